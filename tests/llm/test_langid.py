import zlib

import numpy as np
import pytest

from legajo.llm import langid
from legajo.sources.tables import table


def plain_ngrams(text):
    points = []
    for c in text.lower():
        p = ord(c) if c.isalpha() else 32
        if p != 32 or not points or points[-1] != 32:
            points.append(p)
    total, m = np.zeros(langid.SLOTS, int), 2**32
    for n in (1, 2, 3):
        for i in range(len(points) - n + 1):
            x = points[i : i + n]
            h = x[0] * langid.MIX % m
            if n > 1:
                h = ((h ^ (h >> 15)) * langid.MIX + x[1]) % m
            if n > 2:
                h = ((h ^ (h >> 13)) * langid.MIX + x[2] * 3) % m
            total[(h if n == 1 else h * langid.MIX % m) >> 20] += 1
    return total


@pytest.mark.parametrize("text", ["", "a", "ab", "Abc  DÉF--12 g", "漢字🙂かな", "  x  y "])
@pytest.mark.parametrize("block", [1, 2, 3, 1 << 20])
def test_ngrams(monkeypatch, text, block):
    monkeypatch.setattr(langid, "BLOCK", block)
    assert np.array_equal(langid.ngrams(text), plain_ngrams(text))


@pytest.fixture(scope="module")
def model(spark, sf):
    return langid.fit(table(spark, sf, "documents"))


def test_held_out_accuracy(spark, sf, model):
    docs = table(spark, sf, "documents")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    out = langid.identified(docs, model).collect()
    held = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert {r.doc_id for r in docs.select("doc_id", langid.held_out(docs["doc_id"]).alias("h")).where("h").collect()} == {r.doc_id for r in held}
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in out)
    assert sum(r.rejected for r in out) <= 0.01 * len(out)


def test_prediction_is_the_nearest_centroid(spark, sf, model):
    texts = [r.text for r in table(spark, sf, "documents").limit(40).collect()]
    names, score, _ = model.predict(texts)
    for t, n, s in zip(texts, names, score, strict=True):
        x = np.log1p(plain_ngrams(t)) * model.idf
        cosine = model.centroids @ (x / np.linalg.norm(x))
        assert s == pytest.approx(min(cosine.max(), 1)) and n == model.languages[model.owner[cosine.argmax()]]


def test_several_centroids_and_learning_rows_only(spark, sf, model):
    assert len(model.centroids) > len(model.languages)
    docs = table(spark, sf, "documents")
    from pyspark.sql import functions as F

    other = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    again = langid.fit(other)
    assert again.languages == model.languages and np.allclose(again.centroids, model.centroids)


def test_rejection_and_odd_rows(spark, model):
    rows = [(1, None), (1, None), (2, ""), (3, "123 %%%"), (None, "the and of with that"), (5, "漢字かな交じり文です" * 40)]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double")
    out = langid.identified(docs, model)
    assert out.columns == ["doc_id", "text", "lang_pred", "score", "rejected"]
    got = {(r.doc_id, r.lang_pred == "und", r.rejected) for r in out.collect()}
    assert got == {(1, True, True), (2, True, True), (3, True, True), (None, False, False), (5, False, True)}
    assert [r.doc_id for r in langid.identified(docs, model, only_kept=True).collect()] == [None]


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, None, "en"), (2, "text", None), (None, "text", "en"), (4, "12", "en")], "doc_id long, text string, lang string")
    out = langid.identified(docs, langid.fit(docs)).collect()
    assert {r.lang_pred for r in out} == {"und"} and all(r.rejected for r in out)
    assert langid.identified(docs.limit(0), langid.fit(docs.limit(0))).collect() == []

FOREIGN = {
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. Każdy człowiek posiada wszystkie prawa i wolności zawarte w niniejszej deklaracji bez względu na różnice rasy, koloru, płci, języka, wyznania.",
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. Jokainen on oikeutettu kaikkiin tässä julistuksessa esitettyihin oikeuksiin ja vapauksiin ilman minkäänlaista rotuun, väriin, sukupuoleen perustuvaa erotusta.",
    "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler. Herkes, ırk, renk, cinsiyet, dil, din, siyasi veya başka bir akide, milli veya içtimai menşe farkı gözetilmeksizin bu beyannamede ilan olunan tekmil haklardan yararlanabilir.",
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
}


def test_languages_outside_the_learned_ones_are_rejected(spark, sf, model):
    texts = [t * n for t in FOREIGN.values() for n in (1, 20)]
    assert all(model.predict(texts)[2])
    docs = table(spark, sf, "documents").collect()
    assert sum(model.predict([r.text for r in docs])[2]) <= 0.01 * len(docs)


def test_an_odd_text_does_not_widen_the_radius():
    rng = np.random.default_rng(3)
    x = np.abs(rng.normal(1, 0.1, (100, 50)))
    x[0] = np.eye(50)[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert langid.clustered(x, 1, 0.02)[1][0] > 0.9


def test_few_ids_in_many_rows_are_learned(spark):
    """A language whose rows repeat a handful of ids, beside rows without letters."""
    rows = [(i % 3 + 1000 * (i % 3 == 0), "uno dos tres cuatro " * 3, "es") for i in range(3000)] + [(i, "1234 5678", "es") for i in range(2000, 3000)]
    rows += [(5000 + i, f"eins zwei drei vier {i} " * 2, "de") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert set(langid.fit(docs, max_per_language=20).languages) == {"de", "es"}


def test_many_languages_are_learned(spark):
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 300)]
    docs = spark.createDataFrame([(i * 2 + k, c * 30, f"l{i:03d}") for i, c in enumerate(letters) for k in range(2)], "doc_id long, text string, lang string")
    learned = langid.fit(docs).languages
    assert len(learned) > 256
