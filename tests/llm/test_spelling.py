import random
import re
import zlib
from collections import Counter

import pytest

from legajo.llm import spelling
from legajo.llm.queries import QUERIES


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def counted(rows):
    seen = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    return seen


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows, least=7, occurrences=2):
    words = {w: n for w, n in counted(rows).items() if len(w) >= least and n >= occurrences}
    near = {w: [x for x in words if abs(len(x) - len(w)) <= 1 and one_edit(w, x)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-words[x], x), default=None)
        if best and words[best] >= 10 * words[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, n, len(near[w]), form.get(w), words.get(form.get(w)), root(w)) for w, n in words.items())


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(8)
    letters = "abcé"
    words = ["".join(rnd.choices(letters, k=rnd.randrange(6, 11))) for _ in range(60)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "caaaaaa", "ab" * 40, "ab" * 40 + "a", "z" * 3000, "z" * 2999]
    often = {w: rnd.choice([1, 2, 3, 30, 400]) for w in words}
    for w in words[:40]:
        for _ in range(4):
            k = rnd.randrange(len(w))
            often[rnd.choice([w[:k] + w[k + 1 :], w[:k] + rnd.choice(letters) + w[k:], w[:k] + rnd.choice(letters) + w[k + 1 :]])] = rnd.choice([2, 3, 40])
    often |= {"rootword": 700, "rootwordo": 40, "rootwordom": 3}
    stream = [w for w, n in often.items() for _ in range(n)]
    rnd.shuffle(stream)
    texts = [" ".join(stream[i : i + 50]) for i in range(0, len(stream), 50)]
    return [(i, t.upper() if i % 3 == 0 else t) for i, t in enumerate(texts)] + [(None, None), (None, "Solo, solo-solo"), (3, ""), (3, "1234 _")]


def test_all_words(spark, rows):
    docs = spark.createDataFrame([(t, i, 1, "x") for i, t in rows], "text string, doc_id long, n int, word string")
    got = spelling.variants(docs)
    assert got.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    got = sorted(map(tuple, got.collect()))
    assert got == brute(rows) and any(r[5] not in (r[0], r[3]) for r in got) and max(r[2] for r in got) > 3


def test_query(spark, sf):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op11_spelling_variants"](spark, sf).select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(texts), key=str)


def test_one_frequent_prefix(spark):
    """A third of all words begin alike: their states share nodes, and each still meets its neighbours only."""
    rnd = random.Random(3)
    words = ["common" + "".join(rnd.choices("abcdefgh", k=4)) for _ in range(300)] + ["".join(rnd.choices("abcdefghij", k=8)) for _ in range(600)]
    rows = [(i, " ".join([w, w, w])) for i, w in enumerate(words)]
    assert sorted(map(tuple, spelling.variants(spark.createDataFrame(rows, "doc_id int, text string")).collect()), key=str) == sorted(brute(rows), key=str)


def test_empty(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert spelling.variants(spark.createDataFrame([(1, "short words only")], "doc_id long, text string")).collect() == []


def test_counts_from_a_length_on(spark, rows):
    """Short runs are left out before they are counted, also those that get too short by losing a character."""
    docs = spark.createDataFrame([*rows, *((i, "Palabra palabra PALABRA été") for i in range(200))], "doc_id long, text string")
    whole = sorted(map(tuple, spelling.word_counts(docs).where("char_length(word) >= 7").collect()))
    assert sorted(map(tuple, spelling.word_counts(docs, least=7).collect())) == whole and "palabra" in dict(whole)
    assert all(len(w) >= 7 for w, _ in spelling.words_of(1, ["Palabras"] * 3 + ["palabras"], 10**9))
    assert sorted(spelling.words_of(1, ["Palabras"] * 3 + ["palabras"], 10**9)) == [("palabras", 1), ("palabras", 3)]
