import random

import numpy as np
import pytest

from legajo.llm import quality


def corpus(n=240, seed=1):
    rnd, words = random.Random(seed), [f"{a}{b}" for a in "bcdfg" for b in "aeiou"]
    rows, grades = [], []
    for i in range(n):
        text = rnd.choices(words, k=rnd.randrange(30, 80))
        grade = i % 3
        if grade == 0:
            text = [w.upper() + "!!" for w in text]
        if grade == 1:
            text = ["nasty" if k % 9 == 0 else w for k, w in enumerate(text)]
        rows.append((i, " ".join(text)))
        grades.append((i, grade))
    return rows, grades


def frames(spark, rows, grades):
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(grades, "doc_id long, grade int")


def test_shapes():
    assert [quality.shape(w) for w in ("abc", "Abc", "A", "ABC!!", "a1b22", "###", "Éa-é")] == ["a", "Aa", "A", "A!", "a0a0", "#", "Aa-a"]


def test_held_out_grades(spark):
    rows, grades = corpus()
    docs, ratings = frames(spark, rows, grades)
    model = quality.fit(docs, ratings.where("doc_id % 4 <> 0"))
    assert list(model.thresholds) == sorted(model.thresholds)
    out = {r.doc_id: r for r in quality.scored(docs, model).collect()}
    test = [(i, g) for i, g in grades if i % 4 == 0]
    assert np.mean([out[i].kept == (g > 0) for i, g in test]) > 0.95
    means = [np.mean([out[i].expected_grade for i, g in test if g == k]) for k in range(3)]
    assert means[0] + 0.3 < means[1] < means[2] - 0.2
    strict = {r.doc_id: r.tail_probability for r in quality.scored(docs, model, at_least=2).collect()}
    assert all(strict[i] <= out[i].tail_probability for i in strict)


def test_score_equals_the_counts():
    rows, grades = corpus(60)
    slots = quality.Slots()
    model = quality.fit_rows([(g, *quality.counts(t, slots)) for (_, t), (_, g) in zip(rows, grades, strict=True)])
    for _, text in [*rows[:10], (0, ""), (0, None), (0, "a a a a b")]:
        used, share = quality.counts(text, slots)
        assert model.score(text, slots) == pytest.approx(float(model.weights[used] @ share))


def test_blocks(monkeypatch):
    text = " ".join(random.Random(2).choices(["a", "B!", "cc", "cc"], k=300))
    whole = quality.counts(text, quality.Slots())
    monkeypatch.setattr(quality, "BLOCK", 7)
    parts = quality.counts(text, quality.Slots())
    assert np.array_equal(whole[0], parts[0]) and np.allclose(whole[1], parts[1])


def test_gradient_lowers_the_loss():
    rows, grades = corpus(90)
    slots = quality.Slots()
    data = [(g, *quality.counts(t, slots)) for (_, t), (_, g) in zip(rows, grades, strict=True)]

    def loss(model):
        eta = np.array([model.weights[i] @ v for _, i, v in data])
        tails = np.hstack([np.ones((len(data), 1)), model.tails(eta), np.zeros((len(data), 1))])
        return -np.mean([np.log(max(tails[k, g] - tails[k, g + 1], 1e-12)) for k, (g, _, _) in enumerate(data)])

    losses = [loss(quality.fit_rows(data, rounds=r)) for r in (0, 20, 120)]
    assert losses[0] > losses[1] > losses[2]


@pytest.mark.parametrize("grades", [[], [(1, 2)], [(1, None), (None, 1)]])
def test_few_ratings_keep_all(spark, grades):
    docs, ratings = frames(spark, [(1, "a b"), (2, None), (None, "")], grades)
    out = quality.scored(docs, quality.fit(docs, ratings)).collect()
    assert len(out) == 3 and all(r.kept for r in out)
    assert quality.scored(docs, quality.fit(docs, ratings), at_least=1, only_kept=True).count() == 3


def test_query_without_labels_keeps_all(spark, sf, tmp_path):
    from legajo.llm.queries import QUERIES
    spark.read.parquet(f"{sf}/documents.parquet").limit(20).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    got = QUERIES["op4_quality_grades"](spark, str(tmp_path)).collect()
    assert len(got) == 20 and all(r.kept for r in got)


def test_odd_rows_and_names(spark):
    rows, grades = corpus(60)
    docs, ratings = frames(spark, rows, grades + grades[:5])
    model = quality.fit(docs, ratings, max_per_grade=10)
    odd = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "", "y"), (3, "bad " * 50_000, None)], "doc_id long, text string, Kept string")
    out = quality.scored(odd, model)
    assert out.columns == ["doc_id", "text", "expected_grade", "tail_probability", "kept"] and out.count() == 4
    assert quality.scored(odd, model, only_kept=True).columns == odd.columns
    assert quality.scored(odd.limit(0), model).collect() == []


def test_graded(spark):
    from pyspark.sql import functions as F

    rows = [(0, 0), (0, 1), (1, 1), (1, 0), (1, None), (None, 1)]
    got = spark.createDataFrame(rows, "q int, t int").select(quality.graded(F.col("q"), F.col("t")).alias("g")).collect()
    assert [r.g for r in got] == [0, 0, 1, 2, 2, None]
