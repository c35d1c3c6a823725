import random

import numpy as np
import pytest

from legajo.llm import jaccard
from legajo.llm.queries import QUERIES


def words_of(text):
    w = (text or "").encode().lower().split()
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(rows, percent=80):
    """(n_shingles, component) of each row: by comparison of all pairs."""
    sets, label = [words_of(t) for _, t in rows], list(range(len(rows)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                a, b = sorted((label[i], label[j]))
                label = [a if v == b else v for v in label]
    best = {}
    for (i, _), lb in zip(rows, label, strict=True):
        best[lb] = min(best.get(lb, i), i)
    return sorted((i, len(s), best[lb]) for (i, _), s, lb in zip(rows, sets, label, strict=True))


def near_rows(seed=4):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = [(0, None), (1, " \n"), (2, "One two"), (3, "one  TWO"), (4, "one two three"), (5, ""), (6, "long " * 30_000), (7, "x" * 100_000)]
    common = rnd.choices(vocabulary, k=40)  # a passage that many texts share
    for group in range(12):
        base = (common if group % 2 else []) + rnd.choices(vocabulary, k=rnd.choice([20, 120, 300]))
        for copy in range(7):
            text = list(base)
            for _ in range(rnd.choice([0, 1, 2, 4, 8])):
                text[rnd.randrange(len(text))] = rnd.choice(vocabulary)
            rows.append((1000 - 10 * group - copy, " ".join(text)))
    return rows


@pytest.mark.parametrize("slots", [1, 1 << 16])
def test_prefixes_of_similar_sets_meet(slots):
    sets = [jaccard.shingles(t) for _, t in near_rows()]
    counts = np.zeros(slots, np.int64)
    for s in sets:
        np.add.at(counts, (s & np.uint64(slots - 1)).astype(np.int64), 1)
    for i, x in enumerate(sets):
        for y in sets[:i]:
            both = len(set(x.tolist()) & set(y.tolist()))
            if both and 100 * both >= 80 * (len(x) + len(y) - both):
                first = [set(jaccard.in_order(s, counts)[: jaccard.prefix_length(len(s), 80)].tolist()) for s in (x, y)]
                assert first[0] & first[1]


@pytest.mark.parametrize("slots", [1, 1 << 20])
def test_groups_as_all_pairs(spark, slots):
    rows = near_rows()
    docs = spark.createDataFrame([(t, i, 1, 2) for i, t in rows], "text string, doc_id long, n int, key int")
    got = jaccard.similar_groups(docs, slots=slots).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op12_similar_documents"](spark, sf)
    assert got.columns == ["doc_id", "n_shingles", "component_id"] and sorted(map(tuple, got.collect())) == brute(rows)


def test_a_large_group_costs_its_size(spark, monkeypatch):
    """Six hundred near copies of one text: pairs that meet grow with the group, not with its square."""
    rnd = random.Random(1)
    base = [f"v{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 600):
        text = list(base)
        for _ in range(rnd.randrange(1, 6)):
            text[rnd.randrange(150)] = f"new{i}"
        rows.append((i, " ".join(text)))
    made, real = {}, jaccard.stored

    def stored(df, name):
        out = real(df, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard, "stored", stored)
    got = jaccard.similar_groups(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    assert sorted(map(tuple, got)) == brute(rows)
    assert made["star-pairs"] + made["other-pairs"] < 5 * len(rows)


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (7, "A b c d e f"), (7, "A b c d e f"), (None, "x y"), (None, None), (9, "q r s")], "doc_id long, text string")
    got = jaccard.similar_groups(docs)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(None, 2, 7), (7, 2, 7), (7, 2, 7), (None, 1, None), (None, 0, None), (9, 1, 9)], key=str)
    assert jaccard.similar_groups(docs.limit(0)).collect() == []
