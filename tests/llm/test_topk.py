import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from legajo.llm import topk

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k):
    ok = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in ok:
        if q % 10 == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ok if i != q and len(w) == len(v))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])]
    return sorted(out)


def vectors(seed, n=300, dim=8, spread=3.0):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        size = rnd.random() ** spread * 4
        rows.append((i, [rnd.gauss(0, 1) * size for _ in range(dim)]))
    return rows


CASES = {
    "spread lengths": vectors(1), "near equal lengths": vectors(2, spread=0.0), "one axis": [(i, [float(i % 7 == a) * (i + 1) for a in range(4)]) for i in range(120)],
    "all negative": [(i, [(-1.0) ** i * (i + 1)]) for i in range(40)], "ties": [(i, [1.0, 2.0]) for i in range(60)] + [(100 + i, [0.0, 0.0]) for i in range(30)],
    "odd rows": [*vectors(3, 60), (None, [1.0] * 8), (400, None), (410, []), (420, [1.0, None]), (430, [float("nan")] * 8), (440, [float("inf")] * 8), (450, [1.0, 2.0]), (451, [5.0, 1.0]), (460, [1.0, 2.0, 3.0])],
    "large": [(i, [1e5 * (i % 5 - 2), 3e4 * i]) for i in range(50)],
}


@pytest.mark.parametrize("name", CASES)
def test_equals_brute_force(spark, name):
    rows = CASES[name]
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA), F.col("id") % 10 == 0, 5, bucket_rows=16, block_queries=7)
    assert sorted(map(tuple, got.collect())) == brute(rows, 5)


def test_pruning_leaves_rows_out():
    import pandas as pd

    rng = np.random.default_rng(3)
    v = (rng.normal(size=(500, 8)) * 1000).astype(np.int64)
    rows = pd.DataFrame({"id": np.arange(500), "v": list(v), "norm": np.linalg.norm(v.astype(float), axis=1)})
    q = rows.iloc[:40].copy()
    scores = q["v"].apply(lambda x: np.sort(v @ x)[-6]).to_numpy()
    seen = []
    original = topk.products
    topk.products = lambda r, s: (seen.append(len(r) * len(s)), original(r, s))[1]
    try:
        got = topk.search(rows, q.assign(least=scores.astype(float)), 5)
    finally:
        topk.products = original
    for i in range(40):
        want = sorted(((-int(v[j] @ v[i]), j) for j in range(500) if j != i))[:5]
        own = got[got["query_id"] == i]
        assert sorted(zip((-own["score"]).tolist(), own["vec_id"].tolist(), strict=True))[:5] == want
    assert sum(seen) < 40 * 500


def test_repeated_rows(spark):
    rows = [(10, [1.0, 0.0]), (10, [1.0, 0.0]), (11, [2.0, 0.0]), (11, [2.0, 0.0])]
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA), F.col("id") % 10 == 0, 5).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(10, 1, 11), (10, 2, 11)]


def test_empty(spark):
    assert topk.top_k(spark.createDataFrame([], SCHEMA), F.col("id") % 10 == 0).collect() == []
