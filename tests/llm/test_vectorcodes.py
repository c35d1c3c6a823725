import hashlib
import math
import random

import numpy as np
import pytest

from legajo.llm import vectorcodes as vc


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    """(id, label, codes, error) of each row and the codebooks, with Python's own whole numbers."""
    kept = [(i, lb, [math.floor(scale * x) for x in v]) for i, v, lb in rows if v and not any(x is None or not math.isfinite(x) for x in v)]
    if not kept:
        return [], []
    width = len(kept[0][2]) // parts
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    books = [[r[2][p * width : (p + 1) * width] for r in order[:entries]] for p in range(parts)]

    def nearest(own, book):
        return min((sum((a - b) ** 2 for a, b in zip(own, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            mine = [[] for _ in books[p]]
            for _, _, v in kept:
                own = v[p * width : (p + 1) * width]
                mine[nearest(own, books[p])[1]].append(own)
            books[p] = [[sum(x) // len(m) for x in zip(*m, strict=True)] if m else e for m, e in zip(mine, books[p], strict=True)]
    out = []
    for i, lb, v in kept:
        found = [nearest(v[p * width : (p + 1) * width], books[p]) for p in range(parts)]
        out.append((i, lb, [k for _, k in found], sum(d for d, _ in found)))
    return out, books


def vectors(n, width, seed=2):
    rnd = random.Random(seed)
    rows = [(i, [rnd.gauss(0, 1) * (1 + i % 3) for _ in range(width)], rnd.choice([None, 1, 2])) for i in range(n)]
    rows += [(10 + n, None, 1), (11 + n, [], 1), (12 + n, [None] + [0.5] * (width - 1), 1), (13 + n, [float("nan")] * width, 2), (14 + n, [float("-inf")] * width, 2)]
    same = rows[5][1]
    return rows + [(100 + n + k, same, 9) for k in range(n // 2)] + [(3, rows[4][1], 1), (3, rows[3][1], 1), (None, rows[2][1], None)]


@pytest.mark.parametrize(("n", "width"), [(120, 16), (400, 8), (9, 24)])
def test_codes_as_brute_force(spark, n, width, monkeypatch):
    monkeypatch.setattr(vc, "BLOCK", 16)
    rows = vectors(n, width)
    docs = spark.createDataFrame([(lb, v, i, 0, "x") for i, v, lb in rows], "label int, embedding array<double>, vec_id long, part int, codes string").repartition(5)
    got = vc.compressed(docs)
    want, books = brute(rows)
    assert got.codebooks == books
    assert sorted(map(tuple, got.rows.collect()), key=str) == sorted(want, key=str)
    sums = {}
    for _, lb, _, e in want:
        sums[lb] = sums.get(lb, 0) + e
    assert {(r.label, r.label_error) for r in vc.with_label_error(got.rows).collect()} == set(sums.items())


def test_equal_distances_take_the_lower_index(spark):
    rows = [(0, [0.0] * 8, 0), (1, [0.0] * 8, 0), (2, [2.0] * 8, 0), (3, [1.0] * 8, 0)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = vc.compressed(docs, entries=3, rounds=0)
    assert {r.id: r.codes[0] for r in got.rows.collect()} == {0: 0, 1: 0, 2: 2, 3: 0}


def test_extreme_components_are_held(spark):
    rows = [(i, [1e30 * (-1) ** i] * 8, 0) for i in range(4)]
    got = vc.compressed(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), entries=2)
    assert sorted((r.id, r.error) for r in got.rows.collect()) == [(0, 0), (1, 0), (2, 0), (3, 0)]


def test_neighbours_on_the_curve_are_neighbours_in_space():
    for axes, bits in ((2, 4), (3, 3), (5, 2), (1, 6)):
        grid = np.stack([g.ravel() for g in np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij")], 1)
        keys = vc.hilbert_keys(grid, bits)
        assert sorted(keys.tolist()) == list(range(len(grid)))
        walk = grid[np.argsort(keys)]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_shortlists_keep_every_nearest_entry():
    rnd = np.random.default_rng(3)
    for _ in range(60):
        own, entries = rnd.integers(-9, 9, (12, 4)) * rnd.integers(1, 4), rnd.integers(-12, 12, (10, 4))
        short = np.flatnonzero(vc.shortlists(own.min(0)[None], own.max(0)[None], entries)[0])
        all_of_them = vc.nearest(own, entries, np.arange(10))
        assert [x.tolist() for x in vc.nearest(own, entries, short)] == [x.tolist() for x in all_of_them]


def test_empty_and_digest(spark):
    none = vc.compressed(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))
    assert none.codebooks == [] and vc.with_label_error(none.rows).collect() == []
    assert vc.codebooks_sha256([[[1, -2], [3, 4]], [[5, 6]]]) == hashlib.sha256(b"1,-2,3,4,5,6").hexdigest()
