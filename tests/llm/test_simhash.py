import random

import numpy as np
import pytest
import xxhash

from legajo.llm import simhash
from legajo.llm.graph import components


def plain_fingerprint(text, words=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    w = [x for x in lower.split(" ") if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def brute_components(fps, limit=3):
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= limit and label[i] != label[j]:
                    a, b = sorted((label[i], label[j]))
                    label = [a if x == b else x for x in label]
                    changed = True
    return label


TEXTS = [None, "", " \n", "One", "one", "two words", "A b c d e f", "a  b\tc d e f", "é É ü", "a b c d", "\x1c x y z", "w " * 40_000]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_fingerprint_in_blocks(monkeypatch):
    text = " ".join(random.Random(1).choices("alpha beta gamma delta Eps".split(), k=500))
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def near_fps(seed, centers=6, each=12):
    rnd = random.Random(seed)
    fps = {0, (1 << 64) - 1}
    for _ in range(centers):
        c = rnd.getrandbits(64)
        fps.add(c)
        for _ in range(each):
            c ^= sum(1 << b for b in rnd.sample(range(64), rnd.choice([1, 2, 3, 4, 5])))
            fps.add(c)
    return sorted(fps)


PARTS = {
    "four": [simhash.Part(tuple(range(i, 64, 4)), 0) for i in range(4)],
    "three": [simhash.Part(tuple(range(0, 20)), 1), simhash.Part(tuple(range(20, 42)), 0), simhash.Part(tuple(range(42, 64)), 0)],
    "unused": [simhash.Part(tuple(range(0, 10)), -1), simhash.Part(tuple(range(10, 37)), 1), simhash.Part(tuple(range(37, 64)), 1)],
    "planned": None,
}


@pytest.mark.parametrize("name", PARTS)
def test_pairs(spark, name):
    fps = near_fps(3)
    frame = spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp long")
    got = {(r.a, r.b) for r in simhash.near_pairs(frame, 3, PARTS[name]).collect()}
    s = [simhash.signed(x) for x in fps]
    assert got == {(min(a, b), max(a, b)) for i, a in enumerate(s) for b in s[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3}


def test_thresholds_cover_the_limit(spark):
    rng = np.random.default_rng(5)
    bits = rng.random((400, 64)) < np.linspace(0.05, 0.95, 64)
    count, both = len(bits), (bits.T.astype(float) @ bits)
    for m in (2, 3, 4):
        groups = simhash.grouped_bits(count, both, m)
        assert sorted(b for g in groups for b in g) == list(range(64))
        _, parts = simhash.allocate(groups, count, both, {i: 400.0 for i in range(m)}, 3)
        assert sum(p.threshold + 1 for p in parts) == 4


def test_allocation_is_least_of_all():
    groups = [tuple(range(0, 10)), tuple(range(10, 40)), tuple(range(40, 64))]
    both = np.full((64, 64), 250.0)
    np.fill_diagonal(both, np.linspace(20, 980, 64))
    equal = {0: 50_000.0, 1: 1_500.0, 2: 4_000.0}
    total, parts = simhash.allocate(groups, 1000, both, equal, 3)
    p = np.diag(both) / 1000
    agree = p * p + (1 - p) ** 2

    def cost(i, t):
        if t < 0:
            return 0.0
        near = simhash.within(agree[list(groups[i])], 3)
        return simhash.PROBE_COST * 1000 * sum(__import__("math").comb(len(groups[i]), k) for k in range(t + 1)) + simhash.CANDIDATE_COST * min(equal[i] * near[t] / near[0], 1e6) / 2

    options = [sum(cost(i, t) for i, t in enumerate(ts)) for ts in np.ndindex(5, 5, 5) if sum(ts) == 4 for ts in [[t - 1 for t in ts]]]
    assert total == pytest.approx(min(options)) and sum(x.threshold + 1 for x in parts) == 4


def test_correlated_bits_meet():
    rng = np.random.default_rng(7)
    base = rng.random((2000, 16)) < 0.5
    bits = np.repeat(base, 4, axis=1)[:, np.argsort(np.tile(np.arange(4), 16), kind="stable")]
    groups = simhash.grouped_bits(2000, bits.T.astype(float) @ bits, 4)
    same = {b: b % 16 for b in range(64)}
    for g in groups:
        assert len({same[b] for b in g}) == 4


def test_groups(spark):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "one"), (None, "quite alone here")]
    for k in range(8):
        base = rnd.choices(words, k=150)
        for c in range(6):
            changed = list(base)
            for _ in range(c % 3):
                changed[rnd.randrange(150)] = rnd.choice(words)
            rows.append((100 + 10 * k + c, " ".join(changed)))
    rows += rows[-3:]
    fps = [plain_fingerprint(t) for _, t in rows]
    label = brute_components(fps)
    want = sorted(((i, f, min((rows[j][0] for j in range(len(rows)) if label[j] == lb and rows[j][0] is not None), default=None)) for (i, _), f, lb in zip(rows, fps, label, strict=True)), key=str)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_groups(docs).collect()), key=str)
    assert got == want

    kept = simhash.drop_near(docs.selectExpr("text as fp", "doc_id", "text"))
    assert kept.columns == ["fp", "doc_id", "text"] and kept.count() == len(set(label))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_groups(docs).collect() == [] and simhash.drop_near(docs).collect() == []


@pytest.mark.parametrize("edges", [
    [], [(1, 1)], [(1, 2), (2, 1), (2, 3)], [(i, i + 1) for i in range(40)], [(99, i) for i in range(30)] + [(5, 500), (500, 501)], [(-3, -9), (4, -9), (7, 8)],
])
def test_components(spark, edges):
    label = {n: n for e in edges for n in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == label
