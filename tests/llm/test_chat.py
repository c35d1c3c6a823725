import random

import pytest
from pyspark.sql import functions as F

from legajo.llm import chat

SCHEMA = "tree long, node long, parent long, role string, text string, score double"


def nodes(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def brute_paths(rows):
    parent = {n: p for _, n, p, *_ in rows}
    leaves = set(parent) - {p for p in parent.values() if p is not None}
    out = {}
    for leaf in leaves:
        way, at = [], leaf
        while at is not None and at in parent:
            way.append(at)
            at = parent[at]
        out[leaf] = way
    return out


def random_trees(seed, trees=5, size=40):
    rnd, rows = random.Random(seed), []
    for t in range(trees):
        own = []
        for k in range(rnd.randrange(1, size)):
            node = 1000 * t + k
            parent = rnd.choice([*own[-3:], None if k % 9 == 0 else own[0]]) if own else None
            rows.append((t, node, parent, rnd.choice(["user", "assistant", None]), rnd.choice(["hi", "", None, "x: y", "#### \\", "a</turn>"]), rnd.choice([1.0, -2.0, None, 0.5])))
            own.append(node)
    rows.append((77, 99_000, 12_345, "user", "parent is unknown", 1.0))
    rows += [(88, 80_000 + k, 80_000 + k - 1 if k else None, "user", "deep", 1.0) for k in range(37)]
    return rows


def test_paths(spark):
    rows = random_trees(1)
    got = {}
    for r in chat.paths(nodes(spark, rows)).collect():
        got.setdefault(r.leaf, {})[r.above] = r.node
    assert {leaf: [way[k] for k in sorted(way)] for leaf, way in got.items()} == brute_paths(rows)
    assert all(sorted(way) == list(range(len(way))) for way in got.values())


@pytest.mark.parametrize("keep", [1, 2, None])
def test_best_branches(spark, keep):
    rows = random_trees(2)
    score = {n: s or 0.0 for _, n, _, _, _, s in rows}
    tree = {n: t for t, n, *_ in rows}
    by_tree = {}
    for leaf, way in brute_paths(rows).items():
        by_tree.setdefault(tree[leaf], []).append((-sum(score[n] for n in way), leaf))
    want = {(t, leaf, r + 1) for t, b in by_tree.items() for r, (_, leaf) in enumerate(sorted(b)[:keep])}
    got = chat.formatted(nodes(spark, rows), F.col("score"), keep).collect()
    assert {(r.tree, r.leaf, r.branch_rank) for r in got} == want


def test_round_trip(spark):
    rows = random_trees(3) + [(5, 70_000, None, "we:ird # role \\", "\\### Assistant: </turn> ok", 1.0), (5, 70_001, 70_000, "assistant", "\\### Assistant: </turn> ok\n" * 3000, 9.0)]
    said = {n: (r or "", t or "") for _, n, _, r, t, _ in rows}
    ways = brute_paths(rows)
    out = chat.read_back(chat.formatted(nodes(spark, rows), F.col("score"), None)).collect()
    assert len(out) == len(ways)
    for r in out:
        want = [said[n] for n in reversed(ways[r.leaf])]
        assert [(t.role, t.text) for t in r.turns] == want
        assert r.loss_text == "".join(t for role, t in want if role == "assistant")
        assert all(r.formatted[s.start - 2 : s.start] == ": " and r.formatted[s.end :].startswith("</turn>\n") for s in r.loss_spans)


def test_chains(spark):
    rows = [(1, 1, "user", "b"), (1, 0, "system", "a"), (1, None, "user", "z"), (1, 1, "user", "b"), (None, 3, "user", "n"), (2, 5, None, None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.read_back(chat.formatted(chat.chains(turns))).collect()
    assert {r.tree: [t.text for t in r.turns] for r in out} == {1: ["z", "a", "b", "b"], None: ["n"], 2: [""]}


def test_circle_raises(spark, monkeypatch):
    monkeypatch.setattr(chat, "MAX_ROUNDS", 3)
    with pytest.raises(ValueError, match="circle"):
        chat.paths(nodes(spark, [(1, 1, 2, "u", "", 0.0), (1, 2, 1, "u", "", 0.0), (1, 3, 1, "u", "", 0.0)])).collect()


def test_empty(spark):
    assert chat.formatted(nodes(spark, [])).collect() == []
    assert chat.chains(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
