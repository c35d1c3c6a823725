"""SimHash fingerprints and near-duplicate groups by the generalised pigeonhole principle."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from legajo.llm.common import checked, map_arrow, stored, with_columns
from legajo.llm.graph import components

BITS = 64
#: Shingles whose bits are counted at once.
BLOCK = 1 << 15


def fingerprint(text: str | None, words: int = 3) -> int:
    """64-bit SimHash: a bit is set if it is set in more than half of the shingles' XXH64 (seed 42).

    A-Z count as a-z; words are runs of bytes other than ASCII white space, so U+00A0 belongs to a word. A text
    of fewer words is one shingle, one without words has fingerprint 0.
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(tokens))
    starts, ends = starts[: len(tokens) - k + 1], ends[k - 1 :]
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), BLOCK):
        shingles = [joined[a:b] for a, b in zip(starts[at : at + BLOCK].tolist(), ends[at : at + BLOCK].tolist(), strict=True)]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, len(shingles))
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(starts), bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, text_col: str = "text", words: int = 3) -> DataFrame:
    """``docs`` with the column ``fp``, a signed long with the 64 bits (it takes the place of one so named)."""
    checked(docs, text_col)
    schema = with_columns(docs.schema, [T.StructField("fp", T.LongType())])
    at, kept = docs.columns.index(text_col), [docs.columns.index(f.name) for f in schema.fields[:-1]]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), words) for t in b.column(at)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in kept], pa.array(fps.view(np.int64))], schema.names)

    return map_arrow(docs, schema, work)


@dataclass(frozen=True)
class Part:
    """A set of bit positions, and how many of them a pair may differ in to become a candidate (-1: not used)."""

    bits: tuple[int, ...]
    threshold: int

    @property
    def mask(self) -> int:
        return sum(1 << b for b in self.bits)

    def flips(self) -> list[int]:
        return [sum(1 << b for b in c) for k in range(self.threshold + 1) for c in combinations(self.bits, k)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and how many have each pair of bits set; partial sums leave the tasks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS), np.int64), 0
        for b in batches:
            x = np.ascontiguousarray(b.column(0).to_numpy(zero_copy_only=False)).view(np.uint8).reshape(-1, 8)
            for at in range(0, len(x), BLOCK):
                bits = np.unpackbits(x[at : at + BLOCK], axis=1, bitorder="little").astype(np.float32)
                total += (bits.T @ bits).astype(np.int64)
            n += len(x)
        if n:
            i, j = np.triu_indices(BITS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(i * BITS + j, -1)), pa.array(np.append(total[i, j], n))], ["cell", "n"]
            )

    sums = map_arrow(fps.select("fp"), "cell long, n long", work).groupBy("cell").agg(F.sum("n").alias("n"))
    both, count = np.zeros((BITS, BITS)), 0
    for r in sums.collect():  # 64 * 65 / 2 + 1 rows at most
        if r["cell"] < 0:
            count = r["n"]
        else:
            i, j = divmod(r["cell"], BITS)
            both[i, j] = both[j, i] = r["n"]
    return count, both


def grouped_bits(count: int, both: np.ndarray, parts: int) -> list[tuple[int, ...]]:
    """Positions in ``parts`` groups of equal size, correlated ones together: each group grows from the position
    most correlated with what is left, by the position most correlated with the group."""
    p = np.diag(both) / max(count, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    tied = np.abs(both / max(count, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(tied, 0)
    left, groups = list(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        group = [max(left, key=lambda b: (tied[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < size:
            nearest = max(left, key=lambda b: (tied[b, group].sum(), -b))
            group.append(nearest)
            left.remove(nearest)
        groups.append(tuple(sorted(group)))
    return groups


def within(agree: np.ndarray, limit: int) -> np.ndarray:
    """Chance that a random pair differs in at most 0..limit of independent bits, from the chance of agreement."""
    exact = np.zeros(limit + 1)
    exact[0] = 1.0
    for a in agree:
        exact[1:] = exact[1:] * a + exact[:-1] * (1 - a)
        exact[0] *= a
    return np.cumsum(exact)


#: Cost of writing, shuffling and sorting a probe against comparing a candidate within the join.
PROBE_COST, CANDIDATE_COST = 1.0, 0.02


def allocate(bits: list[tuple[int, ...]], count: int, both: np.ndarray, equal: dict[int, float], limit: int) -> tuple[float, list[Part]]:
    """Thresholds t with sum(t + 1) = limit + 1 of least estimated cost, by dynamic programming over the parts.

    A pair within ``limit`` differs, in some part, in at most that part's t bits: else it would differ in
    sum(t + 1) > limit bits. ``equal`` has the pairs (ordered, with themselves) that agree in each whole part.
    """
    p = np.diag(both) / max(count, 1)
    agree = p * p + (1 - p) * (1 - p)
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for i, group in enumerate(bits):
        near = within(agree[list(group)], limit)
        pairs = np.minimum(equal.get(i, 0.0) * near / max(near[0], 1e-300), float(count) ** 2)
        cost = {-1: 0.0}
        for t in range(limit + 1):
            cost[t] = PROBE_COST * count * sum(comb(len(group), k) for k in range(t + 1)) + CANDIDATE_COST * pairs[t] / 2
        after: dict[int, tuple[float, tuple[int, ...]]] = {}
        for used, (so_far, chosen) in best.items():
            for t, c in cost.items():
                if (k := used + t + 1) <= limit + 1 and so_far + c < after.get(k, (float("inf"),))[0]:
                    after[k] = (so_far + c, (*chosen, t))
        best = after
    total, chosen = best[limit + 1]
    return total, [Part(b, t) for b, t in zip(bits, chosen, strict=True)]


def plan_parts(fps: DataFrame, limit: int = 3) -> list[Part]:
    """The cheapest division into 1 to limit + 1 parts, from counts over all fingerprints."""
    count, both = bit_statistics(fps)
    options = [grouped_bits(count, both, m) for m in range(2, limit + 2)] or [[tuple(range(BITS))]]
    masks = [(m, i, signed(Part(g, 0).mask)) for m, groups in enumerate(options) for i, g in enumerate(groups)]
    values = F.explode(F.array(*[
        F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(mask)).alias("v")) for m, i, mask in masks
    ]))
    sizes = (
        fps.select(values.alias("x")).groupBy("x.m", "x.i", "x.v").agg(F.count("*").cast("double").alias("n"))
        .groupBy("m", "i").agg(F.sum(F.col("n") * F.col("n")).alias("pairs")).collect()
    )  # one row for each part
    equal = {(r["m"], r["i"]): r["pairs"] for r in sizes}
    plans = [
        allocate(g, count, both, {i: equal.get((m, i), 0.0) for i in range(len(g))}, limit) for m, g in enumerate(options)
    ]
    return min(plans, key=lambda x: x[0])[1]


def near_pairs(fps: DataFrame, limit: int = 3, parts: list[Part] | None = None) -> DataFrame:
    """All pairs ``a, b`` of the distinct fingerprints in ``fps`` that differ in 1 to ``limit`` bits.

    Every fingerprint is filed under its value in each used part, and asks for its own value and those within
    the part's threshold. The join compares whole fingerprints inside itself, so only true pairs leave it; Spark
    splits values that many share. A fingerprint has at most sum(C(64, k)) partners, however many copies a text has.
    """
    used = [p for p in (parts or plan_parts(fps, limit)) if p.threshold >= 0]

    def keyed(part: int, flips: list[int]) -> Column:
        """The part's value in a fingerprint, with each of ``flips`` applied."""
        value = F.col("fp").bitwiseAND(F.lit(signed(used[part].mask)))
        return F.transform(
            F.array(*[F.lit(signed(x)) for x in flips]), lambda x: F.struct(F.lit(part).alias("part"), value.bitwiseXOR(x).alias("value"))
        )

    own = F.concat(*[keyed(i, [0]) for i in range(len(used))])
    filed = fps.select(F.col("fp").alias("a"), F.explode(own).alias("k")).select("a", "k.part", "k.value")
    asked = F.concat(*[keyed(i, p.flips()) for i, p in enumerate(used)])
    probes = fps.select(F.col("fp").alias("b"), F.explode(asked).alias("k")).select("b", "k.part", "k.value")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= limit)
    same = (filed["part"] == probes["part"]) & (filed["value"] == probes["value"])
    return filed.join(probes, same & near).select("a", "b").distinct()


def _components(rows: DataFrame, limit: int) -> DataFrame:
    """``fp, label, least`` for each distinct ``fp`` of ``rows`` (``doc_id, fp``): a label for each component."""
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-classes")
    linked = components(near_pairs(classes.select("fp"), limit)).withColumnRenamed("node", "_node")
    return classes.join(linked, F.col("fp") == F.col("_node"), "left").select(
        "fp", F.coalesce("component", "fp").alias("label"), "least"
    )


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, limit: int = 3) -> DataFrame:
    """``doc_id, fp, component_id`` for each row: linked are fingerprints that differ in at most ``limit`` bits,
    a component is what links reach, and its id the smallest doc_id in it.

    Copies meet in their fingerprint before anything is compared. Null or wordless texts have fingerprint 0 and
    link like any other. Rows with a null id are part of their component but never name it, unless it has no
    other rows (null). Repeated rows give repeated rows; an empty table an empty result.
    """
    checked(docs, id_col, text_col)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = stored(with_fingerprints(narrow, "text", words).select("doc_id", "fp"), "fingerprints")
    whole = _components(rows, limit)
    names = whole.groupBy("label").agg(F.min("least").alias("component_id"))
    return rows.join(whole.join(names, "label").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, limit: int = 3) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component the row with the smallest id.

    Null ids come last. Of rows that share the smallest id, that with the smallest fingerprint stays, and of rows
    that share both, the smallest by its columns in their order.
    """
    checked(docs, id_col, text_col)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("_row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    full = stored(with_fingerprints(rows, "_text", words).drop("_text"), "fingerprinted")
    members = full.groupBy("fp", "doc_id").agg(F.count("*").alias("copies"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "fp", "copies"))
    stay = members.join(_components(full.select("doc_id", "fp"), limit), "fp").groupBy("label").agg(first.alias("s"))
    stay = stay.select(F.col("s.doc_id").alias("_id"), F.col("s.fp").alias("_fp"), "s.copies")

    def matched(part: DataFrame) -> DataFrame:
        return full.join(part, full["doc_id"].eqNullSafe(part["_id"]) & (full["fp"] == part["_fp"]))

    several = matched(stay.where("copies > 1")).groupBy("doc_id", "fp").agg(F.min("_row").alias("_row"))
    return matched(stay.where("copies = 1")).select("_row").unionAll(several.select("_row")).select("_row.*")
