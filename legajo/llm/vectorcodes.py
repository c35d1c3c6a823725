"""Product quantisation of vectors in whole numbers, over Hilbert-sorted blocks whose boxes rule out codebook entries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from legajo.llm.common import checked, map_arrow, stored

#: Parts of vectors in a block.
BLOCK = 256
#: Bits of a Hilbert key, shared by the components of a part.
KEY_BITS = 62


class Codes(NamedTuple):
    """What ``compressed`` gives: a row per vector, and the final entries as ``[part][entry][component]``."""

    rows: DataFrame
    codebooks: list[list[list[int]]]


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Places of ``points`` (rows of whole numbers below ``2 ** bits``) along the Hilbert curve through their space.

    From the highest bit down, the axes of each sub-cube are swapped or mirrored as the curve turns there; a Gray
    code over the axes then gives the digit.
    """
    x = points.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for i in range(n):
            mirrored = (x[i] & bit) != 0
            swap = np.where(mirrored, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(mirrored, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= turn
    keys = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            keys = (keys << 1) | ((x[i] >> level) & 1)
    return keys


def quantised(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, parts: int, scale: int) -> DataFrame:
    """``id, label, v`` of the vectors that take part: ``v`` is ``floor(scale * component)``, held within bounds that
    keep every sum of squares below 2 ** 63."""
    x = F.col(f"`{vector_col}`")
    good = ~F.coalesce(F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))), F.lit(True))
    rows = vectors.where(good & (F.size(x) > 0) & (F.size(x) % parts == 0))
    # (2 * bound) ** 2 * size stays below 2 ** 62
    bound = F.pow(F.lit(2.0), F.floor((F.lit(60.0) - F.ceil(F.log2(F.size(x).cast("double")))) / 2))
    whole = F.transform(x, lambda c: F.greatest(-bound, F.least(bound, F.floor(F.greatest(-bound, F.least(bound, c.cast("double") * scale))).cast("double"))).cast("long"))
    return rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), whole.alias("v"))


BLOCK_ROWS = "part int, n int, low array<long>, high array<long>, sums array<long>, members binary, ids array<long>"


def blocks(rows: DataFrame, parts: int, size: int = BLOCK) -> DataFrame:
    """``rows`` (``rid, v``) as blocks: for each part position, the vectors' parts in the order of a Hilbert curve,
    ``size`` together, with the least and largest value of each component, their sums and the parts themselves."""
    width = rows.select(F.size("v").alias("n")).first()["n"] // parts
    found = rows.select(F.posexplode("v").alias("k", "x")).groupBy("k").agg(F.min("x").alias("low"), F.max("x").alias("high")).collect()
    low, high = np.zeros(parts * width, np.int64), np.zeros(parts * width, np.int64)
    for r in found:  # a row for each component of a vector
        low[r["k"]], high[r["k"]] = r["low"], r["high"]
    axes = min(width, KEY_BITS)  # longer parts are sorted by their first components
    bits = max(1, min(16, KEY_BITS // axes))
    span = np.maximum(high - low, 1).astype(np.float64)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column(1).flatten().to_numpy().reshape(-1, parts * width)
            cell = np.minimum(((v - low) / span * (1 << bits)).astype(np.int64), (1 << bits) - 1)
            for p in range(parts):
                here = slice(p * width, p * width + axes)
                own = np.ascontiguousarray(v[:, p * width : (p + 1) * width])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(v), p, np.int32)), pa.array(hilbert_keys(cell[:, here], bits)), b.column(0),
                    pa.array([x.tobytes() for x in own], pa.binary()),
                ], ["part", "key", "rid", "own"])

    def block(part: int, ids: list[np.ndarray], own: list[np.ndarray]) -> pa.RecordBatch:
        x, r = np.concatenate(own), np.concatenate(ids)
        return pa.RecordBatch.from_pylist([{
            "part": part, "n": len(x), "low": x.min(0).tolist(), "high": x.max(0).tolist(), "sums": x.sum(0).tolist(),
            "members": x.tobytes(), "ids": r.tolist(),
        }], schema)

    integers = pa.list_(pa.int64())
    schema = pa.schema([("part", pa.int32()), ("n", pa.int32()), ("low", integers), ("high", integers), ("sums", integers), ("members", pa.binary()), ("ids", integers)])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, many, ids, own = -1, 0, [], []
        for b in batches:
            of, rid = b.column(0).to_numpy(), b.column(1).to_numpy()
            at = 0
            while at < b.num_rows:
                if many and (of[at] != part or many == size):
                    yield block(part, ids, own)
                    many, ids, own = 0, [], []
                part = int(of[at])
                end = min(at + size - many, at + int(np.searchsorted(of[at:], part, "right")))
                data = b"".join(b.column(2).slice(at, end - at).to_pylist())
                own.append(np.frombuffer(data, np.int64).reshape(-1, width))
                ids.append(rid[at:end])
                many += end - at
                at = end
        if many:
            yield block(part, ids, own)

    order = ["part", "key", "rid"]
    spread = map_arrow(rows.select("rid", "v"), "part int, key long, rid long, own binary", cut)
    spread = spread.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(map_arrow(spread.select("part", "rid", "own"), BLOCK_ROWS, gather), "blocks")


def shortlists(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """For each box (rows of ``low`` and ``high``) the entries that may be nearest to something in it: those whose
    least distance to the box is not above the least of all entries' largest distances."""
    below, above = low[:, None, :] - entries[None], entries[None] - high[:, None, :]
    outside = np.maximum(np.maximum(below, above), 0)
    farthest = np.maximum(np.abs(below), np.abs(above))  # from an entry to the far side of the box, at most
    farthest = np.maximum(farthest, np.maximum(np.abs(entries[None] - low[:, None, :]), np.abs(high[:, None, :] - entries[None])))
    return (outside**2).sum(2) <= (farthest**2).sum(2).min(1)[:, None]


def nearest(members: np.ndarray, entries: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest of the entries named by ``short`` (ascending) for each member, and the squared distance."""
    best = ((members - entries[short[0]]) ** 2).sum(1)
    index = np.full(len(members), short[0], np.int64)
    for k in short[1:]:
        d = ((members - entries[k]) ** 2).sum(1)
        nearer = d < best
        best[nearer], index[nearer] = d[nearer], k
    return index, best


def _boxes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    part = batch.column("part").to_numpy()
    wide = [batch.column(c).flatten().to_numpy().reshape(batch.num_rows, -1) for c in ("low", "high", "sums")]
    return part, *wide


def _round(filed: DataFrame, books: list[np.ndarray]) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """How many parts are nearest to each entry, and their sums: by (part, entry). A block with one entry left gives
    its stored sums; only the others are looked into."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = [np.zeros(len(e), np.int64) for e in books]
        total = [np.zeros((len(e), e.shape[1]), object) for e in books]
        for b in batches:
            part, low, high, sums = _boxes(b)
            for p in np.unique(part).tolist():
                here = np.flatnonzero(part == p)
                left = shortlists(low[here], high[here], books[p])
                for i, short in zip(here.tolist(), left, strict=True):
                    short = np.flatnonzero(short)
                    if len(short) == 1:
                        many[p][short[0]] += b.column("n")[i].as_py()
                        total[p][short[0]] += sums[i].astype(object)
                        continue
                    own = np.frombuffer(b.column("members")[i].as_buffer(), np.int64).reshape(-1, low.shape[1])
                    index, _ = nearest(own, books[p], short)
                    for k in short.tolist():
                        mine = own[index == k]
                        many[p][k] += len(mine)
                        total[p][k] += mine.sum(0).astype(object)
        rows = [(p, k, int(many[p][k]), j, int(total[p][k][j])) for p, e in enumerate(books) for k in range(len(e)) if many[p][k] for j in range(e.shape[1])]
        names = ["part", "entry", "n", "at", "total"]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.decimal128(38, 0)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    sums = map_arrow(filed, "part int, entry int, n long, at int, total decimal(38,0)", work)
    sums = sums.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    out: dict[tuple[int, int], tuple[int, list[int]]] = {}
    for r in sorted(sums.collect(), key=lambda r: (r["part"], r["entry"], r["at"])):  # as many rows as codebooks have numbers
        out.setdefault((r["part"], r["entry"]), (r["n"], []))[1].append(int(r["total"]))
    return out


def seeds(rows: DataFrame, parts: int, entries: int) -> list[np.ndarray]:
    """For each part position that part of the vectors with the smallest ids (null last), ties by the vector."""
    first: list[Row] = rows.orderBy(F.asc_nulls_last("id"), "v").select("v").limit(entries).collect()
    v = np.array([r["v"] for r in first], np.int64)
    return [np.ascontiguousarray(x) for x in np.split(v, parts, axis=1)]


def compressed(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 8,
    entries: int = 16, rounds: int = 6, scale: int = 4096,
) -> Codes:
    """Rows ``id, label, codes, error`` (and the codebooks): ``codes`` has, for each of ``parts`` equal stretches of the
    vector, the index of the nearest entry in that stretch's codebook, ``error`` is the sum of squared distances.

    Components are ``floor(scale * x)``. A codebook starts as that part of the ``entries`` smallest ids; in each round
    every part goes to its nearest entry (ties to the lower index) and an entry becomes the floor of its parts' mean;
    an entry without parts stays. All arithmetic is in whole numbers, so partitioning never changes a result.

    Vectors that are null, empty, of another length than the smallest id's or no multiple of ``parts``, or that hold
    null or non-finite components take no part; fewer vectors than ``entries`` give smaller codebooks. Components are
    held within +-2 ** 27 after scaling (at 64 components), so that no sum overflows. Repeated ids are rows of their
    own; extra columns are ignored. An empty table gives no rows and no codebooks. ``entries``: 256 at most.
    """
    checked(vectors, id_col, vector_col, label_col)
    kept = stored(quantised(vectors, id_col, vector_col, label_col, parts, scale).withColumn("rid", F.monotonically_increasing_id()), "vectors")
    first = kept.orderBy(F.asc_nulls_last("id"), "v").select(F.size("v").alias("n")).first()
    kinds = kept.select("id", "label").schema
    if first is None:
        empty = kept.select("id", "label", F.lit(None).cast("array<int>").alias("codes"), F.lit(None).cast("long").alias("error"))
        return Codes(empty, [])
    same = kept.where(F.size("v") == first["n"])
    filed = blocks(same, parts)
    books = seeds(same, parts, entries)
    for _ in range(rounds):
        for (p, k), (n, total) in _round(filed, books).items():
            books[p][k] = [t // n for t in total]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part, low, high, _ = _boxes(b)
            for i, p in enumerate(part.tolist()):
                own = np.frombuffer(b.column("members")[i].as_buffer(), np.int64).reshape(-1, low.shape[1])
                short = np.flatnonzero(shortlists(low[i : i + 1], high[i : i + 1], books[p])[0])
                index, far = nearest(own, books[p], short)
                ids = b.column("ids").slice(i, 1).flatten()
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(own), p, np.int32)), pa.array(index.astype(np.int32)), pa.array(far)], ["rid", "part", "code", "far"])

    each = map_arrow(filed.select("part", "n", "low", "high", "sums", "members", "ids"), "rid long, part int, code int, far long", assign)
    whole = each.groupBy("rid").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("part", "code"))), lambda x: x["code"]).alias("codes"), F.sum("far").alias("error"),
    )  # a group has a row for each part
    rows = stored(same.select("rid", *kinds.names).join(whole, "rid").drop("rid"), "codes")
    return Codes(rows, [b.tolist() for b in books])


def codebooks_sha256(codebooks: list[list[list[int]]]) -> str:
    """Hex SHA-256 of all entries' components as decimal numbers, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(x) for part in codebooks for entry in part for x in entry).encode()).hexdigest()


def with_label_error(rows: DataFrame) -> DataFrame:
    """``rows`` with ``label_error``, the error of all rows with an equal label; null labels are alike. Partial sums are
    made before the shuffle, and Spark splits a label that many rows share when it joins them."""
    sums = rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return rows.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
