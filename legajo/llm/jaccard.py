"""Similarity join of documents by the Jaccard similarity of their word shingles, and the components it links."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legajo.llm.common import checked, map_arrow, stored
from legajo.llm.graph import components

#: Slots in which shingles are counted, to order them from rare to frequent: their number is the size of what every
#: task gets (four bytes each). A shingle in more than a few thousandths of all texts stands out at every input size.
SLOTS = 1 << 20
#: Ranges of hashes in which the shingles of a text are counted for the suffix filter.
RANGES = 64
#: Bits that mark the shingles of long posting lists, and the texts whose sets are wanted; where values are more than
#: bits, more rows are looked at, none less.
MARKS = 1 << 25


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes. A-Z count as a-z, words are runs of bytes other than
    ASCII white space; a text of fewer words is one shingle, one without words has none."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    word = np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))
    k = min(words, len(tokens))
    n = len(tokens) - k + 1
    mixed = np.full(n, k, np.uint64)
    for i in range(k):
        mixed = (mixed ^ word[i : i + n]) * np.uint64(0x9FB21C651E98DF25)
        mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def key(own: np.ndarray) -> int:
    """A 64-bit name of a set of shingles, 0 for the empty one."""
    return (xxhash.xxh64_intdigest(own.tobytes(), 7) or 1) if len(own) else 0


def prefix_length(n: int, percent: int) -> int:
    """So many of the rarest of ``n`` shingles that two sets of similarity ``percent`` or more share one of them."""
    return n - -(-n * percent // 100) + 1 if n else 0


def in_order(own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``own`` from rare to frequent, as the slot counts tell; ties by hash."""
    return own[np.lexsort((own, counts[own & np.uint64(len(counts) - 1)]))]


#: Bytes of a hash that the comparison of two sets uses.
KEPT_BYTES = 6


def packed(own: np.ndarray) -> bytes:
    """The upper ``KEPT_BYTES`` bytes of each hash."""
    return np.ascontiguousarray(own.view(np.uint8).reshape(-1, 8)[:, 8 - KEPT_BYTES :]).tobytes()


def unpacked(data: object) -> np.ndarray:
    wide = np.zeros((len(data) // KEPT_BYTES, 8), np.uint8)
    wide[:, 8 - KEPT_BYTES :] = np.frombuffer(data, np.uint8).reshape(-1, KEPT_BYTES)
    return wide.view(np.uint64).reshape(-1)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))


class Sets(NamedTuple):
    """``rows``: ``doc_id, n, key, ranges`` of each text: size and name of its set, and how many of it fall into each
    range; ``counts``: how many texts have a shingle in each slot."""

    rows: DataFrame
    counts: np.ndarray


def _sets(texts: DataFrame, words: int, slots: int) -> Sets:
    """One pass over the texts, stored. Slot counts leave a task in chunks, and are summed as they come in."""
    kind = texts.schema["doc_id"].dataType.simpleString()
    shift = np.uint64(64 - (RANGES.bit_length() - 1))
    size = min(slots, 1 << 12)
    names = ["doc_id", "n", "key", "ranges", "chunk", "counts"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, ids = np.zeros(slots, np.uint32), None
        for b in batches:
            sets = [shingles(t.as_py(), words) for t in b.column(1)]
            for s in sets:
                np.add.at(total, (s & np.uint64(slots - 1)).astype(np.int64), 1)
            ranges = [np.minimum(np.bincount((s >> shift).astype(np.int64), minlength=RANGES), 32_767).astype(np.int16) for s in sets]
            keys, ids, m = np.array([key(s) for s in sets], np.uint64).view(np.int64), b.column(0), b.num_rows
            yield pa.RecordBatch.from_arrays([
                ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(keys), pa.array(ranges, pa.list_(pa.int16())),
                pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()),
            ], names)
        if ids is not None:
            for k in range(slots // size):
                part = total[k * size : (k + 1) * size]
                if part.any():
                    yield pa.RecordBatch.from_arrays([
                        pa.nulls(1, ids.type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int16())),
                        pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary()),
                    ], names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                part = np.frombuffer(data.as_buffer(), np.uint32)
                sums[k] = sums[k] + part if k in sums else part.astype(np.int64)
        for k, part in sums.items():
            data = np.minimum(part, np.iinfo(np.uint32).max).astype(np.uint32).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([data], pa.binary())], ["chunk", "counts"])

    found = stored(map_arrow(texts, f"doc_id {kind}, n long, key long, ranges array<smallint>, chunk int, counts binary", work), "sets")
    chunks = found.where("chunk is not null").select("chunk", "counts")
    counts = np.zeros(slots, np.uint32)
    for k, data in zip(*map_arrow(chunks.repartition("chunk"), "chunk int, counts binary", add).toArrow().to_pydict().values(), strict=True):
        counts[k * size : (k + 1) * size] = np.frombuffer(data, np.uint32)  # four bytes a slot at most
    return Sets(found.where("chunk is null").select("doc_id", "n", "key", "ranges"), counts)


def _marked(values: DataFrame, column: str) -> np.ndarray:
    """A bit for each value of a column of longs, of a fixed number of bits: misses are not possible, false hits are."""
    slot = F.pmod(column, F.lit(MARKS)) + 1
    marks = values.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    bits = np.zeros((MARKS // 32_768, 4096), np.uint8)
    for r in marks.toArrow().to_pylist():  # a fixed number of buckets of 4 KB at most
        bits[r["bucket"] - 1] = np.frombuffer(r["bits"], np.uint8)
    return bits.reshape(-1)


def _is_marked(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values % MARKS
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _first_of_copies(rows: DataFrame) -> np.ndarray:
    """Marks of the ids that stand for a set: the smallest of those that have it. Other copies need not be read again;
    an id that is marked by chance is read for nothing."""
    first = rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    return _marked(first.select(F.xxhash64("doc_id").alias("id")), "id")


def _rare(texts: DataFrame, words: int, percent: int, counts: np.ndarray, firsts: np.ndarray) -> DataFrame:
    """``shingle, key, n, pos`` for the prefix of each text that ``firsts`` marks: its rarest shingles and their places
    in its order."""
    sent = texts.sparkSession.sparkContext.broadcast(counts)
    marks = texts.sparkSession.sparkContext.broadcast(firsts)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(_is_marked(marks.value, b.column(1).to_numpy())))
            sets = [shingles(t.as_py(), words) for t in b.column(0)]
            firsts = [in_order(s, sent.value)[: prefix_length(len(s), percent)] for s in sets]
            size = [len(f) for f in firsts]
            empty = np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([empty, *firsts]).view(np.int64)),
                pa.array(np.repeat(np.array([key(s) for s in sets], np.uint64).view(np.int64), size)),
                pa.array(np.repeat(np.array([len(s) for s in sets], np.int64), size)),
                pa.array(np.concatenate([np.zeros(0, np.int64), *map(np.arange, size)])),
            ], ["shingle", "key", "n", "pos"])

    return map_arrow(texts.select("text", F.xxhash64("doc_id").alias("id")), "shingle long, key long, n long, pos long", work)


def _shared(rare: DataFrame, several: DataFrame) -> DataFrame:
    """The rows of ``rare`` whose shingle is in ``several``; most others are left out before anything is shuffled."""
    sent = rare.sparkSession.sparkContext.broadcast(_marked(several, "shingle"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_is_marked(sent.value, b.column(0).to_numpy())))

    return map_arrow(rare, "shingle long, key long, n long, pos long", work).join(several, "shingle").distinct()


def _wanted(texts: DataFrame, keys: DataFrame, words: int, firsts: np.ndarray) -> DataFrame:
    """``key, own`` for the keys in ``keys``: their sets, once each, found again from the texts."""
    sent = texts.sparkSession.sparkContext.broadcast(_marked(keys, "key"))
    marks = texts.sparkSession.sparkContext.broadcast(firsts)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # of one task's rows
        for b in batches:
            b = b.filter(pa.array(_is_marked(marks.value, b.column(1).to_numpy())))
            sets = [shingles(t.as_py(), words) for t in b.column(0)]
            names = np.array([key(s) for s in sets], np.uint64).view(np.int64)
            found: dict[int, bytes] = {}
            for k in np.flatnonzero(_is_marked(sent.value, names)).tolist():
                if (name := int(names[k])) not in seen and len(sets[k]):
                    found[name] = packed(sets[k])
                    seen.add(name)
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.binary())], ["key", "own"])

    sets = map_arrow(texts.select("text", F.xxhash64("doc_id").alias("id")), "key long, own binary", work)
    return sets.groupBy("key").agg(F.first("own").alias("own"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (``a, b``) whose sets have similarity ``percent`` or more."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = unpacked(x.as_buffer()), unpacked(y.as_buffer())
                both = len(np.intersect1d(x, y))
                keep.append(both * 100 >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = sets.select(F.col("key").alias("a"), F.col("own").alias("x")), sets.select(F.col("key").alias("b"), F.col("own").alias("y"))
    return map_arrow(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y"), "a long, b long", work)


def _least(percent: int, n: Column, m: Column) -> Column:
    """So many shingles two similar sets of these sizes share at least."""
    return F.ceil(percent * (n + m) / (100 + percent))


def _may_link(percent: int, a: str, b: str) -> Column:
    """Length and position filters on two entries of one posting list, with columns ``n_<x>, pos_<x>``. At the first
    shingle that two sets share, at most that and what follows it in both can be shared."""
    n, m = F.col(f"n_{a}"), F.col(f"n_{b}")
    length = F.least(n, m) * 100 >= F.greatest(n, m) * percent
    return length & (F.least(n - F.col(f"pos_{a}"), m - F.col(f"pos_{b}")) >= _least(percent, n, m))


def _suffix_filtered(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (``a, b``) whose counts per range differ by no more than what two similar sets don't share."""
    own = sets.groupBy("key").agg(F.first("n").alias("n"), F.first("ranges").alias("ranges"))
    left, right = (own.select(F.col("key").alias(x), F.col("n").alias(f"n_{x}"), F.col("ranges").alias(f"ranges_{x}")) for x in ("a", "b"))
    apart = F.aggregate(
        F.zip_with("ranges_a", "ranges_b", lambda x, y: F.abs(x.cast("int") - y.cast("int"))), F.lit(0), lambda s, x: s + x
    )
    n, m = F.col("n_a"), F.col("n_b")
    return pairs.join(left, "a").join(right, "b").where(apart <= n + m - 2 * _least(percent, n, m)).select("a", "b")


def _entries(lists: DataFrame, side: str) -> DataFrame:
    return lists.select("shingle", *[F.col(c).alias(f"{c}_{side}") for c in lists.columns if c != "shingle"])


def links(texts: DataFrame, sets: Sets, words: int = 5, percent: int = 80) -> DataFrame:
    """Pairs ``a, b`` of keys, all of similarity ``percent`` or more, which connect every two sets that such pairs
    connect. ``texts``: ``doc_id, text``; ``sets``: see ``_sets``.

    Two such sets share one of their rarest shingles. A shingle that one set has is dropped by the grouping that finds
    it, one that two rows have is a pair at once. In longer posting lists, every set first meets the hub, the set with
    the shingle in the earliest place, which has the fewest rare shingles of its own. Then the sets of a list that
    these links leave in different components meet. So a group of copies costs its size, not its square; each pair
    passes the filters, and is compared once.
    """
    firsts = _first_of_copies(sets.rows)
    rare = stored(_rare(texts, words, percent, sets.counts, firsts), "rare-shingles")
    packed = F.shiftleft("n", 32) + F.col("pos")
    held = rare.withColumn("x", packed).groupBy("shingle").agg(
        F.count("*").alias("c"), F.min("key").alias("a"), F.max("key").alias("b"), F.min("x").alias("x"), F.max("x").alias("y")).where("a < b")
    low = F.lit((1 << 32) - 1)
    # whose place is whose does not matter to the filters
    held = stored(held.select(
        "shingle", "c", "a", "b", F.shiftright("x", 32).alias("n_a"), F.col("x").bitwiseAND(low).alias("pos_a"),
        F.shiftright("y", 32).alias("n_b"), F.col("y").bitwiseAND(low).alias("pos_b"),
    ).where((F.col("c") > 2) | _may_link(percent, "a", "b")), "shared-shingles")
    twos = held.where("c = 2").select("a", "b")
    lists = stored(_shared(rare, held.where("c > 2").select("shingle")), "posting-lists")
    hub = lists.groupBy("shingle").agg(F.min(F.struct("pos", "key", "n")).alias("hub"))
    hub = hub.select("shingle", *[F.col(f"hub.{c}").alias(f"{c}_a") for c in ("pos", "key", "n")])
    met = hub.join(_entries(lists, "b"), "shingle").where((F.col("key_a") != F.col("key_b")) & _may_link(percent, "a", "b"))
    stars = twos.unionAll(met.select(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b"))).distinct()
    own = sets.rows.where("n > 0").select("key", "n", "ranges")

    def alike(pairs: DataFrame) -> DataFrame:
        left = stored(_suffix_filtered(pairs, own, percent), "candidates")
        keys = left.select(F.explode(F.array("a", "b")).alias("key")).distinct()
        return _verified(left, stored(_wanted(texts, keys, words, firsts), "compared-sets"), percent)

    stars = stored(stars, "star-pairs")
    first = stored(alike(stars), "links")
    label = components(first).withColumnRenamed("node", "key")
    named = lists.join(label, "key", "left").withColumn("label", F.coalesce("component", "key")).drop("component")
    named = stored(named, "posting-lists")
    open_lists = named.groupBy("shingle").agg(F.min("label").alias("l"), F.max("label").alias("m")).where("l < m").select("shingle")
    named = named.join(open_lists, "shingle")
    apart = _entries(named, "a").join(_entries(named, "b"), "shingle").where((F.col("label_a") < F.col("label_b")) & _may_link(percent, "a", "b"))
    other = apart.select(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b")).distinct()
    other = stored(other.join(stars, ["a", "b"], "left_anti"), "other-pairs")
    return first.unionAll(alike(other))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, slots: int = SLOTS) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row: linked are rows whose sets of ``words``-word shingles have a
    Jaccard similarity of ``percent`` or more; a component is what links reach, its id the smallest doc_id in it.

    A text of fewer words is one shingle. Null, empty and wordless texts are linked with nothing. Equal sets meet by
    their hash before anything is compared. Rows with a null id are part of their component but never name it, unless
    it has no other rows. Repeated rows give repeated rows; an empty table an empty result. Shingles and sets are
    known by 64-bit hashes (48 bits where two sets are compared); apart from their collisions no link is missed. ``slots``: a power of two.
    """
    checked(docs, id_col, text_col)
    texts = _texts(docs, id_col, text_col)
    found = _sets(texts, words, slots)
    sets = found.rows
    label = components(links(texts, found, words, percent)).withColumnRenamed("node", "key")
    classes = sets.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("least"))
    classes = stored(classes.join(label, "key", "left").select("key", "least", F.coalesce("component", "key").alias("label")), "classes")
    names = classes.groupBy("label").agg(F.min("least").alias("component_id"))
    known = classes.join(names, "label").select("key", "component_id")
    linked = sets.where("n > 0").join(known, "key").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionAll(sets.where("n = 0").select("doc_id", F.col("n"), F.col("doc_id")))
