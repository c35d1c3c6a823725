"""Packing of token sequences: bulk-synchronous best fit over range-sorted documents and gaps."""

from __future__ import annotations

import json
import os
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache
from itertools import chain, pairwise
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legajo.llm.common import checked, map_arrow, ranked, ship, steps, stored

#: How byte-level vocabularies of this kind cut a text before merging bytes (fixed value).
CUT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes that byte-level vocabularies write as themselves; the rest are written as the characters from 256 on (fixed values).
OWN_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    rest = [b for b in range(256) if b not in OWN_BYTES]
    return {chr(b): b for b in OWN_BYTES} | {chr(256 + k): b for k, b in enumerate(rest)}


class Ids:
    """Token ids of texts as little-endian 32-bit numbers, those that the tokenizer file gives with its own library.

    Merging by the rank of the merged bytes (``fast``) is several times faster. It gives the same ids where ranks
    follow the merges and every token's own bytes merge to that token: were two neighbours x and y merged to a token
    in another way than its listed merge, the token's bytes alone would end as x and y. Both are tested on the file;
    any other file, or one with another cut or a normaliser, is left to the library.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.fast = self._fast()

    def _fast(self):  # noqa: ANN202
        import tiktoken

        spec = json.loads(self.tokenizer.to_str())
        cut, model, added = spec["pre_tokenizer"] or {}, spec["model"], spec["added_tokens"]
        plain = spec["normalizer"] is None and cut.get("type") == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"]
        odd = model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or odd or any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            return None
        byte, merge = byte_of(), self.tokenizer.model.tokenize
        tokens = {t: i for t, i in model["vocab"].items() if t not in self.special}
        made = [tokens.get("".join(m) if isinstance(m, list) else m.replace(" ", ""), -1) for m in model["merges"]]
        if -1 in made or any(a >= b for a, b in pairwise(made)) or any(c not in byte for t in tokens for c in t):
            return None
        if any([x.id for x in merge(t)] != [i] for t, i in tokens.items()):
            return None
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in tokens.items()}
        if len(ranks) != len(tokens) or any(bytes([b]) not in ranks for b in range(256)):
            return None
        names = {t["content"]: t["id"] for t in added}
        return tiktoken.Encoding("file", pat_str=CUT, mergeable_ranks=ranks, special_tokens=names)

    def of(self, texts: list[str | None]) -> list[bytes]:
        if self.fast is None:
            found = self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
            return [np.array(e.ids, "<u4").tobytes() for e in found]
        return [self.fast.encode_to_numpy(t, allowed_special="all").astype("<u4", copy=False).tobytes() if t else b"" for t in texts]


@cache
def ids_of(path: str) -> Ids:
    return Ids(path)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``): token ids of each text with id 0 after them, cut
    only where longer than ``capacity``: into full pieces, but for the first, which takes what is left over."""
    checked(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chain.from_iterable(steps(b, 1) for b in batches):
            took: tuple[list, ...] = ([], [], [], [], [], [])
            for doc, data in enumerate(ids_of(tokenizer_path).of(b.column(1).to_pylist())):
                data += b"\0\0\0\0"
                n = len(data) // 4
                first = n % capacity or capacity
                for k, end in enumerate(range(first, n + 1, capacity)):
                    start = 0 if k == 0 else end - capacity
                    part = data[4 * start : 4 * end]
                    for column, value in zip(took, (doc, k, start, end - start, crc32(part), np.frombuffer(part, "<u4") if with_ids else None), strict=True):
                        column.append(value)
            columns = [b.column(0).take(pa.array(took[0], pa.int64())), pa.array(took[1], pa.int32()), *(pa.array(c, pa.int64()) for c in took[2:5])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array([x.astype(np.int32) for x in took[5]], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    return map_arrow(rows, schema + ", ids array<int>" * with_ids, work)


def sweep(sizes: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit for ``sizes`` (length: how many documents), longest first, as runs of documents and gaps.

    Superstep after superstep, the documents of one length, which their rank tells apart, go to the gaps of the
    smallest size that is not below it (the successor); the k-th document takes the k-th gap, those left over
    go on to the next larger gaps, at last to new sequences; then the gaps are updated. A run is
    ``(length, first rank, documents, first sequence, offset)``.
    """
    runs, used = [], 0
    free: dict[int, list[tuple[int, int]]] = {}  # gap: runs of sequences (first, how many)
    gaps: list[int] = []  # ascending

    def add(gap: int, first: int, many: int) -> None:
        if gap > 0 and many:
            if gap not in free:
                free[gap] = []
                insort(gaps, gap)
            free[gap].append((first, many))

    for length in sorted(sizes, reverse=True):
        rank, left = 0, sizes[length]
        while left:
            at = bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                first, many = free[gap].pop()
                if not free[gap]:
                    del free[gap], gaps[at]
            else:
                gap, first = capacity, used
                many = -(-left // (capacity // length))
                used += many
            each = gap // length  # as many of this length as a gap can take
            full = min(many, left // each)
            rest = left - full * each if full < many else 0
            for k in range(each):
                if full:
                    runs.append((length, rank, full, first, capacity - gap + k * length))
                    rank += full
            add(gap - each * length, first, full)
            if rest:
                for k in range(rest):
                    runs.append((length, rank, 1, first + full, capacity - gap + k * length))
                    rank += 1
                add(gap - rest * length, first + full, 1)
            add(gap, first + full + bool(rest), many - full - bool(rest))
            left -= full * each + rest
    return runs


def pack(parts: DataFrame, capacity: int = 2048, lane_rows: int = 4_000_000) -> DataFrame:
    """``parts`` (with ``doc_id, piece, length``) and their ``sequence_id`` and ``offset``, gapless from 0.

    The pieces are range-sorted by length, so a piece has a rank among those of its length. Lanes of about
    ``lane_rows`` ranks each are swept side by side, one task a lane over its counts per length (``capacity``
    rows at most); a lane leaves its last few sequences underfilled, a millionth of its tokens. A piece then
    finds its run by lane, length and rank. Pieces of equal length are alike, so their order decides nothing but
    who goes where: by doc_id, piece, then order of storage. Lengths are 1 to ``capacity``; an empty table gives
    an empty result; rows with equal ids are packed each.
    """
    spark = parts.sparkSession
    ship(spark)
    kept = parts.drop("sequence_id", "offset").withColumn("_tie", F.monotonically_increasing_id())
    order = ranked(kept, "pieces", F.desc("length"), "doc_id", "piece", "_tie")
    total = order.count()
    lanes = max(1, -(-total // lane_rows))
    place = order.withColumn("_lane", F.pmod("pos", F.lit(lanes))).withColumn("_at", F.floor(F.col("pos") / lanes))
    sizes = place.groupBy("_lane", "length").agg(F.count("*").alias("n"), F.min("_at").alias("low"))

    def swept(group: pd.DataFrame) -> pd.DataFrame:
        low = dict(zip(group["length"].tolist(), group["low"].tolist(), strict=True))
        runs = sweep(dict(zip(group["length"].tolist(), group["n"].tolist(), strict=True)), capacity)
        lane = int(group["_lane"].iloc[0])
        return pd.DataFrame(
            [(lane, n, low[n] + rank, low[n] + rank + many, first, offset) for n, rank, many, first, offset in runs],
            columns=["lane", "len", "low", "high", "first", "place"],
        )

    runs = sizes.groupBy("_lane").applyInPandas(swept, "lane long, len long, low long, high long, first long, place long")
    runs = stored(runs, "runs")
    here = (F.col("_lane") == F.col("lane")) & (F.col("length") == F.col("len")) & (F.col("_at") >= F.col("low")) & (F.col("_at") < F.col("high"))
    return place.join(runs, here).select(
        *[F.col(f"`{c}`") for c in parts.columns if c not in ("sequence_id", "offset")],
        ((F.col("first") + F.col("_at") - F.col("low")) * lanes + F.col("_lane")).alias("sequence_id"), F.col("place").alias("offset"),
    )


def packed(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of all ``docs`` with their place: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A null or empty text is one piece of length 1, the end mark. See ``pieces`` and ``pack``.
    """
    return pack(stored(pieces(docs, tokenizer_path, capacity, id_col, text_col, with_ids), "tokens"), capacity)
