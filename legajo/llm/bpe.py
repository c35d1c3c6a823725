"""Byte-pair encoding and decoding of whole texts; long ones as a tree of parts whose joins are re-encoded."""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import chain, pairwise
from string import ascii_letters
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from legajo.llm.common import Memory, checked, map_arrow, ship, steps, stored, with_columns

#: Characters above which a text is cut into parts that tasks encode in parallel.
LEAF = 1 << 16
#: Characters on each side of a join that are encoded anew at first.
WINDOW = 64
#: Words whose ids a worker remembers, in each of two generations.
REMEMBERED = 120_000
#: Separators that str.split() takes for white space and the vocabulary does not.
SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")


class Part(NamedTuple):
    """A stretch of text with its tokens and where in it they start and end."""

    text: str
    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


class Coder:
    """A tokenizer file with the ids of words it has seen. The vocabulary drops white space and never joins over
    it, so a text's ids are its words' ids in order."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.tokens = [""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.tokens[i] = token
        #: Special tokens are looked for in the text itself, so a window must hold one and what stands before it.
        self.longest = max((len(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()), default=0)
        self.merge = self.tokenizer.model.tokenize
        #: Whether all that happens to a word of ASCII letters before its merges is lower-casing: letters are cut from
        #: one another nowhere, so a few words that hold every letter in both cases, long and short, tell.
        self.plain = not any(t.content.isalpha() for t in self.tokenizer.get_added_tokens_decoder().values()) and all(
            [t.id for t in self.merge(w.lower())] == self.tokenizer.encode(w, add_special_tokens=False).ids
            for w in (ascii_letters, *ascii_letters, *map("".join, pairwise(ascii_letters * 2)), "sstrevemlld" * 30)
        )
        self.memory = Memory(self.encoded, REMEMBERED)

    def encoded(self, words: list[str]) -> list[bytes]:
        """Ids of each word. Words of ASCII letters only go to the tokenizer's model at once where ``plain`` holds."""
        found = {w: np.array([t.id for t in self.merge(w.lower())], "<u4").tobytes() for w in words if self.plain and w.isalpha() and w.isascii()}
        rest = [w for w in words if w not in found]
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            found[w] = np.array(e.ids, "<u4").tobytes()
        return [found[w] for w in words]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [None if t and any(s in t for s in SEPARATORS) else (t or "").split() for t in texts]
        known = self.memory.of(set(chain.from_iterable(w for w in split if w)))
        return [
            np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4") if w is None
            else np.frombuffer(b"".join(map(known.__getitem__, w)), "<u4")
            for t, w in zip(texts, split, strict=True)
        ]

    def decode(self, ids: np.ndarray) -> str:
        if self.tokenizer.decoder is None:
            return " ".join(map(self.tokens.__getitem__, ids.tolist()))
        return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)

    def part(self, text: str) -> Part:
        e = self.tokenizer.encode(text, add_special_tokens=False)
        at = np.array(e.offsets, np.int64).reshape(-1, 2)
        return Part(text, np.array(e.ids, np.int64), at[:, 0], at[:, 1])


@cache
def coder(path: str) -> Coder:
    return Coder(path)


def can_cut(text: str, at: int) -> bool:
    """Whether normalisation treats both sides of ``at`` alike when apart: no mark or vowel that joins what precedes."""
    if at <= 0 or at >= len(text):
        return True
    return unicodedata.category(text[at])[0] != "M" and not 0x1160 <= ord(text[at]) <= 0x11FF


def cuts(text: str, leaf: int) -> list[str]:
    """``text`` in parts of ``leaf`` characters, or somewhat more where it can't be cut."""
    parts, start = [], 0
    while start < len(text):
        end = min(start + leaf, len(text))
        while not can_cut(text, end):
            end += 1
        parts.append(text[start:end])
        start = end
    return parts


def agreement(known: Part, window: Part, shift: int, from_left: bool) -> tuple[int, int] | None:
    """Where two tokens in a row are the same in both: their place in ``known`` and in ``window``, which starts at
    ``shift`` of known's text. The tokens at an end made by cutting don't count. From the left: the last ones such."""
    at = {(s, e, i): k for k, (s, e, i) in enumerate(zip((known.starts - shift).tolist(), (known.ends - shift).tolist(), known.ids.tolist(), strict=True))}
    order = range(len(window.ids) - 1)
    for j in reversed(order) if from_left else order:
        k = at.get((int(window.starts[j]), int(window.ends[j]), int(window.ids[j])))
        l = at.get((int(window.starts[j + 1]), int(window.ends[j + 1]), int(window.ids[j + 1])))  # noqa: E741
        if k is None or l != k + 1:
            continue
        if (from_left and l < len(known.ids) - 1) or (not from_left and k > 0):
            return k, j
    return None


def joined(coder: Coder, left: Part, right: Part) -> Part:
    """The tokens of both texts as one. A window around the join is encoded anew and doubled until it agrees with
    both sides in two tokens in a row; what lies beyond these stays as it is.

    Byte-pair tokens are right if each pair of neighbours is what their text gives alone. Every pair of the result
    stands in one of the three encodings, so the result is exact. At worst the window is the whole.
    """
    text, width = left.text + right.text, max(WINDOW, 2 * coder.longest)
    while True:
        a, b = max(0, len(left.text) - width), min(len(right.text), width)
        while not can_cut(left.text, a):
            a -= 1
        while not can_cut(right.text, b):
            b += 1
        window = coder.part(left.text[a:] + right.text[:b])
        own = len(left.text) - a
        near = agreement(left, window, a, True) if a else (0, 0)
        far = agreement(right, window, -own, False) if b < len(right.text) else (len(right.ids), len(window.ids))
        if near and far and near[1] <= far[1]:
            (k, j), (m, n) = near, far
            return Part(text, *(
                np.concatenate([x[:k], w[j:n] + s, y[m:] + t])
                for x, w, y, s, t in (
                    (left.ids, window.ids, right.ids, 0, 0),
                    (left.starts, window.starts, right.starts, a, len(left.text)),
                    (left.ends, window.ends, right.ends, a, len(left.text)),
                )
            ))
        width *= 2


PARTS = "key long, leaf long, text string, ids array<long>, starts array<long>, ends array<long>"


def _long_ids(rows: DataFrame, path: str, leaf: int) -> DataFrame:
    """``key, ids`` of ``rows`` (``key, text``), each cut into parts; a level of the tree is one grouping by pairs."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for i, part in enumerate(cuts(text.as_py(), leaf)):
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([i]), pa.array([part])], ["key", "leaf", "text"])

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for key, i, text in b.itertuples(index=False, name=None):
                p = coder(path).part(text)
                yield pd.DataFrame({"key": [key], "leaf": [i], "text": [text], "ids": [p.ids], "starts": [p.starts], "ends": [p.ends]})

    def pair(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("leaf")
        parts = [Part(*p) for p in group[["text", "ids", "starts", "ends"]].itertuples(index=False, name=None)]
        p = joined(coder(path), *parts) if len(parts) == 2 else parts[0]
        return pd.DataFrame({"key": group["key"].iloc[:1].values, "leaf": [int(group["leaf"].iloc[0]) // 2], "text": [p.text], "ids": [p.ids], "starts": [p.starts], "ends": [p.ends]})

    parts = stored(map_arrow(rows, "key long, leaf long, text string", cut), "leaves")
    most = parts.agg(F.max("leaf")).first()[0]
    several = max(2, parts.sparkSession.sparkContext.defaultParallelism)  # without a number small parts would share one task
    tree = parts.repartition(several, F.xxhash64("key", "leaf")).mapInPandas(encode, PARTS)
    while most:
        tree = tree.groupBy("key", F.floor(F.col("leaf") / 2).alias("_pair")).applyInPandas(pair, PARTS)
        most //= 2
    return tree.select("key", F.col("ids").cast("array<int>").alias("ids"))


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """``doc_id, ids`` for each row: the ids the tokenizer in ``path`` gives the whole text (null: empty), without
    special tokens added; those that stand in a text count, as with the library.

    Texts of at most ``leaf`` characters are encoded word by word. Longer ones are cut, wherever the cut falls, and
    their parts encoded in tasks of their own and joined by twos, so that one long text occupies no single task but
    for the last join. Rows are independent; repeated rows give repeated results.
    """
    checked(docs, id_col, text_col)
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = coder(path)
        for b in batches:
            for part in steps(b, 1):
                ids = known.encode(part.column(1).to_pylist())
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
                flat = np.concatenate(ids).view(np.int32) if ids else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["doc_id", "ids"])

    size = F.length("text")
    short = map_arrow(rows.where(size <= leaf), f"doc_id {kind}, ids array<int>", work)
    keyed = stored(rows.where(size > leaf).withColumn("key", F.monotonically_increasing_id()), "long-texts")
    if keyed.isEmpty():
        return short
    return short.unionAll(keyed.select("doc_id", "key").join(_long_ids(keyed.select("key", "text"), path, leaf), "key").select("doc_id", "ids"))


def decoded(tokens: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``tokens`` with ``decoded``, the text that the tokenizer gives for ``ids_col`` (special tokens included); null
    ids give null. A column of that name gives way to the new one.

    A vocabulary without a decoder joins tokens by spaces, which Spark does itself: ids that a Python worker has just
    made need no second worker beside it, with a tokenizer and a memory of its own.
    """
    checked(tokens, ids_col)
    if coder(path).tokenizer.decoder is None:
        names = token_list(coder(path).tokens)
        text = F.array_join(F.transform(ids_col, lambda i: F.element_at(names, i.cast("int") + 1)), " ")
        others = [c for c in tokens.columns if c.lower() != "decoded"]
        return tokens.select(*others, text.alias("decoded"))
    schema = with_columns(tokens.schema, [T.StructField("decoded", T.StringType())])
    at, own = tokens.columns.index(ids_col), [tokens.columns.index(f.name) for f in schema.fields[:-1]]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = coder(path)
        for b in batches:
            for part in steps(b, at):
                texts = [known.decode(x.values.to_numpy()) if x.is_valid else None for x in part.column(at)]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in own], pa.array(texts, pa.string())], schema.names)

    return map_arrow(tokens, schema, work)


def token_list(tokens: list[str]) -> Column:
    """``tokens`` as an array that the optimizer turns into one constant, made from a single text."""
    used = set(chain.from_iterable(tokens))
    mark = next(c for c in map(chr, range(1, 0x110000)) if c not in used and not c.isspace() and not c.isprintable())
    return F.split(F.lit(mark.join(tokens)), f"\\x{{{ord(mark):x}}}")
