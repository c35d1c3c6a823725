"""Ordinal quality grades: one hashed-text score shared by all grades, and ordered thresholds between them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from legajo.llm.common import checked, map_arrow, with_columns

#: Hash slots of words; as many again for their shapes.
SLOTS = 1 << 14
#: Words whose slots a task remembers at once; then it starts anew.
REMEMBERED = 150_000
#: Tokens of a text that are counted at once.
BLOCK = 1 << 16


#: Tokens without evidence that every text counts in addition, so that a few words decide little.
PRIOR = 20


def shape(word: str) -> str:
    """Kinds of characters in a word, runs as one: ``Abc.!!`` gives ``Aa.!``."""
    if word.isalpha():
        if word.islower():
            return "a"
        if word.istitle() and len(word) > 1:
            return "Aa"
    kinds = ("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    return "".join(k for k, _ in groupby(kinds))


class Slots(dict):
    """Word to its two slots, packed in one number."""

    def __missing__(self, word: str) -> int:
        a = crc32(word.lower().encode("utf-8", "surrogatepass")) % SLOTS
        b = crc32(b"shape " + shape(word).encode("utf-8", "surrogatepass")) % SLOTS
        if len(self) >= REMEMBERED:
            self.clear()
        if len(word) <= 64:
            self[word] = a * SLOTS + b
        return a * SLOTS + b


#: The slot, among the shapes, of tokens equal to the one before.
REPEATED = crc32(b"shape repeated") % SLOTS


def packed(text: str | None, slots: Slots) -> Iterator[tuple[np.ndarray, int]]:
    """Block by block, the packed slots of the tokens, and how many tokens are as the one before."""
    tokens, last = (text or "").split(), -1
    for at in range(0, len(tokens), BLOCK):
        block = tokens[at : at + BLOCK]
        found = np.fromiter(map(slots.__getitem__, block), np.int64, len(block))
        yield found, int((found[1:] == found[:-1]).sum()) + (found[0] == last)
        last = found[-1]


def counts(text: str | None, slots: Slots) -> tuple[np.ndarray, np.ndarray]:
    """Used slots (words, then shapes after ``SLOTS``) and the share of tokens in each."""
    total, tokens = np.zeros(2 * SLOTS, np.int64), 0
    for found, again in packed(text, slots):
        total[:SLOTS] += np.bincount(found // SLOTS, minlength=SLOTS)
        total[SLOTS:] += np.bincount(found % SLOTS, minlength=SLOTS)
        total[SLOTS + REPEATED] += again
        tokens += len(found)
    used = np.flatnonzero(total)
    return used, total[used] / (tokens + PRIOR)


@dataclass(frozen=True)
class Model:
    """P(grade >= grades[k + 1]) = sigmoid(weights . x - thresholds[k]), thresholds in ascending order."""

    grades: tuple[int, ...]
    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, text: str | None, slots: Slots) -> float:
        total, tokens = 0.0, 0
        for found, again in packed(text, slots):
            total += self.weights[found // SLOTS].sum() + self.weights[SLOTS + found % SLOTS].sum() + self.weights[SLOTS + REPEATED] * again
            tokens += len(found)
        return total / (tokens + PRIOR)

    def tails(self, scores: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds[None, :], -50, 50)))


def fit_rows(rows: list[tuple[int, np.ndarray, np.ndarray]], rounds: int = 120, rate: float = 0.5, decay: float = 3e-3) -> Model:
    """Maximum likelihood of the cumulative-link model by Adam steps over all rows; grades weigh alike.

    One grade or none: a model without thresholds, by which every text has that grade (0 where there is none).
    """
    grades = tuple(sorted({g for g, _, _ in rows})) or (0,)
    weights, k = np.zeros(2 * SLOTS), len(grades) - 1
    if k == 0:
        return Model(grades, weights, np.zeros(0))
    y = np.searchsorted(grades, [g for g, _, _ in rows])
    at = np.repeat(np.arange(len(rows)), [len(i) for _, i, _ in rows])
    slot = np.concatenate([i for _, i, _ in rows])
    x = np.concatenate([v for _, _, v in rows])
    rarity = np.sqrt(np.bincount(slot, minlength=2 * SLOTS) + 1.0)  # rare words take larger steps, as shares are small
    x = x / (rarity[slot] / len(rows) ** 0.5) * 20
    share = np.bincount(y, minlength=k + 1) / len(y)
    each = (1 / share / (k + 1))[y] / len(y)
    tail = np.clip(1 - np.cumsum(share)[:-1], 1e-3, 1 - 1e-3)
    start = -np.log(tail / (1 - tail))
    cut = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 0.1))])  # the gaps as logarithms keep the order
    state = np.concatenate([weights, cut])
    m, v = np.zeros_like(state), np.zeros_like(state)
    for step in range(1, rounds + 1):
        w, c = state[:-k], state[-k:]
        theta = c[0] + np.concatenate([[0.0], np.cumsum(np.exp(c[1:]))])
        eta = np.bincount(at, x * w[slot], minlength=len(rows))
        bounds = np.concatenate([[-np.inf], theta, [np.inf]])
        upper = 1 / (1 + np.exp(-np.clip(bounds[y + 1] - eta, -40, 40)))
        lower = 1 / (1 + np.exp(-np.clip(bounds[y] - eta, -40, 40)))
        chance = np.maximum(upper - lower, 1e-9)
        up, low = upper * (1 - upper), lower * (1 - lower)
        d_eta = each * (up - low) / chance
        d_theta = np.array([
            -(each * (y == j) * up / chance).sum() + (each * (y == j + 1) * low / chance).sum() for j in range(k)
        ])
        d_cut = np.array([d_theta.sum(), *[np.exp(c[j]) * d_theta[j:].sum() for j in range(1, k)]])
        gradient = np.concatenate([np.bincount(slot, x * d_eta[at], minlength=2 * SLOTS) + decay * w, d_cut])
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        state = state - rate * 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    w, c = state[:-k], state[-k:]
    theta = c[0] + np.concatenate([[0.0], np.cumsum(np.exp(c[1:]))])
    return Model(grades, w / (rarity / len(rows) ** 0.5) * 20, theta)


def graded(quality: Column, toxic: Column) -> Column:
    """Rating from two flags: 0 poor, 1 good but toxic, 2 good. Null quality gives none, null toxic counts as 0."""
    return F.when(quality.isNull(), None).when(quality < 1, 0).when(F.coalesce(toxic, F.lit(0)) >= 1, 1).otherwise(2)


def fit(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_per_grade: int = 1500) -> Model:
    """Fit on the whole texts of at most ``max_per_grade`` rated documents of each grade, the first by a hash of
    their id; ``ratings`` has ``id_col`` and ``grade`` (small integers). Of several ratings the lowest counts."""
    checked(docs, id_col, text_col)
    spark = docs.sparkSession
    known = ratings.where(F.col("grade").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min("grade").cast("int").alias("_grade"))
    grades = sorted(r["_grade"] for r in known.select("_grade").distinct().collect())
    parts = [known.where(F.col("_grade") == g).orderBy(F.xxhash64("_id"), "_id").limit(max_per_grade) for g in grades]
    rows = [r for p in parts for r in p.collect()]
    if not rows:
        return fit_rows([])
    chosen = spark.createDataFrame(rows, "_id long, _grade int")
    sample = docs.select(F.col(id_col).cast("long").alias("_own"), F.col(text_col).alias("_text")).join(
        F.broadcast(chosen), F.col("_own") == F.col("_id")  # at most max_per_grade rows for each grade
    ).select("_own", "_grade", "_text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots()
        for b in batches:
            found = [counts(t.as_py(), slots) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([i for i, _ in found], pa.list_(pa.int32())), pa.array([v for _, v in found], pa.list_(pa.float32()))],
                ["own", "grade", "slot", "share"],
            )

    features = map_arrow(sample, "own long, grade int, slot array<int>, share array<float>", work).toArrow()
    ordered = sorted(zip(*[features.column(c).to_pylist() for c in ("own", "grade")], range(features.num_rows), strict=True))
    pick = lambda c, i: features.column(c)[i].values.to_numpy(zero_copy_only=False)
    return fit_rows([(g, pick("slot", i), pick("share", i).astype(np.float64)) for _, g, i in ordered if len(features.column("slot")[i].values)])


def scored(docs: DataFrame, model: Model, text_col: str = "text", at_least: int | None = None, chance: float = 0.5, only_kept: bool = False) -> DataFrame:
    """``docs`` with ``expected_grade``, ``tail_probability`` (grade ``at_least`` or more) and ``kept`` (that
    probability is ``chance`` or more); with ``only_kept`` the kept rows of ``docs`` as they are.

    ``at_least``: the second grade of the model unless given. A model without thresholds (no ratings, or all of one
    grade) can't tell texts apart, so it keeps all. Texts are read whole. A null or empty text, or one
    of white space only, has score 0, which is what the thresholds say of no evidence. Columns of these names give
    way to the new ones; rows are independent, so repeated rows get equal results.
    """
    checked(docs, text_col)
    level = model.grades[min(1, len(model.grades) - 1)] if at_least is None else at_least
    later = [k for k, g in enumerate(model.grades[1:]) if g >= level]  # its first threshold, or none above
    new = [T.StructField("expected_grade", T.DoubleType()), T.StructField("tail_probability", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    schema = docs.schema if only_kept else with_columns(docs.schema, new)
    at, own = docs.columns.index(text_col), [docs.columns.index(f.name) for f in (docs.schema.fields if only_kept else schema.fields[:-3])]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2 * SLOTS numbers

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, slots = sent.value, Slots()
        gaps = np.diff(m.grades)
        for b in batches:
            tails = m.tails(np.fromiter((m.score(t.as_py(), slots) for t in b.column(at)), np.float64, b.num_rows))
            grade = m.grades[0] + tails @ gaps
            tail = np.ones(b.num_rows) if m.grades[0] >= level or len(m.grades) == 1 else tails[:, later[0]] if later else np.zeros(b.num_rows)
            columns = [b.column(i) for i in own]
            if only_kept:
                yield pa.RecordBatch.from_arrays(columns, schema.names).filter(pa.array(tail >= chance))
            else:
                yield pa.RecordBatch.from_arrays([*columns, pa.array(grade), pa.array(tail), pa.array(tail >= chance)], schema.names)

    return map_arrow(docs, schema, work)
