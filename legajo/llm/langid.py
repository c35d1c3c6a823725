"""Language identification by the nearest of several centroids per language over TF-IDF vectors of letter n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from legajo.llm.common import checked, map_arrow, ship, with_columns

#: Hash slots of the n-grams.
SLOTS = 1 << 12
#: Multiplier of the rolling n-gram hash (odd, near 2**32 divided by the golden ratio).
MIX = 2654435761
#: Characters of a text that are counted at once; blocks overlap, so no n-gram is lost.
BLOCK = 1 << 20
UNKNOWN = "und"


@cache
def letters() -> np.ndarray:
    """For each code point, itself if it is a letter and a space otherwise."""
    points = np.arange(0x110000, dtype=np.uint32)
    known = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return np.where(known, points, 32).astype(np.uint32)


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def ngrams(text: str) -> np.ndarray:
    """How often each slot is hit by the text's lower-cased n-grams of 1 to 3 characters; a run of other characters
    than letters is one space."""
    total = np.zeros(SLOTS, np.int64)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    before = np.zeros(0, np.uint32)  # the last two characters of the block before
    for at in range(0, len(points), BLOCK):
        x = np.concatenate([before, letters()[points[at : at + BLOCK]]])
        blank = x == 32
        x = x[~(blank & np.concatenate([[False], blank[:-1]]))]
        new = len(before)
        before = x[-2:]
        one = x * np.uint32(MIX)
        two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(MIX) + x[1:]
        three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(MIX) + x[2:] * np.uint32(3)
        for h, skip in ((one, new), (two * np.uint32(MIX), max(new - 1, 0)), (three * np.uint32(MIX), 0)):
            total += np.bincount(h[skip:] >> np.uint32(20), minlength=SLOTS)
    return total


@dataclass(frozen=True)
class Model:
    """``centroids`` (unit rows) of ``languages[owner]``; a text is rejected below the ``radius`` (a cosine)
    of its nearest centroid."""

    languages: tuple[str, ...]
    owner: np.ndarray
    centroids: np.ndarray
    radius: np.ndarray
    idf: np.ndarray

    def vectors(self, texts: list[str]) -> np.ndarray:
        x = np.stack([ngrams(t) for t in texts]) if texts else np.zeros((0, SLOTS))
        x = np.log1p(x) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine and whether it is too far from the nearest centroid, for each text."""
        names, score, far = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        known = [i for i, t in enumerate(texts) if len(self.languages) and has_letter(t)]
        for at in range(0, len(known), 256):
            part = known[at : at + 256]
            cosine = self.vectors([texts[i] for i in part]) @ self.centroids.T
            best = cosine.argmax(axis=1)
            for i, b, c in zip(part, best, cosine, strict=True):
                names[i], score[i], far[i] = self.languages[self.owner[b]], min(max(c[b], 0.0), 1.0), c[b] < self.radius[b]
        return names, score, far


def clustered(x: np.ndarray, count: int, low: float, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means and the ``low`` quantile of the cosines in each cluster. It starts from means of equal slices of the rows,
    ordered by their cosine with the mean of all, so that a single odd text founds no cluster."""
    order = np.argsort(x @ x.mean(axis=0), kind="stable")
    slices = [s for s in np.array_split(order, min(count, len(x))) if len(s)]
    centers = np.stack([x[s].mean(axis=0) for s in slices])
    centers /= np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12)
    for _ in range(rounds):
        of = (x @ centers.T).argmax(axis=1)
        sums = np.stack([x[of == k].sum(axis=0) if (of == k).any() else centers[k] for k in range(len(centers))])
        centers = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    of = (x @ centers.T).argmax(axis=1)
    return centers, np.array([np.quantile(x[of == k] @ centers[k], low) if (of == k).any() else 1.0 for k in range(len(centers))])


def held_out(doc_id: Column) -> Column:
    """Rows that learning never sees: the CRC-32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", clusters: int = 3,
    max_per_language: int = 400, low: float = 0.02, slack: float = 0.5,
) -> Model:
    """Learn from rows with a language, a text with letters, and an id that is not held out.

    Document frequencies come from all such rows. Centroids come from at most ``max_per_language`` whole texts of
    each language, the first by a hash of id, in one small group per language; all languages are learned, so the model
    grows with their number. A centroid's radius is ``slack`` times the ``low`` quantile of
    the cosines of its texts, so that single odd texts of the sample do not widen it.
    No such row: an empty model, by which every text is ``und``.
    """
    checked(docs, id_col, text_col, lang_col)
    spark = docs.sparkSession
    own = F.col(id_col)
    rows = docs.where(own.isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(own)).select(
        own.cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")
    )
    rows = rows.where(F.col("text").rlike(r"\p{L}"))
    # ids are counted, not rows, as the sample is drawn by ids; a row for each language
    most = rows.select("lang", "id").distinct().groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()
    empty = Model((), np.zeros(0, int), np.zeros((0, SLOTS)), np.zeros(0), np.ones(SLOTS))
    if not most:
        return empty

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = np.zeros(SLOTS, np.int64), 0
        for b in batches:
            for t in b.column(0):
                if has_letter(t.as_py()):
                    found += ngrams(t.as_py()) > 0
                    n += 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLOTS + 1)), pa.array(np.append(found, n))], ["slot", "n"])

    seen = map_arrow(rows.select("text"), "slot long, n long", frequencies).groupBy("slot").agg(F.sum("n").alias("n")).collect()
    if not seen:
        return empty
    n = {r["slot"]: r["n"] for r in seen}  # SLOTS + 1 numbers
    idf = np.log((1 + n[SLOTS]) / (1 + np.array([n.get(i, 0) for i in range(SLOTS)]))) + 0.1

    # of a large language only about four times as many ids as wanted are ordered, those of small hash; fewer than
    # wanted come through by chance for less than one language in 10 ** 100
    share = [(r["lang"], min(1.0, 4.0 * max_per_language / r["n"]) if r["n"] > 8 * max_per_language else 1.0) for r in most]
    names = F.broadcast(spark.createDataFrame(share, "lang string, share double"))  # a row for each language
    small = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < F.col("share") * (1 << 40)
    hashed = rows.select("id", "lang").join(names, "lang").where(small).distinct()
    order = F.row_number().over(_window("lang", F.pmod(F.xxhash64("id"), F.lit(1 << 40)), "id"))
    chosen = hashed.withColumn("r", order).where(F.col("r") <= max_per_language).select("id", "lang")
    ship(spark)
    sent = spark.sparkContext.broadcast(Model((), np.zeros(0, int), np.zeros((0, SLOTS)), np.zeros(0), idf))

    def centroids(group: pd.DataFrame) -> pd.DataFrame:
        group = group[[has_letter(t) for t in group["text"]]].sort_values(["id", "text"]).head(max_per_language)
        if not len(group):
            return pd.DataFrame({"lang": [], "center": [], "near": []})
        centers, near = clustered(sent.value.vectors(list(group["text"])), clusters, low)
        return pd.DataFrame({"lang": group["lang"].iloc[0], "center": [c.tolist() for c in centers.astype(np.float32)], "near": near})

    sample = rows.join(F.broadcast(chosen), ["id", "lang"])  # max_per_language narrow rows for each language
    found = sample.groupBy("lang").applyInPandas(centroids, "lang string, center array<float>, near double")
    rows_found = sorted(found.collect(), key=lambda r: (r["lang"], r["center"]))  # a few rows for each language
    if not rows_found:
        return empty
    languages = tuple(dict.fromkeys(r["lang"] for r in rows_found))
    return Model(
        languages, np.array([languages.index(r["lang"]) for r in rows_found]), np.array([r["center"] for r in rows_found], np.float64),
        slack * np.array([r["near"] for r in rows_found]), idf,
    )


def _window(key: str, *order: str | Column):  # noqa: ANN202
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(*order)


def identified(docs: DataFrame, model: Model, text_col: str = "text", only_kept: bool = False) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (cosine with the nearest centroid, 0 to 1) and ``rejected``; with
    ``only_kept`` the rows that are not rejected, as they are.

    Rejected is a text farther from its nearest centroid than that one's radius, and one without letters (null and empty
    included), whose language is ``und`` and score 0. Equal cosines: the first language by name. Texts are read
    whole. Columns of these names give way to the new ones.
    """
    checked(docs, text_col)
    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    schema = docs.schema if only_kept else with_columns(docs.schema, new)
    at, own = docs.columns.index(text_col), [docs.columns.index(f.name) for f in (docs.schema.fields if only_kept else schema.fields[:-3])]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few centroids for each language

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, score, far = sent.value.predict(b.column(at).to_pylist())
            columns = [b.column(i) for i in own]
            if only_kept:
                yield pa.RecordBatch.from_arrays(columns, schema.names).filter(pa.array(~far))
            else:
                yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(score), pa.array(far)], schema.names)

    return map_arrow(docs, schema, work)
