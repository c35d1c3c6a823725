"""Exact duplicates: group by a 128-bit content hash, compare bytes inside groups, keep one stable id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legajo.llm.common import checked

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalised(text: Column) -> Column:
    """A-Z in lower case, everything else as it is; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _members(docs: DataFrame, id_col: str, text_col: str, keep: str, hashed: Callable[[Column], Column]) -> DataFrame:
    """``doc_id, _hash, _sha, _copies`` (rows with this id and text) with ``group_size, keep_id`` of their group."""
    checked(docs, id_col, text_col)
    text = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text")).withColumn("_sha", F.unhex(F.sha2("_text", 256)))
    rows = rows.withColumn("_hash", hashed(F.col("_text")))
    best = F.max("doc_id") if keep == "largest" else F.min("doc_id")
    groups = (
        rows.groupBy("_hash", "_text", "_sha")
        .agg(F.count("*").alias("group_size"), best.alias("keep_id"))
        .select("_hash", "_sha", "group_size", "keep_id")
    )
    return rows.groupBy("doc_id", "_hash", "_sha").agg(F.count("*").alias("_copies")).join(groups, ["_hash", "_sha"])


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest",
    hashed: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are grouped by ``hashed`` and by their bytes, so that a collision of the hash separates into groups
    of its own; the grouping combines before the shuffle, so thousands of copies leave a task as one row. The
    rows then find their group over narrow columns (id, hash, digest), a join of which Spark can split a hot key.

    Of a group the row with the largest id stays (``keep="smallest"``: the smallest). A null text is an empty
    one. Null ids are never preferred to others. Of several rows with the id that stays, one stays. An empty
    table gives an empty result. Columns other than the two named are not read.
    """
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_copy")
    return _members(docs, id_col, text_col, keep, hashed).select(
        "doc_id", "keep_id", "group_size", copies, F.lower(F.hex("_sha")).alias("text_sha256"),
    ).select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)).alias("kept"), "text_sha256",
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of ``docs`` that stay, one for each distinct normalised text, with all their columns.

    Where several rows share both the id and the text, the smallest of them by its columns in their order stays.
    """
    stay = (
        _members(docs, id_col, text_col, keep, content_hash).where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .select(F.col("doc_id").alias("_id"), F.col("_sha").alias("_key"), "_copies")
    )
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_own"),
        F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("_text_key"),
    )

    def matched(part: DataFrame) -> DataFrame:
        return keyed.join(part, keyed["_own"].eqNullSafe(part["_id"]) & (keyed["_text_key"] == part["_key"]))

    single = matched(stay.where("_copies = 1")).select("_row")
    several = matched(stay.where("_copies > 1")).groupBy("_own", "_text_key").agg(F.min("_row").alias("_row"))
    return single.unionAll(several.select("_row")).select("_row.*")
