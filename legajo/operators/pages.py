"""Page tables: whole-text assembly, page lookup, page profile. Pages are ``doc_id, page_num, text``,
numbered from 1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legajo.functions import text as tx
from legajo.rules import catalog as rules


def assemble(pages: DataFrame) -> DataFrame:
    """``doc_id, text``: pages in order, each after a marker line, trimmed."""
    marked = F.concat(
        F.lit("\n--- Página "), F.col("page_num").cast("string"), F.lit(" ---\n"), tx.text_or_empty(F.col("text"))
    )
    ordered = F.sort_array(F.collect_list(F.struct("page_num", marked.alias("m"))))
    return pages.groupBy("doc_id").agg(
        tx.strip(F.array_join(F.transform(ordered, lambda p: p["m"]), "")).alias("text")
    )


def page_lookup(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """Trimmed text of page ``page_index`` (from 0) of each request; NULL when there is no such page."""
    numbered = pages.select(
        "doc_id", (F.col("page_num") - 1).alias("page_index"), tx.strip(F.col("text")).alias("text")
    )
    return requests.join(numbered, ["doc_id", "page_index"], "left")


def page_profile(pages: DataFrame) -> DataFrame:
    """Page counts, text lengths, and what the first pages hold."""
    size = F.char_length(F.col("text"))
    filled = F.char_length(tx.strip(tx.text_or_empty(F.col("text")))) > 0
    early = F.col("page_num") <= rules.CONTENT_PAGES
    profile = pages.groupBy("doc_id").agg(
        F.count("*").alias("total_pages"),
        F.count_if(filled).alias("pages_with_text"),
        F.coalesce(F.avg(F.when(filled, size)), F.lit(0.0)).alias("average_text_length"),
        F.coalesce(F.sum(F.when(filled & early, size)), F.lit(0)).alias("total_characters"),
        F.count_if(filled & early).alias("extractable_pages"),
        F.coalesce(F.sum(F.when(filled, F.char_length(tx.strip(F.col("text"))))), F.lit(0))
        .alias("extractable_chars"),
        F.coalesce(F.max(filled & (F.col("page_num") <= rules.REPORT_PAGES)), F.lit(False)).alias("has_early_text"),
    )
    return profile.withColumn("text_density", F.col("total_characters") / F.col("total_pages"))


def document_info(pages: DataFrame, info: DataFrame) -> DataFrame:
    """Page count of each document with its title, author and other given properties."""
    return pages.groupBy("doc_id").agg(F.count("*").alias("page_count")).join(info, "doc_id", "left")
