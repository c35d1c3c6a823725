"""Inputs derived from the raw tables: file manifest, page table, layout spans, logs, registry rows,
review corrections and labelled samples. The SQL statements also run in other engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from legajo.rules.types import UNKNOWN
from legajo.sources.tables import business_docs, table

# One file per order: sizes and page counts on both sides of every limit, some other extensions,
# password-protected files and files with little or no text.
MANIFEST_SQL = """
SELECT o_orderkey AS doc_id,
       concat('/in/doc_', lpad(cast(o_orderkey AS string), 8, '0'),
              CASE WHEN o_orderkey % 17 = 0 THEN '.txt' WHEN o_orderkey % 13 = 0 THEN '.PDF' ELSE '.pdf' END) AS path,
       CASE o_orderkey % 19 WHEN 0 THEN 1023 WHEN 1 THEN 1024 WHEN 2 THEN 52428800 WHEN 3 THEN 52428801
            WHEN 4 THEN 0 ELSE cast(round(o_totalprice) AS bigint) + 2000 END AS length,
       cast(CASE o_orderkey % 23 WHEN 0 THEN 0 WHEN 1 THEN 500 WHEN 2 THEN 501 ELSE 1 + o_orderkey % 7 END AS int)
         AS page_count,
       o_orderstatus = 'P' AS needs_pass,
       cast(o_orderkey % 64 AS int) AS permissions,
       cast(o_orderkey % 3 AS int) AS pages_with_images,
       cast(o_custkey % 40 AS bigint) AS total_characters,
       cast(o_custkey % 90 AS bigint) AS extractable_chars,
       o_custkey % 40 > 0 AS has_early_text
FROM {orders}
"""

# Pairs of events as start and end of one operation.
OPERATION_LOG_SQL = """
SELECT cast(floor(event_id / 2) AS bigint) AS op_id,
       CASE WHEN event_id % 2 = 0 THEN 'start' ELSE 'end' END AS phase,
       ts, event_type AS method, value / 1000 AS processing_time, event_type <> 'error' AS success
FROM {events}
"""


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(MANIFEST_SQL, orders=table(spark, sf_dir, "orders"))


def operation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(OPERATION_LOG_SQL, events=table(spark, sf_dir, "events"))


def page_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents, their turns as pages."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page_num"), "role", "text"
    )


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One block with one span per line of the business documents."""
    lines = business_docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    x0 = F.when(F.col("line") % 2 == 1, 60.0).otherwise(40.0)
    y0 = (F.lit(40) + F.lit(90) * F.col("line")).cast("double")
    return lines.select(
        "doc_id", F.lit(595.0).alias("page_w"), F.lit(842.0).alias("page_h"), F.col("line").alias("block_id"),
        F.lit(0).alias("line_id"), F.lit(0).alias("span_id"), "text",
        F.when(F.col("line") == 0, 16.0).otherwise(10.0).alias("size"), F.lit("Helvetica").alias("font"),
        x0.alias("x0"), y0.alias("y0"), (x0 + F.char_length("text") * 6).alias("x1"), (y0 + 14).alias("y1"),
    )


def supplier_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry rows for the suppliers of the raw tables."""
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        key.cast("int").alias("ord"), F.concat(F.lit("sup_"), key.cast("string")).alias("supplier_id"),
        F.array("s_name").alias("names"),
        F.concat(F.lit("30-"), F.lpad(key.cast("string"), 8, "0"), F.lit("-"), (key % 10).cast("string")).alias("cuit"),
        (F.col("s_acctbal") < 0).alias("in_debt"), F.col("s_nationkey").alias("nation"),
    )


def corrections(catalog: DataFrame) -> DataFrame:
    """Two corrections for every unknown document: a first guess, and a day later the final one; for
    some the final one is not a category that reviewers may choose."""
    unknown = catalog.filter(F.col("tipo") == UNKNOWN).select(F.col("id").alias("doc_id"), "fecha_procesado")
    first = unknown.select("doc_id", F.lit("facturas").alias("tipo"), F.col("fecha_procesado").alias("ts"))
    final = F.when(F.col("doc_id") % 5 == 0, "sin_categoria").when(F.col("doc_id") % 2 == 0, "otros").otherwise("remitos")
    second = unknown.select("doc_id", final.alias("tipo"), (F.col("fecha_procesado") + F.expr("INTERVAL 1 DAY")).alias("ts"))
    return first.unionByName(second)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a quality label."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("label")), "doc_id")
