"""A catalog folder whose types are replaced one by one: new files beside the old, switched by a manifest.

``<path>/data/tipo=<type>/part=<id>`` holds the rows of one write; ``<path>/manifest/<number>`` says which parts make
up a version (``tipo, part``). A version holds once its manifest is written as a whole; a write that fails before
leaves the last one, and readers of an older version keep its files.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from legajo.operators.review import latest_overrides

MANIFEST = "version bigint, tipo string, part string"
#: Rows of a type are kept in the order of what searches ask for, so that files and row groups can be skipped.
CLUSTERED_BY = ("doc_date", "amount", "id")


def _manifests(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all versions. A manifest is one file, which appears when its write is committed."""
    try:
        return spark.read.schema(MANIFEST).json(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def current_parts(spark: SparkSession, path: str, version: int | None = None) -> dict[str, str]:
    """The part of each type in ``version`` (None: the last); as many entries as there are types."""
    rows = _manifests(spark, path)
    wanted = F.col("version") == (rows.agg(F.max("version")).scalar() if version is None else F.lit(version))
    return {r["tipo"]: r["part"] for r in rows.filter(wanted & F.col("tipo").isNotNull()).collect()}


def last_version(spark: SparkSession, path: str) -> int:
    return _manifests(spark, path).agg(F.max("version").alias("v")).first()["v"] or 0


def _commit(spark: SparkSession, path: str, parts: dict[str, str]) -> int:
    number = last_version(spark, path) + 1
    rows = [(number, t, p) for t, p in sorted(parts.items())] or [(number, None, None)]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").json(f"{path}/manifest")
    return number


def _write_parts(rows: DataFrame, path: str) -> str:
    """Write ``rows`` in a folder by type and a new part; range-sorted, so that a type with a large share of the rows
    is several files, and a file holds a stretch of days."""
    part = uuid.uuid4().hex[:12]
    keys = ["tipo", *(c for c in CLUSTERED_BY if c in rows.columns)]
    clustered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    clustered.withColumn("part", F.lit(part)).write.mode("append").partitionBy("tipo", "part").parquet(f"{path}/data")
    return part


def write_version(rows: DataFrame, path: str) -> int:
    """Write ``rows`` (with ``tipo``) as the next version, all types anew; its number."""
    part = _write_parts(rows, path)
    spark = rows.sparkSession
    kinds = [r["tipo"] for r in rows.select("tipo").distinct().collect()]  # a row for each type
    return _commit(spark, path, {t: part for t in kinds})


def read_version(spark: SparkSession, path: str, schema: StructType, version: int | None = None, types: list[str] | None = None) -> DataFrame:
    """The rows of a version (None: the last), of some ``types`` or all; only their folders are listed."""
    parts = current_parts(spark, path, version)
    folders = [f"{path}/data/tipo={t}/part={p}" for t, p in parts.items() if types is None or t in types]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{path}/data").parquet(*folders).select(*schema.names)


def merge_overrides(spark: SparkSession, path: str, schema: StructType, overrides: DataFrame) -> int:
    """Apply ``overrides(doc_id, tipo, ts)`` to the last version; the number of the new one.

    Only the types that a document leaves or enters are written anew, each as a whole; the others keep their files.
    Corrections of unknown documents, and those to the type a document has, change nothing.
    """
    parts = current_parts(spark, path)
    last = latest_overrides(overrides).select(F.col("doc_id").alias("id"), F.col("tipo").alias("_to"))
    now = read_version(spark, path, schema)
    moved = now.select("id", "tipo").join(last, "id").filter(F.col("tipo") != F.col("_to"))
    pairs = moved.select("tipo", "_to").distinct().collect()  # pairs of types
    left, entered = {r["tipo"] for r in pairs}, {r["_to"] for r in pairs}
    if not pairs:
        return last_version(spark, path)
    changed = read_version(spark, path, schema, types=sorted(left | entered)).join(last, "id", "left")
    rows = changed.withColumn("tipo", F.coalesce("_to", "tipo")).select(*schema.names)
    part = _write_parts(rows, path)
    staying = {r["tipo"] for r in rows.select("tipo").distinct().collect()}  # a type that all its documents leave is gone
    return _commit(spark, path, {t: p for t, p in parts.items() if t not in left | entered} | {t: part for t in staying})
