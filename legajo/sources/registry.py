"""Supplier registry: read, write and flatten."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from legajo.rules.suppliers import SUPPLIERS

PATTERN = "struct<specific_terms:array<string>,layout_indicators:array<string>,confidence_boost:double>"
ENTRY = f"struct<names:array<string>,cuit:string,document_patterns:map<string,{PATTERN}>,contact_info:map<string,string>>"
SCHEMA = (
    "ord int, supplier_id string, names array<string>, cuit string, "
    f"document_patterns map<string,{PATTERN}>, contact_info map<string,string>"
)


def built_in_rows() -> list[Row]:
    """The built-in registry as constants, for operators that compile it into a plan."""
    fields = [f.split()[0] for f in SCHEMA.split(", ")[:4]] + ["document_patterns", "contact_info"]
    pattern = Row("specific_terms", "layout_indicators", "confidence_boost")
    return [
        Row(*fields)(i, s["supplier_id"], s["names"], s["cuit"], {t: pattern(a, b, c) for t, a, b, c in s["patterns"]}, s["contact"])
        for i, s in enumerate(SUPPLIERS)
    ]


def built_in_registry(spark: SparkSession) -> DataFrame:
    rows = [
        (i, s["supplier_id"], s["names"], s["cuit"],
         {t: (terms, indicators, boost) for t, terms, indicators, boost in s["patterns"]}, s["contact"])
        for i, s in enumerate(SUPPLIERS)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def read_registry(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Registry from one JSON object keyed by supplier id; the built-in one without a path."""
    if path is None:
        return built_in_registry(spark)
    text = spark.read.text(path, wholetext=True)
    entries = F.map_entries(F.from_json("value", f"map<string,{ENTRY}>"))
    rows = text.select(F.posexplode(entries).alias("ord", "e"))
    return rows.select("ord", F.col("e.key").alias("supplier_id"), "e.value.*")


def read_registry_lines(spark: SparkSession, path: str) -> DataFrame:
    """Registry from files with one JSON object per line, each with entries by supplier id: the form for registries too
    large for one object. Entries are ordered by their ``ord``, or by id where they have none."""
    entries = F.explode(F.map_entries(F.from_json("value", f"map<string,{ENTRY.replace('struct<', 'struct<ord:int,', 1)}>"))).alias("e")
    rows = spark.read.text(path).select(entries)
    return rows.select(F.col("e.key").alias("supplier_id"), "e.value.*")


def write_registry_lines(registry: DataFrame, path: str) -> None:
    """One JSON object per line and supplier, keyed by its id."""
    entry = F.struct(*[c for c in ("ord", "names", "cuit", "document_patterns", "contact_info") if c in registry.columns])
    registry.select(F.to_json(F.create_map("supplier_id", entry)).alias("value")).write.mode("errorifexists").text(path)


def write_registry(registry: DataFrame, path: str) -> None:
    """Write a new version; the path must not exist, so a failed write leaves the old one usable."""
    registry.write.mode("errorifexists").parquet(path)


def registry_patterns(registry: DataFrame) -> DataFrame:
    """One row per supplier and document type."""
    return registry.select("supplier_id", F.explode("document_patterns").alias("doc_type", "p")).select(
        "supplier_id", "doc_type", "p.specific_terms", "p.layout_indicators", "p.confidence_boost"
    )
