"""Batch processing: validate, classify, extract, route and store a table of documents in one plan."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legajo.functions import metadata as md
from legajo.functions import scoring as sc
from legajo.functions import text as tx
from legajo.operators import catalog as cat
from legajo.operators import validation
from legajo.operators.classify import RULE_METHODS

# Error texts of rejected documents.
INVALID_FILE = "Archivo PDF inválido"
NO_TEXT = "No se pudo extraer texto del PDF"


class Processed(NamedTuple):
    """``results`` has one row per document; ``catalog`` and ``quarantine`` are what is stored."""

    results: DataFrame
    catalog: DataFrame
    quarantine: DataFrame


def process(
    docs: DataFrame, manifest: DataFrame, registry: DataFrame | None, at: Column,
    store: Callable[[DataFrame], DataFrame], root: str = "output",
    methods: Sequence[str] = RULE_METHODS,
) -> Processed:
    """``docs(doc_id, filename, processed_at, text)`` and ``manifest(doc_id, path, ...)`` to results.

    A document that fails keeps its row with an error, and never reaches the scorers. ``store`` writes
    the catalog rows and reads them back; routing and results start from there, so the texts are
    classified once and a file is never placed before its row exists.
    """
    checked = validation.validate(manifest)
    joined = docs.join(checked.select("doc_id", "is_valid"), "doc_id", "left")
    empty = F.char_length(tx.strip(tx.text_or_empty(F.col("text")))) == 0
    error = F.when(~F.coalesce("is_valid", F.lit(False)), INVALID_FILE).when(empty, NO_TEXT)
    marked = joined.withColumn("error", error).drop("is_valid")
    accepted = marked.filter(F.col("error").isNull()).drop("error")
    rows = store(cat.catalog_rows(cat.classify(accepted, registry, methods)))
    placed = cat.route(rows.select(
        F.col("id").alias("doc_id"), "filename", F.col("fecha_procesado").alias("processed_at"), "tipo", "confidence"
    ), root)
    done = placed.select(
        "doc_id", "filename", F.lit(True).alias("success"), F.lit(None).cast("string").alias("error"),
        F.col("tipo").alias("classification"), "confidence", F.col("dest_path").alias("destination"),
    )
    failed = marked.filter(F.col("error").isNotNull()).select(
        "doc_id", "filename", F.lit(False).alias("success"), "error",
        F.lit(None).cast("string").alias("classification"), F.lit(0.0).alias("confidence"),
        F.lit(None).cast("string").alias("destination"),
    )
    return Processed(done.unionByName(failed), rows, validation.quarantine_rows(checked, at))


def summary(results: DataFrame) -> DataFrame:
    """Totals of a run; nothing is ever skipped."""
    return results.agg(
        F.count("*").alias("total_files"), F.count_if("success").alias("processed"),
        F.count_if(~F.col("success")).alias("errors"), F.lit(0).cast("bigint").alias("skipped"),
    )


def summary_by_type(results: DataFrame) -> DataFrame:
    return results.filter("success").groupBy("classification").agg(F.count("*").alias("n"))


def legacy_rows(docs: DataFrame) -> DataFrame:
    """Six-column rows of the earlier version: first-match type and tax id only."""
    text = F.col("text")
    return docs.select(
        F.col("doc_id").alias("id"), "filename", sc.first_match_type(text).alias("tipo"),
        md.tax_id(tx.text_or_empty(text)).alias("cuit"), F.lit(None).cast("string").alias("proveedor"),
        F.col("processed_at").alias("fecha_procesado"),
    )


def reprocess(catalog: DataFrame, ids: DataFrame, registry: DataFrame | None = None, methods: Sequence[str] = RULE_METHODS) -> DataFrame:
    """New catalog rows for the stored documents listed in ``ids(id)``."""
    chosen = catalog.join(ids.select("id"), "id", "left_semi").select(
        F.col("id").alias("doc_id"), "filename", F.col("fecha_procesado").alias("processed_at"),
        F.col("texto_extraido").alias("text"),
    )
    return cat.catalog_rows(cat.classify(chosen, registry, methods))
