"""Incremental ingest of document files and windowed counts on a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from legajo.operators.classify import RULE_METHODS
from legajo.plans import batch

DOCS_SCHEMA = "doc_id bigint, filename string, processed_at timestamp_ntz, text string"


def ingest(
    spark: SparkSession, source: str, target: str, checkpoint: str, manifest: DataFrame, at: Column,
    registry: DataFrame | None = None, methods: Sequence[str] = RULE_METHODS, files_per_batch: int = 1000,
) -> StreamingQuery:
    """Process every document file that has not been seen yet by the plan of ``batch.process``, then stop.

    The checkpoint replaces moving files away. ``target`` gets the folders ``catalog`` (by type), ``results`` and
    ``quarantine``, each with a folder per micro-batch that the batch overwrites, so one repeated after a failure
    leaves no duplicates. ``manifest`` describes the files, as for the batch.
    """
    stream = spark.readStream.schema(DOCS_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def write(docs: DataFrame, batch_id: int) -> None:
        def folder(name: str) -> str:
            return f"{target}/{name}/batch_id={batch_id}"

        def store(rows: DataFrame) -> DataFrame:
            rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("tipo").parquet(folder("catalog"))
            return docs.sparkSession.read.schema(rows.schema).parquet(folder("catalog"))

        own = manifest.join(docs.select("doc_id"), "doc_id", "left_semi")
        done = batch.process(docs, own, registry, at, store, methods=methods)
        done.results.write.mode("overwrite").parquet(folder("results"))
        done.quarantine.write.mode("overwrite").parquet(folder("quarantine"))

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def daily_counts(events: DataFrame, time: str, kind: str, lateness: str = "1 day") -> DataFrame:
    """Rows per day and kind; works on a stream (with a watermark) and on a table alike."""
    timed = events.withWatermark(time, lateness) if events.isStreaming else events
    return timed.groupBy(F.window(time, "1 day"), kind).agg(F.count("*").alias("n")).select(
        F.col("window.start").alias("day"), kind, "n"
    )


def recent_counts(
    events: DataFrame, time: str, key: str, kind: str, lateness: str = "2 days", span: str = "24 hours", every: str = "6 hours",
) -> DataFrame:
    """Rows per kind in the ``span`` up to each full ``every``, each ``key`` once: ``until, kind, n``.

    On a stream, repeated keys are dropped as long as the watermark keeps them, ``lateness`` behind the newest row, and
    so are rows that come later than that; the state holds no more than that time. A table is counted as a whole.
    """
    if events.isStreaming:
        once = events.withWatermark(time, lateness).dropDuplicatesWithinWatermark([key])
    else:
        once = events.dropDuplicates([key])
    return once.groupBy(F.window(time, span, every), kind).agg(F.count("*").alias("n")).select(
        F.col("window.end").alias("until"), kind, "n"
    )


def latest_counts(updates: DataFrame, kind: str, at: str = "day") -> DataFrame:
    """Counts per time and kind from the rows that a stream of windowed counts in update mode has written, each
    with its ``batch_id``: the last update of a window holds."""
    return updates.groupBy(at, kind).agg(F.max_by("n", "batch_id").alias("n"))
