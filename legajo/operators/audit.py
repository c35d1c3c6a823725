"""Audit rows of classifications and timings of operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def classification_log(classified: DataFrame, methods) -> DataFrame:
    """One flat row per classified document."""
    results = F.to_json(F.create_map(*[x for m in methods for x in (F.lit(m), F.col(m))]))
    return classified.select(
        F.col("filename").alias("document_path"), F.col("tipo").alias("final_classification"),
        F.col("confidence").alias("final_confidence"), results.alias("method_results"),
        F.to_json("consensus").alias("consensus_analysis"), "supplier_id", "supplier_confidence",
        F.col("decision.reasoning").alias("decision_reasoning"),
    )


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def operation_timings(log: DataFrame) -> DataFrame:
    """Duration in seconds per operation of ``log(op_id, phase, ts, ...)`` with start and end rows;
    NULL when one side is missing."""
    start = F.min(F.when(F.col("phase") == "start", F.col("ts")))
    end = F.max(F.when(F.col("phase") == "end", F.col("ts")))
    seconds = F.unix_micros(F.col("ended_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))
    return log.groupBy("op_id").agg(start.alias("started_at"), end.alias("ended_at")).withColumn(
        "duration", seconds / F.lit(1_000_000.0)
    )


def method_performance(log: DataFrame) -> DataFrame:
    """Runs, success rate and mean time per method of ``log(method, processing_time, success)``."""
    return log.groupBy("method").agg(
        F.count("*").alias("runs"), F.avg(F.col("success").cast("double")).alias("success_rate"),
        F.avg("processing_time").alias("mean_time"),
    )
