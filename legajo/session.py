"""Session settings and the shared folder for tables written between stages."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName("legajo")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


MAX_BROADCAST_ROWS = 100_000


def broadcast_if_small(small: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Mark for broadcast after counting; a larger table is left to an ordinary join."""
    return F.broadcast(small) if small.limit(max_rows + 1).count() <= max_rows else small


def spread_nulls(key: str, by: str) -> Column:
    """A join key of which NULL, which matches nothing, is spread by another column instead of meeting in one task.
    The stand-ins start with a character that no key has."""
    return F.coalesce(F.col(key), F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(by), F.lit(1 << 20)).cast("string")))


_LOCAL_ROOTS: dict[str, str] = {}
_WRITTEN: dict[tuple[str, str], str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder that every executor can reach, named by ``spark.checkpoint.dir``.

    Only a session on one machine may go without the setting; it then gets a new temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="legajo-")
    return _LOCAL_ROOTS[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no earlier run has used."""
    return f"{shared_folder(spark)}/legajo/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_table(
    spark: SparkSession,
    name: str,
    source: str,
    build: Callable[[], DataFrame],
    partition_by: tuple[str, ...] = (),
    rows_per_file: int = 0,
) -> DataFrame:
    """Write ``build()`` once per application and source folder, then read the files.

    Later stages start from the files, so a lost executor costs a re-read and not a re-computation. ``rows_per_file``
    bounds a file's rows, for tables whose rows cost far more to work on than to read: tasks are made of whole files.
    """
    digest = hashlib.sha256(source.encode()).hexdigest()[:12]
    key = (spark.sparkContext.applicationId, f"{name}-{digest}")
    if key not in _WRITTEN:
        path = new_path(spark, f"{name}-{digest}")
        writer = build().write.mode("errorifexists")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        if rows_per_file:
            writer = writer.option("maxRecordsPerFile", rows_per_file)
        writer.parquet(path)
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key])
