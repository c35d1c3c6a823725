"""Input folders as manifest tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from legajo.rules import catalog as rules


FILES = "path string, modificationTime timestamp, length bigint, content binary"


def scan_folder(spark: SparkSession, folder: str, glob: str = "*", recursive: bool = False) -> DataFrame:
    """``path, modificationTime, length, content`` of the files in a folder, and below it if ``recursive``; a column
    that is not selected is not read. A folder that does not exist has no files."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())
    return reader.load(folder) if folder_exists(spark, folder) else spark.createDataFrame([], FILES)


def folder_exists(spark: SparkSession, folder: str) -> bool:
    try:
        spark.read.format("binaryFile").load(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def with_reason(files: DataFrame, extensions=tuple(rules.EXTENSIONS), max_bytes: int = rules.MAX_BYTES) -> DataFrame:
    """Add ``reason`` why a file is not taken, null where it is."""
    named = F.exists(F.array(*[F.lit(e) for e in extensions]), lambda e: F.endswith(F.lower("path"), e))
    reason = F.when(~F.coalesce(named, F.lit(False)), "extension").when(F.coalesce(F.col("length"), F.lit(0)) > max_bytes, "size")
    return files.withColumn("reason", reason)


def supported(files: DataFrame, extensions=tuple(rules.EXTENSIONS), max_bytes: int = rules.MAX_BYTES) -> DataFrame:
    """Files with a supported extension and an acceptable size; ``rejected`` has the others."""
    ends = F.lit(False)
    for e in extensions:
        ends = ends | F.endswith(F.lower("path"), F.lit(e))
    return files.filter(ends & (F.col("length") <= max_bytes))


def rejected(files: DataFrame, extensions=tuple(rules.EXTENSIONS), max_bytes: int = rules.MAX_BYTES) -> DataFrame:
    """Files that ``supported`` leaves out, each with its ``reason``: ``extension`` or ``size``."""
    return with_reason(files, extensions, max_bytes).filter(F.col("reason").isNotNull())


def new_files(files: DataFrame, seen: DataFrame) -> DataFrame:
    """Files that the manifest ``seen`` does not have: unknown paths, and those whose size or time has changed."""
    same = [c for c in ("path", "length", "modificationTime") if c in files.columns and c in seen.columns]
    return files.join(seen.select(*same).distinct(), same, "left_anti")


def merged_scans(*scans: DataFrame) -> DataFrame:
    """Files of several scans, each path once."""
    merged = scans[0]
    for s in scans[1:]:
        merged = merged.unionByName(s)
    return merged.dropDuplicates(["path"])


def folder_status(files: DataFrame, exists: bool = True) -> DataFrame:
    """Whether the folder exists, and number and total size of its files; their names are the manifest rows."""
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).withColumn("exists", F.lit(exists))


def with_hashes(files: DataFrame, max_bytes: int = rules.MAX_BYTES) -> DataFrame:
    """SHA-256 of the content and whether all bytes were read. A file above ``max_bytes``, which no later step takes,
    keeps its row but is not read: its size is known before its content."""
    size = F.octet_length("content").cast("bigint")
    read = files.filter(F.col("length") <= max_bytes).select(
        "path", "length", F.sha2("content", 256).alias("sha256"), size.alias("bytes_read"),
        (size == F.col("length")).alias("complete"),
    )
    large = files.filter(F.col("length") > max_bytes).select(
        "path", "length", F.lit(None).cast("string").alias("sha256"), F.lit(0).cast("bigint").alias("bytes_read"), F.lit(False).alias("complete"))
    return read.unionByName(large)
