"""What several operators of this package share: stored stages, global ranks, code for the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from legajo.session import new_path

_SHIPPED: set[str] = set()


#: Rows of a batch that goes to Python: texts are long, and ten thousand of them (the default) take much memory.
BATCH_ROWS = 1_000
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Give the executors this package, so that functions of it can run there, once per application; and make
    batches smaller where the session has the default."""
    if spark.conf.get(BATCH_SETTING) == "10000":
        spark.conf.set(BATCH_SETTING, BATCH_ROWS)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(prefix="legajo-code-"), "legajo.zip")
    with zipfile.ZipFile(path, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent).as_posix())
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """``df`` written to the shared folder, in folders by the columns ``by``, and read back: cuts lineage, and a lost
    executor costs a re-read."""
    path = new_path(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checked(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")


def map_arrow(df: DataFrame, schema: T.StructType | str, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(work, schema)


def with_columns(schema: T.StructType, new: list[T.StructField]) -> T.StructType:
    """``schema`` followed by ``new``; a column of the same name (in any case) gives way to the new one."""
    names = {f.name.lower() for f in new}
    return T.StructType([f for f in schema.fields if f.name.lower() not in names] + new)


class Memory:
    """What ``encode`` gives for words, kept in two generations of about ``limit`` words: when the newer is full, it
    becomes the older, so frequent words stay and memory is bounded. Words of over ``LONG`` characters are not kept."""

    LONG = 64

    def __init__(self, encode: Callable[[list[str]], Iterable[bytes]], limit: int) -> None:
        self.encode, self.limit = encode, limit
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.long: list[str] = []

    def of(self, words: set[str]) -> dict[str, bytes]:
        """A dictionary that holds all of ``words``, good until the next call."""
        for w in self.long:
            del self.new[w]
        if len(self.new) > self.limit:
            self.old, self.new = self.new, {}
        missing = words.difference(self.new)
        again = [w for w in missing if w in self.old]
        self.new.update((w, self.old[w]) for w in again)
        unknown = list(missing.difference(again))
        self.new.update(zip(unknown, self.encode(unknown), strict=True))
        self.long = [w for w in unknown if len(w) > self.LONG]
        return self.new


#: Characters of text, or list values, that a task works on between two batches that leave it.
STEP = 1 << 20


def steps(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about ``STEP`` bytes (or list values) in ``column``, of one row at least."""
    values = batch.column(column)
    count = pc.list_value_length(values) if pa.types.is_list(values.type) else pc.binary_length(values)
    start = total = 0
    for i, n in enumerate(count.fill_null(0).to_pylist()):
        total += n
        if total >= STEP:
            yield batch.slice(start, i + 1 - start)
            start, total = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def ranked(df: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """``df`` with ``pos``, its place (from 0) in the total order ``order``.

    One range-sort, stored; then a count per partition, of which the driver sees one number each. No key needs
    one task: equal keys that must not share a partition take a unique last sort column.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    sort = df.repartitionByRange(*cols).sortWithinPartitions(*cols)
    rows = stored(sort.withColumn("_local", F.monotonically_increasing_id()), name)
    part = F.shiftrightunsigned("_local", 33)
    counts = sorted((r["part"], r["n"]) for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before, starts = 0, []
    for p, n in counts:
        starts.append((int(p), before))
        before += n
    offsets = df.sparkSession.createDataFrame(starts, "_part long, _before long")
    return (
        rows.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")  # one row for each partition of the sort
        .withColumn("pos", F.col("_before") + F.col("_local").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_part", "_before", "_local")
    )
