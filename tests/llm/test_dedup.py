import hashlib

import pytest
from pyspark.sql import functions as F

from legajo.llm import dedup

ROWS = [
    (1, "Ab c"), (5, "aB C"), (3, "ab c"), (2, None), (4, ""), (9, "É"), (8, "é"), (7, "x" * 200_000), (6, "X" * 200_000), (10, "lone"),
]


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def brute(rows):
    norm = {}
    for i, t in rows:
        key = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        norm.setdefault(key, []).append(i)
    out = []
    for key, ids in norm.items():
        best = max((i for i in ids if i is not None), default=None)
        left = 1
        for i in ids:
            kept = i == best and left == 1
            left -= kept
            out.append((i, best, len(ids), kept, hashlib.sha256(key.encode()).hexdigest()))
    return sorted(out, key=str)


def test_groups(spark):
    assert sorted(map(tuple, dedup.exact_groups(table(spark, ROWS)).collect()), key=str) == brute(ROWS)


def test_repeated_rows_and_null_ids(spark):
    rows = [*ROWS, (5, "ab c"), (5, "ab c"), (None, "ab c"), (None, "alone"), (None, "alone"), (11, None), (11, None)]
    assert sorted(map(tuple, dedup.exact_groups(table(spark, rows)).collect()), key=str) == brute(rows)


def test_smallest_stays(spark):
    rows = {r.doc_id: r for r in dedup.exact_groups(table(spark, ROWS), keep="smallest").collect()}
    assert rows[5].keep_id == 1 and rows[1].kept and not rows[5].kept


def test_colliding_hashes_separate(spark):
    same = dedup.exact_groups(table(spark, ROWS), hashed=lambda t: F.unhex(F.lit("00")))
    assert sorted(map(tuple, same.collect()), key=str) == brute(ROWS)


def test_empty(spark):
    assert dedup.exact_groups(table(spark, [])).collect() == []
    assert dedup.drop_exact(table(spark, [])).collect() == []


def test_drop_keeps_columns_and_one_row_each(spark):
    rows = [(1, "A", "p", 3), (2, "a", "q", None), (2, "a", "b", 1), (3, None, "r", 0), (None, "z", "s", 1), (None, "z", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, _hash int")
    got = sorted(map(tuple, dedup.drop_exact(docs).collect()), key=str)
    assert got == sorted([(2, "a", "b", 1), (3, None, "r", 0), (None, "z", "s", 1)], key=str)
    assert dedup.drop_exact(docs).columns == docs.columns


def test_missing_column(spark):
    with pytest.raises(ValueError, match="text"):
        dedup.exact_groups(spark.range(3).withColumnRenamed("id", "doc_id"))
