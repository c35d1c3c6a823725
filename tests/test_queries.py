import pytest
from compare import connect, difference

import __spark_entry__ as spark_entry
from legajo.queries import QUERIES


@pytest.fixture(scope="module")
def db(sf):
    return connect(sf)


# On the smallest data some searches may find nothing on both sides.
@pytest.mark.parametrize("name", [n for n in spark_entry.oracle_sql() if n in QUERIES])
def test_query_equals_sql(spark, db, sf, name):
    assert difference(spark, db, sf, name) in (None, "both empty")


def test_every_query_is_known():
    assert set(spark_entry.oracle_sql()) & set(QUERIES) == set(QUERIES) - {"file_hashes"}
    assert set(QUERIES) <= set(spark_entry.queries())


def test_entry(spark):
    assert spark_entry.entry(spark).count() > 0


def test_file_hashes(spark, sf):
    rows = spark_entry.queries()["file_hashes"](spark, sf).collect()
    assert len(rows) == 14 and all(r.complete for r in rows)
