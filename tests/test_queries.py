"""Every query that has SQL gives the same rows as DuckDB; the rest run; results do not depend on partitioning."""

import os

import duckdb
import pytest

from driftmark import queries as q

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df):
    names = sorted(df.columns)
    return names, sorted(repr(tuple(r)) for r in df.select(*[f"`{n}`" for n in names]).collect())


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    names, got = rows(q.QUERIES[name](spark, SF))
    frame = duck.sql(q.ORACLE_SQL[name])
    assert sorted(frame.columns) == names
    assert sorted(map(repr, frame.project(", ".join(f'"{n}"' for n in names)).fetchall())) == got


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.ORACLE_SQL)))
def test_runs_and_repeats(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    first = rows(q.QUERIES[name](spark, SF))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        assert rows(q.QUERIES[name](spark, SF)) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert first[1]


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(q.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
