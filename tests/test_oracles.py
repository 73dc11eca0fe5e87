"""Every query that has SQL, against DuckDB on the same tables."""

import math

import duckdb
import pytest

from vecloom import registry
from vecloom.session import TABLES, sample_dir

SF = sample_dir("sf0.001")


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return "nan" if math.isnan(v) else round(float(v), 5) + 0.0
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    want = duck.execute(registry.oracle_sql()[name])
    columns = sorted(df.columns)
    names = [c[0] for c in want.description]
    assert sorted(names) == columns
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    at = [names.index(c) for c in columns]
    assert got == sorted(repr(tuple(plain(r[i]) for i in at)) for r in want.fetchall())
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs_without_sql(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0
    spark.catalog.clearCache()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
