"""Every registered query of the library against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from corvane.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = catalogue.oracle_sql()
#: These need bins of every config (0 to 99), which only larger tables have.
LARGE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{LARGE}/{t}.parquet'")
    return con


@pytest.fixture(scope="module", autouse=True)
def static_plans(spark):
    """Small tables need no re-planning at run time; the driver's own run has it."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v:
        return None
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "item"):
        v = v.item()
    return repr(round(float(v), 9)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def rows(df):
    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    mine = catalogue.queries()[name](spark, LARGE).toPandas()
    theirs = duck.execute(SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert len(mine) > 0
    assert rows(mine) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(SQL)))
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, LARGE).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert os.path.isdir(LARGE)
