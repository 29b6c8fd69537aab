"""Every registered query against its SQL on the smallest tables."""

import os

import pandas as pd
import pytest

from docketry.plans import catalogue

DIR = os.environ.get("DOCKETRY_TESTDATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DIR):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(df):
    columns = sorted(df.columns)
    fix = lambda v: None if v is None or v is pd.NA or v != v else (repr(float(v)) if isinstance(v, float) else str(v))
    return columns, sorted([[fix(v) for v in row] for row in df[columns].astype(object).values.tolist()], key=str)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_matches_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DIR).toPandas()
    assert len(got.columns)
    if name in catalogue.ORACLES:
        assert plain(got) == plain(duck.sql(catalogue.ORACLES[name]).df())


def test_entry(spark):
    import __spark_entry__

    assert catalogue.FLAGSHIP in __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
