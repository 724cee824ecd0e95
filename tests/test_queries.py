"""Every registered query outside the corpus subpackage against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidewell.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def plain(x):
    if isinstance(x, (np.ndarray, list, tuple)):
        return tuple(plain(y) for y in x)
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, (float, np.floating)) and np.isnan(x)):
        return "null"
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, (int, float, np.integer, np.floating)):
        return f"{float(x):.6g}"
    if hasattr(x, "isoformat"):
        return str(pd.Timestamp(x).tz_localize(None))
    try:
        return f"{float(x):.6g}"
    except (TypeError, ValueError):
        return str(x)


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(plain(x) for x in r) for r in df.values.tolist())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    assert rows(registry.queries()[name](spark, sf_dir).toPandas()) == rows(duck.execute(SQL[name]).df())


def test_queries_without_sql_run(spark, sf_dir):
    for name in sorted(set(registry.queries()) - set(SQL)):
        assert registry.queries()[name](spark, sf_dir).count() > 0, name


def test_flagship(spark, sf_dir):
    assert registry.flagship(spark, sf_dir).columns == ["region", "month", "revenue", "n_lines"]
