"""Every registered query over the driver tables against the same in DuckDB."""

import duckdb
import pandas as pd
import pytest
from conftest import DATA

from tallyloom import plans
from tallyloom.sources.tables import TABLES


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in TABLES:
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return c


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)].astype(object)
    plain = lambda v: None if v is None or v is pd.NA or v != v else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(plain(v) for v in r) for r in pdf.itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    got = plans.QUERIES[name](spark, DATA)
    assert len(set(got.columns)) == len(got.columns)
    got = got.toPandas()
    if name in plans.ORACLE_SQL:
        want = duck.sql(plans.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
