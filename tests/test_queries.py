"""Every registered query with SQL against DuckDB on the small tables."""

import os
from pathlib import Path

import pandas as pd
import pytest

from gridloom import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from '{f}'")
    a, b = catalog.QUERIES[name](spark, DATA).toPandas(), c.sql(catalog.SQL[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    said = lambda t: sorted(tuple("" if pd.isna(v) else f"{v:.5g}" if isinstance(v, float) else str(v) for v in r) for r in t[cols].astype(object).itertuples(index=False))
    norm = lambda t: said(t.apply(lambda s: s.astype(float) if pd.api.types.is_numeric_dtype(s) and not pd.api.types.is_bool_dtype(s) else s))
    assert norm(a) == norm(b)
