"""Queries of the subpackage that SQL can express, against that SQL."""

import duckdb
import pandas as pd
import pytest

from lodestar.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), db.execute(queries.SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda v: None if pd.isna(v) else int(v) if isinstance(v, float) and v.is_integer() else v
    rows = lambda df: sorted(str(tuple(map(plain, r))) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))
    assert rows(got) == rows(want)
