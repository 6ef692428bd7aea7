"""Every registered query of the catalog against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from catalith.plans import catalog
from catalith.sources.tables import SCHEMAS


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in SCHEMAS:
        path = f"{sf}/{name}.parquet"
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(frame: pd.DataFrame, columns: list[str]) -> list[tuple]:
    show = lambda x: "" if pd.isna(x) else f"{x:.6g}" if isinstance(x, float) else str(x)
    return sorted(tuple(show(x) for x in row) for row in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_agrees_with_its_sql(spark, sf, duck, name):
    ours, theirs = catalog.QUERIES[name](spark, sf).toPandas(), duck.sql(catalog.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    columns = sorted(ours.columns)
    whole = {c: "int64" for c in columns if str(ours[c].dtype).startswith(("int", "float")) and str(theirs[c].dtype).startswith("Int")}
    a, b = plain(ours.astype({c: "Int64" for c in whole}), columns), plain(theirs, columns)
    assert a == b


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_gives_rows(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0
