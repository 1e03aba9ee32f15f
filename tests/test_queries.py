import glob
import os

import duckdb
import pandas as pd
import pytest

from atlasq.plans import fact_queries, queries  # noqa: F401  both register
from tests.conftest import DATA


@pytest.fixture(scope="module")
def tables():
    own = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        own.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return own


def plain(df):
    def value(x):
        return None if x is None or x is pd.NaT or x is pd.NA or x != x else round(float(x), 9) if isinstance(x, float) else str(x)

    return sorted((tuple(value(x) for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_give_what_their_sql_gives(spark, tables, name):
    assert plain(queries.QUERIES[name](spark, DATA).toPandas()) == plain(tables.sql(queries.ORACLES[name]).df())


def test_entry_and_rows_only_queries(spark):
    assert queries.entry(spark, DATA).count() > 0
    assert all(queries.QUERIES[name](spark, DATA).count() > 0 for name in set(queries.QUERIES) - set(queries.ORACLES))


@pytest.mark.parametrize("name", ["route_match", "unmatched_calls"])
def test_pages_of_one_id_are_calls_each(spark, tmp_path, name):
    urls = ["http://h.x/en/7", "http://h.x/en/8/", "http://h.x/en/8", "http://h.x/fr/1", "http://h.x/fr/2", "http://k.x/en/9"]
    pd.DataFrame({"page_id": [2, 2, 2, 1, 3, 4], "url": [urls[0], urls[1], urls[2], urls[0], urls[1], urls[5]]}).to_parquet(tmp_path / "pages.parquet")
    own = duckdb.connect()
    own.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet'")
    expected = plain(own.sql(queries.ORACLES[name]).df())
    assert expected and plain(queries.QUERIES[name](spark, str(tmp_path)).toPandas()) == expected
