"""Every query with SQL against DuckDB on the smallest tables; the others must at least give rows."""

import math

import duckdb
import pandas as pd
import pytest

from parlance import plans

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and math.isnan(x):
        return None
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, list):
        return tuple(map(plain, x))
    return x + 0.0 if isinstance(x, int | float) and not isinstance(x, bool) else x


def rows(df: pd.DataFrame):
    names = sorted(df.columns)
    return names, sorted(str(tuple(map(plain, r))) for r in zip(*(df[c].tolist() for c in names), strict=True))


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    got = plans.QUERIES[name](spark, DATA).toPandas()
    if name in plans.ORACLES:
        assert rows(got) == rows(duck.sql(plans.ORACLES[name]).df())
    else:
        assert len(got.columns)


def test_oracles_have_queries():
    assert set(plans.ORACLES) <= set(plans.QUERIES)


def test_pool_matched_where_last_bits_decide(spark, tmp_path):
    """Of 15 pitches, two targets lie midway between two of them."""
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"COPY (SELECT k AS event_id, (hash(k) % 15)::BIGINT AS user_id, 'kind ' || hash(k, 1) % 20 AS event_type, (hash(k, 2) % 50000 + 1) / 100 AS value FROM range(4000) x(k)) TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    assert rows(plans.QUERIES["pool_matched"](spark, str(tmp_path)).toPandas()) == rows(con.sql(plans.ORACLES["pool_matched"]).df())
