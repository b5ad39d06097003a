"""Every registered query of the engine runs; those with SQL give what DuckDB gives on the same tables."""

import math
import os

import duckdb
import pytest

from logloom.plans.oracle import oracle_sql
from logloom.plans.queries import queries

SF = os.environ.get("QUERY_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("events", "documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _plain(v):
    return round(v, 5) + 0.0 if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, duck, name):
    df = queries()[name](spark, SF)
    got = sorted(str([_plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    if name in oracle_sql():
        cur = duck.execute(oracle_sql()[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == sorted(df.columns)
        at = [names.index(c) for c in sorted(names)]
        want = sorted(str([_plain(r[i]) for i in at]) for r in cur.fetchall())
        assert got == want
    assert df.columns
