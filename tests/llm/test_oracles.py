import duckdb
import pytest

from logloom.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(oracle_sql()))
def test_sql_twin(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(str([r[x] for x in cols]) for r in df.collect())
    cur = c.execute(oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    assert got == sorted(str([r[names.index(x)] for x in cols]) for r in cur.fetchall())
