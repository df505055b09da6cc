"""The text operators' queries with SQL, side by side with DuckDB."""

import pytest

from sylvan.llm.queries import ORACLES, QUERIES

duckdb = pytest.importorskip("duckdb")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    df = QUERIES[name](spark, data)
    res = con.execute(ORACLES[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(map(str, res.fetchall()))
