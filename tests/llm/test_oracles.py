"""The SQL of the queries that have one, on the tables of one scale."""

import duckdb
import pytest

from lacuna.llm import queries
from tests.test_queries import plain


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    df = queries.QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    assert sorted([plain(r[c]) for c in names] for r in df.collect()) == sorted([plain(x) for x in r] for r in cur.fetchall())
