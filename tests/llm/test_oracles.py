"""Queries against their SQL in DuckDB on a small table."""

import duckdb
import pytest

from inkveil.llm import entries

DATA = "/root/testdata/sf0.001"


def _norm(v):
    return str(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(entries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    df = entries.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rel = con.execute(entries.ORACLE_SQL[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == cols
    assert sorted([_norm(r[c]) for c in cols] for r in df.collect()) == sorted([_norm(r[names.index(c)]) for c in cols] for r in rel.fetchall())


def test_every_operator_has_a_query():
    assert {f"op{k}" for k in range(1, 11)} == {n.split("_")[0] for n in entries.QUERIES if n.startswith("op")}
