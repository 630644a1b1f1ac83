"""Queries of the corpus operators that have SQL give the SQL's rows."""

from __future__ import annotations

import duckdb
import pytest

from tests.test_queries import TABLES, key, near, plain
from tidemark.llm.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(name, spark, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    got = sorted(([plain(v) for v in r] for r in df.select(*columns).collect()), key=key)
    want = sorted(([plain(r[names.index(c)]) for c in columns] for r in cursor.fetchall()), key=key)
    assert len(got) == len(want) > 0
    assert all(near(a, b) for x, y in zip(got, want) for a, b in zip(x, y))
