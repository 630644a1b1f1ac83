"""Every query that has SQL gives the SQL's rows; the others run."""

from __future__ import annotations

import math
from datetime import date, datetime

import duckdb
import pytest

from tidemark.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, (int, str)):
        return v
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, date):
        return v.isoformat()
    v = float(v)
    return None if math.isnan(v) else v


def key(row):
    return tuple((v is None, str(type(v)) if not isinstance(v, (int, float)) else "", round(v, 4) if isinstance(v, float) else v if isinstance(v, int) else str(v)) for v in row)


def near(a, b):
    return a == b or (isinstance(a, (int, float)) and isinstance(b, (int, float)) and abs(a - b) <= 2e-6 * max(1, abs(a)))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(([plain(v) for v in r] for r in df.select(*columns).collect()), key=key)
    if name not in ORACLES:
        assert got
        return
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted(([plain(r[i]) for i in at] for r in cursor.fetchall()), key=key)
    assert len(got) == len(want)
    wrong = [(a, b) for a, b in zip(got, want) if not all(map(near, a, b))]
    assert not wrong, wrong[:3]
