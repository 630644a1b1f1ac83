"""Expanding quantiles by blocks against a percentile over every prefix."""

from __future__ import annotations

import math
import random
import time
from datetime import datetime, timedelta

import numpy as np
import pytest

from tidemark.operators import expanding as E

T0 = datetime(2024, 1, 1)


def plain(values, q, least):
    seen, out = [], []
    for x in values:
        out.append(float(np.quantile(seen, q)) if len(seen) >= max(1, least) else None)
        if x is not None and not math.isnan(x):
            seen.append(x)
    return out


@pytest.mark.parametrize("q, least", [(0.8, 50), (0.0, 1), (1.0, 3), (0.5, 0)])
def test_equals_a_percentile_of_every_prefix(spark, monkeypatch, q, least):
    monkeypatch.setattr(E, "LEAST_BLOCK", 6)
    rng = random.Random(7)
    series = {
        "walk": list(np.cumsum([rng.gauss(0, 1) for _ in range(400)])), "tied": [float(rng.choice([1, 1, 1, 2, 3])) for _ in range(300)], "falling": [float(-i) for i in range(200)],
        "odd": [rng.choice([None, math.nan, 2.0, rng.gauss(0, 5)]) for _ in range(200)], "one": [4.0], "none": [None, None], "same": [5.0] * 120,
    }
    rows = [(s, T0 + timedelta(hours=i), None if x is None else float(x), i) for s, xs in series.items() for i, x in enumerate(xs)] + [(None, T0, 1.0, 0)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, x double, i int").repartition(5)
    got = {(r.symbol, r.i): r.threshold for r in E.expanding_quantile(df, "x", q, least).collect()}
    assert len(got) == len(rows) and got[None, 0] is None
    for s, xs in series.items():
        for i, want in enumerate(plain(xs, q, least)):
            assert got[s, i] == (None if want is None else pytest.approx(want, abs=1e-9)), (s, i)
    assert E.expanding_quantile(df.limit(0), "x", q, least).count() == 0


def test_a_hundred_thousand_bars_of_one_symbol(spark):
    df = spark.range(100_000).selectExpr("'a' AS symbol", "timestamp_seconds(id) AS ts", "sin(id * 12.9898) * 43758.5453 % 1 AS x").cache()
    values = [r.x for r in df.orderBy("ts").collect()]
    start = time.perf_counter()
    got = [r.threshold for r in E.expanding_quantile(df, "x", 0.8).orderBy("ts").collect()]
    assert time.perf_counter() - start < 90
    assert got[49] is None
    for i in (50, 51, 777, 31_234, 99_999):
        assert got[i] == pytest.approx(np.quantile(values[:i], 0.8), abs=1e-12)
