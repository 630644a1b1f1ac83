"""Greedy spacing by pointer doubling against a plain loop."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import spacing

T0 = datetime(2024, 1, 1)


def plain(times, minutes):
    kept = []
    for t in sorted(set(times)):
        if not kept or t >= kept[-1] + timedelta(minutes=minutes):
            kept.append(t)
    return kept


@pytest.fixture(scope="module")
def signals(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), T0 + timedelta(minutes=rng.randrange(20_000)), rng.gauss(0, 1)) for _ in range(700)]
    rows += [("c", T0, 1.0), ("c", T0, 2.0), (None, T0, 3.0), ("a", None, 4.0)]
    return rows, spark.createDataFrame(rows, "symbol string, ts timestamp, value double").repartition(4).cache()


@pytest.mark.parametrize("minutes", [0, 30, 50_000])
def test_min_interval(signals, minutes):
    rows, df = signals
    got = sorted((r.symbol, r.ts) for r in spacing.min_interval(df, minutes).collect())
    assert got == sorted((s, t) for s in "abc" for t in plain([r[1] for r in rows if r[0] == s and r[1]], minutes))


def test_interval_sweep_selects_the_highest_mean(signals):
    rows, df = signals
    got = {r.minutes: (r.kept, r.mean_value, r.selected) for r in spacing.interval_sweep(df, [0, 60, 480], "value").collect()}
    worth = {}
    for s, t, v in rows:
        if s and t:
            worth.setdefault((s, t), []).append(v)
    want = {}
    for m in (0, 60, 480):
        own = [sum(worth[s, t]) / len(worth[s, t]) for s in "abc" for t in plain([r[1] for r in rows if r[0] == s and r[1]], m)]
        want[m] = (len(own), sum(own) / len(own))
    best = max(want, key=lambda m: (want[m][1], -m))
    assert got == {m: (n, pytest.approx(v), m == best) for m, (n, v) in want.items()}


def test_non_overlap_charges_the_round_trip(spark):
    rows = [("a", T0 + timedelta(hours=i), 100.0 + i) for i in range(40)]
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp, close double")
    got = sorted((r.ts, r.gross, r.net) for r in spacing.non_overlap(bars, F.col("close") >= 105, 5, 60, 8.0).collect())
    assert [t for t, *_ in got] == [T0 + timedelta(hours=h) for h in range(5, 40, 5)]
    assert got[0][1:] == (pytest.approx(5 / 105), pytest.approx(5 / 105 - 0.0008)) and got[-1][1:] == (None, None)
    assert spacing.non_overlap(bars.limit(0), F.col("close") >= 105, 5, 60, 8.0).count() == 0
