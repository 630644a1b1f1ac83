"""Stateful jobs: rows in any order over several batches, late rows, and state that is carried in pieces."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.plans.views import ticks
from tidemark.streaming import jobs as T


class Value:
    """A state variable in memory."""

    def __init__(self):
        self.now = None

    def exists(self):
        return self.now is not None

    def get(self):
        return self.now

    update = put = lambda self, now: setattr(self, "now", now)

    def clear(self):
        self.now = None


class Handle:
    def __init__(self):
        self.timers = set()

    def getValueState(self, *_):
        return Value()

    getListState = getValueState

    def listTimers(self):
        return set(self.timers)

    def registerTimer(self, ms):
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.discard(ms)


class Timers:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def run(processor, batches, key=("a",)):
    """The processor's rows for batches of (watermark in ms, rows), in memory."""
    handle = Handle()
    processor.init(handle)
    out = []
    for mark, rows in batches:
        frames = [pd.DataFrame(rows, columns=["us", "tick_id", "price"])] if rows else []
        out += processor.handleInputRows(key, iter(frames), Timers(mark)) if frames else processor.handleExpiredTimer(key, Timers(mark), None)
        assert not handle.timers or min(handle.timers) >= mark
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame()


def disordered(rng, n=400):
    prices = [float(rng.choice([5, 15, 30, 50, 70])) for _ in range(n)]
    rows = [(1000 * (i // 2), i, p) for i, p in enumerate(prices)]  # two ticks a millisecond
    late = sorted(rows, key=lambda r: r[0] + rng.randrange(20_000))
    batches, seen = [], 0
    for k in range(0, n, 57):
        batches.append((seen // 1000 - 20, late[k : k + 57]))
        seen = max(seen, *(r[0] for r in late[k : k + 57]))
    return rows, [*batches, (10**9, [])]


@pytest.mark.parametrize("seed", range(4))
def test_rolling_features_in_pieces_equal_one_series(seed):
    rows, batches = disordered(random.Random(seed))
    got = run(T.RollingFeatures(0.2, 7), batches)
    prices = pd.Series([p for *_, p in rows])
    assert got["tick_id"].tolist() == list(range(len(rows)))
    assert np.allclose(got["ema"], prices.ewm(alpha=0.2, adjust=False).mean())
    assert np.allclose(got["mean"], prices.rolling(7, min_periods=1).mean()) and np.allclose(got["deviation"], prices.rolling(7, min_periods=1).std(ddof=0), atol=1e-6)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("least, most", [(0, None), (3, None), (2, 4), (0, 1)])
def test_sessions_in_pieces_equal_a_loop(seed, least, most):
    rows, batches = disordered(random.Random(seed))
    want, start, n, cut = [], None, 0, False
    for us, _, p in rows:
        if start is None and p >= 60:
            start, n, cut = us, 0, False
        if start is not None:
            if p < 20:
                if not cut and n >= least:
                    want.append(("a", start, us, n))
                start = None
            elif not cut and n == most:
                want.append(("a", start, us, n))
                cut = True
            else:
                n += 1
    assert [tuple(r) for r in run(T.Sessions(60.0, 20.0, least, most), batches).itertuples(index=False)] == want


def test_nothing_passes_before_the_watermark():
    assert len(run(T.RollingFeatures(0.5, 3), [(0, [(5000, 1, 1.0), (9000, 2, 2.0)]), (4, [])])) == 0
    assert run(T.RollingFeatures(0.5, 3), [(0, [(9000, 2, 2.0), (5000, 1, 1.0)]), (5, [])])["tick_id"].tolist() == [1]


def test_late_rows_go_to_a_table_of_their_own(spark, sf_dir):
    delay = F.when(F.col("event_id") % 3 == 0, 5 * 86_400).otherwise(0)
    in_time, late = T.split_late(T.tick_stream(spark, T.staged_files(spark, sf_dir, delay, files=4), files=1), "late-test")
    every = in_time.select("tick_id").union(late.select("tick_id"))
    assert every.count() == every.distinct().count() == ticks(spark, sf_dir).count()
    assert late.count() > 0 and late.where("tick_id % 3 <> 0").count() == 0
    assert in_time.columns == late.columns == ["symbol", "ts", "tick_id", "price", "qty"]


def test_backfill_holds_the_close_over_gaps(spark):
    bars = spark.createDataFrame([("a", 0, 1.0), ("a", 4, 2.0), ("a", 10, 3.0), ("b", 2, 9.0)], "symbol string, h int, close double").selectExpr("symbol", "timestamp_seconds(h * 3600) AS ts", "close", "5.0D AS volume")
    got = sorted((r.symbol, r.ts.hour, r.close, r.volume) for r in T.backfill(bars).collect())
    assert got == [("a", 0, 1.0, 5.0), ("a", 2, 1.0, 0.0), ("a", 4, 2.0, 5.0), ("a", 6, 2.0, 0.0), ("a", 8, 2.0, 0.0), ("a", 10, 3.0, 5.0), ("b", 2, 9.0, 5.0)]


def test_late_ticks_mend_their_bars_alone(spark):
    rows = [("a", 0, 1, 10.0), ("a", 1, 2, 12.0), ("a", 8, 3, 20.0), ("b", 0, 4, 5.0)]
    late = [("a", 1, 5, 9.0), ("c", 3, 6, 7.0)]
    frame = lambda r: spark.createDataFrame(r, "symbol string, h int, tick_id long, price double").selectExpr("symbol", "timestamp_seconds(h * 3600 + tick_id) AS ts", "tick_id", "price", "1.0D AS qty")
    bars = T.tumbling_bars(frame(rows)).withColumn("volume", F.col("volume") + F.when(F.col("symbol") == "b", 100.0).otherwise(0.0))  # b's bar must stay as it is
    got = sorted((r.symbol, r.ts.hour, r.open, r.low, r.close, r.volume, r.n) for r in T.repaired_bars(bars, frame(rows), frame(late)).collect())
    assert got == [("a", 0, 10.0, 9.0, 9.0, 3.0, 3), ("a", 8, 20.0, 20.0, 20.0, 1.0, 1), ("b", 0, 5.0, 5.0, 5.0, 101.0, 1), ("c", 2, 7.0, 7.0, 7.0, 1.0, 1)]


def test_a_span_that_comes_in_many_files_is_one_batch(spark, sf_dir, tmp_path, monkeypatch):
    events = spark.read.schema(T.EVENTS).parquet(f"{sf_dir}/events.parquet")
    events.repartition(5, "event_id").write.parquet(f"{tmp_path}/events.parquet")
    delay = F.pmod(F.col("event_id") * 7919, F.lit(86_400))
    assert len(spark.read.parquet(f"{T.staged_files(spark, str(tmp_path), delay, files=3)}/events.parquet").inputFiles()) == 3
    monkeypatch.setattr(T, "STAGED", events.count() // 12 + 1)  # four files a span
    late = "1 day"
    got = T.run_to_table(T.with_state(T.staged_stream(spark, str(tmp_path), delay, files=3), T.RollingFeatures(0.1, 20), "symbol string, tick_id long, ema double, mean double, deviation double", late), "spans")
    due = ticks(spark, sf_dir).where(F.col("ts") <= events.agg(F.max("ts")).first()[0] - F.expr(f"interval {late}"))
    assert sorted(r.tick_id for r in got.collect()) == sorted(r.tick_id for r in due.collect())


def test_ticks_are_held_packed():
    rows = [(1000 * i, i, float(i)) for i in range(5000)]
    processor = T.RollingFeatures(0.1, 5)
    got = run(processor, [(0, rows[2500:]), (1, rows[2:2500])])
    assert got.empty and len(list(processor.held.get())) == 1
    shifted = [(1, i) for i in range(2)]  # later than the watermark: dropped
    out = list(processor.handleInputRows(("a",), iter([pd.DataFrame([(us, i, 0.0) for us, i in shifted], columns=["us", "tick_id", "price"])]), Timers(10**6)))
    assert pd.concat(out)["tick_id"].tolist() == list(range(2, 5000)) and not processor.held.exists()
