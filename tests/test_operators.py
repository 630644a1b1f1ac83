"""Literal rows for single operators, bounds and no-look-ahead checks, sources and streams on small files."""

from __future__ import annotations

import io
import math
import zipfile
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as X
from tidemark.functions.plugins import Features, Labels
from tidemark.operators import joins as J
from tidemark.operators import labels as L
from tidemark.operators import ledgers as G
from tidemark.operators import ranking as K
from tidemark.operators import rules as R
from tidemark.operators import spacing
from tidemark.operators import statistics as S
from tidemark.operators import windows as W
from tidemark.operators.expanding import expanding_quantile
from tidemark.sources import store

T0 = datetime(2024, 1, 1)


def values(df, *columns):
    return [tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()]


@pytest.fixture(scope="module")
def walk(spark):
    rng = np.random.default_rng(9)
    rows = []
    for symbol in ("A", "B"):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 320)))
        rows += [(symbol, T0 + timedelta(hours=i), float(c), float(c * 1.01), float(c * 0.99), float(c), 10.0 + i % 7, float((-1) ** i), 5) for i, c in enumerate(close)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double, flow double, n long").cache()


def test_z_and_lift(spark):
    df = spark.createDataFrame([(0.6, 100, 0.4, 100), (0.9, 2, 0.1, 2), (0.5, 50, 0.5, 50)], "a double, n int, b double, m int")
    z = values(df.select(S.two_prop_z(F.col("a"), F.col("n"), F.col("b"), F.col("m")).alias("z")), "z")
    assert z[0] > 2 and z[1:] == [0.0, 0.0]
    lifts = values(spark.createDataFrame([(0.3, 0.2), (0.3, 0.0), (0.0, 0.0)], "g double, b double").select(S.lift(F.col("g"), F.col("b")).alias("l")), "l")
    assert lifts[0] == pytest.approx(0.5) and lifts[1] == math.inf and lifts[2] == 0


def test_clause_calendar_and_missing(spark):
    df = spark.createDataFrame([(0.1, 0.2), (0.5, 0.6), (0.9, 0.8), (None, 0.1)], "a double, b double")
    assert values(df.select(R.clause("a >= 0.4 AND b <= 0.7").alias("m")), "m") == [False, True, False, False]
    assert values(df.select(R.rules(df, [{"feature": "zz", "operator": ">", "value": 0}]).alias("m")), "m") == [False] * 4
    times = spark.createDataFrame([(datetime(2024, 6, 1),), (datetime(2025, 6, 1),), (datetime(2025, 1, 1),)], "ts timestamp")
    assert values(times.select(R.calendar_mask(F.col("ts"), "2024-01-01,2025-01-01").alias("m")), "m") == [True, False, False]


def test_drop_inf_keeps_nulls(spark):
    df = spark.createDataFrame([(1.0, 1.0, 0), (math.inf, 1.0, 1), (1.0, -math.inf, 2), (None, 2.0, 3)], "f1 double, f2 double, y int")
    assert values(R.drop_inf(df, ["f1", "f2"]), "y") == [0, 3]


def test_router_tiers_and_near(spark):
    rows = [(0.5, math.log1p(0.1), math.log1p(1.0), math.log1p(5)), (0.55, math.log1p(1.2), math.log1p(0.8), math.log1p(5)), (0.95, math.log1p(3.0), math.log1p(1.0), math.log1p(20))]
    df = spark.createDataFrame(rows, "pred_dir_prob double, pred_mfe_atr double, pred_mae_atr double, pred_t_to_mfe double")
    cfg = {"mfe_min": 0.5, "eff_min": 1.0, "trend_conf": 0.6, "trend_mfe": 2.0, "trend_ttm": 10.0, "mean_eff": 1.2, "mean_ttm": 12.0}
    code = df.select(R.router3(df, cfg).alias("c"))
    assert values(code, "c") == [0, 1, 2] and values(code.select(R.mean_only(F.col("c")).alias("c")), "c") == [0, 1, 0]
    tiers = spark.createDataFrame([(0.5,), (1.2,), (1.9,), (2.5,)], "s double").select(R.tier(F.col("s"), [(1, 2.0), (2, 1.5), (999, 1.0)]).alias("m"))
    assert values(tiers, "m") == [2.0, 1.5, 1.5, 1.0]
    level = spark.createDataFrame([(100.0, 2.0, 0.01)], "c double, a double, d double")
    assert values(level.select(*(R.near_sr(F.col("d"), F.col("c"), F.col("a"), m).alias(f"m{i}") for i, m in enumerate((1.0, 0.1)))), "m0", "m1") == [(True, False)]


def test_shift_does_not_cross_symbols(spark):
    df = spark.createDataFrame([(s, T0 + timedelta(hours=i), v) for s, vs in (("A", (1.0, 2.0, 3.0)), ("B", (10.0, 20.0, 30.0))) for i, v in enumerate(vs)], "symbol string, ts timestamp, rr double")
    got = df.withColumn("t", L.shift_target("rr", 2)).orderBy("symbol", "ts")
    assert values(got, "t") == [3.0, None, None, 30.0, None, None]


def test_segment_drawdown_is_additive(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.02), (3, -0.05), (4, 0.01)], "k int, x double").withColumn("g", F.lit(1))
    assert G.equity(df, "x", ["g"], ["k"]).agg(F.min("drawdown")).first()[0] == pytest.approx(-0.05)


def test_budget_and_positions(spark):
    df = spark.createDataFrame([("BTC", "TREND", True, 2.0), ("ETH", "TREND", True, 1.0), ("SOL", "MEAN", True, 1.0), ("X", "MEAN", False, 9.0)], "symbol string, mode string, gated boolean, score double")
    got = dict(values(G.budget_split(df, {"TREND": 0.7, "MEAN": 0.3}), "symbol", "weight"))
    assert sum(got.values()) == pytest.approx(1) and got["BTC"] > got["ETH"] and got["SOL"] > 0 and "X" not in got
    before = spark.createDataFrame([("BTCUSDT", "0.01")], "symbol string, amount string")
    now = spark.createDataFrame([("BTCUSDT", "0.01"), ("ETHUSDT", "-1.5"), ("SOLUSDT", "0"), ("Q", "x")], "symbol string, amount string")
    assert values(J.new_positions(before, now), "key") == ["ETHUSDT:short"]
    changes = spark.createDataFrame([(10250.0,), (9650.0,)], "e double").select(G.equity_change(F.col("e"), F.lit(10000.0), 0.03).alias("c"))
    assert values(changes, "c")[0] is None and values(changes.where("c is not null").select(X.percent(F.col("c")).alias("p")), "p") == ["-3.50%"]


def test_scalars(spark):
    df = spark.createDataFrame([("  Fast-Scalp v2 ", 1776649356869, "0.3"), ("Abc", 1711843200000000, "x"), ("btcusdt", 1704067200000, None)], "s string, t long, c string")
    got = df.select(X.slug(F.col("s")).alias("slug"), X.epoch(F.col("t")).alias("at"), X.clamp01(F.col("c")).alias("c"), X.normalize_symbol(F.col("s")).alias("sym"), X.align_floor(F.col("t"), 300000).alias("f"), X.align_ceil(F.col("t"), 300000).alias("z"))
    rows = got.collect()
    assert [r.slug for r in rows] == ["fast_scalp_v2", "abc", "btcusdt"] and [r.c for r in rows] == [0.3, 0.0, 0.0]
    assert rows[1]["at"] == datetime(2024, 3, 31) and rows[2]["at"] == datetime(2024, 1, 1) and rows[2].sym == "BTCUSDT"
    assert rows[0].f < 1776649356869 < rows[0].z and rows[0].f % 300000 == rows[0].z % 300000 == 0


def test_gate_order_and_entry_filters(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1), (-1.0, 1.0, 1), (1.0, -1.0, -1), (-1.0, -1.0, -1)], "a double, b double, side int")
    rules = [{"id": "soft", "phase": "guardrail", "priority": 0, "when": {"a": {"value_lt": 0}}}, {"id": "hard", "phase": "hard_gate", "priority": 5, "when": {"b": {"value_lt": 0}}}]
    assert values(df.select(R.gate(df, rules).alias("g")), "g") == [None, "soft", "hard", "hard"]
    long_only = [{"conditions": [{"feature": "a", "operator": ">", "value": 0}], "direction": "long"}]
    assert values(df.select(R.entry_filters(df, long_only, "and", F.col("side")).alias("p")), "p") == [True, False, True, True]
    assert values(df.select(R.entry_filters(df, [], "or").alias("p")), "p") == [True] * 4


def test_spectrum_and_packets_stay_in_bounds(walk):
    got = W.haar_energy(W.spectrum(walk))
    for c in ("spectrum_flatness", "spectrum_high_share", "spectrum_entropy", "wpt_low", "wpt_mid", "wpt_high"):
        low, high, n = got.agg(F.min(c), F.max(c), F.count(c)).first()
        assert n > 300 and -1e-9 <= low <= high <= 1 + 1e-9
    total = got.where("wpt_low is not null").agg(F.min(F.col("wpt_low") + F.col("wpt_mid") + F.col("wpt_high")), F.max(F.col("wpt_low") + F.col("wpt_mid") + F.col("wpt_high"))).first()
    assert total[0] == pytest.approx(1) and total[1] == pytest.approx(1)


def test_spectrum_equals_numpy(walk):
    close = np.array(values(walk.where("symbol = 'A'").orderBy("ts"), "close"))
    r = np.concatenate(([0.0], np.diff(np.log(close))))[-64:]
    power = np.abs(np.fft.rfft(r))[1:33] ** 2 + 1e-18
    got = W.spectrum(walk).where("symbol = 'A'").orderBy(F.desc("ts")).first()
    share = power / power.sum()
    assert got.spectrum_flatness == pytest.approx(np.exp(np.log(power).mean()) / power.mean(), rel=1e-6)
    assert got.spectrum_entropy == pytest.approx(-(share * np.log(share)).sum() / math.log(32), rel=1e-6)


def test_ema_over_many_blocks(walk):
    import pandas as pd

    close = values(walk.where("symbol = 'B'").orderBy("ts"), "close")
    want = pd.Series(close).ewm(span=20, adjust=False).mean().tolist()
    got = values(W.ema(walk, "close", W.span(20), "e", block=32).where("symbol = 'B'").orderBy("ts"), "e")
    assert got == pytest.approx(want, rel=1e-10)


def test_features_do_not_look_ahead(walk):
    build = lambda df: W.swing_levels(W.rsi(W.ema_position(expanding_quantile(W.box(df, 20), "close", 0.8), 50)))
    columns = ["rsi", "ema_position", "threshold", "box_pos", "swing_high"]
    whole, cut = build(walk).select("symbol", "ts", *columns), build(walk.where(F.col("ts") < T0 + timedelta(hours=200))).select("symbol", "ts", *(F.col(c).alias(f"_{c}") for c in columns))
    both = cut.join(whole, ["symbol", "ts"])
    assert both.count() == 400
    assert both.where(" or ".join(f"not (abs({c} - _{c}) < 1e-9 or ({c} is null and _{c} is null))" for c in columns)).count() == 0


def test_rr_outcome_equals_a_loop(walk):
    h, stop, target, trail, breakeven, cost = 20, 1.0, 2.0, 1.0, 1.0, 10.0
    df = W.atr(walk)
    got = L.rr_outcome(df, h, stop, target, trail, breakeven, cost).where("symbol = 'A'").orderBy("ts").collect()
    bars = df.where("symbol = 'A'").orderBy("ts").collect()
    for i in range(0, len(bars), 7):
        path = bars[i + 1 : i + 1 + h]
        want = (None, None, None)
        if path:
            unit, entry = max(bars[i].atr, 1e-9), path[0].open
            level, best, reason, price, held = entry - stop * unit, entry, "", entry, 0
            for b in path:
                held += 1
                if b.low <= level:
                    reason, price = ("trail" if level >= entry else "stop"), level
                elif b.high >= entry + target * unit:
                    reason, price = "target", entry + target * unit
                else:
                    price = b.close
                if reason:
                    break
                best = max(best, b.high)
                if best - entry >= breakeven * unit:
                    level = max(level, entry, best - trail * unit)
            reason = reason or ("time" if len(path) == h else None)
            if reason:
                want = (reason, held, (price * (1 - cost / 1e4) - entry * (1 + cost / 1e4)) / (stop * unit))
        assert (got[i].exit_reason, got[i].bars_held) == want[:2]
        assert got[i].pnl_r == (pytest.approx(want[2]) if want[2] is not None else None)


def test_ladder_adds_and_greedy_spacing(spark, walk):
    assert {r[0] for r in L.ladder_adds(W.atr(walk), 20, [2.0, 4.0], [0.5, 0.25]).select("adds").distinct().collect()} <= {0, 1, 2}
    signals = spark.createDataFrame([("A", T0 + timedelta(minutes=m)) for m in (0, 10, 29, 30, 45, 61, 200)], "symbol string, ts timestamp")
    kept = sorted(int((r.ts - T0).total_seconds() // 60) for r in spacing.min_interval(signals, 30).collect())
    assert kept == [0, 30, 61, 200]


def test_is_good_needs_a_column(spark):
    df = spark.createDataFrame([(-1.0,), (0.2,), (None,)], "rr double")
    assert values(L.is_good(df), "is_good") == [0, 1, 0]
    with pytest.raises(ValueError):
        L.is_good(df.withColumnRenamed("rr", "other"))


def test_store_merges_months(spark, tmp_path):
    days = [T0 + timedelta(days=i) for i in range(3)]
    frame = lambda c, v: spark.createDataFrame([("X", d, v) for d in days], f"symbol string, ts timestamp, {c} double")
    root = str(tmp_path / "store")
    store.store_write(frame("a", 10.0), root, "core", "120T")
    store.store_write(frame("b", 20.0), root, "core", "120T")
    assert values(store.store_read(spark, root, "core", "120T", "X", "2024-01"), "a", "b") == [(10.0, 20.0)] * 3
    assert store.store_read(spark, root, "core", "120T", "X", "2023-01").count() == 0


def test_klines_in_zip_and_feature_files(spark, tmp_path):
    line = "{},1,2,0.5,1.5,10,0,0,0,0,0,0\n"
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("k.csv", line.format(1774915200000000) + line.format(1704067200000))
    (tmp_path / "k.zip").write_bytes(held.getvalue())
    got = store.scan_klines(spark, str(tmp_path / "k.zip"))
    assert sorted(values(got, "ts")) == [datetime(2024, 1, 1), datetime(2026, 3, 31)]
    import pandas as pd

    for symbol, n in (("AAA", 2), ("BBB", 1)):
        pd.DataFrame({"timestamp": range(n), "x": [1.0] * n}).to_parquet(tmp_path / f"features_{symbol}.parquet")
    assert dict(values(store.scan_feature_dir(spark, str(tmp_path)).groupBy("symbol").count(), "symbol", "count")) == {"AAA": 2, "BBB": 1}


def test_validation_and_schedules(spark):
    with pytest.raises(ValueError, match="MISSING_FEATURE"):
        store.validate_window(spark.createDataFrame([(1.0,)], "a double"), ["a", "adx_50"])
    assert values(store.parse_summary(spark.createDataFrame([], "trades int, sharpe double")), "trades", "sharpe") == [(0, 0.0)]
    assert [r.month for r in store.missing_months(spark, "2023-11", "2024-02", spark.createDataFrame([("2023-12",)], "month string")).orderBy("month").collect()] == ["2023-11", "2024-01", "2024-02"]
    months = spark.createDataFrame([(i, m) for i, m in enumerate(("2024-01", "2024-02", "2024-03", "2024-04"))], "index int, month string")
    wanted = spark.createDataFrame([(0, "2024-04"), (1, "2024-03"), (2, "2024-04")], "pos int, month string")
    assert values(K.schedule_index(months, wanted).orderBy("request"), "index", "month") == [(3, "2024-04"), (2, "2024-03")]
    with pytest.raises(ValueError):
        K.schedule_index(months, spark.createDataFrame([(0, "2030-01")], "pos int, month string"))


def test_plugins(walk):
    labels, features = Labels(), Features()
    labels.add("rr", lambda df, h: df.withColumn("rr", F.lead("close", h).over(W.order())))
    assert "rr" in walk.transform(labels.get("rr", h=3)).columns
    features.add("slow", ("atr",), ("twice",), lambda df: df.withColumn("twice", 2 * F.col("atr")))
    features.add("atr_f", ("high", "low", "close"), ("atr",), W.atr)
    assert features.order(["slow"], walk.columns) == ["atr_f", "slow"] and "twice" in features.apply(walk, ["slow"]).columns
    with pytest.raises(KeyError):
        labels.get("none")
    with pytest.raises(ValueError):
        features.order(["slow"], [c for c in walk.columns if c != "high"])


def test_nearest_level_by_halving(spark):
    from tidemark.operators.flow import nearest_gap

    cases = [([], 5.0), ([3.0], 5.0), ([3.0], 1.0), ([1.0, 4.0, 9.0], 4.0), ([1.0, 4.0, 9.0], 6.6), ([1.0, 4.0, 9.0], 100.0), ([1.0, 4.0, 9.0], -2.0), ([2.0, 2.0, 2.0], 2.5), (None, 1.0), ([1.0], None), ([float(i) for i in range(37)], 17.4)]
    df = spark.createDataFrame([(i, a, p) for i, (a, p) in enumerate(cases)], "i int, a array<double>, p double")
    got = [r.g for r in df.orderBy("i").select(nearest_gap(F.col("a"), F.col("p")).alias("g")).collect()]
    want = [min(abs(x - p) for x in a) if a and p is not None else None for a, p in cases]
    assert got == [None if w is None else pytest.approx(w) for w in want]


def test_nearest_level_looks_at_profiles_that_have_ended(spark):
    from tidemark.operators.flow import dist_to_nearest_sr

    day = lambda d, h=0: T0 + timedelta(days=d, hours=h)
    profiles = spark.createDataFrame([("a", day(0), [90.0, 110.0]), ("a", day(2), [100.0])], "symbol string, ts timestamp, levels array<double>")
    bars = spark.createDataFrame([("a", day(0, 5), 100.0), ("a", day(1), 100.0), ("a", day(2, 23), 95.0), ("a", day(3), 95.0), ("b", day(3), 95.0)], "symbol string, ts timestamp, close double")
    got = {(r.symbol, r.ts): r.dist_to_nearest_sr for r in dist_to_nearest_sr(bars, profiles).collect()}
    assert got == {("a", day(0, 5)): None, ("a", day(1)): pytest.approx(0.1), ("a", day(2, 23)): pytest.approx(5 / 95), ("a", day(3)): pytest.approx(5 / 95), ("b", day(3)): None}
