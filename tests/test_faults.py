"""Cases that once went wrong: merged months, streams over folders, nulls in averages and keys, quantiles over ties."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import joins as J
from tidemark.operators import labels as L
from tidemark.operators import ledgers as G
from tidemark.operators import rules as R
from tidemark.operators import statistics as S
from tidemark.operators import windows as W
from tidemark.sources import store
from tidemark.streaming import jobs as T

T0 = datetime(2024, 1, 1)


def test_merging_a_column_keeps_all_others(spark, tmp_path):
    def month(m: int, column: str, value: float):
        return spark.createDataFrame([("A", datetime(2024, m, d), value + d) for d in (1, 2)], f"symbol string, ts timestamp, {column} double")

    root = str(tmp_path)
    store.store_write(month(1, "a", 10.0), root, "L", "1D")
    store.store_write(month(2, "b", 20.0), root, "L", "1D")
    store.store_write(month(1, "c", 30.0).unionByName(month(2, "c", 40.0)), root, "L", "1D")
    jan = [r.asDict() for r in store.store_read(spark, root, "L", "1D", "A", "2024-01").orderBy("ts").collect()]
    feb = [r.asDict() for r in store.store_read(spark, root, "L", "1D", "A", "2024-02").orderBy("ts").collect()]
    assert [(r["a"], r["b"], r["c"]) for r in jan] == [(11.0, None, 31.0), (12.0, None, 32.0)]
    assert [(r["a"], r["b"], r["c"]) for r in feb] == [(None, 21.0, 41.0), (None, 22.0, 42.0)]


def test_streams_read_folders_in_several_batches(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(5).write.parquet(f"{tmp_path}/events.parquet")
    whole = sorted(map(tuple, T.run_to_table(T.tick_stream(spark, sf_dir), "one").collect()))
    parts = T.run_to_table(T.tick_stream(spark, str(tmp_path), files=2), "many")
    assert len(whole) == events.count() and sorted(map(tuple, parts.collect())) == whole


@pytest.mark.parametrize("alpha", [0.5, 0.05, 0.97, 1.0])
def test_average_holds_over_nulls(spark, alpha):
    rng = np.random.default_rng(2)
    xs = [None, 1.0, 2.0, None, 4.0, 5.0, None, None] + [None if rng.random() < 0.2 else float(rng.normal()) for _ in range(900)]
    df = spark.createDataFrame([("s", T0 + timedelta(hours=i), x) for i, x in enumerate(xs)], "symbol string, ts timestamp, x double")
    got = [r.y for r in W.ema(df, "x", alpha, "y").orderBy("ts").collect()]
    y, want = None, []
    for x in xs:
        y = y if x is None else x if y is None else alpha * x + (1 - alpha) * y
        want.append(y)
    assert got[0] is None and np.allclose(got[1:], want[1:], atol=1e-9)


def test_groups_with_a_null_key_stay(spark):
    rows = [(k, float(i), float((i * 7) % 11)) for k in ("a", None) for i in range(30)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    got = {r.k: (round(r.ic, 9), r.n) for r in S.rank_ic(df, "x", "y", "k").collect()}
    assert set(got) == {"a", None} and got["a"] == got[None]
    trades = spark.createDataFrame([(k, i, float(i % 5 - 2), "r") for k in ("a", None) for i in range(20)], "symbol string, t int, pnl_r double, exit_reason string")
    assert {r.symbol for r in G.asset_stats(trades, ["symbol"], ["t"]).collect()} == {"a", None}
    tail = {r.symbol: (r.tail_share, r.n_winners) for r in G.tail_contribution(trades, ["symbol"]).collect()}
    assert tail["a"] == tail[None] and tail["a"][1] > 0


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=3000), np.full(2000, 0.25), rng.integers(0, 5, 500).astype(float)])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double").repartition(4)
    qs = [0.0, 0.1, 0.5, 0.777, 0.95, 1.0]
    assert np.allclose(S.exact_quantiles(df, "x", qs), np.quantile(x, qs), atol=1e-12)
    assert S.exact_quantiles(df.where("x is null"), "x", [0.5]) == [None]


def test_chop_columns_and_symbol_lists(spark):
    assert R.chop_column("raw") == "semantic_chop" and R.chop_column("ts_quantile") == "semantic_chop_ts_q"
    with pytest.raises(ValueError):
        R.chop_column("other")
    df = spark.createDataFrame([(" btc ",), ("ETH",), ("SOL",)], "symbol string")
    pick = lambda *a: [r.symbol.strip() for r in df.where(R.symbol_filter(*a)).collect()]
    assert pick("BTC, eth") == ["btc", "ETH"] and pick("__ALL__", ["sol"]) == ["btc", "ETH"] and pick([]) == ["btc", "ETH", "SOL"]


def test_result_documents_with_all_their_levels(spark, tmp_path):
    whole = {
        "cv": {"Sharpe_mean": -0.4},
        "backtest": {"sharpe": 0.75, "total_return_pct": 3.5, "max_drawdown_pct": -12.25, "total_trades": 7, "diagnostics": {"entries_exits": {"stopped": 3, "aimed": 4}}},
        "diagnostics": {"labels": {"value_counts": {"up": 11, "down": 9, "flat": 2}}, "predictions": {"p10": 0.08, "p90": 0.91}},
    }
    bare = {"backtest": {"sharpe": -1.5, "total_trades": 0}}
    for name, document in (("rising", whole), ("idle", bare)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "results.json").write_text(json.dumps(document, indent=2))
    got = {r.strategy: r for r in store.summarize_results(spark, f"{tmp_path}/*/results.json", whole_files=True).collect()}
    r = got["rising"]
    assert (r.cv_score, r.sharpe, r.total_return_pct, r.max_drawdown_pct, r.total_trades) == (-0.4, 0.75, 3.5, -12.25, 7)
    assert r.entries_exits == {"stopped": "3", "aimed": "4"} and json.loads(r.label_summary["value_counts"]) == {"up": 11, "down": 9, "flat": 2} and r.pred_summary == {"p10": "0.08", "p90": "0.91"}
    r = got["idle"]
    assert (r.cv_score, r.sharpe, r.total_return_pct, r.max_drawdown_pct, r.total_trades) == (None, -1.5, None, None, 0)
    assert not r.entries_exits and not r.label_summary and not r.pred_summary


def test_labels_need_a_column_to_come_from(spark):
    df = spark.createDataFrame([(1.0, None, 1), (-2.0, 0.5, 1), (None, 0.1, 0)], "return_atr double, rr double, other int")
    assert [r.is_good for r in L.is_good(df).collect()] == [0, 1, 1]  # rr comes before return_atr
    assert [r.is_good for r in L.is_good(df, rr_column="return_atr").collect()] == [1, 0, 0]
    kept = df.withColumn("is_good", F.lit(7))
    assert [r.is_good for r in L.is_good(kept).collect()] == [7, 7, 7]
    for bad in (df.select("other"), kept.select("is_good")):
        with pytest.raises(ValueError):
            L.is_good(bad)


def test_summary_of_nothing_is_zero(spark):
    from tidemark.sources.store import parse_summary

    empty = spark.createDataFrame([], "trades long, sharpe double")
    assert tuple(parse_summary(empty).first()) == (0, 0.0)


def test_asof_carries_over_empty_slots(spark):
    rng = random.Random(3)
    at = lambda k: T0 + timedelta(minutes=k)
    left = [(rng.choice("ab"), at(rng.randrange(20000)), k) for k in range(300)] + [("a", None, 900), (None, at(5000), 901), ("c", at(1), 902)]
    right = [(rng.choice("ab"), at(rng.randrange(20000)), float(k)) for k in range(40)] + [(None, at(1), -1.0), ("a", None, -2.0)]
    want = {}
    for key, t, k in left:
        known = [(u, v) for other, u, v in right if None not in (key, t, u) and other == key and u <= t]
        want[k] = max(known)[1] if known else None
    l, r = spark.createDataFrame(left, "g string, ts timestamp, k int"), spark.createDataFrame(right, "g string, ts timestamp, v double")
    assert {x.k: x.v for x in J.asof_join(l, r, "g", "ts", ["v"]).collect()} == want


def test_equity_over_days_equals_one_pass(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", None]), T0 + timedelta(hours=rng.randrange(200)), k, None if rng.random() < 0.1 else rng.uniform(-1, 1)) for k in range(250)]
    got = {x.k: (x.equity, x.peak, x.drawdown) for x in G.equity(spark.createDataFrame(rows, "g string, t timestamp, k int, x double"), "x", ["g"], ["t", "k"]).collect()}
    assert len(got) == 250
    for group in ("a", None):
        total, peak = None, 0.0
        for _, t, k, x in sorted((r for r in rows if r[0] == group), key=lambda r: r[1:3]):
            total = total if x is None else (total or 0.0) + x
            peak = max(peak, total or 0.0)
            assert got[k] == (pytest.approx(total), pytest.approx(peak), None if total is None else pytest.approx(total - peak, abs=1e-9))


def test_halt_day_keeps_a_row_a_time(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), T0 + timedelta(hours=6 * rng.randrange(60)), k, None if rng.random() < 0.1 else rng.uniform(-1.2, 1)) for k in range(900)]
    held = []
    monkeypatch.setattr(G, "cut", lambda df, cut=G.cut: held.append(cut(df)) or held[-1])
    df = spark.createDataFrame(rows, "g string, exit_time timestamp, k int, pnl_r double")
    for limit in (3.0, 8.0, 1e9):
        got = {r.g: (r.halt, r.kept, r.rejected) for r in G.halt_day(df, ["g"], ["exit_time", "k"], limit).collect()}
        for group in ("a", "b", None):
            total, peak, halt = 0.0, 0.0, None
            own = sorted((r for r in rows if r[0] == group), key=lambda r: r[1:3])
            for _, t, _, x in own:
                total += x or 0.0
                peak = max(peak, total)
                halt = halt or (t if total - peak <= -limit else None)
            kept = sum(halt is None or t <= halt for _, t, _, _ in own)
            assert got[group] == (halt, kept, len(own) - kept)
    assert all(h.count() == len({r[:2] for r in rows}) for h in held) and held
