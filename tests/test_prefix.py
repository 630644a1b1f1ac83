"""Ranks, quantiles and running sums of groups against plain versions: ties, nulls, NaN, infinities, hot values."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import ledgers as G
from tidemark.operators import prefix as P
from tidemark.operators import ranking as K
from tidemark.operators import statistics as S


def plain_ranks(values):
    order = sorted(values)
    return [order.index(v) + (order.count(v) + 1) / 2 for v in values]


@pytest.fixture(scope="module")
def tied(spark):
    rng = random.Random(4)
    rows = [("a" if i % 3 else None, float(rng.randrange(12)) if i % 2 else 5.0, rng.choice([0, 1, 1]), i) for i in range(600)]
    return rows, spark.createDataFrame(rows, "g string, x double, y int, k int").repartition(5).cache()


def test_average_ranks_with_ties_and_null_groups(tied):
    rows, df = tied
    got = {r.k: r.rank for r in P.with_average_rank(df, "x", ["g"], "rank").collect()}
    for g in ("a", None):
        own = [r for r in rows if r[0] == g]
        assert [got[r[3]] for r in own] == plain_ranks([r[1] for r in own])
    assert len(got) == len(rows)


def test_lookup_sends_frequent_keys_out_and_shuffles_others(spark):
    rows = [(i if i % 3 else 0, i) for i in range(900)]
    df = spark.createDataFrame(rows, "a int, k int").cache()
    found = df.groupBy("a").agg(F.count("*").alias("n")).withColumn("twice", F.col("a") * 2)
    for most in (5, 10_000):
        assert sorted((r.k, r.twice) for r in P.lookup(df, found, ["a"], "n", most).collect()) == sorted((k, 2 * a) for a, k in rows)


def test_rank_ic_of_a_two_valued_target(tied):
    rows, df = tied
    got = {r.g: (r.ic, r.n) for r in S.rank_ic(df, "x", "y", "g").collect()}
    for g in ("a", None):
        own = [r for r in rows if r[0] == g]
        a, b = plain_ranks([r[1] for r in own]), plain_ranks([r[2] for r in own])
        assert got[g] == (pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-12), len(own))
    still = df.withColumn("y", F.lit(1))
    assert [r.ic for r in S.rank_ic(still, "x", "y").collect()] == [None]
    assert S.rank_ic(df.limit(0), "x", "y", "g").count() == 0


@pytest.mark.parametrize("small, margin", [(10_000, 4e-4), (20, 0.1)])
def test_group_quantiles(spark, monkeypatch, small, margin):
    monkeypatch.setattr(P, "SMALL", small)
    monkeypatch.setattr(P, "MARGIN", margin)
    rng = random.Random(8)
    qs = [0.0, 0.1, 0.25, 0.5, 0.9, 0.95, 1.0]
    groups = {"wide": [rng.gauss(0, 1) for _ in range(3000)], "tied": [float(rng.randrange(4)) for _ in range(2000)] + [7.0] * 1000, "one": [3.0], None: [float(i) for i in range(50)]}
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("wide", None), ("wide", math.nan), ("empty", None), ("empty", math.nan), ("ends", -math.inf), ("ends", math.inf), ("ends", 1.0), ("ends", math.nan)]
    rng.shuffle(rows)
    got = {r.g: r.q for r in P.group_quantiles(spark.createDataFrame(rows, "g string, x double").repartition(6), ["g"], "x", qs).collect()}
    for g, xs in groups.items():
        assert np.allclose(got[g], np.quantile(xs, qs), atol=1e-12), g
    assert got["empty"] == [None] * len(qs)
    assert got["ends"][0] == -math.inf and got["ends"][3] == 1.0 and got["ends"][-1] == math.inf and got["ends"][4] == math.inf
    assert P.group_quantiles(spark.createDataFrame([], "g string, x double"), ["g"], "x", qs).count() == 0


def test_quantiles_of_a_column_with_nan_and_infinity(spark):
    xs = [float(i) for i in range(10)]
    df = spark.createDataFrame([(x, x) for x in [*xs, math.nan, math.inf, None]], "x double, y double")
    assert S.exact_quantiles(df, "x", [0.5, 1.0]) == [5.0, math.inf]
    assert S.exact_quantiles(df.where("isnan(x)"), "x", [0.5]) == [None]
    assert sorted(r.x for r in K.top_quantile(df, "x", 0.1).collect()) == [9.0, math.inf]
    found = {r.q: (r.threshold, r.trades) for r in S.tau_scan(df, "x", "y", [0.0, 0.5]).collect()}
    assert found == {0.0: (0.0, 11), 0.5: (5.0, 6)}
    assert S.psi(df, df, "x", bins=4).first()["psi"] == pytest.approx(0.0)


def test_tail_contribution_of_ties(spark):
    rng = random.Random(2)
    rows = [(g, float(rng.choice([-1, 0, 1, 1, 2, 5]))) for g in ("a", "b", None) for _ in range(137)] + [("lost", -1.0)]
    got = {r.g: (r.tail_share, r.n_top, r.n_winners) for r in G.tail_contribution(spark.createDataFrame(rows, "g string, pnl_r double").repartition(4), ["g"]).collect()}
    for g in ("a", "b", None):
        won = sorted((x for h, x in rows if h == g and x > 0), reverse=True)
        k = max(1, math.ceil(len(won) * 0.1))
        assert got[g] == (pytest.approx(sum(won[:k]) / sum(won)), k, len(won))
    assert got["lost"] == (0.0, 0, 0)


@pytest.mark.parametrize("timed", [True, False])
def test_path_metrics_over_any_order(spark, timed):
    rng = random.Random(6)
    rows = [("a" if i % 4 else None, i, f"{i:05}", rng.gauss(0, 1) if i % 9 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, k int, s string, x double").withColumn("t", F.timestamp_seconds(F.col("k") * 20_000)).repartition(5)
    order = ["t", "k"] if timed else ["s"]
    got = {(r.g, r.name): r for r in G.path_metrics(df, {"plain": F.col("x"), "less": F.col("x") - 0.1}, ["g"], order).collect()}
    for g in ("a", None):
        for name, cost in (("plain", 0.0), ("less", 0.1)):
            own = [r[3] - cost for r in rows if r[0] == g and r[3] is not None]
            run = np.cumsum(own)
            r = got[g, name]
            assert r.trades == sum(row[0] == g for row in rows)
            assert (r.win_rate, r.total_r, r.mean_r, r.std_r) == pytest.approx((np.mean(np.array(own) > 0), sum(own), np.mean(own), np.std(own, ddof=1)))
            assert r.max_dd == pytest.approx(min(run - np.maximum(np.maximum.accumulate(run), 0)))
    nothing = G.path_metrics(df.withColumn("x", F.lit(None).cast("double")), {"x": F.col("x")}, ["g"], order).collect()
    assert {(r.total_r, r.mean_r, r.std_r) for r in nothing} == {(None, None, None)}
    assert G.path_metrics(df.limit(0), {"x": F.col("x")}, ["g"], order).count() == 0


def test_equity_over_a_text_order_equals_one_pass(spark):
    rng = random.Random(1)
    rows = [("a", f"{i:04}", rng.gauss(0, 1)) for i in range(300)]
    got = {r.s: (r.equity, r.peak) for r in G.equity(spark.createDataFrame(rows, "g string, s string, x double").repartition(6), "x", ["g"], ["s"]).collect()}
    run = np.cumsum([r[2] for r in rows])
    assert [got[r[1]] for r in rows] == [(pytest.approx(a), pytest.approx(b)) for a, b in zip(run, np.maximum(np.maximum.accumulate(run), 0))]


def test_psi_of_many_features_at_once(spark):
    rng = np.random.default_rng(3)
    ref, cur = rng.normal(0, 1, (500, 2)), np.column_stack([rng.normal(0.4, 1, 400), np.full(400, 9.0)])
    frame = lambda m: spark.createDataFrame([(float(a), float(b), None) for a, b in m] + [(None, math.nan, None)], "a double, b double, none double").repartition(3)
    got = {r.feature: r.psi for r in S.psi_features(frame(cur), frame(ref), ["a", "b", "none"], bins=5).collect()}
    assert set(got) == {"a", "b"}
    for k, name in enumerate("ab"):
        edges = np.quantile(ref[:, k], [0.2, 0.4, 0.6, 0.8])
        p, q = (np.maximum(np.bincount((m[:, k][:, None] > edges).sum(1), minlength=5) / len(m), 1e-6) for m in (cur, ref))
        assert got[name] == pytest.approx(((p - q) * np.log(p / q)).sum())
