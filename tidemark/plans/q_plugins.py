"""Labels, features and grids that a user declares by name and parameters (D rows of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.plugins import Features, Labels
from tidemark.operators import labels as L
from tidemark.operators import statistics as S
from tidemark.operators import windows as W
from tidemark.plans.catalog import query
from tidemark.plans.q_features import ATR, TR, rounded, w
from tidemark.plans.q_labels import _RR, _touch
from tidemark.plans.q_rules import ROWS, rows
from tidemark.plans.views import BARS, LABELED, bars, labeled

_r = lambda s, n: f"round(CAST({s} AS DOUBLE), 6) AS {n}"

LABEL_REGISTRY = Labels()
LABEL_REGISTRY.add("first_touch", lambda df, take_profit_r, stop_loss_r, max_holding_bars: L.first_touch(df, take_profit_r, stop_loss_r, max_holding_bars).withColumn("rr_label", F.col("realized_r")))
LABEL_REGISTRY.add("forward", lambda df, max_holding_bars: df.withColumn("forward_label", L.signed_rr(max_holding_bars)))
#: What a user writes: names and parameters, and the columns that must not be null.
LABEL_CONFIG = [{"function": "first_touch", "params": {"take_profit_r": 2.0, "stop_loss_r": 1.0, "max_holding_bars": 50}}, {"function": "forward", "params": {"max_holding_bars": 20}}]


@query("D1_label_plugin", f"WITH RECURSIVE {ROWS}, {_touch(2.0, 1.0, 50, 1, 'x', 'f')} SELECT symbol, ts, {_r('rr', 'rr_label')}, {_r('fw', 'forward_label')} FROM (SELECT *, {_RR(20)} AS fw FROM x WINDOW w AS (PARTITION BY symbol ORDER BY ts)) WHERE rr IS NOT NULL AND fw IS NOT NULL")
def label_plugin(spark, sf_dir):
    df = rows(spark, sf_dir)
    for step in LABEL_CONFIG:
        df = df.transform(LABEL_REGISTRY.get(step["function"], **step["params"]))
    return rounded(df.where("rr_label is not null and forward_label is not null"), "rr_label", "forward_label")


FEATURE_REGISTRY = Features()
FEATURE_REGISTRY.add("stretch", ("atr", "mean"), ("stretch",), lambda df: df.withColumn("stretch", (F.col("close") - F.col("mean")) / F.nullif("atr", F.lit(0.0))))
FEATURE_REGISTRY.add("stretch_rank", ("stretch",), ("stretch_rank",), lambda df: W.rolling_rank(df, "stretch", 50, "stretch_rank"))
FEATURE_REGISTRY.add("mean", ("close",), ("mean",), lambda df: df.withColumn("mean", F.avg("close").over(W.over(20))))
FEATURE_REGISTRY.add("atr", ("high", "low", "close"), ("atr",), W.atr)
FEATURE_REGISTRY.add("unused", ("nothing",), ("never",), lambda df: df)


@query("D2_feature_plugin", f"WITH {BARS}, {TR}, {ATR}, s AS (SELECT *, (close - avg(close) OVER {w(20)}) / nullif(atr_v, 0) AS s FROM atr), l AS (SELECT *, list(s) OVER {w(50)} AS l FROM s) SELECT symbol, ts, {_r('s', 'stretch')}, {_r('CASE WHEN s IS NOT NULL THEN len(list_filter(l, lambda x: x <= s)) / len(list_filter(l, lambda x: x IS NOT NULL)) END', 'stretch_rank')} FROM l")
def feature_plugin(spark, sf_dir):
    """Only the nodes that the wanted one needs run, each after those it needs."""
    return rounded(FEATURE_REGISTRY.apply(bars(spark, sf_dir), ["stretch_rank"]), "stretch", "stretch_rank")


@query("D5_grid", f"WITH {LABELED}, g AS (SELECT CAST(unnest(range(500, 5001, 500)) AS DOUBLE) AS threshold), p AS (SELECT threshold, avg(CASE WHEN feature >= threshold THEN 1.0 ELSE 0.0 END) FILTER (label = 1) AS a, avg(CASE WHEN feature >= threshold THEN 1.0 ELSE 0.0 END) FILTER (label = 0) AS b FROM labeled CROSS JOIN g GROUP BY 1) SELECT threshold, {_r('a', 'pass_good')}, {_r('b', 'pass_bad')}, {_r('a - b', 'gate_score')} FROM p")
def grid(spark, sf_dir):
    """A grid given by start, end and step, laid out by one expression over every labelled row."""
    got = S.gate_plateau(labeled(spark, sf_dir), "feature", S.grid(500.0, 5000.0, 500.0), F.col("label") == 1)
    return rounded(got, "pass_good", "pass_bad", "gate_score", keys=("threshold",))
