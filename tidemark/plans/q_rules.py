"""Predicates and rule layers (P rows of the inventory) over feature rows of two-hour bars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import rules as R
from tidemark.operators import windows as W
from tidemark.operators.prefix import group_quantiles
from tidemark.plans.catalog import query
from tidemark.plans.q_features import ATR, MOVE, TR, cte, ema_cte, w
from tidemark.plans.views import BARS, LABELED, bars, labeled
from tidemark.session import table


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with position (close to its average of 20 bars), roc, atr, box position, volume ratio and a regime."""
    b = W.volume_ratio(W.box(W.roc(W.atr(W.ema(bars(spark, sf_dir), "close", W.span(20), "ema")), 5), 20))
    b = b.withColumn("position", (F.col("close") - F.col("ema")) / F.col("close"))
    return b.withColumn("regime", F.when(F.col("position") > 0.2, "up").when(F.col("position") < -0.2, "down").otherwise("flat"))


ROWS = f"""{BARS}, {TR}, {ATR}, {ema_cte("e", "close", W.span(20), "atr")},
  fx AS (SELECT *, atr_v AS atr, e_v AS ema, close / lag(close, 5) OVER w - 1 AS roc, max(high) OVER {w(20)} AS hi, min(low) OVER {w(20)} AS lo,
    volume / nullif(avg(volume) OVER {w(20)}, 0) AS volume_ratio, (close - e_v) / close AS position FROM e WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
  f AS (SELECT *, (close - lo) / nullif(hi - lo, 0) AS box_pos, CASE WHEN position > 0.2 THEN 'up' WHEN position < -0.2 THEN 'down' ELSE 'flat' END AS regime FROM fx)"""


def on_rows(name: str, sql: dict[str, str], *, where: str = "", more: list[str] | None = None, source: str = "f"):
    """Registers columns over feature rows: a function of the frame gives the Columns by name."""
    select = ", ".join(f"{s} AS {c}" for c, s in sql.items())
    text = f"WITH RECURSIVE {', '.join([ROWS, *(more or [])])} SELECT symbol, ts, {select} FROM {source} {where} WINDOW w AS (PARTITION BY symbol ORDER BY ts)"

    def register(build: Callable[[DataFrame], dict[str, Column]]):
        query(name, text)(lambda spark, sf_dir: (lambda df: df.select("symbol", "ts", *(c.alias(n) for n, c in build(df).items())))(rows(spark, sf_dir)))
        return build

    return register


def rule(feature: str, operator: str, value: float, **more) -> dict:
    return {"feature": feature, "operator": operator, "value": value, **more}


UP, DEEP, LOUD = rule("position", ">=", 0.1), rule("box_pos", "<=", 0.7), rule("volume_ratio", ">", 1.0)
_c = lambda s: f"coalesce({s}, false)"

on_rows("P01_clause", {"mask": _c("position >= 0.1 AND abs(roc) > 0.10")})(lambda df: {"mask": R.clause("position >= 0.1 AND abs(roc) > 0.10")})
on_rows("P02_calendar_mask", {"mask": "ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'"})(lambda df: {"mask": R.calendar_mask(F.col("ts"), "2024-01-05,2024-01-20")})
on_rows("P03_rule_all_any", {"passed": f"{_c('position >= 0.1')} AND ({_c('box_pos <= 0.7')} OR {_c('volume_ratio > 1.0')})"})(lambda df: {"passed": R.rules(df, [UP, {"any_of": [DEEP, LOUD]}])})
on_rows("P04_missing_rejects", {"passed": "false"})(lambda df: {"passed": R.rules(df, [UP, rule("no_such_feature", ">", 0)])})
on_rows("P05_recent_window", {"passed": f"bool_or({_c('position >= 0.1')}) OVER {w(3)}"})(lambda df: {"passed": R.recent(R.rules(df, [UP]), 3)})
GATES = [
    {"id": "late", "phase": "guardrail", "priority": 1, "when": {"box_pos": {"value_gt": 0.95}}},
    {"id": "thin", "phase": "hard_gate", "priority": 2, "when": {"volume_ratio": {"value_lt": 0.5}}},
    {"id": "wild", "phase": "hard_gate", "priority": 1, "when": {"all_of": [{"roc": {"value_gt": 2.0}}, {"position": {"value_gte": 0.3}}]}},
    {"id": "stale", "phase": "system_safety", "priority": 9, "when": {"n": {"value_lte": 1}}},
]
_GATE = "CASE WHEN n <= 1 THEN 'stale' WHEN roc > 2.0 AND position >= 0.3 THEN 'wild' WHEN volume_ratio < 0.5 THEN 'thin' WHEN box_pos > 0.95 THEN 'late' END"
on_rows("P06_gate", {"rule_id": _GATE, "allowed": f"{_GATE} IS NULL"})(lambda df: {"rule_id": R.gate(df, GATES), "allowed": R.gate(df, GATES).isNull()})
on_rows("P07_gate_regime_allow", {"rule_id": "CASE WHEN volume_ratio < 0.8 AND regime IN ('up', 'flat') THEN 'thin' END"})(lambda df: {"rule_id": R.gate(df, [{"id": "thin", "phase": "hard_gate", "priority": 1, "when": {"volume_ratio": {"value_lt": 0.8}}, "regime_allow": ["up", "flat"]}])})
_DEC = f"CASE WHEN {_GATE} IS NOT NULL THEN 'VETO' WHEN box_pos > 0.8 THEN 'THROTTLE_25' WHEN box_pos > 0.6 THEN 'THROTTLE_50' ELSE 'ALLOW' END"


@on_rows("P08_gate_decision", {"decision": _DEC, "size": f"CASE {_DEC} WHEN 'VETO' THEN 0.0 WHEN 'THROTTLE_25' THEN 0.25 WHEN 'THROTTLE_50' THEN 0.5 ELSE 1.0 END::DOUBLE"})
def _decision(df):
    d = R.gate_decision(R.gate(df, GATES), F.col("box_pos"))
    return {"decision": d, "size": R.size_of_decision(d)}


FILTERS = [{"conditions": [UP, DEEP], "direction": "long"}, {"conditions": [rule("position", "<=", -0.1)], "direction": "short"}, {"conditions": [LOUD], "enabled": False}]
_SIDE = "CASE WHEN position > 0 THEN 1 WHEN position < 0 THEN -1 ELSE 0 END"
_L, _S = f"({_SIDE} = 1)", f"({_SIDE} = -1)"
_side = lambda: F.signum("position").cast("int")
on_rows("P09_entry_filters", {"passed": f"NOT ({_L} OR {_S}) OR ({_c('position >= 0.1')} AND {_c('box_pos <= 0.7')} AND {_L}) OR ({_c('position <= -0.1')} AND {_S})", "empty": "true"})(
    lambda df: {"passed": R.entry_filters(df, FILTERS, "or", _side()), "empty": R.entry_filters(df, [], "and")}
)
BUNDLED = [{"conditions": [UP], "bundle": "a"}, {"conditions": [rule("roc", ">", 0.5)], "bundle": "a"}, {"conditions": [LOUD]}]
on_rows("P10_or_bundle", {"passed": f"({_c('position >= 0.1')} OR {_c('roc > 0.5')}) AND {_c('volume_ratio > 1.0')}"})(lambda df: {"passed": R.entry_filters(df, BUNDLED, "and")})
REGIMES = [("bull", [UP, LOUD]), ("quiet_bull", [UP]), ("bear", [rule("position", "<=", -0.1)])]
on_rows("P11_regime_class", {"regime_class": "CASE WHEN position >= 0.1 AND volume_ratio > 1.0 THEN 'bull' WHEN position >= 0.1 THEN 'quiet_bull' WHEN position <= -0.1 THEN 'bear' END"})(lambda df: {"regime_class": R.regime_class(df, REGIMES)})
on_rows("P12_regime_dead_zone", {"outside": "coalesce(position >= 0.15, false) OR coalesce(position <= -0.15, false)"})(lambda df: {"outside": R.rules(df, [{"any_of": [rule("position", ">=", 0.15), rule("position", "<=", -0.15)]}])})


@on_rows("P13_side_mask", {"long_ok": f"{_c('position >= 0.1')} AND {_c('roc > 0')}", "short_ok": f"{_c('position <= -0.1')} AND {_c('roc < 0')}"})
def _mask(df):
    long, short = R.side_mask(df, [UP, rule("roc", ">", 0)], [rule("position", "<=", -0.1), rule("roc", "<", 0)])
    return {"long_ok": long, "short_ok": short}


_sg = lambda x: f"CAST(sign({x}) AS INTEGER)"
on_rows("P14_dir_feature_sign", {"raw": "CAST(trunc(position) AS INTEGER)", "s": _sg("position"), "neg": f"-{_sg('position')}", "centered": f"coalesce({_sg('box_pos - 0.5')}, 0)"})(
    lambda df: {n: R.direction(df, {"kind": "sign", "feature": f, "transform": t}) for n, f, t in (("raw", "position", "raw"), ("s", "position", "sign"), ("neg", "position", "negate_sign"), ("centered", "box_pos", "center_sign"))}
)
on_rows("P15_dir_threshold", {"direction": "CASE WHEN box_pos < 0.3 THEN 1 WHEN box_pos > 0.7 THEN -1 ELSE 0 END"})(lambda df: {"direction": R.direction(df, {"kind": "threshold", "feature": "box_pos", "long_below": 0.3, "short_above": 0.7})})
BAND = {"kind": "band", "feature": "position", "signals": ["roc", "flow"], "inner": 0.02, "outer": 0.5, "second": "flow", "deadband": 50.0}
_SIG = f"coalesce(nullif({_sg('roc')}, 0), nullif({_sg('flow')}, 0), 0)"
_BAND = f"CASE WHEN coalesce(abs(position) > 0.02 AND abs(position) <= 0.5 AND sign(position) = {_SIG} AND (abs(flow) <= 50 OR sign(flow) = {_SIG}), false) THEN {_SIG} ELSE 0 END"
on_rows("P16_dir_band", {"direction": _BAND})(lambda df: {"direction": R.direction(df, BAND)})
on_rows("P17_dir_cascade", {"direction": f"coalesce(nullif({_BAND}, 0), nullif(CASE WHEN box_pos < 0.3 THEN 1 WHEN box_pos > 0.7 THEN -1 ELSE 0 END, 0), 0)"})(
    lambda df: {"direction": R.direction_cascade(df, [BAND, {"kind": "threshold", "feature": "box_pos", "long_below": 0.3, "short_above": 0.7}])}
)
on_rows("P18_dir_fixed", {"direction": "1"})(lambda df: {"direction": R.direction(df, {"kind": "fixed", "value": 1})})
_OVER = "CASE WHEN symbol = 'click' THEN 0.9 ELSE 0.7 END"
on_rows("P19_dir_score", {"direction": f"CASE WHEN box_pos >= {_OVER} THEN 1 WHEN box_pos <= 0.3 THEN -1 ELSE 0 END"})(
    lambda df: {"direction": R.direction_score(F.col("box_pos"), F.when(F.col("symbol") == "click", 0.9).otherwise(0.7), F.lit(0.3))}
)
on_rows("P20_dir_dual_head", {"direction": "CASE WHEN coalesce(box_pos >= 0.6, false) AND NOT coalesce(volume_ratio >= 1.2, false) THEN 1 WHEN coalesce(volume_ratio >= 1.2, false) AND NOT coalesce(box_pos >= 0.6, false) THEN -1 ELSE 0 END"})(
    lambda df: {"direction": R.direction_dual(F.col("box_pos"), F.col("volume_ratio"), 0.6, 1.2)}
)
on_rows("P21_entry_mode", {"level": _c("position >= 0.1"), "crossing": f"{_c('position >= 0.1')} AND NOT coalesce(lag({_c('position >= 0.1')}) OVER w, false)"})(
    lambda df: {m: R.entry_mode(R.rules(df, [UP]), k) for m, k in (("level", "level"), ("crossing", "cross"))}
)


@query("P22_drop_inf", f"WITH RECURSIVE {ROWS}, g AS (SELECT symbol, ts, CASE WHEN flow = 0 THEN CAST('inf' AS DOUBLE) ELSE 100 / flow END AS per_flow FROM f) SELECT symbol, ts, round(per_flow, 6) AS per_flow FROM g WHERE abs(per_flow) <> CAST('inf' AS DOUBLE) OR per_flow IS NULL")
def drop_inf(spark, sf_dir):
    df = rows(spark, sf_dir).select("symbol", "ts", F.when(F.col("flow") == 0, float("inf")).otherwise(100 / F.nullif("flow", F.lit(0.0))).alias("per_flow"))
    return R.drop_inf(df, ["per_flow"]).withColumn("per_flow", F.round("per_flow", 6))


@query("P23_map_values", f"WITH RECURSIVE {ROWS} SELECT symbol, ts, {_sg('roc')} + 1 AS label FROM f WHERE roc IS NOT NULL")
def map_values(spark, sf_dir):
    return R.post_filters(rows(spark, sf_dir).select("symbol", "ts", F.signum("roc").cast("int").alias("label")), "label", {-1: 0, 0: 1, 1: 2})




@query("P24_ensure_column", f"WITH RECURSIVE {ROWS} SELECT symbol, ts, round(position, 6) AS position, 0.5::DOUBLE AS extra FROM f")
def ensure_column(spark, sf_dir):
    df = R.ensure_column(R.ensure_column(rows(spark, sf_dir), "position", 0.0), "extra", 0.5)
    return df.select("symbol", "ts", F.round("position", 6).alias("position"), "extra")


_CATALOGUE = [("macd_f", ["macd", "macd_signal", "macd_histogram"]), ("box_f", ["box_pos", "box_width"])]


@query(
    "P25_select_features",
    """WITH req AS (SELECT row_number() OVER (ORDER BY k) - 1 AS pos, node FROM (SELECT min(ts) AS k, event_type AS node FROM events GROUP BY event_type)),
  all_ AS (SELECT pos, node FROM req UNION ALL SELECT 100, 'macd_f' UNION ALL SELECT 101, 'box_f' UNION ALL SELECT 102, 'macd'),
  cat AS (SELECT 'macd_f' AS node, ['macd', 'macd_signal', 'macd_histogram'] AS oc UNION ALL SELECT 'box_f', ['box_pos', 'box_width']),
  wide AS (SELECT pos, coalesce(oc, [a.node]) AS oc FROM all_ a LEFT JOIN cat c ON a.node = c.node),
  flat AS (SELECT pos, unnest(oc) AS col, unnest(range(len(oc))) AS inner_pos FROM wide),
  d AS (SELECT col, min((pos, inner_pos)) AS first FROM flat WHERE col <> 'box_width' GROUP BY col)
  SELECT col AS "column", CAST(row_number() OVER (ORDER BY first) AS INTEGER) AS position FROM d""",
)
def select_features(spark, sf_dir):
    from pyspark.sql import Window

    events = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("node")).agg(F.min("ts").alias("k"))
    nodes = events.select((F.row_number().over(Window.orderBy("k")) - 1).alias("pos"), "node").unionByName(spark.createDataFrame([(100, "macd_f"), (101, "box_f"), (102, "macd")], "pos int, node string"))
    return R.select_features(spark.createDataFrame(_CATALOGUE, "node string, output_columns array<string>"), nodes, ["box_width"])


@query("P25_constant_columns", f"""WITH {LABELED} SELECT 'feature' AS "column", min(feature) = max(feature) AS is_constant FROM labeled UNION ALL SELECT 'label', min(label) = max(label) FROM labeled UNION ALL SELECT 'one', true""")
def constant_columns(spark, sf_dir):
    return R.constant_columns(labeled(spark, sf_dir).withColumn("one", F.lit(1)), ["feature", "label", "one"])


@query("P26_allow_globs", "SELECT DISTINCT event_type AS feature FROM events WHERE event_type LIKE '%ic%' OR event_type = 'view'")
def allow_globs(spark, sf_dir):
    return R.allowed(table(spark, sf_dir, "events").select(F.col("event_type").alias("feature")).distinct(), ["*ic*", "view"])


on_rows("P27_near_sr", {"near": "coalesce((close - lo) / close * close / nullif(atr, 0) <= 1.0, false)"})(lambda df: {"near": R.near_sr((F.col("close") - F.min("low").over(W.over(20))) / F.col("close"), F.col("close"), F.col("atr"), 1.0)})
on_rows("P28_symbol_filter", {"chosen": "symbol IN ('click', 'view')", "left_over": "symbol NOT IN ('click')", "every": "true"})(
    lambda df: {"chosen": R.symbol_filter(" click, VIEW"), "left_over": R.symbol_filter(["*"], ["Click"]), "every": R.symbol_filter("")}
)


@query("P29_chop_column", f"WITH RECURSIVE {ROWS} SELECT symbol, ts, round(box_pos, 6) AS chop, round(volume_ratio, 6) AS chop_q FROM f")
def chop_column(spark, sf_dir):
    df = rows(spark, sf_dir).withColumn("semantic_chop", F.col("box_pos")).withColumn("semantic_chop_ts_q", F.col("volume_ratio"))
    return df.select("symbol", "ts", F.round(R.chop_column("raw"), 6).alias("chop"), F.round(R.chop_column("ts_quantile"), 6).alias("chop_q"))


_Q = ["q AS (SELECT quantile_cont(volume_ratio, 0.9) AS hi, quantile_cont(roc, 0.1) AS lo FROM f)", "fq AS (SELECT f.*, q.hi AS vq, q.lo AS rq FROM f CROSS JOIN q)"]


@query("P30_evidence_quantile", f"WITH RECURSIVE {', '.join([ROWS, *_Q])} SELECT symbol, ts, coalesce(volume_ratio > vq, false) AS volume_high, coalesce(roc < rq, false) AS roc_low FROM fq")
def evidence_quantile(spark, sf_dir):
    df = rows(spark, sf_dir)
    long = df.select("volume_ratio", "roc").unpivot([], ["volume_ratio", "roc"], "name", "value")
    told = {r["name"]: r["q"] for r in group_quantiles(long, ["name"], "value", [0.1, 0.9]).collect()}
    known = {("volume_ratio", 0.9): told["volume_ratio"][1], ("roc", 0.1): told["roc"][0]}
    return df.select("symbol", "ts", R.evidence(known, "volume_ratio", "quantile_gt", 0.9).alias("volume_high"), R.evidence(known, "roc", "quantile_lt", 0.1).alias("roc_low"))


ROUTER = {"mfe_min": 0.2, "eff_min": 0.5, "trend_conf": 0.4, "trend_mfe": 1.0, "trend_ttm": 2.0, "mean_eff": 0.8, "mean_ttm": 30.0}
_PRED = ["p AS (SELECT *, box_pos AS dir, ln(1 + volume_ratio) AS mfe, ln(1 + n / 10.0) AS mae, ln(1 + volume / 20) AS ttm FROM f)", "r AS (SELECT *, abs(2 * dir - 1) AS conf, exp(mfe) - 1 AS m, (exp(mfe) - 1) / greatest(exp(mae) - 1, 1e-9) AS eff, exp(ttm) - 1 AS t FROM p)"]
_CODE = "CASE WHEN m >= 0.2 AND eff >= 0.5 AND conf >= 0.4 AND m >= 1.0 AND t >= 2.0 THEN 2 WHEN m >= 0.2 AND eff >= 0.5 AND eff >= 0.8 AND t <= 30.0 THEN 1 ELSE 0 END"


def _predicted(df: DataFrame) -> DataFrame:
    return df.withColumn("pred_dir_prob", F.col("box_pos")).withColumn("pred_mfe_atr", F.log1p("volume_ratio")).withColumn("pred_mae_atr", F.log1p(F.col("n") / 10)).withColumn("pred_t_to_mfe", F.log1p(F.col("volume") / 20))


@query("P31_router3", f"WITH RECURSIVE {', '.join([ROWS, *_PRED])} SELECT symbol, ts, {_CODE} AS code FROM r")
def router3(spark, sf_dir):
    df = _predicted(rows(spark, sf_dir))
    return df.select("symbol", "ts", R.router3(df, ROUTER).alias("code"))


@query("P32_mean_only", f"WITH RECURSIVE {', '.join([ROWS, *_PRED])} SELECT symbol, ts, CASE WHEN {_CODE} = 2 THEN 0 ELSE {_CODE} END AS code FROM r")
def mean_only(spark, sf_dir):
    df = _predicted(rows(spark, sf_dir))
    return df.select("symbol", "ts", R.mean_only(R.router3(df, ROUTER)).alias("code"))


on_rows("P33_tier_lookup", {"multiplier": "CASE WHEN volume_ratio < 0.5 THEN 2.0 WHEN volume_ratio < 1.5 THEN 1.5 WHEN volume_ratio < 999 THEN 1.0 END::DOUBLE"})(lambda df: {"multiplier": R.tier(F.col("volume_ratio"), [(0.5, 2.0), (1.5, 1.5), (999.0, 1.0)])})
on_rows("P34_degradation", {"state": "CASE WHEN coalesce(roc IS NOT NULL AND volume_ratio < 2, false) THEN 'normal' ELSE 'reduce' END"})(lambda df: {"state": R.degradation(F.col("roc").isNotNull(), F.col("volume_ratio") < 2, "reduce")})
on_rows("P35_size_cap", {"cap": "round((1 - greatest(0, least(1, box_pos))) * sqrt(greatest(0, least(1, volume_ratio))), 6)"})(lambda df: {"cap": F.round(R.size_cap(F.col("box_pos"), F.col("volume_ratio")), 6)})
on_rows("P36_score_veto", {"reason": "CASE WHEN box_pos > 0.55 THEN 'score_veto' END"})(lambda df: {"reason": R.score_veto(F.col("box_pos"))})


@query(
    "P37_kpi_gate",
    f"""WITH {LABELED}, m AS (SELECT avg(label) AS q, avg(toxic) AS t FROM labeled)
  SELECT 'quality' AS metric, CASE WHEN q >= 0.5 THEN 'ok' ELSE 'fail' END AS state FROM m UNION ALL
  SELECT 'toxic', CASE WHEN t <= 0.05 THEN 'ok' ELSE 'warn' END FROM m UNION ALL SELECT 'absent_optional', 'ok' UNION ALL SELECT 'absent', 'fail'""",
)
def kpi_gate(spark, sf_dir):
    m = labeled(spark, sf_dir).agg(F.avg("label").alias("quality"), F.avg(F.col("toxic").cast("double")).alias("toxic")).unpivot([], ["quality", "toxic"], "metric", "value")
    wanted = [("quality", 0.5, None, True, False), ("toxic", None, 0.05, False, False), ("absent_optional", 0.0, None, True, True), ("absent", 0.0, None, True, False)]
    return R.kpi_gate(m, spark.createDataFrame(wanted, "metric string, lo double, hi double, hard boolean, optional boolean"))


on_rows("P38_health_flag", {"health": "CASE WHEN coalesce(roc > 0 AND (hi - close) / hi <= 0.35 AND position > 0, false) THEN 1.0 ELSE 0.0 END::DOUBLE"})(
    lambda df: {"health": R.health(F.col("roc"), (F.max("high").over(W.over(20)) - F.col("close")) / F.max("high").over(W.over(20)), F.col("position"))}
)


@query(
    "P39_eligibility",
    """WITH f AS (SELECT o_orderpriority AS symbol, CASE WHEN max(o_totalprice) > 480000 THEN 1.0 END AS wp, count(*) FILTER (o_orderstatus = 'O' AND o_totalprice > 499000) AS pending FROM orders GROUP BY 1)
  SELECT symbol, pending = 0 AND wp IS NOT NULL AS can_buy, concat_ws(',', CASE WHEN pending > 0 THEN 'pending_orders' END, CASE WHEN wp IS NULL THEN 'no_weekly_position' END) AS blockers FROM f""",
)
def eligibility(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "symbol")
    features = o.groupBy("symbol").agg(F.when(F.max("o_totalprice") > 480000, 1.0).alias("weekly_position"))
    return R.eligibility(features, o.where("o_totalprice > 499000").select("symbol", F.col("o_orderstatus").alias("status")))




@query("P40_attach_subject", f"WITH RECURSIVE {ROWS} SELECT symbol, ts, {_c('position >= 0.1 AND volume_ratio > 1')} AS by_expression, round(roc, 6) AS by_feature, {_c('position >= 0.1')} AND {_c('volume_ratio > 1')} AS by_rules FROM f")
def attach_subject(spark, sf_dir):
    df = R.attach_subject(rows(spark, sf_dir), {"name": "by_expression", "expression": "position >= 0.1 AND volume_ratio > 1"})
    df = R.attach_subject(R.attach_subject(df, {"name": "by_feature", "feature": "roc"}), {"name": "by_rules", "rules": [UP, LOUD]})
    return df.select("symbol", "ts", "by_expression", F.round("by_feature", 6).alias("by_feature"), "by_rules")


on_rows("P41_size_bucket", {"size": "CASE regime WHEN 'up' THEN 1.0 WHEN 'down' THEN 0.5 ELSE 0.25 END::DOUBLE"})(lambda df: {"size": R.size_bucket(F.col("regime"), {"up": 1.0, "down": 0.5, "default": 0.25})})
on_rows("P42_block_on_exit", {"entry": f"{_c('position >= 0.1')} AND NOT {_c('roc < 0')}"})(lambda df: {"entry": R.block_on_exit(F.col("position") >= 0.1, F.col("roc") < 0)})
