"""Rule layers: rules are data, and each layer compiles to one Column, so a plan holds no per-row Python.

A null comparison is false, and a rule on an absent column rejects every row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_OPERATORS = {
    ">=": lambda c, v: c >= v, "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, "<": lambda c, v: c < v, "==": lambda c, v: c == v,
}
_WHEN = {"value_gt": ">", "value_lt": "<", "value_gte": ">=", "value_lte": "<="}
PHASES = ("system_safety", "hard_gate", "guardrail")


def order():
    return Window.partitionBy("symbol").orderBy("ts")


def holds(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def clause(text: str) -> Column:
    """The mask of a textual condition."""
    return holds(F.expr(text))


def calendar_mask(ts: Column, span: str) -> Column:
    """ts within "start,end"; the end is exclusive."""
    start, end = (F.lit(x.strip()).cast("timestamp") for x in span.split(","))
    return holds((ts >= start) & (ts < end))


def rule(df: DataFrame, r: dict) -> Column:
    """One comparison {feature, operator, value}, or {any_of: [...]} or {all_of: [...]}."""
    if "any_of" in r:
        return reduce(lambda a, b: a | b, (rule(df, x) for x in r["any_of"]), F.lit(False))
    if "all_of" in r:
        return rules(df, r["all_of"])
    if r["feature"] not in df.columns:
        return F.lit(False)
    c = F.col(r["feature"])
    return holds(_OPERATORS[r["operator"]](F.abs(c) if r.get("abs") else c, r["value"]))


def rules(df: DataFrame, listed: list[dict]) -> Column:
    """All of the listed rules."""
    return reduce(lambda a, b: a & b, (rule(df, r) for r in listed), F.lit(True))


def recent(condition: Column, bars: int) -> Column:
    """The condition held on one of the last `bars` bars, now included."""
    return F.max(condition).over(order().rowsBetween(1 - bars, 0))


def when(df: DataFrame, tests: dict | list) -> Column:
    """A gate's condition: {feature: {value_gt: x, ...}, all_of: [...]}."""
    parts = []
    for feature, limits in tests.items():
        if feature == "all_of":
            parts += [when(df, t) for t in limits]
        else:
            parts += [rule(df, {"feature": feature, "operator": _WHEN[k], "value": v}) for k, v in limits.items()]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def gate(df: DataFrame, listed: list[dict]) -> Column:
    """The id of the first rule that denies, by phase and then priority; null where none does.

    `regime_allow` limits a rule to rows of these regimes.
    """
    ordered = sorted(listed, key=lambda r: (PHASES.index(r["phase"]), r["priority"]))
    hit = [F.when(when(df, r["when"]) & (holds(F.col("regime").isin(r["regime_allow"])) if "regime_allow" in r else F.lit(True)), F.lit(r["id"])) for r in ordered]
    return F.coalesce(*hit) if hit else F.lit(None).cast("string")


def size_of_decision(decision: Column) -> Column:
    return F.when(decision == "VETO", 0.0).when(decision == "THROTTLE_25", 0.25).when(decision == "THROTTLE_50", 0.5).when(decision == "ALLOW", 1.0)


def gate_decision(denied: Column, risk: Column) -> Column:
    """VETO where denied, else throttled by risk (over 0.8: 25, over 0.6: 50), else ALLOW."""
    return F.when(denied.isNotNull(), "VETO").when(risk > 0.8, "THROTTLE_25").when(risk > 0.6, "THROTTLE_50").otherwise("ALLOW")


def entry_filters(df: DataFrame, filters: list[dict], mode: str, side: Column | None = None) -> Column:
    """Enabled filters, each all of its conditions, combined by or / and. No filters pass.

    A filter with `direction` counts only for rows of that side and is neutral for others. Filters with a `bundle`
    are alternatives of each other, and the bundles go with the remaining filters by and.
    """
    live = [f for f in filters if f.get("enabled", True)]
    if not live:
        return F.lit(True)
    own = lambda f: rules(df, f["conditions"])
    fits = lambda f: F.lit(True) if side is None or "direction" not in f else side == (1 if f["direction"] == "long" else -1)
    bundles: dict[str, list[dict]] = {}
    for f in live:
        if "bundle" in f:
            bundles.setdefault(f["bundle"], []).append(f)
    single = [f for f in live if "bundle" not in f]
    either = [reduce(lambda a, b: a | b, (own(f) & fits(f) for f in b)) for b in bundles.values()]
    if mode == "or" and single and not either:
        applies = reduce(lambda a, b: a | b, (fits(f) for f in single))
        return ~applies | reduce(lambda a, b: a | b, (own(f) & fits(f) for f in single))
    return reduce(lambda a, b: a & b, [*either, *(own(f) | ~fits(f) for f in single)])


def regime_class(df: DataFrame, regimes: list[tuple[str, list[dict]]]) -> Column:
    """The first regime all of whose rules hold."""
    return F.coalesce(*(F.when(rules(df, r), F.lit(name)) for name, r in regimes))


def side_mask(df: DataFrame, long: list[dict], short: list[dict]) -> tuple[Column, Column]:
    return rules(df, long), rules(df, short)


def direction(df: DataFrame, r: dict) -> Column:
    """-1, 0 or 1 by one rule: sign (raw, sign, negate_sign, center_sign), threshold, band or fixed."""
    kind = r["kind"]
    if kind == "fixed":
        return F.lit(r["value"])
    x = F.col(r["feature"])
    if kind == "sign":
        x = {"raw": x, "sign": F.signum(x), "negate_sign": -F.signum(x), "center_sign": F.signum(x - 0.5)}[r["transform"]]
        return F.coalesce(x.cast("int"), F.lit(0))
    if kind == "threshold":
        return F.when(x < r["long_below"], 1).when(x > r["short_above"], -1).otherwise(0)
    signal = F.coalesce(*(F.nullif(F.signum(F.col(c)).cast("int"), F.lit(0)) for c in r["signals"]), F.lit(0))
    size = F.abs(x)
    fit = (size > r["inner"]) & (size <= r["outer"]) & (F.signum(x) == signal)
    if "second" in r:
        y = F.col(r["second"])
        fit = fit & ((F.abs(y) <= r["deadband"]) | (F.signum(y) == signal))
    return F.when(holds(fit), signal).otherwise(0)


def direction_cascade(df: DataFrame, listed: list[dict]) -> Column:
    """The first rule that is not 0."""
    return F.coalesce(*(F.nullif(direction(df, r), F.lit(0)) for r in listed), F.lit(0))


def direction_score(score: Column, long_entry: Column, short_entry: Column) -> Column:
    return F.when(score >= long_entry, 1).when(score <= short_entry, -1).otherwise(0)


def direction_dual(long: Column, short: Column, long_min: float, short_min: float) -> Column:
    """By the head that reaches its threshold; 0 where both do."""
    a, b = holds(long >= long_min), holds(short >= short_min)
    return F.when(a & ~b, 1).when(b & ~a, -1).otherwise(0)


def entry_mode(condition: Column, mode: str) -> Column:
    """level: the condition; cross: it holds now and did not on the bar before."""
    return condition if mode == "level" else condition & ~F.coalesce(F.lag(condition).over(order()), F.lit(False))


def drop_inf(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without plus or minus infinity in the columns; nulls stay."""
    finite = (F.coalesce(F.abs(F.col(c).cast("double")) != float("inf"), F.lit(True)) for c in columns)
    return df.where(reduce(lambda a, b: a & b, finite, F.lit(True)))


def post_filters(df: DataFrame, column: str, mapping: dict[int, int]) -> DataFrame:
    """Rows whose label is not null, with its values mapped."""
    table = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))
    return df.where(F.col(column).isNotNull()).withColumn(column, table[F.col(column)])


def ensure_column(df: DataFrame, name: str, default) -> DataFrame:
    return df if name in df.columns else df.withColumn(name, F.lit(default))


def select_features(catalogue: DataFrame, nodes: DataFrame, exclude: list[str]) -> DataFrame:
    """Requested nodes (pos, node) as output columns, in the order first met; unknown nodes stand for themselves."""
    wide = nodes.join(catalogue, "node", "left").select("pos", F.posexplode(F.coalesce("output_columns", F.array("node"))).alias("at", "column"))
    return wide.where(~F.col("column").isin(exclude)).groupBy("column").agg(F.min(F.struct("pos", "at")).alias("first")).select("column", F.row_number().over(Window.orderBy("first")).alias("position"))


def constant_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns and whether they hold one value at most."""
    long = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).unpivot([], columns, "column", "value")
    return long.groupBy("column").agg(F.coalesce(F.min("value") == F.max("value"), F.lit(True)).alias("is_constant"))


def allowed(features: DataFrame, globs: list[str]) -> DataFrame:
    """Features that a whitelist of globs names."""
    pattern = "^(" + "|".join("".join(".*" if c == "*" else "." if c == "?" else c if c.isalnum() or c == "_" else "\\" + c for c in g) for g in globs) + ")$"
    return features.where(F.col("feature").rlike(pattern))


def near_sr(distance: Column, close: Column, atr: Column, most: float) -> Column:
    """Distance to a level, in ATR, is at most `most`."""
    return holds(distance * close / F.nullif(atr, F.lit(0.0)) <= most)


CHOP = {"raw": "semantic_chop", "ts_quantile": "semantic_chop_ts_q"}


def chop_column(mode: str) -> str:
    """The column that a chop signal reads: the raw one, or its quantile in time."""
    if mode not in CHOP:
        raise ValueError(f"chop signal {mode}: not one of {', '.join(CHOP)}")
    return CHOP[mode]


def symbol_filter(wanted: str | list[str] = "", exclude: list[str] | None = None) -> Column:
    """Rows of the listed symbols but the excluded ones; an empty list, * or ALL take every row."""
    clean = lambda names: [s.strip().upper() for s in names if s.strip()]
    names, gone = clean(wanted.split(",") if isinstance(wanted, str) else wanted), clean(exclude or [])
    symbol = F.upper(F.trim("symbol"))
    chosen = F.lit(True) if not names or any(n in ("*", "ALL", "__ALL__") for n in names) else symbol.isin(names)
    return chosen & ~symbol.isin(gone) if gone else chosen


def router3(df: DataFrame, cfg: dict) -> Column:
    """0 no trade, 1 mean, 2 trend, from predictions in log1p space."""
    conf = F.abs(2 * F.col("pred_dir_prob") - 1)
    mfe, mae, ttm = (F.expm1(f"pred_{c}") for c in ("mfe_atr", "mae_atr", "t_to_mfe"))
    eff = mfe / F.greatest(mae, F.lit(1e-9))
    base = (mfe >= cfg["mfe_min"]) & (eff >= cfg["eff_min"])
    trend = base & (conf >= cfg["trend_conf"]) & (mfe >= cfg["trend_mfe"]) & (ttm >= cfg["trend_ttm"])
    mean = base & (eff >= cfg["mean_eff"]) & (ttm <= cfg["mean_ttm"])
    return F.when(holds(trend), 2).when(holds(mean), 1).otherwise(0)


def mean_only(code: Column) -> Column:
    return F.when(code == 2, 0).otherwise(code)


def tier(score: Column, tiers: list[tuple[float, float]]) -> Column:
    """The multiplier of the first tier whose upper edge the score is below."""
    return F.coalesce(*(F.when(score < edge, F.lit(m)) for edge, m in tiers))


def degradation(available: Column, stable: Column, policy: str) -> Column:
    return F.when(holds(available & stable), "normal").otherwise(policy)


def size_cap(ood: Column, survival: Column, a: float = 1.0, b: float = 0.5) -> Column:
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return F.pow(1 - unit(ood), F.lit(a)) * F.pow(unit(survival), F.lit(b))


def score_veto(p: Column, threshold: float = 0.55) -> Column:
    """The reason where a score is over the threshold."""
    return F.when(p > threshold, F.lit("score_veto"))


def kpi_gate(metrics: DataFrame, wanted: DataFrame) -> DataFrame:
    """ok, warn or fail of each rule (metric, lo, hi, hard, optional); a missing metric fails unless optional."""
    joined = wanted.join(metrics, "metric", "left")
    inside = (F.col("value") >= F.coalesce("lo", F.col("value"))) & (F.col("value") <= F.coalesce("hi", F.col("value")))
    state = F.when(F.col("value").isNull(), F.when(F.col("optional"), "ok").otherwise("fail")).when(inside, "ok").when(F.col("hard"), "fail").otherwise("warn")
    return joined.select("metric", state.alias("state"))


def health(ret: Column, dd: Column, sharpe: Column, dd_limit: float = 0.35) -> Column:
    return holds((ret > 0) & (dd <= dd_limit) & (sharpe > 0)).cast("double")


def eligibility(features: DataFrame, orders: DataFrame) -> DataFrame:
    """can_buy and the blockers of each symbol: orders that are pending, and a missing weekly position."""
    pending = orders.where(F.col("status") == "O").groupBy("symbol").agg(F.count("*").alias("pending"))
    joined = features.join(pending, "symbol", "left")
    blockers = F.array_compact(F.array(F.when(F.col("pending") > 0, "pending_orders"), F.when(F.col("weekly_position").isNull(), "no_weekly_position")))
    return joined.select("symbol", (F.size(blockers) == 0).alias("can_buy"), F.array_join(blockers, ",").alias("blockers"))


def attach_subject(df: DataFrame, spec: dict) -> DataFrame:
    """A column to test, from {feature}, {expression} or {rules}."""
    c = F.col(spec["feature"]) if "feature" in spec else clause(spec["expression"]) if "expression" in spec else rules(df, spec["rules"])
    return df.withColumn(spec["name"], c)


def size_bucket(regime: Column, buckets: dict[str, float]) -> Column:
    table = F.create_map(*(F.lit(x) for kv in buckets.items() if kv[0] != "default" for x in kv))
    return F.coalesce(table[regime], F.lit(buckets["default"]))


def block_on_exit(entry: Column, exit_: Column) -> Column:
    return holds(entry) & ~holds(exit_)


def evidence(quantile_of: dict[tuple[str, float], float], feature: str, operator: str, q: float) -> Column:
    """A value against a quantile of its baseline: quantile_gt or quantile_lt."""
    edge = quantile_of[feature, q]
    return holds(F.col(feature) > edge if operator == "quantile_gt" else F.col(feature) < edge)
