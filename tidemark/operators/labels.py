"""Labels: windows ahead of each bar, first-touch outcomes, folds over a signal's path, and splits.

"Ahead" frames never cross symbols. Folds (rr_outcome, ladder_adds) run over one array of a row's next bars, inside the
JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.windows import order, over

#: Where a realised or forward R is looked for, in this order.
RR_COLUMNS = ("bpc_impulse_return_atr", "forward_rr", "rr", "return_atr")


def ahead(h: int):
    """The next h bars."""
    return order().rowsBetween(1, h)


def signed_rr(h: int, atr: str = "atr", least: float = 1e-9) -> Column:
    """Move of the close over h bars in ATR."""
    return (F.lead("close", h).over(order()) - F.col("close")) / F.greatest(F.col(atr), F.lit(least))


def shift_target(c: str, h: int) -> Column:
    return F.lead(c, h).over(order())


def path_primitives(df: DataFrame, h: int, side: int = 1, atr: str = "atr") -> DataFrame:
    """Most favourable and adverse moves over the next h bars in ATR and bars until the former; null without a whole path."""
    df = df.withColumn("_i", F.row_number().over(order()))
    unit = F.greatest(F.col(atr), F.lit(1e-9))
    whole = F.count("*").over(ahead(h)) == h
    best, worst = ("high", "low") if side > 0 else ("low", "high")
    top = F.max(best).over(ahead(h)) if side > 0 else F.min(best).over(ahead(h))
    bottom = F.min(worst).over(ahead(h)) if side > 0 else F.max(worst).over(ahead(h))
    first = (F.max_by if side > 0 else F.min_by)("_i", F.struct(F.col(best), (-F.col("_i") if side > 0 else F.col("_i")).alias("_o"))).over(ahead(h))
    df = df.withColumn("mfe", F.when(whole, F.greatest(side * (top - F.col("close")) / unit, F.lit(0.0)))).withColumn("mae", F.when(whole, F.greatest(side * (F.col("close") - bottom) / unit, F.lit(0.0))))
    return df.withColumn("t_mfe", F.when(whole, first - F.col("_i"))).withColumn("forward_rr", side * signed_rr(h, atr)).drop("_i")


def failure(stop: float = 1.0, target: float = 1.0) -> Column:
    """1 where the outcome is below -0.8 or the stop was passed by a fifth without 0.3 of the target."""
    bad = (F.col("forward_rr") < -0.8) | ((F.col("mae") > 1.2 * stop) & (F.col("mfe") < 0.3 * target))
    return F.when(F.col("mfe").isNotNull(), F.when(bad, 1).otherwise(0))


def success_without_extreme(extreme: float = -0.8) -> Column:
    return F.when(F.col("forward_rr").isNotNull(), F.when(F.col("forward_rr") < extreme, 0).otherwise(1))


def is_good(df: DataFrame, threshold: float = -0.8, rr_column: str | None = None) -> DataFrame:
    """1 where the first RR column reaches the threshold, 0 elsewhere and for null; an existing label is kept. Without an RR column it is an error."""
    found = [c for c in ([rr_column] if rr_column else RR_COLUMNS) if c in df.columns]
    if not found:
        raise ValueError(f"none of {rr_column or RR_COLUMNS} is a column")
    if "is_good" in df.columns:
        return df
    return df.withColumn("is_good", F.coalesce((F.col(found[0]) >= threshold).cast("int"), F.lit(0)))


def first_touch(df: DataFrame, tp: float, sl: float, h: int, side: int = 1, unit: str = "atr") -> DataFrame:
    """tp, sl or time, whichever comes first over the next h bars (sl where both come in one bar), the bars held and R."""
    up, down = F.col("close") + tp * F.col(unit), F.col("close") - sl * F.col(unit)
    if side < 0:
        up, down = F.col("close") - tp * F.col(unit), F.col("close") + sl * F.col(unit)
    df = df.withColumn("_up", up).withColumn("_down", down).withColumn("_path", F.collect_list(F.struct("high", "low")).over(ahead(h)))
    hit_up = (lambda b: b["high"] >= F.col("_up")) if side > 0 else (lambda b: b["low"] <= F.col("_up"))
    hit_down = (lambda b: b["low"] <= F.col("_down")) if side > 0 else (lambda b: b["high"] >= F.col("_down"))
    at = lambda f: F.array_position(F.transform("_path", f), F.lit(True))
    df = df.withColumn("_tu", at(hit_up)).withColumn("_td", at(hit_down))
    stopped = (F.col("_td") > 0) & ((F.col("_tu") == 0) | (F.col("_td") <= F.col("_tu")))
    won = (F.col("_tu") > 0) & ~stopped
    df = df.withColumn("outcome", F.when(F.size("_path") < h, F.when(stopped, "sl").when(won, "tp")).when(stopped, "sl").when(won, "tp").otherwise("time"))
    df = df.withColumn("bars_held", F.when(stopped, F.col("_td")).when(won, F.col("_tu")).when(F.size("_path") == h, h).cast("int"))
    drift = side * (F.lead("close", h).over(order()) - F.col("close")) / F.greatest(F.col(unit), F.lit(1e-9))
    return df.withColumn("realized_r", F.when(F.col("outcome") == "sl", -sl).when(F.col("outcome") == "tp", tp).when(F.col("outcome") == "time", drift)).drop("_up", "_down", "_path", "_tu", "_td")


def rr_weights(near: Column) -> DataFrame | Column:
    """Sample weights near a level: 0.05 for losses, 1.5 from two R on, else 1; null elsewhere."""
    ratio = F.col("mfe") / F.greatest(F.col("mae"), F.lit(1e-9))
    return F.when(near, F.when(F.col("forward_rr") < 0, 0.05).when(ratio >= 2, 1.5).otherwise(1.0))


def compression_label(width_rank: str, confirm: int = 3, below: float = 0.2) -> Column:
    """Sign of the move over the next bars if every one of them goes that way, after compression; else 0."""
    moves = [F.signum(F.lead("close", i + 1).over(order()) - F.lead("close", i).over(order()) if i else F.lead("close", 1).over(order()) - F.col("close")) for i in range(confirm)]
    total = sum(moves, F.lit(0.0))
    tight = F.lag(width_rank).over(order()) < below
    return F.when(F.coalesce(tight, F.lit(False)) & (F.abs(total) == confirm), F.signum(total)).otherwise(0).cast("int")


def trend_rank(df: DataFrame, h: int = 50, n: int = 200, least: int = 50) -> DataFrame:
    """Rank of the move over the next h bars among the last n such moves, from `least` of them on."""
    df = df.withColumn("_f", F.lead("close", h).over(order()) / F.col("close") - 1).withColumn("_l", F.collect_list("_f").over(over(n)))
    small = F.aggregate("_l", F.lit(0), lambda t, x: t + F.when(x <= F.col("_f"), 1).otherwise(0))
    return df.withColumn("trend_rank", F.when(F.col("_f").isNotNull() & (F.size("_l") >= least), small / F.size("_l"))).drop("_f", "_l")


def breakout_label(df: DataFrame, h: int = 10, jump: float = 0.1, cap: float = 3.0) -> DataFrame:
    """Outcome in R, at most `cap`, of bars whose ATR rose by more than `jump` on the bar before."""
    signal = F.col("atr") / F.nullif(F.lag("atr").over(order()), F.lit(0.0)) - 1 > jump
    side = F.when(F.col("close") >= F.col("open"), 1).otherwise(-1)
    return df.withColumn("signal", F.coalesce(signal, F.lit(False)).cast("int")).withColumn("breakout_rr", F.when(F.col("signal") == 1, F.least(F.lit(cap), side * signed_rr(h))))


def dual_win(h: int, floor: float) -> tuple[Column, Column]:
    """1 where the move over h bars, in ATR, is beyond the floor upwards; downwards."""
    r = signed_rr(h)
    flag = lambda c: F.when(r.isNotNull(), c.cast("int"))
    return flag(r > floor), flag(r < -floor)


def holding_exit(name: str = "holding_exit") -> Column:
    return F.lit(None).cast("double").alias(name)


def rr_outcome(df: DataFrame, h: int = 20, stop: float = 1.0, target: float = 2.0, trail: float = 1.0, breakeven: float = 1.0, cost_bps: float = 10.0) -> DataFrame:
    """Long entries at the next bar's open: stop, target, trailing stop from the best high, stop to entry after `breakeven` R, else time.

    A fold over the row's next h bars; on each bar the stop set so far is tried before the target. Gives bars held,
    the reason and R after costs; null without a next bar.
    """
    unit = F.greatest(F.col("atr"), F.lit(1e-9))
    df = df.withColumn("_path", F.collect_list(F.struct("open", "high", "low", "close")).over(ahead(h))).withColumn("_entry", F.get("_path", F.lit(0))["open"]).withColumn("_unit", unit)
    start = F.struct((F.col("_entry") - stop * F.col("_unit")).alias("stop"), F.col("_entry").alias("best"), F.lit(0).alias("bars"), F.lit("").alias("reason"), F.col("_entry").alias("price"))

    def step(s: Column, bar: Column) -> Column:
        goal = F.col("_entry") + target * F.col("_unit")
        out = F.when(bar["low"] <= s["stop"], F.when(s["stop"] >= F.col("_entry"), "trail").otherwise("stop")).when(bar["high"] >= goal, "target").otherwise("")
        price = F.when(bar["low"] <= s["stop"], s["stop"]).when(bar["high"] >= goal, goal).otherwise(bar["close"])
        best = F.greatest(s["best"], bar["high"])
        moved = F.greatest(s["stop"], F.when(best - F.col("_entry") >= breakeven * F.col("_unit"), F.greatest(F.col("_entry"), best - trail * F.col("_unit"))).otherwise(s["stop"]))
        return F.when(s["reason"] != "", s).otherwise(F.struct(moved.alias("stop"), best.alias("best"), (s["bars"] + 1).alias("bars"), out.alias("reason"), price.alias("price")))

    df = df.withColumn("_end", F.when(F.size("_path") > 0, F.aggregate("_path", start, step)))
    reason = F.when(F.col("_end.reason") != "", F.col("_end.reason")).when(F.size("_path") == h, "time")
    r = (F.col("_end.price") * (1 - cost_bps / 1e4) - F.col("_entry") * (1 + cost_bps / 1e4)) / (stop * F.col("_unit"))
    return df.withColumn("exit_reason", reason).withColumn("bars_held", F.when(reason.isNotNull(), F.col("_end.bars"))).withColumn("pnl_r", F.when(reason.isNotNull(), r)).drop("_path", "_entry", "_unit", "_end")


def ladder_adds(df: DataFrame, h: int, steps: list[float], weights: list[float], stop: float = 1.0) -> DataFrame:
    """How many R steps the next highs reach before a bar touches the stop, and the weights so added."""
    df = df.withColumn("_path", F.collect_list(F.struct("high", "low")).over(ahead(h))).withColumn("_u", F.greatest(F.col("atr"), F.lit(1e-9)))
    start = F.struct(F.lit(True).alias("open"), F.col("close").alias("best"))
    walk = F.aggregate("_path", start, lambda a, b: F.when(a["open"], F.when(b["low"] <= F.col("close") - stop * F.col("_u"), F.struct(F.lit(False).alias("open"), a["best"].alias("best"))).otherwise(F.struct(F.lit(True).alias("open"), F.greatest(a["best"], b["high"]).alias("best")))).otherwise(a))
    reached = (walk["best"] - F.col("close")) / F.col("_u")
    df = df.withColumn("_r", reached)
    return df.withColumn("adds", sum((F.when(F.col("_r") >= s, 1).otherwise(0) for s in steps), F.lit(0))).withColumn("add_weight", sum((F.when(F.col("_r") >= s, w).otherwise(0.0) for s, w in zip(steps, weights)), F.lit(0.0))).drop("_path", "_u", "_r")


def atr_size(equity: Column, risk: float, atr: Column, stop: float, cap: float) -> Column:
    return F.least(F.lit(cap), equity * risk / F.nullif(atr * stop, F.lit(0.0)))


def stop_pct(distance: Column, low: float = 0.01, high: float = 0.2) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), distance))


def splits(df: DataFrame, test_start: str, holdout_start: str, cutoff: str | None = None) -> DataFrame:
    """train, validation or holdout by time; the cutoff is the explicit date or else the test start."""
    edge = F.coalesce(F.lit(cutoff), F.lit(test_start)).cast("timestamp")
    return df.withColumn("split", F.when(F.col("ts") < edge, "train").when(F.col("ts") < F.lit(holdout_start).cast("timestamp"), "validation").otherwise("holdout"))


def folds(df: DataFrame, n: int = 5, gap: int = 24) -> DataFrame:
    """Time-series folds: n + 1 parts in order; the last `gap` bars of a part before the next are marked as embargoed."""
    df = df.withColumn("fold", F.ntile(n + 1).over(order()) - 1)
    left = F.row_number().over(Window.partitionBy("symbol", "fold").orderBy(F.desc("ts")))
    return df.withColumn("embargo", (left <= gap) & (F.col("fold") < n))


def invert_features(df: DataFrame, columns: list[str]) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, -F.col(c))
    return df


def structural_exit(df: DataFrame, position: Column, side: int, h: int) -> DataFrame:
    """Bars until the position first turns against the trade, within the next h bars."""
    df = df.withColumn("_i", F.row_number().over(order())).withColumn("_p", position)
    against = F.when((F.col("_p") * side) < 0, F.col("_i"))
    return df.withColumn("_a", against).withColumn("bars_to_exit", F.min("_a").over(ahead(h)) - F.col("_i")).drop("_i", "_p", "_a")
