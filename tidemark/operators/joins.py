"""Joins over time: as-of, base alignment, anchors, ranges, coarse with fine bars, and key comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import sized_broadcast


def asof_join(left: DataFrame, right: DataFrame, by: str, on: str, take: list[str], tolerance: str | None = None, slot_seconds: int = 3600) -> DataFrame:
    """For each row of left the columns `take` of the last row of right at or before it, of the same key.

    Both sides are laid into one ordered series per key and slot of time, which begins with the last right row of the
    slots before it; so a hot key spreads over tasks by slots, and only one row a slot is ordered per key. `tolerance`
    is the longest interval to look back. Right rows come before left rows of the same time; of equal right rows one
    of the largest values is taken. Rows without key or time match nothing; those of left stay.
    """
    own = F.struct(*left.columns).alias("_left")
    taken = F.struct(F.col(on).alias("_on"), *take).alias("_right")
    place = lambda side: [F.col(by).alias("_by"), F.col(on).alias("_at"), F.lit(side).alias("_is_left"), F.floor(F.col(on).cast("timestamp").cast("double") / slot_seconds).alias("_slot")]
    rows = right.where(F.col(by).isNotNull() & F.col(on).isNotNull()).select(*place(0), taken)
    series = left.select(*place(1), own).unionByName(rows, allowMissingColumns=True)
    slots = left.select(*place(1)).unionByName(rows, allowMissingColumns=True).groupBy("_by", "_slot").agg(F.max(F.when(F.col("_is_left") == 0, F.struct("_at", "_right")))["_right"].alias("_right"))
    before = Window.partitionBy("_by").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = slots.select("_by", "_slot", F.lit(0).alias("_is_left"), F.last("_right", ignorenulls=True).over(before).alias("_right")).where("_right is not null")
    order = Window.partitionBy("_by", "_slot").orderBy(F.asc_nulls_first("_at"), "_is_left", "_right").rowsBetween(Window.unboundedPreceding, 0)
    joined = series.unionByName(carried, allowMissingColumns=True).withColumn("_right", F.last("_right", ignorenulls=True).over(order)).where("_is_left = 1")
    fresh = F.lit(True) if tolerance is None else F.col("_right._on") >= F.col("_at") - F.expr(f"interval {tolerance}")
    return joined.select("_left.*", *(F.when(fresh, F.col(f"_right.{c}")).alias(c) for c in take))


def align_base(base: DataFrame, cached: DataFrame, take: list[str]) -> DataFrame:
    """Every base row with the cached values of the same symbol and instant; naive times count as UTC."""
    utc = lambda df: df.withColumn("ts", F.col("ts").cast("timestamp"))
    return utc(base).join(utc(cached).select("symbol", "ts", *take), ["symbol", "ts"], "left")


def anchor_overlay(df: DataFrame, column: str, anchor: str, enabled: bool = True) -> DataFrame:
    """Every symbol's value of a column replaced by the anchor symbol's at the same time."""
    if not enabled:
        return df
    source = df.where(F.col("symbol") == anchor).select("ts", F.col(column).alias("_anchor"))
    return df.join(source, "ts", "left").withColumn(column, F.col("_anchor")).select(*df.columns)


def merge_columns(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows and columns of both; where both have a column the new value counts unless it is null."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys], "full")
    pick = lambda c: F.coalesce(*(F.col(f"{s}.{c}") for s, df in (("n", new), ("o", old)) if c in df.columns)).alias(c)
    return joined.select(*(pick(c) for c in dict.fromkeys([*old.columns, *new.columns])))


def segment_join(df: DataFrame, segments: DataFrame, ts: str = "ts") -> DataFrame:
    """Every row once for each segment [start, end) that holds it; segments may overlap."""
    s = sized_broadcast(segments, 10_000)
    return df.join(s, (F.col(ts) >= F.col("seg_start")) & (F.col(ts) < F.col("seg_end")))


def timeframe_join(signals: DataFrame, fine: DataFrame, width: str) -> DataFrame:
    """Fine bars with the coarse bar that holds them."""
    inside = fine.withColumn("signal_ts", F.window("ts", width)["start"])
    coarse = signals.select("symbol", F.col("ts").alias("signal_ts"), F.col("close").alias("signal_close"))
    return inside.join(coarse, ["symbol", "signal_ts"])


def inject_scores(df: DataFrame, scores: DataFrame) -> DataFrame:
    """score_long and score_short of the same symbol and time; it is an error if scores lack them."""
    missing = {"symbol", "ts", "score_long", "score_short"} - set(scores.columns)
    if missing:
        raise ValueError(f"scores lack {sorted(missing)}")
    return df.join(scores.select("symbol", "ts", "score_long", "score_short"), ["symbol", "ts"], "left")


def overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(b, keys, "left_semi")


def exclusive(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(b, keys, "left_anti")


def position_key(symbol: Column, amount: Column) -> Column:
    """SYMBOL:long or SYMBOL:short by the sign of an amount written as text; null for none."""
    n = amount.try_cast("double")
    return F.when(n > 0, F.concat(F.upper(F.trim(symbol)), F.lit(":long"))).when(n < 0, F.concat(F.upper(F.trim(symbol)), F.lit(":short")))


def new_positions(before: DataFrame, now: DataFrame) -> DataFrame:
    """Keys of positions that are open now and were not before."""
    keys = lambda df: df.select(position_key(F.col("symbol"), F.col("amount")).alias("key")).where("key is not null").distinct()
    return keys(now).join(keys(before), "key", "left_anti")


def variant_grid(variants: DataFrame, segments: DataFrame) -> DataFrame:
    """Every variant with every segment: two short parameter tables, so the product is short too."""
    return variants.join(sized_broadcast(segments, 10_000), F.lit(True))


def against_baseline(current: DataFrame, baseline: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A statistic with its stored baseline and their difference; a missing baseline stays null."""
    return current.join(baseline.withColumnRenamed(value, "baseline"), keys, "left").withColumn("change", F.col(value) - F.col("baseline"))


def join_same(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """left and right on equal keys, null being equal to null; without keys, left with right's one row."""
    if not by:
        return left.join(F.broadcast(right))
    other = right.select(*(F.col(c).alias(f"_same_{c}") if c in by else F.col(c) for c in right.columns))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_same_{c}")) for c in by))
    return left.join(other, same, how).drop(*(f"_same_{c}" for c in by))
