"""Greedy spacing of signals: each is kept if the last kept one has ended; by pointer doubling, without a list of a symbol's signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.joins import asof_join
from tidemark.operators.windows import order
from tidemark.session import cut


def _backwards(ts: Column) -> Column:
    """A time that falls as ts rises, so that the first row after a time is the last one before it."""
    return F.timestamp_micros(-F.unix_micros(ts))


def spaced(df: DataFrame, free_at: Column, by: list[str] | None = None) -> DataFrame:
    """symbol, `by`, ts of the signals kept: a symbol's first, then always the first one later than the last kept and not before its free_at.

    Signals of one symbol, `by` and time are one signal, with the latest free_at. Each signal points to the one that
    would follow it; pointers are squared round by round, and what the kept ones reach doubles, so the rounds are the
    logarithm of the longest chain and every round is two joins on unique keys. Signals without symbol or time are
    dropped.
    """
    keys = ["symbol", *(by or [])]
    times = df.where(F.col("symbol").isNotNull() & F.col("ts").isNotNull())
    times = times.groupBy(*keys, F.col("ts").cast("timestamp").alias("ts")).agg(F.max(free_at.cast("timestamp")).alias("_free"))
    times = cut(times.withColumn("_free", F.greatest("_free", F.col("ts") + F.expr("interval 1 microsecond"))))
    # all of a symbol's times for each combination of `by`: the same times, where `by` only changes free_at
    signals = times.select(F.struct(*keys).alias("_key"), "ts", "_free").withColumn("_by", F.to_json("_key"))
    later = signals.select("_by", F.col("ts").alias("_next"), _backwards(F.col("ts")).alias("_at"))
    pointers = asof_join(signals.select("_by", "_key", "ts", _backwards(F.col("_free")).alias("_at")), later, "_by", "_at", ["_next"], slot_seconds=86_400)
    jump = cut(pointers.where("_next is not null").select("_by", F.col("ts").alias("_from"), F.col("_next").alias("_to")))
    kept = cut(signals.groupBy("_by").agg(F.min("ts").alias("ts")))
    while not jump.isEmpty():
        reached = kept.join(jump.withColumnRenamed("_from", "ts"), ["_by", "ts"]).select("_by", F.col("_to").alias("ts"))
        kept = cut(kept.unionByName(reached))
        onward = jump.select("_by", F.col("_from").alias("_to"), F.col("_to").alias("_then"))
        jump = cut(jump.join(onward, ["_by", "_to"]).select("_by", "_from", F.col("_then").alias("_to")))
    return signals.select("_by", "_key", "ts").join(kept, ["_by", "ts"]).select("_key.*", "ts")


def min_interval(df: DataFrame, minutes: int) -> DataFrame:
    """symbol, ts of signals at least so many minutes after the last kept one."""
    return spaced(df, F.col("ts") + F.expr(f"interval {minutes} minutes"))


def interval_sweep(df: DataFrame, grid: list[int], value: str) -> DataFrame:
    """For each minimum interval of a grid: signals kept, and the mean of their value; `selected` has the highest mean, the shortest of equal ones.

    Signals of one symbol and time count with their mean value.
    """
    asked = df.select("symbol", "ts", F.explode(F.array(*map(F.lit, grid))).alias("minutes"))
    kept = spaced(asked, F.col("ts") + F.make_dt_interval(mins=F.col("minutes")), ["minutes"])
    worth = df.groupBy("symbol", F.col("ts").cast("timestamp").alias("ts")).agg(F.avg(value).alias("_v"))
    got = kept.join(worth, ["symbol", "ts"]).groupBy("minutes").agg(F.count("*").alias("kept"), F.avg("_v").alias("mean_value"))
    best = got.agg(F.min_by("minutes", F.struct(-F.coalesce("mean_value", F.lit(float("-inf"))), F.col("minutes"))).alias("_best"))
    return got.join(F.broadcast(best)).withColumn("selected", F.col("minutes") == F.col("_best")).drop("_best")


def non_overlap(bars: DataFrame, signal: Column, hold: int, minutes_per_bar: int, fee_bps: float) -> DataFrame:
    """symbol, ts of signals after the last kept one has ended, `hold` bars later, with their return over those bars before and after a round trip's fee; null without that many bars."""
    rows = bars.select("symbol", F.col("ts").cast("timestamp").alias("ts"), (F.lead("close", hold).over(order()) / F.col("close") - 1).alias("gross"), signal.alias("_signal"))
    rows = cut(rows.where("_signal").select("symbol", "ts", "gross"))
    kept = spaced(rows, F.col("ts") + F.expr(f"interval {hold * minutes_per_bar} minutes"))
    return rows.join(kept, ["symbol", "ts"]).withColumn("net", F.col("gross") - fee_bps / 1e4)
