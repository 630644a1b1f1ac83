"""Bars from ticks and from finer bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tick_bars(ticks: DataFrame, width: str) -> DataFrame:
    """Open, high, low, close, volume, signed flow and number of ticks of each symbol and window.

    Partial aggregates run before the shuffle, so a hot symbol costs one row per window and task.
    """
    order = F.struct("ts", "tick_id")
    grouped = ticks.groupBy("symbol", F.window("ts", width).alias("_w")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"),
        F.sum("qty").alias("volume"), F.sum(F.col("qty") * F.col("side")).alias("flow"), F.count("*").alias("n"),
    )
    return grouped.select("symbol", F.col("_w.start").alias("ts"), "open", "high", "low", "close", "volume", "flow", "n")


def resample(bars: DataFrame, width: str) -> DataFrame:
    """Coarser bars from finer ones."""
    grouped = bars.groupBy("symbol", F.window("ts", width).alias("_w")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"),
        F.sum("volume").alias("volume"), F.sum("flow").alias("flow"), F.sum("n").alias("n"),
    )
    return grouped.select("symbol", F.col("_w.start").alias("ts"), "open", "high", "low", "close", "volume", "flow", "n")


def bars_bounds(bars: DataFrame) -> DataFrame:
    """First and last time and number of rows of each symbol."""
    return bars.groupBy("symbol").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n_rows"))
