"""Quantiles of all values before each row, by blocks of time and blocks of values.

A symbol of n values has about sqrt(n) blocks of time and as many blocks of its ordered values. The counts of the
pairs of blocks, summed over time and then over values, tell for each block of time which few blocks of values hold
the earlier values that its rows can ask for: within a block of time the place of a quantile moves by no more than
the block's rows. So a task gets a block's rows and some sqrt(n) earlier values, and never a whole series.
"""

from __future__ import annotations

import math
from bisect import insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.prefix import running
from tidemark.session import cut

#: Rows in a block of time, at least.
LEAST_BLOCK = 64


def _reach(q: float, first: int, size: int) -> tuple[int, int]:
    """The places among the `first` values before a block of `size` rows that quantiles of its rows can need."""
    return max(0, math.floor(q * (first - 1)) - size - 1), min(first - 1, math.ceil(q * (first + size)) + 1)


def block_quantiles(q: float, least: int, first: int, size: int, below: int, earlier: list[tuple[float, int]], values: list[float | None]) -> list[float | None]:
    """For each value of a block, the quantile of all values before it: `earlier` has (value, count) of those near the place, `below` is the number of the others under them."""
    low, high = _reach(q, first, size)
    held: list[float] = []
    at = below
    for x, n in sorted(earlier):
        a, z = max(at, low), min(at + n, high + 1)
        held += [x] * max(0, z - a)
        at += n
    start, seen = (max(below, low) if first else 0), first
    out: list[float | None] = []
    for x in values:
        if seen < max(least, 1):
            out.append(None)
        else:
            place = q * (seen - 1)
            a = held[math.floor(place) - start]
            b = held[math.ceil(place) - start]
            out.append(a if a == b else a + (b - a) * (place - math.floor(place)))
        if x is not None:
            insort(held, x)
            seen += 1
    return out


def expanding_quantile(df: DataFrame, c: str, q: float, least: int = 50, out: str = "threshold") -> DataFrame:
    """Interpolated quantile of all values of the symbol before now, from `least` of them on; null and NaN are no values, and rows without a symbol have none."""
    if not 0 <= q <= 1:
        raise ValueError("q lies within 0 and 1")
    x = F.col(c).cast("double")
    rows = df.withColumn("_x", F.when(~F.isnan(x), x)).withColumn("_one", F.col("_x").isNotNull().cast("long"))
    rows = running(rows, ["symbol"], ["ts"], ["_one"])
    size = F.greatest(F.lit(LEAST_BLOCK), F.ceil(F.sqrt(F.col("_one_total")))).cast("long")
    rows = cut(rows.withColumn("_size", size).withColumn("_time", F.floor(F.col("_one_before") / F.col("_size"))).withColumn("_row", F.monotonically_increasing_id()))
    held = rows.where("_x is not null").groupBy("symbol", "_size", "_x", "_time").agg(F.count("*").alias("_n"))
    ordered = running(held, ["symbol"], ["_x", "_time"], ["_n"])
    firsts = Window.partitionBy("symbol", "_x")  # blocks of time that share a value: at most one row each
    held = cut(ordered.withColumn("_block", F.floor(F.min("_n_before").over(firsts) / F.col("_size"))))

    blocks = rows.groupBy("symbol").agg(F.max("_time").alias("_last"))
    cells = held.groupBy("symbol", "_size", "_block", "_time").agg(F.sum("_n").alias("_n")).join(blocks, "symbol")
    by_time = Window.partitionBy("symbol", "_block").orderBy("_time")
    until = F.coalesce(F.lead("_time").over(by_time), F.col("_last"))
    so_far = F.sum("_n").over(by_time.rowsBetween(Window.unboundedPreceding, 0))
    grid = cells.select("symbol", "_size", "_block", so_far.alias("_n"), F.when(F.col("_time") < until, F.sequence(F.col("_time") + 1, until)).alias("_at"))
    grid = grid.select("symbol", "_size", "_block", "_n", F.explode("_at").alias("_at"))
    under = F.coalesce(F.sum("_n").over(Window.partitionBy("symbol", "_at").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = F.col("_at") * F.col("_size")
    low, high = F.floor(q * (first - 1)) - F.col("_size") - 1, F.ceil(q * (first + F.col("_size"))) + 1
    wanted = grid.withColumn("_under", under).where((F.col("_under") <= high) & (F.col("_under") + F.col("_n") > low)).select("symbol", "_block", "_at", "_under")
    near = held.select("symbol", "_block", "_time", "_x", "_n").join(wanted, ["symbol", "_block"]).where("_time < _at")
    near = near.groupBy(F.col("symbol").alias("_owner"), "_at", F.col("_x").alias("_value")).agg(F.sum("_n").alias("_n"), F.min("_under").alias("_under"))

    def of_block(key: tuple, own: pd.DataFrame, earlier: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["_one_before", "ts"])
        size_ = int(own["_size"].iloc[0])
        below = int(earlier["_under"].min()) if len(earlier) else 0
        got = block_quantiles(q, least, int(key[1]) * size_, size_, below, list(zip(earlier["_value"], earlier["_n"])), [None if math.isnan(v) else v for v in own["_x"]])
        return pd.DataFrame({"_row": own["_row"], out: np.array(got, dtype=float)})

    told = rows.where("symbol is not null").select("symbol", "_time", "_row", "ts", "_x", "_one_before", "_size").groupBy("symbol", "_time").cogroup(near.groupBy("_owner", "_at")).applyInPandas(of_block, f"_row long, {out} double")
    told = told.withColumn(out, F.when(~F.isnan(out), F.col(out)))
    return rows.join(told, "_row", "left").select(*df.columns, out)
