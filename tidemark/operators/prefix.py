"""Running sums, ranks and quantiles of groups of any size, without a window or a list over a whole group.

Rows are first counted by distinct value, so that ties cost one row; the distinct values are dealt by ranges of
(group, value), and only a row for each range and group is carried from range to range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.joins import join_same
from tidemark.session import cut, sized_broadcast

#: Groups of at most so many rows are bracketed whole; approximate ranks are within a ten-thousandth.
SMALL, MARGIN = 10_000, 4e-4


def group_key(by: list[str]) -> Column:
    """One column that is equal where all of `by` are, null being equal to null."""
    return F.struct(*by) if by else F.lit(0)


def running(df: DataFrame, by: list[str], order: list[str], values: list[str], parts: int | None = None) -> DataFrame:
    """df with, for each value v, v_before (its sum over the group's rows before this one) and v_total; sums of nothing are 0.

    Rows of a group should differ in `order`. Ranges follow the order of (by, order), so a group's sums before a
    range are those of its ranges before; these are as many rows as there are ranges and groups.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(parts, *by, *order).withColumn("_range", F.spark_partition_id()))
    keyed = ranged.withColumn("_group", group_key(by))
    group = Window.partitionBy("_group")
    sums = keyed.groupBy("_group", "_range").agg(*(F.coalesce(F.sum(v), F.lit(0)).alias(v) for v in values))
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("_group", "_range", *(F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_{v}_carried") for v in values), *(F.sum(v).over(group).alias(f"{v}_total") for v in values))
    inside = Window.partitionBy("_group", "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = keyed.select("*", *(F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"{v}_before") for v in values))
    joined = rows.join(carried, ["_group", "_range"])  # rows are already dealt and sorted so
    for v in values:
        joined = joined.withColumn(f"{v}_before", F.col(f"{v}_before") + F.col(f"_{v}_carried"))
    return joined.drop("_group", "_range", *(f"_{v}_carried" for v in values))


def lookup(rows: DataFrame, found: DataFrame, keys: list[str], count: str, most: int = 10_000, total: int | None = None) -> DataFrame:
    """rows, each with the row of `found` (one for each combination of keys in rows, with its number of rows in `count`).

    Combinations with more than 1 / most of the rows are at most `most`: they go out by broadcast, and their rows stay
    where they are; the others meet by shuffle, where each brings few rows. rows are read twice, so cut them before.
    """
    if total is None:
        total = found.agg(F.sum(count)).first()[0] or 0
    edge = total // most
    frequent = F.broadcast(found.where(F.col(count) > edge).drop(count))
    near = join_same(rows, frequent, keys)
    if not edge:  # all are
        return near
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    far = rows.alias("l").join(frequent.alias("r"), same, "left_anti")
    return near.unionByName(join_same(far, found.where(F.col(count) <= edge).drop(count), keys))


def group_quantiles(df: DataFrame, by: list[str], value: str | Column, qs: list[float], out: str = "q") -> DataFrame:
    """by and an array of the exact quantiles qs of a value, with linear interpolation, for every group of df.

    An approximate percentile brackets each place (a group of at most SMALL rows is its own bracket); rows below a
    bracket are counted, and only distinct values inside it are put in order. Null and NaN are no values, infinities
    are the smallest and largest; the quantiles of a group without values are null.
    """
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    rows = df.select(*by, F.when(~F.isnan(x), x).alias("_x"))
    asked = [min(1.0, max(0.0, q + side * MARGIN)) for q in qs for side in (-1, 1)]
    told = cut(rows.groupBy(*by).agg(F.count("_x").alias("_rows"), F.percentile_approx("_x", F.array(*map(F.lit, asked)), 10_000).alias("_edges")))
    spans = F.array(*(F.struct(F.lit(i).alias("i"), F.col("_edges")[2 * i].alias("a"), F.col("_edges")[2 * i + 1].alias("z")) for i in range(len(qs))))
    bracketed = join_same(rows.where("_x is not null"), sized_broadcast(told), by).select(*by, "_x", "_rows", F.explode(spans).alias("_s"))
    inside = (F.col("_rows") <= SMALL) | F.col("_x").between(F.col("_s.a"), F.col("_s.z"))
    below = F.when(inside, F.col("_x"))  # null for rows below the bracket, which nulls first puts before it
    counted = bracketed.where(inside | (F.col("_x") < F.col("_s.a"))).groupBy(*by, F.col("_s.i").alias("_i"), below.alias("_x")).agg(F.count("*").alias("_n"))
    placed = join_same(running(counted, [*by, "_i"], ["_x"], ["_n"]).where("_x is not null"), sized_broadcast(told.select(*by, "_rows")), by)
    wanted = F.element_at(F.array(*map(F.lit, qs)), F.col("_i") + 1) * (F.col("_rows") - 1)
    holds = lambda k: (F.col("_n_before") <= k) & (k < F.col("_n_before") + F.col("_n"))
    low = F.max(F.when(holds(F.floor(wanted)), F.col("_x")))
    high = F.max(F.when(holds(F.ceil(wanted)), F.col("_x")))
    share = F.max(wanted - F.floor(wanted))
    picked = placed.groupBy(*by, "_i").agg(low.alias("_low"), high.alias("_high"), share.alias("_f"))
    missed = F.col("_low").isNull() | F.col("_high").isNull()
    between = F.when(missed, F.raise_error(F.lit("a bracket missed its quantile")).cast("double")).when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(F.col("_low") * (1 - F.col("_f")) + F.col("_high") * F.col("_f"))
    lists = picked.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_i", between.alias("v")))).alias("_m"))
    every = join_same(told.select(*by), lists, by, "left")
    return every.select(*by, F.array(*(F.element_at("_m", F.lit(i)) for i in range(len(qs)))).alias(out))


def with_average_rank(df: DataFrame, value: str, by: list[str], out: str) -> DataFrame:
    """Rank of a value in its group, ties sharing the mean of their places; null ranks first, NaN last, as Spark orders them."""
    rows = cut(df)
    counts = running(rows.groupBy(*by, value).agg(F.count("*").alias("_n")), by, [value], ["_n"])
    ranks = counts.select(*by, value, "_n", (F.col("_n_before") + (F.col("_n") + 1) / 2).alias(out))
    return lookup(rows, ranks, [*by, value], "_n")
