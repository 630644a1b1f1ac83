"""Order-flow features from ticks and auxiliary series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.joins import asof_join
from tidemark.operators.prefix import group_key
from tidemark.operators.windows import lag, order, over, zscore
from tidemark.session import sized_broadcast


def cvd(bars: DataFrame, n: int = 20) -> DataFrame:
    """Cumulative signed volume, its change over five bars and its sum over n bars."""
    df = bars.withColumn("cvd", F.sum("flow").over(order().rowsBetween(Window.unboundedPreceding, 0)))
    return df.withColumn("cvd_change_5", F.col("cvd") - lag("cvd", 5)).withColumn("cvd_roll", F.sum("flow").over(over(n)))


def vpin(ticks: DataFrame, bucket_volume: float, n: int = 20) -> DataFrame:
    """Mean over n equal-volume buckets of |buys - sells| / volume; a tick belongs to the bucket in which it ends.

    Volume runs within an hour of a symbol and is set upon that of the hours before: hourly sums are a row an hour and
    task before they are shuffled, and go out by broadcast where they are few, so ticks are shuffled once.
    """
    rows = ticks.select("ts", "tick_id", "qty", "side", group_key(["symbol"]).alias("_group"), F.date_trunc("hour", "ts").alias("_hour")).where("ts is not null")
    hours = rows.groupBy("_group", "_hour").agg(F.sum("qty").alias("_volume"))
    before = Window.partitionBy("_group").orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.select("_group", "_hour", F.coalesce(F.sum("_volume").over(before), F.lit(0.0)).alias("_base"))
    w = Window.partitionBy("_group", "_hour").orderBy("ts", "tick_id").rowsBetween(Window.unboundedPreceding, 0)
    volume = F.col("_base") + F.coalesce(F.col("_run"), F.lit(0.0))
    rows = rows.withColumn("_run", F.sum("qty").over(w)).join(sized_broadcast(hours), ["_group", "_hour"]).withColumn("bucket", F.floor((volume - F.lit(1e-9)) / bucket_volume))
    buckets = rows.groupBy("_group", "bucket").agg(F.max("ts").alias("ts"), F.abs(F.sum(F.col("qty") * F.col("side"))).alias("_gap"), F.sum("qty").alias("_all"))
    run = Window.partitionBy("_group").orderBy("bucket").rowsBetween(1 - n, 0)
    return buckets.withColumn("vpin", F.when(F.count("*").over(run) == n, F.avg(F.col("_gap") / F.nullif("_all", F.lit(0.0))).over(run))).select("_group.symbol", "bucket", "ts", "vpin")


def ofi(bars: DataFrame, n: int = 5) -> DataFrame:
    return bars.withColumn("ofi", F.sum("flow").over(over(n)) / F.nullif(F.sum("volume").over(over(n)), F.lit(0.0)))


def trade_runs(ticks: DataFrame, width: str = "2 hours") -> DataFrame:
    """Per bar: runs of ticks of one side, their longest of each side, net number, and the entropy of their sides."""
    rows = ticks.withColumn("_w", F.window("ts", width)["start"])
    w = Window.partitionBy("symbol", "_w").orderBy("ts", "tick_id")
    rows = rows.withColumn("_new", F.when(F.col("side") == F.lag("side").over(w), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy("symbol", "_w", "_run").agg(F.first("side").alias("side"), F.count("*").alias("len"))
    got = runs.groupBy("symbol", F.col("_w").alias("ts")).agg(
        F.coalesce(F.max(F.when(F.col("side") > 0, F.col("len"))), F.lit(0)).alias("max_buy_run"), F.coalesce(F.max(F.when(F.col("side") < 0, F.col("len"))), F.lit(0)).alias("max_sell_run"),
        F.sum("side").alias("net_runs"), F.count("*").alias("n_runs"), F.sum(F.when(F.col("side") > 0, F.col("len")).otherwise(0)).alias("_b"), F.sum("len").alias("_n"),
    )
    p = F.col("_b") / F.col("_n")
    return got.withColumn("run_entropy", F.when((p > 0) & (p < 1), -(p * F.log(p) + (1 - p) * F.log(1 - p))).otherwise(0.0)).drop("_b", "_n")


def footprint(ticks: DataFrame, width: str = "2 hours", price_step: float = 10.0) -> DataFrame:
    """Largest share of one side's surplus over a price level's volume, per bar."""
    levels = ticks.groupBy("symbol", F.window("ts", width)["start"].alias("ts"), F.floor(F.col("price") / price_step).alias("level")).agg(F.sum(F.when(F.col("side") > 0, F.col("qty")).otherwise(0.0)).alias("_b"), F.sum("qty").alias("_all"))
    share = F.abs(2 * F.col("_b") - F.col("_all")) / F.nullif("_all", F.lit(0.0))
    return levels.groupBy("symbol", "ts").agg(F.max(share).alias("fp_max_imbalance"), F.count("*").alias("fp_levels"))


def volume_profile(ticks: DataFrame, width: str = "1 day", price_step: float = 10.0, area: float = 0.7) -> DataFrame:
    """Level of the most volume (the lowest of equal ones), edges of the fewest levels, by volume, that hold `area` of it, and the levels of at least mean volume, in order."""
    levels = ticks.groupBy("symbol", F.window("ts", width)["start"].alias("ts"), F.floor(F.col("price") / price_step).alias("level")).agg(F.sum("qty").alias("v"))
    by = Window.partitionBy("symbol", "ts")
    run = F.sum("v").over(by.orderBy(F.desc("v"), "level").rowsBetween(Window.unboundedPreceding, 0))
    inside = F.col("_run") - F.col("v") < area * F.col("_all")
    rows = levels.withColumn("_run", run).withColumn("_all", F.sum("v").over(by)).withColumn("_mean", F.avg("v").over(by))
    mid = lambda c: (c + 0.5) * price_step
    return rows.groupBy("symbol", "ts").agg(
        mid(F.max_by("level", F.struct(F.col("v"), -F.col("level")))).alias("poc"), mid(F.min(F.when(inside, F.col("level")))).alias("value_low"), mid(F.max(F.when(inside, F.col("level")))).alias("value_high"),
        F.array_sort(F.collect_list(F.when(F.col("v") >= F.col("_mean"), mid(F.col("level"))))).alias("levels"),
    )


def nearest_gap(levels: Column, price: Column) -> Column:
    """Distance of a price to the nearest of an ascending array of levels, by halving the array; null without levels or price."""
    start = F.struct(F.lit(0).alias("lo"), F.size(levels).alias("hi"))

    def halve(at: Column, _: Column) -> Column:
        middle = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
        higher = F.get(levels, middle) < price
        moved = F.struct(F.when(higher, middle + 1).otherwise(at["lo"]).alias("lo"), F.when(higher, at["hi"]).otherwise(middle).alias("hi"))
        return F.when(at["lo"] < at["hi"], moved).otherwise(at)

    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(levels) + 1)).cast("int"))
    first = F.aggregate(rounds, start, halve)["lo"]  # place of the first level that is not below the price
    gap = F.least(F.abs(F.get(levels, first) - price), F.abs(price - F.get(levels, F.when(first > 0, first - 1))))
    return F.when((F.size(levels) > 0) & price.isNotNull(), gap)


def dist_to_nearest_sr(bars: DataFrame, profiles: DataFrame, width: str = "1 day") -> DataFrame:
    """Distance, as a share of the close, to the nearest level of the symbol's last profile that had ended when the bar began; null before the first."""
    ended = profiles.select("symbol", (F.col("ts") + F.expr(f"interval {width}")).alias("ts"), "levels")
    joined = asof_join(bars, ended, "symbol", "ts", ["levels"], slot_seconds=86_400)
    return joined.withColumn("dist_to_nearest_sr", nearest_gap(F.col("levels"), F.col("close")) / F.nullif("close", F.lit(0.0))).drop("levels")


def oi_funding(df: DataFrame, oi: str, funding: str, n: int = 50) -> DataFrame:
    """Change and z-score of open interest, and crowding: the product of both series' z-scores."""
    df = zscore(zscore(df, oi, n, "oi_zscore"), funding, n, "funding_zscore")
    return df.withColumn("oi_change", F.col(oi) / F.nullif(lag(oi), F.lit(0.0)) - 1).withColumn("crowding", F.col("oi_zscore") * F.col("funding_zscore"))


def liquidation_proxy(df: DataFrame, oi: str, n: int = 50) -> DataFrame:
    """Product of the positive parts of the z-scores of absolute return, volume and falling open interest."""
    df = df.withColumn("_a", F.abs(F.log(F.col("close") / lag("close")))).withColumn("_d", lag(oi) - F.col(oi))
    for c, o in (("_a", "_za"), ("volume", "_zv"), ("_d", "_zd")):
        df = zscore(df, c, n, o)
    part = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(0.0))
    return df.withColumn("liq_proxy", part("_za") * part("_zv") * part("_zd")).drop("_a", "_d", "_za", "_zv", "_zd")


def wall(bars: DataFrame, depth: DataFrame, times: float = 3.0) -> DataFrame:
    """Distance in ATR from the close to the nearest level (ts, level, size of depth) that holds `times` the mean size of its bar."""
    mean = Window.partitionBy("symbol", "ts")
    walls = depth.withColumn("_m", F.avg("size").over(mean)).where(F.col("size") >= times * F.col("_m")).groupBy("symbol", "ts").agg(F.array_sort(F.collect_list("level")).alias("_walls"))
    joined = bars.join(walls, ["symbol", "ts"], "left")
    return joined.select("symbol", "ts", (nearest_gap(F.col("_walls"), F.col("close")) / F.nullif("atr", F.lit(0.0))).alias("wall_nearest_dist_atr"))


def divergence(df: DataFrame, n: int = 50) -> DataFrame:
    """-1..1: how far price and signed volume disagree, by the signs and the smaller of their z-scores."""
    df = df.withColumn("_p", F.col("close") - lag("close", 5)).withColumn("_c", F.col("cvd") - lag("cvd", 5))
    df = zscore(zscore(df, "_p", n, "_zp"), "_c", n, "_zc")
    apart = (F.signum("_zp") * F.signum("_zc")) < 0
    return df.withColumn("cvd_divergence", F.when(apart, F.signum("_zc") * F.least(F.lit(1.0), F.least(F.abs("_zp"), F.abs("_zc")))).otherwise(0.0)).drop("_p", "_c", "_zp", "_zc")


def normalized_flow(df: DataFrame, n: int = 50) -> DataFrame:
    """Signed flow of n bars over the mean turnover of n bars."""
    turnover = F.avg(F.col("volume") * F.col("close")).over(over(n))
    return df.withColumn("normalized_flow", F.sum(F.col("flow") * F.col("close")).over(over(n)) / F.nullif(turnover, F.lit(0.0)))
