"""Statistics of scans: rates inside and outside conditions, thresholds, information coefficients, drift."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.joins import join_same
from tidemark.operators.prefix import group_quantiles, lookup, running
from tidemark.session import cut, sized_broadcast


def two_prop_z(p1: Column, n1: Column, p2: Column, n2: Column, least: int = 5) -> Column:
    """Absolute z of two proportions with pooled variance; 0 for few rows or no variance."""
    pooled = (p1 * n1 + p2 * n2) / (n1 + n2)
    variance = pooled * (1 - pooled) * (1 / n1 + 1 / n2)
    enough = (n1 >= least) & (n2 >= least) & (variance > 0)
    return F.when(enough, F.abs(p1 - p2) / F.sqrt(variance)).otherwise(0.0)


def lift(good: Column, bad: Column) -> Column:
    """good / bad - 1; for bad <= 0 infinity, or 0 if good is not positive either."""
    return F.when(bad > 0, good / F.nullif(bad, F.lit(0.0)) - 1).when(good > 0, float("inf")).otherwise(0.0)


def exact_quantiles(df: DataFrame, value: str, qs: list[float]) -> list[float | None]:
    """Quantiles with linear interpolation, exact at any size; null and NaN are no values, None without values."""
    found = group_quantiles(df, [], value, qs).first()
    return list(found["q"]) if found else [None] * len(qs)


def correlation(a: str, b: str) -> Column:
    """Pearson correlation of two columns without nulls; null where either does not vary."""
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def rank_ic(df: DataFrame, feature: str, target: str, *by: str) -> DataFrame:
    """Spearman correlation of feature and target and the number of pairs, per group `by`; pairs with a null are left out.

    Equal pairs are counted first, and values (as doubles) are ranked by their counts, so a value that fills a group
    costs a row; both sides are ranked at once.
    """
    number = lambda c, name: F.col(c).cast("double").alias(name)
    both = df.where(F.col(feature).isNotNull() & F.col(target).isNotNull()).select(*by, number(feature, "_x"), number(target, "_y"))
    pairs = cut(both.groupBy(*by, "_x", "_y").agg(F.count("*").alias("_w")))
    sides = pairs.select(*by, "_w", F.explode(F.array(*(F.struct(F.lit(k).alias("side"), F.col(c).alias("v")) for k, c in enumerate(("_x", "_y"))))).alias("_s"))
    counts = sides.groupBy(*by, F.col("_s.side").alias("_side"), F.col("_s.v").alias("_v")).agg(F.sum("_w").alias("_n"), F.count("*").alias("_k"))
    centred = F.col("_n_before") + (F.col("_n") - F.col("_n_total")) / 2  # the mean of all ranks is (total + 1) / 2
    ranks = cut(running(counts, [*by, "_side"], ["_v"], ["_n"]).select(*by, "_side", "_v", "_k", centred.alias("_rank")))
    total = pairs.count()
    for side, (value, out) in enumerate((("_x", "_f"), ("_y", "_t"))):
        mine = ranks.where(F.col("_side") == side).select(*by, F.col("_v").alias(value), "_k", F.col("_rank").alias(out))
        pairs = lookup(pairs, mine, [*by, value], "_k", total=total)
    sums = pairs.groupBy(*by).agg(F.sum(F.col("_w") * F.col("_f") * F.col("_t")).alias("_c"), F.sum(F.col("_w") * F.col("_f") * F.col("_f")).alias("_v"), F.sum(F.col("_w") * F.col("_t") * F.col("_t")).alias("_u"), F.sum("_w").alias("n"))
    return sums.select(*by, (F.col("_c") / F.nullif(F.sqrt("_v") * F.sqrt("_u"), F.lit(0.0))).alias("ic"), "n")


def ic_decay(df: DataFrame, features: list[str], horizons: list[int], target: str) -> DataFrame:
    """Rank IC of every feature with the target h bars ahead of the same symbol."""
    w = Window.partitionBy("symbol").orderBy("ts")
    ahead = df.select(*features, F.array(*(F.lead(target, h).over(w) for h in horizons)).alias("_ahead"))
    long = ahead.select(*features, F.posexplode("_ahead").alias("_h", "_target")).unpivot(["_h", "_target"], features, "feature", "value")
    at = F.create_map(*(F.lit(x) for i, h in enumerate(horizons) for x in (i, h)))
    long = long.withColumn("horizon", at[F.col("_h")])
    return rank_ic(long, "value", "_target", "feature", "horizon").withColumn("target", F.concat(F.lit(f"{target}_shift_"), F.col("horizon").cast("string"))).withColumn("shifted", F.lit(True))


def ic_screen(ic: DataFrame, lags: list[int], reject: int, min_ic: float, min_n: int, top: int = 20) -> DataFrame:
    """Features whose absolute IC peaks at an allowed lag, high enough, on enough rows."""
    peak = ic.groupBy("feature").agg(F.max_by(F.struct("horizon", "ic", "n"), F.struct(F.abs("ic"), -F.col("horizon"))).alias("p")).select("feature", "p.horizon", "p.ic", "p.n")
    kept = peak.where(F.col("horizon").isin(lags) & (F.col("horizon") != reject) & (F.abs("ic") >= min_ic) & (F.col("n") >= min_n))
    return kept.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.abs("ic")), "feature"))).where(F.col("place") <= top)


def condition_set(df: DataFrame, label: str, base: Column, conditions: dict[str, Column], bucket: Column | None = None) -> DataFrame:
    """For each condition, the label's rate inside and outside it, their difference in points and z: one pass over df."""
    rows = df.where(base).where(F.col(label).isNotNull()).withColumn("bucket", bucket if bucket is not None else F.lit("all"))
    flags = rows.select(F.col(label).cast("double").alias("_y"), "bucket", F.explode(F.array(*(F.struct(F.lit(n).alias("condition"), F.coalesce(c, F.lit(False)).alias("inside")) for n, c in conditions.items()))).alias("c"))
    inside = F.col("c.inside")
    got = flags.groupBy(F.col("c.condition").alias("condition"), "bucket").agg(
        F.avg(F.when(inside, F.col("_y"))).alias("p_in"), F.count(F.when(inside, 1)).alias("n_in"), F.avg(F.when(~inside, F.col("_y"))).alias("p_out"), F.count(F.when(~inside, 1)).alias("n_out")
    )
    return got.withColumn("delta_pp", 100 * (F.col("p_in") - F.col("p_out"))).withColumn("z", two_prop_z(F.col("p_in"), F.col("n_in"), F.col("p_out"), F.col("n_out")))


def plateau(df: DataFrame, feature: str, operator: str, grid: list[float], label: str) -> DataFrame:
    """condition_set for every threshold of a grid; the recommended one has the largest z (the smallest of equal ones)."""
    conditions = {f"{t!r}": F.col(feature) >= t if operator == ">=" else F.col(feature) <= t for t in grid}
    got = condition_set(df, label, F.lit(True), conditions).withColumn("threshold", F.col("condition").cast("double")).drop("condition", "bucket")
    best = got.agg(F.min_by("threshold", F.struct(-F.col("z"), F.col("threshold"))).alias("best"))
    return got.join(F.broadcast(best)).withColumn("recommended", F.col("threshold") == F.col("best")).drop("best")


def gate_score(deny: Column, good: Column) -> Column:
    """Share of bad rows denied minus share of good rows denied."""
    d = deny.cast("double")
    return F.avg(F.when(~good, d)) - F.avg(F.when(good, d))


def grid(start: float, end: float, step: float) -> Column:
    """The array start, start + step, ... up to end."""
    return F.transform(F.sequence(F.lit(0), F.lit(math.floor((end - start) / step + 1e-9))), lambda i: F.lit(start) + i * F.lit(step))


def gate_plateau(df: DataFrame, feature: str, grid: list[float] | Column, good: Column) -> DataFrame:
    """Pass rates of good and bad rows, lift and gate score for each threshold (rows below it are denied)."""
    g = good.cast("double")
    thresholds = grid if isinstance(grid, Column) else F.array(*map(F.lit, grid))
    rows = df.where(F.col(feature).isNotNull()).select(F.col(feature).alias("_x"), g.alias("_g"), F.explode(thresholds).alias("threshold")).withColumn("_p", (F.col("_x") >= F.col("threshold")).cast("double"))
    is_good = F.col("_g") == 1
    got = rows.groupBy("threshold").agg(F.avg(F.when(is_good, F.col("_p"))).alias("pass_good"), F.avg(F.when(~is_good, F.col("_p"))).alias("pass_bad"))
    return got.withColumn("lift", lift(F.col("pass_good"), F.col("pass_bad"))).withColumn("gate_score", F.col("pass_good") - F.col("pass_bad"))


def threshold_means(df: DataFrame, feature: str, value: str, grid: list[float], least: int = 20) -> DataFrame:
    """Mean value and number of rows at or over each threshold, where there are enough."""
    rows = df.select(F.col(feature).alias("_x"), F.col(value).alias("_v"), F.explode(F.array(*map(F.lit, grid))).alias("threshold")).where("_x >= threshold")
    return rows.groupBy("threshold").agg(F.avg("_v").alias("mean_r"), F.count("*").alias("trades")).where(F.col("trades") >= least)


def tau_scan(df: DataFrame, score: str, value: str, qs: list[float]) -> DataFrame:
    """For each quantile of the score: the threshold, rows beyond it and their mean value."""
    edges = group_quantiles(df, [], score, qs).select(F.explode(F.arrays_zip(F.array(*map(F.lit, qs)).alias("q"), F.col("q").alias("threshold"))).alias("e")).select("e.q", "e.threshold")
    return df.select(score, value).where(~F.isnan(score)).join(F.broadcast(edges), F.col(score) >= F.col("threshold")).groupBy("q", "threshold").agg(F.count("*").alias("trades"), F.avg(value).alias("mean_r"))


def plateau_update(new: Column, last: Column) -> Column:
    """ADOPT without a last plateau or where both overlap by half of the new one, KEEP where equal, else ALERT; plateaus are structs lo, hi."""
    shared = F.least(new["hi"], last["hi"]) - F.greatest(new["lo"], last["lo"])
    return F.when(last.isNull(), "ADOPT").when((new["lo"] == last["lo"]) & (new["hi"] == last["hi"]), "KEEP").when(shared >= 0.5 * (new["hi"] - new["lo"]), "ADOPT").otherwise("ALERT")


def psi_features(current: DataFrame, reference: DataFrame, features: list[str], bins: int = 10, floor: float = 1e-6) -> DataFrame:
    """feature, psi: population stability index of each feature over its reference's quantile bins; null and NaN are in none.

    All features go through together: quantiles of all, then one count by feature and bin. A feature without reference
    values has one bin.
    """
    tall = lambda df, now: df.select(*(F.col(f).cast("double") for f in features)).unpivot([], features, "feature", "_x").where("_x is not null and not isnan(_x)").withColumn("_now", F.lit(now))
    edges = group_quantiles(tall(reference, 0), ["feature"], "_x", [i / bins for i in range(1, bins)], "_edges")
    both = tall(current, 1).unionByName(tall(reference, 0)).join(sized_broadcast(edges), "feature", "left")
    bin_ = F.size(F.filter(F.coalesce("_edges", F.array().cast("array<double>")), lambda e: e < F.col("_x")))
    counted = both.groupBy("feature", bin_.alias("_bin")).agg(F.sum("_now").alias("_a"), F.sum(1 - F.col("_now")).alias("_e"))
    every = Window.partitionBy("feature")
    share = lambda c: F.greatest(F.coalesce(F.col(c) / F.nullif(F.sum(c).over(every), F.lit(0)), F.lit(0.0)), F.lit(floor))
    placed = counted.withColumn("_p", share("_a")).withColumn("_q", share("_e"))
    return placed.groupBy("feature").agg(F.sum((F.col("_p") - F.col("_q")) * F.log(F.col("_p") / F.col("_q"))).alias("psi"))


def psi(current: DataFrame, reference: DataFrame, feature: str, bins: int = 10, floor: float = 1e-6) -> DataFrame:
    """The one row of psi_features() for one feature; null without values."""
    return psi_features(current, reference, [feature], bins, floor).agg(F.max("psi").alias("psi"))


def shares(df: DataFrame, column: str) -> DataFrame:
    total = df.agg(F.count("*").alias("_t"))
    return df.groupBy(column).agg(F.count("*").alias("_n")).join(F.broadcast(total)).select(column, (F.col("_n") / F.col("_t")).alias("share"))


def ks_distance(df: DataFrame, feature: str, label: str) -> DataFrame:
    """Largest distance of the distribution functions of rows with label 1 and 0."""
    counts = df.where(F.col(feature).isNotNull()).groupBy(F.col(feature).alias("_x")).agg(F.sum(F.col(label)).alias("_g"), F.sum(1 - F.col(label)).alias("_b"))
    share = lambda c: (F.col(f"{c}_before") + F.col(c)) / F.col(f"{c}_total")
    return running(counts, [], ["_x"], ["_g", "_b"]).agg(F.max(F.abs(share("_g") - share("_b"))).alias("ks"))


def eval_metrics(df: DataFrame, pred: str, target: str) -> DataFrame:
    """Accuracy of the signs, correlation, mean absolute error and rank IC per symbol."""
    plain = df.groupBy("symbol").agg(F.avg((F.signum(pred) == F.signum(target)).cast("double")).alias("accuracy"), correlation(pred, target).alias("pearson"), F.avg(F.abs(F.col(pred) - F.col(target))).alias("mae"))
    return join_same(plain, rank_ic(df, pred, target, "symbol").drop("n"), ["symbol"])
