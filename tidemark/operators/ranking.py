"""Top quantiles, priorities, latest rows, downsampling, schedules, and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.statistics import exact_quantiles


def top_quantile(df: DataFrame, score: str, q: float) -> DataFrame:
    """Rows at or over the 1 - q quantile of a score; those without a score (null or NaN) are not."""
    return df.where((F.col(score) >= F.lit(exact_quantiles(df, score, [1 - q])[0])) & ~F.isnan(score))


def top_features(ic: DataFrame, n: int, always: list[str]) -> DataFrame:
    """The n features of the largest absolute IC, and those always wanted."""
    best = ic.orderBy(F.desc(F.abs("ic")), "feature").limit(n)
    return best.unionByName(ic.where(F.col("feature").isin(always)).join(best.select("feature"), "feature", "left_anti"))


def rule_priority(rules: DataFrame, classes: DataFrame, overrides: DataFrame) -> DataFrame:
    """Rules with their priority: an override of their archetype, else their class."""
    joined = rules.join(classes, "rule_class", "left").join(overrides, ["archetype", "rule_id"], "left")
    return joined.withColumn("priority", F.coalesce("override", "class_priority"))


def latest(df: DataFrame, order: list[str], n: int) -> DataFrame:
    return df.orderBy(*(F.desc(c) for c in order)).limit(n)


def downsample(df: DataFrame, by: str, order: str, most: int) -> DataFrame:
    """Every k-th row of each series, so that at most `most` stay."""
    w = Window.partitionBy(by)
    rows = df.withColumn("_k", F.row_number().over(w.orderBy(order)) - 1).withColumn("_s", F.ceil(F.count("*").over(w) / most))
    return rows.where("_k % _s = 0").drop("_k", "_s")


def schedule_index(months: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted months (pos, month), once each and in their order, with their index in the full list; unknown ones are an error."""
    unknown = wanted.join(months, "month", "left_anti").limit(5).collect()
    if unknown:
        raise ValueError(f"unknown months: {sorted(r['month'] for r in unknown)}")
    first = wanted.groupBy("month").agg(F.min("pos").alias("request"))
    return first.join(months, "month").select("request", "index", "month")


def union_markers(frames: dict[str, DataFrame], symbols: Column, scopes: list[str]) -> DataFrame:
    """Markers of several ledgers with their scope; columns that one lacks are null."""
    out = None
    for scope, df in frames.items():
        if scope in scopes:
            part = df.where(symbols).withColumn("scope", F.lit(scope))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def rules_merge(first: DataFrame, second: DataFrame) -> DataFrame:
    """Locked rules of the first source in their order, then the unlocked ones of the second."""
    a = first.where("locked").withColumn("source_order", F.lit(0))
    return a.unionByName(second.where("not locked").withColumn("source_order", F.lit(1)))


def mode_class(names: Column) -> Column:
    """spot for the names of spot strategies, else trend."""
    return F.when(F.arrays_overlap(names, F.array(F.lit("spot_accum"), F.lit("spot_accum_simple"))), "spot").otherwise("trend")
