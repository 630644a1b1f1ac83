"""Metrics of trade ledgers, equity series, monitoring and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.joins import join_same
from tidemark.operators.prefix import group_key, running
from tidemark.session import cut, sized_broadcast


def _in_blocks(df: DataFrame, order: list[str]) -> DataFrame:
    """df with the number of a block of the order: its day where the first column is a date or a time, else a range of all columns."""
    if isinstance(df.schema[order[0]].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return df.withColumn("_block", F.to_date(order[0]))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(parts, *order).withColumn("_block", F.spark_partition_id())


def equity(df: DataFrame, value: str, by: list[str], order: list[str]) -> DataFrame:
    """Running sum, its highest value so far (0 at the start) and the distance below it.

    A block of a group is summed by itself and set upon the sum and the highest value of the blocks before it, so only
    a row a block is ordered per group. df is read twice; cut it before where it is dear.
    """
    rows = _in_blocks(df, order).withColumn("_group", group_key(by))
    w = Window.partitionBy("_group", "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_run", F.sum(value).over(w))
    blocks = rows.groupBy("_group", "_block").agg(F.sum(value).alias("_sum"), F.max("_run").alias("_top"))
    before = Window.partitionBy("_group").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_base", F.sum("_sum").over(before))
    blocks = blocks.select("_group", "_block", "_base", F.max(F.coalesce(F.col("_base") + F.col("_top"), "_top")).over(before).alias("_high"))
    key = F.coalesce(F.col("_block").cast("string"), F.lit("none"))  # rows without a day are a block too
    joined = rows.withColumn("_key", key).join(blocks.withColumn("_key", key).drop("_block"), ["_group", "_key"])
    joined = joined.withColumn("equity", F.coalesce(F.col("_base") + F.col("_run"), "_base", "_run"))
    joined = joined.withColumn("peak", F.greatest(F.max("equity").over(w), F.col("_high"), F.lit(0.0))).withColumn("drawdown", F.col("equity") - F.col("peak"))
    return joined.select(*df.columns, "equity", "peak", "drawdown")


def path_metrics(df: DataFrame, values: dict[str, Column], by: list[str], order: list[str]) -> DataFrame:
    """For each group and named value: trades, win rate, total, mean and standard deviation of R, largest drawdown of the running sum.

    df is read and shuffled once: a block of the order becomes a row with its sum and the highest and lowest points
    and the deepest fall of its running sum; a group's blocks are then laid upon each other. A fall that begins in an
    earlier block is the block's lowest point against the highest before it.
    """
    names = list(values)
    rows = _in_blocks(df, order)
    narrow = rows.select(*by, *order, "_block", *(v.cast("double").alias(f"_v{i}") for i, v in enumerate(values.values())))
    w = Window.partitionBy(*by, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    for i in range(len(names)):
        narrow = narrow.withColumn(f"_run{i}", F.sum(f"_v{i}").over(w))
    for i in range(len(names)):
        narrow = narrow.withColumn(f"_fall{i}", F.col(f"_run{i}") - F.max(f"_run{i}").over(w))

    def of_block(i: int) -> Column:
        v, run = F.col(f"_v{i}"), F.col(f"_run{i}")
        return F.struct(
            F.lit(i).alias("i"), F.count("*").alias("trades"), F.count(v).alias("n"), F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"), F.coalesce(F.var_pop(v), F.lit(0.0)).alias("var"), F.count(F.when(v > 0, 1)).alias("wins"),
            F.coalesce(F.sum(v), F.lit(0.0)).alias("sum"), F.max(run).alias("top"), F.min(run).alias("low"), F.min(f"_fall{i}").alias("fall"),
        )

    blocks = narrow.groupBy(*by, "_block").agg(F.array(*(of_block(i) for i in range(len(names)))).alias("_b")).select(*by, "_block", F.explode("_b").alias("_b")).select(*by, "_block", "_b.*")
    whole = Window.partitionBy(*by, "i")
    before = whole.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_base", F.coalesce(F.sum("sum").over(before), F.lit(0.0))).withColumn("_mean", F.sum(F.col("n") * F.col("mean")).over(whole) / F.nullif(F.sum("n").over(whole), F.lit(0)))
    high = F.greatest(F.max(F.col("_base") + F.col("top")).over(before), F.lit(0.0))
    blocks = blocks.withColumn("_dd", F.least(F.col("_base") + F.col("low") - high, "fall")).withColumn("_m2", F.col("n") * (F.col("var") + F.pow(F.col("mean") - F.col("_mean"), 2)))
    n = F.sum("n")
    got = blocks.groupBy(*by, "i").agg(
        F.sum("trades").alias("trades"), (F.sum("wins") / F.nullif(n, F.lit(0))).alias("win_rate"), F.when(n > 0, F.sum("sum")).alias("total_r"), F.first("_mean").alias("mean_r"),
        F.when(n > 1, F.sqrt(F.sum("_m2") / (n - 1))).alias("std_r"), F.min("_dd").alias("max_dd"),
    )
    return got.withColumn("name", F.element_at(F.array(*map(F.lit, names)), F.col("i") + 1)).drop("i")


def ledger_metrics(df: DataFrame, by: list[str], order: list[str], values: dict[str, Column] | None = None) -> DataFrame:
    """path_metrics of pnl_r (or of named values) with mean over standard deviation as `sharpe`."""
    got = path_metrics(df, values or {"pnl_r": F.col("pnl_r")}, by, order)
    got = got.withColumn("sharpe", F.col("mean_r") / F.nullif("std_r", F.lit(0.0))).drop("std_r")
    return got if values else got.drop("name")


def tail_contribution(df: DataFrame, by: list[str], share: float = 0.1) -> DataFrame:
    """Share of the winners' profit that the best tenth of winners (rounded up, one at least) made, with both counts.

    Winners are counted by profit, and profits are laid end to end from the highest; of equal ones it does not matter
    which are among the best.
    """
    profits = df.where("pnl_r > 0").groupBy(*by, (-F.col("pnl_r")).alias("_loss")).agg(F.count("*").alias("_n"))
    placed = running(profits, by, ["_loss"], ["_n"])
    top = F.greatest(F.lit(0), F.least("_n", F.greatest(F.lit(1), F.ceil(F.col("_n_total") * share)) - F.col("_n_before")))
    got = placed.groupBy(*by).agg((F.sum(F.col("_loss") * top) / F.sum(F.col("_loss") * F.col("_n"))).alias("tail_share"), F.sum(top).alias("n_top"), F.sum("_n").alias("n_winners"))
    every = join_same(df.select(*by).distinct(), got, by, "left")
    return every.select(*by, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("tail_share", "n_top", "n_winners")))


def asset_stats(df: DataFrame, by: list[str], order: list[str], value: str = "pnl_r", regime: str = "exit_reason") -> DataFrame:
    """Mean, largest drawdown, stability 1 / (1 + std / |mean|), and fragility: the standard deviation of the regimes' means."""
    base = path_metrics(df, {value: F.col(value)}, by, order)
    base = base.select(*by, F.col("mean_r").alias("mu"), "max_dd", (1 / (1 + F.col("std_r") / F.nullif(F.abs("mean_r"), F.lit(0.0)))).alias("stability"))
    means = df.groupBy(*by, regime).agg(F.avg(value).alias("_m")).groupBy(*by).agg(F.stddev_samp("_m").alias("fragility"))
    return join_same(base, means, by)


def cost_stress(df: DataFrame, levels: list[float], by: list[str], order: list[str]) -> DataFrame:
    """Ledger metrics after costs of so many basis points of the notional (in R of 10,000); every row is read once for all levels."""
    values = {str(bps): F.col("pnl_r") - F.col("notional") * bps / 1e4 / 1e4 for bps in levels}
    return ledger_metrics(df, by, order, values).withColumn("bps", F.col("name").cast("double")).drop("name")


def halt_day(df: DataFrame, by: list[str], order: list[str], limit: float) -> DataFrame:
    """The first time at which the drawdown passes a limit, trades until then and after it.

    df is read and shuffled once: the trades of a group, block and time become a row with their number and sum, the
    highest and lowest points of the block's running sum there, and its deepest fall within the block. Blocks are laid
    upon each other as in path_metrics, and all else is counted from these rows.
    """
    rows = _in_blocks(df, order).select(*dict.fromkeys([*by, *order, "exit_time", "pnl_r", "_block"]))
    w = Window.partitionBy(*by, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_run", F.sum("pnl_r").over(w)).withColumn("_fall", F.col("_run") - F.max("_run").over(w))
    times = cut(rows.groupBy(*by, "_block", "exit_time").agg(F.count("*").alias("_n"), F.sum("pnl_r").alias("_sum"), F.max("_run").alias("_top"), F.min("_run").alias("_low"), F.min("_fall").alias("_fall")))
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = times.groupBy(*by, "_block").agg(F.sum("_sum").alias("_sum"), F.max("_top").alias("_top")).withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)))
    blocks = blocks.select(*by, "_block", "_base", F.greatest(F.max(F.col("_base") + F.col("_top")).over(before), F.lit(0.0)).alias("_high"))
    laid = join_same(times, sized_broadcast(blocks), [*by, "_block"])
    passed = F.least(F.col("_base") + F.col("_low") - F.col("_high"), "_fall") <= -limit
    first = laid.where(passed).groupBy(*by).agg(F.min("exit_time").alias("halt"))
    kept = F.col("halt").isNull() | (F.col("exit_time") <= F.col("halt"))
    count = lambda which: F.coalesce(F.sum(F.when(which, F.col("_n"))), F.lit(0))
    return join_same(times.select(*by, "exit_time", "_n"), sized_broadcast(first), by, "left").groupBy(*by).agg(F.max("halt").alias("halt"), count(kept).alias("kept"), count(~kept).alias("rejected"))


def entropy(df: DataFrame, column: str) -> DataFrame:
    """Shannon entropy (natural log) of a column's values."""
    total = df.agg(F.count("*").alias("_t"))
    p = F.col("_n") / F.col("_t")
    return df.groupBy(column).agg(F.count("*").alias("_n")).join(F.broadcast(total)).agg((-F.sum(p * F.log(p))).alias("entropy"))


def true_rate(flags: Column) -> Column:
    """Share of the true values of a map; null for an empty one."""
    return F.size(F.filter(F.map_values(flags), lambda x: x)) / F.nullif(F.size(flags), F.lit(0))


def budget_split(df: DataFrame, modes: dict[str, float]) -> DataFrame:
    """Of each mode's weight the gated symbols' shares by score; modes without gated symbols leave theirs to the others."""
    weights = F.create_map(*(F.lit(x) for kv in modes.items() for x in kv))
    rows = df.where("gated").withColumn("_w", weights[F.col("mode")])
    own = F.col("score") / F.sum("score").over(Window.partitionBy("mode")) * F.col("_w")
    rows = rows.withColumn("_own", own)
    return rows.join(F.broadcast(rows.agg(F.sum("_own").alias("_all")))).select("symbol", "mode", (F.col("_own") / F.col("_all")).alias("weight"))


def buy_hold(bars: DataFrame) -> DataFrame:
    """Return from the first close to the last, per symbol and of an equal-weight basket."""
    each = bars.groupBy("symbol").agg((F.max_by("close", "ts") / F.min_by("close", "ts") - 1).alias("ret"))
    return each.unionByName(each.agg(F.avg("ret").alias("ret")).select(F.lit("basket").alias("symbol"), "ret"))


def bar_outcomes(df: DataFrame) -> DataFrame:
    """Rows of each strategy, symbol, engine and outcome; rows without a strategy are left out."""
    named = df.where(F.trim("strategy") != "").select("strategy", F.upper(F.trim("symbol")).alias("symbol"), "engine", "outcome")
    return named.groupBy("strategy", "symbol", "engine", "outcome").agg(F.count("*").alias("n"))


def missing_rate(df: DataFrame, keys: list[str]) -> DataFrame:
    gaps = sum((F.when(F.col(k).isNull(), 1).otherwise(0) if k in df.columns else F.lit(1) for k in keys), F.lit(0))
    return df.agg((F.sum(gaps) / (F.count("*") * len(keys))).alias("missing_rate"))


def equity_change(now: Column, anchor: Column, limit: float) -> Column:
    """The relative change, where it is at least the limit in size."""
    change = now / anchor - 1
    return F.when(F.abs(change) >= limit, change)


def gainers(bars: DataFrame, hours: int, least_volume: float, k: int) -> DataFrame:
    """The k symbols that rose most over the last hours, with at least that volume in them."""
    end = bars.agg(F.max("ts").alias("_end"))
    late = bars.join(F.broadcast(end), F.col("ts") > F.col("_end") - F.expr(f"interval {hours} hours"))
    got = late.groupBy("symbol").agg((100 * (F.max_by("close", "ts") / F.min_by("open", "ts") - 1)).alias("change_pct"), F.sum(F.col("volume") * F.col("close")).alias("quote_volume"))
    return got.where(F.col("quote_volume") >= least_volume).orderBy(F.desc("change_pct"), "symbol").limit(k)
