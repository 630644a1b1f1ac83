"""Sources and sinks: bar files, feature stores by month, buses of latest rows, klines in ZIP files, logs and results."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import epoch
from tidemark.operators.joins import merge_columns
from tidemark.session import cut

KLINE = ["open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "n", "taker_base", "taker_quote", "unused"]


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing: doubles and floats that are NaN become null."""
    return df.select(*(F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in df.schema))


def scan_bars(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    """Bars as Parquet, partitioned by symbol or with a symbol column; the filter prunes."""
    df = nan_to_null(spark.read.parquet(path))
    return df if symbol is None else df.where(F.col("symbol") == symbol)


def scan_range(df: DataFrame, start: str | None = None, end: str | None = None, max_days: int | None = None) -> DataFrame:
    """Bars within [start, end], or the last `max_days` days of all."""
    if start is not None:
        return df.where((F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") <= F.lit(end).cast("timestamp")))
    if max_days is None:
        return df
    last = df.agg(F.max("ts").alias("_last"))
    return df.join(F.broadcast(last), F.col("ts") >= F.col("_last") - F.make_dt_interval(F.lit(max_days))).drop("_last")


def scan_feature_dir(spark: SparkSession, directory: str) -> DataFrame:
    """Files (or folders of part files) features_<SYMBOL>.parquet of a directory, the symbol taken from the name."""
    df = spark.read.option("recursiveFileLookup", "true").parquet(f"{directory}/features_*.parquet")
    return df.withColumn("symbol", F.regexp_extract(F.col("_metadata.file_path"), r"features_([^/]+?)(?:\.|%2E)parquet", 1))


def store_write(df: DataFrame, root: str, layer: str, timeframe: str, merge_existing: bool = True) -> None:
    """Rows of (symbol, ts) into layer / timeframe / symbol / month; with merge_existing the months' columns of both stay."""
    spark = df.sparkSession
    path = f"{root}/layer={layer}/timeframe={timeframe}"
    new = df.withColumn("month", F.date_format("ts", "yyyy-MM"))
    if merge_existing:
        try:
            old = spark.read.option("mergeSchema", "true").parquet(path)
        except Exception as error:  # the first write has nothing to merge with
            if "PATH_NOT_FOUND" not in str(error):
                raise
        else:
            touched = new.select("symbol", "month").distinct()
            old = old.join(touched, ["symbol", "month"], "left_semi")
            new = cut(merge_columns(old, new, ["symbol", "month", "ts"]))  # cut: the files that it reads are overwritten
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "month").parquet(path)


def store_read(spark: SparkSession, root: str, layer: str, timeframe: str, symbol: str, month: str) -> DataFrame:
    """One partition; only its files are read."""
    df = spark.read.option("mergeSchema", "true").parquet(f"{root}/layer={layer}/timeframe={timeframe}")
    return df.where((F.col("symbol") == symbol) & (F.col("month") == month))


def layer_id(features: DataFrame, name: str, timeframe: str, explicit: str | None = None) -> DataFrame:
    """features_<name>_<timeframe>_<10 hex digits of the sorted list's hash>, unless it is given."""
    listed = F.to_json(F.array_sort(F.collect_set("feature")))
    made = F.concat(F.lit(f"features_{name}_{timeframe}_"), F.substring(F.sha2(listed, 256), 1, 10))
    return features.agg((F.lit(explicit) if explicit else made).alias("layer_id"))


def _members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """CSV members of ZIP files, as rows."""
    for frame in frames:
        for content in frame["content"]:
            with zipfile.ZipFile(io.BytesIO(content)) as held:
                for name in held.namelist():
                    with held.open(name) as member:
                        for part in pd.read_csv(member, header=None, names=KLINE, chunksize=100_000, dtype={"open_time": "int64"}):
                            yield part[["open_time", "open", "high", "low", "close", "volume"]].astype({c: "float64" for c in ("open", "high", "low", "close", "volume")})


def scan_klines(spark: SparkSession, path: str) -> DataFrame:
    """Klines of ZIP or CSV files; each open time may be in milliseconds or microseconds."""
    schema = "open_time long, open double, high double, low double, close double, volume double"
    if path.endswith(".zip"):
        rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(_members, schema)
    else:
        rows = spark.read.csv(path, schema=schema + ", close_time long, quote_volume double, n long, taker_base double, taker_quote double, unused string")
    return rows.select(epoch(F.col("open_time")).alias("ts"), "open", "high", "low", "close", "volume")


def bus_keep(df: DataFrame, max_rows: int) -> DataFrame:
    """The latest rows of each symbol and timeframe."""
    w = Window.partitionBy("symbol", "timeframe").orderBy(F.desc("ts"), F.desc("write_ts"))
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= max_rows).drop("_k")


def bus_latest(df: DataFrame, keys: DataFrame, now: str) -> DataFrame:
    """Of each requested key the latest values and the age in seconds; null where there is none."""
    last = df.groupBy("symbol", "timeframe").agg(F.max_by("close", "ts").alias("close"), F.max("ts").alias("ts"), F.max("write_ts").alias("_w"))
    return keys.join(last, ["symbol", "timeframe"], "left").withColumn("age_s", F.lit(now).cast("timestamp").cast("double") - F.col("_w").cast("double")).drop("_w")


def bus_resolve_tf(partitions: DataFrame, wanted: str) -> DataFrame:
    """The wanted timeframe's partition of each symbol, else the legacy one `primary`, flagged."""
    got = partitions.groupBy("symbol").agg(F.max(F.when(F.col("timeframe") == wanted, F.col("timeframe"))).alias("exact"), F.max(F.when(F.col("timeframe") == "primary", F.col("timeframe"))).alias("legacy"))
    return got.select("symbol", F.coalesce("exact", "legacy").alias("timeframe"), (F.col("exact").isNull() & F.col("legacy").isNotNull()).alias("is_legacy"))


def export_window(df: DataFrame, days: int) -> DataFrame:
    """The last `days` days, or all for 0."""
    return scan_range(df, max_days=days or None)


def scan_stage_logs(spark: SparkSession, base: str) -> DataFrame:
    """JSON lines of <base>/<stage>/* or <base>/stage=<stage>/*, with the stage from the path."""
    return spark.read.json(f"{base}/*/*").withColumn("stage", F.regexp_extract(F.col("_metadata.file_path"), r"(?:stage=)?([^/=]+)/[^/]+$", 1))


def missing_months(spark: SparkSession, start: str, end: str, files: DataFrame, force: bool = False) -> DataFrame:
    """Months from start to end without a file; all with force."""
    every = spark.sql(f"select explode(sequence(date'{start}-01', date'{end}-01', interval 1 month)) as m").select(F.date_format("m", "yyyy-MM").alias("month"))
    return every if force else every.join(files.select("month").distinct(), "month", "left_anti")


def summarize_results(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """One row per result document {strategy, cv, backtest, diagnostics}: scores, and the diagnostics as JSON; what is absent is null.

    Documents are JSON lines, or with whole_files a file each; a document without `strategy` takes its folder's name.
    """
    schema = "strategy string, cv struct<Sharpe_mean: double>, backtest struct<sharpe: double, total_return_pct: double, max_drawdown_pct: double, total_trades: long, diagnostics: struct<entries_exits: map<string, string>>>, diagnostics struct<labels: map<string, string>, predictions: map<string, string>>"
    text = spark.read.text(path, wholetext=whole_files).select("value", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("folder"))
    r = text.select("folder", F.from_json("value", schema).alias("r")).where(F.col("r").isNotNull())
    return r.select(
        F.coalesce("r.strategy", "folder").alias("strategy"), F.col("r.cv.Sharpe_mean").alias("cv_score"), F.col("r.backtest.sharpe").alias("sharpe"),
        F.col("r.backtest.total_return_pct").alias("total_return_pct"), F.col("r.backtest.max_drawdown_pct").alias("max_drawdown_pct"), F.col("r.backtest.total_trades").alias("total_trades"),
        F.col("r.backtest.diagnostics.entries_exits").alias("entries_exits"), F.col("r.diagnostics.labels").alias("label_summary"), F.col("r.diagnostics.predictions").alias("pred_summary"),
    )


def parse_summary(df: DataFrame) -> DataFrame:
    """Trades and Sharpe of a summary; an empty one has 0 of both."""
    return df.agg(F.coalesce(F.sum("trades"), F.lit(0)).alias("trades"), F.coalesce(F.avg("sharpe"), F.lit(0.0)).alias("sharpe"))


def validate_window(df: DataFrame, required: list[str]) -> DataFrame:
    """Non-null values of every required column; a missing column is an error MISSING_FEATURE."""
    gone = [c for c in required if c not in df.columns]
    if gone:
        raise ValueError(f"MISSING_FEATURE: {', '.join(gone)}")
    return df.agg(*(F.count(c).alias(c) for c in required)).unpivot([], required, "feature", "n")


def scan_orders(spark: SparkSession, url: str, name: str, reader: dict | None = None) -> DataFrame:
    """A table by JDBC, or a Parquet dump of it."""
    if url.startswith("jdbc:"):
        return spark.read.format("jdbc").options(url=url, dbtable=name, **(reader or {})).load()
    return spark.read.parquet(f"{url}/{name}.parquet")


def load_universe(df: DataFrame, column: str) -> DataFrame:
    """Symbols trimmed, in upper case, once each."""
    return df.select(F.upper(F.trim(column)).alias("symbol")).where("symbol <> ''").distinct()
