"""Market-like views of the driver's tables, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.bars import tick_bars
from tidemark.session import table


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ticks: the event type is the symbol, the value the price; even ids buy, odd ids sell."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("tick_id"),
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("qty"),
        F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1).alias("side"),
    )


def bars(spark: SparkSession, sf_dir: str, width: str = "2 hours") -> DataFrame:
    return tick_bars(ticks(spark, sf_dir), width)


def aux(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as an auxiliary series (like open interest) of five symbols."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("aux_id")
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as closed trades."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(
        F.col("o_orderpriority").alias("symbol"),
        F.when(F.col("l_linestatus") == "O", "long").otherwise("short").alias("side"),
        F.col("o_orderdate").cast("timestamp").alias("entry_time"),
        F.col("l_shipdate").cast("timestamp").alias("exit_time"),
        ((F.col("l_quantity") - 25) / 10).alias("pnl_r"),
        F.col("l_extendedprice").alias("notional"),
        F.col("l_returnflag").alias("exit_reason"),
        F.col("l_orderkey").alias("trade_id"),
        F.col("l_linenumber").alias("leg"),
        F.col("l_partkey").alias("part"),
    )


def labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: label is quality, the feature their number of characters."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return labels.join(docs.select("doc_id", "n_chars", "lang", "source"), "doc_id").select(
        "doc_id", F.col("quality").alias("label"), "toxic", F.col("n_chars").cast("double").alias("feature"), "lang", "source"
    )


TICKS = """ticks AS (SELECT event_type AS symbol, ts, event_id AS tick_id, value AS price,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS qty, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS side FROM events)"""


def bars_sql(hours: int = 2, name: str = "bars") -> str:
    return f"""{name} AS (SELECT symbol, time_bucket(INTERVAL '{hours} hours', ts, TIMESTAMP '1970-01-01') AS ts,
  arg_min(price, (ts, tick_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, tick_id)) AS close,
  sum(qty) AS volume, sum(qty * side) AS flow, count(*) AS n FROM ticks GROUP BY 1, 2)"""


BARS = f"{TICKS}, {bars_sql()}"
AUX = "aux AS (SELECT o_orderpriority AS symbol, o_orderdate AS ts, o_totalprice AS value, o_orderkey AS aux_id FROM orders)"
LEDGER = """ledger AS (SELECT o_orderpriority AS symbol, CASE WHEN l_linestatus = 'O' THEN 'long' ELSE 'short' END AS side,
  o_orderdate AS entry_time, l_shipdate AS exit_time, (l_quantity - 25) / 10 AS pnl_r, l_extendedprice AS notional,
  l_returnflag AS exit_reason, l_orderkey AS trade_id, l_linenumber AS leg, l_partkey AS part
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
LABELED = """labeled AS (SELECT l.doc_id, quality AS label, toxic, CAST(n_chars AS DOUBLE) AS feature, lang, source
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""
