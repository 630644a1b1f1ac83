"""Scalar functions (X rows of the inventory) over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalars as X
from tidemark.operators.joins import position_key
from tidemark.operators.prefix import group_quantiles
from tidemark.plans.catalog import query
from tidemark.session import table

_SLUG = "trim(regexp_replace(lower(trim({})), '[^a-z0-9]+', '_', 'g'), '_')"


@query("X1_slug", f"SELECT p_partkey, {_SLUG.format('p_type')} AS slug, {_SLUG.format('p_brand')} || '__' || {_SLUG.format('p_name')} AS task_id FROM part")
def slug(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.slug(F.col("p_type")).alias("slug"), X.task_id(F.col("p_brand"), F.col("p_name")).alias("task_id"))


@query("X2_normalize_symbol", "SELECT DISTINCT CASE WHEN upper(trim(event_type)) LIKE '%USDT' THEN upper(trim(event_type)) ELSE upper(trim(event_type)) || 'USDT' END AS symbol FROM events")
def normalize(spark, sf_dir):
    return table(spark, sf_dir, "events").select(X.normalize_symbol(F.col("event_type")).alias("symbol")).distinct()


@query("X3_epoch_unit", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN ts ELSE date_trunc('millisecond', ts) END AS at FROM events")
def epoch_unit(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return e.select("event_id", X.epoch(F.when(F.col("event_id") % 2 == 0, F.col("us")).otherwise(F.floor(F.col("us") / 1000))).alias("at"))


@query("X4_align", "SELECT event_id, epoch_ms(ts) - epoch_ms(ts) % 300000 AS floor_ms, CASE WHEN epoch_ms(ts) % 300000 = 0 THEN epoch_ms(ts) ELSE epoch_ms(ts) - epoch_ms(ts) % 300000 + 300000 END AS ceil_ms FROM events")
def align(spark, sf_dir):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", X.align_floor(ms, 300000).alias("floor_ms"), X.align_ceil(ms, 300000).alias("ceil_ms"))


@query("X5_clamp01", "SELECT event_id, greatest(0, least(1, coalesce(try_cast(CASE WHEN event_id % 7 = 0 THEN 'x' ELSE CAST(value / 100 AS VARCHAR) END AS DOUBLE), 0))) AS c FROM events")
def clamp01(spark, sf_dir):
    raw = F.when(F.col("event_id") % 7 == 0, "x").otherwise((F.col("value") / 100).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", X.clamp01(raw).alias("c"))


@query("X6_expm1", "SELECT event_id, round(exp(ln(1 + value)) - 1, 6) AS v FROM events")
def expm1(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(F.expm1(F.log1p("value")), 6).alias("v"))


@query("X7_position_key", "SELECT event_id, upper(trim(event_type)) || CASE WHEN value > 50 THEN ':long' ELSE ':short' END AS key FROM events WHERE value <> 50")
def key(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value <> 50")
    return e.select("event_id", position_key(F.col("event_type"), (F.col("value") - 50).cast("string")).alias("key"))


@query("X8_exit_kind", "SELECT l_returnflag, CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'N' THEN 'none' WHEN 'R' THEN 'returned' ELSE coalesce(nullif(trim(l_returnflag), ''), '-') END AS label, count(*) AS n FROM lineitem GROUP BY 1")
def exit_kind(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n")).withColumn("label", X.exit_label(F.col("l_returnflag")))


@query("X9_month_list", "SELECT o_orderpriority, CAST(unnest(generate_series(date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)), INTERVAL 1 MONTH)) AS DATE) AS month FROM orders GROUP BY 1")
def month_list(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("z"))
    return o.select("o_orderpriority", F.explode(X.month_list(F.col("a").cast("date"), F.col("z").cast("date"))).alias("month"))


@query("X10_coalesce_cutoff", "SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'F' THEN o_orderdate END, TIMESTAMP '1998-01-01') AS cutoff FROM orders")
def cutoff(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate").cast("timestamp")), F.lit("1998-01-01").cast("timestamp")).alias("cutoff"))


@query("X11_json_field", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_field(spark, sf_dir):
    wrapped = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"data": '), F.col("props"), F.lit("}"))).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", X.json_field(wrapped, "k").alias("k"))


@query("X12_pct_format", "SELECT l_orderkey, l_linenumber, l_partkey, printf('%+.2f%%', 100 * ((l_quantity - 25) / 16)) AS pct FROM lineitem")
def pct(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", X.percent((F.col("l_quantity") - 25) / 16).alias("pct"))


@query("X13_quantile_key", "SELECT event_type, round(quantile_cont(value, 0.9), 6) AS q90 FROM events GROUP BY 1")
def quantile_key(spark, sf_dir):
    g = group_quantiles(table(spark, sf_dir, "events"), ["event_type"], "value", [0.1, 0.9])
    table_ = F.map_from_arrays(F.array(F.lit("0.1"), F.lit("0.9")), F.col("q"))
    return g.select("event_type", F.round(X.quantile_key(table_, "0.9"), 6).alias("q90"))
