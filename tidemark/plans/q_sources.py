"""Sources and sinks (S rows of the inventory). What a query writes goes to the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.operators.bars import bars_bounds
from tidemark.plans.catalog import query
from tidemark.plans.views import AUX, BARS, LABELED, TICKS, aux, bars, labeled, ticks
from tidemark.session import cut, shared_dir, table
from tidemark.sources import store as S


def _home(spark) -> str:
    return f"{shared_dir(spark)}/tidemark/{uuid.uuid4().hex}"


@query("S01_scan_bars", f"WITH {BARS} SELECT symbol, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_rows FROM bars WHERE symbol = 'click' GROUP BY 1")
def scan_bars(spark, sf_dir):
    home = _home(spark)
    bars(spark, sf_dir).write.partitionBy("symbol").parquet(home)
    return bars_bounds(S.scan_bars(spark, home, "click"))


@query("S02_scan_range", f"WITH {BARS} SELECT symbol, ts FROM bars WHERE ts >= (SELECT max(ts) FROM bars) - INTERVAL 7 DAY")
def scan_range(spark, sf_dir):
    return S.scan_range(bars(spark, sf_dir), max_days=7).select("symbol", "ts")


@query("S03_scan_feature_dir", f"WITH {BARS} SELECT upper(symbol) AS symbol, count(*) AS n FROM bars GROUP BY 1")
def scan_feature_dir(spark, sf_dir):
    home = _home(spark)
    b = cut(bars(spark, sf_dir))
    for r in b.select("symbol").distinct().collect():  # a folder per symbol, as feature builds write them
        b.where(F.col("symbol") == r.symbol).drop("symbol").write.parquet(f"{home}/features_{r.symbol.upper()}.parquet")
    return S.scan_feature_dir(spark, home).groupBy("symbol").agg(F.count("*").alias("n"))


@query("S04_store_write_month", f"WITH {BARS} SELECT symbol, ts, open, CASE WHEN n % 2 = 0 THEN close END AS close, CASE WHEN n % 3 = 0 THEN high END AS high FROM bars")
def store_write(spark, sf_dir):
    home, b = _home(spark), cut(bars(spark, sf_dir))
    S.store_write(b.select("symbol", "ts", "open"), home, "core", "120T")
    S.store_write(b.where("n % 2 = 0").select("symbol", "ts", "close"), home, "core", "120T")
    S.store_write(b.where("n % 3 = 0").select("symbol", "ts", "high"), home, "core", "120T")
    return spark.read.option("mergeSchema", "true").parquet(f"{home}/layer=core/timeframe=120T").select("symbol", "ts", "open", "close", "high")


@query("S05_store_read_month", f"WITH {BARS} SELECT symbol, ts, open FROM bars WHERE symbol = 'click' AND strftime(ts, '%Y-%m') = '2024-01'")
def store_read(spark, sf_dir):
    home = _home(spark)
    S.store_write(bars(spark, sf_dir).select("symbol", "ts", "open"), home, "core", "120T", merge_existing=False)
    return S.store_read(spark, home, "core", "120T", "click", "2024-01").select("symbol", "ts", "open")


@query("S06_layer_id", """SELECT 'features_core_120T_' || substring(sha256('[' || string_agg('"' || f || '"', ',' ORDER BY f) || ']'), 1, 10) AS layer_id FROM (SELECT DISTINCT event_type AS f FROM events)""")
def layer_id(spark, sf_dir):
    return S.layer_id(table(spark, sf_dir, "events").select(F.col("event_type").alias("feature")), "core", "120T")


@query("S07_scan_klines", "SELECT date_trunc('millisecond', ts) AS ts, value AS open, value AS close FROM events")
def scan_klines(spark, sf_dir):
    home, e = _home(spark), table(spark, sf_dir, "events")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    unit = F.when(F.col("event_id") % 2 == 0, ms).otherwise(ms * 1000)
    e.select(unit.alias("open_time"), *(F.col("value").alias(c) for c in ("open", "high", "low", "close")), F.lit(1.0).alias("volume"), ms.alias("close_time"), *(F.lit(0).alias(c) for c in S.KLINE[7:])).write.csv(home)
    return S.scan_klines(spark, home).select("ts", "open", "close")


@query("S08_bus_append", f"WITH {BARS}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS r FROM bars) SELECT symbol, '120T' AS timeframe, ts, close FROM k WHERE r <= 50")
def bus_append(spark, sf_dir):
    rows = bars(spark, sf_dir).withColumn("timeframe", F.lit("120T")).withColumn("write_ts", F.col("ts"))
    return S.bus_keep(rows, 50).select("symbol", "timeframe", "ts", "close")


@query("S09_bus_latest", f"WITH {BARS}, k AS (SELECT DISTINCT symbol FROM bars UNION ALL SELECT 'none'), l AS (SELECT symbol, arg_max(close, ts) AS close, max(ts) AS ts FROM bars GROUP BY 1) SELECT k.symbol, '120T' AS timeframe, l.close, l.ts, epoch(TIMESTAMP '2024-02-01') - epoch(l.ts) AS age_s FROM k LEFT JOIN l ON k.symbol = l.symbol")
def bus_latest(spark, sf_dir):
    b = bars(spark, sf_dir).withColumn("timeframe", F.lit("120T")).withColumn("write_ts", F.col("ts"))
    keys = b.select("symbol", "timeframe").distinct().unionByName(spark.createDataFrame([("none", "120T")], "symbol string, timeframe string"))
    return S.bus_latest(b, keys, "2024-02-01")


@query("S10_bus_resolve_tf", "WITH p AS (SELECT o_orderpriority AS symbol, CASE WHEN o_orderstatus = 'F' AND o_orderpriority < '3' THEN '120T' WHEN o_orderstatus = 'F' THEN 'other' ELSE 'primary' END AS tf FROM orders), g AS (SELECT symbol, max(tf) FILTER (tf = '120T') AS e, max(tf) FILTER (tf = 'primary') AS l FROM p GROUP BY 1) SELECT symbol, coalesce(e, l) AS timeframe, e IS NULL AND l IS NOT NULL AS is_legacy FROM g")
def bus_resolve(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    tf = F.when((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") < "3"), "120T").when(F.col("o_orderstatus") == "F", "other").otherwise("primary")
    return S.bus_resolve_tf(o.select(F.col("o_orderpriority").alias("symbol"), tf.alias("timeframe")), "120T")


@query("S11_export_window", f"WITH {TICKS} SELECT symbol, count(*) AS n FROM ticks WHERE ts >= (SELECT max(ts) FROM ticks) - INTERVAL 3 DAY GROUP BY 1")
def export_window(spark, sf_dir):
    home = _home(spark)
    S.export_window(ticks(spark, sf_dir), 3).write.parquet(home)
    return spark.read.parquet(home).groupBy("symbol").agg(F.count("*").alias("n"))


@query("S12_scan_stage_logs", "SELECT event_type AS stage, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def stage_logs(spark, sf_dir):
    home = _home(spark)
    table(spark, sf_dir, "events").select("event_id", "value", F.col("event_type").alias("stage")).write.partitionBy("stage").json(home)
    return S.scan_stage_logs(spark, home).groupBy("stage").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("S13_missing_months", "SELECT strftime(m, '%Y-%m') AS month FROM (SELECT unnest(generate_series(DATE '1994-06-01', DATE '1999-06-01', INTERVAL 1 MONTH)) AS m) WHERE strftime(m, '%Y-%m') NOT IN (SELECT strftime(o_orderdate, '%Y-%m') FROM orders WHERE o_totalprice > 480000)")
def missing_months(spark, sf_dir):
    files = table(spark, sf_dir, "orders").where("o_totalprice > 480000").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    return S.missing_months(spark, "1994-06", "1999-06", files)


@query("S14_scan_aux", f"WITH {AUX} SELECT symbol, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_rows FROM aux GROUP BY 1")
def scan_aux(spark, sf_dir):
    home = _home(spark)
    aux(spark, sf_dir).write.partitionBy("symbol").parquet(home)
    return bars_bounds(spark.read.parquet(home))


@query("S15_summarize_results", "SELECT p_brand AS strategy, round(avg(p_retailprice), 4) AS cv_score, round(max(p_retailprice), 4) AS sharpe, round(min(p_retailprice), 4) AS max_drawdown_pct, count(*) AS total_trades, CAST(count(*) FILTER (p_size > 25) AS VARCHAR) AS entries, CAST(count(DISTINCT p_type) AS VARCHAR) AS label_kinds FROM part GROUP BY 1")
def summarize(spark, sf_dir):
    home = _home(spark)
    price, named = F.col("p_retailprice"), lambda **c: F.struct(*(v.alias(k) for k, v in c.items()))
    entries = named(entries_exits=named(total_entries=F.count(F.when(F.col("p_size") > 25, 1))))
    g = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("strategy")).agg(
        named(Sharpe_mean=F.round(F.avg(price), 4)).alias("cv"),
        named(sharpe=F.round(F.max(price), 4), max_drawdown_pct=F.round(F.min(price), 4), total_trades=F.count("*"), diagnostics=entries).alias("backtest"),
        named(labels=named(kinds=F.countDistinct("p_type"))).alias("diagnostics"),
    )
    g.write.json(home)
    got = S.summarize_results(spark, home)
    return got.select("strategy", "cv_score", "sharpe", "max_drawdown_pct", "total_trades", F.col("entries_exits.total_entries").alias("entries"), F.col("label_summary.kinds").alias("label_kinds"))


@query("S16_parse_summary", "SELECT coalesce(sum(l_linenumber), 0)::BIGINT AS trades, round(coalesce(avg(l_discount), 0), 6) AS sharpe FROM lineitem")
def parse_summary(spark, sf_dir):
    got = S.parse_summary(table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("trades"), F.col("l_discount").cast("double").alias("sharpe")))
    return got.withColumn("sharpe", F.round("sharpe", 6))


@query("S17_validate_window", f"WITH {LABELED} SELECT 'feature' AS feature, count(feature) AS n FROM labeled UNION ALL SELECT 'label', count(label) FROM labeled")
def validate(spark, sf_dir):
    return S.validate_window(labeled(spark, sf_dir), ["feature", "label"])


@query("S18_scan_orders", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def scan_orders(spark, sf_dir):
    return S.scan_orders(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("S19_dims", "SELECT DISTINCT upper(trim(c_mktsegment)) AS symbol FROM customer WHERE trim(c_mktsegment) <> ''")
def dims(spark, sf_dir):
    return S.load_universe(table(spark, sf_dir, "customer"), "c_mktsegment")
