"""Joins (J rows of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import joins as J
from tidemark.plans.catalog import query
from tidemark.plans.q_features import rounded
from tidemark.plans.q_rules import ROWS, rows
from tidemark.plans.views import BARS, LEDGER, TICKS, bars, bars_sql, ledger, ticks
from tidemark.session import table

#: Labelled, overlapping ranges.
SEGMENTS = [("early", "2024-01-01", "2024-01-15"), ("middle", "2024-01-10", "2024-01-22"), ("late", "2024-01-20", "2024-02-01")]
_SEG = "seg AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', TIMESTAMP '{a}', TIMESTAMP '{z}')" for n, a, z in SEGMENTS) + ") AS s(segment, seg_start, seg_end))"


def segments(spark):
    return spark.createDataFrame(SEGMENTS, "segment string, a string, z string").select("segment", F.col("a").cast("timestamp").alias("seg_start"), F.col("z").cast("timestamp").alias("seg_end"))


_LAST = "r AS (SELECT symbol, ts, max(price) AS price FROM ticks GROUP BY 1, 2)"


@query("J01_asof_join", f"WITH {BARS}, {_LAST} SELECT b.symbol, b.ts, r.price AS tick_price FROM bars b ASOF LEFT JOIN r ON b.symbol = r.symbol AND b.ts >= r.ts")
def asof(spark, sf_dir):
    return J.asof_join(bars(spark, sf_dir), ticks(spark, sf_dir), "symbol", "ts", ["price"]).select("symbol", "ts", F.col("price").alias("tick_price"))


@query("J01_asof_tolerance", f"WITH {BARS}, {_LAST} SELECT b.symbol, b.ts, CASE WHEN r.ts >= b.ts - INTERVAL 10 MINUTE THEN r.price END AS v FROM bars b ASOF LEFT JOIN r ON b.symbol = r.symbol AND b.ts >= r.ts")
def asof_tolerance(spark, sf_dir):
    right = ticks(spark, sf_dir).select("symbol", "ts", F.col("price").alias("v"))
    return J.asof_join(bars(spark, sf_dir), right, "symbol", "ts", ["v"], "10 minutes").select("symbol", "ts", "v")


@query("J02_align_base", f"WITH {BARS}, c AS (SELECT symbol, ts, close AS cached FROM bars WHERE n > 5) SELECT b.symbol, b.ts, c.cached FROM bars b LEFT JOIN c ON b.symbol = c.symbol AND b.ts = c.ts")
def align(spark, sf_dir):
    b = bars(spark, sf_dir)
    cached = b.where("n > 5").select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("close").alias("cached"))
    return J.align_base(b.select("symbol", "ts"), cached, ["cached"])


@query("J03_anchor_overlay", f"WITH {BARS} SELECT b.symbol, b.ts, a.close FROM bars b LEFT JOIN (SELECT ts, close FROM bars WHERE symbol = 'click') a ON b.ts = a.ts")
def anchor(spark, sf_dir):
    return J.anchor_overlay(bars(spark, sf_dir).select("symbol", "ts", "close"), "close", "click")


@query("J04_merge_columns", f"WITH {BARS}, o AS (SELECT symbol, ts, open, close FROM bars WHERE n % 2 = 0), n AS (SELECT symbol, ts, close + 1 AS close, high FROM bars WHERE n % 3 = 0) SELECT coalesce(n.symbol, o.symbol) AS symbol, coalesce(n.ts, o.ts) AS ts, o.open, coalesce(n.close, o.close) AS close, n.high FROM o FULL JOIN n ON o.symbol = n.symbol AND o.ts = n.ts")
def merge(spark, sf_dir):
    b = bars(spark, sf_dir)
    return J.merge_columns(b.where("n % 2 = 0").select("symbol", "ts", "open", "close"), b.where("n % 3 = 0").select("symbol", "ts", (F.col("close") + 1).alias("close"), "high"), ["symbol", "ts"])


@query("J05_segment_join", f"WITH {BARS}, {_SEG} SELECT symbol, ts, segment FROM bars JOIN seg ON ts >= seg_start AND ts < seg_end")
def segment(spark, sf_dir):
    return J.segment_join(bars(spark, sf_dir), segments(spark)).select("symbol", "ts", "segment")


@query("J06_sector_join", "SELECT o_orderkey, c_mktsegment AS sector FROM orders JOIN customer ON o_custkey = c_custkey")
def sector(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("sector"))
    return table(spark, sf_dir, "orders").join(c, "o_custkey").select("o_orderkey", "sector")


@query("J07_tf_join", f"WITH {TICKS}, {bars_sql(2, 'fine')}, {bars_sql(8, 'coarse')} SELECT f.symbol, f.ts, c.ts AS signal_ts, c.close AS signal_close FROM fine f JOIN coarse c ON f.symbol = c.symbol AND c.ts = time_bucket(INTERVAL 8 HOUR, f.ts, TIMESTAMP '1970-01-01')")
def tf(spark, sf_dir):
    from tidemark.operators.bars import resample

    b = bars(spark, sf_dir)
    return J.timeframe_join(resample(b, "8 hours"), b, "8 hours").select("symbol", "ts", "signal_ts", "signal_close")


@query("J08_inject_scores", f"WITH {BARS} SELECT symbol, ts, CASE WHEN n > 4 THEN round((close - low) / nullif(high - low, 0), 6) END AS score_long, CASE WHEN n > 4 THEN round((high - close) / nullif(high - low, 0), 6) END AS score_short FROM bars")
def inject(spark, sf_dir):
    b = bars(spark, sf_dir)
    size = F.nullif(F.col("high") - F.col("low"), F.lit(0.0))
    scores = b.where("n > 4").select("symbol", "ts", F.round((F.col("close") - F.col("low")) / size, 6).alias("score_long"), F.round((F.col("high") - F.col("close")) / size, 6).alias("score_short"))
    return J.inject_scores(b.select("symbol", "ts"), scores)


_A, _B = "SELECT DISTINCT ts FROM f WHERE position >= 0.2", "SELECT DISTINCT ts FROM f WHERE volume_ratio > 1.5"


@query("J09_overlap", f"WITH RECURSIVE {ROWS} SELECT ts FROM ({_A}) WHERE ts IN ({_B})")
def overlap(spark, sf_dir):
    df = rows(spark, sf_dir)
    return J.overlap(df.where("position >= 0.2").select("ts").distinct(), df.where("volume_ratio > 1.5").select("ts"), ["ts"])


@query("J09_exclusive", f"WITH RECURSIVE {ROWS} SELECT ts FROM ({_A}) WHERE ts NOT IN ({_B})")
def exclusive(spark, sf_dir):
    df = rows(spark, sf_dir)
    return J.exclusive(df.where("position >= 0.2").select("ts").distinct(), df.where("volume_ratio > 1.5").select("ts"), ["ts"])


_KEY = "upper(trim(c_mktsegment)) || CASE WHEN {0} > 0 THEN ':long' WHEN {0} < 0 THEN ':short' END"
_POS = "SELECT {} AS key FROM (SELECT c_mktsegment, avg(c_acctbal) AS s FROM customer WHERE c_custkey % 3 <> {} GROUP BY 1)"


@query("J10_new_positions", f"SELECT DISTINCT key FROM ({_POS.format(_KEY.format('s - 4300'), 0)}) WHERE key NOT IN (SELECT key FROM ({_POS.format(_KEY.format('s - 4600'), 1)}) WHERE key IS NOT NULL) AND key IS NOT NULL")
def new_positions(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    state = lambda left, off: c.where(F.col("c_custkey") % 3 != left).groupBy("c_mktsegment").agg((F.avg("c_acctbal") - off).cast("string").alias("amount")).withColumnRenamed("c_mktsegment", "symbol")
    return J.new_positions(state(1, 4600), state(0, 4300))


@query("J11_variant_grid", f"WITH {BARS}, {_SEG}, v AS (SELECT unnest([10, 20]) AS fast) SELECT fast, segment, symbol, count(*) AS n FROM v CROSS JOIN seg JOIN bars ON ts >= seg_start AND ts < seg_end GROUP BY ALL")
def grid(spark, sf_dir):
    variants = spark.createDataFrame([(10,), (20,)], "fast int")
    tagged = J.segment_join(bars(spark, sf_dir), segments(spark)).groupBy("segment", "symbol").agg(F.count("*").alias("n"))
    return J.variant_grid(variants, segments(spark)).select("fast", "segment").join(tagged, "segment")


@query("J12_baseline_join", f"WITH {LEDGER}, c AS (SELECT symbol, side, avg(pnl_r) AS v FROM ledger WHERE exit_time >= TIMESTAMP '1998-01-01' GROUP BY 1, 2), b AS (SELECT symbol, side, avg(pnl_r) AS v FROM ledger WHERE exit_time < TIMESTAMP '1998-01-01' AND symbol <> '5-LOW' GROUP BY 1, 2) SELECT c.symbol, c.side, round(c.v, 6) AS v, round(b.v, 6) AS baseline, round(c.v - b.v, 6) AS change FROM c LEFT JOIN b USING (symbol, side)")
def baseline(spark, sf_dir):
    led = ledger(spark, sf_dir)
    mean = lambda df: df.groupBy("symbol", "side").agg(F.avg("pnl_r").alias("v"))
    got = J.against_baseline(mean(led.where("exit_time >= timestamp'1998-01-01'")), mean(led.where("exit_time < timestamp'1998-01-01' and symbol <> '5-LOW'")), ["symbol", "side"], "v")
    return rounded(got, "v", "baseline", "change", keys=("symbol", "side"))


@query("J13_labels_merge", f"WITH RECURSIVE {ROWS} SELECT symbol, ts, round(position, 6) AS position, round((lead(close, 20) OVER w - close) / greatest(atr, 1e-9), 6) AS forward_rr FROM f WINDOW w AS (PARTITION BY symbol ORDER BY ts)")
def with_labels(spark, sf_dir):
    from tidemark.operators.labels import signed_rr

    return rounded(rows(spark, sf_dir).withColumn("forward_rr", signed_rr(20)), "position", "forward_rr")


