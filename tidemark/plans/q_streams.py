"""Streaming jobs (T rows of the inventory), each run to its end over the event files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.prefix import group_quantiles
from tidemark.plans.catalog import query
from tidemark.plans.q_features import rounded
from tidemark.plans.views import BARS, TICKS, ticks
from tidemark.sources import store as S
from tidemark.session import cut, sized_broadcast
from tidemark.streaming import jobs as T

_CLOSED = "closed AS (SELECT * FROM bars WHERE ts + INTERVAL 2 HOUR <= (SELECT max(ts) FROM ticks) - INTERVAL 2 MINUTE)"


def _bars(spark, sf_dir):
    return T.run_to_table(T.tumbling_bars(T.tick_stream(spark, sf_dir)), "bars")


@query("T01_tick_stream", f"WITH {TICKS} SELECT symbol, ts, tick_id, price, qty FROM ticks")
def tick_stream(spark, sf_dir):
    return T.run_to_table(T.tick_stream(spark, sf_dir), "ticks")


@query("T02_tumbling_bars", f"WITH {BARS}, {_CLOSED} SELECT symbol, ts, open, high, low, close, volume, n FROM closed")
def tumbling(spark, sf_dir):
    return _bars(spark, sf_dir)


@query("T03_sliding_stats", f"""WITH {TICKS}, s AS (SELECT symbol, price, qty, time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') - to_hours(CAST(unnest(range(24)) AS INTEGER)) AS start FROM ticks)
  SELECT symbol, start, count(*) AS n, sum(qty) AS volume, max(price) AS high FROM s GROUP BY 1, 2 HAVING start + INTERVAL 24 HOUR <= (SELECT max(ts) FROM ticks) - INTERVAL 2 MINUTE""")
def sliding(spark, sf_dir):
    return T.run_to_table(T.sliding_stats(T.tick_stream(spark, sf_dir)), "sliding")


_DAY = 86_400
_shuffled = lambda: F.pmod(F.col("event_id") * 7919, F.lit(_DAY))  # noqa: E731  seconds late, less than a day
_PASSED = "(SELECT max(ts) FROM ticks) - INTERVAL 1 DAY"


def _ticks_in_disorder(spark, sf_dir):
    """Ticks up to a day late, over six files and as many batches."""
    return T.staged_stream(spark, sf_dir, _shuffled())


@query("T04_regime_sessions", f"""WITH {TICKS}, e AS (SELECT *, CASE WHEN price >= 60 THEN 1 WHEN price < 20 THEN 0 END AS ev FROM ticks),
  s AS (SELECT *, coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, tick_id ROWS UNBOUNDED PRECEDING), 0) AS st FROM e),
  g AS (SELECT *, sum(CASE WHEN st <> p THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts, tick_id ROWS UNBOUNDED PRECEDING) AS seg FROM (SELECT *, coalesce(lag(st) OVER (PARTITION BY symbol ORDER BY ts, tick_id), 0) AS p FROM s)),
  k AS (SELECT *, row_number() OVER (PARTITION BY symbol, seg ORDER BY ts, tick_id) AS k FROM g),
  a AS (SELECT symbol, seg, any_value(st) AS st, min(ts) AS ts, count(*) AS n, max(ts) FILTER (k = 11) AS cut FROM k GROUP BY 1, 2), n AS (SELECT *, lead(ts) OVER (PARTITION BY symbol ORDER BY seg) AS off FROM a)
  SELECT symbol, epoch_us(ts) AS start_us, epoch_us(coalesce(cut, off)) AS end_us, CAST(least(n, 10) AS INTEGER) AS n FROM n WHERE st = 1 AND n >= 2 AND coalesce(cut, off) <= {_PASSED}""")
def sessions(spark, sf_dir):
    return T.run_to_table(T.with_state(_ticks_in_disorder(spark, sf_dir), T.Sessions(60.0, 20.0, 2, 10), "symbol string, start_us long, end_us long, n int", "1 day"), "sessions")


@query("T05_incremental_features", f"""WITH RECURSIVE {TICKS}, r AS (SELECT symbol, tick_id, price, ts, row_number() OVER w AS k, avg(price) OVER (w ROWS 19 PRECEDING) AS mean, stddev_pop(price) OVER (w ROWS 19 PRECEDING) AS deviation FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts, tick_id)),
  e AS (SELECT symbol, k, tick_id, price AS y FROM r WHERE k = 1 UNION ALL SELECT r.symbol, r.k, r.tick_id, 0.1 * r.price + 0.9 * e.y FROM e JOIN r ON r.symbol = e.symbol AND r.k = e.k + 1)
  SELECT e.symbol, e.tick_id, round(y, 6) AS ema, round(mean, 6) AS mean, round(deviation, 6) AS deviation FROM e JOIN r ON r.symbol = e.symbol AND r.k = e.k WHERE ts <= {_PASSED}""")
def incremental(spark, sf_dir):
    got = T.run_to_table(T.with_state(_ticks_in_disorder(spark, sf_dir), T.RollingFeatures(0.1, 20), "symbol string, tick_id long, ema double, mean double, deviation double", "1 day"), "features")
    return rounded(got, "ema", "mean", "deviation", keys=("symbol", "tick_id"))


_ARRIVED = f"""a AS (SELECT *, epoch_us(ts) + CASE WHEN tick_id % 20 = 0 THEN {3 * _DAY * 1_000_000} ELSE 0 END AS arrived FROM ticks), x AS (SELECT min(epoch_us(ts)) AS lo, (max(epoch_us(ts)) - min(epoch_us(ts))) // 6 + 1 AS span FROM ticks),
  f AS (SELECT a.*, least(5, (arrived - lo) // span) AS file FROM a CROSS JOIN x), m AS (SELECT DISTINCT file, (SELECT max(g.ts) FROM f g WHERE g.file < f.file) - INTERVAL 2 MINUTE AS mark FROM f)"""


@query("T06_late_rows", f"WITH {TICKS}, {_ARRIVED} SELECT symbol, tick_id, coalesce(time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 2 HOUR <= mark, false) AS late FROM f JOIN m ON f.file = m.file")
def late_rows(spark, sf_dir):
    """Every twentieth tick comes three days late; each tick is in one of the two tables."""
    delay = F.when(F.col("event_id") % 20 == 0, 3 * _DAY).otherwise(0)
    in_time, late = T.split_late(T.staged_stream(spark, sf_dir, delay), "late")
    return in_time.select("symbol", "tick_id", F.lit(False).alias("late")).unionByName(late.select("symbol", "tick_id", F.lit(True).alias("late")))


@query("T06_repaired_bars", f"WITH {BARS} SELECT symbol, ts, open, high, low, close, volume, n FROM bars")
def repaired(spark, sf_dir):
    """Bars of the ticks in time, then those with late ticks built again: in the end all ticks are in."""
    delay = F.when(F.col("event_id") % 20 == 0, 3 * _DAY).otherwise(0)
    in_time, late = T.split_late(T.staged_stream(spark, sf_dir, delay), "repair")
    return T.repaired_bars(T.tumbling_bars(in_time), in_time, late)


@query("T06_late_and_gap", f"""WITH {BARS}, {_CLOSED}, d AS (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 2 HOUR)) AS ts FROM closed GROUP BY 1),
  j AS (SELECT d.symbol, d.ts, c.close, coalesce(c.volume, 0) AS volume FROM d LEFT JOIN closed c ON d.symbol = c.symbol AND d.ts = c.ts)
  SELECT symbol, ts, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS close, volume FROM j""")
def late_and_gap(spark, sf_dir):
    return T.backfill(_bars(spark, sf_dir))


@query("T07_dedup", f"WITH {TICKS} SELECT symbol, count(*) AS n FROM ticks GROUP BY 1")
def dedup(spark, sf_dir):
    twice = T.tick_stream(spark, sf_dir).union(T.tick_stream(spark, sf_dir))
    return T.run_to_table(T.deduplicated(twice), "once").groupBy("symbol").agg(F.count("*").alias("n"))


@query("T08_bus_sink", f"WITH {BARS}, {_CLOSED} SELECT symbol, '120T' AS timeframe, arg_max(close, ts) AS close, max(ts) AS ts, epoch(TIMESTAMP '2024-02-01') - epoch(max(ts)) AS age_s FROM closed GROUP BY 1")
def bus_sink(spark, sf_dir):
    rows = T.run_batches(T.tumbling_bars(T.tick_stream(spark, sf_dir)).withColumn("timeframe", F.lit("120T")).withColumn("write_ts", F.col("ts")), "bus")
    return S.bus_latest(S.bus_keep(rows, 100), rows.select("symbol", "timeframe").distinct(), "2024-02-01")


@query("T09_stream_static", f"WITH {TICKS}, q AS (SELECT symbol, quantile_cont(price, 0.9) AS edge FROM ticks GROUP BY 1) SELECT t.symbol, tick_id, price > edge AS is_high FROM ticks t JOIN q ON t.symbol = q.symbol")
def stream_static(spark, sf_dir):
    edges = cut(group_quantiles(ticks(spark, sf_dir), ["symbol"], "price", [0.9]).select("symbol", F.col("q")[0].alias("edge")))
    joined = T.tick_stream(spark, sf_dir).join(sized_broadcast(edges), "symbol")
    return T.run_to_table(joined.select("symbol", "tick_id", (F.col("price") > F.col("edge")).alias("is_high")), "highs")


@query("T10_scheduled_monitor", f"WITH {TICKS} SELECT symbol, CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS n, round(avg(price), 6) AS mean FROM ticks WHERE ts >= (SELECT max(ts) FROM ticks) - INTERVAL 7 DAY GROUP BY 1, 2")
def monitor(spark, sf_dir):
    rows = T.run_to_table(T.tick_stream(spark, sf_dir), "monitor")
    late = S.export_window(rows, 7).groupBy("symbol", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.avg("price").alias("mean"))
    return rounded(late, "mean", keys=("symbol", "day", "n"))


@query("T11_live_staleness", f"WITH {BARS}, {_CLOSED} SELECT symbol, epoch(TIMESTAMP '2024-02-01') - epoch(max(ts)) AS age_s FROM closed GROUP BY 1")
def live_staleness(spark, sf_dir):
    last = _bars(spark, sf_dir).groupBy("symbol").agg(F.max("ts").alias("last"))
    return last.select("symbol", (F.lit("2024-02-01").cast("timestamp").cast("double") - F.col("last").cast("double")).alias("age_s"))


