"""Order-flow features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import flow as O
from tidemark.operators import windows as W
from tidemark.plans.catalog import query
from tidemark.plans.q_features import ATR, SO_FAR, TR, cte, feature, rounded, w
from tidemark.plans.views import BARS, TICKS, bars, ticks

_r = lambda s, n: f"round(CAST({s} AS DOUBLE), 6) AS {n}"
_CVD = f"c AS (SELECT *, sum(flow) OVER {SO_FAR} AS cvd FROM bars)"
feature("W17_cvd", O.cvd, {"cvd": "cvd", "cvd_change_5": "cvd - lag(cvd, 5) OVER w", "cvd_roll": f"sum(flow) OVER {w(20)}"}, [_CVD], "c")


@query("W18_vpin", f"""WITH {TICKS}, t AS (SELECT *, floor((sum(qty) OVER (PARTITION BY symbol ORDER BY ts, tick_id ROWS UNBOUNDED PRECEDING) - 1e-9) / 500) AS bucket FROM ticks),
  b AS (SELECT symbol, bucket, max(ts) AS ts, abs(sum(qty * side)) AS g, sum(qty) AS v FROM t GROUP BY 1, 2)
  SELECT symbol, CAST(bucket AS BIGINT) AS bucket, ts, CASE WHEN count(*) OVER r = 20 THEN round(avg(g / nullif(v, 0)) OVER r, 6) END AS vpin FROM b WINDOW r AS (PARTITION BY symbol ORDER BY bucket ROWS 19 PRECEDING)""")
def vpin(spark, sf_dir):
    return O.vpin(ticks(spark, sf_dir), 500.0).withColumn("vpin", F.round("vpin", 6))


feature("W19_ofi", O.ofi, {"ofi": f"sum(flow) OVER {w(5)} / nullif(sum(volume) OVER {w(5)}, 0)"})
_BAR = "time_bucket(INTERVAL '{} hours', ts, TIMESTAMP '1970-01-01')"


@query("W20_trade_runs", f"""WITH {TICKS}, a AS (SELECT *, {_BAR.format(2)} AS b FROM ticks), c AS (SELECT *, CASE WHEN side = lag(side) OVER (PARTITION BY symbol, b ORDER BY ts, tick_id) THEN 0 ELSE 1 END AS nw FROM a),
  d AS (SELECT *, sum(nw) OVER (PARTITION BY symbol, b ORDER BY ts, tick_id ROWS UNBOUNDED PRECEDING) AS run FROM c), e AS (SELECT symbol, b, run, any_value(side) AS side, count(*) AS len FROM d GROUP BY 1, 2, 3),
  g AS (SELECT symbol, b AS ts, coalesce(max(len) FILTER (side > 0), 0) AS max_buy_run, coalesce(max(len) FILTER (side < 0), 0) AS max_sell_run, sum(side) AS net_runs, count(*) AS n_runs, coalesce(sum(len) FILTER (side > 0), 0) / sum(len) AS p FROM e GROUP BY 1, 2)
  SELECT symbol, ts, max_buy_run, max_sell_run, CAST(net_runs AS BIGINT) AS net_runs, n_runs, round(CASE WHEN p > 0 AND p < 1 THEN -(p * ln(p) + (1 - p) * ln(1 - p)) ELSE 0 END, 6) AS run_entropy FROM g""")
def trade_runs(spark, sf_dir):
    return O.trade_runs(ticks(spark, sf_dir)).withColumn("run_entropy", F.round("run_entropy", 6))


@query("W21_footprint", f"WITH {TICKS}, l AS (SELECT symbol, {_BAR.format(2)} AS ts, floor(price / 10) AS lv, coalesce(sum(qty) FILTER (side > 0), 0) AS b, sum(qty) AS a FROM ticks GROUP BY 1, 2, 3) SELECT symbol, ts, {_r('max(abs(2 * b - a) / nullif(a, 0))', 'fp_max_imbalance')}, count(*) AS fp_levels FROM l GROUP BY 1, 2")
def footprint(spark, sf_dir):
    return O.footprint(ticks(spark, sf_dir)).withColumn("fp_max_imbalance", F.round("fp_max_imbalance", 6))


@query("W22_volume_profile", f"""WITH {TICKS}, l AS (SELECT symbol, {_BAR.format(24)} AS ts, floor(price / 10) AS lv, sum(qty) AS v FROM ticks GROUP BY 1, 2, 3),
  r AS (SELECT *, sum(v) OVER (PARTITION BY symbol, ts ORDER BY v DESC, lv ROWS UNBOUNDED PRECEDING) AS run, sum(v) OVER (PARTITION BY symbol, ts) AS a FROM l)
  SELECT symbol, ts, (arg_max(lv, (v, -lv)) + 0.5) * 10 AS poc, (min(lv) FILTER (run - v < 0.7 * a) + 0.5) * 10 AS value_low, (max(lv) FILTER (run - v < 0.7 * a) + 0.5) * 10 AS value_high FROM r GROUP BY 1, 2""")
def volume_profile(spark, sf_dir):
    return O.volume_profile(ticks(spark, sf_dir)).drop("levels")


@query("W22_nearest_level", f"""WITH {BARS}, l AS (SELECT symbol, {_BAR.format(24)} AS day, floor(price / 10) AS lv, sum(qty) AS v FROM ticks GROUP BY 1, 2, 3),
  m AS (SELECT *, avg(v) OVER (PARTITION BY symbol, day) AS m FROM l), p AS (SELECT symbol, day + INTERVAL 1 DAY AS known, list((lv + 0.5) * 10) FILTER (v >= m) AS levels FROM m GROUP BY 1, 2)
  SELECT b.symbol, b.ts, {_r('list_min(list_transform(levels, lambda x: abs(x - close))) / nullif(close, 0)', 'dist_to_nearest_sr')} FROM bars b ASOF LEFT JOIN p ON b.symbol = p.symbol AND b.ts >= p.known""")
def nearest_level(spark, sf_dir):
    t = ticks(spark, sf_dir)
    return rounded(O.dist_to_nearest_sr(bars(spark, sf_dir), O.volume_profile(t)), "dist_to_nearest_sr")


def _with_aux(b):
    """Open interest as the running number of ticks, funding as flow over volume."""
    return W.atr(b).withColumn("oi", F.col("n") * F.lit(1.0) + F.col("volume") / 10).withColumn("funding", F.col("flow") / F.nullif("volume", F.lit(0.0)))


_AUX = "x AS (SELECT *, n + volume / 10 AS oi, flow / nullif(volume, 0) AS funding FROM bars)"
_z = lambda c: f"CASE WHEN stddev_pop({c}) OVER {w(50)} > 1e-12 THEN ({c} - avg({c}) OVER {w(50)}) / stddev_pop({c}) OVER {w(50)} END"
feature("W35_oi_funding", lambda b: O.oi_funding(_with_aux(b), "oi", "funding"), {"oi_change": "oi / nullif(lag(oi) OVER w, 0) - 1", "oi_zscore": _z("oi"), "crowding": f"({_z('oi')}) * ({_z('funding')})"}, [_AUX], "x")
_LIQ = [_AUX, cte("y", "abs(ln(close / lag(close) OVER w)) AS a, lag(oi) OVER w - oi AS d", "x")]
_pos = lambda c: f"greatest(coalesce({_z(c)}, 0), 0)"
feature("W36_liq_proxy", lambda b: O.liquidation_proxy(_with_aux(b), "oi"), {"liq_proxy": f"{_pos('a')} * {_pos('volume')} * {_pos('d')}"}, _LIQ, "y")


@query("W37_wall", f"""WITH {BARS}, {TR}, {ATR}, l AS (SELECT symbol, {_BAR.format(2)} AS ts, (floor(price / 10) + 0.5) * 10 AS level, sum(qty) AS size FROM ticks GROUP BY 1, 2, 3),
  m AS (SELECT *, avg(size) OVER (PARTITION BY symbol, ts) AS m FROM l), k AS (SELECT symbol, ts, level FROM m WHERE size >= 1.5 * m)
  SELECT a.symbol, a.ts, {_r('min(abs(level - close) / nullif(atr_v, 0))', 'wall_nearest_dist_atr')} FROM atr a LEFT JOIN k ON a.symbol = k.symbol AND a.ts = k.ts GROUP BY 1, 2""")
def wall(spark, sf_dir):
    depth = ticks(spark, sf_dir).groupBy("symbol", F.window("ts", "2 hours")["start"].alias("ts"), ((F.floor(F.col("price") / 10) + 0.5) * 10).alias("level")).agg(F.sum("qty").alias("size"))
    return rounded(O.wall(W.atr(bars(spark, sf_dir)), depth, 1.5), "wall_nearest_dist_atr")


_DIV = [_CVD, cte("y", "close - lag(close, 5) OVER w AS p, cvd - lag(cvd, 5) OVER w AS q", "c"), f"z AS (SELECT *, {_z('p')} AS zp, {_z('q')} AS zc FROM y)"]
feature("W38_divergence", lambda b: O.divergence(O.cvd(b)), {"cvd_divergence": "CASE WHEN sign(zp) * sign(zc) < 0 THEN sign(zc) * least(1, least(abs(zp), abs(zc))) ELSE 0 END"}, _DIV, "z")
feature("W47_cap_normalized_flow", O.normalized_flow, {"normalized_flow": f"sum(flow * close) OVER {w(50)} / nullif(avg(volume * close) OVER {w(50)}, 0)"})
