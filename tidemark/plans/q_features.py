"""Window features over two-hour bars (W rows of the inventory, but for those that need ticks)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.operators import joins as J
from tidemark.operators import windows as W
from tidemark.operators.expanding import expanding_quantile
from tidemark.plans.catalog import query
from tidemark.plans.views import BARS, bars


def rounded(df: DataFrame, *columns: str, keys: tuple[str, ...] = ("symbol", "ts"), digits: int = 6) -> DataFrame:
    """Keys, and the columns as doubles rounded alike on both sides of a comparison."""
    return df.select(*keys, *(F.round(F.col(c).cast("double"), digits).alias(c) for c in columns))


def select_sql(columns: dict[str, str], source: str, keys: str = "symbol, ts", digits: int = 6) -> str:
    return f"SELECT {keys}, " + ", ".join(f"round(CAST({sql} AS DOUBLE), {digits}) AS {name}" for name, sql in columns.items()) + f" FROM {source}"


def feature(name: str, build: Callable[[DataFrame], DataFrame], columns: list[str] | dict[str, str], ctes: list[str] | None = None, source: str = "bars") -> None:
    """Registers a feature of bars; columns with their SQL over `source`, or names alone where there is no SQL."""
    sql = f"WITH RECURSIVE {', '.join([BARS, *(ctes or [])])} " + select_sql(columns, f"{source} WINDOW w AS (PARTITION BY symbol ORDER BY ts)") if isinstance(columns, dict) else None
    query(name, sql)(lambda spark, sf_dir: rounded(build(bars(spark, sf_dir)), *columns))


def w(n: int, ahead: int = 0) -> str:
    """SQL frame of n bars up to `ahead` bars from now."""
    edge = lambda k: "CURRENT ROW" if k == 0 else f"{abs(k)} {'PRECEDING' if k < 0 else 'FOLLOWING'}"
    return f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {edge(ahead - n + 1)} AND {edge(ahead)})"


SO_FAR = "(PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)"


def cte(name: str, columns: str, source: str = "bars") -> str:
    return f"{name} AS (SELECT *, {columns} FROM {source} WINDOW w AS (PARTITION BY symbol ORDER BY ts))"


def ema_cte(name: str, column: str, alpha: float, source: str = "bars") -> str:
    """A table like the source with the exponential average as `name`_v, by recursion."""
    return f"""{name}_r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn_ FROM {source}),
  {name}_e AS (SELECT symbol, rn_, CAST({column} AS DOUBLE) AS y FROM {name}_r WHERE rn_ = 1 UNION ALL
    SELECT r.symbol, r.rn_, {alpha!r} * r.{column} + (1 - {alpha!r}) * e.y FROM {name}_e e JOIN {name}_r r ON r.symbol = e.symbol AND r.rn_ = e.rn_ + 1),
  {name} AS (SELECT r.* EXCLUDE (rn_), e.y AS {name}_v FROM {name}_r r JOIN {name}_e e ON r.symbol = e.symbol AND r.rn_ = e.rn_)"""


TR = cte("tr", "greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr_v")
ATR = f"atr AS (SELECT *, avg(tr_v) OVER {w(14)} AS atr_v FROM tr)"
MOVE = cte("mv", "close - lag(close) OVER w AS d, ln(close / lag(close) OVER w) AS r")

feature("W01_atr", W.atr, {"atr": "atr_v"}, [TR, ATR], "atr")
feature("W02_ema", lambda b: W.ema(b, "close", W.span(20), "ema"), {"ema": "e_v"}, [ema_cte("e", "close", W.span(20))], "e")
feature("W03_ema_position", lambda b: W.ema_position(b, 100), {"ema_position": "(close - e_v) / close", "ema_slope": "e_v / lag(e_v, 10) OVER w - 1"}, [ema_cte("e", "close", W.span(100))], "e")
feature("W05_sma", lambda b: W.sma(b, 50), {"sma": "s", "sma_position": "(close - s) / close", "sma_slope": "s / lag(s, 5) OVER w - 1"}, [f"x AS (SELECT *, avg(close) OVER {w(50)} AS s FROM bars)"], "x")
_MACD = [TR, ATR, ema_cte("f", "close", W.span(12), "atr"), ema_cte("s", "close", W.span(26), "f"), "m AS (SELECT *, f_v - s_v AS macd FROM s)", ema_cte("g", "macd", W.span(9), "m")]
feature("W06_macd", W.macd, {"macd": "macd", "macd_signal": "g_v", "macd_histogram": "macd - g_v", "macd_atr": "macd / nullif(atr_v, 0)"}, _MACD, "g")
feature("W50_ppo", W.macd, {"ppo": "macd / s_v", "macd_signal": "g_v"}, _MACD, "g")
_EXT = [f"e AS (SELECT *, avg(close) OVER {w(12)} - avg(close) OVER {w(26)} AS x FROM bars)", f"x AS (SELECT *, avg(x) OVER {w(9)} AS sg FROM e)"]
feature("W50_macdext", lambda b: W.macdext(b, kinds=("sma", "sma", "sma")), {"macdext": "x", "macdext_signal": "sg", "macdext_histogram": "x - sg"}, _EXT, "x")
_RSI = [MOVE, f"x AS (SELECT *, avg(CASE WHEN d IS NOT NULL THEN greatest(d, 0) END) OVER {w(14)} AS g, avg(CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END) OVER {w(14)} AS l FROM mv)"]
feature("W07_rsi", W.rsi, {"rsi": "CASE WHEN g + l > 0 THEN 100 * g / (g + l) WHEN g IS NOT NULL THEN 50 END"}, _RSI, "x")
_ADX = [
    cte("u", "coalesce(high - lag(high) OVER w, 0) AS up, coalesce(lag(low) OVER w - low, 0) AS down", "tr"),
    "p AS (SELECT *, CASE WHEN up > down AND up > 0 THEN up ELSE 0 END AS plus, CASE WHEN down > up AND down > 0 THEN down ELSE 0 END AS minus FROM u)",
    ema_cte("a", "plus", 1.0 / 14, "p"), ema_cte("b", "minus", 1.0 / 14, "a"), ema_cte("c", "tr_v", 1.0 / 14, "b"),
    "di AS (SELECT *, coalesce(100 * a_v / nullif(c_v, 0), 0) AS pdi, coalesce(100 * b_v / nullif(c_v, 0), 0) AS mdi FROM c)",
    "dx AS (SELECT *, CASE WHEN pdi + mdi > 0 THEN 100 * abs(pdi - mdi) / (pdi + mdi) ELSE 0 END AS dx_v FROM di)", ema_cte("x", "dx_v", 1.0 / 14, "dx"),
]
feature("W08_adx", W.adx, {"adx": "x_v", "plus_di": "pdi", "minus_di": "mdi"}, [TR, *_ADX], "x")
feature("W09_roc", lambda b: W.acceleration(W.roc(b, 5)), {"roc": "close / lag(close, 5) OVER w - 1", "acceleration": "r3 - lag(r3, 3) OVER w"}, [cte("x", "close / lag(close, 3) OVER w - 1 AS r3")], "x")
_BB = f"bb AS (SELECT *, avg(close) OVER {w(20)} AS m, stddev_pop(close) OVER {w(20)} AS s FROM bars)"
feature("W10_bollinger", W.bollinger, {"bb_mid": "m", "bb_lower": "m - 2 * s", "bb_upper": "m + 2 * s", "bb_width": "4 * s / m"}, [_BB], "bb")
feature("W11_trend_r2", W.trend_r2, {"trend_r2": f"regr_r2(close, i) OVER {w(20)}"}, [cte("x", "CAST(row_number() OVER w AS DOUBLE) AS i")], "x")
feature("W12_rolling_rank", lambda b: W.rolling_rank(b, "close", 50, "close_rank"), {"close_rank": "len(list_filter(l, lambda x: x <= close)) / len(l)"}, [f"x AS (SELECT *, list(close) OVER {w(50)} AS l FROM bars)"], "x")
feature("W13_zscore", lambda b: W.zscore(b, "close", 50, "z"), {"z": f"CASE WHEN stddev_pop(close) OVER {w(50)} > 1e-12 THEN (close - avg(close) OVER {w(50)}) / stddev_pop(close) OVER {w(50)} END"})
_BEFORE = "(PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
feature("W14_expanding_quantile", lambda b: expanding_quantile(b, "close", 0.8), {"threshold": f"CASE WHEN count(close) OVER {_BEFORE} >= 50 THEN quantile_cont(close, 0.8) OVER {_BEFORE} END"})
_CANDLE = {"upper_wick": "(high - greatest(open, close)) / nullif(high - low, 0)", "lower_wick": "(least(open, close) - low) / nullif(high - low, 0)", "body_ratio": "(greatest(open, close) - least(open, close)) / nullif(high - low, 0)", "range_ratio": f"(high - low) / nullif(avg(high - low) OVER {w(5)}, 0)"}
feature("W15_candle_shape", W.candle_shape, _CANDLE)
feature("W16_volume_ratio", W.volume_ratio, {"volume_ratio": f"volume / nullif(avg(volume) OVER {w(20)}, 0)"})
_BOX = [
    f"h AS (SELECT *, max(high) OVER {w(60)} AS hi, min(low) OVER {w(60)} AS lo, CASE WHEN close <= max(high) OVER {w(60, -1)} AND close >= min(low) OVER {w(60, -1)} THEN 1.0 ELSE 0.0 END AS inside FROM bars)",
    "p AS (SELECT *, (close - lo) / nullif(hi - lo, 0) AS pos FROM h)",
]
_touch = lambda c: f"sum(CASE WHEN {c} THEN 1 ELSE 0 END) OVER {w(60)}"
feature("W23_box", W.box, {"box_pos": "pos", "box_width": "(hi - lo) / close", "box_stability": f"avg(inside) OVER {w(60)}", "box_touch_high": _touch("pos >= 0.9"), "box_touch_low": _touch("pos <= 0.1")}, _BOX, "p")
feature("W24_breakout", W.breakout, {"breakout": f"CASE WHEN close > max(high) OVER {w(20, -1)} THEN 1 WHEN close < min(low) OVER {w(20, -1)} THEN -1 ELSE 0 END"})
_PULL = [f"x AS (SELECT *, max(high) OVER {w(240)} AS hi, min(low) OVER {w(240)} AS lo FROM bars)"]
feature("W25_pullback_depth", W.pullback_depth, {"pullback_long": "(hi - close) / hi", "pullback_short": "(close - lo) / nullif(hi - lo, 0)"}, _PULL, "x")
_SINCE = [cte("i", "row_number() OVER w AS i"), f"x AS (SELECT *, arg_max(i, (high, i)) OVER {w(50)} AS t, arg_min(i, (low, -i)) OVER {w(50)} AS b FROM i)"]
feature("W26_bars_since_extreme", W.bars_since_extreme, {"since_high": "(i - t) / 50.0", "since_low": "(i - b) / 50.0"}, _SINCE, "x")
_PATH = [MOVE, f"x AS (SELECT *, sum(d) OVER {w(20)} AS net, nullif(sum(abs(d)) OVER {w(20)}, 0) AS way, max(abs(d)) OVER {w(20)} AS big, abs(avg(sign(d)) OVER {w(20)}) AS same FROM mv)"]
feature("W27_path", W.path, {"path_efficiency": "abs(net) / way", "path_length": "way", "jump_risk": "big / way", "dir_consistency": "same"}, _PATH, "x")
_VWAP = [f"x AS (SELECT *, sum((high + low + close) / 3 * volume) OVER {w(48)} / nullif(sum(volume) OVER {w(48)}, 0) AS v FROM bars)"]
feature("W28_vwap_position", W.vwap_position, {"vwap": "v", "vwap_position": "(close - v) / close"}, _VWAP, "x")


def ema_over_vwap(b: DataFrame) -> DataFrame:
    """1 where the average crosses the volume-weighted price upwards."""
    b = W.ema(W.vwap_position(b), "close", W.span(20), "ema")
    return b.withColumn("cross_up", W.crossed(F.coalesce(F.col("ema") > F.col("vwap"), F.lit(False))).cast("int"))


feature("W29_cross_event", ema_over_vwap, {"cross_up": "CASE WHEN up AND NOT coalesce(lag(up) OVER w, false) THEN 1 ELSE 0 END"}, [*_VWAP, ema_cte("e", "close", W.span(20), "x"), "c AS (SELECT *, coalesce(e_v > v, false) AS up FROM e)"], "c")
_VOL = [MOVE, cte("a", "abs(r) AS av, lag(abs(r)) OVER w AS ab, lag(r) OVER w AS rb", "mv")]
feature("W30_volatility", W.volatility, {"volatility_regime": f"stddev_pop(r) OVER {w(10)} / nullif(stddev_pop(r) OVER {w(50)}, 0)", "vol_persistence": f"corr(av, ab) OVER {w(50)}", "vol_leverage_asymmetry": f"corr(rb, av) OVER {w(50)}"}, _VOL, "a")
_TAIL = [MOVE, f"x AS (SELECT *, quantile_cont(-r, 0.99) OVER {w(100)} AS q, list(-r) OVER {w(100)} AS l FROM mv)"]
feature("W31_tail_risk", W.tail_risk, {"evt_var_99": "q", "evt_es_99": "list_avg(list_filter(l, lambda x: x >= q))", "evt_tail_shape": "CASE WHEN len(list_filter(l, lambda x: x > 0)) >= 11 THEN list_avg(list_transform(list_reverse_sort(list_filter(l, lambda x: x > 0))[1:10], lambda x: ln(x / list_reverse_sort(list_filter(l, lambda y: y > 0))[11]))) END"}, _TAIL, "x")
_lags = (1, 2, 4, 8)
_HURST = [cte("d", ", ".join(f"close - lag(close, {t}) OVER w AS d{t}" for t in _lags)), "s AS (SELECT *, " + ", ".join(f"ln(nullif(stddev_pop(d{t}) OVER {w(64)}, 0)) AS s{t}" for t in _lags) + f", count(close) OVER {w(64)} AS k FROM d)"]
feature("W32_hurst", W.hurst, {"hurst": "CASE WHEN k = 64 THEN (-1.5 * s1 - 0.5 * s2 + 0.5 * s4 + 1.5 * s8) / (5 * ln(2)) END"}, _HURST, "s")
_POWER = [
    cte("rt", "coalesce(ln(close / lag(close) OVER w), 0) AS r"), f"wn AS (SELECT *, list(r) OVER {w(64)} AS x FROM rt)",
    "pw AS (SELECT *, CASE WHEN len(x) = 64 THEN list_transform(range(1, 33), lambda k: list_sum(list_transform(x, lambda v, t: v * cos(2 * pi() / 64 * k * t))) ** 2 + list_sum(list_transform(x, lambda v, t: v * sin(2 * pi() / 64 * k * t))) ** 2 + 1e-18) END AS p FROM wn)",
]
feature("W33_spectrum", W.spectrum, {"spectrum_flatness": "exp(list_avg(list_transform(p, lambda v: ln(v)))) / list_avg(p)", "spectrum_high_share": "list_sum(p[17:32]) / list_sum(p)", "spectrum_entropy": "-list_sum(list_transform(p, lambda v: v / list_sum(p) * ln(v / list_sum(p)))) / ln(32)"}, _POWER, "pw")
_HALVE = "flatten(list_transform({}, lambda b: [list_transform(range(1, len(b) // 2 + 1), lambda k: (b[2 * k - 1] + b[2 * k]) / sqrt(2)), list_transform(range(1, len(b) // 2 + 1), lambda k: (b[2 * k - 1] - b[2 * k]) / sqrt(2))]))"
_PACKETS = [
    cte("mo", "row_number() OVER w AS i, coalesce(close - lag(close) OVER w, 0) AS d"), f"wn AS (SELECT *, list(d) OVER {w(96)} AS x FROM mo)", "b0 AS (SELECT *, CASE WHEN len(x) = 96 AND i % 5 = 0 THEN [x] END AS k0 FROM wn)",
    *(f"b{k + 1} AS (SELECT *, {_HALVE.format(f'k{k}')} AS k{k + 1} FROM b{k})" for k in range(4)),
    "en AS (SELECT *, list_transform(k4, lambda b: list_sum(list_transform(b, lambda v: v * v))) AS e FROM b4)",
]
_band = lambda a, z: f"last_value(list_sum(e[{a}:{z}]) / nullif(list_sum(e), 0) IGNORE NULLS) OVER {SO_FAR}"
feature("W34_wpt_energy", W.haar_energy, {"wpt_low": _band(1, 4), "wpt_mid": _band(5, 8), "wpt_high": _band(9, 16)}, _PACKETS, "en")


def rank_interaction(b: DataFrame) -> DataFrame:
    """Product of the ranks of price and volume."""
    b = W.rolling_rank(W.rolling_rank(b, "close", 50, "_a"), "volume", 50, "_b")
    return b.withColumn("close_x_volume_rank", F.col("_a") * F.col("_b"))


feature("W39_rank_interaction", rank_interaction, {"close_x_volume_rank": "len(list_filter(l, lambda x: x <= close)) / len(l) * len(list_filter(m, lambda x: x <= volume)) / len(m)"}, [f"x AS (SELECT *, list(close) OVER {w(50)} AS l, list(volume) OVER {w(50)} AS m FROM bars)"], "x")
feature("W40_time_features", lambda b: b.withColumn("hour_sin", F.sin(2 * 3.141592653589793 * F.hour("ts") / 24)), {"hour_sin": "sin(2 * pi() * hour(ts) / 24)"})
_RANKED = [f"x AS (SELECT *, list(close) OVER {w(50)} AS l FROM bars)", "q AS (SELECT *, len(list_filter(l, lambda x: x <= close)) / len(l) AS c FROM x)"]
_HYST = [
    *_RANKED, "e AS (SELECT *, CASE WHEN c >= 0.52 THEN 1 WHEN c < 0.33 THEN 0 END AS ev FROM q)",
    f"s AS (SELECT *, coalesce(last_value(ev IGNORE NULLS) OVER {SO_FAR}, 0) AS st FROM e)",
    cte("g", "CASE WHEN st <> coalesce(lag(st) OVER w, -1) THEN 1 ELSE 0 END AS ch", "s"), f"n AS (SELECT *, sum(ch) OVER {SO_FAR} AS seg FROM g)",
]
feature("W41_hysteresis", lambda b: W.hysteresis(W.rolling_rank(b, "close", 50, "c"), "c", 0.52, 0.33), {"state": "st", "segment": "seg", "segment_length": "count(*) OVER (PARTITION BY symbol, seg)"}, _HYST, "n")
feature("W42_drift_series", lambda b: W.drift_series(b, F.col("close") > F.col("open")), {"activation_rate": f"CASE WHEN count(*) OVER {w(60)} >= 30 THEN avg(CASE WHEN close > open THEN 1.0 ELSE 0.0 END) OVER {w(60)} END"})
feature("W43_drawdown", W.drawdown, {"drawdown": f"(close - max(close) OVER {SO_FAR}) / max(close) OVER {SO_FAR}"})
feature("W44_ts_quantile", lambda b: W.rolling_rank(W.trend_r2(b), "trend_r2", 100, "chop_ts_q"), {"chop_ts_q": "CASE WHEN t IS NOT NULL THEN len(list_filter(l, lambda x: x <= t)) / len(list_filter(l, lambda x: x IS NOT NULL)) END"}, [cte("i", "CAST(row_number() OVER w AS DOUBLE) AS i"), f"t AS (SELECT *, regr_r2(close, i) OVER {w(20)} AS t FROM i)", f"x AS (SELECT *, list(t) OVER {w(100)} AS l FROM t)"], "x")
feature("W45_composite_score", lambda b: W.volume_ratio(W.rsi(b)).withColumn("score", W.composite_score([("rsi", 30, 70, 2), ("volume_ratio", 0, 2, 1)])), {"score": f"greatest(0, least(1, (CASE WHEN g + l > 0 THEN 100 * g / (g + l) WHEN g IS NOT NULL THEN 50 END - 30) / 40)) * 2 / 3 + greatest(0, least(1, volume / nullif(avg(volume) OVER {w(20)}, 0) / 2)) / 3"}, _RSI, "x")
feature("W46_cross_sectional_rank", lambda b: W.cross_sectional_rank(b, "close"), {"cs_rank": "percent_rank() OVER (PARTITION BY ts ORDER BY close)"})
_SWING = [
    TR, ATR,
    "m AS (SELECT *, max(high) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS mh, min(low) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS ml FROM atr)",
    "z AS (SELECT *, CASE WHEN high = mh THEN high END AS sh, CASE WHEN low = ml THEN low END AS sl FROM m)",
    f"y AS (SELECT *, last_value(sh IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 3 PRECEDING) AS h3, last_value(sl IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 3 PRECEDING) AS l3, list(high) OVER {w(50)} AS hs FROM z)",
]
feature("W48_sr_levels", W.swing_levels, {"swing_high": "h3", "swing_low": "l3", "dist_to_swing_high_atr": "(h3 - close) / nullif(atr_v, 0)", "sr_strength": "CASE WHEN h3 IS NOT NULL THEN len(list_filter(hs, lambda x: abs(x - h3) <= 0.5 * atr_v)) END"}, _SWING, "y")
_SQUEEZE = [
    _BB, f"x AS (SELECT *, 4 * s / m AS bw, list(4 * s / m) OVER {w(60)} AS l FROM bb)", "c AS (SELECT *, CASE WHEN len(list_filter(l, lambda x: x <= bw)) / len(l) < 0.2 THEN 1 ELSE 0 END AS on_ FROM x)",
    f"g AS (SELECT *, sum(1 - on_) OVER {SO_FAR} AS grp FROM c)",
]
feature("W49_compression_duration", W.compression_duration, {"compression_duration": "sum(on_) OVER (PARTITION BY symbol, grp ORDER BY ts ROWS UNBOUNDED PRECEDING)"}, _SQUEEZE, "g")


def weekly_position(b: DataFrame, n: int = 4) -> DataFrame:
    """(close - weekly average) / close, with the average of the last week that had ended."""
    weeks = W.ema(B.resample(b, "7 days"), "close", W.span(n), "weekly_ema").select("symbol", (F.col("ts") + F.expr("interval 7 days")).alias("ts"), "weekly_ema")
    return J.asof_join(b, weeks, "symbol", "ts", ["weekly_ema"]).withColumn("weekly_ema_position", (F.col("close") - F.col("weekly_ema")) / F.col("close"))


_WEEK = ["wk AS (SELECT symbol, time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS ts, arg_max(close, ts) AS close FROM bars GROUP BY 1, 2)", ema_cte("e", "close", W.span(4), "wk"), "j AS (SELECT b.*, x.e_v FROM bars b ASOF LEFT JOIN (SELECT symbol, ts + INTERVAL 7 DAY AS ts, e_v FROM e) x ON b.symbol = x.symbol AND b.ts >= x.ts)"]
feature("W04_weekly_ema_position", weekly_position, {"weekly_ema_position": "(close - e_v) / close"}, _WEEK, "j")
