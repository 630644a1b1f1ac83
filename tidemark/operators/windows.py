"""Window features: trailing, bar-counted, one symbol at a time, never looking ahead.

Each function adds columns to a frame keyed by (symbol, ts). Rows are ordered by ts within a symbol.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def order():
    """A symbol's rows by time."""
    return Window.partitionBy("symbol").orderBy("ts")


def over(n: int, ahead: int = 0):
    """The last n bars up to `ahead` bars from now (negative: before now)."""
    return order().rowsBetween(ahead - n + 1, ahead)


def lag(c: str, n: int = 1) -> Column:
    return F.lag(c, n).over(order())


def true_range() -> Column:
    before = lag("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def atr(df: DataFrame, n: int = 14, out: str = "atr") -> DataFrame:
    """Mean true range of n bars."""
    return df.withColumn("_tr", true_range()).withColumn(out, F.avg("_tr").over(over(n))).drop("_tr")


def ema(df: DataFrame, c: str, alpha: float, out: str, block: int = 256) -> DataFrame:
    """Exponential average, seeded with the first value: y = alpha x + (1 - alpha) y before; a null x leaves y as it is.

    A linear recursion is a block-wise affine scan: within blocks of `block` bars the sum of x q^-k scaled by q^k
    (all weights positive, so nothing cancels), then one short fold over the blocks of a symbol for what they carry
    on. Long series spread over many tasks by (symbol, block).
    """
    q = 1.0 - alpha
    so_far = order().rowsBetween(Window.unboundedPreceding, 0)
    if q <= 0:
        return df.withColumn(out, F.last(F.col(c).cast("double"), ignorenulls=True).over(so_far))
    block = max(1, min(block, int(200 / -math.log10(q)))) if q < 1 else block  # weights stay within doubles
    rows = df.withColumn("_n", F.count(c).over(so_far) - 1).withColumn("_b", F.floor(F.col("_n") / block)).withColumn("_k", F.col("_n") % block)
    inside = Window.partitionBy("symbol", "_b").orderBy("ts")
    weight = F.when(F.col("_n") == 0, F.lit(1.0)).otherwise(F.lit(alpha))
    rows = rows.withColumn("_s", F.sum(F.col(c) * weight * F.pow(F.lit(q), -F.col("_k"))).over(inside.rowsBetween(Window.unboundedPreceding, 0)) * F.pow(F.lit(q), F.col("_k")))
    ends = rows.where("_n >= 0").groupBy("symbol", "_b").agg(F.max_by("_s", "_n").alias("e"), (F.max("_k") + 1).alias("len"))
    chain = ends.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("_b", "e", "len"))).alias("blocks"))
    step = lambda acc, x: F.array_append(acc, x["e"] + F.pow(F.lit(q), x["len"]) * F.coalesce(F.element_at(acc, -1), F.lit(0.0)))
    carried = chain.select("symbol", F.aggregate("blocks", F.array().cast("array<double>"), lambda acc, x: F.when(F.size(acc) == 0, F.array(x["e"])).otherwise(step(acc, x))).alias("y"))
    carried = carried.select("symbol", F.posexplode("y").alias("_p", "_carry")).select("symbol", (F.col("_p") + 1).cast("long").alias("_b"), "_carry")
    joined = rows.join(carried, ["symbol", "_b"], "left")
    return joined.withColumn(out, F.when(F.col("_n") >= 0, F.col("_s") + F.coalesce(F.col("_carry"), F.lit(0.0)) * F.pow(F.lit(q), F.col("_k") + 1))).drop("_n", "_b", "_k", "_s", "_carry")


def span(n: int) -> float:
    return 2.0 / (n + 1)


def ema_position(df: DataFrame, n: int, slope: int = 10) -> DataFrame:
    """(close - ema) / close and the ema's relative change over `slope` bars."""
    df = ema(df, "close", span(n), "ema")
    return df.withColumn("ema_position", (F.col("close") - F.col("ema")) / F.col("close")).withColumn("ema_slope", F.col("ema") / lag("ema", slope) - 1)


def sma(df: DataFrame, n: int, slope: int = 5) -> DataFrame:
    """Mean close of n bars, position and slope."""
    df = df.withColumn("sma", F.avg("close").over(over(n)))
    return df.withColumn("sma_position", (F.col("close") - F.col("sma")) / F.col("close")).withColumn("sma_slope", F.col("sma") / lag("sma", slope) - 1)


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    df = ema(ema(df, "close", span(fast), "_fast"), "close", span(slow), "_slow").withColumn("macd", F.col("_fast") - F.col("_slow"))
    df = ema(df, "macd", span(signal), "macd_signal").withColumn("macd_histogram", F.col("macd") - F.col("macd_signal"))
    df = atr(df, 14, "_atr")
    return df.withColumn("macd_atr", F.col("macd") / F.nullif("_atr", F.lit(0.0))).withColumn("ppo", F.col("macd") / F.col("_slow")).drop("_fast", "_slow", "_atr")


def macdext(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, kinds: tuple[str, str, str] = ("ema", "ema", "ema")) -> DataFrame:
    """macd with a kind of average (ema or sma) for each of its three lines."""

    def average(df: DataFrame, c: str, n: int, out: str, kind: str) -> DataFrame:
        return ema(df, c, span(n), out) if kind == "ema" else df.withColumn(out, F.avg(c).over(over(n)))

    df = average(average(df, "close", fast, "_fast", kinds[0]), "close", slow, "_slow", kinds[1]).withColumn("macdext", F.col("_fast") - F.col("_slow"))
    df = average(df, "macdext", signal, "macdext_signal", kinds[2]).drop("_fast", "_slow")
    return df.withColumn("macdext_histogram", F.col("macdext") - F.col("macdext_signal"))


def rsi(df: DataFrame, n: int = 14) -> DataFrame:
    """100 gain / (gain + loss) over the mean gains and losses of n bars; 50 where nothing moved."""
    d = F.col("close") - lag("close")
    gain, loss = F.avg("_up").over(over(n)), F.avg("_down").over(over(n))
    df = df.withColumn("_d", d).withColumn("_up", F.greatest("_d", F.lit(0.0))).withColumn("_down", F.greatest(-F.col("_d"), F.lit(0.0)))
    df = df.withColumn("_up", F.when(F.col("_d").isNotNull(), F.col("_up"))).withColumn("_down", F.when(F.col("_d").isNotNull(), F.col("_down")))
    return df.withColumn("_g", gain).withColumn("_l", loss).withColumn("rsi", F.when(F.col("_g") + F.col("_l") > 0, 100 * F.col("_g") / (F.col("_g") + F.col("_l"))).when(F.col("_g").isNotNull(), F.lit(50.0))).drop("_d", "_up", "_down", "_g", "_l")


def adx(df: DataFrame, n: int = 14) -> DataFrame:
    """Directional index: smoothed (alpha 1/n) directional moves over smoothed true range, and the average of their contrast."""
    up, down = F.col("high") - lag("high"), lag("low") - F.col("low")
    df = df.withColumn("_u", F.coalesce(up, F.lit(0.0))).withColumn("_v", F.coalesce(down, F.lit(0.0))).withColumn("_tr", true_range())
    df = df.withColumn("_p", F.when((F.col("_u") > F.col("_v")) & (F.col("_u") > 0), F.col("_u")).otherwise(0.0)).withColumn("_m", F.when((F.col("_v") > F.col("_u")) & (F.col("_v") > 0), F.col("_v")).otherwise(0.0))
    for c, o in (("_p", "_sp"), ("_m", "_sm"), ("_tr", "_st")):
        df = ema(df, c, 1.0 / n, o)
    df = df.withColumn("plus_di", F.coalesce(100 * F.col("_sp") / F.nullif("_st", F.lit(0.0)), F.lit(0.0))).withColumn("minus_di", F.coalesce(100 * F.col("_sm") / F.nullif("_st", F.lit(0.0)), F.lit(0.0)))
    total = F.col("plus_di") + F.col("minus_di")
    df = df.withColumn("_dx", F.when(total > 0, 100 * F.abs(F.col("plus_di") - F.col("minus_di")) / total).otherwise(0.0))
    return ema(df, "_dx", 1.0 / n, "adx").drop("_u", "_v", "_tr", "_p", "_m", "_sp", "_sm", "_st", "_dx")


def roc(df: DataFrame, n: int = 5, out: str = "roc") -> DataFrame:
    return df.withColumn(out, F.col("close") / lag("close", n) - 1)


def acceleration(df: DataFrame, n: int = 3) -> DataFrame:
    """Change of the rate of change over n bars."""
    return roc(df, n, "_roc").withColumn("acceleration", F.col("_roc") - lag("_roc", n)).drop("_roc")


def bollinger(df: DataFrame, n: int = 20, width: float = 2.0) -> DataFrame:
    df = df.withColumn("bb_mid", F.avg("close").over(over(n))).withColumn("_s", F.stddev_pop("close").over(over(n)))
    df = df.withColumn("bb_lower", F.col("bb_mid") - width * F.col("_s")).withColumn("bb_upper", F.col("bb_mid") + width * F.col("_s"))
    return df.withColumn("bb_width", 2 * width * F.col("_s") / F.col("bb_mid")).drop("_s")


def trend_r2(df: DataFrame, n: int = 20, out: str = "trend_r2") -> DataFrame:
    """Share of the variance of n closes that a line over time explains."""
    return df.withColumn("_i", F.row_number().over(order()).cast("double")).withColumn(out, F.regr_r2("close", "_i").over(over(n))).drop("_i")


def rolling_rank(df: DataFrame, c: str, n: int, out: str) -> DataFrame:
    """Share of the last n values, now included, that are no larger than the value now."""
    df = df.withColumn("_l", F.collect_list(c).over(over(n)))
    small = F.aggregate("_l", F.lit(0), lambda t, x: t + F.when(x <= F.col(c), 1).otherwise(0))
    return df.withColumn(out, F.when(F.col(c).isNotNull(), small / F.size("_l"))).drop("_l")


def zscore(df: DataFrame, c: str, n: int, out: str) -> DataFrame:
    """(x - mean) / population standard deviation of n bars; null where nothing varies."""
    return df.withColumn("_m", F.avg(c).over(over(n))).withColumn("_s", F.stddev_pop(c).over(over(n))).withColumn(out, F.when(F.col("_s") > 1e-12, (F.col(c) - F.col("_m")) / F.col("_s"))).drop("_m", "_s")


def candle_shape(df: DataFrame) -> DataFrame:
    size = F.nullif(F.col("high") - F.col("low"), F.lit(0.0))
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    df = df.withColumn("upper_wick", (F.col("high") - top) / size).withColumn("lower_wick", (bottom - F.col("low")) / size).withColumn("body_ratio", (top - bottom) / size)
    return df.withColumn("_r", F.col("high") - F.col("low")).withColumn("range_ratio", F.col("_r") / F.nullif(F.avg("_r").over(over(5)), F.lit(0.0))).drop("_r")


def volume_ratio(df: DataFrame, n: int = 20) -> DataFrame:
    return df.withColumn("volume_ratio", F.col("volume") / F.nullif(F.avg("volume").over(over(n)), F.lit(0.0)))


def box(df: DataFrame, n: int = 60, edge: float = 0.1) -> DataFrame:
    """Position in and width of the range of n bars, share of closes inside the range before it, touches near its edges."""
    df = df.withColumn("_hi", F.max("high").over(over(n))).withColumn("_lo", F.min("low").over(over(n)))
    size = F.col("_hi") - F.col("_lo")
    df = df.withColumn("box_pos", (F.col("close") - F.col("_lo")) / F.nullif(size, F.lit(0.0))).withColumn("box_width", size / F.col("close"))
    df = df.withColumn("_in", F.when((F.col("close") <= F.max("high").over(over(n, -1))) & (F.col("close") >= F.min("low").over(over(n, -1))), 1.0).otherwise(0.0))
    df = df.withColumn("box_stability", F.avg("_in").over(over(n)))
    near = lambda c: F.sum(F.when(c, 1).otherwise(0)).over(over(n))
    return df.withColumn("box_touch_high", near(F.col("box_pos") >= 1 - edge)).withColumn("box_touch_low", near(F.col("box_pos") <= edge)).drop("_hi", "_lo", "_in")


def breakout(df: DataFrame, n: int = 20) -> DataFrame:
    """1 where the close passes the highest high of the n bars before, -1 below the lowest low, else 0."""
    up, down = F.col("close") > F.max("high").over(over(n, -1)), F.col("close") < F.min("low").over(over(n, -1))
    return df.withColumn("breakout", F.when(up, 1).when(down, -1).otherwise(0))


def pullback_depth(df: DataFrame, n: int = 240) -> DataFrame:
    hi, lo = F.max("high").over(over(n)), F.min("low").over(over(n))
    return df.withColumn("pullback_long", (hi - F.col("close")) / hi).withColumn("pullback_short", (F.col("close") - lo) / F.nullif(hi - lo, F.lit(0.0)))


def bars_since_extreme(df: DataFrame, n: int = 50) -> DataFrame:
    """Bars since the latest highest high and lowest low of n bars, as a share of n."""
    df = df.withColumn("_i", F.row_number().over(order()))
    top, low = F.max_by("_i", F.struct("high", "_i")).over(over(n)), F.min_by("_i", F.struct("low", -F.col("_i"))).over(over(n))
    return df.withColumn("since_high", (F.col("_i") - top) / n).withColumn("since_low", (F.col("_i") - low) / n).drop("_i")


def path(df: DataFrame, n: int = 20) -> DataFrame:
    """Efficiency, length, largest jump and consistency of the closes' way over n moves."""
    df = df.withColumn("_d", F.col("close") - lag("close"))
    net, way = F.sum("_d").over(over(n)), F.nullif(F.sum(F.abs("_d")).over(over(n)), F.lit(0.0))
    same = F.abs(F.avg(F.signum("_d")).over(over(n)))
    return df.withColumn("path_efficiency", F.abs(net) / way).withColumn("path_length", way).withColumn("jump_risk", F.max(F.abs("_d")).over(over(n)) / way).withColumn("dir_consistency", same).drop("_d")


def vwap_position(df: DataFrame, n: int = 48) -> DataFrame:
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    v = F.sum(typical * F.col("volume")).over(over(n)) / F.nullif(F.sum("volume").over(over(n)), F.lit(0.0))
    return df.withColumn("vwap", v).withColumn("vwap_position", (F.col("close") - F.col("vwap")) / F.col("close"))


def crossed(now: Column, name: str = "cross") -> Column:
    """True where `now` holds and did not on the bar before."""
    return now & ~F.coalesce(F.lag(now).over(order()), F.lit(False))


def volatility(df: DataFrame, short: int = 10, long: int = 50) -> DataFrame:
    """Short over long realised volatility, persistence of absolute returns, leverage asymmetry."""
    df = df.withColumn("_r", F.log(F.col("close") / lag("close"))).withColumn("_a", F.abs("_r")).withColumn("_b", lag("_a")).withColumn("_p", lag("_r"))
    df = df.withColumn("volatility_regime", F.stddev_pop("_r").over(over(short)) / F.nullif(F.stddev_pop("_r").over(over(long)), F.lit(0.0)))
    whole = F.col("_b").isNotNull()
    df = df.withColumn("_x", F.when(whole, F.col("_a")))
    together = lambda a, b: F.covar_pop(a, b).over(over(long)) / F.nullif(F.stddev_pop(a).over(over(long)) * F.stddev_pop(b).over(over(long)), F.lit(0.0))
    return df.withColumn("vol_persistence", together("_x", "_b")).withColumn("vol_leverage_asymmetry", together("_p", "_x")).drop("_r", "_a", "_b", "_p", "_x")


def tail_risk(df: DataFrame, n: int = 100, k: int = 10) -> DataFrame:
    """99 % value at risk and expected shortfall of n returns, and Hill's shape of the k largest losses."""
    df = df.withColumn("_loss", -(F.log(F.col("close") / lag("close")))).withColumn("evt_var_99", F.percentile("_loss", F.lit(0.99)).over(over(n))).withColumn("_l", F.collect_list("_loss").over(over(n)))
    worst = F.filter("_l", lambda x: x >= F.col("evt_var_99"))
    df = df.withColumn("evt_es_99", F.aggregate(worst, F.lit(0.0), lambda t, x: t + x) / F.nullif(F.size(worst), F.lit(0)))
    top = F.slice(F.reverse(F.array_sort(F.filter("_l", lambda x: x > 0))), 1, k + 1)
    df = df.withColumn("_t", top).withColumn("_edge", F.when(F.size("_t") == k + 1, F.element_at("_t", k + 1)))
    hill = F.aggregate(F.slice("_t", 1, k), F.lit(0.0), lambda t, x: t + F.log(x / F.col("_edge"))) / k
    return df.withColumn("evt_tail_shape", F.when(F.col("_edge").isNotNull(), hill)).drop("_loss", "_l", "_t", "_edge")


def hurst(df: DataFrame, c: str = "close", taus: tuple[int, ...] = (1, 2, 4, 8), n: int = 64, out: str = "hurst") -> DataFrame:
    """Slope of log standard deviation of differences against log lag."""
    x = [math.log(t) for t in taus]
    mean = sum(x) / len(x)
    total = sum((v - mean) ** 2 for v in x)
    names = []
    for t in taus:
        df = df.withColumn(f"_d{t}", F.col(c) - lag(c, t)).withColumn(f"_s{t}", F.log(F.nullif(F.stddev_pop(f"_d{t}").over(over(n)), F.lit(0.0))))
        names += [f"_d{t}", f"_s{t}"]
    slope = reduce(lambda a, b: a + b, (F.col(f"_s{t}") * ((v - mean) / total) for t, v in zip(taus, x)))
    return df.withColumn(out, F.when(F.count(c).over(over(n)) == n, slope)).drop(*names)


def hysteresis(df: DataFrame, c: str, on: float, off: float, out: str = "state") -> DataFrame:
    """1 from where c reaches `on` until it falls below `off`, with the number and length of each such run."""
    event = F.when(F.col(c) >= on, 1).when(F.col(c) < off, 0)
    df = df.withColumn("_e", event).withColumn(out, F.coalesce(F.last("_e", ignorenulls=True).over(order().rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    df = df.withColumn("_c", F.when(F.col(out) != F.coalesce(lag(out), F.lit(-1)), 1).otherwise(0)).withColumn("segment", F.sum("_c").over(order().rowsBetween(Window.unboundedPreceding, 0)))
    return df.withColumn("segment_length", F.count("*").over(Window.partitionBy("symbol", "segment"))).drop("_e", "_c")


def drift_series(df: DataFrame, flag: Column, n: int = 60, least: int = 30, out: str = "activation_rate") -> DataFrame:
    """Mean of a flag over n bars, null until `least` bars are there."""
    df = df.withColumn("_f", flag.cast("double"))
    return df.withColumn(out, F.when(F.count("_f").over(over(n)) >= least, F.avg("_f").over(over(n)))).drop("_f")


def drawdown(df: DataFrame, c: str = "close", out: str = "drawdown") -> DataFrame:
    """Share lost since the highest value so far."""
    peak = F.max(c).over(order().rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(out, (F.col(c) - peak) / peak)


def composite_score(inputs: list[tuple[str, float, float, float]]) -> Column:
    """Weighted mean of inputs (column, low, high, weight), each scaled to 0..1 and clipped."""
    total = sum(w for *_, w in inputs)
    return reduce(lambda a, b: a + b, (F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(c) - lo) / (hi - lo))) * (w / total) for c, lo, hi, w in inputs))


def cross_sectional_rank(df: DataFrame, c: str, out: str = "cs_rank") -> DataFrame:
    """Percent rank of a value among all symbols at the same time."""
    return df.withColumn(out, F.percent_rank().over(Window.partitionBy("ts").orderBy(c)))


def swing_levels(df: DataFrame, k: int = 3) -> DataFrame:
    """Last confirmed swing high and low (extremes of k bars on both sides, known k bars later), distance in ATR, strength as touches within half an ATR over 50 bars."""
    df = atr(df, 14, "_atr").withColumn("_mh", F.max("high").over(order().rowsBetween(-k, k))).withColumn("_ml", F.min("low").over(order().rowsBetween(-k, k)))
    df = df.withColumn("_sh", F.when(F.col("high") == F.col("_mh"), F.col("high"))).withColumn("_sl", F.when(F.col("low") == F.col("_ml"), F.col("low")))
    so_far = order().rowsBetween(Window.unboundedPreceding, -k)
    df = df.withColumn("swing_high", F.last("_sh", ignorenulls=True).over(so_far)).withColumn("swing_low", F.last("_sl", ignorenulls=True).over(so_far))
    df = df.withColumn("dist_to_swing_high_atr", (F.col("swing_high") - F.col("close")) / F.nullif("_atr", F.lit(0.0)))
    touches = F.aggregate(F.collect_list("high").over(over(50)), F.lit(0), lambda t, x: t + F.when(F.abs(x - F.col("swing_high")) <= 0.5 * F.col("_atr"), 1).otherwise(0))
    return df.withColumn("sr_strength", F.when(F.col("swing_high").isNotNull(), touches)).drop("_atr", "_mh", "_ml", "_sh", "_sl")


def compression_duration(df: DataFrame, n: int = 60, below: float = 0.2) -> DataFrame:
    """Bars in a row in which the rolling rank of the band width stays below a limit."""
    df = rolling_rank(bollinger(df), "bb_width", n, "_rank").withColumn("_c", F.when(F.col("_rank") < below, 1).otherwise(0))
    df = df.withColumn("_g", F.sum(1 - F.col("_c")).over(order().rowsBetween(Window.unboundedPreceding, 0)))
    return df.withColumn("compression_duration", F.sum("_c").over(Window.partitionBy("symbol", "_g").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))).drop("_rank", "_c", "_g", "bb_mid", "bb_lower", "bb_upper", "bb_width")


def spectrum(df: DataFrame, n: int = 64) -> DataFrame:
    """Power of n returns at the frequencies 1..n/2: flatness, high over low share, entropy, each within 0..1.

    Each frequency has a running complex sum along the symbol, one update a bar; a window's part is the sum now less
    that n bars ago (its phase does not matter for power).
    """
    half = n // 2
    df = df.withColumn("_r", F.coalesce(F.log(F.col("close") / lag("close")), F.lit(0.0))).withColumn("_j", F.row_number().over(order()))
    so_far = order().rowsBetween(Window.unboundedPreceding, 0)
    waves = [(f, i) for i in range(1, half + 1) for f in (F.cos, F.sin)]
    turn = lambda f, i: F.sum(F.col("_r") * f(F.lit(2 * math.pi / n) * (F.col("_j") * i % n))).over(so_far)
    names = [f"_s{k}" for k in range(len(waves))]
    df = df.withColumns({name: turn(f, i) for name, (f, i) in zip(names, waves)})
    df = df.withColumns({f"_d{name}": F.col(name) - F.coalesce(F.lag(name, n).over(order()), F.lit(0.0)) for name in names})
    parts = [F.pow(F.col(f"_d{names[2 * k]}"), 2) + F.pow(F.col(f"_d{names[2 * k + 1]}"), 2) + F.lit(1e-18) for k in range(half)]
    df = df.withColumn("_p", F.when(F.col("_j") >= n, F.array(*parts))).drop(*names, *(f"_d{name}" for name in names))
    total = F.aggregate("_p", F.lit(0.0), lambda a, v: a + v)
    logs = F.aggregate("_p", F.lit(0.0), lambda a, v: a + F.log(v))
    high = F.aggregate(F.slice("_p", half // 2 + 1, half), F.lit(0.0), lambda a, v: a + v)
    df = df.withColumn("_t", total).withColumn("spectrum_flatness", F.exp(logs / half) / (F.col("_t") / half)).withColumn("spectrum_high_share", high / F.col("_t"))
    entropy = -F.aggregate("_p", F.lit(0.0), lambda a, v: a + v / F.col("_t") * F.log(v / F.col("_t"))) / math.log(half)
    return df.withColumn("spectrum_entropy", entropy).drop("_r", "_j", "_p", "_t")


def haar_energy(df: DataFrame, n: int = 100, level: int = 4, every: int = 5) -> DataFrame:
    """Energy shares of low, middle and high bands of a Haar packet of the last n closes' moves, on every fifth bar, then held."""
    use = n // (1 << level) * (1 << level)
    df = df.withColumn("_i", F.row_number().over(order())).withColumn("_d", F.coalesce(F.col("close") - lag("close"), F.lit(0.0))).withColumn("_x", F.collect_list("_d").over(over(use)))
    bands = [F.when((F.size("_x") == use) & (F.col("_i") % every == 0), F.col("_x"))]
    root = 1 / math.sqrt(2)
    pairs = lambda x, sign: F.transform(F.sequence(F.lit(1), (F.size(x) / 2).cast("int")), lambda k: (F.element_at(x, (2 * k - 1).cast("int")) + sign * F.element_at(x, (2 * k).cast("int"))) * root)
    names = []
    for depth in range(level):
        split = []
        for k, x in enumerate(bands):
            df = df.withColumn(f"_w{depth}_{k}", x)
            names.append(f"_w{depth}_{k}")
            split += [pairs(F.col(f"_w{depth}_{k}"), 1), pairs(F.col(f"_w{depth}_{k}"), -1)]
        bands = split
    energy = [F.aggregate(F.when(F.col("_w0_0").isNotNull(), x), F.lit(0.0), lambda a, v: a + v * v) for x in bands]
    df = df.withColumn("_e", F.array(*energy))
    part = lambda a, z: F.aggregate(F.slice("_e", a + 1, z - a), F.lit(0.0), lambda t, v: t + v)
    count = 1 << level
    total = F.nullif(part(0, count), F.lit(0.0))
    last = order().rowsBetween(Window.unboundedPreceding, 0)
    for name, a, z in (("low", 0, count // 4), ("mid", count // 4, count // 2), ("high", count // 2, count)):
        df = df.withColumn(f"wpt_{name}", F.last(part(a, z) / total, ignorenulls=True).over(last))
    return df.drop("_i", "_d", "_x", "_e", *names)
