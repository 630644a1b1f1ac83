"""Labels and outcomes (L rows of the inventory) over two-hour bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import labels as L
from tidemark.operators import rules as R
from tidemark.operators import spacing
from tidemark.operators import windows as W
from tidemark.plans.catalog import query
from tidemark.plans.q_features import rounded
from tidemark.plans.q_rules import ROWS, rows

_r = lambda s, n: f"round(CAST({s} AS DOUBLE), 6) AS {n}"


def _ahead(h: int) -> str:
    return f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"


_RR = lambda h, side=1: f"{side} * (lead(close, {h}) OVER w - close) / greatest(atr, 1e-9)"


def _path(h: int, side: int = 1) -> str:
    a = _ahead(h)
    top, low = (f"max(high) OVER {a}", f"min(low) OVER {a}") if side > 0 else (f"min(low) OVER {a}", f"max(high) OVER {a}")
    first = f"arg_max(i, (high, -i)) OVER {a}" if side > 0 else f"arg_min(i, (low, i)) OVER {a}"
    whole = f"count(*) OVER {a} = {h}"
    return f"""i_ AS (SELECT *, row_number() OVER w AS i FROM f WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
  p AS (SELECT *, CASE WHEN {whole} THEN greatest({side} * ({top} - close) / greatest(atr, 1e-9), 0) END AS mfe, CASE WHEN {whole} THEN greatest({side} * (close - {low}) / greatest(atr, 1e-9), 0) END AS mae,
    CASE WHEN {whole} THEN {first} - i END AS t_mfe, {_RR(h, side)} AS forward_rr FROM i_ WINDOW w AS (PARTITION BY symbol ORDER BY ts))"""


def label(name: str, build, columns: dict[str, str], more: list[str] | None = None, source: str = "f", sql: bool = True) -> None:
    text = f"WITH RECURSIVE {', '.join([ROWS, *(more or [])])} SELECT symbol, ts, {', '.join(_r(s, c) for c, s in columns.items())} FROM {source} WINDOW w AS (PARTITION BY symbol ORDER BY ts)" if sql else None
    query(name, text)(lambda spark, sf_dir: rounded(build(rows(spark, sf_dir)), *columns))


_PATH_COLUMNS = {c: c for c in ("mfe", "mae", "t_mfe", "forward_rr")}
label("L01_signed_forward_rr", lambda b: b.withColumn("rr", L.signed_rr(20)), {"rr": _RR(20)})
label("L02_shift_target", lambda b: b.withColumn("target", L.shift_target("roc", 5)), {"target": "lead(roc, 5) OVER w"})
label("L03_path_mfe_mae", lambda b: L.path_primitives(b, 20), _PATH_COLUMNS, [_path(20)], "p")
label("L04_outcome_audit", lambda b: L.path_primitives(b, 50, -1), _PATH_COLUMNS, [_path(50, -1)], "p")
_FAIL = "CASE WHEN mfe IS NOT NULL THEN CASE WHEN coalesce(forward_rr < -0.8, false) OR coalesce(mae > 1.2 AND mfe < 0.3, false) THEN 1 ELSE 0 END END"
label("L05_failure", lambda b: L.path_primitives(b, 20).withColumn("failure", L.failure()).withColumn("success", 1 - F.col("failure")), {"failure": _FAIL, "success": f"1 - ({_FAIL})"}, [_path(20)], "p")
label("L06_rr_extreme", lambda b: L.path_primitives(b, 20).withColumn("success", L.success_without_extreme()), {"success": "CASE WHEN forward_rr IS NOT NULL THEN CASE WHEN forward_rr < -0.8 THEN 0 ELSE 1 END END"}, [_path(20)], "p")
label("L07_is_good", lambda b: L.is_good(b.withColumn("rr", L.signed_rr(20))), {"is_good": f"coalesce(CASE WHEN {_RR(20)} >= -0.8 THEN 1 WHEN {_RR(20)} IS NOT NULL THEN 0 END, 0)"})


def _touch(tp: float, sl: float, h: int, side: int, out: str, source: str) -> str:
    up, down = ("high >= close + {} * atr", "low <= close - {} * atr") if side > 0 else ("low <= close - {} * atr", "high >= close + {} * atr")
    up, down = up.format(tp).replace("high", "x.high").replace("low ", "x.low "), down.format(sl).replace("high", "x.high").replace("low ", "x.low ")
    return f"""{out}_l AS (SELECT *, list({{'high': high, 'low': low}}) OVER {_ahead(h)} AS l, lead(close, {h}) OVER (PARTITION BY symbol ORDER BY ts) AS c{h} FROM {source}),
  {out}_t AS (SELECT *, coalesce(list_position(list_transform(l, lambda x: {up}), true), 0) AS tu, coalesce(list_position(list_transform(l, lambda x: {down}), true), 0) AS td, coalesce(len(l), 0) AS k FROM {out}_l),
  {out}_o AS (SELECT *, CASE WHEN td > 0 AND (tu = 0 OR td <= tu) THEN 'sl' WHEN tu > 0 THEN 'tp' WHEN k = {h} THEN 'time' END AS o FROM {out}_t),
  {out} AS (SELECT * EXCLUDE (l, k), CASE o WHEN 'sl' THEN td WHEN 'tp' THEN tu WHEN 'time' THEN {h} END AS held, CASE o WHEN 'sl' THEN -{sl} WHEN 'tp' THEN {tp} WHEN 'time' THEN {side} * (c{h} - close) / greatest(atr, 1e-9) END AS rr FROM {out}_o)"""


_OUT = lambda c: f"CASE {c} WHEN 'sl' THEN 1 WHEN 'tp' THEN 2 WHEN 'time' THEN 3 END"
_code = lambda c: F.when(F.col(c) == "sl", 1).when(F.col(c) == "tp", 2).when(F.col(c) == "time", 3)
label("L08_first_touch", lambda b: L.first_touch(b, 2.0, 1.0, 20).withColumn("code", _code("outcome")), {"code": _OUT("o"), "bars_held": "held", "realized_r": "rr"}, [_touch(2.0, 1.0, 20, 1, "x", "f")], "x")
_NEAR = "coalesce((close - lo) / close * close / nullif(atr, 0) <= 1.5, false)"
label("L09_rr_weights", lambda b: (lambda p: p.withColumn("weight", L.rr_weights(R.near_sr((F.col("close") - F.min("low").over(W.over(20))) / F.col("close"), F.col("close"), F.col("atr"), 1.5))))(L.path_primitives(b, 20)), {"weight": f"CASE WHEN {_NEAR} THEN CASE WHEN forward_rr < 0 THEN 0.05 WHEN mfe / greatest(mae, 1e-9) >= 2 THEN 1.5 ELSE 1.0 END END"}, [_path(20)], "p")
_SIGN = " + ".join(f"sign({'lead(close, %d) OVER w' % (i + 1)} - {'close' if i == 0 else 'lead(close, %d) OVER w' % i})" for i in range(3))
label("L10_compression_label", lambda b: b.withColumn("label", L.compression_label("box_pos", 3, 0.2)), {"label": f"CASE WHEN coalesce(lag(box_pos) OVER w < 0.2, false) AND abs({_SIGN}) = 3 THEN sign({_SIGN}) ELSE 0 END"})
_TREND = [f"t AS (SELECT *, lead(close, 50) OVER w / close - 1 AS fw FROM f WINDOW w AS (PARTITION BY symbol ORDER BY ts))", "l AS (SELECT *, list_filter(list(fw) OVER (PARTITION BY symbol ORDER BY ts ROWS 199 PRECEDING), lambda x: x IS NOT NULL) AS l FROM t)"]  # noqa: F541
label("L11_trend_rank_label", L.trend_rank, {"trend_rank": "CASE WHEN fw IS NOT NULL AND len(l) >= 50 THEN len(list_filter(l, lambda x: x <= fw)) / len(l) END"}, _TREND, "l")
_SIGNAL = "coalesce(atr / nullif(lag(atr) OVER w, 0) - 1 > 0.1, false)"
label("L12_breakout_label", L.breakout_label, {"signal": f"CASE WHEN {_SIGNAL} THEN 1 ELSE 0 END", "breakout_rr": f"CASE WHEN {_SIGNAL} AND lead(close, 10) OVER w IS NOT NULL THEN least(3, CASE WHEN close >= open THEN 1 ELSE -1 END * {_RR(10)}) WHEN {_SIGNAL} THEN 3 END"})
label("L13_dual_win", lambda b: b.withColumn("long_win", L.dual_win(3, 0.5)[0]).withColumn("short_win", L.dual_win(3, 0.5)[1]), {"long_win": f"CASE WHEN {_RR(3)} > 0.5 THEN 1 WHEN {_RR(3)} IS NOT NULL THEN 0 END", "short_win": f"CASE WHEN {_RR(3)} < -0.5 THEN 1 WHEN {_RR(3)} IS NOT NULL THEN 0 END"})


def _both(b):
    long = L.first_touch(b, 1.0, 1.5, 6, 1).withColumnRenamed("realized_r", "r_long").drop("outcome", "bars_held")
    return L.first_touch(long, 1.0, 1.5, 6, -1).withColumn("r_diff", F.col("r_long") - F.col("realized_r"))


label("L14_realized_r_diff", _both, {"r_diff": "xl - y.rr"}, [_touch(1.0, 1.5, 6, 1, "x", "f"), "xx AS (SELECT * EXCLUDE (rr, tu, td, o, held, c6), rr AS xl FROM x)", _touch(1.0, 1.5, 6, -1, "y", "xx")], "y")
label("L15_holding_exit", lambda b: b.withColumn("holding_exit", L.holding_exit()), {"holding_exit": "CAST(NULL AS DOUBLE)"})
_GOAL, _UNIT = "a.entry + 2 * a.unit", "greatest(atr, 1e-9)"
_STEP = f"""CASE WHEN a.reason <> 0 THEN a ELSE {{'entry': a.entry, 'unit': a.unit,
    'stop': greatest(a.stop, CASE WHEN greatest(a.best, x.high) - a.entry >= a.unit THEN greatest(a.entry, greatest(a.best, x.high) - a.unit) ELSE a.stop END),
    'best': greatest(a.best, x.high), 'bars': a.bars + 1,
    'reason': CASE WHEN x.low <= a.stop THEN CASE WHEN a.stop >= a.entry THEN 2 ELSE 1 END WHEN x.high >= {_GOAL} THEN 3 ELSE 0 END,
    'price': CASE WHEN x.low <= a.stop THEN a.stop WHEN x.high >= {_GOAL} THEN {_GOAL} ELSE x.close END}} END"""
_EXITS = [
    f"l AS (SELECT *, list({{'open': open, 'high': high, 'low': low, 'close': close}}) OVER {_ahead(20)} AS l FROM f)",
    f"ex AS (SELECT *, CASE WHEN len(l) > 0 THEN list_reduce(l, lambda a, x: {_STEP}, {{'entry': l[1].open, 'unit': {_UNIT}, 'stop': l[1].open - {_UNIT}, 'best': l[1].open, 'bars': 0, 'reason': 0, 'price': l[1].open}}) END AS z FROM l)",
    "ot AS (SELECT *, CASE WHEN z.reason > 0 THEN z.reason WHEN len(l) = 20 THEN 4 END AS code FROM ex)",
]
label("L16_rr_outcome", lambda b: L.rr_outcome(b).withColumn("code", F.when(F.col("exit_reason") == "stop", 1).when(F.col("exit_reason") == "trail", 2).when(F.col("exit_reason") == "target", 3).when(F.col("exit_reason") == "time", 4)), {"code": "code", "bars_held": "CASE WHEN code IS NOT NULL THEN z.bars END", "pnl_r": "CASE WHEN code IS NOT NULL THEN (z.price * (1 - 0.001) - z.entry * (1 + 0.001)) / z.unit END"}, _EXITS, "ot")


_SPACED = "k AS (SELECT symbol, minutes, min(ts) AS ts FROM s GROUP BY 1, 2 UNION ALL SELECT symbol, minutes, ts FROM (SELECT s.symbol, s.minutes, s.ts, row_number() OVER (PARTITION BY s.symbol, s.minutes ORDER BY s.ts) AS n FROM k JOIN s ON s.symbol = k.symbol AND s.minutes = k.minutes AND s.ts > k.ts AND s.ts >= k.ts + to_minutes(k.minutes)) WHERE n = 1)"
_GRID = [0, 240, 480, 1200]


def _signals(grid: list[int]) -> str:
    return f"WITH RECURSIVE {ROWS}, g AS (SELECT CAST(unnest({grid}) AS BIGINT) AS minutes), s AS (SELECT symbol, ts, minutes FROM f CROSS JOIN g WHERE position >= 0.1), {_SPACED}"


@query("L17_min_interval", f"{_signals([480])} SELECT symbol, ts FROM k")
def min_interval(spark, sf_dir):
    return spacing.min_interval(rows(spark, sf_dir).where("position >= 0.1").select("symbol", "ts"), 480)


@query("L17_interval_sweep", f"{_signals(_GRID)}, v AS (SELECT *, lead(close) OVER (PARTITION BY symbol ORDER BY ts) / close - 1 AS ahead FROM f), p AS (SELECT k.minutes, count(*) AS kept, avg(ahead) AS m FROM k JOIN v ON v.symbol = k.symbol AND v.ts = k.ts GROUP BY 1) SELECT CAST(minutes AS INTEGER) AS minutes, kept, {_r('m', 'mean_value')}, minutes = (SELECT arg_min(minutes, (-m, minutes)) FROM p) AS selected FROM p")
def interval_sweep(spark, sf_dir):
    b = rows(spark, sf_dir).withColumn("ahead", F.lead("close").over(W.order()) / F.col("close") - 1)
    return rounded(spacing.interval_sweep(b.where("position >= 0.1"), _GRID, "ahead"), "mean_value", keys=("minutes", "kept", "selected"))


label("L18_atr_size", lambda b: b.withColumn("size", L.atr_size(F.lit(10000.0), 0.01, F.col("atr"), 1.5, 5.0)), {"size": "least(5.0, 100.0 / nullif(atr * 1.5, 0))"})
label("L19_stop_guardrail", lambda b: b.withColumn("stop_pct", L.stop_pct(F.col("atr") / F.col("close"))), {"stop_pct": "greatest(0.01, least(0.2, atr / close))"})


@query("L20_splits", f"WITH RECURSIVE {ROWS}, n AS (SELECT *, ntile(6) OVER w - 1 AS fold FROM f WINDOW w AS (PARTITION BY symbol ORDER BY ts)) SELECT symbol, ts, CASE WHEN ts < TIMESTAMP '2024-01-20' THEN 'train' WHEN ts < TIMESTAMP '2024-01-26' THEN 'validation' ELSE 'holdout' END AS split, CAST(fold AS INTEGER) AS fold, row_number() OVER (PARTITION BY symbol, fold ORDER BY ts DESC) <= 24 AND fold < 5 AS embargo FROM n")
def splits(spark, sf_dir):
    return L.folds(L.splits(rows(spark, sf_dir), "2024-01-20", "2024-01-26")).select("symbol", "ts", "split", "fold", "embargo")


label("L21_invert_features", lambda b: L.invert_features(b, ["position", "roc"]), {"position": "-position", "roc": "-roc"})
_LADDER = [
    f"l AS (SELECT *, {_UNIT} AS u, list({{'high': high, 'low': low}}) OVER {_ahead(20)} AS l FROM f)",
    "td AS (SELECT *, coalesce(list_position(list_transform(l, lambda x: x.low <= close - u), true), 0) AS stopped FROM l)",
    "rr AS (SELECT *, (greatest(close, coalesce(list_max(list_transform(CASE WHEN stopped > 0 THEN l[1:stopped - 1] ELSE l END, lambda x: x.high)), close)) - close) / u AS r FROM td)",
]
label("L22_ladder_adds", lambda b: L.ladder_adds(b, 20, [2.0, 4.0], [0.5, 0.25]), {"adds": "CASE WHEN r >= 4 THEN 2 WHEN r >= 2 THEN 1 ELSE 0 END", "add_weight": "CASE WHEN r >= 4 THEN 0.75 WHEN r >= 2 THEN 0.5 ELSE 0 END"}, _LADDER, "rr")


@query("L23_non_overlap", f"{_signals([1200])}, v AS (SELECT *, lead(close, 10) OVER (PARTITION BY symbol ORDER BY ts) / close - 1 AS ahead FROM f) SELECT k.symbol, k.ts, {_r('ahead', 'gross')}, {_r('ahead - 0.0008', 'net')} FROM k JOIN v ON v.symbol = k.symbol AND v.ts = k.ts")
def non_overlap(spark, sf_dir):
    return rounded(spacing.non_overlap(rows(spark, sf_dir), F.col("position") >= 0.1, 10, 120, 8.0), "gross", "net")


label("L24_structural_exit", lambda b: L.structural_exit(b, F.col("position"), 1, 20), {"bars_to_exit": f"min(CASE WHEN position < 0 THEN i END) OVER {_ahead(20)} - i"}, ["x AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM f)"], "x")
