"""Bars, ledger metrics and monitoring."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.operators import ledgers as L
from tidemark.operators import windows as W
from tidemark.operators.joins import join_same
from tidemark.operators.prefix import group_quantiles
from tidemark.plans.catalog import query
from tidemark.plans.q_features import ema_cte, rounded
from tidemark.plans.q_rules import ROWS, rows
from tidemark.plans.views import BARS, LEDGER, TICKS, bars, bars_sql, ledger, ticks
from tidemark.session import cut, table

_r = lambda s, n: f"round(CAST({s} AS DOUBLE), 6) AS {n}"
ORDER = ["exit_time", "trade_id", "leg", "part", "notional"]
_O = ", ".join(ORDER)
_COLS = ("open", "high", "low", "close", "volume", "flow", "n")
_SUM = "sum(pnl_r) OVER (PARTITION BY {by} ORDER BY " + _O + " ROWS UNBOUNDED PRECEDING)"


def _dd(by: str, source: str = "ledger") -> str:
    run = f"(PARTITION BY {by} ORDER BY {_O} ROWS UNBOUNDED PRECEDING)"
    return f"q_ AS (SELECT *, sum(pnl_r) OVER {run} AS eq FROM {source}), d AS (SELECT *, eq - greatest(max(eq) OVER {run}, 0) AS dd FROM q_)"


@query("A01_tick_bars", f"WITH {BARS} SELECT symbol, ts, {', '.join(_r(c, c) for c in _COLS)} FROM bars")
def tick_bars(spark, sf_dir):
    return rounded(bars(spark, sf_dir), *_COLS)


@query("A02_resample", f"WITH {TICKS}, {bars_sql(8)} SELECT symbol, ts, {', '.join(_r(c, c) for c in _COLS)} FROM bars")
def resample(spark, sf_dir):
    return rounded(B.resample(bars(spark, sf_dir), "8 hours"), *_COLS)


@query("A20_asset_stats", f"WITH {LEDGER}, {_dd('symbol')}, b AS (SELECT symbol, avg(pnl_r) AS mu, min(dd) AS max_dd, 1 / (1 + stddev_samp(pnl_r) / nullif(abs(avg(pnl_r)), 0)) AS st FROM d GROUP BY 1), m AS (SELECT symbol, exit_reason, avg(pnl_r) AS m FROM ledger GROUP BY 1, 2), g AS (SELECT symbol, stddev_samp(m) AS fr FROM m GROUP BY 1) SELECT symbol, {_r('mu', 'mu')}, {_r('max_dd', 'max_dd')}, {_r('st', 'stability')}, {_r('fr', 'fragility')} FROM b JOIN g USING (symbol)")
def asset_stats(spark, sf_dir):
    return rounded(L.asset_stats(ledger(spark, sf_dir), ["symbol"], ORDER), "mu", "max_dd", "stability", "fragility", keys=("symbol",))


@query("A21_segment_drawdown", f"WITH {LEDGER}, {_dd('symbol, side')} SELECT symbol, side, {_r('min(dd)', 'max_dd')} FROM d GROUP BY 1, 2")
def segment_drawdown(spark, sf_dir):
    return L.ledger_metrics(ledger(spark, sf_dir), ["symbol", "side"], ORDER).select("symbol", "side", F.round("max_dd", 6).alias("max_dd"))


@query("A22_segment_quantiles", f"WITH {LEDGER} SELECT symbol, {_r('avg(pnl_r)', 'mean')}, {_r('quantile_cont(pnl_r, 0.1)', 'q10')}, {_r('quantile_cont(pnl_r, 0.5)', 'q50')}, {_r('quantile_cont(pnl_r, 0.9)', 'q90')} FROM ledger GROUP BY 1")
def segment_quantiles(spark, sf_dir):
    led = cut(ledger(spark, sf_dir).select("symbol", "pnl_r"))
    g = join_same(led.groupBy("symbol").agg(F.avg("pnl_r").alias("mean")), group_quantiles(led, ["symbol"], "pnl_r", [0.1, 0.5, 0.9]), ["symbol"])
    return rounded(g.select("symbol", "mean", *(F.col("q")[i].alias(n) for i, n in enumerate(("q10", "q50", "q90")))), "mean", "q10", "q50", "q90", keys=("symbol",))


@query("A23_timeline_return", f"""WITH {LEDGER}, dly AS (SELECT exit_time, sum(pnl_r / 5 * 100) AS x FROM ledger GROUP BY 1), e AS (SELECT exit_time, sum(x) OVER (ORDER BY exit_time) AS eq FROM dly), p AS (SELECT *, eq - greatest(max(eq) OVER (ORDER BY exit_time), 0) AS dd FROM e)
  SELECT {_r('arg_max(eq, exit_time)', 'final_pct')}, {_r('min(dd)', 'max_dd')}, (SELECT round(avg(s), 6) FROM (SELECT sum(pnl_r) AS s FROM ledger GROUP BY symbol)) AS equal_weight, (SELECT round(sum(pnl_r), 6) FROM ledger) AS pooled FROM p""")
def timeline(spark, sf_dir):
    """Daily sums come before the one global window, so it sees a row a day."""
    led = ledger(spark, sf_dir)
    daily = led.groupBy("exit_time").agg(F.sum(F.col("pnl_r") / 5 * 100).alias("x")).withColumn("_k", F.lit(1))
    e = L.equity(daily, "x", ["_k"], ["exit_time"]).agg(F.max_by("equity", "exit_time").alias("final_pct"), F.min("drawdown").alias("max_dd"))
    finals = led.groupBy("symbol").agg(F.sum("pnl_r").alias("s")).agg(F.avg("s").alias("equal_weight"), F.sum("s").alias("pooled"))
    return rounded(e.join(F.broadcast(finals)), "final_pct", "max_dd", "equal_weight", "pooled", keys=())


@query("A24_tail_contribution", f"""WITH {LEDGER}, w AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY pnl_r DESC, trade_id, leg, part, notional) AS k, count(*) OVER (PARTITION BY symbol) AS c FROM ledger WHERE pnl_r > 0)
  SELECT symbol, {_r('sum(pnl_r) FILTER (k <= greatest(1, ceil(c * 0.1))) / sum(pnl_r)', 'tail_share')}, count(*) FILTER (k <= greatest(1, ceil(c * 0.1))) AS n_top, count(*) AS n_winners FROM w GROUP BY 1""")
def tail_contribution(spark, sf_dir):
    return L.tail_contribution(ledger(spark, sf_dir), ["symbol"]).withColumn("tail_share", F.round("tail_share", 6))


_METRICS = f"count(*) AS trades, {_r('avg(CASE WHEN pnl_r > 0 THEN 1.0 ELSE 0.0 END)', 'win_rate')}, {_r('sum(pnl_r)', 'total_r')}, {_r('avg(pnl_r)', 'mean_r')}, {_r('avg(pnl_r) / nullif(stddev_samp(pnl_r), 0)', 'sharpe')}, {_r('min(dd)', 'max_dd')}"
_MET = ("win_rate", "total_r", "mean_r", "sharpe", "max_dd")


@query("A25_ledger_metrics", f"WITH {LEDGER}, {_dd('symbol, side')} SELECT symbol, side, {_METRICS} FROM d GROUP BY 1, 2")
def ledger_metrics(spark, sf_dir):
    return rounded(L.ledger_metrics(ledger(spark, sf_dir), ["symbol", "side"], ORDER), *_MET, keys=("symbol", "side", "trades"))


@query("A26_exit_counts", f"WITH {LEDGER} SELECT symbol, count(*) FILTER (exit_reason = 'A') AS exit_a, count(*) FILTER (exit_reason = 'N') AS exit_n, count(*) FILTER (exit_reason = 'R') AS exit_r FROM ledger GROUP BY 1")
def exit_counts(spark, sf_dir):
    got = ledger(spark, sf_dir).groupBy("symbol").pivot("exit_reason", ["A", "N", "R"]).count()
    return got.select("symbol", *(F.coalesce(c, F.lit(0)).alias(f"exit_{c.lower()}") for c in "ANR"))


@query("A27_stability", f"WITH {LEDGER} SELECT date_trunc('month', exit_time)::DATE AS month, side, count(*) AS trades, {_r('avg(pnl_r)', 'mean_r')} FROM ledger GROUP BY GROUPING SETS ((month), (side))")
def stability(spark, sf_dir):
    led = ledger(spark, sf_dir).withColumn("month", F.trunc("exit_time", "month"))
    got = led.groupingSets([["month"], ["side"]], "month", "side").agg(F.count("*").alias("trades"), F.round(F.avg("pnl_r"), 6).alias("mean_r"))
    return got.select("month", "side", "trades", "mean_r")


@query("A28_funnel", f"WITH RECURSIVE {ROWS} SELECT symbol, count(*) AS bars, count(*) FILTER (position >= 0.1) AS prefilter, count(*) FILTER (position >= 0.1 AND volume_ratio > 1) AS gate, count(*) FILTER (position >= 0.1 AND volume_ratio > 1 AND box_pos <= 0.7) AS entry FROM f GROUP BY 1")
def funnel(spark, sf_dir):
    a, b, c = F.col("position") >= 0.1, F.col("volume_ratio") > 1, F.col("box_pos") <= 0.7
    return rows(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("bars"), F.count_if(a).alias("prefilter"), F.count_if(a & b).alias("gate"), F.count_if(a & b & c).alias("entry"))


@query("A29_bar_outcomes", "SELECT o_orderpriority AS strategy, upper(trim(c_mktsegment)) AS symbol, 'engine' AS engine, o_orderstatus AS outcome, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE trim(o_orderpriority) <> '' GROUP BY ALL")
def bar_outcomes(spark, sf_dir):
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return L.bar_outcomes(joined.select(F.col("o_orderpriority").alias("strategy"), F.col("c_mktsegment").alias("symbol"), F.lit("engine").alias("engine"), F.col("o_orderstatus").alias("outcome")))


@query("A30_missing_rate", f"WITH RECURSIVE {ROWS} SELECT {_r('sum(CASE WHEN roc IS NULL THEN 1 ELSE 0 END + CASE WHEN box_pos IS NULL THEN 1 ELSE 0 END + 1) / (count(*) * 3)', 'missing_rate')} FROM f")
def missing_rate(spark, sf_dir):
    return L.missing_rate(rows(spark, sf_dir), ["roc", "box_pos", "not_there"]).withColumn("missing_rate", F.round("missing_rate", 6))


@query("A31_true_rate", f"WITH RECURSIVE {ROWS} SELECT symbol, ts, {_r('(CASE WHEN position > 0 THEN 1 ELSE 0 END + CASE WHEN volume_ratio > 1 THEN 1 ELSE 0 END + CASE WHEN flow > 0 THEN 1 ELSE 0 END) / 3.0', 'true_rate')} FROM f")
def true_rate(spark, sf_dir):
    flags = F.create_map(*(x for n, c in (("p", "position > 0"), ("v", "volume_ratio > 1"), ("f", "flow > 0")) for x in (F.lit(n), F.coalesce(F.expr(c), F.lit(False)))))
    return rows(spark, sf_dir).select("symbol", "ts", F.round(L.true_rate(flags), 6).alias("true_rate"))


@query("A32_mode_entropy", f"WITH RECURSIVE {ROWS}, p AS (SELECT count(*) / (SELECT count(*) FROM f) AS p FROM f GROUP BY regime) SELECT {_r('-sum(p * ln(p))', 'entropy')} FROM p")
def mode_entropy(spark, sf_dir):
    return L.entropy(rows(spark, sf_dir), "regime").withColumn("entropy", F.round("entropy", 6))


@query("A33_tick_gap", f"WITH {TICKS}, k AS (SELECT DISTINCT symbol FROM ticks UNION ALL SELECT 'none') SELECT k.symbol, {_r('epoch(TIMESTAMP ' + chr(39) + '2024-02-01' + chr(39) + ') - epoch(max(ts))', 'gap_s')} FROM k LEFT JOIN ticks t ON k.symbol = t.symbol GROUP BY 1")
def tick_gap(spark, sf_dir):
    t = ticks(spark, sf_dir)
    last = t.groupBy("symbol").agg(F.max("ts").alias("last"))
    keys = last.select("symbol").unionByName(spark.createDataFrame([("none",)], "symbol string"))
    gap = F.lit("2024-02-01").cast("timestamp").cast("double") - F.col("last").cast("double")
    return keys.join(last, "symbol", "left").select("symbol", F.round(gap, 6).alias("gap_s"))


@query("A34_staleness", f"WITH {TICKS} SELECT symbol, max(ts) AS last FROM ticks GROUP BY 1 HAVING max(ts) < TIMESTAMP '2024-01-30 23:30:00'")
def staleness(spark, sf_dir):
    return ticks(spark, sf_dir).groupBy("symbol").agg(F.max("ts").alias("last")).where("last < timestamp'2024-01-30 23:30:00'")


@query("A35_duplicate_check", f"WITH {LEDGER} SELECT trade_id, leg, count(*) AS n FROM ledger WHERE exit_time >= (SELECT max(exit_time) FROM ledger) - INTERVAL 365 DAY GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_check(spark, sf_dir):
    led = ledger(spark, sf_dir)
    late = led.join(F.broadcast(led.agg(F.max("exit_time").alias("_m"))), F.col("exit_time") >= F.col("_m") - F.expr("interval 365 days"))
    return late.groupBy("trade_id", "leg").agg(F.count("*").alias("n")).where("n > 1")


@query("A38_buy_hold", f"WITH {BARS}, e AS (SELECT symbol, arg_max(close, ts) / arg_min(close, ts) - 1 AS r FROM bars GROUP BY 1) SELECT symbol, {_r('r', 'ret')} FROM e UNION ALL SELECT 'basket', {_r('avg(r)', 'ret')} FROM e")
def buy_hold(spark, sf_dir):
    return rounded(L.buy_hold(bars(spark, sf_dir)), "ret", keys=("symbol",))


_SECTOR = "CASE WHEN symbol IN ('click', 'view') THEN 'traffic' ELSE 'account' END"


@query("A39_heat", f"WITH RECURSIVE {BARS}, wk AS (SELECT symbol, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS ts, arg_max(close, ts) AS close FROM bars GROUP BY 1, 2), {ema_cte('e', 'close', W.span(50), 'wk')}, s AS (SELECT symbol, {_SECTOR} AS sector, arg_max((close - e_v) / e_v, ts) AS h FROM e GROUP BY 1) SELECT sector, symbol, {_r('avg(h)', 'heat')} FROM s GROUP BY ROLLUP (sector, symbol)")
def heat(spark, sf_dir):
    days = W.ema(B.resample(bars(spark, sf_dir), "1 day"), "close", W.span(50), "ema")
    last = days.groupBy("symbol").agg(F.max_by((F.col("close") - F.col("ema")) / F.col("ema"), "ts").alias("h"))
    sector = F.when(F.col("symbol").isin("click", "view"), "traffic").otherwise("account")
    return last.withColumn("sector", sector).rollup("sector", "symbol").agg(F.round(F.avg("h"), 6).alias("heat"))


@query("A40_budget_split", f"""WITH RECURSIVE {ROWS}, l AS (SELECT symbol, arg_max(volume_ratio, ts) AS score, {_SECTOR} AS mode, symbol <> 'error' AS gated FROM f GROUP BY 1),
  o AS (SELECT symbol, mode, score / sum(score) OVER (PARTITION BY mode) * CASE mode WHEN 'traffic' THEN 0.6 ELSE 0.4 END AS own FROM l WHERE gated) SELECT symbol, mode, {_r('own / sum(own) OVER ()', 'weight')} FROM o""")
def budget_split(spark, sf_dir):
    mode = F.when(F.col("symbol").isin("click", "view"), "traffic").otherwise("account")
    last = rows(spark, sf_dir).groupBy("symbol").agg(F.max_by("volume_ratio", "ts").alias("score")).withColumn("mode", mode).withColumn("gated", F.col("symbol") != "error")
    return L.budget_split(last, {"traffic": 0.6, "account": 0.4}).withColumn("weight", F.round("weight", 6))


@query("A41_equity_change", f"WITH {BARS}, c AS (SELECT symbol, ts, close / first_value(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ch FROM bars) SELECT symbol, ts, {_r('ch', 'change')} FROM c WHERE abs(ch) >= 0.03")
def equity_change(spark, sf_dir):
    anchor = F.first("close").over(W.order().rowsBetween(Window.unboundedPreceding, 0))
    return rounded(bars(spark, sf_dir).withColumn("change", L.equity_change(F.col("close"), anchor, 0.03)).where("change is not null"), "change")


@query("A42_gainers", f"WITH {BARS}, l AS (SELECT * FROM bars WHERE ts > (SELECT max(ts) FROM bars) - INTERVAL 24 HOUR), g AS (SELECT symbol, 100 * (arg_max(close, ts) / arg_min(open, ts) - 1) AS ch, sum(volume * close) AS qv FROM l GROUP BY 1) SELECT symbol, {_r('ch', 'change_pct')}, {_r('qv', 'quote_volume')} FROM g WHERE qv >= 1000 ORDER BY ch DESC, symbol LIMIT 2")
def gainers(spark, sf_dir):
    return rounded(L.gainers(bars(spark, sf_dir), 24, 1000.0, 2), "change_pct", "quote_volume", keys=("symbol",))


@query("A43_cost_stress", f"WITH {LEDGER}, c AS (SELECT * REPLACE (pnl_r - notional * bps / 1e4 / 1e4 AS pnl_r) FROM (SELECT l.*, b.bps FROM ledger l CROSS JOIN (SELECT unnest([0.0, 5.0, 20.0])::DOUBLE AS bps) b)), {_dd('symbol, bps', 'c')} SELECT symbol, bps, {_METRICS} FROM d GROUP BY 1, 2")
def cost_stress(spark, sf_dir):
    return rounded(L.cost_stress(ledger(spark, sf_dir), [0.0, 5.0, 20.0], ["symbol"], ORDER), *_MET, keys=("symbol", "bps", "trades"))


@query("A44_halt_day", f"WITH {LEDGER}, {_dd('symbol')}, h AS (SELECT symbol, min(exit_time) AS halt FROM d WHERE dd <= -50 GROUP BY 1) SELECT d.symbol, h.halt, count(*) FILTER (h.halt IS NULL OR exit_time <= h.halt) AS kept, count(*) FILTER (NOT (h.halt IS NULL OR exit_time <= h.halt)) AS rejected FROM d LEFT JOIN h ON d.symbol = h.symbol GROUP BY 1, 2")
def halt_day(spark, sf_dir):
    return L.halt_day(ledger(spark, sf_dir), ["symbol"], ORDER, 50.0)
