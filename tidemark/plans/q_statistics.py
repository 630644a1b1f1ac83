"""Scan statistics and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import statistics as S
from tidemark.operators import windows as W
from tidemark.operators.prefix import group_quantiles
from tidemark.plans.catalog import query
from tidemark.plans.q_features import rounded
from tidemark.plans.q_rules import ROWS, rows
from tidemark.plans.views import LABELED, LEDGER, labeled, ledger

_r = lambda s, n: f"round(CAST({s} AS DOUBLE), 6) AS {n}"
_IN = "avg(label) FILTER (c) AS p1, count(*) FILTER (c) AS n1, avg(label) FILTER (NOT c) AS p2, count(*) FILTER (NOT c) AS n2"
_POOL = "(p1 * n1 + p2 * n2) / (n1 + n2)"
_VAR = f"({_POOL} * (1 - {_POOL}) * (1.0 / n1 + 1.0 / n2))"
_Z = f"CASE WHEN n1 >= 5 AND n2 >= 5 AND {_VAR} > 0 THEN abs(p1 - p2) / sqrt({_VAR}) ELSE 0 END"


@query("A03_two_prop_z", f"WITH {LABELED}, g AS (SELECT source, avg(label) FILTER (toxic = 1) AS p1, count(*) FILTER (toxic = 1) AS n1, avg(label) FILTER (toxic = 0) AS p2, count(*) FILTER (toxic = 0) AS n2 FROM labeled GROUP BY source) SELECT source, coalesce({_r(_Z, 'z').removesuffix(' AS z')}, 0) AS z FROM g")
def two_prop_z(spark, sf_dir):
    t = F.col("toxic") == 1
    g = labeled(spark, sf_dir).groupBy("source").agg(F.avg(F.when(t, F.col("label"))).alias("p1"), F.count(F.when(t, 1)).alias("n1"), F.avg(F.when(~t, F.col("label"))).alias("p2"), F.count(F.when(~t, 1)).alias("n2"))
    return g.select("source", F.coalesce(F.round(S.two_prop_z(*map(F.col, ("p1", "n1", "p2", "n2"))), 6), F.lit(0.0)).alias("z"))


@query("A04_lift", f"WITH {LABELED}, g AS (SELECT source, avg(toxic) FILTER (label = 1) AS g, avg(toxic) FILTER (label = 0) AS b FROM labeled GROUP BY source) SELECT source, CASE WHEN b > 0 THEN round(g / b - 1, 6) WHEN g > 0 THEN 1e9 ELSE 0 END AS lift FROM g")
def lift(spark, sf_dir):
    g = labeled(spark, sf_dir).groupBy("source").agg(F.avg(F.when(F.col("label") == 1, F.col("toxic"))).alias("g"), F.avg(F.when(F.col("label") == 0, F.col("toxic"))).alias("b"))
    return g.select("source", F.least(F.round(S.lift(F.col("g"), F.col("b")), 6), F.lit(1e9)).alias("lift"))


_AVG = "rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0"


@query("A05_rank_ic", f"WITH {LABELED}, r AS (SELECT lang, {_AVG.format(by='lang', x='feature')} AS a, {_AVG.format(by='lang', x='label')} AS b FROM labeled) SELECT lang, {_r('(covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0))', 'ic')}, count(*) AS n FROM r GROUP BY lang")
def rank_ic(spark, sf_dir):
    return S.rank_ic(labeled(spark, sf_dir), "feature", "label", "lang").withColumn("ic", F.round("ic", 6))


_FEATS, _HORIZONS = ["position", "roc", "box_pos"], [1, 3, 6]
_DECAY = f"""{ROWS}, a AS (SELECT position, roc, box_pos, {', '.join(f'lead(ret, {h}) OVER w AS t{h}' for h in _HORIZONS)} FROM (SELECT *, close / lag(close) OVER w AS ret FROM f WINDOW w AS (PARTITION BY symbol ORDER BY ts)) WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
  l AS ({' UNION ALL '.join(f"SELECT '{x}' AS feature, {h} AS horizon, {x} AS v, t{h} AS t FROM a" for x in _FEATS for h in _HORIZONS)}),
  k AS (SELECT feature, horizon, {_AVG.format(by='feature, horizon', x='v')} AS a, {_AVG.format(by='feature, horizon', x='t')} AS b FROM l WHERE v IS NOT NULL AND t IS NOT NULL),
  ic AS (SELECT feature, horizon, (covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0)) AS ic, count(*) AS n FROM k GROUP BY 1, 2)"""


def _decay(spark, sf_dir):
    b = rows(spark, sf_dir).withColumn("ret", F.col("close") / W.lag("close"))
    return S.ic_decay(b, _FEATS, _HORIZONS, "ret")


@query("A06_ic_decay", f"WITH RECURSIVE {_DECAY} SELECT feature, horizon, {_r('ic', 'ic')}, n, 'ret_shift_' || horizon AS target, true AS shifted FROM ic")
def ic_decay(spark, sf_dir):
    return _decay(spark, sf_dir).withColumn("ic", F.round("ic", 6))


@query("A07_ic_screen", f"WITH RECURSIVE {_DECAY}, p AS (SELECT feature, arg_max({{'h': horizon, 'ic': ic, 'n': n}}, (abs(ic), -horizon)) AS p FROM ic GROUP BY 1) SELECT feature, p.h AS horizon, {_r('p.ic', 'ic')}, p.n AS n, CAST(row_number() OVER (ORDER BY abs(p.ic) DESC, feature) AS INTEGER) AS place FROM p WHERE p.h IN (1, 3) AND p.h <> 6 AND abs(p.ic) >= 0.001 AND p.n >= 100")
def ic_screen(spark, sf_dir):
    return S.ic_screen(_decay(spark, sf_dir), [1, 3], 6, 0.001, 100).withColumn("ic", F.round("ic", 6))


_CONDS = {"short_text": "feature <= 1000", "long_text": "feature >= 3000", "hot_source": "source = 'src0'"}
_CS = " UNION ALL ".join(f"SELECT '{n}' AS condition, bucket, {_IN} FROM (SELECT *, {c} AS c FROM x) GROUP BY bucket" for n, c in _CONDS.items())


@query("A08_condition_set", f"WITH {LABELED}, x AS (SELECT *, CASE WHEN lang = 'en' THEN 'en' ELSE 'other' END AS bucket FROM labeled WHERE toxic = 0), g AS ({_CS}) SELECT condition, bucket, {_r('p1', 'p_in')}, n1 AS n_in, {_r('p2', 'p_out')}, n2 AS n_out, {_r('100 * (p1 - p2)', 'delta_pp')}, {_r(_Z, 'z')} FROM g")
def condition_set(spark, sf_dir):
    got = S.condition_set(labeled(spark, sf_dir), "label", F.col("toxic") == 0, {n: F.expr(c) for n, c in _CONDS.items()}, F.when(F.col("lang") == "en", "en").otherwise("other"))
    return rounded(got, "p_in", "p_out", "delta_pp", "z", keys=("condition", "bucket", "n_in", "n_out"))


_GRID = [500.0, 1000.0, 2000.0, 4000.0]
_PL = " UNION ALL ".join(f"SELECT {t} AS threshold, {_IN} FROM (SELECT *, feature >= {t} AS c FROM labeled)" for t in _GRID)


@query("A09_feature_plateau", f"WITH {LABELED}, g AS ({_PL}), z AS (SELECT *, {_Z} AS z FROM g) SELECT CAST(threshold AS DOUBLE) AS threshold, {_r('p1', 'p_in')}, n1 AS n_in, {_r('p2', 'p_out')}, n2 AS n_out, {_r('100 * (p1 - p2)', 'delta_pp')}, {_r('z', 'z')}, threshold = (SELECT arg_min(threshold, (-z, threshold)) FROM z) AS recommended FROM z")
def feature_plateau(spark, sf_dir):
    return rounded(S.plateau(labeled(spark, sf_dir), "feature", ">=", _GRID, "label"), "p_in", "p_out", "delta_pp", "z", keys=("threshold", "recommended", "n_in", "n_out"))


_GP = " UNION ALL ".join(f"SELECT {t}::DOUBLE AS threshold, avg(CASE WHEN feature >= {t} THEN 1.0 ELSE 0.0 END) FILTER (label = 1) AS g, avg(CASE WHEN feature >= {t} THEN 1.0 ELSE 0.0 END) FILTER (label = 0) AS b FROM labeled" for t in _GRID)


@query("A10_gate_plateau", f"WITH {LABELED}, g AS ({_GP}) SELECT threshold, {_r('g', 'pass_good')}, {_r('b', 'pass_bad')}, {_r('CASE WHEN b > 0 THEN g / b - 1 WHEN g > 0 THEN 1e9 ELSE 0 END', 'lift')}, {_r('g - b', 'gate_score')} FROM g")
def gate_plateau(spark, sf_dir):
    got = S.gate_plateau(labeled(spark, sf_dir), "feature", _GRID, F.col("label") == 1)
    return rounded(got.withColumn("lift", F.least("lift", F.lit(1e9))), "pass_good", "pass_bad", "lift", "gate_score", keys=("threshold",))


@query("A11_gate_score", f"WITH {LABELED} SELECT lang, {_r('avg(CASE WHEN feature < 500 THEN 1.0 ELSE 0.0 END) FILTER (label = 0) - avg(CASE WHEN feature < 500 THEN 1.0 ELSE 0.0 END) FILTER (label = 1)', 'gate_score')} FROM labeled GROUP BY lang")
def gate_score(spark, sf_dir):
    return labeled(spark, sf_dir).groupBy("lang").agg(F.round(S.gate_score(F.col("feature") < 500, F.col("label") == 1), 6).alias("gate_score"))


_STEPS = [float(5000 + 6000 * i) for i in range(15)]


@query("A12_snotio_plateau", f"WITH {LEDGER}, g AS (SELECT unnest({_STEPS}) AS threshold) SELECT threshold, {_r('avg(pnl_r)', 'mean_r')}, count(*) AS trades FROM g JOIN ledger ON notional >= threshold GROUP BY 1 HAVING count(*) >= 20")
def snotio_plateau(spark, sf_dir):
    return S.threshold_means(ledger(spark, sf_dir), "notional", "pnl_r", _STEPS).withColumn("mean_r", F.round("mean_r", 6))


_QS = [0.5, 0.8, 0.9, 0.95]


@query("A13_tau_scan", f"WITH {LEDGER}, q AS (SELECT unnest({_QS}) AS q, unnest(quantile_cont(notional, {_QS})) AS threshold FROM ledger) SELECT CAST(q AS DOUBLE) AS q, {_r('threshold', 'threshold')}, count(*) AS trades, {_r('avg(pnl_r)', 'mean_r')} FROM q JOIN ledger ON notional >= threshold GROUP BY q, threshold")
def tau_scan(spark, sf_dir):
    return rounded(S.tau_scan(ledger(spark, sf_dir), "notional", "pnl_r", _QS), "threshold", "mean_r", keys=("q", "trades"))


@query("A14_plateau_update", f"""WITH {LABELED}, h AS (SELECT source, quantile_cont(feature, 0.25) FILTER (doc_id % 2 = 0) AS nl, quantile_cont(feature, 0.75) FILTER (doc_id % 2 = 0) AS nh, quantile_cont(feature, 0.25) FILTER (doc_id % 2 = 1) AS ll, quantile_cont(feature, 0.75) FILTER (doc_id % 2 = 1) AS lh FROM labeled GROUP BY source)
  SELECT source, CASE WHEN ll IS NULL THEN 'ADOPT' WHEN nl = ll AND nh = lh THEN 'KEEP' WHEN least(nh, lh) - greatest(nl, ll) >= 0.5 * (nh - nl) THEN 'ADOPT' ELSE 'ALERT' END AS verdict FROM h""")
def plateau_update(spark, sf_dir):
    halves = labeled(spark, sf_dir).withColumn("even", F.col("doc_id") % 2 == 0)
    bands = group_quantiles(halves, ["source", "even"], "feature", [0.25, 0.75])
    pair = F.struct(F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))
    g = bands.groupBy("source").agg(F.max(F.when(F.col("even"), pair)).alias("n"), F.max(F.when(~F.col("even"), pair)).alias("l"))
    return g.select("source", S.plateau_update(F.col("n"), F.col("l")).alias("verdict"))


_HALF = "CASE WHEN doc_id % 2 = 0 THEN 'current' ELSE 'reference' END"


@query("A15_psi", f"""WITH {LABELED}, e AS (SELECT quantile_cont(feature, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM labeled WHERE doc_id % 2 = 1),
  b AS (SELECT doc_id % 2 AS odd, len(list_filter(edges, lambda x: feature > x)) AS bin FROM labeled CROSS JOIN e),
  s AS (SELECT bin, count(*) FILTER (odd = 0) / (SELECT count(*) FROM b WHERE odd = 0) AS a, count(*) FILTER (odd = 1) / (SELECT count(*) FROM b WHERE odd = 1) AS e FROM b GROUP BY bin)
  SELECT {_r('sum((greatest(a, 1e-6) - greatest(e, 1e-6)) * ln(greatest(a, 1e-6) / greatest(e, 1e-6)))', 'psi')} FROM s""")
def psi(spark, sf_dir):
    df = labeled(spark, sf_dir)
    return S.psi(df.where("doc_id % 2 = 0"), df.where("doc_id % 2 = 1"), "feature").withColumn("psi", F.round("psi", 6))


_DRIFTED = ["position", "roc", "box_pos"]
_LONG = " UNION ALL ".join(f"SELECT '{x}' AS feature, {x} AS x, ts >= TIMESTAMP '2024-01-16' AS now FROM f" for x in _DRIFTED)


@query("A15_psi_features", f"""WITH RECURSIVE {ROWS}, lo AS (SELECT * FROM ({_LONG}) WHERE x IS NOT NULL), ed AS (SELECT feature, quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM lo WHERE NOT now GROUP BY 1),
  bi AS (SELECT lo.feature, now, len(list_filter(edges, lambda y: lo.x > y)) AS bin FROM lo JOIN ed ON lo.feature = ed.feature), co AS (SELECT feature, bin, count(*) FILTER (now) AS a, count(*) FILTER (NOT now) AS e FROM bi GROUP BY 1, 2),
  sh AS (SELECT feature, greatest(a / sum(a) OVER (PARTITION BY feature), 1e-6) AS p, greatest(e / sum(e) OVER (PARTITION BY feature), 1e-6) AS q FROM co) SELECT feature, {_r('sum((p - q) * ln(p / q))', 'psi')} FROM sh GROUP BY 1""")
def psi_features(spark, sf_dir):
    df = rows(spark, sf_dir).select("ts", *_DRIFTED)
    now = F.col("ts") >= F.lit("2024-01-16").cast("timestamp")
    return S.psi_features(df.where(now), df.where(~now), _DRIFTED).withColumn("psi", F.round("psi", 6))


_IC2 = f"r AS (SELECT lang, doc_id % 2 AS odd, {_AVG.format(by='lang, doc_id % 2', x='feature')} AS a, {_AVG.format(by='lang, doc_id % 2', x='label')} AS b FROM labeled), i AS (SELECT lang, odd, (covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0)) AS ic FROM r GROUP BY 1, 2)"


@query("A16_ic_drift", f"WITH {LABELED}, {_IC2} SELECT c.lang, {_r('c.ic', 'ic')}, {_r('b.ic', 'baseline')}, coalesce(sign(c.ic) <> sign(b.ic) OR abs(c.ic) < 0.5 * abs(b.ic), false) AS drifted FROM i c LEFT JOIN i b ON c.lang = b.lang AND b.odd = 1 WHERE c.odd = 0")
def ic_drift(spark, sf_dir):
    df = labeled(spark, sf_dir)
    cur, base = (S.rank_ic(df.where(f"doc_id % 2 = {k}"), "feature", "label", "lang").drop("n") for k in (0, 1))
    both = cur.join(base.withColumnRenamed("ic", "baseline"), "lang", "left")
    drift = (F.signum("ic") != F.signum("baseline")) | (F.abs("ic") < 0.5 * F.abs("baseline"))
    return rounded(both.withColumn("drifted", F.coalesce(drift, F.lit(False))), "ic", "baseline", keys=("lang", "drifted"))


@query("A17_mid_in_band", f"WITH {LABELED} SELECT lang, 1500.0 BETWEEN quantile_cont(feature, 0.1) AND quantile_cont(feature, 0.95) AS inside FROM labeled GROUP BY lang")
def mid_in_band(spark, sf_dir):
    g = group_quantiles(labeled(spark, sf_dir), ["lang"], "feature", [0.1, 0.95])
    return g.select("lang", F.lit(1500.0).between(F.col("q")[0], F.col("q")[1]).alias("inside"))


@query("A18_value_percentile", f"WITH {LABELED} SELECT lang, {_r('avg(CASE WHEN feature <= 1500 THEN 1.0 ELSE 0.0 END)', 'percentile')} FROM labeled GROUP BY lang")
def value_percentile(spark, sf_dir):
    return labeled(spark, sf_dir).groupBy("lang").agg(F.round(F.avg((F.col("feature") <= 1500).cast("double")), 6).alias("percentile"))


@query("A19_regime_shares", f"WITH RECURSIVE {ROWS}, s AS (SELECT regime, count(*) / (SELECT count(*) FROM f) AS share FROM f GROUP BY 1) SELECT regime, {_r('share', 'share')}, abs(share - CASE regime WHEN 'flat' THEN 0.4 ELSE 0.3 END) > 0.1 AS flagged FROM s")
def regime_shares(spark, sf_dir):
    s = S.shares(rows(spark, sf_dir), "regime")
    gap = F.abs(F.col("share") - F.when(F.col("regime") == "flat", 0.4).otherwise(0.3))
    return s.select("regime", F.round("share", 6).alias("share"), (gap > 0.1).alias("flagged"))


@query("A36_eval_metrics", f"""WITH RECURSIVE {ROWS}, ev AS (SELECT symbol, roc AS p, lead(roc, 5) OVER w AS t FROM f WINDOW w AS (PARTITION BY symbol ORDER BY ts)), k AS (SELECT * FROM ev WHERE p IS NOT NULL AND t IS NOT NULL),
  r AS (SELECT *, {_AVG.format(by='symbol', x='p')} AS a, {_AVG.format(by='symbol', x='t')} AS b FROM k)
  SELECT symbol, {_r('avg(CASE WHEN sign(p) = sign(t) THEN 1.0 ELSE 0.0 END)', 'accuracy')}, {_r('(covar_pop(p, t) / nullif(stddev_pop(p) * stddev_pop(t), 0))', 'pearson')}, {_r('avg(abs(p - t))', 'mae')}, {_r('(covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0))', 'ic')} FROM r GROUP BY symbol""")
def eval_metrics(spark, sf_dir):
    e = rows(spark, sf_dir).withColumn("ahead", F.lead("roc", 5).over(W.order())).where("roc is not null and ahead is not null")
    return rounded(S.eval_metrics(e, "roc", "ahead"), "accuracy", "pearson", "mae", "ic", keys=("symbol",))


@query("A37_ks_distance", f"WITH {LABELED}, c AS (SELECT feature, sum(label) AS g, sum(1 - label) AS b FROM labeled GROUP BY 1), r AS (SELECT sum(g) OVER (ORDER BY feature) / (SELECT sum(g) FROM c) AS cg, sum(b) OVER (ORDER BY feature) / (SELECT sum(b) FROM c) AS cb FROM c) SELECT {_r('max(abs(cg - cb))', 'ks')} FROM r")
def ks(spark, sf_dir):
    return S.ks_distance(labeled(spark, sf_dir), "feature", "label").withColumn("ks", F.round("ks", 6))
