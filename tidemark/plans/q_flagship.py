"""Ticks to a condition scan in one plan."""

from __future__ import annotations

from tidemark.operators import labels as L
from tidemark.operators import rules as R
from tidemark.operators import statistics as S
from tidemark.operators import windows as W
from tidemark.plans.catalog import query
from tidemark.plans.q_features import ATR, TR, rounded, w
from tidemark.plans.q_statistics import _IN, _Z, _r
from tidemark.plans.views import BARS, bars

_CONDS = {"trending": "trend_r2 >= 0.3", "loud": "volume >= 300", "both": "trend_r2 >= 0.3 AND volume >= 300"}
_SCAN = " UNION ALL ".join(f"SELECT '{n}' AS condition, 'all' AS bucket, {_IN} FROM (SELECT *, coalesce({c}, false) AS c FROM x)" for n, c in _CONDS.items())


@query("flagship", f"""WITH {BARS}, {TR}, {ATR}, i AS (SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY ts) AS DOUBLE) AS i FROM atr),
  y AS (SELECT *, regr_r2(close, i) OVER {w(20)} AS trend_r2, (lead(close, 10) OVER (PARTITION BY symbol ORDER BY ts) - close) / greatest(atr_v, 1e-9) AS rr FROM i),
  x AS (SELECT *, CASE WHEN rr >= -0.8 THEN 1.0 ELSE 0.0 END AS label FROM y WHERE n >= 2 AND rr IS NOT NULL), g AS ({_SCAN})
  SELECT condition, bucket, {_r('p1', 'p_in')}, n1 AS n_in, {_r('p2', 'p_out')}, n2 AS n_out, {_r('100 * (p1 - p2)', 'delta_pp')}, {_r(_Z, 'z')} FROM g""")
def flagship(spark, sf_dir):
    df = W.trend_r2(W.atr(bars(spark, sf_dir)), 20).withColumn("rr", L.signed_rr(10))
    df = L.is_good(df.where("rr is not null"))
    conditions = {n: R.clause(c) for n, c in _CONDS.items()}
    got = S.condition_set(df, "is_good", R.rules(df, [{"feature": "n", "operator": ">=", "value": 2}]), conditions)
    return rounded(got, "p_in", "p_out", "delta_pp", "z", keys=("condition", "bucket", "n_in", "n_out"))


