"""Sorts, limits and set operations (K and U rows of the inventory)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import ranking as R
from tidemark.plans.catalog import query
from tidemark.plans.q_statistics import _DECAY, _decay
from tidemark.plans.views import AUX, LEDGER, aux, ledger
from tidemark.session import table


@query("K01_top_quantile", f"WITH {LEDGER} SELECT trade_id, leg, part, notional FROM ledger WHERE notional >= (SELECT quantile_cont(notional, 0.95) FROM ledger)")
def top_quantile(spark, sf_dir):
    return R.top_quantile(ledger(spark, sf_dir), "notional", 0.05).select("trade_id", "leg", "part", "notional")


@query("K02_top_n_features", f"WITH RECURSIVE {_DECAY}, one AS (SELECT feature, ic FROM ic WHERE horizon = 3), b AS (SELECT * FROM one ORDER BY abs(ic) DESC, feature LIMIT 1) SELECT feature, round(ic, 6) AS ic FROM b UNION ALL SELECT feature, round(ic, 6) FROM one WHERE feature = 'roc' AND feature NOT IN (SELECT feature FROM b)")
def top_features(spark, sf_dir):
    one = _decay(spark, sf_dir).where("horizon = 3").select("feature", "ic")
    return R.top_features(one, 1, ["roc"]).withColumn("ic", F.round("ic", 6))


@query(
    "K03_rule_priority",
    """WITH r AS (SELECT DISTINCT p_type AS rule_class, p_brand AS archetype, p_brand || '-' || p_type AS rule_id FROM part), c AS (SELECT p_type AS rule_class, dense_rank() OVER (ORDER BY p_type) % 4 + 1 AS cp FROM (SELECT DISTINCT p_type FROM part))
  SELECT rule_id, archetype, CAST(CASE WHEN r.archetype LIKE '%1' THEN 0 ELSE cp END AS INTEGER) AS priority FROM r LEFT JOIN c ON r.rule_class = c.rule_class""",
)
def rule_priority(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_type").alias("rule_class"), F.col("p_brand").alias("archetype"), F.concat_ws("-", "p_brand", "p_type").alias("rule_id")).distinct()
    classes = part.select("rule_class").distinct().withColumn("class_priority", F.dense_rank().over(Window.orderBy("rule_class")) % 4 + 1)
    overrides = part.where("archetype like '%1'").select("archetype", "rule_id", F.lit(0).alias("override"))
    return R.rule_priority(part, classes, overrides).select("rule_id", "archetype", "priority")


@query("K04_latest_n", "SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def latest(spark, sf_dir):
    return R.latest(table(spark, sf_dir, "events").select("event_id", "ts", "event_type"), ["ts", "event_id"], 100)


@query("K05_downsample", f"WITH {AUX}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY aux_id) - 1 AS k, ceil(count(*) OVER (PARTITION BY symbol) / 2500) AS s FROM aux) SELECT symbol, aux_id, value FROM r WHERE k % s = 0")
def downsample(spark, sf_dir):
    return R.downsample(aux(spark, sf_dir), "symbol", "aux_id", 2500).select("symbol", "aux_id", "value")


_MONTHS = "m AS (SELECT month, CAST(row_number() OVER (ORDER BY month) - 1 AS INTEGER) AS idx FROM (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month FROM orders))"


@query("K06_schedule_index", f"WITH {_MONTHS}, w AS (SELECT strftime(l_shipdate, '%Y-%m') AS month, min(l_orderkey) AS request FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01' GROUP BY 1) SELECT CAST(request AS BIGINT) AS request, idx AS \"index\", w.month FROM w JOIN m ON w.month = m.month")
def schedule(spark, sf_dir):
    months = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month")).distinct()
    listed = months.withColumn("index", F.row_number().over(Window.orderBy("month")) - 1)
    wanted = table(spark, sf_dir, "lineitem").where("l_shipdate < timestamp'1998-01-01'").select(F.col("l_orderkey").alias("pos"), F.date_format("l_shipdate", "yyyy-MM").alias("month"))
    return R.schedule_index(listed, wanted)


@query("U01_union_markers", "SELECT o_orderkey AS id, o_orderpriority AS symbol, o_totalprice AS price, NULL::DOUBLE AS qty, 'trend' AS scope FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') UNION ALL SELECT event_id, event_type, value, 1.0, 'spot' FROM events WHERE event_type IN ('1-URGENT', '2-HIGH', 'click')")
def markers(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("symbol"), F.col("o_totalprice").alias("price"))
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("symbol"), F.col("value").alias("price"), F.lit(1.0).alias("qty"))
    return R.union_markers({"trend": o, "spot": e, "multi": e}, F.col("symbol").isin("1-URGENT", "2-HIGH", "click"), ["trend", "spot"])


@query("U02_rules_merge", "SELECT p_partkey AS id, 0 AS source_order FROM part WHERE p_size % 2 = 0 AND p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 1 FROM part WHERE p_size % 2 = 1 AND p_partkey % 2 = 1")
def rules_merge(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 2 == 0).alias("locked"))
    return R.rules_merge(p.where("id % 2 = 0"), p.where("id % 2 = 1")).select("id", "source_order")


@query("U03_dedup_runs", "SELECT DISTINCT id FROM (SELECT o_custkey AS id FROM orders UNION ALL SELECT c_custkey FROM customer)")
def dedup_runs(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).union(table(spark, sf_dir, "customer").select("c_custkey")).dropDuplicates(["id"])


@query("U04_new_vs_old", "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 100000")
def new_vs_old(spark, sf_dir):
    old = table(spark, sf_dir, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("id"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).join(old, "id", "left_anti")


@query("U05_mode_class", "SELECT s_suppkey, CASE WHEN s_nationkey % 4 = 0 THEN 'spot' ELSE 'trend' END AS mode FROM supplier")
def mode_class(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    names = F.array(F.lit("bpc"), F.when(F.col("s_nationkey") % 4 == 0, "spot_accum").otherwise("tpc"))
    return s.select("s_suppkey", R.mode_class(names).alias("mode"))
