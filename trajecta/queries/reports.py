"""Evaluation reports over orders and line items; years stand for videos."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import table
from ..operators import metrics as me
from ..plans import report as rp

_KEY = ["video"]


def f19_stage_summary(spark, d):
    """Line items as raw tracks, orders as associated ones, suppliers as objects."""
    li = table(spark, d, "lineitem").withColumn("video", F.year("l_shipdate"))
    orders = li.groupBy("video", "l_orderkey").agg(F.count(F.lit(1)).alias("n_fragments"))
    suppliers = li.groupBy("video", "l_suppkey").agg(F.count_distinct("l_returnflag").alias("n_sightings"))
    return rp.stage_summary(li, orders, suppliers, _KEY)


F19 = """WITH li AS (SELECT year(l_shipdate)::INTEGER AS video, * FROM lineitem),
s AS (SELECT video, 0 AS line, 'tracking' AS stage, count(*) AS identities, 'raw per-clip tracks' AS note FROM li GROUP BY video
  UNION ALL SELECT video, 1, 'association', count(*), (sum(n - 1))::BIGINT::VARCHAR || ' fragment merges' FROM (SELECT video, l_orderkey, count(*) AS n FROM li GROUP BY 1, 2) GROUP BY video
  UNION ALL SELECT video, 2, 'linking', count(*), (count(*) FILTER (WHERE n > 1))::VARCHAR || ' span multiple clips' FROM (SELECT video, l_suppkey, count(DISTINCT l_returnflag) AS n FROM li GROUP BY 1, 2) GROUP BY video)
SELECT video, line::INTEGER AS line, stage, identities, note FROM s"""


def f21_class_roster(spark, d):
    """Customers as objects of their nation, by market segment."""
    return rp.roster(table(spark, d, "customer").select(F.col("c_nationkey").alias("video"), F.col("c_mktsegment").alias("class")), _KEY)


F21 = """SELECT c_nationkey AS video, c_mktsegment AS class, count(*) AS n, (row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment))::INTEGER AS rank
FROM customer GROUP BY 1, 2"""


def _orders(spark, d):
    return table(spark, d, "orders").withColumn("video", F.year("o_orderdate"))


def _videos(orders):
    """1996 has no ground truth, 1998 no reconciled objects."""
    return orders.select("video").distinct().withColumns({"has_truth": F.col("video") != 1996, "has_final": F.col("video") != 1998})


def _rows(orders):
    """Three attributes of every order; 1997 has boxes only."""
    key, none = F.col("o_orderkey"), F.lit(None).cast("string")
    known = F.col("video") != 1997
    each = (
        ("customer", F.col("o_custkey").cast("string"), F.col("o_custkey").cast("string"), F.lit(True)),
        ("priority", F.when(key % 4 != 0, F.col("o_orderpriority")), F.when(key % 3 == 0, F.lit("1-URGENT")).otherwise(F.col("o_orderpriority")), F.col("o_orderstatus") == "P"),
        ("status", F.col("o_orderstatus"), F.lit("F"), key % 5 == 0),
    )
    made = F.array(*[F.struct(F.lit(a).alias("attribute"), F.when(known, t).otherwise(none).alias("truth"), v.alias("value"), u.alias("uncertain")) for a, t, v, u in each])
    return orders.select("video", "o_custkey", F.explode(made).alias("x")).select("video", "o_custkey", "x.*")


def _accuracy(spark, d):
    orders = _orders(spark, d)
    return rp.accuracy_report(_rows(orders), _videos(orders), _KEY)


def m8_accuracy_report(spark, d):
    return _accuracy(spark, d)


_VIDEOS = "o AS (SELECT year(o_orderdate)::INTEGER AS video, * FROM orders), videos AS (SELECT DISTINCT video, video <> 1996 AS has_truth, video <> 1998 AS has_final FROM o)"
_ROWS = """x AS (SELECT video, o_custkey, 'customer' AS attribute, CASE WHEN video <> 1997 THEN o_custkey::VARCHAR END AS truth, o_custkey::VARCHAR AS value, true AS uncertain FROM o
  UNION ALL SELECT video, o_custkey, 'priority', CASE WHEN video <> 1997 AND o_orderkey % 4 <> 0 THEN o_orderpriority END, CASE WHEN o_orderkey % 3 = 0 THEN '1-URGENT' ELSE o_orderpriority END, o_orderstatus = 'P' FROM o
  UNION ALL SELECT video, o_custkey, 'status', CASE WHEN video <> 1997 THEN o_orderstatus END, 'F', o_orderkey % 5 = 0 FROM o)"""
_ACCURACY = f"""{_VIDEOS}, {_ROWS},
n AS (SELECT video, attribute, count(*) FILTER (WHERE truth IS NOT NULL AND NOT uncertain AND value = truth) AS correct, count(*) FILTER (WHERE truth IS NOT NULL AND NOT uncertain AND value <> truth) AS wrong,
  count(*) FILTER (WHERE truth IS NOT NULL AND uncertain) AS abstained FROM x GROUP BY 1, 2),
why AS (SELECT video, CASE WHEN NOT has_truth THEN 'no ground truth for this video' WHEN NOT has_final THEN 'no reconciled objects for this video' WHEN total = 0 THEN 'the ground truth has boxes but no attribute values' END AS reason
  FROM videos JOIN (SELECT video, sum(correct + wrong + abstained) AS total FROM n GROUP BY 1) USING (video)),
l AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY attribute) AS line FROM n JOIN why USING (video) WHERE reason IS NULL),
c AS (SELECT video, line, attribute, 0 AS col, 'correct' AS metric, correct::DOUBLE AS value, NULL AS reason FROM l
  UNION ALL SELECT video, line, attribute, 1, 'wrong', wrong, NULL FROM l UNION ALL SELECT video, line, attribute, 2, 'abstained', abstained, NULL FROM l
  UNION ALL SELECT video, line, attribute, 3, 'precision', CASE WHEN correct + wrong > 0 THEN round(correct / (correct + wrong), 4) END, CASE WHEN correct + wrong = 0 THEN 'nothing was answered' END FROM l
  UNION ALL SELECT video, line, attribute, 4, 'coverage', CASE WHEN correct + wrong + abstained > 0 THEN round((correct + wrong) / (correct + wrong + abstained), 4) END, CASE WHEN correct + wrong + abstained = 0 THEN 'the ground truth has boxes but no attribute values' END FROM l
  UNION ALL SELECT video, 0, NULL, 0, NULL, NULL, reason FROM why WHERE reason IS NOT NULL),
report AS (SELECT video, 'attribute accuracy' AS label, line::INTEGER AS line, attribute AS row, col::INTEGER AS "column", metric, value, reason FROM c)"""
M8 = f"WITH {_ACCURACY} SELECT * FROM report"


def m8_consistency_report(spark, d):
    """An object is a customer; orders are its sightings."""
    orders = _orders(spark, d)
    kinds = me.consistency(_rows(orders).where("attribute <> 'customer' OR video > 1999"), ["video", "o_custkey", "attribute"])
    return rp.consistency_report(kinds, _videos(orders), _KEY)


M8C = f"""WITH {_VIDEOS}, {_ROWS},
k AS (SELECT video, o_custkey, attribute, count(value) FILTER (WHERE NOT uncertain) AS n, count(DISTINCT value) FILTER (WHERE NOT uncertain) AS m FROM x WHERE attribute <> 'customer' OR video > 1999 GROUP BY 1, 2, 3),
n AS (SELECT video, attribute, count(*) FILTER (WHERE n >= 2 AND m = 1) AS good, count(*) FILTER (WHERE n >= 2 AND m > 1) AS bad, count(*) FILTER (WHERE n < 2) AS single FROM k GROUP BY 1, 2),
why AS (SELECT video, CASE WHEN NOT has_final THEN 'no reconciled objects for this video' WHEN coalesce(total, 0) = 0 THEN 'every object was seen in one clip only' END AS reason
  FROM videos LEFT JOIN (SELECT video, sum(good + bad) AS total FROM n GROUP BY 1) USING (video)),
l AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY attribute) AS line FROM n JOIN why USING (video) WHERE reason IS NULL),
c AS (SELECT video, line, attribute, 0 AS col, 'consistent' AS metric, good::DOUBLE AS value, NULL AS reason FROM l
  UNION ALL SELECT video, line, attribute, 1, 'inconsistent', bad, NULL FROM l
  UNION ALL SELECT video, line, attribute, 2, 'rate', CASE WHEN good + bad > 0 THEN round(good / (good + bad), 4) END, CASE WHEN good + bad = 0 THEN 'every object was seen in one clip only' END FROM l
  UNION ALL SELECT video, line, attribute, 3, 'single', single, NULL FROM l
  UNION ALL SELECT video, 0, NULL, 0, NULL, NULL, reason FROM why WHERE reason IS NOT NULL)
SELECT video, 'attribute consistency' AS label, line::INTEGER AS line, attribute AS row, col::INTEGER AS "column", metric, value, reason FROM c"""


def b9_latex(spark, d):
    """The accuracy report of every video as a document."""
    return rp.latex(_accuracy(spark, d), _KEY)


B9 = rf"""WITH {_ACCURACY},
cells AS (SELECT video, line, row, "column", metric, reason, value IS NOT NULL AS has, CASE WHEN value IS NULL THEN '-' WHEN value = floor(value) THEN value::BIGINT::VARCHAR ELSE value::VARCHAR END AS cell FROM report),
lines AS (SELECT video, line, coalesce(row, '') || ' & ' || string_agg(cell, ' & ' ORDER BY "column") || ' \\' AS t, string_agg(metric, ' & ' ORDER BY "column") AS head, bool_or(has) AS has, count(*) AS n, min(reason) AS reason FROM cells GROUP BY video, line, row),
tabs AS (SELECT video, bool_or(has) AS has, min(reason) AS reason, '\begin{{tabular}}{{l' || repeat('r', max(n)::INTEGER) || '}}' || chr(10) || '\toprule' || chr(10) || 'name & ' || min(head) || ' \\' || chr(10) || '\midrule' || chr(10) || string_agg(t, chr(10) ORDER BY line) || chr(10) || '\bottomrule' || chr(10) || '\end{{tabular}}' AS body FROM lines GROUP BY video)
SELECT video, '\begin{{table}}[h]' || chr(10) || '\centering' || chr(10) || '\caption{{attribute accuracy}}' || chr(10) || CASE WHEN has THEN body ELSE '\textit{{Not available: ' || reason || '}}' END || chr(10) || '\end{{table}}' || chr(10) AS document FROM tabs"""

QUERIES = {
    "f19_stage_summary": (f19_stage_summary, F19),
    "f21_class_roster": (f21_class_roster, F21),
    "m8_accuracy_report": (m8_accuracy_report, M8),
    "m8_consistency_report": (m8_consistency_report, M8C),
    "b9_latex": (b9_latex, B9),
}
