"""Votes, merging, reconciliation and metrics over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..adapters import table
from ..operators import metrics as me
from ..operators import voting as vo
from ..plans import answers as an
from ..plans import graph as g

_W = "CASE WHEN o_orderstatus = 'P' THEN 0.6 ELSE 1.0 END * (o_totalprice / 500000.0) * (1 - (o_orderkey % 5) / 10.0)"


def _readings(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("track"), F.year("o_orderdate").alias("clip"), F.col("o_orderpriority").alias("value"), (F.col("o_orderstatus") == "P").alias("from_retry"), (F.col("o_totalprice") / 500000.0).alias("crop_quality"), ((F.col("o_orderkey") % 5) / 10.0).alias("occlusion"), "o_orderdate", "o_orderkey")
    return vo.weigh(o)


_READ = f"r AS (SELECT o_custkey AS track, year(o_orderdate) AS clip, o_orderpriority AS value, greatest(1e-6, {_W}) AS weight, o_orderdate, o_orderkey FROM orders)"


def _vote_sql(keys: str) -> str:
    return f"""{_READ}, s AS (SELECT {keys}, value, sum(CAST(round(weight * 1000000000) AS HUGEINT)) AS w, count(*) AS n FROM r GROUP BY {keys}, value),
    sh AS (SELECT *, (2 * w * 1000000 + sum(w) OVER (PARTITION BY {keys})) // (2 * sum(w) OVER (PARTITION BY {keys})) AS ppm, row_number() OVER (PARTITION BY {keys} ORDER BY w DESC, value) AS rank FROM s),
    v AS (SELECT {keys}, max(value) FILTER (WHERE rank = 1) AS winner, CAST(sum(n) AS BIGINT) AS n_votes,
           (max(ppm) FILTER (WHERE rank = 1) - coalesce(max(ppm) FILTER (WHERE rank = 2), 0)) / 1000000 AS margin FROM sh GROUP BY {keys}),
    vote AS (SELECT *, CASE WHEN n_votes < 3 THEN 'insufficient_evidence' WHEN margin < 0.15 THEN 'low_margin' END AS uncertain_reason FROM v)"""


def f1_vote(spark, d):
    v = vo.vote(_readings(spark, d), ["track"])
    return v.select("track", "winner", "n_votes", "margin", "uncertain")


F1 = f"WITH {_vote_sql('track')} SELECT track, winner, n_votes, margin, uncertain_reason IS NOT NULL AS uncertain FROM vote"


def f2_merge_clips(spark, d):
    clips = vo.vote(_readings(spark, d), ["track", "clip"])
    return vo.merge_clips(clips, ["track"]).select("track", "value", "support", F.round("confidence", 6).alias("confidence"))


F2 = f"""WITH {_vote_sql('track, clip')}, b AS (SELECT track, winner AS value, CAST(sum(greatest(n_votes, 1)) AS BIGINT) AS support FROM vote WHERE uncertain_reason IS NULL GROUP BY track, winner),
k AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY support DESC, value) AS r, sum(support) OVER (PARTITION BY track) AS total FROM b)
SELECT track, value, support, round(support / total, 6) AS confidence FROM k WHERE r = 1"""


def _distribution(spark, d):
    s = vo.shares(_readings(spark, d), ["track", "clip"])
    n = F.sum("n").over(Window.partitionBy("track", "clip"))
    return vo.merge_distributions(s.withColumn("n_votes", n), ["track"])


def f3_merge_distributions(spark, d):
    return _distribution(spark, d).select("track", "value", "share")


F3 = f"""WITH {_vote_sql('track, clip')}, w AS (SELECT track, value, sum(CAST(nv * ppm AS HUGEINT)) AS w FROM (SELECT *, sum(n) OVER (PARTITION BY track, clip) AS nv FROM sh) GROUP BY track, value)
SELECT track, value, ((2 * w * 1000000 + sum(w) OVER (PARTITION BY track)) // (2 * sum(w) OVER (PARTITION BY track))) / 1000000 AS share FROM w"""


def f4_majority(spark, d):
    return vo.majority(_readings(spark, d), ["track"], "value", "o_orderkey").select("track", "value", "n")


F4 = f"WITH {_READ}, b AS (SELECT track, value, count(*) AS n, min(o_orderkey) AS f FROM r GROUP BY track, value) SELECT track, value, n FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY n DESC, f) AS k FROM b) WHERE k = 1"


def _reconciled(spark, d):
    v = vo.vote(_readings(spark, d), ["track"])
    best = _readings(spark, d).groupBy("track").agg(F.max_by("value", F.struct("crop_quality", "o_orderkey")).alias("best_value"))
    attr = F.element_at(F.array(*[F.lit(x) for x in ("color", "vehicle_type", "make", "model", "direction")]), (F.col("track") % 5 + 1).cast("int"))
    pairs = v.join(best, "track").select("track", attr.alias("attribute"), F.when(~F.col("uncertain"), F.col("winner")).alias("clip_value"), F.col("margin").alias("clip_confidence"), F.when(F.col("track") % 7 != 0, F.col("best_value")).alias("best_value"), (F.col("track") % 11 == 0).alias("best_uncertain"))
    return vo.reconcile(pairs)


def q22_reconcile(spark, d):
    return _reconciled(spark, d).select("track", "attribute", "outcome", "value", "confidence", "source", "uncertain")


_REC = f"""{_vote_sql('track')}, best AS (SELECT o_custkey AS track, arg_max(o_orderpriority, (o_totalprice / 500000.0, o_orderkey)) AS best FROM orders GROUP BY o_custkey), p AS (
 SELECT v.track, ['color', 'vehicle_type', 'make', 'model', 'direction'][v.track % 5 + 1] AS attribute, CASE WHEN uncertain_reason IS NULL THEN winner END AS cv, margin AS cc,
  CASE WHEN v.track % 7 <> 0 THEN best END AS bv, v.track % 11 = 0 AS bu FROM vote v JOIN best USING (track)), o AS (
 SELECT *, CASE WHEN attribute = 'direction' OR bv IS NULL OR bu THEN 'unconfirmed' WHEN cv IS NULL THEN 'filled' WHEN cv = bv THEN 'confirmed' WHEN attribute IN ('make', 'model') THEN 'corrected' ELSE 'retained' END AS outcome FROM p), rec AS (
 SELECT track, attribute, outcome, CASE WHEN outcome IN ('filled', 'corrected') THEN bv ELSE cv END AS value,
  CASE WHEN outcome IN ('filled', 'corrected') THEN 1.0 WHEN outcome = 'confirmed' THEN least(1.0, cc + 0.1) WHEN outcome = 'retained' THEN cc * 0.8 ELSE cc END AS confidence,
  CASE WHEN outcome IN ('filled', 'corrected') THEN 'best_shot' WHEN outcome = 'confirmed' THEN 'agreed' WHEN outcome = 'retained' THEN 'clip_voting' ELSE 'unconfirmed' END AS source FROM o)"""
Q22 = f"WITH {_REC} SELECT track, attribute, outcome, value, round(confidence, 6) AS confidence, source, value IS NULL AS uncertain FROM rec"


def f14_outcomes(spark, d):
    return _reconciled(spark, d).groupBy("attribute", "outcome").agg(F.count(F.lit(1)).alias("n"))


F14 = f"WITH {_REC} SELECT attribute, outcome, count(*) AS n FROM rec GROUP BY ALL"


def f15_uncertainty(spark, d):
    r = _reconciled(spark, d)
    return r.groupBy("attribute").agg(F.round(F.avg(F.col("uncertain").cast("int")), 4).alias("rate"), F.count(F.lit(1)).alias("n"))


F15 = f"WITH {_REC} SELECT attribute, round(avg(CAST(value IS NULL AS INTEGER)), 4) AS rate, count(*) AS n FROM rec GROUP BY attribute"


def f16_accuracy(spark, d):
    """The reconciled value against each customer's majority."""
    truth = vo.majority(_readings(spark, d), ["track"], "value", "o_orderkey").select("track", F.when(F.col("track") % 13 != 0, F.col("value")).alias("truth"))
    return me.attribute_accuracy(_reconciled(spark, d).join(truth, "track"))


F16 = f"""WITH {_REC}, b AS (SELECT track, value, count(*) AS n, min(o_orderkey) AS f FROM r GROUP BY track, value),
t AS (SELECT track, CASE WHEN track % 13 <> 0 THEN value END AS truth FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY n DESC, f) AS k FROM b) WHERE k = 1),
c AS (SELECT attribute, count(*) FILTER (WHERE value = truth) AS correct, count(*) FILTER (WHERE value <> truth) AS wrong, count(*) FILTER (WHERE truth IS NOT NULL AND value IS NULL) AS abstained, count(*) FILTER (WHERE truth IS NULL) AS missing_truth FROM rec JOIN t USING (track) GROUP BY attribute)
SELECT *, round(correct / nullif(correct + wrong, 0), 4) AS precision, round((correct + wrong) / nullif(correct + wrong + abstained, 0), 4) AS coverage FROM c"""


def f17_consistency(spark, d):
    v = vo.vote(_readings(spark, d), ["track", "clip"]).withColumnRenamed("winner", "value")
    return me.consistency(v, ["track"]).select("track", "n", "n_distinct", "consistency")


F17 = f"""WITH {_vote_sql('track, clip')}, c AS (SELECT track, count(winner) FILTER (WHERE uncertain_reason IS NULL) AS n, count(DISTINCT winner) FILTER (WHERE uncertain_reason IS NULL) AS n_distinct FROM vote GROUP BY track)
SELECT *, CASE WHEN n < 2 THEN 'single' WHEN n_distinct = 1 THEN 'consistent' ELSE 'inconsistent' END AS consistency FROM c"""


def w12_identity_changes(spark, d):
    """Switches and fragments of each user's event types, errors unmatched."""
    e = table(spark, d, "events").select(F.col("user_id").alias("identity"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("frame_no"), F.lit("v").alias("video_id"), "event_type")
    matches = e.where("event_type <> 'error'").select("video_id", "frame_no", F.col("identity").alias("a"), F.col("event_type").alias("b"))
    c = me.identity_changes(e, matches, ["video_id", "frame_no"])
    return c.select(F.col("a").alias("user_id"), "switches", "fragments")


W12 = """WITH e AS (SELECT user_id, ts, event_id, CASE WHEN event_type <> 'error' THEN event_type END AS b FROM events), l AS (
 SELECT *, last_value(b IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p, lag(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS q FROM e)
SELECT user_id, count(*) FILTER (WHERE b IS NOT NULL AND p IS NOT NULL AND p <> b) AS switches, count(*) FILTER (WHERE b IS NOT NULL AND q IS NULL AND p IS NOT NULL) AS fragments FROM l GROUP BY user_id"""


def i19_set_scores(spark, d):
    """Suppliers of an order against the suppliers of its returned lines."""
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("found"), F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_suppkey"))).alias("expected"))
    return g.select("l_orderkey", *[c.alias(n) for n, c in me.set_scores("found", "expected").items()])


I19 = """WITH g AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n, count(DISTINCT l_suppkey) FILTER (WHERE l_returnflag = 'R') AS m FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN m > 0 THEN round(m / n, 4) END AS precision, CASE WHEN m > 0 THEN 1.0 END AS recall, CASE WHEN m > 0 THEN round(2 * m / (n + m), 4) END AS f1 FROM g"""



def q4_distribution(spark, d):
    """Candidates of each customer's attribute in the order shown."""
    return an.distribution(_distribution(spark, d), ["track"]).select("track", "rank", "value", "share")


Q4 = f"SELECT track, CAST(row_number() OVER (PARTITION BY track ORDER BY share DESC, value) AS INTEGER) AS rank, value, share FROM ({F3})"


def q10_best_shot_audit(spark, d):
    """Final values that the best shot decided, with their vote shares."""
    r = _reconciled(spark, d).withColumnRenamed("track", "global_id")
    shares = _distribution(spark, d).select(F.col("track").alias("global_id"), "value", "share").join(r.select("global_id", "attribute"), "global_id").select("global_id", "attribute", "value", "share")
    edges = g.attribute_edges(shares, r.select("global_id", "attribute", "value", "confidence", "source", "uncertain"))
    return an.best_shot_audit(edges).select("global_id", F.col("type").alias("attribute"), "value", F.round("share", 6).alias("share"), F.round("confidence", 6).alias("confidence"))


Q10 = f"""WITH {_REC}, w AS (SELECT track, value, sum(CAST(nv * ppm AS HUGEINT)) AS w FROM (SELECT *, sum(n) OVER (PARTITION BY track, clip) AS nv FROM (WITH {_vote_sql("track, clip")} SELECT track, clip, value, n, ppm FROM sh)) GROUP BY track, value),
d AS (SELECT track, value, ((2 * w * 1000000 + sum(w) OVER (PARTITION BY track)) // (2 * sum(w) OVER (PARTITION BY track))) / 1000000 AS share FROM w)
SELECT rec.track AS global_id, attribute, rec.value, round(coalesce(share, 0), 6) AS share, round(confidence, 6) AS confidence FROM rec LEFT JOIN d ON d.track = rec.track AND d.value = rec.value WHERE source = 'best_shot' AND rec.value IS NOT NULL"""

QUERIES = {
    "q4_distribution": (q4_distribution, Q4), "q10_best_shot_audit": (q10_best_shot_audit, Q10),
    "f1_vote": (f1_vote, F1), "f2_merge_clips": (f2_merge_clips, F2), "f3_merge_distributions": (f3_merge_distributions, F3), "f4_majority": (f4_majority, F4),
    "q22_reconcile": (q22_reconcile, Q22), "f14_outcomes": (f14_outcomes, F14), "f15_uncertainty": (f15_uncertainty, F15), "f16_accuracy": (f16_accuracy, F16),
    "f17_consistency": (f17_consistency, F17), "w12_identity_changes": (w12_identity_changes, W12), "i19_set_scores": (i19_set_scores, I19),
}
