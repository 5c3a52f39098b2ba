"""Crops, answers and lookups in time over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import SAMPLES_SQL, samples, table
from ..operators import crops as cr
from ..operators import metrics as me
from ..operators import trajectory as tr


def c16_crop_paths(spark, d):
    """Every third path has backslashes, every fifth too few parts."""
    k = F.col("o_orderkey")
    name = F.concat(F.lit("frame."), k.cast("string"), F.lit(".jpg"))
    path = F.concat_ws("/", F.lit("data"), F.lit("crops"), F.concat(F.lit("clip_"), (k % 13).cast("string")), F.col("o_custkey").cast("string"), name)
    path = F.when(k % 5 == 0, F.concat_ws("/", F.lit("crops"), F.lit("x"), name)).when(k % 3 == 0, F.replace(path, F.lit("/"), F.lit("\\"))).otherwise(path)
    return table(spark, d, "orders").select("o_orderkey", *[c.alias(n) for n, c in cr.crop_path(path).items()])


C16 = "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN 'clip_' || (o_orderkey % 13) END AS clip_id, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS track_id, CASE WHEN o_orderkey % 5 <> 0 THEN 'frame.' || o_orderkey END AS frame_id FROM orders"


def c19_clamp(spark, d):
    b = tuple(F.col(c) for c in ("x1", "y1", "x2", "y2"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("double") - 10.5).alias("x1"), (F.col("l_discount").cast("double") * 100 - 4).alias("y1"), (F.col("l_quantity").cast("double") + 7.25).alias("x2"), (F.col("l_tax").cast("double") * 100).alias("y2"))
    return rows.select("l_orderkey", "l_linenumber", *[c.alias(n) for n, c in zip(("x1", "y1", "x2", "y2"), cr.clamp(b, F.lit(40), F.lit(6)), strict=True)])


C19 = """WITH b AS (SELECT l_orderkey, l_linenumber, greatest(0, CAST(trunc(CAST(l_quantity AS DOUBLE) - 10.5) AS INTEGER)) AS x1, greatest(0, CAST(trunc(CAST(l_discount AS DOUBLE) * 100 - 4) AS INTEGER)) AS y1,
  least(40, CAST(trunc(CAST(l_quantity AS DOUBLE) + 7.25) AS INTEGER)) AS x2, least(6, CAST(trunc(CAST(l_tax AS DOUBLE) * 100) AS INTEGER)) AS y2 FROM lineitem)
SELECT l_orderkey, l_linenumber, """ + ", ".join(f"CASE WHEN x2 > x1 AND y2 > y1 THEN {c} END AS {c}" for c in ("x1", "y1", "x2", "y2")) + " FROM b"


def c20_shot_scores(spark, d):
    """Lines as crops; returned ones are partly hidden, the others unknown."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", *[F.col(c).cast("double").alias(c) for c in ("l_quantity", "l_extendedprice", "l_discount")])
    li = li.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("flag"), F.max("l_quantity").alias("q"), F.max("l_extendedprice").alias("p"), F.max("l_discount").alias("occlusion"))
    crops = li.select("l_orderkey", "l_linenumber", (F.col("q") * 2).alias("w"), (F.col("l_linenumber") * 15.0 - 14).alias("h"), (F.col("p") / 200).alias("sharpness"))
    out = cr.scored_shots(crops, li.where("flag = 'R'"), ["l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", F.round("score", 10).alias("score"), F.round(cr.caption_quality(F.col("w"), F.col("h"), F.col("sharpness")), 10).alias("caption_quality"))


C20 = """WITH l AS (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS flag, max(CAST(l_quantity AS DOUBLE)) * 2 AS w, l_linenumber * 15.0 - 14 AS h, max(CAST(l_extendedprice AS DOUBLE)) / 200 AS s, max(CAST(l_discount AS DOUBLE)) AS o FROM lineitem GROUP BY 1, 2),
q AS (SELECT *, least(1.0, sqrt(w * h) / 128) * least(1.0, s / 200) * (1 - CASE WHEN flag = 'R' THEN o ELSE 0.0 END) * (0.5 + 0.5 * least(1.0, greatest(0.0, (2.2 - w / h) / (CAST(2.2 AS DOUBLE) - CAST(1.2 AS DOUBLE))))) AS score FROM l WHERE w >= 2 AND h >= 2)
SELECT l_orderkey, l_linenumber, round(score, 10) AS score, round(least(1.0, sqrt(w * h) / 96) * least(1.0, s / 200), 10) AS caption_quality FROM q WHERE score > 0"""


def m5_identity_votes(spark, d):
    return me.identity_votes(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("b"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("a")))


M5 = "SELECT b, a, n FROM (SELECT l_suppkey AS b, l_returnflag || l_linenumber AS a, count(*) AS n, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_returnflag || l_linenumber) AS r FROM lineitem GROUP BY 1, 2) WHERE r = 1"


def f18_answer_summary(spark, d):
    """Orders as questions, their priorities as answering systems."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    text = lambda n: (k % n).cast("string")
    kind = F.element_at(F.array(*map(F.lit, ("factual", "counting", "temporal", "relational"))), (k % 4 + 1).cast("int"))
    items = o.select(k.alias("question_id"), kind.alias("question_type"), (k % 9 != 0).alias("answerable"), F.when(k % 8 != 5, k % 3).alias("expected_count"), F.array(text(7), text(5)).alias("expected_ids"))
    said = F.when(k % 6 == 0, F.lit("I cannot determine that.")).when(k % 6 == 1, F.lit("There is insufficient evidence.")).otherwise(F.lit("It is the red one."))
    answers = o.select(k.alias("question_id"), F.col("o_orderpriority").alias("system"), said.alias("answer"), (k % 2).alias("said_count"), F.array(text(3), text(11)).alias("cited_ids"), F.array(text(11), F.lit("1"), F.lit("2")).alias("retrieved_ids"))
    true_ids = spark.range(11).select(F.col("id").cast("string").alias("b"), (F.col("id") % 6).cast("string").alias("a"))
    return me.answer_summary(me.answer_scores(items, answers, true_ids))


F18 = """WITH q AS (SELECT o_orderkey AS k, o_orderpriority AS system, k % 9 <> 0 AS ask, k % 6 IN (0, 1) AS quiet, k % 4 AS kind, list_distinct([k % 3 % 6, k % 11 % 6]) AS m, list_distinct([k % 7, k % 5]) AS e FROM orders),
s AS (SELECT *, 2 * len(list_intersect(m, e)) / (len(m) + len(e)) AS f FROM q)
SELECT system, count(*) AS n_questions, round(avg(CASE WHEN k % 2 = k % 3 THEN 1.0 ELSE 0.0 END) FILTER (WHERE ask AND kind = 1 AND k % 8 <> 5), 4) AS counting_accuracy, round(avg(f) FILTER (WHERE ask AND kind < 3), 4) AS object_f1,
 round(avg(CASE WHEN quiet <> ask THEN 1.0 ELSE 0.0 END), 4) AS abstention_accuracy, round(avg(CASE WHEN k % 3 IN (1, 2) OR k % 3 = k % 11 THEN 1.0 ELSE 0.0 END), 4) AS grounded_rate FROM s GROUP BY system"""


def e11_nearest_sample(spark, d):
    """A quarter of an hour behind every fifth sample, the nearest one."""
    s = samples(spark, d).select("obj", "pos", "t", "event_id")
    times = s.where("pos % 5 = 0").select("obj", (F.col("t") + 0.25).alias("at"))
    return tr.nearest_samples(times, s, ["obj"]).select("obj", F.round("at", 6).alias("at"), "sample.pos", "sample.event_id")


E11 = f"""WITH {SAMPLES_SQL}, q AS (SELECT DISTINCT obj, t + 0.25 AS "at" FROM samples WHERE pos % 5 = 0),
r AS (SELECT q.obj, "at", pos, event_id, row_number() OVER (PARTITION BY q.obj, "at" ORDER BY abs(t - "at"), pos) AS n FROM q JOIN samples USING (obj))
SELECT obj, round("at", 6) AS "at", pos, event_id FROM r WHERE n = 1"""


def e28_sighting_at(spark, d):
    """Years as sightings of a customer, asked for at three days."""
    day = lambda c: F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date"))
    s = table(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("pos")).agg(F.min(day("o_orderdate")).alias("first_seen"), F.max(day("o_orderdate")).alias("last_seen"))
    times = s.select("o_custkey").distinct().withColumn("at", F.explode(F.array(*map(F.lit, (8500, 9400, 10300)))))
    return tr.sighting_at(times, s, ["o_custkey"])


E28 = """WITH s AS (SELECT o_custkey, year(o_orderdate) AS pos, min(CAST(o_orderdate AS DATE) - DATE '1970-01-01') AS f, max(CAST(o_orderdate AS DATE) - DATE '1970-01-01') AS l FROM orders GROUP BY 1, 2),
r AS (SELECT o_custkey, "at", pos, "at" BETWEEN f AND l AS c, row_number() OVER (PARTITION BY o_custkey, "at" ORDER BY ("at" BETWEEN f AND l) DESC, CASE WHEN "at" BETWEEN f AND l THEN 0 ELSE abs("at" - f) END, pos) AS n FROM s CROSS JOIN (VALUES (8500), (9400), (10300)) v("at"))
SELECT o_custkey, "at", pos, c AS covered FROM r WHERE n = 1"""

QUERIES = {
    "c16_crop_paths": (c16_crop_paths, C16),
    "c19_clamp": (c19_clamp, C19),
    "c20_shot_scores": (c20_shot_scores, C20),
    "m5_identity_votes": (m5_identity_votes, M5),
    "f18_answer_summary": (f18_answer_summary, F18),
    "e11_nearest_sample": (e11_nearest_sample, E11),
    "e28_sighting_at": (e28_sighting_at, E28),
}
