"""Graph patterns: customers as objects, orders and user events as events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..adapters import table
from ..plans import graph as g


def _objects(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.date_format(F.min("o_orderdate"), "yyyy-MM-dd'T'HH:mm:ss").alias("first_seen"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd'T'HH:mm:ss").alias("last_seen"))
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(o, c.c_custkey == o.o_custkey, "left")
    return j.select(F.col("c_custkey").alias("global_id"), F.lower("c_mktsegment").alias("class"), F.when(F.col("c_acctbal") >= 0, F.col("n_name")).alias("color"), F.when(F.col("c_custkey") % 3 != 0, F.col("n_regionkey").cast("string")).alias("vehicle_type"), "first_seen", "last_seen", F.col("c_acctbal").alias("color_confidence"))


_OBJ = """objects AS (SELECT c_custkey AS global_id, lower(c_mktsegment) AS class, CASE WHEN c_acctbal >= 0 THEN n_name END AS color,
  CASE WHEN c_custkey % 3 <> 0 THEN CAST(n_regionkey AS VARCHAR) END AS vehicle_type, strftime(f, '%Y-%m-%dT%H:%M:%S') AS first_seen, strftime(l, '%Y-%m-%dT%H:%M:%S') AS last_seen, c_acctbal AS color_confidence
  FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS f, max(o_orderdate) AS l FROM orders GROUP BY 1) ON o_custkey = c_custkey)"""


def _events(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.upper("event_type").alias("type"), F.col("user_id").alias("global_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("start_time"), "value")


_EV = "ev AS (SELECT event_id, upper(event_type) AS type, user_id AS global_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS start_time, value FROM events)"


def q1_attribute_filter(spark, d):
    n = table(spark, d, "nation").agg(F.min("n_name")).first()[0]
    found = g.find_objects(_objects(spark, d), g.Intent(attributes={"color": n}, classes=("building", "machinery")))
    return found.select("global_id", "class", "color", "first_seen", "last_seen", F.round("color_confidence", 2).alias("confidence"))


Q1 = f"WITH {_OBJ} SELECT global_id, class, color, first_seen, last_seen, round(color_confidence, 2) AS confidence FROM objects WHERE color = (SELECT min(n_name) FROM nation) AND class IN ('building', 'machinery')"


def q2_seen_before(spark, d):
    e = _events(spark, d).where(F.substring("start_time", 12, 8) < "12:05:00")
    return e.groupBy("global_id").agg(F.min("start_time").alias("first_seen"), F.count(F.lit(1)).alias("frames_seen"))


Q2 = f"WITH {_EV} SELECT global_id, min(start_time) AS first_seen, count(*) AS frames_seen FROM ev WHERE substring(start_time, 12, 8) < '12:05:00' GROUP BY global_id"


def q3_timeline(spark, d):
    """Both collections are aggregated before they meet the object."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("global_id")).agg(F.count_distinct(F.year("o_orderdate")).alias("n_clips"), F.array_join(F.array_sort(F.collect_set(F.date_format("o_orderdate", "yyyy"))), ",").alias("clips"))
    e = _events(spark, d).groupBy("global_id").agg(F.count_distinct("type", "start_time").alias("n_events"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"))
    return _objects(spark, d).select("global_id", "class").join(o, "global_id", "left").join(e, "global_id", "left")


Q3 = f"""WITH {_OBJ}, {_EV}, o AS (SELECT o_custkey AS global_id, count(DISTINCT year(o_orderdate)) AS n_clips, string_agg(DISTINCT strftime(o_orderdate, '%Y'), ',' ORDER BY strftime(o_orderdate, '%Y')) AS clips FROM orders GROUP BY 1),
e AS (SELECT global_id, count(DISTINCT (type, start_time)) AS n_events, string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM ev GROUP BY 1)
SELECT global_id, class, n_clips, clips, n_events, types FROM objects LEFT JOIN o USING (global_id) LEFT JOIN e USING (global_id)"""


def q5_who_whom(spark, d):
    """Edges user to next user of the same event type within the day, with
    both ends' attributes; edges without an end vanish."""
    w = Window.partitionBy("type", F.substring("start_time", 1, 10)).orderBy("start_time", "event_id")
    edges = _events(spark, d).withColumn("object_id", F.lead("global_id").over(w)).where("object_id IS NOT NULL").select("event_id", F.col("global_id").alias("subject_id"), "object_id", F.col("start_time").alias("seen_at"))
    o = _objects(spark, d)
    edges = g.attach(edges, [(o, "global_id", "subject_id"), (o, "global_id", "object_id")])
    a = o.select(F.col("global_id").alias("subject_id"), F.col("class").alias("subject_class"))
    b = o.select(F.col("global_id").alias("object_id"), F.col("class").alias("object_class"))
    return edges.join(a, "subject_id").join(b, "object_id").select("event_id", "subject_id", "subject_class", "object_id", "object_class", "seen_at")


Q5 = f"""WITH {_OBJ}, {_EV}, x AS (SELECT event_id, global_id AS subject_id, lead(global_id) OVER (PARTITION BY type, substring(start_time, 1, 10) ORDER BY start_time, event_id) AS object_id, start_time AS seen_at FROM ev)
SELECT event_id, subject_id, a.class AS subject_class, object_id, b.class AS object_class, seen_at FROM x JOIN objects a ON a.global_id = subject_id JOIN objects b ON b.global_id = object_id"""


def q6_event_filter(spark, d):
    e = _events(spark, d).where(F.col("type").isin("PURCHASE", "SIGNUP"))
    return e.join(_objects(spark, d), "global_id").select("global_id", "class", "type", "start_time", F.round("value", 4).alias("value"))


Q6 = f"WITH {_OBJ}, {_EV} SELECT global_id, class, type, start_time, round(value, 4) AS value FROM ev JOIN objects USING (global_id) WHERE type IN ('PURCHASE', 'SIGNUP')"


def q8_counts(spark, d):
    return g.count_objects(_objects(spark, d))


Q8 = f"WITH {_OBJ} SELECT coalesce(class, 'unknown') AS class, coalesce(vehicle_type, 'unknown') AS vehicle_type, coalesce(color, 'unknown') AS color, count(*) AS n FROM objects GROUP BY 1, 2, 3"


def q9_cross_clip(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("global_id")).agg(F.count_distinct(F.year("o_orderdate")).alias("n_clips"), F.count(F.lit(1)).alias("n_tracks"), F.min("o_orderkey").alias("first_track"))
    return o.where("n_clips > 1")


Q9 = "SELECT o_custkey AS global_id, count(DISTINCT year(o_orderdate)) AS n_clips, count(*) AS n_tracks, min(o_orderkey) AS first_track FROM orders GROUP BY 1 HAVING count(DISTINCT year(o_orderdate)) > 1"


def e15_subject_of_all(spark, d):
    """Objects that are the subject of a purchase and of an error."""
    e = _events(spark, d)
    involves = e.select("event_id", "global_id", F.lit("subject").alias("role"))
    return g.find_objects(_objects(spark, d), g.Intent(events=("PURCHASE", "ERROR")), involves=involves, events=e).select("global_id", "class")


E15 = f"WITH {_OBJ} SELECT global_id, class FROM objects WHERE EXISTS (SELECT 1 FROM events WHERE user_id = global_id AND event_type = 'purchase') AND EXISTS (SELECT 1 FROM events WHERE user_id = global_id AND event_type = 'error')"


def e18_event_participants(spark, d):
    e = _events(spark, d).where(F.col("type").isin("PURCHASE", "CLICK") & F.substring("start_time", 12, 8).between("06:00:00", "18:00:00"))
    return e.groupBy("type", F.substring("start_time", 1, 10).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("global_id").alias("n_objects"), F.array_join(F.slice(F.array_sort(F.collect_set("global_id")), 1, 5).cast("array<string>"), ",").alias("participants"))


E18 = f"""WITH {_EV} SELECT type, substring(start_time, 1, 10) AS day, count(*) AS n, count(DISTINCT global_id) AS n_objects,
 array_to_string(list_slice(list_sort(list_distinct(list(global_id))), 1, 5), ',') AS participants FROM ev WHERE type IN ('PURCHASE', 'CLICK') AND substring(start_time, 12, 8) BETWEEN '06:00:00' AND '18:00:00' GROUP BY 1, 2"""


def e19_context(spark, d):
    o = _objects(spark, d)
    attrs = o.where("color IS NOT NULL").select("global_id", F.lit("color").alias("type"), F.col("color").alias("value"), F.lit(1.0).alias("confidence"), F.lit(True).alias("winner"), F.lit(False).alias("uncertain"))
    e = _events(spark, d).withColumns({"end_time": F.col("start_time"), "confidence": F.lit(1.0)})
    involves = e.select("event_id", "global_id", F.lit("subject").alias("role"))
    seen = table(spark, d, "orders").select(F.col("o_custkey").alias("global_id"), F.date_format("o_orderdate", "yyyy").alias("clip_id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("first_seen"))
    c = g.context(o, attrs, involves, e.drop("global_id"), seen)
    size = lambda x: F.coalesce(F.when(F.col(x).isNotNull(), F.size(x)), F.lit(0))
    return c.select("global_id", size("attributes").alias("n_attributes"), size("events").alias("n_events"), size("clips").alias("n_clips"), "earliest", F.col("events")[0]["start_time"].alias("first_event"))


E19 = f"""WITH {_OBJ}, {_EV}, e AS (SELECT global_id, least(count(*), 5) AS n, min(start_time) AS f FROM ev GROUP BY 1), s AS (SELECT o_custkey AS global_id, count(DISTINCT year(o_orderdate)) AS n, strftime(min(o_orderdate), '%Y-%m-%dT%H:%M:%S') AS f FROM orders GROUP BY 1)
SELECT global_id, CASE WHEN color IS NULL THEN 0 ELSE 1 END AS n_attributes, CAST(coalesce(e.n, 0) AS INTEGER) AS n_events, CAST(coalesce(s.n, 0) AS INTEGER) AS n_clips, s.f AS earliest, e.f AS first_event FROM objects LEFT JOIN e USING (global_id) LEFT JOIN s USING (global_id)"""


def b4_merge_edges(spark, d):
    """Upsert: the last order per customer and priority stays."""
    o = table(spark, d, "orders").withColumn("_k", F.struct("o_orderdate", "o_orderkey"))
    return g.merge_edges(o, ["o_custkey", "o_orderpriority"], "_k").select("o_custkey", "o_orderpriority", "o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"))


B4 = "SELECT o_custkey, o_orderpriority, o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1"


def k8_set_operations(spark, d):
    """Union, intersection and difference of suppliers and customers by nation."""
    a = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("k"))
    b = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("k"))
    parts = [("union", a.union(b).distinct()), ("intersect", a.intersect(b)), ("except", a.subtract(b)), ("union_all", a.unionByName(b))]
    out = None
    for name, df in parts:
        one = df.groupBy("k").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("operation"), "k", "n")
        out = one if out is None else out.unionByName(one)
    return out


K8 = """WITH a AS (SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 0), b AS (SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 0)
SELECT 'union' AS operation, k, 1::BIGINT AS n FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'intersect', k, 1 FROM (SELECT k FROM a INTERSECT SELECT k FROM b)
UNION ALL SELECT 'except', k, 1 FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'union_all', k, count(*) FROM (SELECT k FROM a UNION ALL SELECT k FROM b) GROUP BY k"""

QUERIES = {
    "q1_attribute_filter": (q1_attribute_filter, Q1), "q2_seen_before": (q2_seen_before, Q2), "q3_timeline": (q3_timeline, Q3), "q5_who_whom": (q5_who_whom, Q5),
    "q6_event_filter": (q6_event_filter, Q6), "q8_counts": (q8_counts, Q8), "q9_cross_clip": (q9_cross_clip, Q9), "e15_subject_of_all": (e15_subject_of_all, E15),
    "e18_event_participants": (e18_event_participants, E18), "e19_context": (e19_context, E19), "b4_merge_edges": (b4_merge_edges, B4), "k8_set_operations": (k8_set_operations, K8),
}
