"""The graph build: nations as videos, customers as objects, years as clips,
order days as frames, user events as events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import table
from ..plans import payload as p


def _payload(spark, d):
    c = table(spark, d, "customer").select(F.concat(F.lit("v"), "c_nationkey").alias("video_id"), F.col("c_custkey").cast("string").alias("global_id"), F.lower("c_mktsegment").alias("class"), "c_acctbal", "c_custkey")
    o = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    o = o.select("video_id", F.date_format("o_orderdate", "yyyy").alias("clip_id"), F.col("global_id").alias("track_id"), "global_id", day.alias("frame_id"), "o_orderpriority", "o_orderkey")
    key = ["video_id", "global_id"]
    sightings = o.groupBy(*key, "clip_id", "track_id").agg(F.min("frame_id").alias("first_seen"), F.max("frame_id").alias("last_seen"))
    share = o.groupBy(*key, F.lit("make").alias("attribute"), F.col("o_orderpriority").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = o.groupBy(*key).agg(F.count(F.lit(1)).alias("total"))
    share = share.join(total, key).select(*key, "attribute", "value", (F.col("n") / F.col("total")).alias("share"))
    color = c.where("c_acctbal >= 0").select(*key, F.lit("color").alias("attribute"), F.col("class").alias("value"), F.lit(0.9).alias("confidence"))
    make = c.where("c_custkey % 2 = 0").select(*key, F.lit("make").alias("attribute"), F.lit("1-URGENT").alias("value"), F.lit(0.5).alias("confidence"))
    final = color.unionByName(make).withColumns({"source": F.lit("m8"), "uncertain": F.col("confidence") < 0.6})
    least = c.groupBy("video_id").agg(F.min("c_custkey").cast("string").alias("other"))
    first = o.groupBy(*key).agg(F.min("frame_id").alias("first"))
    e = table(spark, d, "events").join(c, F.col("user_id") == F.col("c_custkey")).join(least, "video_id").join(first, key, "left")
    kind = F.element_at(F.array(*[F.lit(t) for t in ("OVERTAKE", "CROSSES", "STOP", "PARK", "APPEAR")]), (F.col("event_id") % 5 + 1).cast("int"))
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    region = F.when((F.col("type") == "CROSSES") & (F.col("event_id") % 3 != 0), F.create_map(F.lit("region_id"), F.concat(F.lit("r"), F.col("event_id") % 7)))
    e = e.withColumn("type", kind).select("video_id", "event_id", "type", F.col("global_id").alias("subject_id"), F.when((F.col("type") == "OVERTAKE") & (F.col("event_id") % 3 != 0), F.col("other")).alias("object_id"), at.alias("start_time"), at.alias("end_time"), F.lit(0.75).alias("confidence"), F.array_compact(F.array("first")).alias("evidence_frames"), region.alias("metadata"))
    videos = c.select("video_id").distinct()
    regions = videos.select("video_id", F.explode(F.expr("transform(sequence(0, 6), i -> 'r' || i)")).alias("region_id"), F.lit("polygon").alias("region_type"))
    samples = o.select("video_id", "clip_id", "track_id", "frame_id", F.array(F.col("o_orderkey").cast("double")).alias("bbox"))
    return p.graph_payload(videos, o.select("video_id", "clip_id").distinct(), o.select("video_id", "clip_id", "frame_id").distinct(), c.select(*key, "class"), sightings, samples, e, regions, final=final, shares=share)


def q21_payload(spark, d):
    """Every node and edge of every table of the build, in one shape."""
    t = _payload(spark, d)
    none = F.lit(None).cast("string")
    shape = {
        "video": ("video_id", none, none, None),
        "clips": ("uid", F.col("video_id"), none, None),
        "frames": ("uid", F.col("clip_uid"), none, None),
        "objects": ("uid", F.col("video_id"), F.concat_ws("|", "label", "color", "color_source", "make", F.col("make_uncertain").cast("string"), "first_seen", "last_seen"), "n_sightings"),
        "attribute_edges": ("object_uid", F.col("key"), F.concat_ws("|", "source", F.col("winner").cast("string"), F.col("uncertain").cast("string")), "share"),
        "clip_sightings": ("object_uid", F.col("clip_uid"), F.concat_ws("|", "track_id", "first_seen", "last_seen"), None),
        "frame_sightings": ("object_uid", F.col("frame_uid"), none, F.col("bbox")[0]),
        "locations": ("uid", F.col("video_id"), F.col("region_type"), None),
        "events": ("uid", F.col("meta_region_id"), F.col("type"), "confidence"),
        "event_roles": ("event_uid", F.col("object_uid"), F.col("role"), None),
        "shortcut_edges": ("from_uid", F.col("to_uid"), F.concat_ws("|", "rel", "to_kind", F.col("event_id").cast("string"), "at"), "confidence"),
        "moved_to": ("object_uid", F.col("location_uid"), none, "order"),
    }
    out = None
    for name, (a, b, label, value) in shape.items():
        value = F.lit(None) if value is None else F.col(value) if isinstance(value, str) else value
        one = t[name].select(F.lit(name).alias("part"), F.col(a).alias("from_uid"), b.alias("to_uid"), label.alias("label"), value.cast("double").alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


_BASE = """c AS (SELECT 'v' || c_nationkey AS v, CAST(c_custkey AS VARCHAR) AS g, lower(c_mktsegment) AS class, c_acctbal, c_custkey FROM customer),
o AS (SELECT v, g, v || ':' || g AS u, strftime(o_orderdate, '%Y') AS clip, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority AS pr, o_orderkey FROM orders JOIN c ON o_custkey = c_custkey),
s AS (SELECT v, g, u, clip, min(day) AS a, max(day) AS z FROM o GROUP BY ALL),
e AS (SELECT v, event_id, v || ':' || event_id AS eu, v || ':' || g AS u, ['OVERTAKE', 'CROSSES', 'STOP', 'PARK', 'APPEAR'][event_id % 5 + 1] AS type, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS began,
  CASE WHEN event_id % 5 = 0 AND event_id % 3 <> 0 THEN other END AS ob, CASE WHEN event_id % 5 = 1 AND event_id % 3 <> 0 THEN 'r' || (event_id % 7) END AS r, first
  FROM events JOIN c ON user_id = c_custkey JOIN (SELECT v, CAST(min(c_custkey) AS VARCHAR) AS other FROM c GROUP BY v) USING (v) LEFT JOIN (SELECT v, g, min(day) AS first FROM o GROUP BY ALL) USING (v, g)),
sh AS (SELECT u, pr, count(*) / sum(count(*)) OVER (PARTITION BY u) AS share FROM o GROUP BY u, pr),
urgent AS (SELECT v || ':' || g AS u FROM c WHERE c_custkey % 2 = 0),
mv AS (SELECT v, u, r, began, event_id FROM (SELECT *, lag(r) OVER (PARTITION BY u ORDER BY began, r, event_id) AS l FROM e WHERE r IS NOT NULL) WHERE l IS NULL OR l <> r)"""

Q21 = f"""WITH {_BASE}
SELECT DISTINCT 'video' AS part, v AS from_uid, CAST(NULL AS VARCHAR) AS to_uid, CAST(NULL AS VARCHAR) AS label, CAST(NULL AS DOUBLE) AS value FROM c
UNION ALL SELECT DISTINCT 'clips', v || ':' || clip, v, NULL, NULL FROM o
UNION ALL SELECT DISTINCT 'frames', v || ':' || day, v || ':' || clip, NULL, NULL FROM o
UNION ALL SELECT 'objects', v || ':' || g, v, concat_ws('|', 'Vehicle', CASE WHEN c_acctbal >= 0 THEN class END, CASE WHEN c_acctbal >= 0 THEN 'm8' ELSE 'unconfirmed' END, CASE WHEN c_custkey % 2 = 0 THEN '1-URGENT' END, 'true', a, z), coalesce(n, 0)
  FROM c LEFT JOIN (SELECT v, g, min(a) AS a, max(z) AS z, count(*) AS n FROM s GROUP BY ALL) USING (v, g)
UNION ALL SELECT 'attribute_edges', v || ':' || g, 'color:' || class, 'm8|true|false', 1.0 FROM c WHERE c_acctbal >= 0
UNION ALL SELECT 'attribute_edges', coalesce(sh.u, w.u), 'make:' || coalesce(pr, '1-URGENT'), CASE WHEN w.u IS NULL THEN 'clip_voting|false|true' ELSE 'm8|true|true' END,
  round(coalesce(share, CASE WHEN w.u IN (SELECT u FROM o) THEN 0.0 ELSE 1.0 END), 6) FROM sh FULL JOIN (SELECT u, '1-URGENT' AS pr FROM urgent) w USING (u, pr)
UNION ALL SELECT 'clip_sightings', u, v || ':' || clip, g || '|' || a || '|' || z, NULL FROM s
UNION ALL SELECT 'frame_sightings', u, v || ':' || day, NULL, o_orderkey FROM o
UNION ALL SELECT 'locations', v || ':r' || i, v, 'polygon', NULL FROM (SELECT DISTINCT v FROM c), range(7) t(i)
UNION ALL SELECT 'events', eu, r, type, 0.75 FROM e
UNION ALL SELECT 'event_roles', eu, u, 'subject', NULL FROM e
UNION ALL SELECT 'event_roles', eu, v || ':' || ob, 'object', NULL FROM e WHERE ob IS NOT NULL
UNION ALL SELECT 'shortcut_edges', u, v || ':' || ob, 'OVERTAKES|object|' || event_id || '|' || began, 0.75 FROM e WHERE ob IS NOT NULL
UNION ALL SELECT 'shortcut_edges', u, v || ':' || r, 'CROSSES|location|' || event_id || '|' || began, 0.75 FROM e WHERE r IS NOT NULL
UNION ALL SELECT 'shortcut_edges', u, v || ':' || first, CASE type WHEN 'STOP' THEN 'STOPS_AT' WHEN 'PARK' THEN 'PARKED_AT' ELSE 'OVERTAKES' END || '|frame|' || event_id || '|' || began, 0.75 FROM e
  WHERE first IS NOT NULL AND (type IN ('STOP', 'PARK') OR type = 'OVERTAKE' AND ob IS NULL)
UNION ALL SELECT 'moved_to', u, v || ':' || r, NULL, row_number() OVER (PARTITION BY u ORDER BY began, r, event_id) FROM mv"""


def f20_payload_counts(spark, d):
    return p.counts(_payload(spark, d)).select("video_id", F.col("table").alias("part"), "n")


F20 = f"SELECT CASE WHEN part = 'video' THEN from_uid ELSE split_part(from_uid, ':', 1) END AS video_id, part, count(*) AS n FROM ({Q21}) GROUP BY ALL"

QUERIES = {"q21_payload": (q21_payload, Q21), "f20_payload_counts": (f20_payload_counts, F20)}
