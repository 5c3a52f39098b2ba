"""Sentences and metadata of customers as objects and user events as events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import table
from ..plans import documents as doc
from ..plans import graph as g

TYPES = [*doc.EVENT_TYPES, "NEAR_MISS"]


def _objects(spark, d):
    """Every fourth customer lacks orders' times, every third a make."""
    c = table(spark, d, "customer")
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(*[f("o_orderdate").alias(n) for f, n in ((F.min, "f"), (F.max, "l"))], F.count_distinct(F.year("o_orderdate")).alias("n_clips"))
    k = F.col("c_custkey")
    iso = "yyyy-MM-dd'T'HH:mm:ss"
    return c.join(o, "c_custkey", "left").select(
        k.alias("global_id"), F.lower("c_mktsegment").alias("class"), F.when(k % 2 == 0, F.element_at(F.array(*map(F.lit, ("red", "blue", "orange"))), (k % 3 + 1).cast("int"))).alias("color"),
        F.when(k % 3 == 0, F.lit("ford")).alias("make"), F.when(k % 5 == 0, F.lit("suv")).alias("vehicle_type"), F.when(k % 7 == 0, F.lit("east")).alias("direction"),
        F.date_format("f", iso).alias("first_seen"), F.date_format("l", iso).alias("last_seen"), F.coalesce("n_clips", F.lit(0)).alias("n_clips"))


def _events(spark, d):
    """Event 7n + 6 has no phrase; every fourth overtake has no object."""
    e, i = table(spark, d, "events"), F.col("event_id")
    iso = "yyyy-MM-dd'T'HH:mm:ss"
    return e.select(
        i, F.element_at(F.array(*map(F.lit, TYPES)), (i % 7 + 1).cast("int")).alias("type"), F.col("user_id").alias("subject_id"), F.when((i % 7 == 3) & (i % 4 != 0), F.col("user_id") + i % 5).alias("object_id"),
        F.date_format("ts", iso).alias("start_time"), F.date_format(F.expr("ts + INTERVAL 90 SECONDS"), iso).alias("end_time"), F.col("value").alias("confidence"), F.when(i % 3 == 0, F.col("event_type")).alias("detail"))


_LIST = "[" + ", ".join(f"'{t}'" for t in TYPES) + "]"
_BASE = f"""obj AS (SELECT c_custkey AS global_id, lower(c_mktsegment) AS class, CASE WHEN c_custkey % 2 = 0 THEN ['red', 'blue', 'orange'][c_custkey % 3 + 1] END AS color, CASE WHEN c_custkey % 3 = 0 THEN 'ford' END AS make,
  CASE WHEN c_custkey % 5 = 0 THEN 'suv' END AS vehicle_type, CASE WHEN c_custkey % 7 = 0 THEN 'east' END AS direction, strftime(f, '%Y-%m-%dT%H:%M:%S') AS first_seen, strftime(l, '%Y-%m-%dT%H:%M:%S') AS last_seen, coalesce(n, 0) AS n_clips
  FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS f, max(o_orderdate) AS l, count(DISTINCT year(o_orderdate)) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey),
dsc AS (SELECT global_id, concat_ws(' ', upper(color[1]) || color[2:], upper(make[1]) || make[2:], coalesce(vehicle_type, class)) AS d FROM obj),
ev AS (SELECT event_id, {_LIST}[event_id % 7 + 1] AS type, user_id AS subject_id, CASE WHEN event_id % 7 = 3 AND event_id % 4 <> 0 THEN user_id + event_id % 5 END AS object_id,
  strftime(ts, '%Y-%m-%dT%H:%M:%S') AS start_time, strftime(ts + INTERVAL 90 SECOND, '%Y-%m-%dT%H:%M:%S') AS end_time, value AS confidence, CASE WHEN event_id % 3 = 0 THEN event_type END AS detail FROM events)"""
_TOLD = """named AS (SELECT ev.*, s.d AS sd, o.d AS od FROM ev LEFT JOIN dsc s ON s.global_id = subject_id LEFT JOIN dsc o ON o.global_id = object_id),
phr AS (SELECT *, strftime(CAST(start_time AS TIMESTAMP), '%H:%M:%S') AS clk, CASE type WHEN 'OVERTAKE' THEN 'overtook ' || CASE WHEN regexp_matches(coalesce(od, 'another vehicle'), '^[aeiouAEIOU]') THEN 'an ' ELSE 'a ' END || lower(coalesce(od, 'another vehicle'))
  WHEN 'STOP' THEN 'stopped' WHEN 'PARK' THEN 'parked' WHEN 'TURN' THEN 'turned' || coalesce(' ' || detail, '') WHEN 'LANE_CHANGE' THEN 'changed lanes' WHEN 'CROSSES' THEN 'crossed ' || coalesce(detail, 'a marked line') END AS phrase FROM named)"""


def h14_event_summary(spark, d):
    return doc.event_summaries(_events(spark, d), _objects(spark, d))


H14E = f"WITH {_BASE}, {_TOLD} SELECT event_id, coalesce(sd, 'A vehicle') || ' ' || coalesce(phrase, 'was involved in a ' || lower(type) || ' event') || ' at ' || clk || '.' AS document FROM phr"


def h14_object_summary(spark, d):
    return doc.object_summaries(_objects(spark, d), _events(spark, d))


H14O = f"""WITH {_BASE}, {_TOLD}, part AS (SELECT subject_id AS global_id, start_time, event_id, phrase, clk FROM phr
 UNION ALL SELECT object_id, start_time, event_id, CASE WHEN type = 'OVERTAKE' THEN 'was overtaken by ' || CASE WHEN regexp_matches(coalesce(sd, 'another vehicle'), '^[aeiouAEIOU]') THEN 'an ' ELSE 'a ' END || lower(coalesce(sd, 'another vehicle')) END, clk FROM phr WHERE object_id IS NOT NULL AND object_id <> subject_id),
told AS (SELECT global_id, string_agg(phrase || ' at ' || clk, ', ' ORDER BY start_time, event_id) AS told FROM part GROUP BY 1)
SELECT obj.global_id, concat_ws(', ', d, CASE WHEN first_seen IS NULL THEN NULL WHEN told.global_id IS NULL AND last_seen <> first_seen THEN 'seen from ' || substring(first_seen, 12) || ' to ' || substring(last_seen, 12)
 ELSE 'first seen ' || substring(first_seen, 12) || coalesce(' heading ' || direction, '') END, told) || '.' AS document FROM obj JOIN dsc USING (global_id) LEFT JOIN told ON told.global_id = obj.global_id"""


def c14_object_metadata(spark, d):
    return doc.object_metadata(_objects(spark, d), _events(spark, d))


_FLAGS = ", ".join(f"EXISTS (SELECT 1 FROM ev WHERE subject_id = global_id AND type = '{t}') AS \"event_{t}\"" for t in doc.EVENT_TYPES)
C14 = f"""WITH {_BASE} SELECT global_id, class, coalesce(color, 'unknown') AS color, coalesce(make, 'unknown') AS make, coalesce(vehicle_type, 'unknown') AS vehicle_type, coalesce(direction, 'unknown') AS direction,
 coalesce(first_seen, '') AS first_seen, coalesce(last_seen, '') AS last_seen, n_clips, (SELECT count(*) FROM ev WHERE subject_id = global_id) + (SELECT count(*) FROM ev WHERE object_id = global_id AND object_id <> subject_id) AS n_events, {_FLAGS} FROM obj"""


def c15_event_metadata(spark, d):
    return doc.event_metadata(_events(spark, d), _objects(spark, d))


C15 = f"WITH {_BASE} SELECT event_id, type, subject_id, coalesce(CAST(object_id AS VARCHAR), '') AS object_id, coalesce(color, 'unknown') AS subject_color, coalesce(class, 'unknown') AS subject_class, start_time, end_time, confidence FROM ev LEFT JOIN obj ON global_id = subject_id"


def h15_count_answer(spark, d):
    """One sentence per direction."""
    o = _objects(spark, d).withColumn("direction", F.coalesce("direction", F.lit("any")))
    n = o.groupBy("direction", "class", F.coalesce("vehicle_type", F.lit("unknown")).alias("vehicle_type"), F.coalesce("color", F.lit("unknown")).alias("color")).agg(F.count(F.lit(1)).alias("n"))
    return doc.count_answer(n, ("direction",))


H15 = f"""WITH {_BASE}, n AS (SELECT coalesce(direction, 'any') AS direction, class, vehicle_type, color, count(*) AS n FROM obj GROUP BY ALL),
p AS (SELECT direction, n, concat_ws(' ', CAST(n AS VARCHAR), color, coalesce(vehicle_type, class) || CASE WHEN n = 1 THEN '' ELSE 's' END) AS part FROM n)
SELECT direction, CAST(sum(n) AS BIGINT) AS count, 'The footage contains ' || CAST(sum(n) AS BIGINT) || ' matching object' || CASE WHEN sum(n) = 1 THEN '' ELSE 's' END || ' in total: ' || string_agg(part, ', ' ORDER BY n DESC, part) || '.' AS answer FROM p GROUP BY direction"""


def h16_context(spark, d):
    o, e = _objects(spark, d), _events(spark, d)
    a = o.where("color IS NOT NULL").select("global_id", F.lit("color").alias("type"), F.col("color").alias("value"), F.lit(0.75).alias("confidence"), F.lit(True).alias("winner"), (F.col("global_id") % 4 == 0).alias("uncertain"))
    seen = o.where("first_seen IS NOT NULL").select("global_id", F.substring("first_seen", 1, 4).alias("clip_id"), "first_seen")
    involves = e.select("event_id", F.col("subject_id").alias("global_id"), F.lit("subject").alias("role"))
    rows = g.context(o.select("global_id", "class"), a, involves, e.select("event_id", "type", "start_time", "end_time", "confidence"), seen)
    return doc.context_blocks(rows).select("global_id", "block", F.array_join("valid_times", ",").alias("valid_times"))


H16 = f"""WITH {_BASE}, r AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY start_time, event_id) AS r FROM ev QUALIFY r <= 5),
l AS (SELECT subject_id AS k, string_agg('    event: ' || type || ' (as subject) [' || subject_id || ' @ ' || substring(start_time, 12) || '] to ' || substring(end_time, 12), chr(10) ORDER BY start_time, event_id) AS lines, list(substring(start_time, 12)) || list(substring(end_time, 12)) AS t FROM r GROUP BY 1)
SELECT global_id, concat_ws(chr(10), '- ' || global_id || ' (' || class || '):', CASE WHEN color IS NOT NULL AND global_id % 4 <> 0 THEN '    attributes: color=' || color || ' (confidence 0.75)' END, '    seen in clips: ' || first_seen[1:4],
 '    first seen: [' || global_id || ' @ ' || first_seen[12:] || ']', lines) AS block, array_to_string(list_sort(list_distinct(coalesce(t, []) || CASE WHEN first_seen IS NULL THEN [] ELSE [first_seen[12:]] END)), ',') AS valid_times FROM obj LEFT JOIN l ON k = global_id"""


def q18_spans(spark, d):
    """Each event's own time cited, or, for every third, one that is nobody's."""
    e = _events(spark, d)
    at = F.when(F.col("event_id") % 3 == 0, F.lit("00:00:00")).otherwise(F.substring("start_time", 12, 8))
    cited = e.select((F.col("event_id") % 50).alias("answer_id"), F.col("subject_id").alias("global_id"), at.alias("at"))
    return doc.timestamp_spans(cited, e.withColumn("global_id", F.col("subject_id")))


Q18 = f"""WITH {_BASE}, c AS (SELECT DISTINCT event_id % 50 AS answer_id, subject_id AS global_id, CASE WHEN event_id % 3 = 0 THEN '00:00:00' ELSE substring(start_time, 12) END AS clk FROM ev),
f AS (SELECT subject_id AS global_id, substring(start_time, 12) AS clk, arg_min(substring(end_time, 12), (start_time, event_id)) AS e FROM ev GROUP BY 1, 2)
SELECT answer_id, global_id, clk AS start, coalesce(e, clk) AS "end" FROM c LEFT JOIN f USING (global_id, clk)"""

QUERIES = {
    "h14_event_summary": (h14_event_summary, H14E), "h14_object_summary": (h14_object_summary, H14O), "c14_object_metadata": (c14_object_metadata, C14), "c15_event_metadata": (c15_event_metadata, C15),
    "h15_count_answer": (h15_count_answer, H15), "h16_context": (h16_context, H16), "q18_spans": (q18_spans, Q18),
}
