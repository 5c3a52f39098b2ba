"""Pairs of tracks across clips, stitched trajectories, chains of linked tracks and numbered event logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..adapters import table
from ..config import Linking
from ..operators import events as ev
from ..operators import linking as ln
from ..operators import trajectory as tr


def _day(c):
    return F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date"))


def w1_stitch(spark, d):
    """A customer's year is a track, its orders the samples; tracks of
    customers with the same remainder by 50 are one object's sightings."""
    w = Window.partitionBy("o_custkey", "year").orderBy("o_orderdate", "o_orderkey")
    samples = table(spark, d, "orders").withColumn("year", F.year("o_orderdate")).select("o_custkey", "year", _day("o_orderdate").alias("t"), F.row_number().over(w).alias("pos"), "o_orderkey")
    tracks = samples.groupBy("o_custkey", "year").agg(F.min("t").alias("first")).withColumn("obj", F.col("o_custkey") % 50)
    seen = tracks.withColumn("sighting_no", F.row_number().over(Window.partitionBy("obj").orderBy("first", "o_custkey"))).drop("first")
    return tr.stitch(seen, samples, ["o_custkey", "year"], ["obj"]).select("obj", "pos", "t", "sighting_no", "o_orderkey")


W1 = """WITH s AS (SELECT o_custkey, year(o_orderdate) AS y, CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS t, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate, o_orderkey) AS pos, o_orderkey FROM orders),
k AS (SELECT o_custkey, y, o_custkey % 50 AS obj, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY min(t), o_custkey) AS sighting_no FROM s GROUP BY o_custkey, y)
SELECT obj, (row_number() OVER (PARTITION BY obj ORDER BY t, sighting_no, pos) - 1)::INTEGER AS pos, t, sighting_no::INTEGER AS sighting_no, o_orderkey FROM s JOIN k USING (o_custkey, y)"""


def w7_numbered_events(spark, d):
    """Events of a user as the event log of a video."""
    e = table(spark, d, "events").select("user_id", F.col("ts").alias("start_time"), F.col("event_type").alias("type"), F.col("user_id").cast("string").alias("subject_id"), F.nullif(F.regexp_extract("props", r"(\d+)", 1), F.lit("")).alias("object_id"))
    return ev.number_events(e, scope=["user_id"]).select("user_id", "type", "object_id", "event_id")


W7 = r"""WITH e AS (SELECT user_id, ts, event_type AS type, nullif(regexp_extract(props, '(\d+)', 1), '') AS object_id FROM events)
SELECT user_id, type, object_id, printf('evt_%05d', row_number() OVER (PARTITION BY user_id ORDER BY ts, type, coalesce(object_id, ''))) AS event_id FROM e"""


def w11_global_ids(spark, d):
    """A customer's years as tracks, linked from year to year but where the sum
    of both is divisible by three; twenty videos."""
    o = table(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("clip_no")).agg(F.min(_day("o_orderdate")).alias("t_first"))
    name = lambda y: F.concat_ws("_", F.col("o_custkey").cast("string"), y.cast("string"))
    tracks = o.select((F.col("o_custkey") % 20).alias("video_id"), name(F.col("clip_no")).alias("track"), "clip_no", "t_first", "o_custkey")
    after = tracks.select("video_id", F.col("track").alias("b"), "o_custkey", (F.col("clip_no") - 1).alias("clip_no"))
    links = tracks.join(after, ["video_id", "o_custkey", "clip_no"]).where((F.col("o_custkey") + F.col("clip_no")) % 3 != 0).select("video_id", F.col("track").alias("a"), "b")
    return ln.global_ids(tracks.drop("o_custkey"), links)


W11 = """WITH t AS (SELECT o_custkey % 20 AS video_id, o_custkey AS c, year(o_orderdate) AS y, min(CAST(o_orderdate AS DATE) - DATE '1970-01-01') AS t FROM orders GROUP BY 1, 2, 3),
m AS (SELECT *, CASE WHEN lag(y) OVER w = y - 1 AND (c + y - 1) % 3 <> 0 THEN 0 ELSE 1 END AS starts FROM t WINDOW w AS (PARTITION BY c ORDER BY y)),
i AS (SELECT *, sum(starts) OVER (PARTITION BY c ORDER BY y) AS part FROM m),
f AS (SELECT video_id, c, part, arg_min(t, y) AS t, min(y) AS y FROM i GROUP BY 1, 2, 3),
g AS (SELECT *, printf('obj_%04d', row_number() OVER (PARTITION BY video_id ORDER BY t, y, c::VARCHAR || '_' || y::VARCHAR)) AS global_id FROM f)
SELECT i.video_id, i.c::VARCHAR || '_' || i.y::VARCHAR AS track, global_id FROM i JOIN g ON i.c = g.c AND i.part = g.part"""

_LINKING = Linking(max_gap=200.0)


def e4_clip_pairs(spark, d):
    """Ten customers are a video, years its clips, a customer's year a track."""
    n, price = F.count(F.lit(1)), F.col("o_totalprice")
    t = table(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("clip_no")).agg(
        F.min("o_orderpriority").alias("class"), F.min(_day("o_orderdate")).alias("t_first"), F.max(_day("o_orderdate")).alias("t_last"),
        (F.min(price) / 1000).alias("x_first"), (F.max(price) / 1000).alias("x_last"), n.cast("double").alias("y_first"), F.array(F.min(price) / 100000, F.max(price) / 100000, F.lit(1.0)).alias("embedding"),
        F.when(n >= 2, F.min("o_orderstatus")).alias("color"), F.when(n != 3, F.max("o_orderstatus")).alias("make"),
    )
    tracks = t.withColumns({"video_id": F.floor(F.col("o_custkey") / 10), "track": F.concat_ws("_", F.col("o_custkey").cast("string"), F.col("clip_no").cast("string")), "y_last": F.col("y_first"), "exit_vx": F.lit(1.0), "exit_vy": F.lit(-0.5), "diag": F.lit(100.0)})
    pairs = ln.clip_pairs(tracks, _LINKING, attributes=("color", "make"))
    return pairs.select("video_id", "clip_no", "a", "b", "gap", F.round("motion_error", 6).alias("motion_error"), F.round("cosine", 6).alias("cosine"), "semantic", "failed_gate", F.round("score", 6).alias("score"))


E4 = f"""WITH t AS (SELECT o_custkey, year(o_orderdate) AS y, o_custkey // 10 AS video_id, min(o_orderpriority) AS class, min(CAST(o_orderdate AS DATE) - DATE '1970-01-01') AS tf, max(CAST(o_orderdate AS DATE) - DATE '1970-01-01') AS tl,
  min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*)::DOUBLE AS n, CASE WHEN count(*) >= 2 THEN min(o_orderstatus) END AS color, CASE WHEN count(*) <> 3 THEN max(o_orderstatus) END AS make FROM orders GROUP BY 1, 2),
p AS (SELECT a.video_id, a.y AS clip_no, a.o_custkey::VARCHAR || '_' || a.y::VARCHAR AS a, b.o_custkey::VARCHAR || '_' || b.y::VARCHAR AS b, b.tf - a.tl AS gap, a.class <> b.class AS other,
  sqrt(power(a.hi / 1000 + (b.tf - a.tl) - b.lo / 1000, 2) + power(a.n - 0.5 * (b.tf - a.tl) - b.n, 2)) / 100 AS err,
  (a.lo / 100000 * (b.lo / 100000) + a.hi / 100000 * (b.hi / 100000) + 1) / (sqrt(power(a.lo / 100000, 2) + power(a.hi / 100000, 2) + 1) * sqrt(power(b.lo / 100000, 2) + power(b.hi / 100000, 2) + 1)) AS cos,
  (a.color IS NOT NULL AND b.color IS NOT NULL)::INTEGER + (a.make IS NOT NULL AND b.make IS NOT NULL)::INTEGER AS comparable, coalesce(a.color = b.color, false)::INTEGER + coalesce(a.make = b.make, false)::INTEGER AS agreed
  FROM t a JOIN t b ON a.video_id = b.video_id AND b.y = a.y + 1),
g AS (SELECT *, CASE WHEN other THEN 'class' WHEN agreed < comparable THEN 'semantic' WHEN gap <= 0 OR gap > {_LINKING.max_gap} OR err > {_LINKING.max_error} THEN 'motion' WHEN cos < {_LINKING.min_cosine} THEN 'appearance' END AS failed_gate, CASE WHEN comparable = 0 THEN 1.0 ELSE agreed / comparable END::DOUBLE AS semantic FROM p)
SELECT video_id, clip_no::INTEGER AS clip_no, a, b, gap::INTEGER AS gap, round(err, 6) AS motion_error, round(cos, 6) AS cosine, semantic, failed_gate, CASE WHEN failed_gate IS NULL THEN round(0.4 * cos + 0.3 / (1 + err) + 0.3 * semantic, 6) END AS score FROM g"""

QUERIES = {
    "e4_clip_pairs": (e4_clip_pairs, E4),
    "w1_stitch": (w1_stitch, W1),
    "w7_numbered_events": (w7_numbered_events, W7),
    "w11_global_ids": (w11_global_ids, W11),
}
