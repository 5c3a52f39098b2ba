"""Detections, frames and plug-in models over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import table
from ..operators import detections as de
from ..operators import inference as nf
from ..operators import tracking as tk
from ..session import scratch
from ..sources import frames as fr


def d1_suppress(spark, d):
    """Boxes by quantity and discount; return flags are classes, the tax is the
    confidence."""
    x, y = F.rint("l_quantity"), F.rint(F.col("l_discount") * 100)
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("frame"), F.col("l_returnflag").alias("class"), (F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("id"), F.rint(F.col("l_tax") * 100).alias("confidence"), (x * 7 % 200).alias("x1"), (y * 3).alias("y1"), (x * 7 % 200 + 20 + y).alias("x2"), (y * 3 + 12).alias("y2"))
    rows = rows.groupBy("frame", "class", "id").agg(*[F.max(c).alias(c) for c in ("confidence", "x1", "y1", "x2", "y2")])
    boxes = de.admitted(rows, ("A", "N"), least=1)
    return de.suppress(boxes, ["frame", "class"], threshold=0.5).select("frame", "class", "id", "kept")


D1 = """WITH RECURSIVE r AS (SELECT l_suppkey AS frame, l_returnflag AS class, l_orderkey * 1000 + l_linenumber AS id, round(l_tax * 100) AS confidence, round(l_quantity) * 7 % 200 AS x, round(l_discount * 100) AS y FROM lineitem),
g AS (SELECT frame, class, id, max(confidence) AS confidence, max(x) AS x1, max(y * 3) AS y1, max(x + 20 + y) AS x2, max(y * 3 + 12) AS y2 FROM r GROUP BY 1, 2, 3),
o AS (SELECT *, row_number() OVER (PARTITION BY frame, class ORDER BY confidence DESC, id) AS n FROM g WHERE class IN ('A', 'N') AND confidence >= 1),
s AS (SELECT frame, class, n, [{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}] AS kept, id, true AS ok FROM o WHERE n = 1
 UNION ALL SELECT o.frame, o.class, o.n, CASE WHEN f.free THEN list_append(s.kept, {'x1': o.x1, 'y1': o.y1, 'x2': o.x2, 'y2': o.y2}) ELSE s.kept END, o.id, f.free FROM s JOIN o ON o.frame = s.frame AND o.class = s.class AND o.n = s.n + 1,
 LATERAL (SELECT len(list_filter(s.kept, lambda k: greatest(0.0, least(k.x2, o.x2) - greatest(k.x1, o.x1)) * greatest(0.0, least(k.y2, o.y2) - greatest(k.y1, o.y1))
   / ((k.x2 - k.x1) * (k.y2 - k.y1) + (o.x2 - o.x1) * (o.y2 - o.y1) - greatest(0.0, least(k.x2, o.x2) - greatest(k.x1, o.x1)) * greatest(0.0, least(k.y2, o.y2) - greatest(k.y1, o.y1))) > 0.5)) = 0 AS free) f)
SELECT frame, class, id, ok AS kept FROM s"""


def _videos(spark, d):
    """A customer as a video: length, frame rate and start by its key."""
    k = F.col("c_custkey")
    fps = F.element_at(F.array(F.lit(12.5), F.lit(25.0), F.lit(10.0)), (k % 3 + 1).cast("int"))
    return table(spark, d, "customer").select(k.alias("video_id"), (k % 700).alias("n_frames"), fps.alias("fps"), F.timestamp_seconds(k * 1000 + 1_700_000_000).alias("start"))


_VIDEOS = "v AS (SELECT c_custkey AS video_id, c_custkey % 700 AS n, [12.5, 25.0, 10.0][c_custkey % 3 + 1] AS fps, c_custkey * 1000 + 1700000000 AS s FROM customer)"


def c3_frame_index(spark, d):
    """Sampled frames of every video, with their wall clocks."""
    f = fr.frame_index(_videos(spark, d), clip_seconds=10.0)
    return f.select("video_id", "clip_id", "frame_id", F.round("t", 4).alias("t"), F.unix_micros("wallclock").alias("wallclock_us"))


C3 = f"""WITH {_VIDEOS}, f AS (SELECT video_id, fps, s, unnest(range(0, n, greatest(1, CAST(round_even(0.5 * fps, 0) AS BIGINT)))) AS i FROM v)
SELECT video_id, 'clip_' || lpad(CAST(i // CAST(10 * fps AS BIGINT) AS VARCHAR), 3, '0') AS clip_id, 'frame_' || lpad(CAST(i AS VARCHAR), 6, '0') AS frame_id, round(i / fps, 4) AS t, CAST(s * 1000000 + round(i / fps * 1000000) AS BIGINT) AS wallclock_us FROM f"""


def w14_clip_manifest(spark, d):
    m = fr.clip_manifest(_videos(spark, d), clip_seconds=10.0)
    return m.select("video_id", "clip_id", "first", "last", F.unix_micros("start_wallclock").alias("start_us"), F.unix_micros("end_wallclock").alias("end_us"))


W14M = f"""WITH {_VIDEOS}, c AS (SELECT *, CAST(10 * fps AS BIGINT) AS clip FROM v WHERE n > 0), e AS (SELECT *, unnest(range(0, (n - 1) // clip + 1)) AS no FROM c), b AS (SELECT *, no * clip AS first, least((no + 1) * clip, n) - 1 AS last FROM e)
SELECT video_id, 'clip_' || lpad(CAST(no AS VARCHAR), 3, '0') AS clip_id, first, last, CAST(s * 1000000 + round(first / fps * 1000000) AS BIGINT) AS start_us, CAST(s * 1000000 + round(last / fps * 1000000) AS BIGINT) AS end_us FROM b"""


def _reader():
    """Stands for a captioning model: says a name backwards."""
    return lambda contents: [c[::-1] for c in contents]


def u4_cached_answers(spark, d):
    """Names of parts through a model, a second run from the cache."""
    cache = scratch(spark, "answers")
    parts = table(spark, d, "part").select("p_partkey", "p_name")
    nf.cached_answers(parts.where("p_partkey % 2 = 0"), "reader-1", _reader, cache, content="p_name")
    return nf.cached_answers(parts, "reader-1", _reader, cache, content="p_name").select("p_partkey", "answer", "error")


U4 = "SELECT p_partkey, reverse(p_name) AS answer, CAST(NULL AS VARCHAR) AS error FROM part"


def u2_follow(spark, d):
    """Lines as boxes that move with the day in their supplier's video."""
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1992-01-01").cast("date"))
    x = F.rint(F.col("l_quantity")) * 4 + (day % 30) * 2
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("video_id"), F.floor(day / 365).alias("clip_id"), day.alias("frame_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_discount") * 10).cast("double").alias("confidence"), x.alias("x1"), F.lit(0.0).alias("y1"), (x + 60).alias("x2"), F.lit(40.0).alias("y2"))
    return tk.follow(li.select("video_id", "clip_id", "frame_id"), li).select("video_id", "clip_id", "frame_id", "id", "track")


QUERIES = {
    "d1_suppress": (d1_suppress, D1), "c3_frame_index": (c3_frame_index, C3), "w14_clip_manifest": (w14_clip_manifest, W14M),
    "u4_cached_answers": (u4_cached_answers, U4), "u2_follow": (u2_follow, None),
}
