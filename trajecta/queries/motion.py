"""Trajectories and events over the driver's ``events`` and ``lineitem``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import SAMPLES_SQL, TRAJECTORIES_SQL, samples, table, trajectories
from ..config import Events
from ..functions.geometry import box, covered, iou, turn
from ..operators import events as ev
from ..operators import trajectory as tr
from ..session import scratch
from ..streaming import clips, live

#: Thresholds for user trajectories: hours and units of value.
CFG = Events(stop_speed=5.0, stop_seconds=6.0, moving_speed=0.5)
LINES = [("line_a", [(0.0, 50.0), (500.0, 50.0)]), ("poly_b", [(100.0, 20.0), (400.0, 20.0), (400.0, 80.0), (100.0, 80.0)])]



def c5_velocity(spark, d):
    return trajectories(spark, d).select("obj", "pos", *[F.round(c, 6).alias(c) for c in ("t", "vx", "vy", "speed", "heading")])


C5 = f"WITH {TRAJECTORIES_SQL} SELECT obj, pos, round(t, 6) AS t, round(vx, 6) AS vx, round(vy, 6) AS vy, round(speed, 6) AS speed, round(heading, 6) AS heading FROM traj"


def c8_track_summary(spark, d):
    s = tr.summaries(trajectories(spark, d), ["obj"], window=3, still=60000.0)
    return s.select("obj", "n", "stationary", *[F.round(c, 5).alias(c) for c in ("t_first", "t_last", "x_first", "y_first", "x_last", "y_last", "exit_vx", "exit_vy", "heading")])


C8 = f"""WITH {TRAJECTORIES_SQL}, late AS (
  SELECT *, row_number() OVER (PARTITION BY obj ORDER BY t DESC, pos DESC) AS r FROM traj), g AS (
  SELECT obj, count(*) AS n, min(t) AS t_first, max(t) AS t_last, arg_min(x, pos) AS x_first, arg_min(y, pos) AS y_first,
         arg_max(x, pos) AS x_last, arg_max(y, pos) AS y_last,
         coalesce(avg(vx) FILTER (WHERE r <= 3 AND pos > 0), 0.0) AS exit_vx, coalesce(avg(vy) FILTER (WHERE r <= 3 AND pos > 0), 0.0) AS exit_vy,
         var_pop(x) + var_pop(y) < 60000.0 AS stationary FROM late GROUP BY obj)
SELECT obj, n, stationary, round(t_first, 5) AS t_first, round(t_last, 5) AS t_last, round(x_first, 5) AS x_first, round(y_first, 5) AS y_first,
       round(x_last, 5) AS x_last, round(y_last, 5) AS y_last, round(exit_vx, 5) AS exit_vx, round(exit_vy, 5) AS exit_vy,
       CASE WHEN n >= 2 AND (x_last <> x_first OR y_last <> y_first) THEN round(degrees(atan2(y_last - y_first, x_last - x_first)), 5) END AS heading FROM g"""


def w2_stop_park(spark, d):
    e = ev.stops(trajectories(spark, d), CFG)
    return e.select("obj", "type", "start_pos", "end_pos", *[F.round(c, 5).alias(c) for c in ("start_t", "end_t", "duration", "confidence")])


_STOPS = f"""WITH {TRAJECTORIES_SQL}, marked AS (
  SELECT *, speed < 5.0 AS slow, max(pos) OVER (PARTITION BY obj) AS last_pos,
         CASE WHEN speed < 5.0 AND NOT coalesce(lag(speed < 5.0) OVER (PARTITION BY obj ORDER BY pos), false) THEN 1 ELSE 0 END AS opens FROM traj), runs AS (
  SELECT *, sum(opens) OVER (PARTITION BY obj ORDER BY pos) AS run FROM marked), g AS (
  SELECT obj, run, min(t) AS start_t, max(t) AS end_t, min(pos) AS start_pos, max(pos) AS end_pos, avg(speed) AS a, max(last_pos) AS last_pos
  FROM runs WHERE slow GROUP BY obj, run), stops AS (
  SELECT obj, CASE WHEN end_pos = last_pos THEN 'PARK' ELSE 'STOP' END AS type, start_pos, end_pos, start_t, end_t, end_t - start_t AS duration,
         (greatest(0, least(1, 1 - a / 5.0)) + greatest(0, least(1, (end_t - start_t) / 12.0))) / 2 AS confidence
  FROM g WHERE end_t - start_t >= 6.0)"""
W2 = _STOPS + " SELECT obj, type, start_pos, end_pos, round(start_t, 5) AS start_t, round(end_t, 5) AS end_t, round(duration, 5) AS duration, round(confidence, 5) AS confidence FROM stops"


def f9_event_counts(spark, d):
    return ev.stops(trajectories(spark, d), CFG).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("duration"), 3).alias("hours"))


F9 = _STOPS + " SELECT type, count(*) AS n, round(sum(duration), 3) AS hours FROM stops GROUP BY type"


def _jump(a, b):
    return F.abs(b["x"] - a["x"]) >= 100


def w3_greedy_windows(spark, d):
    """Non-overlapping windows of 6 h to 3 d in which the value moves by 100."""
    found = ev.candidate_windows(trajectories(spark, d), _jump, 6.0, 72.0, 0.5)
    return ev.thin(found)


_WINDOWS = f"""WITH RECURSIVE {TRAJECTORIES_SQL}, cand AS (
  SELECT a.obj, a.pos AS i, min(b.pos) AS j FROM traj a JOIN traj b ON a.obj = b.obj AND b.pos > a.pos
   AND b.t - a.t >= 6.0 AND b.t - a.t <= 72.0 AND a.speed >= 0.5 AND b.speed >= 0.5 AND {{test}} GROUP BY a.obj, a.pos),
nxt AS (SELECT obj, i, j, (SELECT min(c.i) FROM cand c WHERE c.obj = cand.obj AND c.i > cand.j) AS n FROM cand),
walk AS (SELECT obj, i, j, n FROM nxt WHERE i = (SELECT min(c.i) FROM cand c WHERE c.obj = nxt.obj)
  UNION ALL SELECT g.obj, g.i, g.j, g.n FROM walk w JOIN nxt g ON g.obj = w.obj AND g.i = w.n)
SELECT obj, i, j FROM walk"""
W3 = _WINDOWS.format(test="abs(b.x - a.x) >= 100")


LANE = Events(lane_pixels=100.0, lane_degrees=60.0, lane_window=(6.0, 72.0), moving_speed=0.5)


def w5_lane_change(spark, d):
    """LANE_CHANGE: 100 units to the side, onward, within 60 degrees."""
    return ev.lane_changes(trajectories(spark, d), LANE).select("obj", "i", "j", F.round("lateral", 5).alias("lateral"), F.round("confidence", 5).alias("confidence"))


_LON = "((b.x - a.x) * cos(radians(a.heading)) + (b.y - a.y) * sin(radians(a.heading)))"
_LAT = f"sqrt(pow(b.x - a.x - {_LON} * cos(radians(a.heading)), 2) + pow(b.y - a.y - {_LON} * sin(radians(a.heading)), 2))"
W5 = _WINDOWS.format(test=f"abs((((b.heading - a.heading + 180) % 360) + 360) % 360 - 180) < 60 AND {_LON} > 0 AND {_LAT} >= 100").replace("SELECT obj, i, j FROM walk", f"SELECT w.obj, w.i, w.j, round({_LAT}, 5) AS lateral, round(least(1.0, {_LAT} / 200.0), 5) AS confidence FROM walk w JOIN traj a ON a.obj = w.obj AND a.pos = w.i JOIN traj b ON b.obj = w.obj AND b.pos = w.j")


def k11_event_log(spark, d):
    """Stops, parks, turns, lane changes and crossings in one log."""
    regions = spark.createDataFrame(LINES, "region_id string, points array<struct<x:double,y:double>>")
    cfg = Events(stop_speed=CFG.stop_speed, stop_seconds=CFG.stop_seconds, moving_speed=0.5, turn_window=(6.0, 72.0), lane_pixels=100.0, lane_degrees=60.0, lane_window=(6.0, 72.0))
    log = ev.event_log(trajectories(spark, d), regions, cfg)
    return log.groupBy("obj", "type").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("start_t"), 4).alias("first"), F.round(F.max("end_t"), 4).alias("last"))


def w4_turns(spark, d):
    """TURN: heading changes by 45 degrees or more within a window."""
    return ev.thin(ev.candidate_windows(trajectories(spark, d), lambda a, b: F.abs(turn(a["heading"], b["heading"])) >= 45, 6.0, 72.0, 0.5))


W4 = _WINDOWS.format(test="abs((((b.heading - a.heading + 180) % 360) + 360) % 360 - 180) >= 45")


def _walk(test: str, name: str) -> str:
    """The greedy windows of ``test`` as CTEs named after ``name``."""
    body = _WINDOWS.format(test=test).split(f"{TRAJECTORIES_SQL}, ", 1)[1].rsplit("\nSELECT obj, i, j FROM walk", 1)[0]
    for t in ("cand", "nxt", "walk"):
        body = body.replace(t, f"{t}_{name}")
    return body


_TURN = "abs((((b.heading - a.heading + 180) % 360) + 360) % 360 - 180)"


def w6_crossings(spark, d):
    regions = spark.createDataFrame(LINES, "region_id string, points array<struct<x:double,y:double>>")
    c = ev.crossings(trajectories(spark, d), regions)
    return c.select("obj", "pos", "region_id", "direction", F.round("start_t", 5).alias("start_t"))


_CROSS = f"""WITH {TRAJECTORIES_SQL}, step AS (
  SELECT obj, pos, t, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM traj WINDOW w AS (PARTITION BY obj ORDER BY pos)), c AS (
  SELECT obj, pos, t, 'line_a' AS region_id, NULL AS direction FROM step
   WHERE ((500.0 * (y - 50.0)) * (500.0 * (y2 - 50.0)) < 0)
     AND ((x2 - x) * (50.0 - y) - (y2 - y) * (0.0 - x)) * ((x2 - x) * (50.0 - y) - (y2 - y) * (500.0 - x)) < 0
  UNION ALL
  SELECT obj, pos, t, 'poly_b', CASE WHEN b THEN 'enter' ELSE 'exit' END FROM (
   SELECT *, x < 400 AND x >= 100 AND y >= 20 AND y < 80 AS a, x2 < 400 AND x2 >= 100 AND y2 >= 20 AND y2 < 80 AS b FROM step WHERE x2 IS NOT NULL) WHERE a <> b)"""
W6 = _CROSS + " SELECT obj, pos, region_id, direction, round(t, 5) AS start_t FROM c"

K11 = f"""WITH RECURSIVE {_STOPS.split("WITH ", 1)[1]}, {_CROSS.split(f"WITH {TRAJECTORIES_SQL}, ", 1)[1].replace(", c AS (", ", crossed AS (")}, {_walk(f"{_TURN} >= 45", "turn")}, {_walk(f"{_TURN} < 60 AND {_LON} > 0 AND {_LAT} >= 100", "lane")},
log_ AS (SELECT obj, type, start_t, end_t FROM stops
  UNION ALL SELECT w.obj, 'TURN', a.t, b.t FROM walk_turn w JOIN traj a ON a.obj = w.obj AND a.pos = w.i JOIN traj b ON b.obj = w.obj AND b.pos = w.j
  UNION ALL SELECT w.obj, 'LANE_CHANGE', a.t, b.t FROM walk_lane w JOIN traj a ON a.obj = w.obj AND a.pos = w.i JOIN traj b ON b.obj = w.obj AND b.pos = w.j
  UNION ALL SELECT k.obj, 'CROSSES', k.t, n.t FROM crossed k JOIN traj n ON n.obj = k.obj AND n.pos = k.pos + 1)
SELECT obj, type, count(*) AS n, round(min(start_t), 4) AS first, round(max(end_t), 4) AS last FROM log_ GROUP BY obj, type"""


def w8_moved_to(spark, d):
    s = samples(spark, d).select("obj", F.col("class").alias("region_id"), F.col("t").alias("start_t"))
    return ev.moved_to(s).select("obj", "region_id", "step", F.round("start_t", 5).alias("start_t"))


W8 = f"""WITH {SAMPLES_SQL}, m AS (SELECT obj, class AS region_id, t, lag(class) OVER (PARTITION BY obj ORDER BY t, class) AS p FROM samples)
SELECT obj, region_id, row_number() OVER (PARTITION BY obj ORDER BY t, region_id) AS step, round(t, 5) AS start_t FROM m WHERE p IS DISTINCT FROM region_id"""


def w10_numbering(spark, d):
    s = ev.stops(trajectories(spark, d), CFG).select(F.col("obj").cast("string").alias("video_id"), "type", F.col("obj").cast("string").alias("subject_id"), F.lit(None).cast("string").alias("object_id"), F.format_string("%012.4f", F.round("start_t", 4)).alias("start_time"))
    return ev.number_events(s, scope=["video_id"]).select("event_id", "type", "subject_id", "start_time")


W10 = _STOPS + """, s AS (SELECT type, CAST(obj AS VARCHAR) AS subject_id, printf('%012.4f', round(start_t, 4)) AS start_time FROM stops)
SELECT 'evt_' || lpad(CAST(row_number() OVER (PARTITION BY subject_id ORDER BY start_time, type) AS VARCHAR), 5, '0') AS event_id, type, subject_id, start_time FROM s"""


def e10_interpolate(spark, d):
    """Position between a user's other events at the time of each error."""
    s = samples(spark, d)
    at = tr.interpolate(s.where("class = 'error'").select("obj", "t"), s.where("class <> 'error'"), ["obj"])
    return at.select("obj", *[F.round(c, 5).alias(c) for c in ("t", "x", "y")])


E10 = f"""WITH {SAMPLES_SQL}, known AS (SELECT obj, t, arg_max(x, pos) AS x, arg_max(y, pos) AS y FROM samples WHERE class <> 'error' GROUP BY obj, t),
asked AS (SELECT DISTINCT obj, t FROM samples WHERE class = 'error'),
p AS (SELECT a.obj, a.t, k.t AS t0, k.x AS x0, k.y AS y0 FROM asked a ASOF LEFT JOIN known k ON a.obj = k.obj AND a.t >= k.t),
q AS (SELECT p.*, k.t AS t1, k.x AS x1, k.y AS y1 FROM p ASOF LEFT JOIN known k ON p.obj = k.obj AND p.t <= k.t)
SELECT obj, round(t, 5) AS t, round(x0 + CASE WHEN t1 > t0 THEN (t - t0) / (t1 - t0) ELSE 0.0 END * (x1 - x0), 5) AS x,
       round(y0 + CASE WHEN t1 > t0 THEN (t - t0) / (t1 - t0) ELSE 0.0 END * (y1 - y0), 5) AS y FROM q"""


def f8_mean_heading(spark, d):
    t = trajectories(spark, d).where("heading IS NOT NULL")
    return t.groupBy("obj").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.sin(F.radians("heading"))), 6).alias("s"), F.round(F.avg(F.cos(F.radians("heading"))), 6).alias("c"), F.round(tr.mean_heading(F.col("heading")), 4).alias("mean_heading"))


F8 = f"WITH {TRAJECTORIES_SQL} SELECT obj, count(*) AS n, round(avg(sin(radians(heading))), 6) AS s, round(avg(cos(radians(heading))), 6) AS c, round(degrees(atan2(avg(sin(radians(heading))), avg(cos(radians(heading))))), 4) AS mean_heading FROM traj WHERE heading IS NOT NULL GROUP BY obj"


def f5_evidence(spark, d):
    n = samples(spark, d).groupBy("obj").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return n.select("obj", F.explode(tr.spread(F.col("n"), 5)).alias("pos"))


F5 = "WITH g AS (SELECT user_id AS obj, count(*) AS n FROM events GROUP BY user_id) SELECT DISTINCT obj, CAST(round_even(k * (n - 1) / greatest(least(n, 5) - 1, 1), 0) AS INTEGER) AS pos FROM g, range(5) r(k) WHERE k < least(n, 5)"


def c1_frames(spark, d):
    n = table(spark, d, "lineitem").count()
    f = tr.frames(n, 12.5, 30.0, 0.5, spark)
    return f.select("clip_id", "frame_id", F.round("t", 4).alias("t"))


C1 = "SELECT 'clip_' || lpad(CAST(i // 375 AS VARCHAR), CAST(greatest(3, length(CAST(i // 375 AS VARCHAR))) AS INTEGER), '0') AS clip_id, 'frame_' || lpad(CAST(i AS VARCHAR), 6, '0') AS frame_id, round(i / 12.5, 4) AS t FROM (SELECT unnest(range((SELECT count(*) FROM lineitem))) AS i) WHERE i % 6 = 0"


def _boxes(spark, d):
    b = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("frame"), F.col("l_partkey").alias("track"), F.col("l_quantity").alias("x1"), (F.col("l_discount") * 100).alias("y1"), (F.col("l_quantity") + 10).alias("x2"), (F.col("l_discount") * 100 + 5).alias("y2"))
    return b.distinct()


_BOXES = "boxes AS (SELECT DISTINCT l_orderkey AS frame, l_partkey AS track, l_quantity AS x1, l_discount * 100 AS y1, l_quantity + 10 AS x2, l_discount * 100 + 5 AS y2 FROM lineitem)"


def e13_occlusion(spark, d):
    """How much of each box others of its frame hide, and the best overlap."""
    b = _boxes(spark, d)
    a, o = (b.select("frame", *[F.col(c).alias(f"{p}_{c}") for c in ("track", "x1", "y1", "x2", "y2")]) for p in ("a", "o"))
    pairs = a.join(o, "frame").where("a_track <> o_track")
    own = ["frame", *[f"a_{c}" for c in ("track", "x1", "y1", "x2", "y2")]]
    hid = pairs.groupBy(*own).agg(F.max(covered(box("a_"), box("o_"))).alias("occlusion"), F.max(iou(box("a_"), box("o_"))).alias("best_iou"))
    return a.join(hid, own, "left").select("frame", F.col("a_track").alias("track"), F.col("a_x1").alias("x1"), *[F.round(F.coalesce(c, F.lit(0.0)), 5).alias(c) for c in ("occlusion", "best_iou")])


E13 = f"""WITH {_BOXES}, p AS (SELECT a.frame, a.track, a.x1, a.y1, greatest(0.0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0.0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS inter,
  b.track IS NOT NULL AS other FROM boxes a LEFT JOIN boxes b ON a.frame = b.frame AND a.track <> b.track)
SELECT frame, track, x1, round(coalesce(max(inter / 50.0) FILTER (WHERE other), 0.0), 5) AS occlusion, round(coalesce(max(inter / (100.0 - inter)) FILTER (WHERE other), 0.0), 5) AS best_iou FROM p GROUP BY frame, track, x1, y1"""


def stream_daily_counts(spark, d):
    """Tumbling counts from a file stream, run to its end."""
    schema = table(spark, d, "events").schema
    out = scratch(spark, "stream")
    stream = live.windowed_counts(live.read(spark, d, schema, glob="events.parquet"), late="3650 days")
    flat = stream.select(F.col("window.start").alias("start"), "event_type", "n", "total")
    live.replace_once(flat, f"{out}/result", f"{out}/state")
    return spark.read.parquet(f"{out}/result").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


STREAM = "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


def w14_running_clips(spark, d):
    """Days of a user as clips of a video, from a file stream run to its end."""
    out = scratch(spark, "clips")
    e = live.read(spark, d, table(spark, d, "events").schema, glob="events.parquet")
    frames = e.select(F.col("user_id").alias("video_id"), F.col("event_id").alias("frame_no"), "ts")
    live.run_once(clips.running_clips(frames, seconds=86400, every=5), f"{out}/result", f"{out}/state")
    r = spark.read.schema(clips.OUT).parquet(f"{out}/result")
    return r.select("video_id", "clip_no", F.date_format("first_frame", "HH:mm:ss").alias("first"), F.date_format("last_frame", "HH:mm:ss").alias("last"), "n_frames", "n_sampled")


W14 = """WITH f AS (SELECT user_id AS video_id, epoch_us(ts) // 86400000000 AS clip_no, min(ts) AS a, max(ts) AS b, count(*) AS n_frames, count(*) FILTER (WHERE event_id % 5 = 0) AS n_sampled FROM events GROUP BY 1, 2),
m AS (SELECT *, max(clip_no) OVER (PARTITION BY video_id) AS last_no, (SELECT max(epoch_us(ts)) / 1e6 - 3600 FROM events) AS mark FROM f)
SELECT video_id, clip_no, strftime(a, '%H:%M:%S') AS first, strftime(b, '%H:%M:%S') AS last, n_frames, n_sampled FROM m WHERE clip_no < last_no OR (clip_no + 1) * 86400 <= mark"""


def w9_best_of_track(spark, d):
    """Top three samples per object by value, ties to the earlier one."""
    from pyspark.sql import Window

    s = samples(spark, d)
    r = F.row_number().over(Window.partitionBy("obj").orderBy(F.desc("x"), "pos"))
    return s.withColumn("rank", r).where("rank <= 3").select("obj", "rank", "event_id", F.round("x", 6).alias("x"))


W9 = f"WITH {SAMPLES_SQL} SELECT obj, rank, event_id, round(x, 6) AS x FROM (SELECT *, row_number() OVER (PARTITION BY obj ORDER BY x DESC, pos) AS rank FROM samples) WHERE rank <= 3"


def d7_time_of_day(spark, d):
    e = table(spark, d, "events").withColumn("hh", F.date_format("ts", "HH:mm:ss"))
    return e.where((F.col("hh") >= "08:00:00") & (F.col("hh") <= "12:00:00")).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("hh").alias("first"), F.max("hh").alias("last"))


D7 = "SELECT user_id, count(*) AS n, min(hh) AS first, max(hh) AS last FROM (SELECT user_id, strftime(ts, '%H:%M:%S') AS hh FROM events) WHERE hh >= '08:00:00' AND hh <= '12:00:00' GROUP BY user_id"

QUERIES = {
    "w5_lane_change": (w5_lane_change, W5), "k11_event_log": (k11_event_log, K11),
    "c1_frames": (c1_frames, C1), "c5_velocity": (c5_velocity, C5), "c8_track_summary": (c8_track_summary, C8), "w2_stop_park": (w2_stop_park, W2),
    "f9_event_counts": (f9_event_counts, F9), "w3_greedy_windows": (w3_greedy_windows, W3), "w4_turns": (w4_turns, W4), "w6_crossings": (w6_crossings, W6),
    "w8_moved_to": (w8_moved_to, W8), "w10_numbering": (w10_numbering, W10), "e10_interpolate": (e10_interpolate, E10), "f8_mean_heading": (f8_mean_heading, F8),
    "f5_evidence": (f5_evidence, F5), "e13_occlusion": (e13_occlusion, E13), "stream_daily_counts": (stream_daily_counts, STREAM), "w9_best_of_track": (w9_best_of_track, W9),
    "w14_running_clips": (w14_running_clips, W14), "d7_time_of_day": (d7_time_of_day, D7),
}
