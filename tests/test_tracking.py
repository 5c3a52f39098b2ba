"""Tracks, merged tracks and running means on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajecta.operators import merging as mg
from trajecta.operators import tracking as tk
from trajecta.plans import questions as qu

BOX = "x1 double, y1 double, x2 double, y2 double"


def boxes(spark, rows):
    return spark.createDataFrame([("v", "c", f"f{f:03d}", i, c, float(x), float(y), float(x + 20), float(y + 10)) for f, i, c, x, y in rows], f"video_id string, clip_id string, frame_id string, id long, confidence double, {BOX}")


def test_follow(spark):
    """Two cars that pass each other, one of them hidden and then unsure, a
    ghost seen once, a new car behind the gap that a lost track allows."""
    rows = []
    for f in range(20):
        if f not in (8, 9, 10):
            rows.append((f, 100 + f, 0.9 if f != 5 else 0.15, 10 + 4 * f, 50))
        rows.append((f, 200 + f, 0.8, 150 - 4 * f, 90))
    rows += [(3, 300, 0.9, 400, 400), (12, 400, 0.2, 600, 600), (19, 500, 0.3, 700, 700)]
    frames = spark.createDataFrame([("v", "c", f"f{f:03d}") for f in range(20)] + [("v", "c", "f003")], "video_id string, clip_id string, frame_id string")
    got = {r.id: r.track for r in tk.follow(frames, boxes(spark, rows)).collect()}
    assert len({got[100 + f] for f in range(20) if f not in (8, 9, 10)}) == 1 and len({got[200 + f] for f in range(20)}) == 1
    assert got[100] != got[200] and 300 in got and 400 not in got and 500 not in got
    few = tk.follow(frames, boxes(spark, rows), tk.Tracking(confirmed_after=2))
    assert 300 not in {r.id for r in few.collect()}
    short = {r.id: r.track for r in tk.follow(frames, boxes(spark, rows), tk.Tracking(lost_frames=2)).collect()}
    assert short[107] != short[111]
    assert {r.n for r in tk.track_summary(few).collect()} == {17, 20}
    assert tk.follow(frames, boxes(spark, rows).limit(0)).count() == 0


def test_follow_equals_the_plain_fold(spark):
    rng = np.random.default_rng(3)
    rows = [(f, 1000 * k + f, float(np.round(rng.random(), 2)), 30 * k + 3 * f + rng.normal(), 40 * k) for k in range(4) for f in range(30) if rng.random() < 0.8]
    frames = spark.createDataFrame([("v", "c", f"f{f:03d}") for f in range(30)], "video_id string, clip_id string, frame_id string")
    tracks, number, want = [], 1, {}
    for f in range(30):
        mine = sorted((i, c, x, y) for g, i, c, x, y in rows if g == f)
        b = np.array([(x, y, x + 20, y + 10) for _, _, x, y in mine], float).reshape(-1, 4)
        tracks, given, number = tk.update(tracks, f, b, np.array([c for _, c, _, _ in mine]), tk.Tracking(), number)
        want.update({i: n for (i, *_), n in zip(mine, given, strict=True) if n > 0})
    assert {r.id: r.track for r in tk.follow(frames, boxes(spark, rows)).collect()} == want and len(want) > 40


@pytest.mark.parametrize("flip", [False, True])
def test_merge_of_three_in_any_order(spark, flip):
    scope = "video_id string, clip_id string, "
    e = [[2.0, 0.0], [0.0, 3.0], None]
    tracks = [("v", "c", t, k, f, x) for (t, k, f), x in zip([("10", "car", 4.0), ("9", "bus", 0.0), ("x", "van", 8.0)], [e[0], e[1], e[2]], strict=True)]
    samples = [("v", "c", t, p, s + p, 10.0 * (s + p), 5.0) for t, s, n in (("10", 4.0, 2), ("9", 0.0, 3), ("x", 8.0, 1)) for p in range(n)]
    crops = [("v", "c", "10", "b", 0.5), ("v", "c", "9", "a", 0.5), ("v", "c", "x", "z", 0.9), ("v", "c", "9", "n", None)]
    links = [("v", "c", "9", "10"), ("v", "c", "10", "x")]
    order = (lambda x: x[::-1]) if flip else (lambda x: x)
    t, s, c, ln = (spark.createDataFrame(order(rows), scope + kind) for rows, kind in ((tracks, "track string, class string, first double, embedding array<double>"), (samples, "track string, pos int, t double, x double, y double"), (crops, "track string, path string, score double"), (links, "a string, b string")))
    merged, whole = mg.merge_tracks(t, s, c, ln, top_k=3)
    (r,) = merged.collect()
    assert (r.track, r["class"], r.n_fragments, r.n_samples, r.heading) == ("9", "bus", 3, 6, 0.0)
    assert np.allclose(r.embedding, np.array([2, 3]) / np.sqrt(13)) and [x.path for x in r.crops] == ["z", "a", "b"]
    path = sorted(map(tuple, whole.select("pos", "part_of", "vx").collect()))
    assert [p[0] for p in path] == list(range(6)) and path[3][1] == "10" and path[3][2] == pytest.approx(10.0)  # 2 s to 4 s: over the gap
    alone, _ = mg.merge_tracks(t, s, c, ln.limit(0))
    assert {x.track for x in alone.collect()} == {"9", "10", "x"} and alone.where("track = 'x'").first().embedding is None


def test_running_mean_in_parts(spark):
    rng = np.random.default_rng(5)
    rows = [("a", i, rng.normal(size=3).tolist()) for i in range(500)] + [("b", 0, [0.0, 2.0, 0.0]), ("b", 1, [0.0, 0.0, 0.0]), ("b", 2, None)]
    df = spark.createDataFrame(rows, "k string, at int, embedding array<double>")
    got = {r.k: r for r in mg.running_mean(df, ["k"], "at").collect()}
    s = None
    for _, _, v in rows[:500]:
        u = np.array(v) / np.linalg.norm(v)
        s = u if s is None else 0.9 * s + 0.1 * u
    assert np.allclose(got["a"].embedding, s) and got["a"].n == 500 and got["b"].embedding == [0.0, 1.0, 0.0] and got["b"].n == 1


def test_times_of_questions(spark):
    cases = {
        "between 11:00 and 12:30": ("11:00:00", "12:30:00"), "after 3pm": ("15:00:00", None), "before 10:15. Then at 9:05": ("09:05:00", "09:05:00"),
        "a car at 10 or 11:15 before noon, 12pm": ("11:15:00", "12:00:00"), "top 5 at gate 7": (None, None), "around 25:10": (None, None), "until 12am": (None, "00:00:00"),
    }
    df = spark.createDataFrame([(k,) for k in cases], "q string").withColumn("t", qu.time_bounds(F.col("q")))
    assert {r.q: (r.t.after, r.t.before) for r in df.collect()} == cases


def test_odd_questions(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "Which white sedans overtook a blue truck?"), (4, "red buses")], "question_id long, question string")
    rows = {r.question_id: r for r in qu.parse(df, ["gate_1"]).collect()}
    assert not rows[1].constrained and rows[1].question_type is None and not rows[2].constrained
    r = rows[3]
    assert (r.color, r.vehicle_type, r.classes, r.other_color, r.other_vehicle_type, r.other_classes, r.relations) == ("white", "sedan", ["car"], "blue", None, ["truck"], ["OVERTAKE"])
    assert (rows[4].color, rows[4].vehicle_type, rows[4].classes) == ("red", None, ["bus"])
    assert qu.parse(df.limit(0)).count() == 0


def test_clips_share_calls(spark):
    """Many short clips in one call, cut by small batches, are each tracked as
    if alone; crowded frames go by arrays and give the same."""
    rng = np.random.default_rng(8)
    rows = [(c, f, c * 1000 + f * 10 + k, float(rng.choice([0.2, 0.9])), float(x), 0.0, float(x) + 30, 20.0) for c in range(12) for f in range(8) for k, x in enumerate(rng.integers(0, 60, rng.integers(0, 5)))]
    df = spark.createDataFrame(rows, "clip_id int, frame_id int, id long, confidence double, x1 double, y1 double, x2 double, y2 double").withColumn("video_id", F.lit("v"))
    frames = df.select("video_id", "clip_id", "frame_id").distinct()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        whole = tk.follow(frames, df)
        got = {(r.clip_id, r.id): r.track for r in whole.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroupsInPandas" not in whole._jdf.queryExecution().toString()
    want = {}
    for c in range(12):
        tracks, number = [], 1
        for at, f in enumerate(sorted({r[1] for r in rows if r[0] == c})):
            mine = sorted((r for r in rows if r[:2] == (c, f)), key=lambda r: r[2])
            tracks, given, number = tk.update(tracks, at, np.array([r[4:] for r in mine]), np.array([r[3] for r in mine]), tk.Tracking(), number)
            want.update({(c, r[2]): n for r, n in zip(mine, given, strict=True) if n > 0})
    assert got == want and len(want) > 40
    corner = rng.integers(0, 50, (2, 12, 2))
    a, b = ([tuple(map(float, x)) for x in side] for side in np.concatenate([corner, corner + rng.integers(1, 30, (2, 12, 2))], axis=2))
    m = tk.overlap_matrix(np.array(a), np.array(b))
    want = {(i, j): m[i, j] for i in range(12) for j in range(12) if m[i, j] > 0}
    assert tk._overlaps(a, b) == want == {(i, j): x for i in range(12) for j in range(12) for x in tk._overlaps(a[i : i + 1], b[j : j + 1]).values()}
