"""Literal cases for operators without an SQL oracle, and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajecta.config import Events, load
from trajecta.functions import geometry as ge
from trajecta.functions import text as tx
from trajecta.functions import vocabulary as V
from trajecta.operators import events as ev
from trajecta.operators import linking as ln
from trajecta.operators import matching as ma
from trajecta.operators import metrics as me
from trajecta.operators import retrieval as rt
from trajecta.operators import trajectory as tr
from trajecta.operators import voting as vo
from trajecta.plans import graph as g
from trajecta.sources import importers as im
from trajecta.streaming import live


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def traj(spark, points, obj=1):
    """points: (t, x, y, vx, vy)."""
    df = spark.createDataFrame([(obj, i, *map(float, p)) for i, p in enumerate(points)], "obj long, pos int, t double, x double, y double, vx double, vy double")
    return tr.motion(df)


def test_geometry(spark):
    a, b = tuple(F.lit(float(x)) for x in (0, 0, 10, 10)), tuple(F.lit(float(x)) for x in (5, 0, 15, 10))
    square = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (10, 0), (10, 10), (0, 10))])
    p = lambda x, y: (F.lit(float(x)), F.lit(float(y)))
    r = one(spark, iou=ge.iou(a, b), t1=ge.turn(F.lit(170.0), F.lit(-170.0)), t2=ge.turn(F.lit(-170.0), F.lit(170.0)), inside=ge.in_polygon(*p(5, 5), square), out=ge.in_polygon(*p(15, 5), square), x=ge.segments_cross(p(0, 0), p(10, 10), p(0, 10), p(10, 0)), no=ge.segments_cross(p(0, 0), p(10, 10), p(20, 20), p(30, 30)))
    assert (r.iou, r.t1, r.t2, r.inside, r.out, r.x, r.no) == (50 / 150, 20, -20, True, False, True, False)


@pytest.mark.parametrize(("speeds", "kind"), [((100, 0.1, 0.1, 0.1, 100), ["STOP"]), ((100, 0, 0, 0), ["PARK"]), ((), [])])
def test_stops(spark, speeds, kind):
    df = traj(spark, [(t, 0, 0, s, 0) for t, s in enumerate(speeds)])
    assert [r.type for r in ev.stops(df).collect()] == kind


def test_too_brief_a_stop(spark):
    assert ev.stops(traj(spark, [(0, 0, 0, 100, 0), (0.5, 0, 0, 0, 0), (1.0, 0, 0, 100, 0)])).count() == 0


def test_turn_takes_the_smallest_window(spark):
    df = traj(spark, [(0, 0, 0, 100, 0), (1, 0, 0, 0, 100), (2, 0, 0, -100, 0)])
    found = ev.thin(ev.candidate_windows(df, lambda a, b: F.abs(ge.turn(a["heading"], b["heading"])) >= 45, 0.5, 8.0, 8.0)).collect()
    assert [(r.i, r.j) for r in found] == [(0, 1)]


def test_crossings_of_polygon(spark):
    regions = spark.createDataFrame([("p", [(0.0, 0.0), (100.0, 0.0), (100.0, 100.0), (0.0, 100.0)]), ("l", [(50.0, 0.0), (50.0, 100.0)])], "region_id string, points array<struct<x:double,y:double>>")
    df = traj(spark, [(0, -50, 50, 0, 0), (1, 49, 50, 0, 0), (2, 150, 50, 0, 0)])
    assert sorted((r.region_id, r.pos, r.direction) for r in ev.crossings(df, regions).collect()) == [("l", 1, None), ("p", 0, "enter"), ("p", 1, "exit")]


def test_overtake(spark):
    a = traj(spark, [(t, 150 * t, 20, 150, 0) for t in range(7)], 1)
    b = traj(spark, [(t, 100 * t + 250, 0, 100, 0) for t in range(7)], 2)
    c = traj(spark, [(t, 100 * t + 250, 20, 100, 0) for t in range(7)], 3)
    found = ev.overtakes(a.unionByName(b)).collect()
    assert [(r.subject, r.object) for r in found] == [(1, 2)]
    assert ev.overtakes(a.unionByName(c)).count() == 0  # nothing lateral
    assert ev.overtakes(a).count() == 0


def test_hungarian_beats_greedy():
    score = np.array([[0.99, 0.764], [0.98, 0.763]])
    assert len(ma.hungarian(score)) == 2
    rng = np.random.default_rng(0)
    from itertools import permutations

    for n, m in ((3, 3), (2, 4), (4, 2), (5, 5)):
        s = rng.random((n, m))
        got = sum(s[i, j] for i, j in ma.hungarian(s))
        rows, cols = (s, m) if n <= m else (s.T, n)
        best = max(sum(rows[i, p[i]] for i in range(min(n, m))) for p in permutations(range(cols), min(n, m)))
        assert abs(got - best) < 1e-9


def test_greedy_equals_the_sequential_choice(spark):
    rng = np.random.default_rng(3)
    rows = [(s, int(a), int(b), float(rng.integers(0, 6))) for s in range(3) for a in range(6) for b in range(6) if rng.random() < 0.6]
    got = {(r.s, r.a, r.b) for r in ma.greedy(spark.createDataFrame(rows, "s int, a int, b int, score double"), ["s"]).where("accepted").collect()}
    want, used = set(), set()
    for s, a, b, v in sorted(rows, key=lambda r: (-r[3], r[1], r[2])):
        if ("a", s, a) not in used and ("b", s, b) not in used:
            want.add((s, a, b))
            used |= {("a", s, a), ("b", s, b)}
    assert got == want


def test_greedy_leaves_no_feasible_link(spark):
    """More equal links than 30 rounds of one link each would take."""
    rows = [(1, a, b, 0.5) for a in range(40) for b in range(45)] + [(2, a, b, 0.5) for a in range(4) for b in range(a, 5)]
    got = {(r.s, r.a, r.b) for r in ma.greedy(spark.createDataFrame(rows, "s int, a int, b int, score double"), ["s"]).where("accepted").collect()}
    assert got == {(1, k, k) for k in range(40)} | {(2, k, k) for k in range(4)}


def test_chains(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (7, 8)], "a long, b long")
    assert {r.node: (r.head, r.step) for r in ma.chains(links).collect()} == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (1, 3), 7: (7, 0), 8: (7, 1)}


def test_cross_clip_links(spark):
    def track(clip, name, angle, t):
        v = [float(np.cos(np.radians(angle))), float(np.sin(np.radians(angle)))]
        return ("v", clip, name, "car", t, t, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 10.0, v, None, None, None, None)

    schema = "video_id string, clip_no int, track string, class string, t_first double, t_last double, x_first double, y_first double, x_last double, y_last double, exit_vx double, exit_vy double, diag double, embedding array<double>, color string, vehicle_type string, make string, model string"
    tracks = spark.createDataFrame([track(0, "a1", 0, 0.0), track(0, "a2", -3.37, 0.0), track(1, "b1", 8.11, 1.0), track(1, "b2", 36.87, 1.0)], schema)
    won = ln.link_clips(ln.clip_pairs(tracks))
    assert {(r.a, r.b) for r in won.collect()} == {("a1", "b2"), ("a2", "b1")}
    ids = {r.track: r.global_id for r in ln.global_ids(tracks, won).collect()}
    assert ids == {"a1": "obj_0001", "b2": "obj_0001", "a2": "obj_0002", "b1": "obj_0002"}


def test_vote_prefers_quality_to_number(spark):
    rows = [("t", "white", 1.0)] + [("t", "silver", 0.05)] * 3
    r = vo.vote(spark.createDataFrame(rows, "track string, value string, weight double"), ["track"]).first()
    assert (r.winner, r.n_votes, r.uncertain) == ("white", 4, False)
    none = vo.vote(spark.createDataFrame([("t", None, 1.0)], "track string, value string, weight double"), ["track"]).first()
    assert (none.winner, none.uncertain_reason) == (None, "no_evidence")


def test_merge_distributions(spark):
    rows = spark.createDataFrame([("o", "white", 1.0, 20), ("o", "silver", 1.0, 5)], "o string, value string, share double, n_votes int")
    assert {r.value: r.share for r in vo.merge_distributions(rows, ["o"]).collect()} == {"white": 0.8, "silver": 0.2}


def test_tracking_metrics(spark):
    box = (0.0, 0.0, 10.0, 10.0)
    schema = "video_id string, frame_no int, identity string, x1 double, y1 double, x2 double, y2 double"
    truth = spark.createDataFrame([("v", i, "g", *box) for i in range(3)], schema)
    found = spark.createDataFrame([("v", i, p, *box) for i, p in enumerate(("p1", "p2", "p2"))], schema)
    r = me.mota(truth, found, ["video_id", "frame_no"]).first()
    assert (r.tp, r.switches, r.mota) == (3, 1, round(1 - 1 / 3, 6))
    assert me.idf1(truth, found, ["video_id", "frame_no"], keys=["video_id"]).first().idf1 == round(2 * 2 / 6, 6)
    many = spark.createDataFrame([("v", 0, f"p{i}", *(box if not i else (50.0, 50.0, 60.0, 60.0))) for i in range(4)], schema)
    assert me.mota(truth.where("frame_no = 0"), many, ["video_id", "frame_no"]).first().mota == -2.0


def test_questions(spark):
    q = "find the grey lorry"
    r = one(spark, color=tx.match_vocabulary(F.lit(q), V.COLOR), classes=tx.find_all(F.lit(q), V.CLASSES), n=tx.first_count(F.lit("There are seven matching objects")), m=tx.first_count(F.lit("There are 12 objects")), c=tx.citations(F.lit("See [obj_0001 @ 11:03:20] and [obj_2 @ 9:00:00].")), s=tx.split_at_relation(F.lit("red car that overtook a bus"))[1], p=tx.pluralize(F.lit("bus"), F.lit(2)), t=tx.time_of(F.lit("2024-01-01T11:03:20.5")))
    assert r.color == "gray" and r.classes == ["truck"] and (r.n, r.m) == (7, 12)
    assert [(c.id, c.at) for c in r.c] == [("obj_0001", "11:03:20"), ("obj_2", "09:00:00")]
    assert r.s.strip() == "a bus" and r.p == "buses" and r.t == "11:03:20"
    assert tx.latex_escape("50% & a_b") == r"50\% \& a\_b"


def test_fusion(spark):
    hits = spark.createDataFrame([("in_range", 1, "car"), ("out", 2, "car")], "global_id string, rank int, hit_class string")
    rows = spark.createDataFrame([("in_range", "car", 1.0)], "global_id string, class string, confidence double")
    assert [r.global_id for r in rt.top(rt.fuse(hits, rows, constrained=True), 5).collect()] == ["in_range"]
    assert rt.fuse(hits, rows, constrained=False).count() == 2
    r = one(spark, a=rt.rrf(F.lit(1)), s=rt.route(F.lit("counting"), F.lit(0), F.lit("")))
    assert r.a == 1.0 and r.s == "counting"


def test_reconcile_table(spark):
    rows = [("color", "red", 0.5, "red", False), ("color", None, None, "red", False), ("make", "audi", 0.5, "bmw", False), ("color", "red", 0.5, "blue", False), ("direction", "left", 0.5, "left", False), ("color", "red", 0.5, None, False)]
    df = spark.createDataFrame(rows, "attribute string, clip_value string, clip_confidence double, best_value string, best_uncertain boolean")
    assert [r.outcome for r in vo.reconcile(df).collect()] == ["confirmed", "filled", "corrected", "retained", "unconfirmed", "unconfirmed"]


def test_graph_edges(spark):
    shares = spark.createDataFrame([("o", "color", "white", 0.8), ("o", "color", "silver", 0.2)], "global_id string, attribute string, value string, share double")
    final = spark.createDataFrame([("o", "color", "white", 0.9, "agreed", False), ("o", "make", "toyota", 1.0, "best_shot", False)], "global_id string, attribute string, value string, confidence double, source string, uncertain boolean")
    got = {(r.type, r.value): (r.share, r.winner, r.source) for r in g.attribute_edges(shares, final).collect()}
    assert got == {("color", "white"): (0.8, True, "agreed"), ("color", "silver"): (0.2, False, "clip_voting"), ("make", "toyota"): (1.0, True, "best_shot")}


def test_importers(spark, tmp_path):
    (tmp_path / "gt.txt").write_text("1,1,0,0,10,10,1,3,1\n2,1,0,0,10,10,1,3,1\n3,1,5,5,10,10,1,3,1\n4,2,5,5,10,10,0,3,1\n")
    frames = spark.createDataFrame([(f"frame_{i:06d}",) for i in (0, 2, 4, 6)], "frame_id string")
    kept, report = im.align(im.mot(spark, str(tmp_path / "gt.txt")), frames)
    assert sorted(r.frame_id for r in kept.collect()) == ["frame_000000", "frame_000002"]
    r = report.first()
    assert (r.ignored, r.unsampled, r.kept, r.vanished) == (1, 1, 2, 1)
    (tmp_path / "d.xml").write_text('<sequence><frame num="1"><target_list><target id="4"><box left="1" top="2" width="3" height="4"/><attribute vehicle_type="others"/></target></target_list></frame></sequence>')
    d = im.detrac(spark, str(tmp_path / "d.xml")).first()
    assert (d.gt_id, d.frame_no, d["class"], d.x2, d.y2) == ("gt_4", 0, "car", 4.0, 6.0)
    body = "".join(f'<target id="{i}"><box left="0" top="0" width="1" height="1"/>{a}</target>' for i, a in enumerate(['<attribute vehicle_type="Van"/>', '<attribute vehicle_type="truck"/>', '<attribute vehicle_type="hovercraft"/>', ""]))
    (tmp_path / "e.xml").write_text(f'<sequence><frame num="1"><target_list>{body}</target_list></frame></sequence>')
    assert [(r["class"], r.vehicle_type) for r in im.detrac(spark, str(tmp_path / "e.xml")).orderBy("gt_id").collect()] == [("car", "van"), ("truck", "truck"), ("car", None), ("car", None)]
    (tmp_path / "classes.txt").write_text("".join(f"1,{c},0,0,1,1,1,{c},1\n" for c in range(1, 8)))
    assert [r["class"] for r in im.mot(spark, str(tmp_path / "classes.txt")).orderBy("gt_id").collect()] == ["person", None, "car", "car", "truck", "bus", None]
    (tmp_path / "r.yaml").write_text("lines:\n- {id: a, points: [[0, 0], [1, 1]]}\nregions:\n- {id: b, points: [[0, 0], [1, 1], [1, 0]]}\n")
    assert im.regions(spark, str(tmp_path / "r.yaml")).count() == 2


def test_streams_equal_batches(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = live.visits(live.read(spark, "/root/testdata/sf0.001", src.schema, glob="events.parquet"), late="36500 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("visits").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = src.groupBy(F.session_window(F.col("ts").cast("timestamp"), "12 hours"), "user_id").count()
    assert spark.table("visits").agg(F.sum("n"), F.count("*")).first() == batch.agg(F.sum("count"), F.count("*")).first()


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("events:\n  stop_speed: 3\nretrieval:\n  weights: [1, 0, 0]\n")
    s = load(str(tmp_path / "c.yaml"), {"TRAJECTA__EVENTS__STOP_SPEED": "4"})
    assert s.events.stop_speed == 4.0 and s.retrieval.weights == (1.0, 0.0, 0.0) and s.events.turn_degrees == Events().turn_degrees


def test_spread_and_empty_tables(spark):
    assert one(spark, a=tr.spread(F.lit(9), 5), b=tr.spread(F.lit(2), 5), c=tr.spread(F.lit(0), 5)) == ([0, 2, 4, 6, 8], [0, 1], [])
    empty = traj(spark, [])
    assert ev.stops(empty).count() == 0 and ev.thin(ev.candidate_windows(empty, lambda a, b: F.lit(True), 1, 2, 0)).count() == 0


def test_global_ids_of_several_videos(spark):
    tracks = spark.createDataFrame([(v, 0 if t == "x" else 1, t, float(i)) for v in ("v", "w") for i, t in enumerate(("x", "y"))], "video_id string, clip_no int, track string, t_first double")
    links = spark.createDataFrame([("v", 0, "x", "y", 1.0)], "video_id string, clip_no int, a string, b string, score double")
    got = {(r.video_id, r.track): r.global_id for r in ln.global_ids(tracks, links).collect()}
    assert got[("v", "x")] == got[("v", "y")] and got[("w", "x")] != got[("w", "y")]


def test_link_clips_in_order_of_clips(spark):
    """At distance 2, clip 0 takes from clip 2 before clip 1 may."""
    rows = [("v", 0, 2, "a", "c", 0.5), ("v", 1, 2, "b", "c", 0.9), ("w", 1, 2, "b", "c", 0.9), ("w", 0, 1, "a", "b", 0.4), ("w", 0, 2, "a", "d", 0.9)]
    pairs = spark.createDataFrame([(*r, None) for r in rows], "video_id string, clip_no int, b_clip_no int, a string, b string, score double, failed_gate string")
    got = {(r.video_id, r.a, r.b) for r in ln.link_clips(pairs, 2).collect()}
    assert got == {("v", "a", "c"), ("w", "a", "b"), ("w", "b", "c")}


def test_greedy_takes_all_of_a_chain(spark):
    links = [("s", f"a{i:03}", f"b{i + k:03}", 1.0 - (2 * i + k) / 1000) for i in range(80) for k in (0, 1)]
    got = ma.greedy(spark.createDataFrame(links, "scope string, a string, b string, score double"), ["scope"]).where("accepted").collect()
    assert len(got) == 80
