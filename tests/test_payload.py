"""The graph build: versions, checked ends, and videos that stay."""

import pytest
from pyspark.sql import functions as F

from trajecta.plans import payload as p


@pytest.fixture
def build(spark):
    def make(video, cls="car", stray=False):
        def df(rows, schema):
            return spark.createDataFrame(rows, "video_id string, " + schema)

        meta = "map<string,string>"
        events = [(video, "e1", "CROSSES", "o1", None, "10:00", "10:01", 0.9, [], {"region_id": "r1"}), (video, "e2", "CROSSES", "o1", None, "10:02", "10:03", 0.9, [], {"region_id": "r1"}), (video, "e3", "CROSSES", "o1", None, "10:04", "10:05", 0.9, [], {"region_id": "r2"}), (video, "e4", "STOP", "o1", None, "10:06", "10:07", 0.9, ["f1"], None), (video, "e5", "PARK", "o1", None, "10:06", "10:07", 0.9, ["f9"], None), (video, "e6", "OVERTAKE", "o1", "zz" if stray else "o2", "10:08", "10:09", 0.9, ["f1"], {})]
        return p.graph_payload(
            spark.createDataFrame([(video,)], "video_id string"),
            df([(video, "c1")], "clip_id string"),
            df([(video, "c1", "f1"), (video, "c1", "f2")], "clip_id string, frame_id string"),
            df([(video, "o1", cls), (video, "o2", "person")], "global_id string, class string"),
            df([(video, "o1", "c1", "t1", "10:00", "10:10")], "global_id string, clip_id string, track_id string, first_seen string, last_seen string"),
            df([(video, "c1", "t1", "f1", [0.0, 0.0, 1.0, 1.0]), (video, "c1", "t1", "f7", [0.0]), (video, "c1", "t9", "f1", [0.0])], "clip_id string, track_id string, frame_id string, bbox array<double>"),
            df(events, f"event_id string, type string, subject_id string, object_id string, start_time string, end_time string, confidence double, evidence_frames array<string>, metadata {meta}"),
            df([(video, "r1", "line"), (video, "r2", "polygon")], "region_id string, region_type string"),
            final=df([(video, "o1", "color", "red", 0.8, "m8", False)], "global_id string, attribute string, value string, confidence double, source string, uncertain boolean"),
            shares=df([(video, "o1", "color", "blue", 1.0)], "global_id string, attribute string, value string, share double"),
        )

    return make


def test_shapes(build):
    t = build("a")
    o = {r.global_id: r for r in t["objects"].collect()}
    assert (o["o1"].color, o["o1"].color_source, o["o1"].make_source, o["o1"].n_sightings) == ("red", "m8", "unconfirmed", 1)
    assert (o["o2"].label, o["o2"].n_sightings, o["o2"].color_uncertain) == ("Person", 0, True)
    assert sorted((r.key, r.share, r.winner) for r in t["attribute_edges"].collect()) == [("color:blue", 1.0, False), ("color:red", 0.0, True)]
    assert [(r.object_uid, r.frame_uid) for r in t["frame_sightings"].collect()] == [("a:o1", "a:f1")]
    assert sorted((r.rel, r.to_uid) for r in t["shortcut_edges"].collect()) == [("CROSSES", "a:r1"), ("CROSSES", "a:r1"), ("CROSSES", "a:r2"), ("OVERTAKES", "a:o2"), ("STOPS_AT", "a:f1")]
    assert sorted((r.order, r.location_uid) for r in t["moved_to"].collect()) == [(1, "a:r1"), (2, "a:r2")]
    assert p.loose_ends(t).count() == 0


def test_a_failed_build_leaves_the_old_version(spark, build, tmp_path):
    path = str(tmp_path / "graph")
    assert p.manifest(spark, path).count() == 0
    first = p.publish(build("a"), path)
    p.publish(build("07"), path)
    with pytest.raises(ValueError, match="a:zz"):
        p.publish(build("a", "bus", stray=True), path)
    shown = p.published(spark, path, "objects").where("global_id = 'o1'")
    assert sorted((r.video_id, r["class"]) for r in shown.collect()) == [("07", "car"), ("a", "car")]
    p.publish(build("a", "bus"), path)
    shown = p.published(spark, path, "objects").where("global_id = 'o1'")
    assert sorted((r.video_id, r["class"]) for r in shown.collect()) == [("07", "car"), ("a", "bus")]
    assert {r.version for r in p.manifest(spark, path).where(F.col("video_id") == "a").collect()} != {first}
