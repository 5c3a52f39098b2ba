"""Crops, evaluation and lookups in time, on small cases worked by hand."""

import pytest
from pyspark.sql import functions as F

from trajecta.operators import crops as cr
from trajecta.operators import metrics as me
from trajecta.operators import trajectory as tr


def test_frame_boxes_keep_the_last(spark):
    tracks = spark.createDataFrame(
        [("c1", 1, 0, ["f1", "f2", "f2"], [(0.0, 0.0, 1.0, 1.0), (1.0, 1.0, 2.0, 2.0), (5.0, 5.0, 6.0, 6.0)]), ("c1", 1, 1, ["f1", "f9"], [(7.0, 7.0, 8.0, 8.0), (0.0, 0.0, 1.0, 1.0)]), ("c1", 2, 2, [], [])],
        "clip_id string, track_id int, pos int, frames array<string>, boxes array<struct<x1:double,y1:double,x2:double,y2:double>>",
    )
    frames = spark.createDataFrame([("f1",), ("f2",), ("f3",)], "frame_id string")
    out = {(r.frame_id, r.identity): r.x1 for r in me.frame_boxes(tracks, frames, prefix="p_").collect()}
    assert out == {("f1", "p_c1:1"): 7.0, ("f2", "p_c1:1"): 5.0}


def test_identity_votes_and_ties(spark):
    rows = spark.createDataFrame([("t2", "p"), ("t1", "p"), ("t1", "q"), ("t3", "q"), ("t3", "q")], "a string, b string")
    assert {r.b: (r.a, r.n) for r in me.identity_votes(rows).collect()} == {"p": ("t1", 1), "q": ("t3", 2)}


def test_answer_scores(spark):
    items = spark.createDataFrame([(1, "factual", True, None, ["g1", "g2"]), (2, "counting", True, 3, []), (3, "factual", False, None, ["g1"])], "question_id int, question_type string, answerable boolean, expected_count int, expected_ids array<string>")
    answers = spark.createDataFrame([(1, "s", "A red car.", None, ["o1", "o9"], ["o1", "o9"]), (2, "s", "There is insufficient evidence.", None, [], []), (3, "s", "A red car.", 1, ["o1"], [])], "question_id int, system string, answer string, said_count int, cited_ids array<string>, retrieved_ids array<string>")
    true_ids = spark.createDataFrame([("o1", "g1")], "b string, a string")
    scores = me.answer_scores(items, answers, true_ids)
    got = {r.question_id: (r.grounded, r.abstention_correct, r.counting_correct, r.object_precision, r.object_recall) for r in scores.collect()}
    assert got == {1: (True, True, None, 1.0, 0.5), 2: (True, False, False, None, None), 3: (False, False, None, None, None)}
    s = me.answer_summary(scores).first()
    assert (s.n_questions, s.counting_accuracy, s.object_f1, s.abstention_accuracy, s.grounded_rate) == (3, 0.0, 0.6667, 0.3333, 0.6667)
    assert me.answer_summary(scores.where("false")).isEmpty()


@pytest.mark.parametrize("w, h, expected", [(120.0, 100.0, 1.0), (220.0, 100.0, 0.0), (170.0, 100.0, 0.5), (10.0, 0.0, 0.0), (900.0, 100.0, 0.0)])
def test_frontality(spark, w, h, expected):
    assert spark.range(1).select(cr.frontality(F.lit(w), F.lit(h))).first()[0] == pytest.approx(expected)


def test_crops(spark):
    b = spark.createDataFrame([(1.9, -3.0, 20.0, 9.9), (8.0, 1.0, 8.9, 5.0), (30.0, 0.0, 40.0, 5.0)], "x1 double, y1 double, x2 double, y2 double")
    box = tuple(F.col(c) for c in b.columns)
    assert [tuple(r) for r in b.select(*cr.clamp(box, F.lit(10), F.lit(8))).collect()] == [(1, 0, 10, 8), (None,) * 4, (None,) * 4]
    assert spark.range(1).select(cr.field_confidence({"color": F.lit("red"), "vehicle_type": F.lit(None), "make": F.lit("ford"), "direction": F.lit(None)})).first()[0] == pytest.approx(0.5)
    assert b.select(cr.track_quality(box, F.lit(0.5), F.lit(900.0))).first()[0] == pytest.approx(18.1 * 12.9 * 0.5 * 500)


def test_lookups_in_time(spark):
    s = spark.createDataFrame([(1, 0, 0.0), (1, 1, 2.0), (1, 2, 2.0), (1, 3, 9.0)], "k int, pos int, t double")
    asked = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, -5.0), (1, 99.0), (2, 0.0)], "k int, at double")
    out = {(r.k, r.at): r.sample and r.sample.pos for r in tr.nearest_samples(asked, s, ["k"]).collect()}
    assert out == {(1, 1.0): 0, (1, 2.0): 1, (1, -5.0): 0, (1, 99.0): 3, (2, 0.0): None}
    clocks = spark.createDataFrame([("01:02:03",), ("x",), (None,)], "c string")
    assert [r[0] for r in clocks.select(tr.seconds_of_clock(F.col("c"))).collect()] == [3723, None, None]
