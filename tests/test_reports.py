"""Evaluation reports on small cases worked by hand."""

import pytest
from pyspark.sql import functions as F

from trajecta.functions.text import latex_escape, latex_escaped
from trajecta.plans import report as rp
from trajecta.sources.importers import UNREVIEWED, reviewed

VIDEOS = [("v1", True, True), ("v2", False, True), ("v3", True, False), ("v4", True, True)]


@pytest.fixture(scope="module")
def videos(spark):
    return spark.createDataFrame(VIDEOS, "video string, has_truth boolean, has_final boolean")


def test_accuracy_has_a_reason_for_every_gap(spark, videos):
    rows = [("v1", "color", "red", "red", False), ("v1", "color", "red", "blue", False), ("v1", "make", "kia", "kia", True), ("v2", "color", None, "red", False), ("v4", "color", None, "red", False)]
    df = rp.accuracy_report(spark.createDataFrame(rows, "video string, attribute string, truth string, value string, uncertain boolean"), videos, ["video"])
    got = {(r.video, r.row, r.metric): (r.value, r.reason) for r in df.collect()}
    assert got["v1", "color", "precision"] == (0.5, None) and got["v1", "make", "precision"] == (None, rp.NO_ANSWER) and got["v1", "make", "coverage"] == (0.0, None)
    assert {v: got[v, None, None] for v in ("v2", "v3", "v4")} == {"v2": (None, rp.NO_TRUTH), "v3": (None, rp.NO_FINAL), "v4": (None, rp.NO_VALUES)}
    assert all((v is None) != (r is None) for v, r in got.values())


def test_failed_questions_spoil_no_other(spark):
    runs = spark.createDataFrame([("v1", "ours", None), ("v1", "ours", "TimeoutError"), ("v1", "plain", "ValueError")], "video string, system string, error string")
    summary = spark.createDataFrame([("v1", "ours", 1, None, 0.75, 1.0, 1.0)], "video string, system string, n_questions long, counting_accuracy double, object_f1 double, abstention_accuracy double, grounded_rate double")
    got = {(r.row, r.metric): (r.value, r.reason) for r in rp.answer_report(summary, runs, ["video"]).collect()}
    assert got["ours", "failed"] == (1.0, None) and got["ours", "object_f1"] == (0.75, None) and got["ours", "counting_accuracy"] == (None, "no counting question ran")
    assert got["plain", "questions"] == (0.0, None) and got["plain", "failed"] == (1.0, None)
    assert {got["plain", m] for m in ("object_f1", "grounded_rate", "counting_accuracy")} == {(None, "every question failed")}


def test_corrections(spark, videos):
    log = spark.createDataFrame([("v1", "filled"), ("v1", "filled"), ("v1", "other")], "video string, outcome string")
    got = {(r.video, r.row): (r.value, r.reason) for r in rp.correction_report(log, videos, ["video"]).collect()}
    assert got["v1", "filled"] == (2.0, None) and got["v4", "retained"] == (0.0, None) and got["v3", None] == (None, rp.NO_FINAL)


def test_documents(spark, videos):
    rows = spark.createDataFrame([("v1", "a_b", "x", "x", False)], "video string, attribute string, truth string, value string, uncertain boolean")
    docs = {r.video: r.document for r in rp.latex(rp.accuracy_report(rows, videos, ["video"], label="50 % & more"), ["video"]).collect()}
    assert r"a\_b & 1 & 0 & 0 & 1 & 1 \\" in docs["v1"] and r"\caption{50 \% \& more}" in docs["v1"] and r"\begin{tabular}{lrrrrr}" in docs["v1"]
    assert "Not available: " + rp.NO_TRUTH in docs["v2"] and "tabular" not in docs["v2"]
    odd = "a\\b~c^d&e%f$g#h_i{j}é"
    assert spark.range(1).select(latex_escaped(F.lit(odd))).first()[0] == latex_escape(odd)


def test_counts_come_with_the_write(spark, tmp_path):
    df = spark.range(100).withColumn("kind", F.col("id") % 3)
    back, counts = rp.write_counted(df, str(tmp_path / "t"), {"rows": F.count(F.lit(1)), "zero": F.count_if(F.col("kind") == 0)})
    assert counts == {"rows": 100, "zero": 34} and back.count() == 100


def test_reviewed(spark, tmp_path):
    schema = "video_id string, frames long"
    assert reviewed(spark, str(tmp_path / "none.json"), schema).count() == 0
    (tmp_path / "a.json").write_text('{"video_id": "v1",\n "frames": 3}')
    assert [tuple(r) for r in reviewed(spark, str(tmp_path / "a.json"), schema).collect()] == [("v1", 3)]
    (tmp_path / "b.json").write_text('{"video_id": "v2", "%s": {"why": "template"}}' % UNREVIEWED)
    with pytest.raises(ValueError, match="b.json"):
        reviewed(spark, str(tmp_path / "*.json"), schema)
