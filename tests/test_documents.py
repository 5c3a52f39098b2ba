"""Sentences, metadata, vectors and answer context of objects and events."""

import pytest
from pyspark.sql import functions as F

from trajecta.functions.text import is_abstention, pluralize
from trajecta.plans import documents as doc

OBJECT = "global_id string, class string, color string, make string, vehicle_type string, direction string, first_seen string, last_seen string, n_clips int"
EVENT = "event_id long, type string, subject_id string, object_id string, start_time string, end_time string, confidence double, detail string"


@pytest.fixture(scope="module")
def objects(spark):
    day = "2024-01-01T"
    rows = [("a", "car", "white", "toyota", "sedan", "east", day + "11:02:10.5", day + "11:06:00", 2), ("b", "truck", "orange", None, None, None, day + "11:00:00", day + "11:09:00", 1), ("c", "person", None, None, "", None, None, None, 0), ("d", "bus", None, None, None, "west", day + "10:00:00", day + "10:05:00", 1)]
    return spark.createDataFrame(rows, OBJECT)


@pytest.fixture(scope="module")
def events(spark):
    at = "2024-01-01T11:0"
    rows = [(1, "OVERTAKE", "a", "b", at + "4:20", at + "4:25", 0.9, None), (2, "STOP", "a", None, at + "5:42", at + "5:50", 0.8, None), (3, "OVERTAKE", "z", None, at + "6:00", at + "6:01", 0.7, None), (4, "OVERTAKE", "a", "a", at + "7:00", at + "7:01", 0.7, None), (5, "CROSSES", "b", None, at + "8:00", None, 0.7, "line 1"), (6, "MERGE", "b", None, at + "9:00", None, None, None)]
    return spark.createDataFrame(rows, EVENT)


def _map(df, key, value="document"):
    return {r[key]: r[value] for r in df.collect()}


def test_object_summaries(objects, events):
    assert _map(doc.object_summaries(objects, events), "global_id") == {
        "a": "White Toyota sedan, first seen 11:02:10 heading east, overtook an orange truck at 11:04:20, stopped at 11:05:42, overtook a white toyota sedan at 11:07:00.",
        "b": "Orange truck, first seen 11:00:00, was overtaken by a white toyota sedan at 11:04:20, crossed line 1 at 11:08:00.",
        "c": "person.",
        "d": "bus, seen from 10:00:00 to 10:05:00.",
    }


def test_event_summaries(objects, events):
    found = _map(doc.event_summaries(events, objects), "event_id")
    assert found[1] == "White Toyota sedan overtook an orange truck at 11:04:20."
    assert found[3] == "A vehicle overtook an another vehicle at 11:06:00."
    assert found[6] == "Orange truck was involved in a merge event at 11:09:00."


def test_metadata_flags_subjects_only(objects, events):
    found = {r["global_id"]: r for r in doc.object_metadata(objects, events).collect()}
    assert found["a"]["event_OVERTAKE"] and found["a"]["n_events"] == 3
    assert not found["b"]["event_OVERTAKE"] and found["b"]["n_events"] == 3
    assert found["c"]["n_events"] == 0 and found["c"]["first_seen"] == "" and found["c"]["vehicle_type"] == "unknown"
    e = {r["event_id"]: r for r in doc.event_metadata(events, objects).collect()}
    assert e[3]["subject_class"] == "unknown" and e[3]["object_id"] == "" and e[1]["subject_color"] == "white"


def test_empty_tables(objects, events):
    none, nobody = events.where("false"), objects.where("false")
    assert doc.object_summaries(nobody, events).count() == 0
    assert doc.event_summaries(none, objects).count() == 0
    assert doc.object_metadata(objects, none).where("n_events = 0").count() == 4
    assert doc.embed(doc.object_summaries(nobody, none)).count() == 0


def test_confirmed_takes_certain_values(spark):
    rows = [("a", "color", "red", False), ("a", "make", "ford", True), ("a", "direction", "", False), ("b", "color", None, None)]
    df = spark.createDataFrame(rows, "global_id string, attribute string, value string, uncertain boolean")
    assert [tuple(r) for r in doc.confirmed(df).collect()] == [("a", "red", None, None, None)]


def test_embedding_is_a_function_of_the_text(spark):
    df = spark.createDataFrame([(1, "red car"), (2, "red car"), (3, "red cars"), (4, "blue bus"), (5, None)], "id int, document string").repartition(3)
    v = _map(doc.embed(df), "id", "vector")
    dot = lambda a, b: sum(x * y for x, y in zip(v[a], v[b], strict=True))
    assert v[1] == v[2] and abs(dot(1, 1) - 1) < 1e-9 and dot(1, 3) > dot(1, 4)
    assert _map(doc.embed(df, model=lambda texts: [[len(t)] for t in texts]), "id", "vector")[5] == [0.0]


def test_count_answer(spark):
    rows = [("car", "unknown", "red", 1), ("bus", None, None, 2), ("person", "unknown", "unknown", 3)]
    df = spark.createDataFrame(rows, "class string, vehicle_type string, color string, n long")
    assert doc.count_answer(df).first()["answer"] == "The footage contains 6 matching objects in total: 3 people, 2 buses, 1 red car."
    assert doc.count_answer(df.where("false")).count() == 0


def test_abstentions_and_plurals(spark):
    r = spark.range(1).select(is_abstention(F.lit("There is NOT enough information.")).alias("a"), is_abstention(F.lit("Two cars.")).alias("b"), pluralize(F.lit("bus"), F.lit(2)).alias("c"), pluralize(F.lit("box"), F.lit(2)).alias("d")).first()
    assert tuple(r) == (True, False, "buses", "boxs")
