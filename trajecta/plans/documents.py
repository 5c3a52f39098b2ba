"""Sentences, metadata and vectors of objects and events, and answer context.

Objects: (global_id, class, color, make, vehicle_type, direction, first_seen,
last_seen, n_clips), attributes already confirmed or null. Events: (event_id,
type, subject_id, object_id, start_time, end_time, confidence, detail), where
``detail`` is a turn's direction or a crossed region. Times are ISO strings. A
document holds everything of its object, so a row of the result is as long as
the object's history is; nothing else meets in one place.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions.text import article, pluralize, time_of

#: Fixed values.
EVENT_TYPES = ("STOP", "PARK", "TURN", "OVERTAKE", "LANE_CHANGE", "CROSSES")
NOTHING_FOUND = "No objects matching that description were found in this footage."
ANY_VEHICLE = "another vehicle"
DIMENSIONS = 256


def confirmed(attributes: DataFrame, names: tuple = ("color", "make", "vehicle_type", "direction")) -> DataFrame:
    """One row per object with a column per attribute: its first certain,
    non-empty winning value, or null. ``attributes``: (global_id, attribute,
    value, uncertain)."""
    sure = attributes.where(~F.coalesce("uncertain", F.lit(False)) & (F.coalesce("value", F.lit("")) != ""))
    return sure.groupBy("global_id").agg(*[F.min(F.when(F.col("attribute") == n, F.col("value"))).alias(n) for n in names])


def _capital(c: str) -> Column:
    value = F.nullif(F.col(c), F.lit(""))
    return F.concat(F.upper(F.substring(value, 1, 1)), F.lower(F.expr(f"substring({c}, 2)")))


def descriptor() -> Column:
    """As specific as the confirmed attributes allow; else the class."""
    return F.concat_ws(" ", _capital("color"), _capital("make"), F.coalesce(F.nullif(F.col("vehicle_type"), F.lit("")), "class"))


def participation(events: DataFrame) -> DataFrame:
    """(global_id, role, the event's columns): subjects and objects by two
    projections, no join on either-or. Who is both is the subject."""
    subject = events.select(F.col("subject_id").alias("global_id"), F.lit("subject").alias("role"), "*")
    other = events.where("object_id IS NOT NULL AND NOT (object_id <=> subject_id)").select(F.col("object_id").alias("global_id"), F.lit("object").alias("role"), "*")
    return subject.unionByName(other)


def described(events: DataFrame, objects: DataFrame) -> DataFrame:
    """Events with the descriptors of both ends, null where there is none."""
    names = objects.select("global_id", descriptor().alias("d"))
    for end in ("subject", "object"):
        events = events.join(names.select(F.col("global_id").alias(f"{end}_id"), F.col("d").alias(f"{end}_descriptor")), f"{end}_id", "left")
    return events


def _other(column: str) -> Column:
    return article(F.lower(F.coalesce(column, F.lit(ANY_VEHICLE))))


def event_phrase() -> Column:
    """The event from its subject's side; null for types without a phrase."""
    kind, detail = F.col("type"), F.nullif(F.col("detail"), F.lit(""))
    return (
        F.when(kind == "OVERTAKE", F.concat(F.lit("overtook "), _other("object_descriptor")))
        .when(kind == "STOP", F.lit("stopped"))
        .when(kind == "PARK", F.lit("parked"))
        .when(kind == "TURN", F.concat_ws(" ", F.lit("turned"), detail))
        .when(kind == "LANE_CHANGE", F.lit("changed lanes"))
        .when(kind == "CROSSES", F.concat(F.lit("crossed "), F.coalesce(detail, F.lit("a marked line"))))
    )


def event_summaries(events: DataFrame, objects: DataFrame) -> DataFrame:
    """(event_id, document): one sentence per event."""
    general = F.concat(F.lit("was involved in a "), F.lower("type"), F.lit(" event"))
    sentence = F.concat(F.coalesce("subject_descriptor", F.lit("A vehicle")), F.lit(" "), F.coalesce(event_phrase(), general), F.lit(" at "), time_of(F.col("start_time")), F.lit("."))
    return described(events, objects).select("event_id", sentence.alias("document"))


def object_summaries(objects: DataFrame, events: DataFrame) -> DataFrame:
    """(global_id, document): the descriptor, where it was seen first, and its
    events in order of time. One without events tells its span instead."""
    passive = F.when(F.col("type") == "OVERTAKE", F.concat(F.lit("was overtaken by "), _other("subject_descriptor")))
    phrase = F.when(F.col("role") == "subject", event_phrase()).otherwise(passive)
    rows = participation(described(events, objects)).withColumn("clause", F.concat(phrase, F.lit(" at "), time_of(F.col("start_time"))))
    told = rows.groupBy("global_id").agg(F.array_sort(F.collect_list(F.when(F.col("clause").isNotNull(), F.struct("start_time", "event_id", "clause")))).alias("told"))
    first, last = time_of(F.col("first_seen")), time_of(F.col("last_seen"))
    heading = F.concat_ws(" heading ", F.concat(F.lit("first seen "), first), F.nullif(F.col("direction"), F.lit("")))
    span = F.concat(F.lit("seen from "), first, F.lit(" to "), last)
    seen = F.when(F.col("first_seen").isNull(), None).when(F.col("told").isNull() & (F.col("last_seen") != F.col("first_seen")), span).otherwise(heading)
    clauses = F.transform("told", lambda s: s["clause"])
    document = F.concat(F.concat_ws(", ", descriptor(), seen, clauses), F.lit("."))
    return objects.join(told, "global_id", "left").select("global_id", document.alias("document"))


def object_metadata(objects: DataFrame, events: DataFrame) -> DataFrame:
    """Scalars to filter by. event_X: whether the object was the subject of an
    X; n_events counts either role."""
    rows = participation(events)
    flags = [F.bool_or((F.col("role") == "subject") & (F.col("type") == t)).alias(f"event_{t}") for t in EVENT_TYPES]
    own = rows.groupBy("global_id").agg(F.count(F.lit(1)).alias("n_events"), *flags)
    named = [F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown")).alias(c) for c in ("color", "make", "vehicle_type", "direction")]
    times = [F.coalesce(c, F.lit("")).alias(c) for c in ("first_seen", "last_seen")]
    kept = [F.coalesce(f"event_{t}", F.lit(False)).alias(f"event_{t}") for t in EVENT_TYPES]
    return objects.join(own, "global_id", "left").select("global_id", "class", *named, *times, "n_clips", F.coalesce("n_events", F.lit(0)).cast("long").alias("n_events"), *kept)


def event_metadata(events: DataFrame, objects: DataFrame) -> DataFrame:
    subject = objects.select(F.col("global_id").alias("subject_id"), F.nullif(F.col("color"), F.lit("")).alias("subject_color"), F.col("class").alias("subject_class"))
    named = [F.coalesce(c, F.lit("unknown")).alias(c) for c in ("subject_color", "subject_class")]
    return events.join(subject, "subject_id", "left").select("event_id", "type", "subject_id", F.coalesce(F.col("object_id").cast("string"), F.lit("")).alias("object_id"), *named, "start_time", "end_time", "confidence")


def _hashed(texts: list[str]) -> np.ndarray:
    """Signed counts of character trigrams by crc32, as unit rows."""
    out = np.zeros((len(texts), DIMENSIONS))
    for row, text in zip(out, texts, strict=True):
        low = f"  {text.lower()} "
        for i in range(len(low) - 2):
            h = zlib.crc32(low[i : i + 3].encode())
            row[h % DIMENSIONS] += 1 if h >> 31 else -1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=out, where=norm > 0)


def embed(documents: DataFrame, *, text: str = "document", model=_hashed) -> DataFrame:
    """``documents`` with ``vector``. ``model`` turns a list of texts into rows
    of numbers and can be any embedder; the default needs none. A null text is
    read as an empty one."""
    rest = documents.drop("vector")
    schema = StructType([*rest.schema.fields, StructField("vector", ArrayType(DoubleType()))])
    at = rest.columns.index(text)

    def run(batches):
        for b in batches:
            rows = model([t or "" for t in b.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([list(map(float, r)) for r in rows], pa.list_(pa.float64()))], [*b.schema.names, "vector"])

    return rest.mapInArrow(run, schema)


def count_answer(breakdown: DataFrame, keys: tuple = ()) -> DataFrame:
    """``breakdown(keys.., class, vehicle_type, color, n)`` as one sentence per
    key, largest groups first; an empty breakdown has no row (NOTHING_FOUND)."""
    known = lambda c: F.when(~F.coalesce(c, F.lit("")).isin("", "unknown"), F.col(c))
    noun = F.coalesce(known("vehicle_type"), "class", F.lit("object"))
    part = F.concat_ws(" ", F.col("n").cast("string"), known("color"), pluralize(noun, F.col("n")))
    rows = breakdown.select(*keys, "n", F.struct((-F.col("n")).alias("o"), part.alias("part")).alias("s"))
    all_ = rows.groupBy(*keys).agg(F.sum("n").alias("count"), F.transform(F.array_sort(F.collect_list("s")), lambda s: s["part"]).alias("parts"))
    text = F.concat(F.lit("The footage contains "), F.col("count").cast("string"), F.lit(" matching "), pluralize(F.lit("object"), F.col("count")), F.lit(" in total: "), F.array_join("parts", ", "), F.lit("."))
    return all_.where("count > 0").select(*keys, "count", text.alias("answer"))


def context_blocks(objects: DataFrame) -> DataFrame:
    """``plans.graph.context`` rows as (global_id, block, valid_times): the
    lines an answer is written from, and exactly the times they show."""
    sure = F.filter("attributes", lambda a: a["winner"] & ~F.coalesce(a["uncertain"], F.lit(False)))
    facts = F.transform(sure, lambda a: F.concat(a["type"], F.lit("="), a["value"], F.lit(" (confidence "), F.format_string("%.2f", F.coalesce(a["confidence"], F.lit(0.0))), F.lit(")")))
    clock = lambda c: F.coalesce(time_of(F.nullif(c, F.lit(""))), F.lit("unknown"))
    cite = lambda at: F.concat(F.lit("["), F.col("global_id").cast("string"), F.lit(" @ "), at, F.lit("]"))
    line = lambda e: F.concat(F.lit("    event: "), e["type"], F.lit(" (as "), F.coalesce(e["role"], F.lit("subject")), F.lit(") "), cite(clock(e["start_time"])), F.lit(" to "), clock(e["end_time"]))
    events = F.coalesce("events", F.expr("cast(array() as array<struct<start_time:string,event_id:bigint,type:string,role:string,end_time:string,confidence:double>>)"))
    first = time_of(F.nullif(F.col("earliest"), F.lit("")))
    head = F.concat(F.lit("- "), F.col("global_id").cast("string"), F.lit(" ("), F.col("class"), F.lit("):"))
    parts = [F.when(F.size(facts) > 0, F.concat(F.lit("    attributes: "), F.array_join(facts, ", "))), F.when(F.size("clips") > 0, F.concat(F.lit("    seen in clips: "), F.array_join("clips", ", "))), F.concat(F.lit("    first seen: "), cite(first))]
    times = F.array_distinct(F.flatten(F.array(F.array_compact(F.array(first)), F.transform(events, lambda e: clock(e["start_time"])), F.transform(events, lambda e: clock(e["end_time"])))))
    return objects.select("global_id", F.concat_ws("\n", head, *parts, F.transform(events, line)).alias("block"), F.array_sort(times).alias("valid_times"))


def timestamp_spans(cited: DataFrame, events: DataFrame) -> DataFrame:
    """``cited(answer_id, global_id, at)``, once each, as (.., start, end): the
    first own event that starts then gives its end, else a point in time."""
    own = events.select("global_id", time_of(F.col("start_time")).alias("at"), F.struct("start_time", "event_id", F.coalesce(time_of(F.col("end_time")), F.lit("unknown")).alias("end")).alias("e"))
    ends = own.groupBy("global_id", "at").agg(F.min("e").alias("e"))
    return cited.select("answer_id", "global_id", "at").distinct().join(ends, ["global_id", "at"], "left").select("answer_id", "global_id", F.col("at").alias("start"), F.coalesce("e.end", "at").alias("end"))
