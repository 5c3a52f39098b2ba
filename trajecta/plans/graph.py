"""Node and edge tables, pattern queries over them, and keyed upserts.

Nodes: object(global_id, class, attribute columns, first_seen, last_seen),
event(event_id, type, start_time, end_time, confidence). Edges: involves(
event_id, global_id, role), seen_in(global_id, clip_id, ...), attribute(
global_id, type, value, share, winner, confidence, source, uncertain), named
object-to-object and object-to-region edges. All carry the scope's keys.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Intent:
    """What a question asks for, in the closed vocabulary."""

    attributes: dict = field(default_factory=dict)
    classes: tuple = ()
    events: tuple = ()
    counterpart: dict = field(default_factory=dict)
    region: str | None = None
    after: str | None = None
    before: str | None = None

    @property
    def constrained(self) -> bool:
        return bool(self.attributes or self.classes or self.events or self.region or self.after or self.before)


#: Attributes that a question may filter on.
FILTERABLE = ("color", "vehicle_type", "make", "direction")


def find_objects(objects: DataFrame, intent: Intent, *, involves: DataFrame | None = None, events: DataFrame | None = None, overtakes: DataFrame | None = None, crosses: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Objects that satisfy every part of the intent; existence of events (one
    of each type, as their subject), counterparts and regions by semi-joins.
    Used as a filter it has no limit."""
    df = objects
    for name, value in intent.attributes.items():
        if name in FILTERABLE:
            df = df.where(F.col(name) == value)
    if intent.classes:
        df = df.where(F.col("class").isin(*intent.classes))
    if intent.after:
        df = df.where(F.substring("last_seen", 12, 8) >= intent.after)
    if intent.before:
        df = df.where(F.substring("first_seen", 12, 8) <= intent.before)
    if intent.events:
        subject = involves.where("role = 'subject'").join(events.select("event_id", "type"), "event_id").where(F.col("type").isin(*intent.events))
        enough = subject.groupBy("global_id").agg(F.count_distinct("type").alias("n")).where(F.col("n") == len(set(intent.events)))
        df = df.join(enough, "global_id", "left_semi")
    if intent.counterpart:
        other = objects
        for name, value in intent.counterpart.items():
            if name in FILTERABLE:
                other = other.where(F.col(name) == F.lit(value))
        edges = overtakes.join(other.select(F.col("global_id").alias("object_id")), "object_id", "left_semi")
        df = df.join(edges.select(F.col("subject_id").alias("global_id")), "global_id", "left_semi")
    if intent.region:
        df = df.join(crosses.where(F.col("region_id") == intent.region), "global_id", "left_semi")
    return df if limit is None else df.orderBy("first_seen", "global_id").limit(limit)


def count_objects(found: DataFrame) -> DataFrame:
    """class, type, color, n; missing values as 'unknown'."""
    named = [F.coalesce(F.col(c), F.lit("unknown")).alias(c) for c in ("class", "vehicle_type", "color")]
    return found.groupBy(*named).agg(F.count(F.lit(1)).alias("n"))


def merge_edges(edges: DataFrame, key: list[str], order: str) -> DataFrame:
    """Upsert: of rows with one key the last stays."""
    w = Window.partitionBy(*key).orderBy(F.desc(order))
    return edges.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def attach(edges: DataFrame, nodes: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Edges whose ends all exist: (nodes, node key, edge column) each."""
    for df, key, column in nodes:
        edges = edges.join(df.select(F.col(key).alias(column)), column, "left_semi")
    return edges


def context(objects: DataFrame, attributes: DataFrame, involves: DataFrame, events: DataFrame, sightings: DataFrame, *, most_events: int = 5) -> DataFrame:
    """Everything an answer may cite about each object. Every edge table is
    aggregated to one row per object before it is joined."""
    attrs = attributes.groupBy("global_id").agg(F.array_sort(F.collect_set(F.struct("type", "value", "confidence", "winner", "uncertain"))).alias("attributes"))
    w = Window.partitionBy("global_id").orderBy("start_time", "event_id")
    own = involves.join(events, "event_id").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most_events)
    evts = own.groupBy("global_id").agg(F.array_sort(F.collect_list(F.struct("start_time", "event_id", "type", "role", "end_time", "confidence"))).alias("events"))
    seen = sightings.groupBy("global_id").agg(F.array_sort(F.collect_set("clip_id")).alias("clips"), F.min("first_seen").alias("earliest"))
    return objects.join(attrs, "global_id", "left").join(evts, "global_id", "left").join(seen, "global_id", "left")


def shortcuts(events: DataFrame) -> dict[str, DataFrame]:
    """Direct edges: OVERTAKES needs an object, CROSSES a region, STOP and PARK
    point at their first evidence frame."""
    base = ["event_id", F.col("subject_id").alias("global_id"), F.col("start_time").alias("at"), "confidence"]
    return {
        "OVERTAKES": events.where("type = 'OVERTAKE' AND object_id IS NOT NULL").select(*base, "object_id"),
        "CROSSES": events.where("type = 'CROSSES' AND metadata['region_id'] IS NOT NULL").select(*base, F.col("metadata")["region_id"].alias("region_id")),
        "STOPS_AT": events.where("type = 'STOP'").select(*base, F.try_element_at("evidence_frames", F.lit(1)).alias("frame_id")),
        "PARKED_AT": events.where("type = 'PARK'").select(*base, F.try_element_at("evidence_frames", F.lit(1)).alias("frame_id")),
    }


def attribute_edges(shares: DataFrame, final: DataFrame) -> DataFrame:
    """HAS_ATTRIBUTE: all candidates of the merged distribution; the final
    value too where it was none (share 1 without candidates, else 0). Others
    than the winner are uncertain, with confidence 0."""
    n = shares.groupBy("global_id", "attribute").agg(F.count(F.lit(1)).alias("_n"))
    won = final.where("value IS NOT NULL").select("global_id", "attribute", "value", "confidence", "source", "uncertain").withColumn("winner", F.lit(True))
    both = shares.join(won, ["global_id", "attribute", "value"], "full_outer").join(n, ["global_id", "attribute"], "left")
    winner = F.coalesce("winner", F.lit(False))
    return both.select("global_id", F.col("attribute").alias("type"), "value", F.coalesce("share", F.when(F.col("_n").isNull(), 1.0).otherwise(0.0)).alias("share"), winner.alias("winner"), F.when(winner, F.col("confidence")).otherwise(0.0).alias("confidence"), F.when(winner, F.col("source")).otherwise("clip_voting").alias("source"), F.when(winner, F.col("uncertain")).otherwise(True).alias("uncertain"))


def subgraph(objects: DataFrame, involves: DataFrame, events: DataFrame, supported: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) around the supported ids; an event shared by two objects
    is one node."""
    edges = involves.join(supported, "global_id", "left_semi")
    shown = events.join(edges.select("event_id").distinct(), "event_id", "left_semi")
    nodes = objects.join(supported, "global_id", "left_semi").select(F.col("global_id").cast("string").alias("id"), F.lit("object").alias("kind"), F.col("class").alias("label"))
    nodes = nodes.unionByName(shown.select(F.col("event_id").cast("string").alias("id"), F.lit("event").alias("kind"), F.col("type").alias("label")))
    return nodes, edges.select("event_id", "global_id", "role")
