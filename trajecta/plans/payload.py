"""The graph of many videos as tables, published together.

``graph_payload`` shapes every table from the stages' rows with joins on
(video_id, local id); ends are uids ``video_id:local_id``. ``publish`` writes
all tables of a version, checks the ends of their edges, and only then swaps
the manifest that says which version holds each video: a build that fails
leaves readers where they were, and other videos are not rewritten.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import attribute_edges

ATTRIBUTES = ("color", "vehicle_type", "make", "model", "direction")
#: Event types with an edge of their own.
SHORTCUTS = {"OVERTAKE": "OVERTAKES", "STOP": "STOPS_AT", "PARK": "PARKED_AT", "CROSSES": "CROSSES"}
#: Edge tables: (end's column, tables that may hold the end).
ENDS = {
    "attribute_edges": (("object_uid", ("objects",)),),
    "clip_sightings": (("object_uid", ("objects",)), ("clip_uid", ("clips",))),
    "frame_sightings": (("object_uid", ("objects",)), ("frame_uid", ("frames",))),
    "event_roles": (("event_uid", ("events",)), ("object_uid", ("objects",))),
    "shortcut_edges": (("from_uid", ("objects",)), ("to_uid", ("objects", "locations", "frames"))),
    "moved_to": (("object_uid", ("objects",)), ("location_uid", ("locations",))),
}


def uid(local: str, video: str = "video_id") -> Column:
    """The key of a local id within its video; null for a null id."""
    return F.concat(F.col(video).cast("string"), F.lit(":"), F.col(local).cast("string"))


def _objects(objects: DataFrame, sightings: DataFrame, final: DataFrame, attributes: tuple) -> DataFrame:
    """One node an object with its attributes spread over columns; both sides
    are aggregated before they meet it."""
    key = ["video_id", "global_id"]
    seen = sightings.groupBy(*key).agg(F.count(F.lit(1)).alias("n_sightings"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    picked = [F.max_by(F.struct("value", "confidence", "source", "uncertain"), F.when(F.col("attribute") == a, 1)).alias(f"_{a}") for a in attributes]
    spread = final.groupBy(*key).agg(*picked)
    columns = []
    for a in attributes:
        f = F.col(f"_{a}")
        columns += [f["value"].alias(a), F.coalesce(f["confidence"], F.lit(0.0)).alias(f"{a}_confidence"), F.coalesce(f["source"], F.lit("unconfirmed")).alias(f"{a}_source"), F.coalesce(f["uncertain"], F.lit(True)).alias(f"{a}_uncertain")]
    both = objects.join(seen, key, "left").join(spread, key, "left")
    label = F.when(F.col("class") == "person", "Person").otherwise("Vehicle")
    return both.select(uid("global_id").alias("uid"), *key, "class", label.alias("label"), F.coalesce("n_sightings", F.lit(0)).alias("n_sightings"), "first_seen", "last_seen", *columns)


def _shortcuts(events: DataFrame, frames: DataFrame) -> DataFrame:
    """An overtaking points at its object, a crossing at its region, a stop or
    parking at its first evidence frame, if that is a frame of the video."""
    rel = F.create_map(*[F.lit(x) for pair in SHORTCUTS.items() for x in pair])
    kind = F.when((F.col("type") == "OVERTAKE") & F.col("object_id").isNotNull(), "object").when(F.col("type") == "CROSSES", "location").otherwise("frame")
    region = F.nullif(F.try_element_at("metadata", F.lit("region_id")), F.lit(""))
    first = F.try_element_at("evidence_frames", F.lit(1))
    e = events.where(F.col("type").isin(*SHORTCUTS)).withColumns({"to_kind": kind, "rel": F.try_element_at(rel, F.col("type"))})
    e = e.withColumn("_to", F.when(F.col("to_kind") == "object", F.col("object_id").cast("string")).when(F.col("to_kind") == "location", region).otherwise(first)).where("_to IS NOT NULL")
    columns = ["video_id", "rel", uid("subject_id").alias("from_uid"), uid("_to").alias("to_uid"), "to_kind", "event_id", F.col("start_time").alias("at"), F.col("end_time").alias("end"), "confidence"]
    stills = e.where("to_kind = 'frame'").join(frames.select("video_id", F.col("frame_id").alias("_to")), ["video_id", "_to"], "left_semi")
    return e.where("to_kind <> 'frame'").select(*columns).unionByName(stills.select(*columns))


def _moves(events: DataFrame) -> DataFrame:
    """The regions that an object entered, in order, repeats in a row once."""
    region = F.nullif(F.try_element_at("metadata", F.lit("region_id")), F.lit(""))
    entered = events.where("type = 'CROSSES'").withColumn("region_id", region).where("region_id IS NOT NULL")
    w = Window.partitionBy("video_id", "subject_id").orderBy("start_time", "region_id", "event_id")
    changed = entered.withColumn("_last", F.lag("region_id").over(w)).where("_last IS NULL OR _last <> region_id")
    return changed.select("video_id", uid("subject_id").alias("object_uid"), uid("region_id").alias("location_uid"), F.row_number().over(w).alias("order"))


def graph_payload(
    videos: DataFrame, clips: DataFrame, frames: DataFrame, objects: DataFrame, sightings: DataFrame, samples: DataFrame, events: DataFrame, regions: DataFrame, *, final: DataFrame, shares: DataFrame, attributes: tuple = ATTRIBUTES, meta: tuple = ("region_id",)
) -> dict[str, DataFrame]:
    """All node and edge tables of all videos in the input.

    ``objects(video_id, global_id, class)``, ``sightings(.., clip_id, track_id,
    first_seen, last_seen)``, ``samples(video_id, clip_id, track_id, frame_id,
    bbox)``, ``events(video_id, event_id, type, subject_id, object_id,
    start_time, end_time, confidence, evidence_frames, metadata)``,
    ``final(video_id, global_id, attribute, value, confidence, source,
    uncertain)`` and ``shares(.., attribute, value, share)``; without
    confirmed attributes ``final`` is empty and objects are unconfirmed.
    ``meta`` lists the metadata that become columns ``meta_*`` of an event.
    Samples of tracks or frames that are not there make no edge.
    """
    own = objects.select(uid("global_id").alias("global_id"), "video_id")
    edges = attribute_edges(*[df.where(F.col("attribute").isin(*attributes)).withColumn("global_id", uid("global_id")) for df in (shares, final)]).join(own, "global_id")
    track = ["video_id", "clip_id", "track_id"]
    seen = samples.join(sightings.select(*track, "global_id"), track).join(frames.select("video_id", "frame_id"), ["video_id", "frame_id"], "left_semi")
    roles = events.select("video_id", uid("event_id").alias("event_uid"), F.explode(F.array(F.struct(uid("subject_id").alias("object_uid"), F.lit("subject").alias("role")), F.struct(uid("object_id").alias("object_uid"), F.lit("object").alias("role")))).alias("r"))
    return {
        "video": videos,
        "clips": clips.withColumn("uid", uid("clip_id")),
        "frames": frames.withColumns({"uid": uid("frame_id"), "clip_uid": uid("clip_id")}).drop("clip_id"),
        "objects": _objects(objects, sightings, final, attributes),
        "attribute_edges": edges.select("video_id", F.col("global_id").alias("object_uid"), F.concat_ws(":", "type", "value").alias("key"), "type", "value", F.round("share", 6).alias("share"), "winner", "confidence", "source", "uncertain"),
        "clip_sightings": sightings.select("video_id", uid("global_id").alias("object_uid"), uid("clip_id").alias("clip_uid"), "track_id", "first_seen", "last_seen"),
        "frame_sightings": seen.select("video_id", uid("global_id").alias("object_uid"), uid("frame_id").alias("frame_uid"), "bbox"),
        "locations": regions.select(uid("region_id").alias("uid"), "video_id", "region_id", "region_type"),
        "events": events.select(uid("event_id").alias("uid"), "video_id", "event_id", "type", "start_time", "end_time", "confidence", "evidence_frames", *[F.try_element_at("metadata", F.lit(m)).alias(f"meta_{m}") for m in meta]),
        "event_roles": roles.select("video_id", "event_uid", "r.*").where("object_uid IS NOT NULL"),
        "shortcut_edges": _shortcuts(events, frames),
        "moved_to": _moves(events),
    }


def counts(payload: dict[str, DataFrame]) -> DataFrame:
    """(video_id, table, n): rows of each table and video."""
    out = None
    for name, df in payload.items():
        one = df.groupBy("video_id").agg(F.count(F.lit(1)).alias("n")).select("video_id", F.lit(name).alias("table"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def loose_ends(payload: dict[str, DataFrame]) -> DataFrame:
    """(table, end, uid): ends of edges that are in none of their node tables."""
    out = None
    for name, ends in ENDS.items():
        for column, tables in ends:
            loose = payload[name].select("video_id", F.col(column).alias("uid"))
            for t in tables:
                # a uid begins with its video, so a video's edges meet its own nodes only
                loose = loose.join(payload[t].select("uid"), "uid", "left_anti")
            one = loose.select(F.lit(name).alias("table"), F.lit(column).alias("end"), "uid")
            out = one if out is None else out.unionByName(one)
    return out


def _manifests(spark: SparkSession, path: str) -> list[str]:
    """Complete manifests, oldest first."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/*/_SUCCESS")
    found = at.getFileSystem(sc._jsc.hadoopConfiguration()).globStatus(at)
    return sorted(str(f.getPath().getParent()) for f in found or [])


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, version) of the last complete manifest; empty before one."""
    found = _manifests(spark, path)
    schema = "video_id string, version string"
    return spark.read.schema(schema).parquet(found[-1]) if found else spark.createDataFrame([], schema)


def publish(payload: dict[str, DataFrame], path: str) -> str:
    """Write a new version of the payload's videos below ``path`` and make it
    the one that is read, returned by name. Loose ends are an error that leaves
    the published version as it was. One builder publishes at a time: two that
    number a manifest alike meet the writer's own error."""
    spark = payload["video"].sparkSession
    last = _manifests(spark, path)
    number = int(last[-1].rsplit("/", 1)[1]) + 1 if last else 1
    version = f"v{number:08d}-{uuid.uuid4().hex[:8]}"
    stored = {}
    for name, df in payload.items():
        df = df.withColumn("video_id", F.col("video_id").cast("string"))
        df.write.parquet(f"{path}/{name}/version={version}")
        stored[name] = spark.read.schema(df.schema).parquet(f"{path}/{name}/version={version}")
    loose = loose_ends(stored).limit(5).collect()
    if loose:
        raise ValueError(f"edges without an end, nothing published: {[tuple(r) for r in loose]}")
    built = stored["video"].select("video_id").distinct()
    rest = manifest(spark, path).join(built, "video_id", "left_anti")
    rest.unionByName(built.withColumn("version", F.lit(version))).write.mode("error").parquet(f"{path}/manifest/{number:08d}")
    return version


def published(spark: SparkSession, path: str, table: str) -> DataFrame:
    """The rows of a table in the published versions of all videos; files of
    other versions are pruned by partition."""
    rows = spark.read.option("basePath", f"{path}/{table}").parquet(f"{path}/{table}")
    return rows.join(manifest(spark, path), ["video_id", "version"], "left_semi").drop("version")
