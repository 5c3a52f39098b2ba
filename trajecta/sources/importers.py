"""Readers of annotation and artifact formats."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Class numbers of the CSV format, names of the XML format.
MOT_CLASSES = {1: "person", 3: "car", 4: "car", 5: "truck", 6: "bus"}
#: The second is the body type that a name asserts, if any.
DETRAC_CLASSES = {"car": ("car", None), "van": ("car", "van"), "bus": ("bus", "bus"), "truck": ("truck", "truck"), "others": ("car", None)}

MOT_SCHEMA = "frame int, id int, x double, y double, w double, h double, conf double, class int, visibility double"
GT_SCHEMA = "gt_id string, frame_no int, class string, x1 double, y1 double, x2 double, y2 double"

ARTIFACTS = {
    "frame": "video_id string, clip_id string, frame_id string, frame_path string, video_timestamp_sec double, wallclock_time string, fps double, width int, height int",
    "clip": "video_id string, clip_id string, clip_path string, start_wallclock string, end_wallclock string, fps double",
    "detection": "video_id string, clip_id string, frame_id string, class string, x1 double, y1 double, x2 double, y2 double, confidence double",
    "track_sample": "video_id string, clip_id string, track_id string, pos int, frame_id string, t double, x double, y double, x1 double, y1 double, x2 double, y2 double",
    "frame_attr": "track_id string, frame_id string, color string, vehicle_type string, make string, model string, direction string, confidence double, crop_quality double, occlusion double, from_retry boolean",
    "event": "event_id string, type string, subject_id string, object_id string, start_time string, end_time string, confidence double, evidence_frames array<string>, metadata map<string,string>",
    "region": "region_id string, region_type string, points array<struct<x:double,y:double>>",
    "qa_item": "question_id string, question string, question_type string, expected_count int, expected_gt_ids array<string>, answerable boolean",
}


def artifact(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """JSON documents of one kind; a malformed one is an error."""
    return spark.read.schema(ARTIFACTS[kind]).option("multiLine", True).option("mode", "FAILFAST").json(path)


#: Fixed value: the key of a document that nobody has corrected yet.
UNREVIEWED = "REMOVE_THIS_KEY_ONCE_REVIEWED"


def reviewed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents of ground truth or questions, one a file: no rows where
    ``path`` (a file, a folder or a pattern) does not exist, an error where a
    document still has the key of unreviewed templates or is malformed."""
    try:
        raw = spark.read.schema(f"{schema}, `{UNREVIEWED}` string").option("multiLine", True).option("mode", "FAILFAST").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    left = raw.where(F.col(UNREVIEWED).isNotNull()).select(F.input_file_name().alias("file")).distinct().orderBy("file").take(5)
    if left:
        raise ValueError(f"unreviewed templates, correct them and delete {UNREVIEWED}: " + ", ".join(r.file for r in left))
    return raw.drop(UNREVIEWED)


def save(df: DataFrame, path: str, *, scope: tuple = ("video_id",)) -> None:
    """Replace the rows of exactly the scopes in ``df`` (a video's artifacts
    are rewritten as a whole), other scopes stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*scope).parquet(path)


def append_new(df: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``df`` whose key is not there yet, one per key: cache misses
    before the work, cache puts after it."""
    return df.dropDuplicates(key).join(existing.select(*key), key, "left_anti")


def mot(spark: SparkSession, path: str, *, offset: int = -1) -> DataFrame:
    """CSV boxes (frame, id, x, y, w, h[, conf, class, visibility]) as ground
    truth rows with ``class`` null where unmapped; ``conf`` 0 marks rows to
    ignore; frames are rebased by ``offset``."""
    raw = spark.read.schema(MOT_SCHEMA).option("comment", "#").option("mode", "PERMISSIVE").csv(path)
    classes = F.create_map(*[F.lit(x) for k, v in MOT_CLASSES.items() for x in (k, v)])
    number = F.when(F.col("class").isNull() | (F.col("class") == -1), 3).otherwise(F.col("class"))
    return raw.select(F.concat(F.lit("gt_"), F.col("id").cast("string")).alias("gt_id"), (F.col("frame") + offset).alias("frame_no"), F.try_element_at(classes, number).alias("class"), F.round("x", 2).alias("x1"), F.round("y", 2).alias("y1"), F.round(F.col("x") + F.col("w"), 2).alias("x2"), F.round(F.col("y") + F.col("h"), 2).alias("y2"), (F.coalesce("conf", F.lit(1.0)) == 0).alias("ignored"))


def detrac(spark: SparkSession, path: str, *, offset: int = -1) -> DataFrame:
    """XML boxes: frame@num / target_list / target@id / box, attribute. Unknown
    and missing names are cars; ``vehicle_type`` is the body type, or null."""
    schema = "_num int, target_list struct<target:array<struct<_id:int,box:struct<_left:double,_top:double,_width:double,_height:double>,attribute:struct<_vehicle_type:string>>>>"
    raw = spark.read.format("xml").option("rowTag", "frame").schema(schema).load(path)
    t = raw.select("_num", F.explode("target_list.target").alias("t"))
    name = F.lower(F.coalesce(F.nullif("t.attribute._vehicle_type", F.lit("")), F.lit("car")))
    classes, bodies = (F.create_map(*[F.lit(x) for k, v in DETRAC_CLASSES.items() for x in (k, v[i])]) for i in (0, 1))
    b = "t.box._"
    return t.select(F.concat(F.lit("gt_"), F.col("t._id").cast("string")).alias("gt_id"), (F.col("_num") + offset).alias("frame_no"), F.coalesce(F.try_element_at(classes, name), F.lit("car")).alias("class"), F.round(f"{b}left", 2).alias("x1"), F.round(f"{b}top", 2).alias("y1"), F.round(F.col(f"{b}left") + F.col(f"{b}width"), 2).alias("x2"), F.round(F.col(f"{b}top") + F.col(f"{b}height"), 2).alias("y2"), F.lit(False).alias("ignored"), F.try_element_at(bodies, name).alias("vehicle_type"))


def align(truth: DataFrame, frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(boxes on sampled frames, one-row report). ``frames(frame_id)`` ends in
    the frame's number. An unmapped class counts as that, not as a frame miss."""
    number = F.regexp_extract("frame_id", r"(\d+)$", 1).cast("int")
    joined = truth.join(frames.select(number.alias("frame_no"), "frame_id"), "frame_no", "left")
    ok = ~F.col("ignored") & F.col("class").isNotNull()
    kept = joined.where(ok & F.col("frame_id").isNotNull())
    report = joined.agg(F.count_if("ignored").alias("ignored"), F.count_if(~F.col("ignored") & F.col("class").isNull()).alias("unmapped"), F.count_if(ok & F.col("frame_id").isNull()).alias("unsampled"), F.count_if(ok & F.col("frame_id").isNotNull()).alias("kept"), (F.count_distinct("gt_id") - F.count_distinct(F.when(ok & F.col("frame_id").isNotNull(), F.col("gt_id")))).alias("vanished"))
    return kept, report


def regions(spark: SparkSession, path: str) -> DataFrame:
    """YAML with ``lines`` and ``regions``: a hand-drawn list, read on the
    driver. Columns region_id, points."""
    import yaml

    text = spark.read.text(path, wholetext=True).first()[0]
    doc = yaml.safe_load(text) or {}
    rows = [(str(r["id"]), [(float(x), float(y)) for x, y in r["points"]]) for k in ("lines", "regions") for r in doc.get(k) or []]
    return spark.createDataFrame(rows, "region_id string, points array<struct<x:double,y:double>>")
