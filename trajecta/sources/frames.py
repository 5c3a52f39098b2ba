"""Frames of videos: an index from their metadata, and decoding by ranges."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import prepare

#: Frames that one call of a decoder is asked for at most.
RANGE = 4096


def frame_ranges(videos: DataFrame, *, every_seconds: float = 0.5, frames: int = RANGE, between: tuple[int, int] | None = None) -> DataFrame:
    """``videos(video_id, n_frames, fps, ..)`` cut into ranges (lo, hi, step) of
    at most ``frames`` frames, lo and hi included and multiples of the sampling
    step, so that a long video is many rows and a wanted span ``between`` two
    frame numbers touches no other. Steps round half to even; videos without
    frames or a frame rate have no ranges."""
    known = videos.where("n_frames > 0 AND fps > 0").withColumn("step", F.greatest(F.lit(1), F.rint(F.lit(every_seconds) * F.col("fps")).cast("long")))
    first, last = (F.lit(0), F.col("n_frames") - 1) if between is None else (F.greatest(F.lit(0), F.lit(between[0])), F.least(F.lit(between[1]), F.col("n_frames") - 1))
    lo, hi = F.ceil(first / F.col("step")) * F.col("step"), F.floor(last / F.col("step")) * F.col("step")
    size = F.greatest(F.lit(1), F.floor(F.lit(frames) / F.col("step"))) * F.col("step")
    cut = known.withColumns({"_lo": lo.cast("long"), "_hi": hi.cast("long"), "_size": size.cast("long")}).where("_lo <= _hi")
    cut = cut.withColumn("lo", F.explode(F.sequence("_lo", "_hi", "_size")))
    return cut.withColumn("hi", F.least(F.col("_hi"), F.col("lo") + F.col("_size") - F.col("step"))).drop("_lo", "_hi", "_size")


def frame_index(videos: DataFrame, *, clip_seconds: float = 30.0, every_seconds: float = 0.5, between: tuple[int, int] | None = None) -> DataFrame:
    """One row a sampled frame: video_id, clip_id, frame_id, frame_no, t
    (seconds of the video) and wallclock, ``start`` plus t. Made from the
    metadata alone, range by range."""
    each = frame_ranges(videos, every_seconds=every_seconds, between=between).withColumn("frame_no", F.explode(F.sequence("lo", "hi", "step")))
    clip = F.greatest(F.lit(1), F.rint(F.lit(clip_seconds) * F.col("fps")).cast("long"))
    t = F.col("frame_no") / F.col("fps")
    wall = F.timestamp_micros(F.unix_micros(F.col("start").cast("timestamp")) + F.rint(t * 1_000_000).cast("long"))
    return each.select("video_id", F.format_string("clip_%03d", F.floor(F.col("frame_no") / clip)).alias("clip_id"), F.format_string("frame_%06d", F.col("frame_no")).alias("frame_id"), "frame_no", t.alias("t"), wall.alias("wallclock"))


def clip_manifest(videos: DataFrame, *, clip_seconds: float = 30.0) -> DataFrame:
    """One row a clip: first and last frame read, sampled or not, with their
    wall clocks; the last clip ends with the video's last frame."""
    clip = F.greatest(F.lit(1), F.rint(F.lit(clip_seconds) * F.col("fps")).cast("long"))
    known = videos.where("n_frames > 0 AND fps > 0").withColumn("clip", clip)
    each = known.withColumn("no", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_frames") - 1) / F.col("clip")))))
    each = each.withColumns({"first": (F.col("no") * F.col("clip")).cast("long"), "last": F.least((F.col("no") + 1) * F.col("clip"), F.col("n_frames")).cast("long") - 1})
    wall = lambda c: F.timestamp_micros(F.unix_micros(F.col("start").cast("timestamp")) + F.rint(F.col(c) / F.col("fps") * 1_000_000).cast("long"))
    return each.select("video_id", F.format_string("clip_%03d", F.col("no")).alias("clip_id"), "first", "last", wall("first").alias("start_wallclock"), wall("last").alias("end_wallclock"))


def decoded(ranges: DataFrame, decoder: Callable[[str, int, int, int], Iterator[tuple[int, bytes]]], *, path: str = "path") -> DataFrame:
    """(video_id, frame_no, image) by a plug-in ``decoder(path, lo, hi, step)``,
    called once a range of ``frame_ranges`` where the range is, so that no
    video is opened for frames that nobody asked for. The path is handed on as
    it is: a decoder opens what its store can open."""
    prepare(ranges.sparkSession)
    kind = dict(ranges.dtypes)["video_id"]

    def run(batches):
        for b in batches:
            for video, where, lo, hi, step in zip(*(b.column(c).to_pylist() for c in ("video_id", "path", "lo", "hi", "step")), strict=True):
                for no, image in decoder(where, lo, hi, step):
                    yield pa.RecordBatch.from_arrays([pa.array([video], b.column("video_id").type), pa.array([no], pa.int64()), pa.array([image], pa.binary())], ["video_id", "frame_no", "image"])

    rows = ranges.select("video_id", F.col(path).cast("string").alias("path"), "lo", "hi", "step")
    return rows.mapInArrow(run, f"video_id {kind}, frame_no long, image binary")
