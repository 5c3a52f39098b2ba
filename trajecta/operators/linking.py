"""Gated joins that link track fragments within and across clips.

Gates are a CASE chain: a failed pair carries the first gate that rejects it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Association, Linking
from ..functions.geometry import box, diagonal, iou, prediction_error
from ..functions.vectors import cosine
from .matching import assign, best_pairs, chains, greedy


def _sides(tracks: DataFrame, columns: list[str], keys: list[str]) -> tuple[DataFrame, DataFrame]:
    return tuple(tracks.select(*keys, *[F.col(c).alias(f"{s}_{c}") for c in columns]) for s in ("a", "b"))


def fragment_pairs(tracks: DataFrame, cfg: Association = Association(), *, scope: tuple = ("video_id", "clip_id")) -> DataFrame:
    """All ordered pairs of fragments of one clip that pass the temporal gate,
    with failed_gate (class, motion, appearance or null) and scores.

    ``tracks``: scope, track, class, t_first, t_last, head_x .. tail boxes
    (head_x1 .., tail_x1 ..), exit_vx, exit_vy, stationary, embedding. The
    range condition runs on time buckets of the largest gap.
    """
    cols = ["track", "class", "t_first", "t_last", "exit_vx", "exit_vy", "stationary", "embedding", *[f"{p}_{c}" for p in ("head", "tail") for c in ("x1", "y1", "x2", "y2")]]
    a, b = _sides(tracks, cols, list(scope))
    size = cfg.max_gap
    a = a.withColumn("_k", F.explode(F.array(F.floor(F.col("a_t_last") / size), F.floor(F.col("a_t_last") / size) + 1)))
    b = b.withColumn("_k", F.floor(F.col("b_t_first") / size))
    gap = F.col("b_t_first") - F.col("a_t_last")
    pairs = a.join(b, [*scope, "_k"]).where((F.col("a_track") != F.col("b_track")) & (gap > 0) & (gap <= size)).drop("_k")
    tail, head = box("a_tail_"), box("b_head_")
    mid = lambda q: ((q[0] + q[2]) / 2, (q[1] + q[3]) / 2)
    error = prediction_error(*mid(tail), F.col("a_exit_vx"), F.col("a_exit_vy"), gap, *mid(head), diagonal(tail))
    still = F.col("a_stationary") & F.col("b_stationary")
    df = pairs.withColumns({"gap": gap, "motion_error": F.when(~still, error), "overlap": F.when(still, iou(tail, head)), "cosine": cosine(F.col("a_embedding"), F.col("b_embedding"))})
    moved = F.when(still, F.col("overlap") < cfg.stationary_iou).otherwise(F.col("motion_error") > cfg.max_error)
    failed = F.when(F.col("a_class") != F.col("b_class"), "class").when(moved, "motion").when(F.col("cosine") < cfg.min_cosine, "appearance")
    motion = F.when(still, F.col("overlap")).otherwise(1 / (1 + F.col("motion_error")))
    w = cfg.weights
    score = w[0] * F.col("cosine") + w[1] * motion + w[2] * (1 - F.col("gap") / cfg.max_gap)
    return df.select(*scope, F.col("a_track").alias("a"), F.col("b_track").alias("b"), "gap", "motion_error", "cosine", failed.alias("failed_gate"), F.when(failed.isNull(), F.round(score, 9)).alias("score"))


def associate(pairs: DataFrame, *, scope: tuple = ("video_id", "clip_id")) -> DataFrame:
    """``fragment_pairs`` -> with status: accepted, suppressed (passed the
    gates, lost to a better link) or rejected."""
    passed = greedy(pairs.where("failed_gate IS NULL").select(*scope, "a", "b", "score"), list(scope))
    df = pairs.join(passed.select(*scope, "a", "b", "accepted"), [*scope, "a", "b"], "left")
    return df.withColumn("status", F.when(F.col("failed_gate").isNotNull(), "rejected").when(F.col("accepted"), "accepted").otherwise("suppressed")).drop("accepted")


def clip_pairs(tracks: DataFrame, cfg: Linking = Linking(), *, attributes: tuple = ("color", "vehicle_type", "make", "model")) -> DataFrame:
    """Pairs of tracks in clips at most ``clip_distance`` apart, all logged.

    ``tracks``: video_id, clip_no, track, class, t_first, t_last, x/y of both
    ends, exit_vx, exit_vy, diag, embedding and the certain attribute values
    (null where uncertain)."""
    cols = ["clip_no", "track", "class", "t_first", "t_last", "x_first", "y_first", "x_last", "y_last", "exit_vx", "exit_vy", "diag", "embedding", *attributes]
    a, b = _sides(tracks, cols, ["video_id"])
    a = a.withColumn("b_clip_no", F.explode(F.array(*[F.col("a_clip_no") + d for d in range(1, cfg.clip_distance + 1)])))
    pairs = a.join(b, ["video_id", "b_clip_no"])
    both = [F.col(f"a_{c}").isNotNull() & F.col(f"b_{c}").isNotNull() for c in attributes]
    same = [x & (F.col(f"a_{c}") == F.col(f"b_{c}")) for x, c in zip(both, attributes, strict=True)]
    count = lambda xs: sum((F.coalesce(x, F.lit(False)).cast("int") for x in xs), F.lit(0))
    gap = F.col("b_t_first") - F.col("a_t_last")
    error = prediction_error(F.col("a_x_last"), F.col("a_y_last"), F.col("a_exit_vx"), F.col("a_exit_vy"), gap, F.col("b_x_first"), F.col("b_y_first"), F.col("a_diag"))
    df = pairs.withColumns({"gap": gap, "comparable": count(both), "agreed": count(same), "motion_error": error, "cosine": cosine(F.col("a_embedding"), F.col("b_embedding"))})
    failed = F.when(F.col("a_class") != F.col("b_class"), "class").when(F.col("agreed") < F.col("comparable"), "semantic").when((F.col("gap") <= 0) | (F.col("gap") > cfg.max_gap) | (F.col("motion_error") > cfg.max_error), "motion").when(F.col("cosine") < cfg.min_cosine, "appearance")
    semantic = F.when(F.col("comparable") == 0, 1.0).otherwise(F.col("agreed") / F.col("comparable"))
    w = cfg.weights
    score = w[0] * F.col("cosine") + w[1] / (1 + F.col("motion_error")) + w[2] * semantic
    return df.select("video_id", F.col("a_clip_no").alias("clip_no"), "b_clip_no", F.col("a_track").alias("a"), F.col("b_track").alias("b"), "gap", "motion_error", "cosine", semantic.alias("semantic"), failed.alias("failed_gate"), F.when(failed.isNull(), F.round(score, 9)).alias("score"))


def link_clips(pairs: DataFrame, distance: int = 1) -> DataFrame:
    """Optimal assignment between clips: (video_id, clip_no, a, b, score).

    At distance 1 no pair of clips disturbs another and all are solved in
    parallel. Beyond, a video's pairs of clips are solved in the order of the
    first, then the second clip, each without the ends that earlier ones took,
    in one task a video."""
    good = pairs.where("failed_gate IS NULL")
    if distance == 1:
        return assign(good.where("b_clip_no - clip_no = 1"), ["video_id", "clip_no"])
    kinds = dict(good.dtypes)
    columns = ["video_id", "clip_no", "a", "b", "score"]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out, left, right = [], set(), set()
        for _, part in pdf.groupby(["clip_no", "b_clip_no"], sort=True):
            part = part[~part["a"].isin(left) & ~part["b"].isin(right)]
            if len(part):
                won = best_pairs(part)
                left.update(won["a"])
                right.update(won["b"])
                out.append(won)
        return pd.concat(out)[columns] if out else pdf.iloc[:0][columns]

    near = good.where((F.col("b_clip_no") - F.col("clip_no")).between(1, distance)).select(*columns, "b_clip_no")
    return near.groupBy("video_id").applyInPandas(fold, ", ".join(f"{c} {kinds[c]}" for c in columns))


def global_ids(tracks: DataFrame, links: DataFrame) -> DataFrame:
    """(video_id, track, global_id): chains of links, numbered by their
    earliest member (t_first, clip_no, track). ``links(video_id, a, b)``; track
    ids are unique in a video."""
    ends = [F.struct("video_id", F.col(c).alias("track")).alias(c) for c in ("a", "b")]
    head = chains(links.select(*ends)).select("node.video_id", "node.track", F.col("head.track").alias("head"))
    member = tracks.join(head, ["video_id", "track"], "left").withColumn("head", F.coalesce("head", "track"))
    first = member.groupBy("video_id", "head").agg(F.min(F.struct("t_first", "clip_no", "track")).alias("k"))
    ids = first.withColumn("global_id", F.format_string("obj_%04d", F.row_number().over(Window.partitionBy("video_id").orderBy("k"))))
    return member.join(ids.drop("k"), ["video_id", "head"]).select("video_id", "track", "global_id")
