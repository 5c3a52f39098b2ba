"""Detections of frames: admission and suppression of overlapping boxes."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import box, iou
from ..session import cut
from .groups import fold_groups

COORDINATES = ("x1", "y1", "x2", "y2")


def admitted(detections: DataFrame, classes: list[str] | tuple, *, least: float = 0.25) -> DataFrame:
    """Detections of the wanted classes with enough confidence; null class or
    confidence is not admitted."""
    return detections.where(F.col("class").isin(*classes) & (F.col("confidence") >= least))


def overlaps(boxes: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """(keys, a, b): pairs of boxes of one group whose overlap (intersection
    over union) is above ``threshold``, ``a`` the surer one: by confidence,
    then by the smaller id. ``boxes(keys, id, confidence, x1, y1, x2, y2)``.

    Boxes that overlap so much differ in size by at most 1 / threshold, so they
    touch a common cell of the grid whose cells are as wide as the larger of
    them, rounded up to a power of two; a box lies in four cells of each of the
    few grids that can matter. A crowded frame is thus no join of all with
    all, and boxes without area meet nobody."""
    reach = math.ceil(math.log2(1 / threshold))
    size = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    placed = boxes.select(*keys, "id", "confidence", *COORDINATES).where((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))
    level = F.ceil(F.log2(size)).cast("int")
    placed = placed.withColumn("own", level).withColumn("level", F.explode(F.sequence(F.col("own"), F.col("own") + reach)))
    cell = F.pow(F.lit(2.0), F.col("level"))
    steps = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))
    placed = placed.withColumn("cx", F.explode(steps("x1", "x2"))).withColumn("cy", F.explode(steps("y1", "y2")))
    side = lambda s: placed.select(*keys, "level", "cx", "cy", *[F.col(c).alias(f"{s}_{c}") for c in ("id", "confidence", "own", *COORDINATES)])
    pairs = side("a").join(side("b"), [*keys, "level", "cx", "cy"])
    first = (F.col("a_confidence") > F.col("b_confidence")) | ((F.col("a_confidence") == F.col("b_confidence")) & (F.col("a_id") < F.col("b_id")))
    pairs = pairs.where(first & (F.col("level") == F.greatest("a_own", "b_own")) & (iou(box("a_"), box("b_")) > threshold))
    # a pair meets in every cell both touch; it counts where their overlap begins
    cell = F.pow(F.lit(2.0), F.col("level"))
    begins = (F.col("cx") == F.floor(F.greatest("a_x1", "b_x1") / cell)) & (F.col("cy") == F.floor(F.greatest("a_y1", "b_y1") / cell))
    return pairs.where(begins).select(*keys, F.col("a_id").alias("a"), F.col("b_id").alias("b"))


def surest(boxes: np.ndarray, threshold: float) -> np.ndarray:
    """Which boxes, the surest first, sequential suppression keeps."""
    x1, y1, x2, y2 = boxes.T
    area = (x2 - x1) * (y2 - y1)
    kept, left = np.zeros(len(boxes), bool), np.arange(len(boxes))
    while len(left):
        i, left = left[0], left[1:]
        kept[i] = True
        inter = np.maximum(0.0, np.minimum(x2[i], x2[left]) - np.maximum(x1[i], x1[left])) * np.maximum(0.0, np.minimum(y2[i], y2[left]) - np.maximum(y1[i], y1[left]))
        left = left[~(inter / (area[i] + area[left] - inter) > threshold)]
    return kept


def _gone(boxes: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """(keys, id) of the suppressed boxes, many groups a call."""
    kinds = dict(boxes.dtypes)

    def fold(pdf: pd.DataFrame, first: np.ndarray) -> pd.DataFrame:
        group = np.repeat(np.arange(len(first)), np.diff([*first, len(pdf)]))
        sure = pdf["confidence"].to_numpy(float)
        # as Spark orders them: not-a-number first; equal ones stay in the order of ids
        order = np.lexsort((-np.nan_to_num(sure, nan=0.0, posinf=np.inf, neginf=-np.inf), ~np.isnan(sure), group))
        at = pdf[list(COORDINATES)].to_numpy(float)[order]
        kept = np.concatenate([surest(at[lo:hi], threshold) for lo, hi in zip(first, [*first[1:], len(pdf)], strict=True)])
        return pdf.iloc[order[~kept]][[*keys, "id"]]

    return fold_groups(boxes, keys, ["id"], fold, ", ".join(f"{c} {kinds[c]}" for c in [*keys, "id"]))


def suppress(boxes: DataFrame, keys: list[str], *, threshold: float = 0.7, largest: int = 4096) -> DataFrame:
    """``boxes`` with ``kept``: greedy suppression of overlapping boxes in each
    group of ``keys`` (a frame and class), where the surest box stays and those
    that overlap it by more than ``threshold`` go, then the next one, and so on.

    A group of at most ``largest`` boxes is done by that rule in a task, many
    groups a call. Of a larger one the same boxes stay in rounds: a box that no
    undecided surer one overlaps is kept, and what it overlaps goes; boxes
    without an overlap are never looked at. Ids are distinct in a group; boxes
    without confidence or area are kept."""
    some = boxes.where((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))).dropna(subset=["id", *keys]).where("confidence IS NOT NULL").select(*keys, "id", "confidence", *COORDINATES)
    large = cut(some.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > largest).select(*keys))
    if large.isEmpty():
        gone = _gone(some, keys, threshold)
        links = None
    else:
        gone = _gone(some.join(large, keys, "left_anti"), keys, threshold)
        links = cut(overlaps(some.join(large, keys, "left_semi"), keys, threshold))
    left = links
    while left is not None and not left.isEmpty():
        losers = left.select(*keys, F.col("b").alias("a")).distinct()
        top = left.select(*keys, "a").distinct().join(losers, [*keys, "a"], "left_anti")
        out = cut(left.join(top, [*keys, "a"], "left_semi").select(*keys, F.col("b").alias("id")).distinct())
        gone = gone.unionByName(out)
        end = lambda c: out.withColumnRenamed("id", c)  # noqa: E731, B023
        left = cut(left.join(end("a"), [*keys, "a"], "left_anti").join(end("b"), [*keys, "b"], "left_anti"))
    return boxes.join(gone.withColumn("_gone", F.lit(True)), [*keys, "id"], "left").withColumn("kept", F.col("_gone").isNull()).drop("_gone")
