"""Crops of tracked objects: places, clamping and quality.

Sharpness (the variance of a Laplacian) is read from pixels elsewhere and
arrives as a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Crops
from ..functions.geometry import Box, area

#: The share of confidence that a found field gives.
FIELD_WEIGHTS = {"color": 0.4, "vehicle_type": 0.3, "direction": 0.2, "make": 0.1}


def crop_path(path: Column) -> dict[str, Column]:
    """Columns clip_id, track_id, frame_id of ``../clip/track/frame.jpg``;
    nulls where the path has fewer than four parts."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    ok = F.size(parts) >= 4
    part = lambda i: F.when(ok, F.element_at(parts, i))
    return {"clip_id": part(-3), "track_id": part(-2), "frame_id": F.regexp_replace(part(-1), r"\.[^.]*$", "")}


def clamp(b: Box, width: Column, height: Column) -> Box:
    """The box in whole pixels (truncated) inside the image; null in every
    coordinate where nothing is left of it."""
    x1, y1 = (F.greatest(F.lit(0), c.cast("int")) for c in b[:2])
    x2, y2 = F.least(width, b[2].cast("int")), F.least(height, b[3].cast("int"))
    return tuple(F.when((x2 > x1) & (y2 > y1), c) for c in (x1, y1, x2, y2))


def track_quality(b: Box, confidence: Column, sharpness: Column, cfg: Crops = Crops()) -> Column:
    """Area by confidence by capped sharpness: ranks the crops of one track."""
    return area(b) * confidence * F.least(sharpness, F.lit(cfg.sharpness_cap))


def _unit(x: Column, whole: float) -> Column:
    return F.least(F.lit(1.0), x / whole)


def caption_quality(width: Column, height: Column, sharpness: Column, cfg: Crops = Crops(), *, size: float | None = None) -> Column:
    """Size by sharpness, each at most 1; 0 for crops under two pixels."""
    score = _unit(F.sqrt(width * height), size or cfg.caption_size) * _unit(sharpness, cfg.reference_sharpness)
    return F.when((width < 2) | (height < 2), 0.0).otherwise(score)


def frontality(width: Column, height: Column, cfg: Crops = Crops()) -> Column:
    """1 for crops no wider than a vehicle seen from the front, 0 from the
    side on, linear between them; 0 without height."""
    span = cfg.side_aspect - cfg.front_aspect
    seen = F.lit(1.0) if span <= 0 else F.least(F.lit(1.0), F.greatest(F.lit(0.0), (cfg.side_aspect - width / F.nullif(height, F.lit(0))) / span))
    return F.when(height <= 0, 0.0).otherwise(seen)


def shot_quality(width: Column, height: Column, sharpness: Column, occlusion: Column, cfg: Crops = Crops()) -> Column:
    """``caption_quality`` less what is hidden and what is seen from the side.
    A crop without a known occlusion counts as free."""
    view = (1 - cfg.view_weight) + cfg.view_weight * frontality(width, height, cfg)
    return caption_quality(width, height, sharpness, cfg, size=cfg.shot_size) * (1 - F.coalesce(occlusion, F.lit(0.0))) * view


def scored_shots(crops: DataFrame, occlusion: DataFrame, keys: list[str], cfg: Crops = Crops()) -> DataFrame:
    """``crops(keys.., w, h, sharpness)`` with occlusion (0 where ``occlusion``
    has none) and score; degenerate crops, of score 0, go."""
    joined = crops.join(occlusion.select(*keys, "occlusion"), keys, "left").withColumn("occlusion", F.coalesce("occlusion", F.lit(0.0)))
    return joined.withColumn("score", shot_quality(F.col("w"), F.col("h"), F.col("sharpness"), F.col("occlusion"), cfg)).where("score > 0")


def field_confidence(fields: dict[str, Column]) -> Column:
    """Weighted share of the fields that a caption gave."""
    return sum((F.when(fields[k].isNotNull(), w).otherwise(0.0) for k, w in FIELD_WEIGHTS.items()), F.lit(0.0))
