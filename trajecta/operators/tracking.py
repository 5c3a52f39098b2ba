"""Tracks of detected boxes, frame by frame."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .groups import codes, fold_groups
from .matching import hungarian


@dataclass(frozen=True)
class Tracking:
    #: A detection from this confidence on is sure; others may only go on with a track.
    sure: float = 0.25
    #: A new track begins this much above ``sure``.
    begins_above: float = 0.1
    least: float = 0.1
    #: Largest 1 - overlap of a match: of sure boxes, of unsure ones, of tracks seen once.
    far: tuple = (0.8, 0.5, 0.7)
    #: Frames that a track is looked for after it was last seen.
    lost_frames: int = 30
    #: Frames from which on a track counts.
    confirmed_after: int = 1


def overlap_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of all boxes of two lists."""
    low, high = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    inter = np.clip(high - low, 0, None).prod(axis=2)
    area = lambda x: np.clip(x[:, 2:] - x[:, :2], 0, None).prod(axis=1)
    union = area(a)[:, None] + area(b)[None, :] - inter
    return np.divide(inter, union, out=np.zeros_like(inter), where=union > 0)


#: Pairs of boxes up to which plain numbers cost less than arrays.
SMALL = 64


def _overlaps(a: list[tuple], b: list[tuple]) -> dict[tuple[int, int], float]:
    """The overlaps above 0 of ``overlap_matrix``, in its order."""
    if len(a) * len(b) > SMALL:
        m = overlap_matrix(np.array(a), np.array(b))
        return {(int(i), int(j)): float(m[i, j]) for i, j in np.argwhere(m > 0)}
    out = {}
    for i, (ax1, ay1, ax2, ay2) in enumerate(a):
        for j, (bx1, by1, bx2, by2) in enumerate(b):
            w = (ax2 if ax2 < bx2 else bx2) - (ax1 if ax1 > bx1 else bx1)
            h = (ay2 if ay2 < by2 else by2) - (ay1 if ay1 > by1 else by1)
            if w > 0 and h > 0:
                inter = w * h
                union = max(ax2 - ax1, 0.0) * max(ay2 - ay1, 0.0) + max(bx2 - bx1, 0.0) * max(by2 - by1, 0.0) - inter
                if union > 0:
                    out[i, j] = inter / union
    return out


def match(a: list[tuple], b: list[tuple], far: float) -> list[tuple[int, int]]:
    """Optimal pairs by overlap, of which those beyond ``far`` are given up.
    Boxes without any overlap take no part in the choice."""
    overlap = _overlaps(a, b)
    if len(overlap) < 2:
        return [p for p, x in overlap.items() if 1 - x <= far]
    rows, columns = sorted({i for i, _ in overlap}), sorted({j for _, j in overlap})
    if min(len(rows), len(columns)) == 1:
        pairs = [max(overlap, key=overlap.get)]
    else:
        some = np.zeros((len(rows), len(columns)))
        for (i, j), x in overlap.items():
            some[rows.index(i), columns.index(j)] = x
        pairs = [(rows[i], columns[j]) for i, j in hungarian(some)]
    return [p for p in pairs if 1 - overlap.get(p, 0.0) <= far]


class Track:
    """A box that moves on by its last velocity a frame until it is seen."""

    __slots__ = ("number", "seen", "n", "box", "speed")

    def __init__(self, number: int, frame: int, box: tuple):
        self.number, self.seen, self.n, self.box, self.speed = number, frame, 1, box, (0.0, 0.0, 0.0, 0.0)

    def expected(self, frame: int) -> tuple:
        k, (a, b, c, d), (p, q, r, s) = frame - self.seen, self.box, self.speed
        return a + p * k, b + q * k, c + r * k, d + s * k

    def see(self, frame: int, box: tuple) -> None:
        k = frame - self.seen
        self.speed = tuple([(y - x) / k for x, y in zip(self.box, box, strict=True)])
        self.seen, self.n, self.box = frame, self.n + 1, box


def update(tracks: list[Track], frame: int, boxes: list[tuple], confidence: list[float], cfg: Tracking, next_number: int) -> tuple[list[Track], list[int], int]:
    """One frame: (tracks still followed, the track's number of every box or
    -1, next free number). Sure boxes meet all tracks first, then the unsure
    ones those still seen in the frame before, then tracks seen only once take
    what is left of the sure ones; a sure box of nobody begins a track."""
    given = [-1] * len(boxes)
    sure = [i for i in range(len(boxes)) if confidence[i] >= cfg.sure]
    unsure = [i for i in range(len(boxes)) if cfg.least <= confidence[i] < cfg.sure]
    known, once = [t for t in tracks if t.n > 1], [t for t in tracks if t.n == 1]

    def stage(some: list[Track], rows: list[int], far: float) -> None:
        if some and rows:
            for i, j in match([t.expected(frame) for t in some], [boxes[r] for r in rows], far):
                some[i].see(frame, boxes[rows[j]])
                given[rows[j]] = some[i].number

    stage(known, sure, cfg.far[0])
    stage([t for t in known if t.seen == frame - 1] if unsure else [], unsure, cfg.far[1])
    stage(once, [i for i in sure if given[i] < 0], cfg.far[2])
    kept = [t for t in tracks if t.seen == frame or (t.n > 1 and frame - t.seen <= cfg.lost_frames)]
    for i in sure:
        if given[i] < 0 and confidence[i] >= cfg.sure + cfg.begins_above:
            kept.append(Track(next_number, frame, boxes[i]))
            given[i] = next_number
            next_number += 1
    return kept, given, next_number


def follow(frames: DataFrame, detections: DataFrame, cfg: Tracking = Tracking(), *, scope: tuple = ("video_id", "clip_id")) -> DataFrame:
    """``detections(scope, frame_id, id, confidence, x1, y1, x2, y2)`` that
    belong to a track, with its number ``track`` in the clip, from 1.

    ``frames(scope, frame_id)`` are all frames that were looked at, also those
    without a detection, in the order of their ids: there a track goes unseen.
    Detections of other frames count for nothing. Each clip is one ordered
    fold in a task, over boxes alone; a clip has a fixed length. Tracks of
    fewer than ``confirmed_after`` frames are left out; of equal optimal
    matches the boxes' order by id decides."""
    kinds = dict(detections.dtypes)
    rows = frames.select(*scope, "frame_id").distinct().join(detections.select(*scope, "frame_id", "id", "confidence", "x1", "y1", "x2", "y2"), [*scope, "frame_id"], "left")
    columns = [*scope, "frame_id", "id", "confidence", "x1", "y1", "x2", "y2"]
    types = {**dict(frames.dtypes), **kinds}

    def fold(pdf: pd.DataFrame, first: np.ndarray) -> pd.DataFrame:
        clip = np.repeat(np.arange(len(first)), np.diff([*first, len(pdf)]))
        frame = codes(pdf["frame_id"])
        lows = np.flatnonzero(np.concatenate(([True], (frame[1:] != frame[:-1]) | (clip[1:] != clip[:-1]))))
        sure = pdf["confidence"].to_numpy(float, na_value=np.nan)
        boxes = list(zip(*[pdf[c].to_numpy(float, na_value=np.nan).tolist() for c in ("x1", "y1", "x2", "y2")], strict=True))
        confidence, real, of = sure.tolist(), (~np.isnan(sure)).tolist(), clip[lows].tolist()
        track = np.zeros(len(pdf), np.int64)
        tracks, number, at, now = [], 1, 0, -1
        for lo, hi, c in zip(lows.tolist(), [*lows[1:].tolist(), len(pdf)], of, strict=True):
            if c != now:
                tracks, number, at, now = [], 1, 0, c
            here = [i for i in range(lo, hi) if real[i]]
            tracks, given, number = update(tracks, at, [boxes[i] for i in here], [confidence[i] for i in here], cfg, number)
            at += 1
            track[here] = given
        own = np.unique(clip * (len(pdf) + 1) + np.maximum(track, 0), return_inverse=True)[1]
        many = np.bincount(own, minlength=1)[own]
        return pdf.assign(track=track)[(track > 0) & (many >= cfg.confirmed_after)][[*columns, "track"]]

    schema = ", ".join([*[f"{c} {types[c]}" for c in columns], "track int"])
    return fold_groups(rows, list(scope), ["frame_id", "id"], fold, schema)


def track_summary(tracked: DataFrame, *, scope: tuple = ("video_id", "clip_id")) -> DataFrame:
    """(scope, track, n, first, last, mean_confidence)."""
    return tracked.groupBy(*scope, "track").agg(F.count(F.lit(1)).alias("n"), F.min("frame_id").alias("first"), F.max("frame_id").alias("last"), F.avg("confidence").alias("mean_confidence"))
