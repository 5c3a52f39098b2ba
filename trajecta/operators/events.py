"""Rule-based events over trajectories: (obj, pos, t, x, y, speed, heading)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Events
from ..functions.geometry import along, clip01, in_polygon, segments_cross, turn
from .groups import fold_groups


def stops(traj: DataFrame, cfg: Events = Events(), *, key: str = "obj") -> DataFrame:
    """STOP and PARK: maximal runs of slow samples that last long enough; a
    run that reaches the trajectory's end is a PARK. Gaps and islands, one
    sort per object."""
    w = Window.partitionBy(key).orderBy("pos")
    slow = F.col("speed") < cfg.stop_speed
    marked = traj.withColumns({"_slow": slow, "_new": (slow & ~F.coalesce(F.lag(slow).over(w), F.lit(False))).cast("int"), "_end": F.max("pos").over(Window.partitionBy(key))})
    runs = marked.withColumn("_run", F.sum("_new").over(w)).where("_slow").groupBy(key, "_run").agg(F.min("t").alias("start_t"), F.max("t").alias("end_t"), F.min("pos").alias("start_pos"), F.max("pos").alias("end_pos"), F.avg("speed").alias("_avg"), F.max("_end").alias("_end"))
    long = runs.withColumn("duration", F.col("end_t") - F.col("start_t")).where(F.col("duration") >= cfg.stop_seconds)
    confidence = (clip01(1 - F.col("_avg") / cfg.stop_speed) + clip01(F.col("duration") / (2 * cfg.stop_seconds))) / 2
    kind = F.when(F.col("end_pos") == F.col("_end"), "PARK").otherwise("STOP")
    return long.select(key, kind.alias("type"), "start_t", "end_t", "start_pos", "end_pos", "duration", confidence.alias("confidence"))


def candidate_windows(traj: DataFrame, test: Callable[[dict, dict], Column], shortest: float, longest: float, moving: float, *, key: str = "obj", bucket: float | None = None) -> DataFrame:
    """(obj, i, j): for each moving sample i the first moving j with the time
    difference within bounds that passes ``test``. The pairs come from an
    equi-join on time buckets as long as the window, never from all pairs."""
    size = bucket or longest
    cols = ["pos", "t", "x", "y", "speed", "heading"]
    live = traj.where(F.col("speed") >= moving).select(key, *cols)
    a = live.select(key, *[F.col(c).alias(f"a_{c}") for c in cols], F.floor(F.col("t") / size).alias("_b"))
    b = live.select(key, *[F.col(c).alias(f"b_{c}") for c in cols], F.explode(F.array(F.floor(F.col("t") / size), F.floor(F.col("t") / size) - 1)).alias("_b"))
    dt = F.col("b_t") - F.col("a_t")
    pairs = a.join(b, [key, "_b"]).where((F.col("b_pos") > F.col("a_pos")) & (dt >= shortest) & (dt <= longest))
    passed = pairs.where(test({c: F.col(f"a_{c}") for c in cols}, {c: F.col(f"b_{c}") for c in cols}))
    return passed.groupBy(key, F.col("a_pos").alias("i")).agg(F.min("b_pos").alias("j"))


def thin(candidates: DataFrame, *, key: str = "obj") -> DataFrame:
    """Greedy choice of non-overlapping windows: the first start, then the
    first start after its end, and so on. Order-dependent, so one pass over
    the objects' candidates in order, many objects a call."""
    kinds = dict(candidates.dtypes)

    def choose(pdf: pd.DataFrame, first: np.ndarray) -> pd.DataFrame:
        i, j, opens, keep, end = pdf["i"].tolist(), pdf["j"].tolist(), set(first.tolist()), [], None
        for at in range(len(i)):
            if at in opens or i[at] > end:
                keep.append(at)
                end = j[at]
        return pdf.iloc[keep]

    return fold_groups(candidates.select(key, "i", "j"), [key], ["i"], choose, f"{key} {kinds[key]}, i {kinds['i']}, j {kinds['j']}")


def _spans(traj: DataFrame, windows: DataFrame, key: str) -> DataFrame:
    """Windows (key, i, j) with both ends' samples as a_* and b_*."""
    cols = ["t", "x", "y", "heading"]
    a, b = (traj.select(key, F.col("pos").alias(p), *[F.col(c).alias(f"{s}_{c}") for c in cols]) for s, p in (("a", "i"), ("b", "j")))
    return windows.join(a, [key, "i"]).join(b, [key, "j"])


def turns(traj: DataFrame, cfg: Events = Events(), *, key: str = "obj") -> DataFrame:
    """TURN: (key, i, j, start_t, end_t, confidence), the heading changed by
    ``turn_degrees`` or more; twice that is certain."""
    found = candidate_windows(traj, lambda a, b: F.abs(turn(a["heading"], b["heading"])) >= cfg.turn_degrees, *cfg.turn_window, cfg.moving_speed, key=key)
    spans = _spans(traj, thin(found, key=key), key)
    confidence = clip01(F.abs(turn(F.col("a_heading"), F.col("b_heading"))) / (2 * cfg.turn_degrees))
    return spans.select(key, "i", "j", F.col("a_t").alias("start_t"), F.col("b_t").alias("end_t"), confidence.alias("confidence"))


def lane_changes(traj: DataFrame, cfg: Events = Events(), *, key: str = "obj") -> DataFrame:
    """LANE_CHANGE: (key, i, j, start_t, end_t, lateral, confidence). Onward
    along the first heading and ``lane_pixels`` or more to its side, while the
    heading changes by less than ``lane_degrees``."""

    def moved(a, b):
        return along(b["x"] - a["x"], b["y"] - a["y"], a["heading"])

    def test(a, b):
        onward, lateral = moved(a, b)
        return (F.abs(turn(a["heading"], b["heading"])) < cfg.lane_degrees) & (onward > 0) & (lateral >= cfg.lane_pixels)

    found = candidate_windows(traj, test, *cfg.lane_window, cfg.moving_speed, key=key)
    spans = _spans(traj, thin(found, key=key), key)
    lateral = moved(*({c: F.col(f"{s}_{c}") for c in ("x", "y", "heading")} for s in ("a", "b")))[1]
    return spans.select(key, "i", "j", F.col("a_t").alias("start_t"), F.col("b_t").alias("end_t"), lateral.alias("lateral"), clip01(lateral / (2 * cfg.lane_pixels)).alias("confidence"))


def event_log(traj: DataFrame, regions: DataFrame | None = None, cfg: Events = Events(), *, key: str = "obj") -> DataFrame:
    """All events of single objects as one table: (key, type, start_t, end_t,
    confidence, region_id). Overtakes, which have two objects, come apart."""
    none = F.lit(None).cast("string").alias("region_id")
    columns = [key, "type", "start_t", "end_t", "confidence"]
    log = stops(traj, cfg, key=key).select(*columns, none)
    for name, found in (("TURN", turns(traj, cfg, key=key)), ("LANE_CHANGE", lane_changes(traj, cfg, key=key))):
        log = log.unionByName(found.withColumn("type", F.lit(name)).select(*columns, none))
    if regions is not None:
        crossed = crossings(traj, regions, key=key).withColumns({"type": F.lit("CROSSES"), "confidence": F.lit(1.0)})
        log = log.unionByName(crossed.select(*columns, "region_id"))
    return log


def crossings(traj: DataFrame, regions: DataFrame, *, key: str = "obj") -> DataFrame:
    """CROSSES between consecutive samples. ``regions(region_id, points)``:
    two points are a line, more a polygon (then ``direction`` enter or exit).
    Regions are drawn by hand, a bounded list that is broadcast."""
    w = Window.partitionBy(key).orderBy("pos")
    steps = traj.select(key, "pos", "t", "x", "y", F.lead("t").over(w).alias("t2"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2")).where("t2 IS NOT NULL")
    both = steps.join(F.broadcast(regions), F.lit(True))
    p = [F.col("points")[i] for i in (0, 1)]
    line = segments_cross((F.col("x"), F.col("y")), (F.col("x2"), F.col("y2")), *((q["x"], q["y"]) for q in p))
    a, b = in_polygon(F.col("x"), F.col("y"), F.col("points")), in_polygon(F.col("x2"), F.col("y2"), F.col("points"))
    is_line = F.size("points") == 2
    hit = F.when(is_line, line).otherwise(a != b)
    direction = F.when(~is_line, F.when(b, "enter").otherwise("exit"))
    return both.where(hit).select(key, "region_id", F.col("t").alias("start_t"), F.col("t2").alias("end_t"), "pos", direction.alias("direction"))


def overlapping_pairs(spans: DataFrame, bucket: float, *, key: str = "obj") -> DataFrame:
    """Unordered pairs of objects whose [t_first, t_last] overlap, through
    time buckets; (a, b) in (t_first, key) order."""
    long = spans.select(key, "t_first", "t_last", F.explode(F.sequence(F.floor(F.col("t_first") / bucket), F.floor(F.col("t_last") / bucket))).alias("_b"))
    a = long.select(F.col(key).alias("a"), F.col("t_first").alias("a_first"), F.col("t_last").alias("a_last"), "_b")
    b = long.select(F.col(key).alias("b"), F.col("t_first").alias("b_first"), F.col("t_last").alias("b_last"), "_b")
    pairs = a.join(b, "_b").where(F.struct("a_first", "a") < F.struct("b_first", "b"))
    start, end = F.greatest("a_first", "b_first"), F.least("a_last", "b_last")
    # a pair meets in every bucket both touch; it counts in the first one
    return pairs.where((end > start) & (F.col("_b") == F.floor(start / bucket))).select("a", "b", start.alias("start_t"), end.alias("end_t"))


def _overtake(a: pd.DataFrame, b: pd.DataFrame, cfg: Events) -> list[tuple]:
    start, end = max(a.t.min(), b.t.min()), min(a.t.max(), b.t.max())
    if end <= start:
        return []
    inside = [d[(d.t >= start) & (d.t <= end)] for d in (a, b)]

    def mean(h):
        h = np.radians(h.dropna().to_numpy())
        return np.degrees(np.arctan2(np.sin(h).mean(), np.cos(h).mean())) if len(h) else None

    heads = [mean(d.heading) for d in inside]
    if None in heads or abs((heads[1] - heads[0] + 180) % 360 - 180) > cfg.overtake_degrees:
        return []
    axis = np.radians(mean(pd.concat([d.heading for d in inside])))
    line = np.unique(np.concatenate([d.t.to_numpy() for d in inside]))
    if len(line) < 2:
        return []
    pos = [[np.interp(line, d.t, d[c]) for c in ("x", "y")] for d in (a, b)]
    dx, dy = pos[0][0] - pos[1][0], pos[0][1] - pos[1][1]
    lon = dx * np.cos(axis) + dy * np.sin(axis)
    lat = np.hypot(dx - lon * np.cos(axis), dy - lon * np.sin(axis))
    side, widest = np.where(lon > 0, 1, -1), np.maximum.accumulate(lat)
    out, k = [], 1
    while k < len(line):
        if side[k] == side[k - 1]:
            k += 1
            continue
        last = k
        while last + 1 < len(line) and side[last + 1] == side[k] and line[last] - line[k] < cfg.overtake_seconds:
            last += 1
        held = line[last] - line[k] >= cfg.overtake_seconds or last == len(line) - 1
        if held and widest[k] >= cfg.overtake_pixels:
            sure = min(1.0, max(0.0, abs(lon[last]) / (2 * widest[k])))
            out.append((bool(side[k] > 0), float(line[k - 1]), float(line[last]), float(sure)))
        k = last + 1
    return out


def overtakes(traj: DataFrame, cfg: Events = Events(), *, bucket: float = 60.0, key: str = "obj") -> DataFrame:
    """OVERTAKE: (subject, object, start_t, end_t, confidence). Pairs that
    share time are found by bucketed join; the sign-change scan with its skips
    runs once per pair over the two trajectories."""
    spans = traj.groupBy(key).agg(F.min("t").alias("t_first"), F.max("t").alias("t_last"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    pairs = overlapping_pairs(spans, bucket, key=key).select("a", "b")
    cols = ["t", "x", "y", "heading", "pos"]
    kind = dict(traj.dtypes)[key]
    sides = [pairs.join(traj.select(F.col(key).alias(s), *cols), s).select("a", "b", F.lit(s).alias("_side"), *cols) for s in ("a", "b")]

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        one, two = (pdf[pdf._side == s].sort_values(["t", "pos"]).reset_index(drop=True) for s in ("a", "b"))
        a, b = pdf["a"].iloc[0], pdf["b"].iloc[0]
        return pd.DataFrame([(a if first else b, b if first else a, *rest) for first, *rest in _overtake(one, two, cfg)], columns=["subject", "object", "start_t", "end_t", "confidence"])

    return sides[0].unionByName(sides[1]).groupBy("a", "b").applyInPandas(scan, f"subject {kind}, object {kind}, start_t double, end_t double, confidence double")


def number_events(events: DataFrame, *, scope: list[str]) -> DataFrame:
    """evt_%05d within ``scope`` by (start_time, type, subject, object)."""
    w = Window.partitionBy(*scope).orderBy("start_time", "type", "subject_id", F.coalesce("object_id", F.lit("")))
    return events.withColumn("event_id", F.format_string("evt_%05d", F.row_number().over(w)))


def moved_to(crosses: DataFrame, *, key: str = "obj") -> DataFrame:
    """The regions an object reached, consecutive repeats collapsed, numbered."""
    w = Window.partitionBy(key).orderBy("start_t", "region_id")
    changed = crosses.withColumn("_last", F.lag("region_id").over(w)).where(~F.col("region_id").eqNullSafe(F.col("_last")))
    return changed.withColumn("step", F.row_number().over(w)).drop("_last")
