"""Chains of linked fragments as whole tracks, and running means of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import unit
from ..session import prepare
from .matching import chains
from .trajectory import velocities


def id_order(track: Column) -> Column:
    """Sorts ids of digits by their number, before all others by their text."""
    text = track.cast("string")
    digits = text.rlike("^[0-9]+$")
    return F.struct((~digits).alias("other"), F.when(digits, text.cast("decimal(38,0)")).alias("number"), F.when(~digits, text).alias("text"))


def merged_ids(tracks: DataFrame, links: DataFrame, *, scope: tuple = ("video_id", "clip_id")) -> DataFrame:
    """(scope, track, merged, fragment): every track with the name of the one it
    becomes part of, the earliest of its chain by first frame and id, and its
    place in that order from 0. ``tracks(scope, track, first)``, ``links(scope,
    a, b)``; a track without links is its own chain."""
    node = [F.struct(*scope, F.col(c).alias("track")).alias(c) for c in ("a", "b")]
    head = chains(links.select(*node)).select(*[F.col(f"node.{c}").alias(c) for c in (*scope, "track")], F.col("head.track").alias("_head"))
    chained = tracks.select(*scope, "track", "first").join(head, [*scope, "track"], "left").withColumn("_head", F.coalesce("_head", "track"))
    w = Window.partitionBy(*scope, "_head").orderBy("first", id_order(F.col("track")))
    return chained.select(*scope, "track", F.first("track").over(w).alias("merged"), (F.row_number().over(w) - 1).alias("fragment"))


def merge_samples(samples: DataFrame, ids: DataFrame, *, scope: tuple = ("video_id", "clip_id")) -> DataFrame:
    """Samples of merged tracks: the fragments' one after the other, ``pos``
    anew from 0, vx and vy over the whole path, so that the sample behind a
    repaired gap has a true velocity. Other columns stay."""
    keep = [c for c in samples.columns if c not in ("pos", "vx", "vy", "track")]
    joined = samples.join(ids, [*scope, "track"])
    w = Window.partitionBy(*scope, "merged").orderBy("fragment", "pos")
    rows = joined.withColumn("pos", F.row_number().over(w) - 1).select(*keep, F.col("merged").alias("track"), F.col("track").alias("part_of"), "pos")
    return velocities(rows, [*scope, "track"], ["pos"])


def merge_tracks(tracks: DataFrame, samples: DataFrame, crops: DataFrame, links: DataFrame, *, scope: tuple = ("video_id", "clip_id"), top_k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(merged tracks, their samples). ``tracks(scope, track, class, first,
    embedding)``, ``samples(scope, track, pos, t, x, y, ..)``, ``crops(scope,
    track, path, score)``, ``links(scope, a, b)`` one-to-one.

    A merged track carries the earliest fragment's id and class, n_fragments,
    n_samples, heading (null without motion), the unit mean of the fragments'
    unit embeddings weighted by their samples (null where it vanishes or none
    has one) and its ``top_k`` crops by score over all fragments, a missing
    score as 0, ties by path. Fragments meet by chain, of which a clip has as
    many members as it has repaired gaps; samples and crops are only sorted."""
    key = [*scope, "track"]
    ids = merged_ids(tracks, links, scope=scope)
    whole = merge_samples(samples, ids, scope=scope)
    n = samples.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    part = tracks.join(ids, key).join(n, key, "left")
    vector = F.when(F.size("embedding") > 0, F.transform(unit(F.col("embedding")), lambda x: x * F.coalesce(F.col("n"), F.lit(0))))
    rows = part.groupBy(*scope, F.col("merged").alias("track")).agg(
        F.min_by("class", "fragment").alias("class"),
        F.count(F.lit(1)).alias("n_fragments"),
        F.array_sort(F.collect_list(F.when(vector.isNotNull(), F.struct("fragment", vector.alias("v"))))).alias("_v"),
    )
    total = F.aggregate(F.slice("_v", 2, F.greatest(F.size("_v") - 1, F.lit(0))), F.col("_v")[0]["v"], lambda s, e: F.zip_with(s, e["v"], lambda x, y: x + y))
    size = F.sqrt(F.aggregate("_sum", F.lit(0.0), lambda s, x: s + x * x))
    rows = rows.withColumn("_sum", F.when(F.size("_v") > 0, total)).withColumn("embedding", F.when(size > 1e-12, unit(F.col("_sum")))).drop("_v", "_sum")
    dx, dy = (F.max_by(c, "pos") - F.min_by(c, "pos") for c in ("x", "y"))
    path = whole.groupBy(*key).agg(F.count(F.lit(1)).alias("n_samples"), F.when((dx != 0) | (dy != 0), F.degrees(F.atan2(dy, dx))).alias("heading"))
    best = crops.join(ids, key).select(*scope, F.col("merged").alias("track"), "path", F.coalesce("score", F.lit(0.0)).alias("score"))
    order = Window.partitionBy(*key).orderBy(F.desc("score"), "path")
    best = best.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top_k)
    shots = best.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "path", "score"))), lambda s: F.struct(s["path"].alias("path"), s["score"].alias("score"))).alias("crops"))
    return rows.join(path, key, "left").join(shots, key, "left"), whole


def _edges(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Where rows of another key begin."""
    new = np.ones(batch.num_rows, bool)
    new[1:] = False
    for k in keys:
        a, b = batch.column(k).slice(1), batch.column(k).slice(0, batch.num_rows - 1)
        other = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        null = a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False)
        new[1:] |= other | null
    return np.flatnonzero(new)


def running_mean(samples: DataFrame, keys: list[str], order: str, *, vector: str = "embedding", keep: float = 0.9) -> DataFrame:
    """(keys, n, embedding): along each key's samples in ``order`` (a number,
    distinct in a key), the first unit vector and then ``keep`` of the mean so
    far and 1 - ``keep`` of the next. Vectors null, empty or of norm 1e-12 or
    less are passed over; the result is not normalised again.

    The recurrence is a chain of affine maps, which may be composed in parts: a
    range partition cuts the ordered samples anywhere, also inside a key that
    holds most of them, each run folds to (first vector, weight, rest), and the
    runs of a key are composed in order."""
    spark = prepare(samples.sparkSession)
    kinds = dict(samples.dtypes)
    rows = samples.select(*keys, F.col(order).cast("double").alias("_at"), F.col(vector).cast("array<double>").alias("_v"))
    length = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda s, x: s + x * x))
    rows = rows.where((F.size("_v") > 0) & (length > 1e-12)).withColumn("_v", unit(F.col("_v")))
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "_at double", "_n long", "_first array<double>", "_weight double", "_rest array<double>"])

    def fold(batches):
        for b in batches:
            if not b.num_rows:
                continue
            begin = _edges(b, keys)
            ends = np.append(begin[1:], b.num_rows)
            v = b.column("_v")
            first, weight, rest = [], [], []
            for lo, hi in zip(begin.tolist(), ends.tolist(), strict=True):
                x = np.array(v.slice(lo, hi - lo).to_pylist())
                first.append(x[0].tolist())
                weight.append(keep ** (hi - lo - 1))
                rest.append(((1 - keep) * keep ** np.arange(hi - lo - 2, -1, -1.0) @ x[1:]).tolist() if hi - lo > 1 else [0.0] * len(x[0]))
            at = pa.array(begin)
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in keys), b.column("_at").take(at), pa.array(ends - begin), pa.array(first, pa.list_(pa.float64())), pa.array(weight), pa.array(rest, pa.list_(pa.float64()))], [*keys, "_at", "_n", "_first", "_weight", "_rest"])

    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys, "_at").sortWithinPartitions(*keys, "_at")
    runs = dealt.mapInArrow(fold, schema).groupBy(*keys).agg(F.sum("_n").alias("n"), F.array_sort(F.collect_list(F.struct("_at", "_first", "_weight", "_rest"))).alias("_runs"))

    def compose(mean: Column, run: Column) -> Column:
        start = F.when(F.size(mean) == 0, run["_first"]).otherwise(F.zip_with(mean, run["_first"], lambda s, x: s * keep + x * (1 - keep)))
        return F.zip_with(start, run["_rest"], lambda s, x: s * run["_weight"] + x)

    return runs.select(*keys, "n", F.aggregate("_runs", F.expr("cast(array() as array<double>)"), compose).alias("embedding"))
