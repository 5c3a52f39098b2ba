"""Per-sample kinematics and stitching of tracks into object trajectories.

Long samples: keys, t (seconds), x, y and whatever else; one row a sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frames(n_frames: int, fps: float, clip_seconds: float, every_seconds: float, spark) -> DataFrame:
    """Frame index of a video of ``n_frames``: clip, sampled frames only,
    seconds. Clip lengths and steps round half to even."""
    clip, step = max(1, round(clip_seconds * fps)), max(1, round(every_seconds * fps))
    idx = F.col("id")
    df = spark.range(n_frames).where(idx % step == 0)
    return df.select(F.format_string("clip_%03d", (F.floor(idx / clip)).cast("int")).alias("clip_id"), F.format_string("frame_%06d", idx.cast("int")).alias("frame_id"), (idx / fps).alias("t"))


def velocities(samples: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds vx, vy per second: backward differences, 0 for a track's first
    sample and where time does not advance."""
    w = Window.partitionBy(*keys).orderBy(*order)
    dt = F.col("t") - F.lag("t").over(w)

    def rate(c: str) -> Column:
        return F.when(dt > 0, (F.col(c) - F.lag(c).over(w)) / dt).otherwise(F.lit(0.0))

    return samples.withColumns({"vx": rate("x"), "vy": rate("y")})


def motion(samples: DataFrame) -> DataFrame:
    """Adds speed and heading (degrees; null below 1e-9)."""
    speed = F.hypot("vx", "vy")
    return samples.withColumn("speed", speed).withColumn("heading", F.when(F.col("speed") >= 1e-9, F.degrees(F.atan2("vy", "vx"))))


def summaries(samples: DataFrame, keys: list[str], *, window: int = 3, still: float = 5.0) -> DataFrame:
    """One row a track: first and last sample, n, net heading, exit velocity
    (mean of the last ``window`` velocities, the first sample's excluded) and
    whether it stands still (population variances of x and y together)."""
    at = F.struct("t", "pos")
    w = Window.partitionBy(*keys).orderBy(F.desc("t"), F.desc("pos"))
    first = F.min("pos").over(Window.partitionBy(*keys))
    late = samples.withColumn("_r", F.row_number().over(w)).withColumn("_use", (F.col("_r") <= window) & (F.col("pos") > first))
    dx, dy = F.col("x_last") - F.col("x_first"), F.col("y_last") - F.col("y_first")
    rows = late.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("t").alias("t_first"),
        F.max("t").alias("t_last"),
        *[f(c, at).alias(f"{c}_{n}") for c in ("x", "y") for f, n in ((F.min_by, "first"), (F.max_by, "last"))],
        F.coalesce(F.avg(F.when(F.col("_use"), F.col("vx"))), F.lit(0.0)).alias("exit_vx"),
        F.coalesce(F.avg(F.when(F.col("_use"), F.col("vy"))), F.lit(0.0)).alias("exit_vy"),
        (F.var_pop("x") + F.var_pop("y") < still).alias("stationary"),
    )
    return rows.withColumn("heading", F.when((F.col("n") >= 2) & ((dx != 0) | (dy != 0)), F.degrees(F.atan2(dy, dx))))


def stitch(sightings: DataFrame, samples: DataFrame, keys: list[str], obj: list[str]) -> DataFrame:
    """Samples of all tracks of an object in time order, renumbered from 0;
    equal times keep the order of sightings, then of samples."""
    joined = sightings.join(samples, keys)
    w = Window.partitionBy(*obj).orderBy("t", "sighting_no", "pos")
    return joined.withColumn("pos", F.row_number().over(w) - 1)


def mean_heading(heading: Column) -> Column:
    """Circular mean in degrees, as an aggregate; nulls do not count."""
    return F.degrees(F.atan2(F.avg(F.sin(F.radians(heading))), F.avg(F.cos(F.radians(heading)))))


def spread(n: Column, most: int) -> Column:
    """At most ``most`` evenly spread positions of 0 .. n-1, ends included;
    halves round to even."""
    steps = F.sequence(F.lit(0), F.least(n, F.lit(most)) - 1)
    one = F.transform(steps, lambda k: F.rint(k * (n - 1) / F.greatest(F.least(n, F.lit(most)) - 1, F.lit(1))).cast("int"))
    return F.when(n <= 0, F.array().cast("array<int>")).otherwise(F.array_distinct(one))


def interpolate(times: DataFrame, samples: DataFrame, keys: list[str]) -> DataFrame:
    """As-of join: x, y of each trajectory at ``times(keys, t)``, linear
    between the samples around; null outside. Duplicate times keep the last
    sample's position. One sort by time, no range join."""
    asked = times.select(*keys, "t").distinct().withColumn("_ask", F.lit(True))
    known = samples.groupBy(*keys, "t").agg(F.max_by("x", "pos").alias("x"), F.max_by("y", "pos").alias("y"))
    both = known.withColumn("_k", F.struct("t", "x", "y")).join(asked, [*keys, "t"], "full_outer")
    back = Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy("t").rowsBetween(0, Window.unboundedFollowing)
    p, q = F.last("_k", ignorenulls=True).over(back), F.first("_k", ignorenulls=True).over(ahead)
    df = both.withColumns({"_p": p, "_q": q}).where("_ask")
    share = F.when(F.col("_q.t") > F.col("_p.t"), (F.col("t") - F.col("_p.t")) / (F.col("_q.t") - F.col("_p.t"))).otherwise(0.0)
    return df.select(*keys, "t", *[(F.col(f"_p.{c}") + share * (F.col(f"_q.{c}") - F.col(f"_p.{c}"))).alias(c) for c in ("x", "y")])


def nearest_samples(times: DataFrame, samples: DataFrame, keys: list[str], *, t: str = "t", order: tuple = ("pos",)) -> DataFrame:
    """``times(keys.., at)`` each with the sample of its key that is nearest in
    ``t``, ties by ``order``: both are one ordered stream, in which a time looks
    at the sample before and the one behind it. Times without any sample of
    their key stay, with a null."""
    columns = [c for c in samples.columns if c not in keys]
    s = samples.select(*keys, F.col(t).alias("_t"), F.struct(*columns).alias("_s"))
    q = times.select(*keys, "at").distinct().select(*keys, F.col("at").alias("_t"), F.lit(None).cast(s.schema["_s"].dataType).alias("_s"), F.lit(True).alias("_q"))
    first = s.groupBy(*keys, "_t").agg(F.min_by("_s", F.struct(*[F.col(f"_s.{c}") for c in order])).alias("_s"), F.lit(False).alias("_q"))
    w = Window.partitionBy(*keys).orderBy("_t")
    place = F.when(F.col("_s").isNotNull(), F.struct(F.col("_t").alias("t"), F.col("_s").alias("s")))
    both = first.unionByName(q).withColumns({"_a": F.last(place, ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)), "_b": F.first(place, ignorenulls=True).over(w.rangeBetween(Window.currentRow, Window.unboundedFollowing))})
    ahead, behind = F.col("_b.t") - F.col("_t"), F.col("_t") - F.col("_a.t")
    earlier = F.struct(*[F.col(f"_a.s.{c}") for c in order]) <= F.struct(*[F.col(f"_b.s.{c}") for c in order])
    one = F.when(F.col("_b").isNull() | (behind < ahead) | ((behind == ahead) & earlier), F.col("_a.s")).otherwise(F.col("_b.s"))
    return both.where("_q").select(*keys, F.col("_t").alias("at"), one.alias("sample"))


def sighting_at(times: DataFrame, sightings: DataFrame, keys: list[str]) -> DataFrame:
    """``times(keys.., at)`` with the first of the key's ``sightings(first_seen,
    last_seen, pos)`` that covers the time, else the one that begins nearest.
    Sightings of a key are few (one a clip); ``times`` are stated."""
    s = sightings.select(*keys, "first_seen", "last_seen", "pos")
    covers = F.col("at").between(F.col("first_seen"), F.col("last_seen"))
    rank = F.struct(~covers, F.when(covers, 0.0).otherwise(F.abs(F.col("at") - F.col("first_seen")).cast("double")), "pos")
    joined = times.join(s, keys)
    return joined.groupBy(*keys, "at").agg(F.min_by("pos", rank).alias("pos"), F.bool_or(covers).alias("covered"))


def seconds_of_clock(clock):
    """HH:MM:SS as seconds; null for other texts."""
    part = F.split(clock, ":")
    ok = clock.rlike(r"^\d+:\d+:\d+$")
    return F.when(ok, part[0].cast("long") * 3600 + part[1].cast("long") * 60 + part[2].cast("long"))
