"""The driver's tables in the shape the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators.trajectory import motion, velocities
from .session import prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def hours(ts):
    """Hours since the epoch, whatever the session's time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})") / 3.6e9


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as trajectories: obj = user, t in hours, x = value, y = props.k."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("obj"), (F.row_number().over(w) - 1).alias("pos"), hours("ts").alias("t"), F.col("value").alias("x"), F.regexp_extract("props", r"(\d+)", 1).cast("double").alias("y"), F.col("event_type").alias("class"), "event_id", "ts")


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """samples with vx, vy, speed and heading."""
    return motion(velocities(samples(spark, sf_dir), ["obj"], ["pos"]))


#: The same in SQL, for the oracles.
SAMPLES_SQL = """samples AS (
  SELECT user_id AS obj, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
         epoch_us(ts) / 3.6e9 AS t, value AS x, CAST(regexp_extract(props, '(\\d+)', 1) AS DOUBLE) AS y,
         event_type AS class, event_id, ts FROM events)"""
TRAJECTORIES_SQL = (
    SAMPLES_SQL
    + """, lagged AS (
  SELECT *, t - lag(t) OVER w AS dt, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy
  FROM samples WINDOW w AS (PARTITION BY obj ORDER BY pos)),
moved AS (SELECT *, CASE WHEN dt > 0 THEN dx / dt ELSE 0.0 END AS vx, CASE WHEN dt > 0 THEN dy / dt ELSE 0.0 END AS vy FROM lagged),
traj AS (SELECT *, sqrt(vx * vx + vy * vy) AS speed,
         CASE WHEN sqrt(vx * vx + vy * vy) >= 1e-9 THEN degrees(atan2(vy, vx)) END AS heading FROM moved)"""
)
