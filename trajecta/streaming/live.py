"""Structured Streaming forms of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, schema, *, glob: str | None = None) -> DataFrame:
    """Files dropped into a folder, as a stream."""
    reader = spark.readStream.schema(schema)
    return (reader.option("pathGlobFilter", glob) if glob else reader).parquet(path)


def windowed_counts(events: DataFrame, *, time: str = "ts", late: str = "1 hour", size: str = "1 day", keys: tuple = ("event_type",)) -> DataFrame:
    """Tumbling counts and sums; rows later than the watermark are dropped."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.window(time, size), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def visits(events: DataFrame, *, time: str = "ts", late: str = "1 hour", gap: str = "12 hours", key: str = "user_id") -> DataFrame:
    """Session windows: an object's visits, apart by at least ``gap``."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n"))


def without_repeats(frames: DataFrame, keys: list[str], *, time: str = "ts", late: str = "1 hour") -> DataFrame:
    timed = frames.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.dropDuplicatesWithinWatermark(keys)


def run_once(stream: DataFrame, path: str, checkpoint: str, *, mode: str = "append") -> None:
    """Process what is there, write Parquet, stop. Exactly once per
    ``checkpoint``."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def replace_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there and keep the complete result of an aggregation as
    Parquet at ``path``; every micro-batch replaces the one before."""

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    stream.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
