"""Batch inference through plug-in models, each content once."""

from __future__ import annotations

import traceback
from collections.abc import Callable

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, prepare

#: A model maps a list of contents to as many answers.
Model = Callable[[list], list]
_loaded: dict[str, Model] = {}
_CACHE = "content_hash string, answer string, model string"


def _model(name: str, load: Callable[[], Model]) -> Model:
    """One a Python worker, loaded when its first batch comes."""
    if name not in _loaded:
        _loaded[name] = load()
    return _loaded[name]


def run_model(items: DataFrame, name: str, load: Callable[[], Model], *, batch: int = 32) -> DataFrame:
    """``items(content_hash, content)`` -> (content_hash, answer, error). A
    batch that fails is tried one by one; what fails alone carries its error,
    and the others keep their answers."""
    prepare(items.sparkSession)

    def answer(model: Model, contents: list) -> list[tuple]:
        try:
            said = model(contents)
            if len(said) != len(contents):
                raise ValueError(f"{len(said)} answers to {len(contents)} contents")
            return [(s, None) for s in said]
        except Exception:
            if len(contents) == 1:
                return [(None, traceback.format_exc(limit=1))]
            return [x for c in contents for x in answer(model, [c])]

    def run(batches):
        for b in batches:
            model = _model(name, load)
            for lo in range(0, b.num_rows, batch):
                part = b.slice(lo, batch)
                said, error = zip(*answer(model, part.column("content").to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([part.column("content_hash"), pa.array(said, pa.string()), pa.array(error, pa.string())], ["content_hash", "answer", "error"])

    return items.select("content_hash", "content").mapInArrow(run, "content_hash string, answer string, error string")


def cached_answers(items: DataFrame, name: str, load: Callable[[], Model], cache: str, *, content: str = "content", batch: int = 32) -> DataFrame:
    """``items`` with ``answer`` and ``error``. Contents are told apart by
    SHA-256; what the table at ``cache`` knows from this model (``name`` holds
    its version) is taken from there, every other distinct content goes through
    the model once, whatever the number of its rows, and is appended. Errors
    are not kept, so that the next run tries again. Null contents have a null
    answer."""
    spark = prepare(items.sparkSession)
    hashed = items.withColumn("content_hash", F.sha2(F.col(content).cast("binary"), 256))
    try:
        known = cut(spark.read.schema(_CACHE).parquet(cache).where(F.col("model") == name))
    except AnalysisException:
        known = spark.createDataFrame([], _CACHE)
    wanted = hashed.where("content_hash IS NOT NULL").groupBy("content_hash").agg(F.first(content).alias("content"))
    fresh = run_model(wanted.join(known.select("content_hash"), "content_hash", "left_anti"), name, load, batch=batch)
    said = cut(fresh)
    said.where("error IS NULL").select("content_hash", "answer", F.lit(name).alias("model")).write.mode("append").parquet(cache)
    # a second writer may have added the same content meanwhile
    good = known.groupBy("content_hash").agg(F.min("answer").alias("answer")).join(said.select("content_hash"), "content_hash", "left_anti").withColumn("error", F.lit(None).cast("string"))
    return hashed.join(good.unionByName(said), "content_hash", "left")
