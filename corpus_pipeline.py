"""Raw documents to packed training sequences, in five stages.

Every stage takes what the one before kept, as Parquet, and works on all of
it; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajecta.llm import near_dedup, packing, quality, substring_dedup, toxicity
from trajecta.llm.common import crc_bucket, prepare, scratch_dir

#: The decisions' thresholds.
GOOD = 0.3
TOXIC = 0.7


def _labels(spark: SparkSession, sf_dir: str, name: str, folds: int, held: int) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labels.where(crc_bucket(F.col("doc_id"), folds) != held).select("doc_id", F.col(name).alias("label"))


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line CRF takes for good ones."""
    model = quality.fit(docs, _labels(prepare(spark), sf_dir, "quality", 5, 0))
    return quality.keep_good(docs, model, threshold=GOOD)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon does not reject."""
    model = toxicity.fit(docs, _labels(prepare(spark), sf_dir, "toxic", 3, 1))
    return toxicity.keep_clean(docs, model, threshold=TOXIC)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group alike in 0.8 of its five-word shingles."""
    return near_dedup.keep_one(docs, words=5, threshold=80)


def drop_repeated_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 20-word windows that occur earlier."""
    return substring_dedup.remove_repeats(docs, window=20)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", classify_quality),
    ("toxicity", drop_toxic),
    ("near-dedup", drop_near_duplicates),
    ("substring dedup", drop_repeated_windows),
    ("packing", pack_sequences),
]

#: Neither the models nor the packing can be said in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared
    folder and read back before the next."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{scratch_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        path = f"{base}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
