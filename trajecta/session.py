"""Session plumbing: importable workers and reliable checkpoints."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package and make sure that there is a
    checkpoint directory: the one the session names, else a temporary one."""
    sc = spark.sparkContext
    parts = [p for p in sc.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in parts:
        sc.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *parts])
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="trajecta-"))
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Truncate the lineage of an iteration's state."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path below the checkpoint directory, which all executors
    see."""
    return f"{prepare(spark).sparkContext._jsc.sc().getCheckpointDir().get().rstrip('/')}/{name}-{uuid.uuid4().hex}"
