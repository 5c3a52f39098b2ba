"""Session plumbing shared by the operators of this subpackage."""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])

#: Rows per Arrow batch handed to Python. Spark's default of 10,000 would put
#: a few hundred MB of long documents into one batch.
ARROW_ROWS = 2000


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, keep Arrow batches small and
    make sure a checkpoint directory exists. Safe to call repeatedly."""
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *parts])
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    scratch_dir(spark)
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; only where that is
    unset and the master is local (tests, a laptop) a temporary folder of this
    machine."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not configured and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="trajecta-"))
    return configured or sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Truncate lineage with a reliable checkpoint: later plans reread the
    shared folder, so a lost executor costs no recomputation of the past."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, *, name: str = "part") -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back."""
    spark = prepare(df.sparkSession)
    path = f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def saved(df: DataFrame, name: str = "part") -> DataFrame:
    """``written``, for tables that ``removed`` may delete once they are used."""
    return written(df, name=name)


def removed(table: DataFrame) -> None:
    """Delete a table of ``saved`` that a later one replaces."""
    sc = table.sparkSession.sparkContext
    folder = table.inputFiles()
    if folder:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder[0].rsplit("/", 1)[0])
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def width(spark: SparkSession) -> int:
    """Partitions to shuffle into: the session's own setting."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: At most so many keys of a join count as hot, whatever the input.
HOT_KEYS = 1000


def join_by_size(rows: DataFrame, table: DataFrame, keys: list[str], size: str, total: int, *, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table``, one row a key, whose column ``size``
    counts the key's rows. A key with more than a HOT_KEYS-th of ``total`` rows
    would meet in one task: these keys, at most HOT_KEYS, are broadcast; all
    others are joined as usual. ``how`` is inner or left."""
    most = F.lit(max(1000, total // HOT_KEYS))
    hot = F.broadcast(table.where(F.col(size) > most))
    others = rows.join(hot.select(*keys), keys, "left_anti").join(table.where(F.col(size) <= most), keys, how)
    met = rows.join(hot, keys)
    return met.select(*others.columns).unionByName(others)


def best_rows(df: DataFrame, keys: list[str], order: list, top: int) -> DataFrame:
    """The first ``top`` rows of each key in ``order``, with their ``rank``.
    Where a key has rows in every partition, groups of partitions choose first,
    so that about the square root of their number meets in a task."""
    groups = max(1, math.isqrt(width(df.sparkSession)))
    few = df.withColumn("_group", F.spark_partition_id() % groups)
    few = few.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "_group").orderBy(*order))).where(F.col("rank") <= top)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top).drop("_group")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def crc_bucket(column, modulus: int):
    """crc32 of the id's decimal text, modulo ``modulus``."""
    return F.crc32(F.encode(column.cast("string"), "UTF-8")) % F.lit(modulus)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
