"""What Python workers hold once their tasks are done."""

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = r"""
import re
import tempfile
from pathlib import Path

import psutil
from pyspark.sql import SparkSession

from trajecta.llm import near_dedup, substring_dedup

spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="trajecta-"))
docs = spark.range(0, 6000, 1, 1).selectExpr("id AS doc_id", "id AS row_key", "id", "concat_ws(' ', transform(sequence(1, 400), i -> hex(xxhash64(id, i)))) AS text")
near_dedup.signatures(near_dedup.prepare(spark) and docs, words=5).write.format("noop").mode("overwrite").save()
substring_dedup._sketches(docs.select("id", "row_key", "text"), 20, 6).write.format("noop").mode("overwrite").save()
near_dedup.near_duplicates(docs.limit(50)).write.format("noop").mode("overwrite").save()
daemons = [p for p in psutil.Process().children(recursive=True) if "pyspark.daemon" in " ".join(p.cmdline()) and "java" in p.parent().name()]
held = [sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path(f"/proc/{w.pid}/smaps_rollup").read_text()))) >> 10 for d in daemons for w in d.children(recursive=True)]
print("HELD", len(daemons), len(held), max(held))
"""


def test_workers_give_their_memory_back():
    """After 41 MB of texts; and near-dedup needs one worker a core only."""
    root = str(Path(__file__).resolve().parents[2])
    run = subprocess.run([sys.executable, "-c", SCRIPT], cwd=root, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=300)
    said = [line.split()[1:] for line in run.stdout.splitlines() if line.startswith("HELD")]
    assert said, run.stderr[-3000:]
    daemons, workers, most = map(int, said[0])
    assert daemons == workers == 1 and most < 110, (daemons, workers, most)
