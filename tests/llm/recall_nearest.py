"""Recall of the nearest-neighbour query against brute force on a whole table:
``python -m tests.llm.recall_nearest /root/testdata/check_l``."""

import sys

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import SparkSession

from trajecta.llm.queries import op8_nearest_neighbours


def main(folder: str) -> None:
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "16").config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    found: dict[int, set] = {}
    for r in op8_nearest_neighbours(spark, folder).select("query_id", "vec_id").collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    t = pq.read_table(f"{folder}/embeddings.parquet", columns=["vec_id", "embedding"])
    ids, v = t.column("vec_id").to_numpy(), np.array(t.column("embedding").to_pylist(), float)
    hits = wanted = 0
    for q in sorted(found):
        at = int(np.flatnonzero(ids == q)[0])
        d = ((v - v[at]) ** 2).sum(axis=1)
        d[at] = np.inf
        near = np.lexsort((ids, d))[:10]
        hits, wanted = hits + len(found[q] & set(ids[near].tolist())), wanted + len(near)
    print(f"{len(ids)} vectors, {len(found)} queries, recall {hits / wanted:.4f}")


if __name__ == "__main__":
    main(sys.argv[1])
