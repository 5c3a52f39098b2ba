"""Greedy windows of many objects in a call."""

import numpy as np

from trajecta.operators import events as ev


def test_objects_share_calls(spark):
    rng, rows = np.random.default_rng(6), []
    for o in [*range(50), None]:
        i = np.unique(rng.integers(0, 60, 20))
        rows += [(o, int(x), int(x + rng.integers(1, 15))) for x in i]
    df = spark.createDataFrame(rows, "obj int, i long, j long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    try:
        found = ev.thin(df)
        got = {(r.obj, r.i, r.j) for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()
    want = set()
    for o in {r[0] for r in rows}:
        end = -1
        for _, i, j in sorted(r for r in rows if r[0] == o):
            if i > end:
                want.add((o, i, j))
                end = j
    assert got == want
