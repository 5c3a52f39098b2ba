"""Spark results against DuckDB on the same Parquet tables."""

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        path = f"{path}/*.parquet" if os.path.isdir(path) else path
        if glob.glob(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def _cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool):
        return x
    if hasattr(x, "as_tuple"):
        x = float(x)
    if isinstance(x, float):
        return round(x, 6) + 0.0
    return x


def differences(df, sql, con):
    """(missing rows, extra rows, Spark columns, SQL columns)."""
    cols = sorted(df.columns)
    spark_rows = sorted((tuple(_cell(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    at = [names.index(c) for c in cols] if sorted(names) == cols else None
    if at is None:
        return [], [], cols, sorted(names)
    sql_rows = sorted((tuple(_cell(r[i]) for i in at) for r in cur.fetchall()), key=repr)
    same = len(spark_rows) == len(sql_rows) and all(all(a == b or (isinstance(a, (int, float)) and isinstance(b, (int, float)) and abs(a - b) <= 1e-6 * max(1, abs(a))) for a, b in zip(x, y)) for x, y in zip(spark_rows, sql_rows))
    if same:
        return [], [], cols, cols
    return [r for r in sql_rows if r not in set(spark_rows)][:3], [r for r in spark_rows if r not in set(sql_rows)][:3], cols, cols
