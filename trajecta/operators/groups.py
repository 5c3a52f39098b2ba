"""Many small groups in few calls of Python."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def codes(column: pd.Series) -> np.ndarray:
    """Equal values as equal numbers from 0, nulls as one of them; of structs too."""
    if column.dtype == object and column.map(lambda x: isinstance(x, (dict, list, np.ndarray))).any():
        column = column.map(repr)
    return pd.factorize(column, use_na_sentinel=False)[0]


def begins(pdf: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Where runs of equal keys begin; nulls are equal."""
    new = np.zeros(len(pdf), bool)
    new[:1] = True
    for c in keys:
        n = codes(pdf[c])
        new[1:] |= n[1:] != n[:-1]
    return np.flatnonzero(new)


def fold_groups(rows: DataFrame, scope: list[str], order: list[str], fold: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """``fold(rows of whole groups, where each begins)`` over the groups of
    ``scope``, rows in ``order``: a call gets all groups that an Arrow batch
    completes, so that a small group does not cost a call and a frame of its
    own. Dealt in a stated number of partitions, as the rows are few and the
    work on them is not; a task holds a batch and one open group."""
    columns, arrow = rows.columns, to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def folded(parts: list[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
            pdf = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0].reset_index(drop=True)
            out = fold(pdf, begins(pdf, scope))
            yield from pa.Table.from_pandas(out[arrow.names], schema=arrow, preserve_index=False).to_batches()

        held: list[pd.DataFrame] = []
        for b in batches:
            pdf = pa.Table.from_batches([b]).to_pandas()[columns]
            if not len(pdf):
                continue
            if held and len(begins(pd.concat([held[-1].iloc[-1:], pdf.iloc[:1]], ignore_index=True), scope)) == 2:
                yield from folded(held)
                held = []
            last = int(begins(pdf, scope)[-1])
            if last:
                yield from folded([*held, pdf.iloc[:last]])
                held = []
            held.append(pdf.iloc[last:])
        if held:
            yield from folded(held)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *scope).sortWithinPartitions(*scope, *order).mapInArrow(run, schema)
