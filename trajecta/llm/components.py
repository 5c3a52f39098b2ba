"""Connected components of a link table, in one shuffle a round."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .memory import tidy

#: Links that a task contracts at once.
CHUNK = 1 << 20


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node reachable over these links) for all nodes but the
    least ones: labels fall along links and pointers until nothing changes."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        old = label.copy()
        # the links' ends hand each other's label to their own labels' nodes
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, old[a], low)
        np.minimum.at(label, old[b], low)
        while (label != label[label]).any():
            label = label[label]
        if (label == old).all():
            break
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[other], nodes[label[other]]


def _round(links: DataFrame) -> DataFrame:
    """One round over ``links(key, a, b)``, sorted by key in every partition:
    links as stars around least nodes, ``a`` the centre, and a row of nulls if
    a key had two centres or was a centre and a member. A chunk hands the link
    of its last key to the next one."""

    def scan(batches):
        held, size = [], 0

        def flush(held):
            key, a, b = (np.concatenate([h[k] for h in held]) for k in range(3))
            node, root = _stars(a, b)
            _, place = np.unique(key, return_inverse=True)
            own = b == key
            least, most = np.full(place.max() + 1, np.iinfo(np.int64).max), np.full(place.max() + 1, np.iinfo(np.int64).min)
            np.minimum.at(least, place[own], a[own])
            np.maximum.at(most, place[own], a[own])
            mixed = np.bincount(place, own) * np.bincount(place, ~own) > 0
            if (most > least).any() or mixed.any():
                node, root = np.append(node, 0), np.append(root, 0)
                gap = np.arange(len(node)) == len(node) - 1
            else:
                gap = np.zeros(len(node), bool)
            at = np.searchsorted(node[: len(node) - gap.sum()], key[-1])
            more = [(key[-1:], root[at : at + 1], key[-1:])] if at < len(node) - gap.sum() and node[at] == key[-1] else []
            return pa.RecordBatch.from_arrays([pa.array(root, pa.int64(), mask=gap), pa.array(node, pa.int64(), mask=gap)], ["a", "b"]), more

        for batch in batches:
            if batch.num_rows:
                held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "a", "b")))
                size += batch.num_rows
            if size >= CHUNK:
                out, held = flush(held)
                size = 0
                yield out
        if size:
            yield flush(held)[0]

    return links.mapInArrow(tidy(scan), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` -> ``(node, component)``, component the least node.

    A round sends every link to the partitions of both its ends, where links
    are contracted to stars, until every node has one centre only: one shuffle
    a round. Nodes without links do not appear; null ends and loops are
    ignored; repeated links count once. An empty table gives an empty result.
    """
    # not contracted where they are: links come from Python, and a task with two
    # Python steps takes two workers, which stay
    left = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b")
    while True:
        both = left.select(F.explode(F.array("a", "b")).alias("key"), "a", "b").repartition("key").sortWithinPartitions("key")
        left = cut(_round(both))
        done = left.where("a IS NULL").isEmpty()
        left = left.where("a IS NOT NULL")
        if done:
            break
    return left.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(left.select(F.col("a").alias("node"), F.col("a").alias("component"))).distinct()
