"""Nearest neighbours by NN-descent and greedy graph search.

Equal vectors form one node. While the graph is built and searched a vector is
one byte a component with a scale of its own (its code); only the last step
measures original vectors. Rows are dealt to tasks by a hash of their node or
query in buckets of fixed size, so no cluster or copy family meets in one.

Build. Brute force inside the leaves of a few random hyperplane partitions
gives each node first neighbours. Then, round by round, a node's sampled
neighbours in both directions are joined with their codes and compared with
each other (neighbours of neighbours); the nearest finds are joined back to
the lists they improve, until few lists change.

Search. One row a query holds its ``BEAM`` nearest nodes seen. Each step joins
the entries not yet expanded with the links, which carry their ends' codes, and
merges what lies nearer than the beam's last entry, until no query has an
unexpanded entry.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, removed, saved, width
from .wordhash import mix

K = 48
#: Neighbours of a node that are compared in a round, per direction.
SAMPLE = 24
#: Finds that one comparison hands to each of the nodes compared.
FINDS = 6
#: A round that changes a smaller share of all lists' entries is the last.
SETTLED = 0.02
TREES = 3
LEAF = 256
#: Links against the graph's direction, nearest first, that search follows.
BACK = 24
PIVOTS = 32
BEAM = 128
#: Nodes or queries of a bucket.
BUCKET = 512


def _flat(column, kind) -> tuple[np.ndarray, np.ndarray]:
    """(values, lengths) of a list column; null lists are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    lengths = np.nan_to_num(np.array(pc.fill_null(pc.list_value_length(column), 0)), nan=0).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind), lengths


def _numpy(column) -> np.ndarray:
    return column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)


def _list(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _codes(v: np.ndarray) -> list[bytes]:
    """A float32 scale, then one signed byte a component."""
    scale = np.abs(v).max(axis=1, initial=0) / 127
    whole = np.rint(v / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8)
    raw = np.concatenate([scale.astype("<f4")[:, None].view(np.uint8), whole.view(np.uint8)], axis=1)
    return [r.tobytes() for r in raw]


def _decoded(codes) -> np.ndarray:
    """Rows of float32 from a binary column or a list of codes."""
    rows = codes if isinstance(codes, list) else codes.to_pylist()
    if not rows:
        return np.zeros((0, 1), np.float32)
    raw = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)
    return raw[:, 4:].view(np.int8).astype(np.float32) * np.ascontiguousarray(raw[:, :4]).view("<f4")


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0, (a * a).sum(-1)[..., :, None] + (b * b).sum(-1)[..., None, :] - 2 * a @ np.swapaxes(b, -1, -2))


def _ranks(owner: np.ndarray) -> np.ndarray:
    """Place of every row within its run of equal owners."""
    if not len(owner):
        return np.zeros(0, np.int64)
    first = np.concatenate(([0], np.flatnonzero(owner[1:] != owner[:-1]) + 1))
    return np.arange(len(owner)) - np.repeat(first, np.diff(np.concatenate((first, [len(owner)]))))


def _nearest_of(owner: np.ndarray, other: np.ndarray, dist: np.ndarray, mark: np.ndarray, k: int):
    """The k nearest distinct others of each owner, nearest first, ties by
    id; of equal pairs the one with ``mark`` False stays."""
    order = np.lexsort((mark, other, owner))
    owner, other, dist, mark = owner[order], other[order], dist[order], mark[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (other[1:] != other[:-1])
    owner, other, dist, mark = owner[new], other[new], dist[new], mark[new]
    order = np.lexsort((other, dist, owner))
    owner, other, dist, mark = owner[order], other[order], dist[order], mark[order]
    keep = _ranks(owner) < k
    return owner[keep], other[keep], dist[keep], mark[keep]


def valid_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part: an id, neither
    null, empty nor zero, all components finite."""
    v = F.transform(vector_col, lambda x: x.cast("double"))
    df = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    return df.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).where(F.exists("v", lambda x: x != 0))


def nodes_of(vectors: DataFrame, keep: int) -> DataFrame:
    """(node, v, code, members): one row per distinct vector; node is its
    least id, members its ``keep`` least ids. Lists are cut inside every
    partition before the shuffle, so copies never gather. Codes are relative to
    the largest component of all vectors."""
    most = vectors.select(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] or 1.0

    def partial(batches):
        least: dict = {}
        for b in batches:
            flat, lengths = _flat(b.column("v"), np.float64)
            for i, v in zip(b.column("vec_id").to_pylist(), flat.reshape(len(lengths), -1) + 0.0 if len(lengths) else [], strict=True):
                ids = least.setdefault(v.tobytes(), [])
                ids.append(i)
                if len(ids) > 4 * keep:
                    ids[:] = sorted(set(ids))[:keep]
            if len(least) > 50_000:
                yield out(least)
                least = {}
        if least:
            yield out(least)

    def out(least):
        return pa.RecordBatch.from_arrays([pa.array(list(least), pa.binary()), pa.array([sorted(set(x))[:keep] for x in least.values()], pa.list_(pa.int64()))], ["key", "ids"])

    parts = vectors.mapInArrow(partial, "key binary, ids array<long>").groupBy("key")
    parts = parts.agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("members"))

    def unpack(batches):
        for b in batches:
            keys = b.column("key").to_pylist()
            if keys:
                v = np.frombuffer(b"".join(keys), np.float64).reshape(len(keys), -1)
                lengths = np.full(len(keys), v.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in b.column("members").to_pylist()], pa.int64()), _list(v.ravel(), lengths), pa.array(_codes(v / most), pa.binary()), b.column("members")], ["node", "v", "code", "members"])

    return parts.mapInArrow(unpack, "node long, v array<double>, code binary, members array<long>")


def _bucket(key: str, n: int):
    return F.pmod(F.xxhash64(F.lit("bucket"), key), F.lit(max(1, -(-n // BUCKET))))


_FOUND = "node long, code binary, ids array<long>, dist array<float>, fresh array<boolean>"


def _rows_of(owner, other, dist, mark, *, codes: dict | None = None, everyone: np.ndarray | None = None) -> pa.Table:
    """Sorted flat entries as one row an owner (of ``everyone``, if given)."""
    owners, lengths = (np.unique(owner, return_counts=True)) if everyone is None else (everyone, np.searchsorted(owner, everyone, side="right") - np.searchsorted(owner, everyone))
    code = pa.nulls(len(owners), pa.binary()) if codes is None else pa.array([codes[i] for i in owners.tolist()], pa.binary())
    columns = [pa.array(owners, pa.int64()), code, _list(other.astype(np.int64), lengths), _list(dist.astype(np.float32), lengths), _list(mark.astype(bool), lengths)]
    return pa.Table.from_arrays(columns, ["node", "code", "ids", "dist", "fresh"])


def _merged(rows: DataFrame, n: int, k: int, *, expanded: bool = False) -> DataFrame:
    """Rows of one node to one: its k nearest entries. One row of each node
    has a code; entries that are known already keep their mark. ``expanded``:
    all entries of the row with a code count as no longer fresh."""

    def merge(table: pa.Table) -> pa.Table:
        ids, lengths = _flat(table.column("ids"), np.int64)
        dist, _ = _flat(table.column("dist"), np.float32)
        fresh, _ = _flat(table.column("fresh"), bool)
        node, code = _numpy(table.column("node")), table.column("code").to_pylist()
        codes = {i: c for i, c in zip(node.tolist(), code, strict=True) if c is not None}
        if expanded:
            fresh &= ~np.repeat(np.array([c is not None for c in code], bool), lengths)
        best = _nearest_of(np.repeat(node, lengths), ids, dist, fresh, k)
        return _rows_of(*best, codes=codes, everyone=np.array(sorted(codes), np.int64))

    return rows.groupBy(_bucket("node", n).alias("bucket")).applyInArrow(merge, _FOUND)


def _leaf(tree: int, bits: int, dim: int, seed: int):
    """Column: the leaf of a code, one bit per random hyperplane."""
    planes = np.random.default_rng([seed, tree]).standard_normal((max(1, bits), dim)).astype(np.float32)

    @F.pandas_udf("long")
    def leaf(code: pd.Series) -> pd.Series:
        if not bits or not len(code):
            return pd.Series(np.zeros(len(code), np.int64))
        side = _decoded(code.tolist()) @ planes.T > 0
        return pd.Series(side.astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64)))

    return leaf("code")


def _first_lists(nodes: DataFrame, n: int, dim: int, k: int, seed: int) -> DataFrame:
    bits = int(np.ceil(np.log2(max(1, n / LEAF))))
    rows = reduce(DataFrame.unionByName, [nodes.select(F.lit(t).alias("tree"), _leaf(t, bits, dim, seed).alias("leaf"), "node", "code") for t in range(TREES)])
    # an overfull leaf is dealt into several by hash; its cuts differ by tree
    sizes = rows.groupBy("tree", "leaf").agg(F.ceil(F.count(F.lit(1)) / (2 * LEAF)).alias("cuts"))
    rows = rows.join(sizes, ["tree", "leaf"]).withColumn("cut", F.pmod(F.xxhash64("node", "tree"), F.col("cuts"))).drop("cuts")

    def brute(table: pa.Table) -> pa.Table:
        ids, v = _numpy(table.column("node")), _decoded(table.column("code"))
        m = min(k, len(ids) - 1)
        if m < 1:
            return _rows_of(*[np.zeros(0, np.int64)] * 4)
        d = _squares(v, v)
        np.fill_diagonal(d, np.inf)
        near = np.argpartition(d, m - 1, axis=1)[:, :m]
        owner, dist = np.repeat(ids, m), np.take_along_axis(d, near, axis=1).ravel()
        return _rows_of(*_nearest_of(owner, ids[near].ravel(), dist, np.ones(len(owner), bool), k))

    found = rows.groupBy("tree", "leaf", "cut").applyInArrow(brute, _FOUND)
    own = nodes.select("node", "code", *[F.expr(f"cast(array() as array<{t}>)").alias(c) for c, t in (("ids", "long"), ("dist", "float"), ("fresh", "boolean"))])
    return _merged(own.unionByName(found), n, k)


def _drawn(batch: pa.RecordBatch, salt: int):
    """Entries of a batch of lists and which of them this round compares:
    fresh ones first, else by a hash."""
    ids, lengths = _flat(batch.column("ids"), np.int64)
    fresh, _ = _flat(batch.column("fresh"), bool)
    owner = np.repeat(_numpy(batch.column("node")), lengths)
    at = np.repeat(np.arange(len(lengths)), lengths)
    draw = mix(ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + owner.view(np.uint64) + np.uint64(salt))
    order = np.lexsort((draw, ~fresh, at))
    take = np.zeros(len(ids), bool)
    take[order[_ranks(at[order]) < SAMPLE]] = True
    return owner, ids, fresh, take, lengths


def _descend(graph: DataFrame, n: int, k: int, salt: int) -> DataFrame:
    """One round: every node's sampled neighbours meet each other."""

    def edges(batches):
        for b in batches:
            owner, other, fresh, take, _ = _drawn(b, salt)
            yield pa.RecordBatch.from_arrays([pa.array(owner[take]), pa.array(other[take]), pa.array(fresh[take])], ["owner", "other", "fresh"])

    def settle(batches):
        for b in batches:
            _, _, fresh, take, lengths = _drawn(b, salt)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], _list(fresh & ~take, lengths)], b.schema.names)

    ahead = graph.mapInArrow(edges, "owner long, other long, fresh boolean")
    order = Window.partitionBy("owner").orderBy(F.desc("fresh"), F.xxhash64("owner", "other", F.lit(salt)))
    back = ahead.select(F.col("other").alias("owner"), F.col("owner").alias("other"), "fresh").withColumn("r", F.row_number().over(order)).where(F.col("r") <= SAMPLE).drop("r")
    limit = F.when(F.size("dist") >= k, F.element_at("dist", -1)).otherwise(float("inf")).cast("float")
    ends = graph.select(F.col("node").alias("other"), "code", limit.alias("limit"))
    lists = ahead.unionByName(back).join(ends, "other")

    def meet(table: pa.Table) -> pa.Table:
        owner, other, fresh, limit_ = (_numpy(table.column(c)) for c in ("owner", "other", "fresh", "limit"))
        order = np.lexsort((~fresh, other, owner))
        owner, other, fresh, limit_ = owner[order], other[order], fresh[order], limit_[order]
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (other[1:] != other[:-1])
        owner, other, fresh, limit_ = owner[new], other[new], fresh[new], limit_[new]
        v = _decoded(table.column("code"))[order[new]]
        row, place = np.unique(owner, return_inverse=True)[1], _ranks(owner)
        wide = int(place.max(initial=0)) + 1
        out = []
        for lo in range(0, int(row.max(initial=-1)) + 1, 64):
            a, b = np.searchsorted(row, [lo, lo + 64])
            at, r, p = np.full((64, wide), -1), row[a:b] - lo, place[a:b]
            at[r, p] = np.arange(a, b)
            there, x = at >= 0, v[at] * (at >= 0)[..., None]
            d, f = _squares(x, x), fresh[at] & there
            ok = there[:, :, None] & there[:, None, :] & (f[:, :, None] | f[:, None, :]) & (d < limit_[at][:, :, None])
            ok[:, np.arange(wide), np.arange(wide)] = False
            d = np.where(ok, d, np.inf)
            best = np.argpartition(d, FINDS - 1, axis=2)[:, :, :FINDS] if wide > FINDS else np.broadcast_to(np.arange(wide), d.shape)
            d = np.take_along_axis(d, best, axis=2)
            i, j, m = np.nonzero(np.isfinite(d))
            out.append((other[at[i, j]], other[at[i, best[i, j, m]]], d[i, j, m]))
        who, near, far = (np.concatenate(x) for x in zip(*out, strict=True)) if out else [np.zeros(0, np.int64)] * 3
        return _rows_of(*_nearest_of(who, near, far, np.ones(len(who), bool), k))

    found = lists.groupBy(_bucket("owner", n).alias("bucket")).applyInArrow(meet, _FOUND)
    return _merged(graph.mapInArrow(settle, _FOUND).unionByName(found), n, k)


def build(nodes: DataFrame, *, k: int = K, seed: int = 11) -> DataFrame:
    """``nodes(node, code)`` -> (node, code, ids, dist, fresh), saved: k near
    nodes each, nearest first; dist is squared, between codes. Nodes without
    any other have empty lists; an empty table gives an empty graph."""
    n = nodes.count()
    first = nodes.select((F.octet_length("code") - 4).alias("d")).limit(1).collect()
    graph = saved(_first_lists(nodes, n, first[0].d if first else 1, k, seed), "graph")
    salt = seed
    while graph.select(F.coalesce(F.sum(F.size(F.filter("fresh", lambda x: x))), F.lit(0))).first()[0] > SETTLED * n * k:
        salt += 1
        better = saved(_descend(graph, n, k, salt), "graph")
        removed(graph)
        graph = better
    return graph


def links_of(graph: DataFrame, n: int) -> DataFrame:
    """(node, ends, codes): where search may go from a node, along the graph
    and ``BACK`` links against it, with the ends' codes."""
    ahead = graph.select("node", F.explode(F.arrays_zip(F.col("ids").alias("end"), F.col("dist").alias("dist"))).alias("e")).select("node", "e.end", "e.dist")
    order = Window.partitionBy("node").orderBy("dist", "end")
    back = ahead.select(F.col("end").alias("node"), F.col("node").alias("end"), "dist").withColumn("r", F.row_number().over(order)).where(F.col("r") <= BACK).drop("r")
    both = ahead.unionByName(back).select("node", "end").join(graph.select(F.col("node").alias("end"), "code"), "end")

    def gather(table: pa.Table) -> pa.Table:
        node, end, code = _numpy(table.column("node")), _numpy(table.column("end")), table.column("code").to_pylist()
        order = np.lexsort((end, node))
        node, end = node[order], end[order]
        new = np.ones(len(node), bool)
        new[1:] = (node[1:] != node[:-1]) | (end[1:] != end[:-1])
        order, node, end = order[new], node[new], end[new]
        nodes, count = np.unique(node, return_counts=True)
        edge = np.concatenate(([0], np.cumsum(count))).tolist()
        ends = [end[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
        codes = [b"".join(code[i] for i in order[a:b].tolist()) for a, b in zip(edge[:-1], edge[1:], strict=True)]
        return pa.table({"node": pa.array(nodes, pa.int64()), "ends": pa.array(ends, pa.binary()), "codes": pa.array(codes, pa.binary())})

    return both.groupBy(_bucket("node", n).alias("bucket")).applyInArrow(gather, "node long, ends binary, codes binary")


def search(graph: DataFrame, queries: DataFrame, *, beam: int = BEAM) -> DataFrame:
    """``queries(query, code)``, query the id of a node with that code or an id
    that no node has -> (node, code, ids, dist, fresh), saved: per query (node)
    the ``beam`` nearest nodes that greedy search sees, itself included."""
    spark = graph.sparkSession
    n, n_queries = graph.count(), queries.count()
    some = graph.orderBy(F.xxhash64("node", F.lit("pivot")), "node").limit(PIVOTS).select("node", "code").collect()
    pivots, pivot_codes = np.array([r.node for r in some], np.int64), [bytes(r.code) for r in some]
    # one shuffle places the links; every step then moves queries to them
    links = links_of(graph, n).repartition(width(spark), "node").persist(StorageLevel.MEMORY_AND_DISK)

    def start(batches):
        for b in batches:
            q, known = _numpy(b.column("query")), b.column("known").to_pylist()
            d = _squares(_decoded(b.column("code")), _decoded(pivot_codes))
            owner, other, dist = np.repeat(q, len(pivots)), np.tile(pivots, len(q)), d.ravel()
            own = q[np.array(known, bool)]
            best = _nearest_of(np.concatenate([own, owner]), np.concatenate([own, other]), np.concatenate([np.zeros(len(own), np.float32), dist]), np.concatenate([np.zeros(len(own), bool), np.zeros(len(owner), bool)]), beam)
            best = (*best[:3], np.ones(len(best[0]), bool))
            codes = dict(zip(q.tolist(), b.column("code").to_pylist(), strict=True))
            yield from _rows_of(*best, codes=codes, everyone=np.array(sorted(codes), np.int64)).to_batches()

    there = graph.select(F.col("node").alias("query"), F.lit(True).alias("is_node"))
    asked = queries.join(there, "query", "left").select("query", "code", F.col("is_node").isNotNull().alias("known"))
    state = saved(asked.mapInArrow(start, _FOUND), "beam")

    def measure(batches):
        for b in batches:
            if not b.num_rows:
                continue
            ends = [np.frombuffer(x, np.int64) for x in b.column("ends").to_pylist()]
            count = np.array([len(x) for x in ends])
            size = len(b.column("code")[0].as_py())
            raw = np.frombuffer(b"".join(b.column("codes").to_pylist()), np.uint8).reshape(-1, size)
            x = raw[:, 4:].view(np.int8).astype(np.float32) * np.ascontiguousarray(raw[:, :4]).view("<f4")
            d = np.square(x - np.repeat(_decoded(b.column("code")), count, axis=0)).sum(axis=1)
            near = d < np.repeat(_numpy(b.column("limit")), count)
            q, end = np.repeat(_numpy(b.column("query")), count)[near], np.concatenate(ends)[near]
            yield from _rows_of(*_nearest_of(q, end, d[near], np.ones(len(q), bool), beam)).to_batches()

    open_ = F.arrays_zip(F.col("ids").alias("id"), F.col("fresh").alias("open"))
    limit = F.when(F.size("dist") >= beam, F.element_at("dist", -1)).otherwise(float("inf")).cast("float")
    while not state.where(F.exists("fresh", lambda x: x)).isEmpty():
        front = state.select(F.col("node").alias("query"), "code", limit.alias("limit"), F.explode(F.filter(open_, lambda e: e["open"])).alias("e"))
        front = front.select("query", "code", "limit", F.col("e.id").alias("node"))
        hits = front.join(links, "node").select("query", "code", "limit", "ends", "codes").mapInArrow(measure, _FOUND)
        wider = saved(_merged(state.unionByName(hits), n_queries, beam, expanded=True), "beam")
        removed(state)
        state = wider
    links.unpersist()
    return state


def _told_apart(nodes: DataFrame) -> DataFrame:
    """Nodes with one least id get nodes of their own: the first by its vector
    keeps the id, the others take a hash."""
    r = F.row_number().over(Window.partitionBy("node").orderBy("v"))
    own = nodes.withColumn("r", r)
    return own.withColumn("node", F.when(F.col("r") == 1, F.col("node")).otherwise(F.xxhash64("node", "v"))).drop("r")


def _nearest_of_length(good: DataFrame, every: int, k: int) -> DataFrame:
    nodes = nodes_of(good, k + 1)
    if not good.groupBy("vec_id").count().where("count > 1").isEmpty():
        nodes = _told_apart(nodes)
    nodes = saved(nodes, "nodes")
    asked = good.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v")
    # copies among the queries are searched once
    own = saved(asked.select("v").distinct().join(nodes.select("node", "v", "code"), "v"), "own")
    graph = build(nodes.select("node", "code"))
    beams = search(graph, own.select(F.col("node").alias("query"), "code"))
    pairs = beams.select(F.col("node").alias("query"), F.explode("ids").alias("node"))
    rows = pairs.join(nodes.select("node", "v", "members"), "node").withColumn("asks", F.lit(False))
    rows = rows.unionByName(own.select("node", F.col("node").alias("query"), "v", F.lit(None).cast("array<long>").alias("members"), F.lit(True).alias("asks")))
    n_queries = own.count()

    def exact(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        q, asks = _numpy(table.column("query")), _numpy(table.column("asks"))
        flat, lengths = _flat(table.column("v"), np.float64)
        v = flat.reshape(len(lengths), -1)
        order = np.argsort(q[asks])
        of = order[np.searchsorted(q[asks][order], q)]
        with np.errstate(over="ignore"):
            dist = np.sqrt(np.square(v - v[asks][of]).sum(axis=1))
        members, count = _flat(table.column("members"), np.int64)
        # a node comes once a query; an id comes as often as it has vectors
        owner, far = np.repeat(q, count), np.repeat(dist, count)
        order = np.lexsort((members, far, owner))
        order = order[_ranks(owner[order]) < k + 1]
        return pa.table({"node": pa.array(owner[order]), "vec_id": pa.array(members[order]), "dist": pa.array(far[order])})

    hits = rows.groupBy(_bucket("query", n_queries).alias("bucket")).applyInArrow(exact, "node long, vec_id long, dist double")
    # other vectors are never 0 apart: that is the query's own row
    hits = hits.join(own.select("node", "v"), "node").join(asked, "v").where("vec_id <> query_id OR dist > 0")
    rank = F.row_number().over(Window.partitionBy("query_id", "node").orderBy("dist", "vec_id"))
    out = hits.withColumn("rank", rank).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("dist").alias("score"))


def nearest(vectors: DataFrame, *, every: int = 100, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Queries: rows whose id is divisible by ``every``; candidates: all rows
    but the query's own. (query_id, rank, vec_id, score): the k nearest found
    by Euclidean distance in double precision, ties to the smaller id.

    Vectors null, empty, zero or with null or non-finite components and rows
    without an id take no part, as queries neither. Vectors of different
    lengths have no distance: each length is searched by itself. Equal vectors
    are one node of the graph and all answer. Repeated rows of an id and a
    vector count once; an id on several vectors is a row for each, as a query
    too; other columns are ignored; an empty table gives an empty result.
    """
    prepare(vectors.sparkSession)
    good = saved(valid_vectors(vectors, id_col=id_col, vector_col=vector_col).distinct(), "vectors")
    lengths = [r[0] for r in good.select(F.size("v")).distinct().collect()]
    return reduce(DataFrame.unionByName, [_nearest_of_length(good.where(F.size("v") == d), every, k) for d in sorted(lengths) or [0]])
