"""MinHash near-duplicates found with an LSH forest.

Plan (n documents, all steps linear in n):

1. One scan gives every document a 128-bit hash of its shingle set, a MinHash
   signature and a sketch of it. Equal sets fall into one class, so copies by
   the thousands cost one row from here on.
2. Forest: the signature is cut into ``TREES`` keys, each of which puts the
   class representatives in one sorted order. Neighbours in an order share a
   prefix of their keys; a run of rows that share ``MIN_DEPTH`` values is a
   region. A region of more than ``LEAF`` rows is split where its neighbours'
   longest common prefix is shorter than 3 values, then 4, until the parts fit
   (``leaves``); all pairs of a part are met. Candidates are thinned by a
   sketch of the signature that misses a true pair with a chance below 1e-6.
3. One more scan of the documents gives the full shingle sets of all
   candidates. Groups are confirmed on them in two passes. The first takes the
   leaves of ``FIRST_TREES`` trees and, as the rows of a region that was split
   must be looked at beyond their parts, these rows beside its hub, the row
   whose keys most others repeat.
4. The second pass takes what still joins different components: all other
   leaves, and every two rows of a split region, in a pair of blocks
   (``block_groups``). Rows of its largest component do not meet each other, so
   a family that is linked costs one pass. Only a spanning set of links leaves
   a group.
5. Components of the links by contraction (``components``).

A pair at the threshold shares a prefix in at least one tree with probability
1 - (1 - 0.8**2)**12 > 0.99999.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bloom
from .common import cut, fresh, prepare, width
from .components import components
from .memory import tidy, tidy_group
from .wordhash import HASHED, Batch, mix, slices, span_sums, windows

TREES = 12
DEPTH = 8
MIN_DEPTH = 2
LEAF = 512
#: Rows of a sorted order that a task splits into regions at once, without
#: the LEAF rows it sees to either side.
SPAN = 4096
#: Rows of a block of an overfull region whose sketches are compared in one task.
WIDE = 1024
FIRST_TREES = 2
HASHES = TREES * DEPTH
_MULT = (np.random.default_rng(20240501).integers(0, 1 << 31, HASHES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_SHORT = 0xA24BAED4963EE407


def shingle_sets(column: pa.Array, words: int):
    """(hashes, bounds): sorted distinct shingles of text i are
    hashes[bounds[i]:bounds[i + 1]]. Texts with fewer words than a shingle
    have their whole sequence as the only one; texts without words have none.
    """
    batch = Batch(column, lower=True)
    h = batch.words()
    count = np.diff(batch.first)
    all_windows = windows(h, words)
    short = span_sums(h, batch.first[:-1], batch.first[1:], _SHORT)
    short = mix(short + np.uint64(_SHORT) * count.astype(np.uint64))
    parts, sizes = [], np.zeros(len(batch), dtype=np.int64)
    for i, n in enumerate(count.tolist()):
        if n >= words:
            part = np.unique(all_windows[batch.first[i] : batch.first[i + 1] - words + 1])
        elif n:
            part = short[i : i + 1]
        else:
            continue
        parts.append(part)
        sizes[i] = len(part)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return flat, np.concatenate(([0], np.cumsum(sizes)))


def set_hashes(flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every shingle set; 0 for empty ones."""
    hi, lo = np.zeros(len(bounds) - 1, np.uint64), np.zeros(len(bounds) - 1, np.uint64)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        hi[full] = np.add.reduceat(mix(flat), bounds[:-1][full])
        lo[full] = np.add.reduceat(mix(flat ^ np.uint64(_SHORT)), bounds[:-1][full])
    return hi.view(np.int64), lo.view(np.int64)


def _binary(matrix: np.ndarray) -> pa.Array:
    """Rows of a matrix as a binary column."""
    matrix = np.ascontiguousarray(matrix)
    n, step = len(matrix), matrix.itemsize * (matrix.shape[1] if matrix.ndim > 1 else 1)
    offsets = np.arange(n + 1, dtype=np.int32) * np.int32(step)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(matrix)])


def signatures(docs: DataFrame, *, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_key, n_shingles, set_hi, set_lo, sig, sketch): row_key is a
    hash of the text, sig holds HASHES MinHash values (big-endian, so bytes sort
    as values do), sketch two bits of each; both null for texts without words."""
    schema = "doc_id long, row_key long, n_shingles long, set_hi long, set_lo long, sig binary, sketch binary"

    def scan(batches):
        for whole in batches:
            for b in slices(whole, "text", HASHED):
                flat, bounds = shingle_sets(b.column("text"), words)
                sizes = np.diff(bounds)
                full = np.flatnonzero(sizes)
                at = bounds[:-1][full]
                n = b.num_rows
                hi, lo = set_hashes(flat, bounds)
                sig = np.zeros((n, HASHES), np.uint32)
                if len(full):
                    x = (flat >> np.uint64(32)).astype(np.uint32)
                    for j in range(HASHES):
                        sig[full, j] = np.minimum.reduceat(x * _MULT[j], at)
                bits = mix(sig.astype(np.uint64))
                planes = [np.packbits(((bits >> np.uint64(s)) & np.uint64(1)).astype(np.uint8), axis=1) for s in (7, 41)]
                columns = [_binary(sig.astype(">u4")), _binary(np.concatenate(planes, axis=1))]
                if len(full) < n:
                    columns = [pa.array([v if s else None for v, s in zip(c.to_pylist(), sizes.tolist(), strict=True)], pa.binary()) for c in columns]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("row_key"), pa.array(sizes), pa.array(hi), pa.array(lo), *columns], ["doc_id", "row_key", "n_shingles", "set_hi", "set_lo", "sig", "sketch"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("row_key"), F.col(text_col).alias("text")).mapInArrow(tidy(scan), schema)


def _tree_rows(reps: DataFrame) -> DataFrame:
    """One row per representative and tree: the tree's key, its region's prefix
    and the sketch of the whole signature."""
    rows = reps.select(F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), F.col("node").alias("rep"), "sig", "sketch")
    rows = rows.select("tree", F.expr(f"substring(sig, {4 * DEPTH} * tree + 1, {4 * DEPTH})").alias("key"), "rep", "sketch")
    return rows.withColumn("prefix", F.substring("key", 1, 4 * MIN_DEPTH))


def _least(threshold: int) -> float:
    """Sketch agreement below which a pair is not at the threshold."""
    j = threshold / 100
    p = j + (1 - j) / 4
    return HASHES * p - 5 * np.sqrt(HASHES * p * (1 - p))


def _planes(sketch: np.ndarray) -> np.ndarray:
    """Sketches as (row, plane, 64-bit word)."""
    half = sketch.shape[1] // 2
    words = np.zeros((len(sketch), 2, -(-half // 8) * 8), np.uint8)
    words[:, 0, :half], words[:, 1, :half] = sketch[:, :half], sketch[:, half:]
    return words.view(np.uint64)


def _clusters(sketch: np.ndarray, least: float) -> list[np.ndarray]:
    """Index sets, of two rows or more, connected by sketch agreement."""
    m = len(sketch)
    words = _planes(sketch)
    out, seen = [], np.zeros(m, bool)
    for i in range(m):
        if seen[i]:
            continue
        seen[i] = True
        members, front = [i], [i]
        while front:
            j = front.pop()
            rest = np.flatnonzero(~seen)
            if not len(rest):
                break
            differ = np.bitwise_count((words[rest, 0] ^ words[j, 0]) | (words[rest, 1] ^ words[j, 1])).sum(axis=1)
            near = rest[HASHES - differ.astype(np.int64) >= least]
            seen[near] = True
            members += near.tolist()
            front += near.tolist()
        if len(members) > 1:
            out.append(np.array(members))
    return out


def _runs(rows: DataFrame) -> DataFrame:
    """``rows`` in every tree's sorted order, by ranges of (tree, key, rep), less
    those that share no region with a neighbour; the first and the last row of
    a partition stay, as theirs are elsewhere."""
    n = width(rows.sparkSession)
    ordered = rows.repartitionByRange(n, "tree", "key", "rep").sortWithinPartitions("tree", "key", "rep")

    def scan(batches):
        held, alike = None, True
        for b in batches:
            if not b.num_rows:
                continue
            if held is not None:
                b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            places = b.column("tree").to_numpy(zero_copy_only=False), np.array(b.column("prefix").to_pylist(), object)
            same = (places[0][1:] == places[0][:-1]) & (places[1][1:] == places[1][:-1])
            stays = np.concatenate(([alike], same[:-1])) | same if len(same) else np.zeros(0, bool)
            yield b.slice(0, len(same)).filter(pa.array(stays, pa.bool_()))
            # the last row waits for its next neighbour
            held, alike = b.slice(len(same)), bool(same[-1]) if len(same) else alike
        if held is not None:
            yield held

    return ordered.mapInArrow(tidy(scan), ordered.schema)


def forest_order(rows: DataFrame) -> DataFrame:
    """``_runs`` with ``pos``, every row's place in the one order of all trees."""
    ordered = cut(_runs(rows)).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    # one number a partition
    sizes = {r["_part"]: r["n"] for r in ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, at = [], 0
    for part in range(max(sizes, default=0) + 1):
        starts.append(at)
        at += sizes.get(part, 0)
    # from an Arrow table: rows would start a second set of Python workers
    starts = F.broadcast(rows.sparkSession.createDataFrame(pa.table({"_part": pa.array(range(len(starts)), pa.int32()), "_start": pa.array(starts, pa.int64())})))
    return ordered.join(starts, "_part").withColumn("pos", F.col("_start") + F.col("_at")).drop("_part", "_start", "_at")


def common_prefix(tree: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Leading values that rows i and i + 1 have in common, none across trees."""
    same = np.cumprod(keys[1:] == keys[:-1], axis=1).sum(axis=1)
    return np.where(tree[1:] == tree[:-1], same, 0)


def leaves(lcp: np.ndarray, leaf: int, least: int, most: int) -> list[tuple[int, int, int]]:
    """(depth, first row, end): the parts of a sorted order whose neighbours
    share ``depth`` values, at the least depth from ``least`` to ``most`` at
    which the part has at most ``leaf`` rows. Rows alone, and runs too large
    at any depth, are in none."""
    out, done = [], np.zeros(len(lcp) + 1, bool)
    for depth in range(least, most + 1):
        bounds = np.concatenate(([0], np.flatnonzero(lcp < depth) + 1, [len(lcp) + 1]))
        size = np.diff(bounds)
        for r in np.flatnonzero((size <= leaf) & ~done[bounds[:-1]]).tolist():
            done[bounds[r] : bounds[r + 1]] = True
            if size[r] > 1:
                out.append((depth, int(bounds[r]), int(bounds[r + 1])))
    return out


def split_order(order: DataFrame, *, threshold: int) -> DataFrame:
    """The leaves and the overfull regions of the sorted orders ``forest_order``.

    Rows with a ``depth``: (tree, depth, gid, member), groups that may hold
    pairs at the threshold; a group's id is a hash of its members, so trees that
    agree repeat it. Rows without: (tree, prefix, member, sketch, alike, block),
    the rows of regions above LEAF; alike counts the rows of the same key near
    it, a block is LEAF rows of the order.

    The order is dealt in spans of SPAN rows with LEAF rows of the spans beside
    it: a run that reaches from a span's own rows to the end of what it sees is
    too large in any case, so all spans agree on a leaf, and the span of its
    first row returns it; a row of an overfull region comes from its own span."""
    least, leaf, span = _least(threshold), LEAF, SPAN
    spans = F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col("pos") - leaf) / span)).cast("int"), F.floor((F.col("pos") + leaf) / span).cast("int")))
    dealt = order.select("tree", "key", "rep", "sketch", "prefix", "pos", spans.alias("span"))

    def split(table: pa.Table) -> pa.Table:
        pos = table.column("pos").to_numpy()
        table, pos, own = table.take(pa.array(np.argsort(pos))), np.sort(pos), table.column("span")[0].as_py()
        tree, ids = (table.column(c).to_numpy() for c in ("tree", "rep"))
        keys = np.frombuffer(b"".join(table.column("key").to_pylist()), ">u4").reshape(len(ids), -1)
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(ids), -1)
        shared = common_prefix(tree, keys)
        trees, depths, gids, members = [], [], [], []
        for depth, lo, hi in leaves(shared, leaf, MIN_DEPTH, DEPTH):
            if pos[lo] // span != own:
                continue
            for found in _clusters(sketch[lo:hi], least):
                group = ids[lo:hi][found]
                trees.append(np.full(len(group), tree[lo], np.int32))
                depths.append(np.full(len(group), depth, np.int32))
                gids.append(np.full(len(group), mix(group.view(np.uint64)).sum(dtype=np.uint64).view(np.int64)))
                members.append(group)
        columns = [np.concatenate(x) if x else np.zeros(0, t) for x, t in ((trees, np.int32), (depths, np.int32), (gids, np.int64), (members, np.int64))]
        groups = pa.table(dict(zip(("tree", "depth", "gid", "member"), columns, strict=True)))
        region, alike = (np.concatenate(([0], np.cumsum(shared < depth))) for depth in (MIN_DEPTH, DEPTH))
        over = np.flatnonzero((np.bincount(region)[region] > leaf) & (pos // span == own))
        hot = table.take(pa.array(over)).select(["tree", "prefix", "rep", "sketch"]).rename_columns(["tree", "prefix", "member", "sketch"])
        hot = hot.append_column("alike", pa.array(np.bincount(alike)[alike][over])).append_column("block", pa.array(pos[over] // leaf))
        both = pa.concat_tables([groups, hot], promote_options="default")
        return both.select(["tree", "depth", "gid", "member", "prefix", "sketch", "alike", "block"])

    return dealt.groupBy("span").applyInArrow(tidy_group(split), "tree int, depth int, gid long, member long, prefix binary, sketch binary, alike long, block long")


def candidate_groups(order: DataFrame, *, threshold: int) -> DataFrame:
    """(tree, depth, gid, member): the groups of ``split_order``."""
    return split_order(order, threshold=threshold).where("depth IS NOT NULL").select("tree", "depth", "gid", "member")


def hub_groups(hot: DataFrame) -> DataFrame:
    """(gid, member, lead): every row of the overfull regions beside its
    region's hub, the lead. The text that many others were made from repeats the most keys."""
    place = ["tree", "prefix"]
    scored = cut(hot.select(*place, "rep", "block", F.sum("alike").over(Window.partitionBy("rep")).alias("score")))
    hub = scored.groupBy(*place).agg(F.max_by("rep", F.struct("score", -F.col("rep"))).alias("hub"))
    pairs = scored.join(hub, place).where("hub <> rep").groupBy("hub", "rep").agg(F.min(F.struct("tree", "block")).alias("at"))
    ends = F.explode(F.array(F.struct(F.col("rep").alias("member"), F.lit(False).alias("lead")), F.struct(F.col("hub").alias("member"), F.lit(True).alias("lead"))))
    return pairs.select(F.xxhash64("hub", "at.tree", "at.block").alias("gid"), ends.alias("end")).select("gid", "end.*").distinct()


def block_groups(hot: DataFrame, label: DataFrame, *, threshold: int) -> DataFrame:
    """(gid, member, known): groups that hold, for every two rows of an overfull
    region in different components of ``label(node, component)`` whose
    sketches agree, both of them.

    The rows outside the region's largest component are dealt to blocks by a
    hash, as are those inside; every outer block meets every block."""
    least = _least(threshold)
    place = ["tree", "prefix"]
    h = hot.join(label.select(F.col("node").alias("rep"), "component"), "rep", "left")
    h = cut(h.select(*place, "rep", "sketch", F.coalesce("component", "rep").alias("known")))
    per = h.groupBy(*place, "known").agg(F.count(F.lit(1)).alias("n"))
    top = per.groupBy(*place).agg(F.max_by("known", F.struct("n", "known")).alias("top"), F.max("n").alias("inner"), F.sum("n").alias("all"))
    top = top.where("all > inner").select(*place, "top", "all", F.ceil(F.col("inner") / WIDE).alias("inside"), F.ceil((F.col("all") - F.col("inner")) / WIDE).alias("outside"))
    h = h.join(top.drop("all"), place).withColumn("is_in", F.expr("known = top"))
    h = h.withColumn("own", F.pmod(F.xxhash64("rep"), F.when(F.col("is_in"), F.col("inside")).otherwise(F.col("outside"))))
    # (kind, i, j, second): kind 1 has an inner block j; second tells the side
    meets = F.expr("""explode(if(is_in,
        transform(sequence(0L, outside - 1), i -> struct(1 AS kind, i AS i, own AS j, true AS second)),
        concat(transform(sequence(0L, outside - 1), o -> struct(0 AS kind, least(own, o) AS i, greatest(own, o) AS j, own > o AS second)),
               transform(sequence(0L, inside - 1), j -> struct(1 AS kind, own AS i, j AS j, false AS second)))))""")
    h = h.select(*place, "rep", "known", "sketch", meets.alias("m")).select(*place, "m.*", "rep", "known", "sketch")

    def meet(table: pa.Table) -> pa.Table:
        ids, known, second = (table.column(c).to_numpy() for c in ("rep", "known", "second"))
        words = _planes(np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(ids), -1))
        inside = not table.column("kind")[0].as_py() and table.column("i")[0] == table.column("j")[0]
        order = np.argsort(ids)
        left, right = (order, order) if inside else (order[~second[order]], order[second[order]])
        step, gids, members = max(1, LEAF // 2), [], []
        for x in range(0, len(left), step):
            a = left[x : x + step]
            for y in range(x if inside else 0, len(right), step):
                b = right[y : y + step]
                differ = sum(np.bitwise_count((words[a, None, 0, k] ^ words[None, b, 0, k]) | (words[a, None, 1, k] ^ words[None, b, 1, k])).astype(np.int64) for k in range(words.shape[2]))
                near = (HASHES - differ >= least) & (known[a, None] != known[None, b])
                found = np.unique(np.concatenate([a[near.any(axis=1)], b[near.any(axis=0)]]))
                if len(found):
                    members.append(found)
                    gids.append(mix(ids[found].view(np.uint64)).sum(dtype=np.uint64).view(np.int64))
        flat = np.concatenate(members) if members else np.zeros(0, np.int64)
        gid = np.repeat(np.array(gids, np.int64), [len(m) for m in members]) if members else flat
        return pa.table({"gid": gid, "member": ids[flat], "known": known[flat]})

    met = h.groupBy(*place, "kind", "i", "j").applyInArrow(tidy_group(meet), "gid long, member long, known long")
    return met.distinct()


def _full_sets(docs: DataFrame, classes: DataFrame, members: DataFrame, *, words: int, id_col: str, text_col: str) -> DataFrame:
    """(member, shingles): the full shingle sets of ``members(member)``, nodes of
    ``classes(node, set_hi, set_lo, rep)``, in one scan of the documents."""
    wanted_sets = cut(classes.withColumnRenamed("node", "member").join(members, "member", "left_semi").select("member", "set_hi", "set_lo", "rep"))
    bits = bloom.build(wanted_sets.select("rep"))

    def scan(batches):
        wanted = bloom.Bloom(bits)
        for whole in batches:
            ids = whole.column("doc_id").to_numpy(zero_copy_only=False)
            whole = whole.filter(pa.array(wanted.might_contain(ids)))
            for b in slices(whole, "text", HASHED):
                flat, bounds = shingle_sets(b.column("text"), words)
                data, (hi, lo) = flat.tobytes(), set_hashes(flat, bounds)
                yield pa.RecordBatch.from_arrays([pa.array(hi), pa.array(lo), b.column("doc_id"), pa.array([data[8 * x : 8 * y] for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary())], ["set_hi", "set_lo", "rep", "shingles"])

    source = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    source = source.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sets = source.mapInArrow(tidy(scan), "set_hi long, set_lo long, rep long, shingles binary")
    return cut(sets.join(wanted_sets, ["set_hi", "set_lo", "rep"]).select("member", "shingles"))


def _confirm(groups: DataFrame, sets: DataFrame, *, threshold: int) -> DataFrame:
    """Links (a, b) between components on full shingle ``sets(member,
    shingles)`` within ``groups(gid, member, known, lead)``. ``known`` is the
    component already found; only links that join different ones are looked
    for. In a group with leads only links of the leads are."""

    def verify(table: pa.Table) -> pa.Table:
        ids, known, raw = table.column("member").to_pylist(), table.column("known").to_pylist(), table.column("shingles").to_pylist()
        one = {}
        for i, k, s, x in zip(ids, known, raw, table.column("lead").to_pylist(), strict=True):
            one.setdefault(i, (k, np.frombuffer(s, np.uint64), x))
        ids = sorted(one)
        sets_ = [one[i][1] for i in ids]
        size = np.array([len(s) for s in sets_])
        label = np.unique([one[i][0] for i in ids], return_inverse=True)[1]
        at_lead = np.array([one[i][2] for i in ids], bool)
        links = []
        for i in np.flatnonzero(at_lead).tolist() or range(len(ids)):
            small, large = np.minimum(size, size[i]), np.maximum(size, size[i])
            others = np.flatnonzero((label != label[i]) & ((np.arange(len(ids)) > i) | at_lead[i]) & (100 * small >= threshold * large))
            if not len(others) or not size[i]:
                continue
            flat = np.concatenate([sets_[j] for j in others])
            at = np.searchsorted(sets_[i], flat)
            hit = sets_[i][np.minimum(at, size[i] - 1)] == flat
            common = np.add.reduceat(hit.astype(np.int64), np.concatenate(([0], np.cumsum(size[others])[:-1])))
            for j in others[100 * common >= threshold * (size[others] + size[i] - common)]:
                if label[j] != label[i]:
                    links.append((one[ids[i]][0], one[ids[j]][0]))
                    label[label == label[j]] = label[i]
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return groups.join(sets, "member").groupBy("gid").applyInArrow(tidy_group(verify), "a long, b long")


def near_duplicates(docs: DataFrame, *, words: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group documents whose shingle sets have ``100 * common >= threshold *
    union``.

    A-Z are lower-cased; words are runs of bytes other than space and
    \\x09-\\x0D. Result: doc_id, n_shingles (set size), component_id (smallest
    doc_id reachable over links), kept (doc_id = component_id).

    Nulls, empty texts and texts without words have an empty set, link with
    nothing and are kept. Rows without an id are neither compared nor merged.
    Rows that repeat a doc_id are judged by their own text and returned once
    each. Other columns are ignored. An empty table gives an empty result.
    """
    return _judged(docs, words=words, threshold=threshold, id_col=id_col, text_col=text_col).drop("row_key")


def _judged(docs: DataFrame, *, words: int, threshold: int, id_col: str, text_col: str) -> DataFrame:
    """``near_duplicates`` with row_key. Nodes of the link graph are classes of
    equal sets."""
    prepare(docs.sparkSession)
    base = cut(signatures(docs, words=words, id_col=id_col, text_col=text_col))
    some = base.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = some.groupBy("set_hi", "set_lo").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig"), F.first("sketch").alias("sketch"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))
    order = forest_order(_tree_rows(classes))
    classes = classes.drop("sig", "sketch")
    split = cut(split_order(order, threshold=threshold))
    sets = _full_sets(docs, classes, split.select("member"), words=words, id_col=id_col, text_col=text_col)
    found = split.where("depth IS NOT NULL").select("tree", "gid", "member")
    hot = split.where("depth IS NULL").select("tree", "prefix", F.col("member").alias("rep"), "sketch", "alike", "block")
    overfull = not hot.isEmpty()

    # leaves of the first trees, and hubs
    first = F.col("tree") < FIRST_TREES
    part = found.where(first).select("gid", "member").distinct().withColumn("lead", F.lit(False))
    part = part.unionByName(hub_groups(hot)) if overfull else part
    label = cut(components(_confirm(part.withColumn("known", F.col("member")), sets, threshold=threshold)))

    # all other leaves and every pair of overfull regions, where they join
    # different components
    own = found.where(~first).select("gid", "member").distinct()
    own = own.join(label.select(F.col("node").alias("member"), F.col("component").alias("known")), "member", "left").withColumn("known", F.coalesce("known", "member"))
    whole = Window.partitionBy("gid")
    own = own.withColumns({"lo": F.min("known").over(whole), "hi": F.max("known").over(whole)}).where("lo <> hi").drop("lo", "hi")
    own = cut((own.unionByName(block_groups(hot, label, threshold=threshold)) if overfull else own).withColumn("lead", F.lit(False)))
    placed = classes.join(label, "node", "left").withColumns({"linked": F.col("component").isNotNull(), "component": F.coalesce("component", "node")})
    if not own.isEmpty():
        merged = cut(components(_confirm(own, sets, threshold=threshold))).select(F.col("node").alias("component"), F.col("component").alias("into"))
        placed = placed.join(merged, "component", "left").withColumns({"linked": F.expr("linked OR into IS NOT NULL"), "component": F.coalesce("into", "component")})

    # a component's id is its least document; classes of one row, in no
    # component, need no join
    placed = cut(placed.where("linked OR copies > 1").select("set_hi", "set_lo", "rep", "component"))
    least = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    placed = placed.join(least, "component").select("set_hi", "set_lo", "component_id")
    result = ["doc_id", "row_key", "n_shingles"]
    alone = base.where("n_shingles = 0 OR doc_id IS NULL").select(*result, F.col("doc_id").alias("component_id"))
    others = some.join(placed, ["set_hi", "set_lo"], "left").select(*result, F.coalesce("component_id", "doc_id").alias("component_id"))
    joined = alone.unionByName(others)
    return joined.select(*result, "component_id", F.col("component_id").eqNullSafe(F.col("doc_id")).alias("kept"))


def keep_one(docs: DataFrame, *, words: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group; its columns are unchanged.
    Rows without an id are kept; rows that repeat an id and a text stay or go
    together. Nulls and empty texts stay; an empty table gives an empty result."""
    groups = _judged(docs, words=words, threshold=threshold, id_col=id_col, text_col=text_col)
    name, key = fresh(docs, "_gone"), fresh(docs, "_gone_key")
    gone = cut(groups.where("NOT kept").select(F.col("doc_id").alias(name), F.col("row_key").alias(key)).distinct())
    return docs.join(gone, (docs[id_col] == gone[name]) & (F.xxhash64(docs[text_col]) == gone[key]), "left_anti")
