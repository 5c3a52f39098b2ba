"""Exact removal of repeated word windows behind a count-min prefilter.

1. One scan. Every task cuts its documents into blocks and sketches each
   block: window hashes fall into cells, a cell hit twice inside the block is
   repeated at once, every other cell goes out as (cell, place) in a few
   delta-coded bytes, split by cell range into shards.
2. Merging a shard adds up its cells over all blocks. A count never falls
   below the truth, so each window that occurs twice has a cell counted twice;
   the sketch widens with the input. Places in such cells return to their
   documents.
3. Second pass, only documents with estimated repeats (a fixed-size Bloom
   filter keeps the rest of the texts out of the join) and only their
   estimated windows: 128-bit digests are grouped exactly, each group's first
   place stays, every other one is repeated.
4. Words covered by repeated windows are removed.

Documents with one word sequence are found by its SHA-256 first: all but the
smallest id are repeated as a whole and skip the second pass. A block sends one
entry per cell, so a passage in a third of all documents costs one entry per
block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import cut, fresh, join_by_size, prepare
from .memory import tidy, tidy_group
from .wordhash import HASHED, LANES, Batch, mix, slices, span_sums

BLOCK = 1 << 20  # windows
BLOCK_DOCS = 1 << 15
PLACE_BITS = 22
SHARD = 1 << 21  # windows, about
EXACT_SHARD = 1 << 20
MIN_SHARDS = 64
NULL_ID = -(1 << 63)


def window_hashes(batch: Batch, size: int, lane: int):
    """(hashes, bounds): the windows of text i are hashes[bounds[i]:bounds[i + 1]]."""
    h = batch.words(lane)
    count = np.maximum(0, np.diff(batch.first) - size + 1)
    bounds = np.concatenate(([0], np.cumsum(count)))
    starts = np.repeat(batch.first[:-1] - bounds[:-1], count) + np.arange(bounds[-1])
    return mix(span_sums(h, starts, starts + size, LANES[1 - lane])), bounds


def _few_bytes(x: np.ndarray) -> bytes:
    """Two or three bytes a value where they do, else four; see ``_wide``."""
    x = x.astype("<u4")
    most = int(x.max()) if len(x) else 0
    n = 2 if most < 1 << 16 else 3 if most < 1 << 24 else 4
    return bytes((n,)) + x.view(np.uint8).reshape(-1, 4)[:, :n].tobytes()


def _wide(data: bytes) -> np.ndarray:
    raw, n = np.frombuffer(data, np.uint8)[1:], data[0]
    out = np.zeros((len(raw) // n, 4), np.uint8)
    out[:, :n] = raw.reshape(-1, n)
    return out.view("<u4").ravel().astype(np.int64)


def _runs(places: np.ndarray) -> bytes:
    """Sorted places as (start, end) pairs: repeats come in long runs."""
    edge = np.flatnonzero(np.diff(places) != 1)
    pairs = np.stack([np.concatenate((places[:1], places[edge + 1])), np.concatenate((places[edge], places[-1:])) + 1], axis=1)
    return pairs.astype("<u4").tobytes()


def _from_runs(data: bytes) -> np.ndarray:
    pairs = np.frombuffer(data, "<u4").reshape(-1, 2).astype(np.int64)
    n = pairs[:, 1] - pairs[:, 0]
    return np.repeat(pairs[:, 0] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())


def _rows(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


_PIECES = (["shard", "block", "kind", "a", "b"], [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()])
_SKETCH, _HOT, _DIRECTORY = 0, 1, 2


def _sketch_block(block: int, hashes: np.ndarray, directory: list[tuple], shard_bits: int):
    """Pieces of one block: its sketch by shard, its own repeats, its documents."""
    cell_bits = shard_bits + min(32, 64 - PLACE_BITS - shard_bits)
    own = -1 - block  # spreads what is no sketch
    if len(hashes) <= 1 << PLACE_BITS:
        packed = (hashes >> np.uint64(64 - cell_bits)) << np.uint64(PLACE_BITS)
        packed |= np.arange(len(hashes), dtype=np.uint64)
        packed.sort()
        cells, places = packed >> np.uint64(PLACE_BITS), packed & np.uint64((1 << PLACE_BITS) - 1)
    else:  # one document longer than a block
        cells = hashes >> np.uint64(64 - cell_bits)
        order = np.argsort(cells, kind="stable")
        cells, places = cells[order], order.astype(np.uint64)
    new = np.ones(len(cells), bool)
    new[1:] = cells[1:] != cells[:-1]
    alone = new.copy()
    alone[:-1] &= new[1:]
    hot = places[~alone]
    # a repeated cell goes out once, with no place
    place = np.where(alone, places, np.uint64(0xFFFFFFFF))[new].astype(np.int64)
    place += 1
    place[place == 1 << 32] = 0
    cells = cells[new]
    low = np.uint64(cell_bits - shard_bits)
    edges = np.searchsorted(cells >> low, np.arange((1 << shard_bits) + 1, dtype=np.uint64))
    inside = (cells & np.uint64((1 << int(low)) - 1)).astype(np.int64)
    yield (own, block, _DIRECTORY, b"".join(np.array(d[:4], np.int64).tobytes() + d[4] for d in directory), None)
    if len(hot):
        yield (own, block, _HOT, _few_bytes(hot), None)
    for s in np.flatnonzero(np.diff(edges)).tolist():
        lo, hi = edges[s], edges[s + 1]
        yield (s, block, _SKETCH, _few_bytes(np.diff(inside[lo:hi], prepend=0)), _few_bytes(place[lo:hi]))


def _sketches(docs: DataFrame, window: int, shard_bits: int) -> DataFrame:
    def scan(batches):
        task, seq, parts, directory, size = TaskContext.get().partitionId(), 0, [], [], 0

        def close():
            hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield _rows(list(_sketch_block((task << 24) + seq, hashes, directory, shard_bits)), *_PIECES)

        for whole in batches:
            for b in slices(whole, "text", HASHED):
                batch = Batch(b.column("text"))
                hashes, bounds = window_hashes(batch, window, 0)
                ids, keys = b.column("id").to_pylist(), b.column("row_key").to_pylist()
                n_words = np.diff(batch.first).tolist()
                for i in range(b.num_rows):
                    n = int(bounds[i + 1] - bounds[i])
                    if directory and (size + n > BLOCK or len(directory) >= BLOCK_DOCS):
                        yield from close()
                        seq, parts, directory, size = seq + 1, [], [], 0
                    directory.append((ids[i], keys[i], n_words[i], n, hashlib.sha256(batch.normal(i)).digest()))
                    parts.append(hashes[bounds[i] : bounds[i + 1]])
                    size += n
        if directory:
            yield from close()

    return docs.mapInArrow(tidy(scan), "shard long, block long, kind int, a binary, b binary")


def _merge(table: pa.Table) -> pa.Table:
    """One shard: places in cells that are counted twice or more."""
    out, sketches = [], []
    for block, kind, a, b in zip(*(table.column(c).to_pylist() for c in ("block", "kind", "a", "b")), strict=True):
        if kind == _SKETCH:
            sketches.append((block, np.cumsum(_wide(a)).astype(np.uint32), _wide(b).astype(np.uint32)))
        else:
            out.append((block, kind, a))
    if sketches:
        cells = np.concatenate([c for _, c, _ in sketches])
        cells.sort()
        twice = np.unique(cells[1:][cells[1:] == cells[:-1]])
        if len(twice):
            for block, cells, place in sketches:
                at = np.minimum(np.searchsorted(twice, cells), len(twice) - 1)
                hot = place[(twice[at] == cells) & (place > 0)]
                if len(hot):
                    out.append((block, _HOT, _few_bytes(hot - 1)))
    return pa.Table.from_batches([_rows(out, ["block", "kind", "a"], [pa.int64(), pa.int32(), pa.binary()])])


def _by_document(table: pa.Table) -> pa.Table:
    """One block: its documents with the places of their estimated windows."""
    directory, hot = b"", []
    for kind, a in zip(table.column("kind").to_pylist(), table.column("a").to_pylist(), strict=True):
        if kind == _DIRECTORY:
            directory = a
        else:
            hot.append(_wide(a))
    hot = np.sort(np.concatenate(hot)) if hot else np.zeros(0, np.int64)
    rows, start = [], 0
    for at in range(0, len(directory), 64):
        doc, key, words, n = np.frombuffer(directory[at : at + 32], np.int64).tolist()
        lo, hi = np.searchsorted(hot, [start, start + n])
        rows.append((doc, key, words, directory[at + 32 : at + 64], _runs(hot[lo:hi] - start) if hi > lo else None, int(hi - lo)))
        start += n
    return pa.Table.from_batches([_rows(rows, ["id", "row_key", "n_words", "sha", "hot", "n_hot"], [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()])])


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted(id, row_key, ...)`` with the texts. Texts that cannot be wanted
    are dropped before the shuffle by a Bloom filter of fixed size."""
    bits = bloom.build(wanted.select("id"))

    def scan(batches):
        filter_ = bloom.Bloom(bits)
        for b in batches:
            yield b.filter(pa.array(filter_.might_contain(b.column("id").to_numpy(zero_copy_only=False))))

    near = docs.mapInArrow(tidy(scan), "id long, row_key long, text string").dropDuplicates(["id", "row_key"])
    return near.join(wanted, ["id", "row_key"])


def _earliest(hi, lo, ids, keys, place):
    """Order of the windows that start first: of equal digests those of the
    least id, the first place in each of its rows."""
    order = np.lexsort((place, keys, ids, lo, hi))
    hi, lo, ids, keys = hi[order], lo[order], ids[order], keys[order]
    new = np.ones(len(hi), bool)
    new[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
    row = new.copy()
    row[1:] |= (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])
    least = ids[np.maximum.accumulate(np.where(new, np.arange(len(hi)), 0))] if len(hi) else ids
    return order[row & (ids == least)]


def _first_places(estimated: DataFrame, window: int, shard_bits: int) -> DataFrame:
    """``estimated(id, row_key, text, hot)`` -> (id, row_key, firsts): places
    whose window occurs nowhere earlier, by exact grouping of 128-bit digests.
    A shard's piece names its rows once; windows carry their number."""
    names, types = ["shard", "hi", "lo", "rows", "row", "place"], [pa.int64(), *[pa.binary()] * 5]

    def scan(batches):
        for whole in batches:
            for b in slices(whole, "text", HASHED):
                batch = Batch(b.column("text"))
                hi, bounds = window_hashes(batch, window, 0)
                lo, _ = window_hashes(batch, window, 1)
                hot = [_from_runs(x) for x in b.column("hot").to_pylist()]
                count = [len(x) for x in hot]
                place = np.concatenate(hot) if hot else np.zeros(0, np.int64)
                at = place + np.repeat(bounds[:-1], count)
                ids, keys = (b.column(c).to_numpy(zero_copy_only=False) for c in ("id", "row_key"))
                row = np.repeat(np.arange(b.num_rows), count)
                hi, lo = hi[at], lo[at]
                order = _earliest(hi, lo, ids[row], keys[row], place)
                hi, lo, row, place = hi[order], lo[order], row[order], place[order]
                shard = (hi >> np.uint64(64 - shard_bits)).astype(np.int64)
                edge = np.concatenate(([0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]))
                out = []
                for x, y in zip(edge[:-1], edge[1:], strict=True):
                    if y > x:
                        some, number = np.unique(row[x:y], return_inverse=True)
                        out.append((int(shard[x]), hi[x:y].tobytes(), lo[x:y].tobytes(), ids[some].tobytes() + keys[some].tobytes(), _few_bytes(number), _few_bytes(place[x:y])))
                yield _rows(out, names, types)

    def first(table: pa.Table) -> pa.Table:
        hi, lo = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint64) for c in ("hi", "lo"))
        owners, numbers = [], []
        for rows, number in zip(table.column("rows").to_pylist(), table.column("row").to_pylist(), strict=True):
            owners.append(np.frombuffer(rows, np.int64).reshape(2, -1))
            numbers.append(owners[-1][:, _wide(number)])
        ids, keys = np.concatenate(numbers, axis=1)
        place = np.concatenate([_wide(x) for x in table.column("place").to_pylist()])
        order = _earliest(hi, lo, ids, keys, place)
        ids, keys, place = ids[order], keys[order], place[order]
        order = np.lexsort((keys, ids))
        ids, keys, place = ids[order], keys[order], place[order]
        edge = np.concatenate(([0], np.flatnonzero((np.diff(ids) != 0) | (np.diff(keys) != 0)) + 1, [len(ids)]))
        return pa.Table.from_batches([_rows([(int(ids[x]), int(keys[x]), _few_bytes(place[x:y])) for x, y in zip(edge[:-1], edge[1:], strict=True)], ["id", "row_key", "first"], [pa.int64(), pa.int64(), pa.binary()])])

    shards = estimated.mapInArrow(tidy(scan), "shard long, hi binary, lo binary, rows binary, row binary, place binary")
    firsts = shards.groupBy("shard").applyInArrow(tidy_group(first), "id long, row_key long, first binary")
    return firsts.groupBy("id", "row_key").agg(F.collect_list("first").alias("firsts"))


def _with_copies(rows: DataFrame, window: int) -> DataFrame:
    """Adds ``copy``: a smaller id has the same words."""
    long_ = rows.where(F.col("n_words") >= window)
    copies = cut(long_.groupBy("sha").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "least", "n"))
    copy = F.coalesce(F.col("id") > F.col("least"), F.lit(False)).alias("copy")
    short = rows.where(F.col("n_words") < window).select(*rows.columns, F.lit(False).alias("copy"))
    return short.unionByName(join_by_size(long_, copies, ["sha"], "n", rows.count(), how="left").select(*rows.columns, copy))


def repeated_spans(docs: DataFrame, *, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row_key, n_words, sha, removed): per distinct row of (id, text) the
    word spans [start, end) to remove, gaps between them at least one word.

    A window of ``window`` words is repeated if its words also start earlier:
    in a smaller id, or earlier in the same document. Null texts have no words;
    a null id counts as smaller than any other and comes back as NULL_ID. Rows
    with equal id and text are judged as one document; rows with one id (or
    none) and different texts are different documents, none before the other. sha is the SHA-256 of
    all words joined by one space.
    """
    spark = prepare(docs.sparkSession)
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("row_key"), F.coalesce(text_col, F.lit("")).alias("text"))
    size = docs.select(F.coalesce(F.sum(F.octet_length(text_col).cast("long")), F.lit(0))).first()[0]
    shard_bits = int(np.ceil(np.log2(max(MIN_SHARDS, size / 6 / SHARD))))

    pieces = _sketches(source, window, shard_bits).groupBy("shard").applyInArrow(tidy_group(_merge), "block long, kind int, a binary")
    rows = pieces.groupBy("block").applyInArrow(tidy_group(_by_document), "id long, row_key long, n_words long, sha binary, hot binary, n_hot long")
    rows = cut(rows.dropDuplicates(["id", "row_key"]))

    rows = cut(_with_copies(rows, window))

    estimated = rows.where("NOT copy AND hot IS NOT NULL").select("id", "row_key", "hot")
    n_hot = rows.where("NOT copy").select(F.coalesce(F.sum("n_hot"), F.lit(0))).first()[0]
    exact_bits = int(np.ceil(np.log2(max(MIN_SHARDS, n_hot / EXACT_SHARD))))
    firsts = _first_places(_texts_of(source, estimated), window, exact_bits)

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def spans(hot, firsts_, words):
        import pandas as pd

        out = []
        for h, f, n in zip(hot, firsts_, words, strict=True):
            place = _from_runs(h)
            kept = np.concatenate([_wide(x) for x in f]) if f is not None and len(f) else np.zeros(0, np.int64)
            place = np.setdiff1d(place, kept)
            cover = np.zeros(int(n) + 1, np.int64)
            np.add.at(cover, place, 1)
            np.add.at(cover, place + window, -1)
            on = np.diff((np.cumsum(cover) > 0).astype(np.int8), prepend=0, append=0)
            out.append([{"start": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(on == 1), np.flatnonzero(on == -1), strict=True)])
        return pd.Series(out)

    judged = estimated.join(rows.select("id", "row_key", "n_words"), ["id", "row_key"]).join(firsts, ["id", "row_key"], "left")
    judged = cut(judged.select("id", "row_key", spans("hot", "firsts", "n_words").alias("spans")))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    return rows.join(judged, ["id", "row_key"], "left").select("id", "row_key", "n_words", "sha", F.when(F.col("copy"), whole).otherwise(F.coalesce("spans", none)).alias("removed"))


def kept_texts(docs: DataFrame, spans: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row_key, kept) for documents that lose some words but not all: the
    words that stay, joined by one space."""
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("row_key"), F.coalesce(text_col, F.lit("")).alias("text"))
    some = spans.where("size(removed) > 0 AND NOT (size(removed) = 1 AND removed[0].end - removed[0].start = n_words)")
    some = cut(some.select("id", "row_key", F.col("removed.start").alias("lo"), F.col("removed.end").alias("hi")))

    def scan(batches):
        for whole in batches:
            for b in slices(whole, "text", HASHED):
                batch = Batch(b.column("text"))
                out = []
                for i, (lo, hi) in enumerate(zip(b.column("lo").to_pylist(), b.column("hi").to_pylist(), strict=True)):
                    first, last = batch.first[i], batch.first[i + 1]
                    stay = zip([0, *hi], [*lo, int(last - first)], strict=True)
                    out.append(b" ".join(batch.joined(first + x, first + y) for x, y in stay if y > x))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("row_key"), pa.array(out, pa.binary()).cast(pa.string())], ["id", "row_key", "kept"])

    return _texts_of(source, some).mapInArrow(tidy(scan), "id long, row_key long, kept string")


def _identified(docs: DataFrame, id_col: str, text_col: str) -> list:
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("row_key")]


def dedup_report(docs: DataFrame, *, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 (lowercase
    hex of the kept words joined by one space). See ``repeated_spans`` for
    nulls, ties and repeated rows; an empty table gives an empty result."""
    spans = cut(repeated_spans(docs, window=window, id_col=id_col, text_col=text_col))
    kept = kept_texts(docs, spans, id_col=id_col, text_col=text_col).select("id", "row_key", F.sha2("kept", 256).alias("kept_sha"))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    judged = spans.withColumn("n_removed", n_removed).join(kept, ["id", "row_key"], "left")
    digest = F.when(F.col("n_removed") == 0, F.lower(F.hex("sha"))).when(F.col("n_removed") == F.col("n_words"), F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha"))
    judged = judged.select("id", "row_key", "n_words", "n_removed", digest.alias("kept_sha256"))
    rows = docs.select(*_identified(docs, id_col, text_col))
    rows = rows.groupBy("id", "row_key").count()
    out = judged.join(rows, ["id", "row_key"]).select(F.nullif("id", F.lit(NULL_ID)).alias("doc_id"), "n_words", "n_removed", "kept_sha256", F.explode(F.sequence(F.lit(1), F.col("count"))).alias("_n"))
    return out.drop("_n")


def remove_repeats(docs: DataFrame, *, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated windows cut out of the text (the kept words,
    joined by one space). No row is dropped: texts that lose nothing stay as
    they are, those that lose every word become empty. ``n_chars``, where there
    is one, follows the text. See ``repeated_spans`` for nulls, ties and
    repeated rows; an empty table gives an empty result."""
    spans = cut(repeated_spans(docs, window=window, id_col=id_col, text_col=text_col))
    kept = kept_texts(docs, spans, id_col=id_col, text_col=text_col)
    gone = spans.where("n_words > 0 AND size(removed) = 1 AND removed[0].end - removed[0].start = n_words").select("id", "row_key", F.lit("").alias("kept"))
    n_id, n_key, n_kept = (fresh(docs, n) for n in ("_id", "_key", "_kept"))
    change = kept.select("id", "row_key", "kept").unionByName(gone).select(F.col("id").alias(n_id), F.col("row_key").alias(n_key), F.col("kept").alias(n_kept))
    ident = _identified(docs, id_col, text_col)
    joined = docs.join(change, (ident[0] == F.col(n_id)) & (ident[1] == F.col(n_key)), "left")
    columns = {c: F.col(c) for c in docs.columns} | {text_col: F.coalesce(n_kept, text_col)}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col(n_kept).isNotNull(), F.char_length(n_kept)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return joined.select(*[v.alias(k) for k, v in columns.items()])
