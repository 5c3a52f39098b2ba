"""Ranked lexical search as a blocked sparse matrix product.

Items times terms (how often an item asks for a term) meets terms times
documents (64-bit integer impacts). Documents are read once and kept as sparse
columns over the terms that items ask for; the product is taken block by block
of documents: an item's row is merged from the rows of its terms, and only its
best documents leave a block, a partition and then the groups of partitions.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import best_rows, prepare, written
from .wordhash import Batch, slices

#: Bytes between terms: ASCII but for letters and digits.
BETWEEN = np.array([c < 0x80 and not chr(c).isalnum() for c in range(256)])
#: Items that are searched in one pass over the documents, and their text.
BLOCK_ITEMS, BLOCK_BYTES = 2048, 4 << 20
#: Documents and cells of one block of the matrix product.
BLOCK_DOCS, BLOCK_CELLS = 8192, 1 << 21

_VECTORS = "doc_id long, n long, terms binary, counts binary"


class Items:
    """A block of items: ids of their terms, by two 64-bit hashes."""

    def __init__(self, texts: list[str | None]):
        batch = Batch(pa.array(texts, pa.string()), lower=True, separators=BETWEEN)
        hashes, second = batch.words(0), batch.words(1)
        self.hashes, first, of = np.unique(hashes, return_index=True, return_inverse=True)
        self.second = second[first]
        if not np.array_equal(second, self.second[of]):
            raise ValueError("two terms share a 64-bit hash")
        #: per item: its terms and how often it asks for each
        self.rows = [np.unique(of[lo:hi], return_counts=True) for lo, hi in zip(batch.first[:-1], batch.first[1:], strict=True)]

    def __len__(self) -> int:
        return len(self.hashes)


def vectors(docs: DataFrame, items: Items, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with a term: n terms with repeats; ids and counts (int32) of
    the terms that ``items`` ask for."""
    prepare(docs.sparkSession)

    def scan(batches):
        for whole in batches:
            for b in slices(whole, "text"):
                batch = Batch(b.column("text"), lower=True, separators=BETWEEN)
                n = np.diff(batch.first)
                hashes = batch.words(0)
                at = np.searchsorted(items.hashes, hashes)
                at[at == len(items)] = 0
                hit = np.flatnonzero(items.hashes[at] == hashes) if len(items) else np.zeros(0, np.int64)
                hit = hit[items.second[at[hit]] == batch.words(1)[hit]]
                cells, counts = np.unique(batch.owners()[hit] * len(items) + at[hit], return_counts=True)
                owner, term = np.divmod(cells, max(1, len(items)))
                ends = 4 * np.searchsorted(owner, np.arange(len(n) + 1)).astype(np.int32)
                keep = np.flatnonzero(n)
                packed = [pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(c.astype("<i4"))]) for c in (term, counts)]
                columns = [b.column("doc_id"), pa.array(n), *packed]
                yield pa.RecordBatch.from_arrays([c.take(pa.array(keep)) for c in columns], ["doc_id", "n", "terms", "counts"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scan, _VECTORS)


def _flat(b: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """int32 values of a binary column and their number in each row."""
    c = b.column(column)
    rows = [np.frombuffer(x, "<i4") for x in c.to_pylist()]
    return np.concatenate(rows) if rows else np.zeros(0, np.int32), np.array([len(x) for x in rows], np.int64)


def statistics(rows: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, documents of each item term."""

    def count(batches):
        found, n, total = np.zeros(n_terms, np.int64), 0, 0
        for b in batches:
            found += np.bincount(_flat(b, "terms")[0], minlength=n_terms)
            n += b.num_rows
            total += int(b.column("n").to_numpy().sum())
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *at.tolist()]), pa.array([total, n, *found[at].tolist()])], ["term", "many"])

    many = {r.term: r.many for r in rows.mapInArrow(count, "term long, many long").groupBy("term").agg(F.sum("many").alias("many")).collect()}
    df = np.zeros(n_terms, np.int64)
    for term, found in many.items():
        if term >= 0:
            df[term] = found
    return many.get(-1, 0), many.get(-2, 0), df


def impacts(weight: np.ndarray, count: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """weight * (10^9 tf div (1000 tf + 20 m)), m = 50 + 50 n N div L."""
    m = 100 - 50 + (50 * n * n_docs) // n_terms
    tf = count.astype(np.int64)
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


class Best:
    """The ``top`` best documents of one item so far: highest score first,
    then the smallest id, null ids last."""

    def __init__(self, top: int):
        self.top = top
        self.score = np.zeros(0, np.int64)
        self.doc = np.zeros(0, np.int64)
        self.null = np.zeros(0, bool)

    def add(self, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        if len(self.score) == self.top:
            near = score >= self.score[-1]
            score, doc, null = score[near], doc[near], null[near]
        if len(score) > self.top:
            near = score >= np.partition(score, len(score) - self.top)[len(score) - self.top]
            score, doc, null = score[near], doc[near], null[near]
        if len(score):
            score, doc, null = np.concatenate([self.score, score]), np.concatenate([self.doc, doc]), np.concatenate([self.null, null])
            order = np.lexsort((doc, null, -score))[: self.top]
            self.score, self.doc, self.null = score[order], doc[order], null[order]


def _product(rows: DataFrame, items: Items, weight: np.ndarray, n_docs: int, n_terms: int, top: int, once: bool) -> DataFrame:
    """Best documents of each item in each partition of ``rows``."""

    def multiply(batches):
        best = [Best(top) for _ in items.rows]
        held, docs, cells = [], 0, 0

        def close():
            """Gustavson: an item's row of the product is merged from the rows
            of its terms, in one dense row of the block."""
            block = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            null = block.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            doc = block.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
            term, many = _flat(block, "terms")
            column = np.repeat(np.arange(len(doc)), many)
            value = impacts(weight[term], _flat(block, "counts")[0], block.column("n").to_numpy()[column], n_docs, n_terms)
            order = np.argsort(term, kind="stable")
            column, value = column[order], value[order]
            ends = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=len(items)))))
            row = np.zeros(len(doc), np.int64)
            for (terms, times), found in zip(items.rows, best, strict=True):
                row[:] = 0
                for t, k in zip(terms.tolist(), times.tolist(), strict=True):
                    lo, hi = ends[t], ends[t + 1]
                    if hi > lo:
                        row[column[lo:hi]] += value[lo:hi] if once else k * value[lo:hi]
                at = np.flatnonzero(row)
                found.add(row[at], doc[at], null[at])
            held.clear()

        for b in batches:
            for lo in range(0, b.num_rows, BLOCK_DOCS):
                part = b.slice(lo, BLOCK_DOCS)
                held.append(part)
                docs += part.num_rows
                cells += part.column("terms").nbytes // 4
                if docs >= BLOCK_DOCS or cells >= BLOCK_CELLS:
                    close()
                    docs = cells = 0
        if held and docs:
            close()
        for i, found in enumerate(best):
            if len(found.score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found.score), i, np.int32)), pa.array(found.doc, mask=found.null), pa.array(found.score)], ["_no", "doc_id", "score"])

    return rows.mapInArrow(multiply, "_no int, doc_id long, score long")


def _blocks(items: DataFrame):
    """Items, a bounded block of rows at a time."""
    block, size = [], 0
    for r in items.toLocalIterator():
        block.append(r)
        size += len(r[1] or "")
        if len(block) == BLOCK_ITEMS or size > BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, *, top: int = 50, once: bool = True, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The ``top`` documents with the highest score above 0 of every row of
    ``items``: item_id, rank (from 1), doc_id, score; equal scores by
    ascending doc_id, null ids last. With ``once`` an item asks for each of
    its terms once, else as often as it holds it.

    Null and empty texts have no terms: such documents count nowhere and such
    items find nothing. Every row of ``docs`` is a document, repeated ones
    too, and every row of ``items`` an item. Empty tables give no rows; other
    columns are ignored. Items come in blocks of BLOCK_ITEMS; each block is
    one pass over the documents.
    """
    spark = prepare(docs.sparkSession)
    asked = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    out = spark.createDataFrame([], f"item_id {dict(asked.dtypes)['item_id']}, rank int, doc_id long, score long")
    for block in _blocks(asked):
        known = Items([r[1] for r in block])
        rows = written(vectors(docs, known, id_col=id_col, text_col=text_col), name="vectors")
        n_docs, n_terms, df = statistics(rows, len(known))
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        found = best_rows(_product(rows, known, weight, n_docs, n_terms, top, once), ["_no"], [F.desc("score"), F.asc_nulls_last("doc_id")], top)
        names = spark.createDataFrame([(i, r[0]) for i, r in enumerate(block)], f"_no int, item_id {dict(asked.dtypes)['item_id']}")
        out = out.unionByName(found.join(F.broadcast(names), "_no").select("item_id", "rank", "doc_id", "score"))
    return out
