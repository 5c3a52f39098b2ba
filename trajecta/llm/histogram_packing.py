"""Packing by the histogram of lengths, with non-negative least squares.

What a document has beyond whole windows is its tail. Combinations of two or
three tail lengths that fill a window are enumerated, and non-negative least
squares finds how often to repeat each so that the histogram is used up. The
repeat counts are rounded. The k-th tail of a length then belongs to a known
place of a known sequence, so that no group of documents ever meets in a task:
a tail needs its length and its number among the tails of that length, no more.

Tails that the rounded counts leave over are packed greedily: they are cut at
the binary digits of their lengths, and the pieces are laid down longest first.
A piece of a power of two begins at a multiple of its length and crosses no
window, and the last window breaks at the binary digits of what it holds.
Every sequence is therefore full or of a power of two.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import public_path
from .common import prepare, written
from .packing import CAPACITY, READ, _tokenizer
from .wordhash import slices

END_ID = 1
#: Sequences of one whole window of one document are numbered from here.
WHOLE = 1 << 62

_TAILS = "doc_id long, part int, n long, tail int, rank long, crc long, digits array<long>, whole array<long>, whole_no long"


def tails(docs: DataFrame, *, vocabulary: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: n ids with END_ID, crc32 of its whole windows, of its
    tail and of the pieces at the tail's binary digits; rank numbers the tails
    of one length in one part, whole_no the whole windows before it there."""
    prepare(docs.sparkSession)
    path = vocabulary or public_path("byte_bpe_50k.json")
    powers = [1 << k for k in reversed(range(capacity.bit_length()))]

    def scan(batches):
        tokenizer, part = _tokenizer(path), TaskContext.get().partitionId()
        met, n_whole = [0] * capacity, 0
        for batch in batches:
            for b in slices(batch, "text", READ):
                out, begin = [], 0
                ids, ends = tokenizer.encode_column(b.column("text"), END_ID)
                for doc, end in zip(b.column("doc_id").to_pylist(), ends.tolist(), strict=True):
                    n = end - begin
                    tail = n % capacity
                    at = end - tail
                    whole = [zlib.crc32(ids[lo : lo + capacity]) for lo in range(begin, at, capacity)]
                    crc, digits = zlib.crc32(ids[at:end]), []
                    for power in powers:
                        if tail & power:
                            digits.append(zlib.crc32(ids[at : at + power]))
                            at += power
                    begin = end
                    out.append((doc, part, n, tail, met[tail], crc, digits, whole, n_whole))
                    met[tail] += 1
                    n_whole += len(whole)
                if out:
                    longs = pa.list_(pa.int64())
                    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), longs, longs, pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in _TAILS.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scan, _TAILS)


def combinations(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """All combinations (a <= b <= c, a may be 0: none) of two or three of
    ``lengths`` that fill ``capacity``; at most capacity^2 / 12 and a few."""
    here = np.zeros(capacity + 1, bool)
    here[lengths] = True
    found = [np.zeros((0, 3), np.int64)]
    for a in [0, *np.flatnonzero(here[: capacity // 3 + 1]).tolist()]:
        b = np.arange(max(a, 1), (capacity - a) // 2 + 1)
        b = b[here[b] & here[capacity - a - b]]
        found.append(np.stack([np.full(len(b), a), b, capacity - a - b], axis=1))
    return np.concatenate(found)


def non_negative_least_squares(columns: np.ndarray, wanted: np.ndarray, *, rounds: int = 40, steps: int = 300, enough: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """x >= 0 with the smallest |A x - wanted|, as (numbers of columns, x).

    A column of A counts the lengths of one combination. Columns enter where
    the residual gains most, each length once a round, and those whose x falls
    to 0 leave; between, accelerated projected gradient steps solve for the
    columns at hand. Ends when no column gains ``enough`` of the mean count.
    """
    held, x = np.zeros(0, np.int64), np.zeros(0)
    rest = wanted.astype(float)
    limit = enough * max(1.0, float(wanted[wanted > 0].mean())) if wanted.any() else 1.0
    for _ in range(rounds):
        gain = rest[columns].sum(axis=1)
        top = np.flatnonzero(gain > limit)
        if not len(top):
            break
        if len(top) > 8 * len(wanted):
            top = top[np.argpartition(-gain[top], 8 * len(wanted))[: 8 * len(wanted)]]
        used, new = set(), []
        top = top[np.argsort(-gain[top], kind="stable")]
        for j, lengths in zip(top.tolist(), columns[top].tolist(), strict=True):
            some = {v for v in lengths if v}
            if not some & used:
                used |= some
                new.append(j)
        fresh = np.setdiff1d(np.array(new), held)
        held, x = np.concatenate([held, fresh]), np.concatenate([x, np.zeros(len(fresh))])
        cells = columns[held]
        flat = cells.ravel()
        degree = np.bincount(flat, minlength=len(wanted)).astype(float)
        degree[0] = 0
        step = 1 / degree[cells].sum(axis=1).max()
        ahead, momentum = x, 1.0
        for _ in range(steps):
            rest = wanted - np.bincount(flat, weights=np.repeat(ahead, 3), minlength=len(wanted))
            rest[0] = 0
            nxt = np.maximum(0.0, ahead + step * rest[cells].sum(axis=1))
            if ((ahead - nxt) * (nxt - x)).sum() > 0:
                momentum = 1.0
            grown = (1 + (1 + 4 * momentum * momentum) ** 0.5) / 2
            ahead, x, momentum = nxt + (momentum - 1) / grown * (nxt - x), nxt, grown
        keep = x > 1e-9
        held, x = held[keep], x[keep]
        rest = wanted - np.bincount(columns[held].ravel(), weights=np.repeat(x, 3), minlength=len(wanted))
        rest[0] = 0
    return held, x


def repeats(columns: np.ndarray, wanted: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeat count) of the combinations to use: the solution's
    counts, rounded, never more than the histogram has; then one more pass
    uses combinations of what is left whole, those of two lengths first."""
    left = wanted.copy()
    held, x = non_negative_least_squares(columns, wanted)
    counts: dict[int, int] = {}

    def take(j: int, lengths: list[int], most: int | None) -> None:
        some = [v for v in lengths if v]
        n = min(left[v] // some.count(v) for v in some)
        n = int(n if most is None else min(n, most))
        if n > 0:
            counts[j] = counts.get(j, 0) + n
            for v in some:
                left[v] -= n

    order = np.argsort(-x, kind="stable")
    for j, times in zip(held[order].tolist(), x[order].tolist(), strict=True):
        take(j, columns[j].tolist(), round(times))
    open_ = np.flatnonzero(((left[columns] > 0) | (columns == 0)).all(axis=1))
    for j in open_.tolist():
        take(j, columns[j].tolist(), None)
    return [(tuple(v for v in columns[j].tolist() if v), n) for j, n in sorted(counts.items())]


class Plan:
    """Where the k-th tail of a length goes.

    ``slots`` are runs of tails of one length that take the same place in
    consecutive sequences; at most three a combination, whatever the corpus.
    """

    def __init__(self, wanted: np.ndarray, capacity: int = CAPACITY):
        self.capacity = capacity
        chosen = repeats(combinations(np.flatnonzero(wanted), capacity), wanted)
        used = np.zeros_like(wanted)
        slots, self.n_filled = [], 0
        for lengths, n in chosen:
            offset = 0
            for v in sorted(lengths, reverse=True):
                slots.append((v, int(used[v]), n, self.n_filled, offset))
                used[v] += n
                offset += v
            self.n_filled += n
        self.length, self.first, self.many, self.sequence, self.offset = (np.array(c, np.int64) for c in zip(*sorted(slots), strict=True)) if slots else (np.zeros(0, np.int64),) * 5
        self.used = used
        left = wanted - used
        sizes = np.arange(len(wanted))
        #: by digit: where the pieces of each left length begin, in tokens
        self.begin = np.zeros((capacity.bit_length(), len(wanted)), np.int64)
        total = 0
        for k in reversed(range(capacity.bit_length())):
            has = np.where(sizes >> k & 1, left, 0)
            self.begin[k] = total + ((np.cumsum(has) - has) << k)
            total += int(has.sum()) << k
        self.n_left_windows = total // capacity
        rest = total % capacity
        bits = [1 << k for k in reversed(range(capacity.bit_length())) if rest >> k & 1]
        #: starts of the sequences that hold the last, partial window
        self.last = np.cumsum([0, *bits])[:-1]

    def find(self, tail: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(covered, sequence, offset) of tails by length and rank."""
        shift = np.int64(1) << np.int64(44)  # ranks stay below 2**44
        at = np.searchsorted(self.length * shift + self.first, tail * shift + rank, "right") - 1
        covered = rank < self.used[tail]
        at = np.where(covered, at, 0)
        if not len(self.length):
            return covered, np.zeros_like(rank), np.zeros_like(rank)
        return covered, self.sequence[at] + rank - self.first[at], self.offset[at]

    def digit(self, k: np.ndarray, tail: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the piece of 2**k of the ``number``-th left
        tail of its length."""
        at = self.begin[k, tail] + (number << k)
        window, offset = at // self.capacity, at % self.capacity
        chunk = np.maximum(np.searchsorted(self.last, offset, "right") - 1, 0)
        partial = window == self.n_left_windows
        start = self.last[chunk] if len(self.last) else np.zeros_like(offset)
        return self.n_filled + window + np.where(partial, chunk, 0), offset - np.where(partial, start, 0)


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _place(rows: DataFrame, plan: Plan) -> DataFrame:
    capacity = plan.capacity

    def place(batches):
        for b in batches:
            if not b.num_rows:
                continue
            part, n, tail, rank, crc, whole_no = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("part", "n", "tail", "rank", "crc", "whole_no"))
            whole, digits = b.column("whole"), b.column("digits")
            out = []
            # whole windows
            many = whole.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            of = np.repeat(np.arange(len(n)), many)
            k = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
            out.append((of, k * capacity, np.full(len(of), capacity), whole.flatten().to_numpy(zero_copy_only=False), WHOLE + (part[of] << 36) + whole_no[of] + k, np.zeros(len(of), np.int64)))
            # tails that the combinations take
            covered, sequence, offset = plan.find(tail, rank)
            of = np.flatnonzero(covered)
            out.append((of, n[of] - tail[of], tail[of], crc[of], sequence[of], offset[of]))
            # tails left over, at their binary digits
            table = (tail[:, None] >> np.arange(capacity.bit_length() - 1, -1, -1)) & 1
            of, column = np.nonzero(table)  # by row, the longest piece first: the order of digits
            power = capacity.bit_length() - 1 - column
            size = np.int64(1) << power
            first = np.cumsum(table << np.arange(capacity.bit_length() - 1, -1, -1), axis=1)[of, column] - size
            value = digits.flatten().to_numpy(zero_copy_only=False)
            left = ~covered[of]
            of, power, size, first, value = of[left], power[left], size[left], first[left], value[left]
            sequence, offset = plan.digit(power, tail[of], rank[of] - plan.used[tail[of]])
            out.append((of, n[of] - tail[of] + first, size, value, sequence, offset))
            of, start, length, crcs, sequence, offset = (np.concatenate(c) for c in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(of)), *(pa.array(c.astype(np.int64)) for c in (start, length, crcs, n[of], sequence, offset))], [x.split()[0] for x in _PIECES.split(", ")])

    return rows.mapInArrow(place, _PIECES)


def pack_by_histogram(docs: DataFrame, *, vocabulary: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset. ``capacity`` is a power of two.

    A null or empty text is the one END_ID; a null doc_id stays null; repeated
    rows are packed as often as they come; an empty table gives no rows; other
    columns are ignored. To the driver goes the histogram, ``capacity`` rows
    at most.
    """
    if capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    rows = written(tails(docs, vocabulary=vocabulary, capacity=capacity, id_col=id_col, text_col=text_col), name="tails")
    counted = rows.where("tail > 0").groupBy("part", "tail").agg(F.count(F.lit(1)).alias("many"))
    wanted = np.zeros(capacity, np.int64)
    for r in counted.groupBy("tail").agg(F.sum("many").alias("many")).collect():
        wanted[r.tail] = r.many
    plan = Plan(wanted, capacity)
    before = Window.partitionBy("tail").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counted.select("part", "tail", F.coalesce(F.sum("many").over(before), F.lit(0)).alias("before"))
    numbered = rows.join(base, ["part", "tail"], "left").withColumn("rank", F.col("rank") + F.coalesce("before", F.lit(0))).drop("before")
    return _place(numbered, plan)
