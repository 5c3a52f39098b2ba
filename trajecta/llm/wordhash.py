"""Vectorised word and n-gram hashing over batches of UTF-8 texts.

A word is a maximal run of bytes other than space and \\x09-\\x0D. All
separators are ASCII, so splitting bytes and splitting characters agree.
Words are hashed with polynomials modulo 2**64 taken from prefix sums, which
costs a few array passes per byte whatever the number of words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_MASK = (1 << 64) - 1

#: Odd multipliers of the two independent hash lanes.
LANES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length()) if n > 1 else 1 << 16
        steps = np.full(size, base & _MASK, dtype=_U)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps)
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


def span_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial of values[start:end] for every span, independent of where
    the span stands."""
    n = len(values)
    sums = np.zeros(n + 1, dtype=_U)
    np.cumsum(values * powers(base, n), out=sums[1:])
    return (sums[ends] - sums[starts]) * powers(inverse(base), n + 1)[starts]


class Batch:
    """Texts of one Arrow column as one byte buffer with the words' places.

    ``first[i]:first[i + 1]`` are the words of text i (null: no words).
    """

    def __init__(self, column: pa.Array, *, lower: bool = False, separators: np.ndarray = SPACE):
        column = column.cast(pa.large_binary())
        n = len(column)
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=n + 1 + column.offset)[column.offset :]
        lengths = np.diff(offsets)
        if column.null_count:
            lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), lengths, 0)
        data = column.buffers()[2]
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None and n else np.zeros(0, np.uint8)
        # one separator after every text keeps words of neighbours apart
        self.begin = np.concatenate(([0], np.cumsum(lengths + 1)))
        self.bytes = np.full(int(self.begin[-1]), 0x20, dtype=np.uint8)
        if n and int(lengths.sum()) == int(offsets[-1] - offsets[0]):
            keep = np.ones(len(self.bytes), dtype=bool)
            keep[self.begin[1:] - 1] = False
            self.bytes[keep] = raw[offsets[0] : offsets[-1]]
        else:
            for i in np.flatnonzero(lengths):
                self.bytes[self.begin[i] : self.begin[i] + lengths[i]] = raw[offsets[i] : offsets[i] + lengths[i]]
        self.space = separators[self.bytes]
        edge = np.diff(self.space.astype(np.int8), prepend=1)
        self.starts = np.flatnonzero(edge == -1)
        self.ends = np.flatnonzero(edge == 1)
        if len(self.ends) and self.ends[0] == 0:
            self.ends = self.ends[1:]
        self.first = np.searchsorted(self.starts, self.begin)
        self.lower = lower

    def __len__(self) -> int:
        return len(self.first) - 1

    def words(self, lane: int = 0) -> np.ndarray:
        """A 64-bit hash for every word."""
        data = (LOWER[self.bytes] if self.lower else self.bytes).astype(_U) + _U(1)
        return mix(span_sums(data, self.starts, self.ends, LANES[lane]))

    def owners(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self)), np.diff(self.first))

    def normal(self, i: int) -> bytes:
        """Words of text i joined by one space."""
        return self.joined(self.first[i], self.first[i + 1])

    def joined(self, lo: int, hi: int) -> bytes:
        if lo == hi:
            return b""
        a, b = self.starts[lo], self.ends[hi - 1]
        part, gap = self.bytes[a:b], self.space[a:b]
        keep = ~gap
        keep[1:] |= gap[1:] & ~gap[:-1]
        out = part[keep]
        out[gap[keep]] = 0x20
        return out.tobytes()


def windows(hashes: np.ndarray, size: int, lane: int = 0) -> np.ndarray:
    """Hash of every run of ``size`` consecutive values (may cross texts)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=_U)
    at = np.arange(n)
    return mix(span_sums(hashes, at, at + size, LANES[1 - lane]))


#: Text bytes that are hashed at once: the arrays above take some 50 bytes for
#: each, and the powers that a worker keeps follow the longest slice.
HASHED = 1 << 18


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20):
    """Cut a record batch into runs of rows of at most ``limit`` text bytes
    (a longer text stands alone), to bound what the arrays above take."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    lo, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > lo and total + size > limit:
            yield batch.slice(lo, i - lo)
            lo, total = i, 0
        total += size
    if lo < batch.num_rows:
        yield batch.slice(lo)
