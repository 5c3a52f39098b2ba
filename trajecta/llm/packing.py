"""Packing tokenised documents into sequences of a fixed length.

Documents longer than a sequence are cut so that all pieces but the first fill
one alone; only first pieces compete for space. They are dealt to partitions
by hash, so no source or group of copies meets in one, and each partition packs
online with bounded space: a fixed number of open bins, found by best fit
through a bitset keyed by free space; when the bins run out the fullest closes.
Bins still wanting at a partition's end give their pieces to a second, narrower
round. Only lengths and ids travel: nothing of the texts is shuffled.
"""

from __future__ import annotations

import os
import zlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import CHUNK, public_path
from .common import cut, prepare, width
from .memory import tidy
from .wordhash import slices

CAPACITY = 2048
OPEN_BINS = 4096
#: Bins at least this full are done when their partition ends.
FULL_ENOUGH = 0.97
#: Later rounds deal the leftovers to fewer partitions by this factor.
NARROWER = 16
ROUNDS = 3
END_ID = 0

#: Chunks of a text whose ids a worker keeps, in each of two generations.
MAX_CACHED = 200_000
LONGEST_CACHED = 64
#: New chunks that go through the tokenizer at once.
JOINED = 2000
#: Text bytes that are read at once.
READ = 1 << 21
WHITE = frozenset(c for c in map(chr, range(0x3001)) if not CHUNK.fullmatch("x" + c))
_WIDE = sorted(c.encode() for c in WHITE if c > "\x7f")
_LAST = {c.encode()[-1] for c in WHITE}
#: Kinds of bytes; _OTHER is all that may be anything beyond ASCII.
_OTHER, _LETTER, _DIGIT, _SIGN, _SPACE = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
for _byte in range(0x80):
    _KIND[_byte] = _SPACE if chr(_byte) in WHITE else _LETTER if chr(_byte).isalpha() else _DIGIT if chr(_byte).isdigit() else _SIGN
#: Whether a chunk ends between two kinds, at 8 * the first + the second.
_PARTS = np.zeros(64, bool)
for _x in range(5):
    for _y in range(5):
        _PARTS[8 * _x + _y] = _x != _y and (_SPACE in (_x, _y) or _OTHER not in (_x, _y))


def chunk_starts(data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Where the chunks of UTF-8 texts start that share no pre-token: runs of
    letters (to U+00FF), digits or other ASCII signs, each with the one space
    before it, runs with anything else in them, and other white space.
    ``begin`` are the texts' starts, and the end of ``data``.
    """
    n = len(data)
    kind = _KIND[data]
    lead = np.flatnonzero(data == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = _LETTER
    for size in (2, 3):
        wide = [w for w in _WIDE if len(w) == size]
        lead = np.flatnonzero(np.isin(data, [w[0] for w in wide]))
        code = sum(data[lead + k].astype(np.int64) << 8 * k for k in range(size))
        lead = lead[np.isin(code, [int.from_bytes(w, "little") for w in wide])]
        for k in range(size):
            kind[lead + k] = _SPACE
    starts = np.zeros(n + 1, bool)
    starts[1:n] = _PARTS[8 * kind[:-1] + kind[1:]]
    # a letter behind an apostrophe may belong to it
    quote = np.flatnonzero(data[:-1] == 0x27) + 1
    starts[quote[kind[quote] == _LETTER]] = False
    # the last of white space within a text stands apart, or with what follows
    space = kind == _SPACE
    last = np.flatnonzero(space[:-1] & ~space[1:])
    inside = np.ones(n + 1, bool)
    inside[begin] = False
    last = last[inside[last + 1]]
    starts[last[data[last] == 0x20] + 1] = False
    for _ in range(2):
        last = last - (data[last] & 0xC0 == 0x80)
    starts[last] = True
    starts[begin] = True
    return np.flatnonzero(starts[:n])


_vocabulary: dict = {}


class Tokenizer:
    """Ids of whole texts by ``tokenizers``, as ``encode(text,
    add_special_tokens=False)`` gives them.

    Texts are read in ``chunk_starts``' chunks, many texts at once: equal chunks
    are found by Arrow and looked up once, and only the lookup is Python. A
    chunk's ids are taken from ``tokenizers`` when it is first met and kept. A
    text that holds an added token's string is one chunk: white space before
    such a string is cut differently.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        import tokenizers

        self.model = tokenizers.Tokenizer.from_file(path)
        self.added = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.marks = [t.encode() for t in self.added]
        #: bytes of every token: the vocabulary writes each byte as one character
        self.width = np.zeros(self.model.get_vocab_size(), np.int64)
        for token, i in self.model.get_vocab(with_added_tokens=False).items():
            self.width[i] = len(token)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        ids, ends = self.encode_column(pa.array(texts, pa.large_string()))
        return [ids[lo:hi].tobytes() for lo, hi in pairwise([0, *ends.tolist()])]

    def encode_column(self, column: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of all texts (null: empty) in a row, each text's
        with ``end`` behind them if given, and where each text's end."""
        if column.null_count:
            column = column.fill_null("")
        whole = np.zeros(len(column), bool)
        for token in self.added:
            whole |= pc.match_substring(column, token).to_numpy(zero_copy_only=False)
        column = column.cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1] or bytes(8), np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        begin = offsets - offsets[0]
        if len(data):
            starts = chunk_starts(data, begin)
            if whole.any():
                text = np.searchsorted(begin, starts, "right") - 1
                starts = starts[~whole[text] | (starts == begin[text])]
            ids, ends = self._chunks(data, starts)
            ends = ends[np.searchsorted(starts, begin[1:])]
        else:
            ids, ends = np.zeros(0, "<u4"), np.zeros(len(column), np.int64)
        if end is not None:
            ids, ends = np.insert(ids, ends, end), ends + np.arange(1, len(ends) + 1)
        return ids, ends

    def _chunks(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the chunks in a row, and how many stand before each chunk
        and behind all."""
        places = np.append(starts, len(data))
        chunks = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(data)]).dictionary_encode()
        which = chunks.indices.to_numpy()
        found = self._ids(chunks.dictionary.to_numpy(zero_copy_only=False).tolist())
        many = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        first, each = np.cumsum(many) - many, many[which]
        ends = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(each, out=ends[1:])
        at = np.repeat(first[which] - ends[:-1], each)
        at += np.arange(len(at))
        return np.frombuffer(b"".join(found), "<u4")[at], ends

    def _ids(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of different chunks."""
        if len(self.known) > MAX_CACHED:
            self.known, self.older = {}, self.known
        found = list(map(self.known.get, chunks))
        missing = [c for c, ids in zip(chunks, found, strict=True) if ids is None]
        if not missing:
            return found
        fresh = {c: ids for c, ids in zip(missing, map(self.older.get, missing), strict=True) if ids is not None}
        fresh |= self._learned([c for c in missing if c not in fresh])
        self.known.update((c, ids) for c, ids in fresh.items() if len(c) <= LONGEST_CACHED)
        return [fresh[c] if ids is None else ids for c, ids in zip(chunks, found, strict=True)]

    def _learned(self, new: list[bytes]) -> dict[bytes, bytes]:
        """Ids of new chunks. All but white space keep apart when joined, those
        without a space in front behind a line end, so that they go through
        together; their tokens' bytes tell them apart again."""
        alone = {c for c in new if c[-1] in _LAST and c.decode()[-1] in WHITE}
        for mark in self.marks:
            alone.update(c for c in new if mark in c)
        joined = [c for c in new if c[0] == 0x20 and c not in alone]
        for c in new:
            if c[0] != 0x20 and c not in alone:
                joined += (b"\n", c)
        groups = [joined[lo : lo + JOINED] for lo in range(0, len(joined), JOINED)]
        out = {c: self._whole(c.decode()) for c in alone}
        for some, found in zip(groups, self.model.encode_batch_fast([b"".join(g).decode() for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, "<u4")
            ends = np.cumsum(self.width[ids])
            at = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)))
            cut_ = (np.searchsorted(ends, at) + 1).tolist()
            if not np.array_equal(ends[np.array(cut_) - 1], at):
                raise ValueError("a token spans two chunks")
            data = ids.tobytes()
            out.update(zip(some, (data[4 * x : 4 * y] for x, y in zip([0, *cut_[:-1]], cut_, strict=True)), strict=True))
        return out

    def _whole(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def _tokenizer(path: str) -> Tokenizer:
    """One per Python worker."""
    if path not in _vocabulary:
        _vocabulary[path] = Tokenizer(path)
    return _vocabulary[path]


def _forget() -> None:
    """The pieces are there: a worker needs no tokenizer from here on."""
    _vocabulary.clear()


def pieces(docs: DataFrame, *, vocabulary: str | None = None, capacity: int = CAPACITY, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): a document's ids, then
    END_ID, cut into pieces of ``capacity``; the first takes the remainder.
    ids (little-endian unsigned 32-bit, one binary) only with ``with_ids``."""
    prepare(docs.sparkSession)
    path = vocabulary or public_path("byte_bpe_50k.json")

    def scan(batches):
        tokenizer = _tokenizer(path)
        for whole in batches:
            for b in slices(whole, "text", READ):
                out, at = [], 0
                ids, ends = tokenizer.encode_column(b.column("text"), END_ID)
                for doc, end in zip(b.column("doc_id").to_pylist(), ends.tolist(), strict=True):
                    n = end - at
                    starts = [0, *range(n % capacity or capacity, n, capacity)]
                    for k, (lo, hi) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
                        part = ids[at + lo : at + hi]
                        out.append((doc, k, lo, hi - lo, zlib.crc32(part), part.tobytes() if with_ids else None))
                    at = end
                names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
                columns = list(zip(*out, strict=True)) if out else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=False)], names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(scan), schema)


class OpenBins:
    """A fixed number of open bins. ``free`` is a bitset of the free spaces
    that some open bin has; bins of one free space wait in a list. Holds at
    most ``most`` bins of ``capacity``; an item may not be longer than that."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.free = 0
        self.bins: dict[int, list] = {}
        self.n_open = 0

    def _take(self, space: int):
        waiting = self.bins[space]
        found = waiting.pop()
        if not waiting:
            del self.bins[space]
            self.free ^= 1 << space
        self.n_open -= 1
        return found

    def _put(self, space: int, bin_: list) -> None:
        self.bins.setdefault(space, []).append(bin_)
        self.free |= 1 << space
        self.n_open += 1

    def add(self, item, length: int):
        """Place an item in the open bin that it fills best. Returns a bin
        that closed, or None."""
        fitting = self.free >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            bin_ = self._take(space)
        else:
            space, bin_ = self.capacity, []
        bin_.append(item)
        space -= length
        if not space:
            return bin_
        closed = None
        if self.n_open >= self.most:
            closed = self._take((self.free & -self.free).bit_length() - 1)
        self._put(space, bin_)
        return closed

    def rest(self):
        """(free space, bin) of all open bins."""
        return [(space, b) for space in sorted(self.bins) for b in self.bins[space]]


_COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32"]
_PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, done boolean"


def _round(rows: DataFrame, number: int, capacity: int, open_bins: int, last: bool) -> DataFrame:
    arrow = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]

    def pack(batches):
        _forget()
        bins = OpenBins(capacity, open_bins)
        base, n, out = (number << 56) | (TaskContext.get().partitionId() << 32), 0, []

        def close(bin_, done=True):
            nonlocal n
            offset = 0
            for item in bin_:
                out.append((*item, base + n, offset, done))
                offset += item[3]
            n += 1

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow, strict=True)], [*_COLUMNS, "sequence_id", "offset", "done"])
            out.clear()
            return batch

        for b in batches:
            for item in zip(*(b.column(c).to_pylist() for c in _COLUMNS), strict=True):
                closed = bins.add(item, item[3])
                if closed:
                    close(closed)
            if out:
                yield flush()
        for space, bin_ in bins.rest():
            close(bin_, last or space <= (1 - FULL_ENOUGH) * capacity)
        if out:
            yield flush()

    return rows.select(*_COLUMNS).mapInArrow(tidy(pack), _PLACED)


def pack(parts: DataFrame, *, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """Assign ``pieces`` to sequences: adds sequence_id and offset, gapless
    from 0 within a sequence, in total at most ``capacity`` long. A partition
    reads its pieces once, the longest first, which needs fewer sequences than
    any other order. Rows are never dropped; repeated rows are
    packed as often as they come; an empty table gives an empty result."""
    spark = prepare(parts.sparkSession)
    n, left, placed = width(spark), parts, []
    for number in range(ROUNDS):
        last = number == ROUNDS - 1
        dealt = left.repartition(n, F.xxhash64("doc_id", "piece", "ids_crc32"))
        dealt = dealt.sortWithinPartitions(F.desc("length"), "doc_id", "piece")
        result = cut(_round(dealt, number, capacity, open_bins, last))
        placed.append(result.where("done").drop("done"))
        left = result.where("NOT done")
        n = max(1, n // NARROWER)
        if last or left.isEmpty():
            break
    out = placed[0]
    for more in placed[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(docs: DataFrame, *, vocabulary: str | None = None, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise and pack ``docs``: one row per piece with doc_id, piece, start,
    length, ids_crc32, sequence_id, offset. A null or empty text is the one
    END_ID. A null doc_id stays null. Other columns are ignored."""
    return pack(cut(pieces(docs, vocabulary=vocabulary, capacity=capacity, id_col=id_col, text_col=text_col)), capacity=capacity, open_bins=open_bins)
