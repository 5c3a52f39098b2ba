"""Byte-level BPE as a finite-state transducer, and streaming decode.

Encoding. For every prefix of a pre-token there is exactly one token that ends
its encoding, and two neighbours (a, b) may stand together iff encoding their
joint bytes gives (a, b) again. A state therefore holds, for each place where a
token may still be open, the vocabulary prefix read since and the tokens
decided up to there but not yet sent. Reading a byte moves all open prefixes
on; a token is sent as soon as all open places agree on it, at the latest when
the longest vocabulary entry has been read. States and moves are made when a
text first needs them and kept; the store starts afresh above MAX_STATES.

Decoding joins the tokens' bytes and lets an incremental UTF-8 machine hold
back the bytes of an unfinished character.
"""

from __future__ import annotations

import base64
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare
from .wordhash import slices

MAX_STATES = 300_000
#: Entries in each of a cache's two generations.
MAX_CACHED = 400_000
#: White_Space, as the pattern's \s means it.
WS = "\t-\r \x85\xa0  -     　"
#: Text splits into these first: a run without white space (with the one space
#: before it) never shares a pre-token with anything else.
CHUNK = re.compile(f" ?[^{WS}]+|[{WS}]+(?![^{WS}])|[{WS}]+")


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Merges:
    """What a rank table says about single tokens and pairs of neighbours."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {v: k for k, v in ranks.items()}
        self.prefixes = {t[:i] for t in ranks for i in range(1, len(t))}
        self._spines: dict[int, tuple] = {}
        self._fits: dict[int, bool] = {}

    def parts(self, data: bytes) -> list[bytes]:
        """The state before the last merge of ``data`` merged on its own, or
        its final parts where they are not one token."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def spines(self, token: int) -> tuple:
        """((part, rank of the merge that uses it up), ...) along the left and
        the right edge; None where merging never makes the token."""
        found = self._spines.get(token, 0)
        if found == 0:
            data = self.token[token]
            edges: list = [[(data, 1 << 60)], [(data, 1 << 60)]]
            for side in (0, 1):
                part = data
                while len(part) > 1:
                    pair = self.parts(part)
                    if len(pair) != 2:
                        edges = []
                        break
                    edges[side].append((pair[-side], self.ranks[part]))
                    part = pair[-side]
                if not edges:
                    break
            found = self._spines[token] = (tuple(edges[0]), tuple(edges[1])) if edges else None
        return found

    def fits(self, a: int, b: int) -> bool:
        """Whether b may follow a: no merge across the border comes before the
        merges that use up the parts at it (leftmost first among equals)."""
        pair = a << 32 | b
        found = self._fits.get(pair)
        if found is None:
            left, right = (self.spines(a) if a >= 0 else ((), ())), self.spines(b)
            found = left is not None and right is not None
            if found and a >= 0:
                for x, until_x in left[1]:
                    for y, until_y in right[0]:
                        rank = self.ranks.get(x + y)
                        if rank is not None and rank < until_x and rank <= until_y:
                            found = False
            if len(self._fits) > MAX_CACHED:
                self._fits.clear()
            self._fits[pair] = found
        return found


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.merges = Merges(ranks)
        self.reset()

    def reset(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        #: state * 256 + byte -> next state, and what is sent where something is
        self.next: dict[int, int] = {}
        self.sent: dict[int, bytes] = {}
        self.add((-1, ((b"", ()),)))

    def add(self, state: tuple) -> int:
        found = self.ids.get(state)
        if found is None:
            found = self.ids[state] = len(self.states)
            self.states.append(state)
        return found

    def move(self, at: int, byte: int) -> int:
        """Make the move from state ``at`` on ``byte``."""
        last, places = self.states[at]
        ranks, prefixes = self.merges.ranks, self.merges.prefixes
        step, live, ended = bytes((byte,)), [], None
        for prefix, tokens in places:
            prefix += step
            if prefix in prefixes:
                live.append((prefix, tokens))
            if ended is None:
                token = ranks.get(prefix)
                if token is not None and self.merges.fits(tokens[-1] if tokens else last, token):
                    ended = (*tokens, token)
        if not live:  # all that is open has ended here
            out, live, last = ended, ((b"", ()),), ended[-1]
        else:
            live.append((b"", ended))
            sent, least = 0, min(len(t) for _, t in live)
            while sent < least and all(t[sent] == ended[sent] for _, t in live):
                sent += 1
            out = ended[:sent]
            live = tuple((p, t[sent:]) for p, t in live) if sent else tuple(live)
            last = -2 if least > sent else out[-1] if out else last  # -2: nothing looks at it
        to = self.next[at << 8 | byte] = self.add((last, live))
        if out:
            self.sent[at << 8 | byte] = struct.pack(f"<{len(out)}I", *out)
        return to

    def encode(self, piece: bytes) -> bytes:
        """Token ids of one pre-token as little-endian unsigned 32-bit."""
        if len(self.states) > MAX_STATES:
            self.reset()
        at, out, step, sent = 0, b"", self.next.get, self.sent
        for byte in piece:
            move = at << 8 | byte
            to = step(move)
            if to is None:
                to = self.move(at, byte)
            if move in sent:
                out += sent[move]
            at = to
        left = self.states[at][1][-1][1]  # what the last place has decided
        return out + struct.pack(f"<{len(left)}I", *left)


class Generations(dict):
    """A bounded cache. A full generation becomes the old one and displaces
    the one before; what is asked for again moves back to the young one."""

    def __init__(self):
        self.old: dict = {}

    def keep(self, key, value):
        if len(self) >= MAX_CACHED:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Encoder(Generations):
    """Text to ids; also the cache of chunks (a dict, so lookups stay in C)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        super().__init__()

        self.transducer = Transducer(ranks)
        # inside a chunk only the pattern's other branches can match
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{WS}").replace(r"|\s+(?!\S)|\s+", ""))

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            word = chunk[1:] if chunk[0] == " " else chunk
            if word.isalpha():  # the pattern's letters, found faster
                pieces = [chunk]
            elif word[:-1].isalpha() and word[-1] in ".,;:!?":
                pieces = [chunk[:-1], chunk[-1]]
            elif chunk.isspace() and not re.search(f"[^{WS}]", chunk):
                pieces = [chunk]
            else:
                pieces = self.pattern.findall(chunk)
            encode = self.transducer.encode
            if len(pieces) == 1:
                ids = encode(chunk.encode())
            else:  # pre-tokens are looked up like chunks
                ids = b"".join([self.get(p) or encode(p.encode()) for p in pieces])
        return self.keep(chunk, ids) if len(chunk) <= 64 else ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, CHUNK.findall(text)))


#: UTF-8 lead bytes: continuation bytes to follow, and the range of the first.
_LEADS = [(0x00, 0x7F, 0, 0, 0), (0xC2, 0xDF, 1, 0x80, 0xBF), (0xE0, 0xE0, 2, 0xA0, 0xBF), (0xE1, 0xEC, 2, 0x80, 0xBF), (0xED, 0xED, 2, 0x80, 0x9F), (0xEE, 0xEF, 2, 0x80, 0xBF), (0xF0, 0xF0, 3, 0x90, 0xBF), (0xF1, 0xF3, 3, 0x80, 0xBF), (0xF4, 0xF4, 3, 0x80, 0x8F)]


class Utf8Stream:
    """Bytes in, text out; an unfinished character waits for its rest.
    Malformed bytes become U+FFFD."""

    def __init__(self):
        self.held = b""

    @staticmethod
    def open_bytes(data: bytes) -> int:
        """How many bytes at the end begin a character that can still be
        completed: the machine run from the last lead byte."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if 0x80 <= byte < 0xC0:
                continue
            for lo, hi, follow, first, last in _LEADS:
                if lo <= byte <= hi:
                    if back - 1 >= follow:
                        return 0
                    return back if back == 1 or first <= data[1 - back] <= last else 0
            return 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        n = len(data) - self.open_bytes(data)
        self.held = data[n:]
        return data[:n].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


class Decoder:
    def __init__(self, ranks: dict[bytes, int], step: int = 4096):
        self.table = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.table[i] = token
        self.step = step

    def stream(self, ids: bytes):
        """Text pieces, never splitting a character."""
        numbers, out = np.frombuffer(ids, "<u4"), Utf8Stream()
        for at in range(0, len(numbers), self.step):
            yield out.feed(b"".join(map(self.table.__getitem__, numbers[at : at + self.step].tolist())))
        yield out.close()


_loaded: dict = {}


def _once(key: tuple, make):
    """One object per Python worker."""
    if key not in _loaded:
        _loaded[key] = make()
    return _loaded[key]


def encode(docs: DataFrame, *, ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): ids as little-endian unsigned 32-bit integers in one
    binary, as ``tiktoken`` would give them without special tokens. Null and
    empty texts have no ids. Rows are neither merged nor ordered. The
    vocabulary file must be readable where executors run."""
    prepare(docs.sparkSession)
    path = ranks_path or public_path("byte_bpe_50k.tiktoken")

    def scan(batches):
        import public_tokenizers

        encoder = _once(("encoder", path), lambda: Encoder(load_ranks(path), public_tokenizers.PATTERN))
        for whole in batches:
            for b in slices(whole, "text"):
                ids = [encoder.encode(t) if t else b"" for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scan, "doc_id long, ids binary")


def decode(tokens: DataFrame, *, ranks_path: str | None = None) -> DataFrame:
    """(doc_id, ids) -> (doc_id, ids, text). Null ids give an empty text."""
    prepare(tokens.sparkSession)
    path = ranks_path or public_path("byte_bpe_50k.tiktoken")

    def scan(batches):
        decoder = _once(("decoder", path), lambda: Decoder(load_ranks(path)))
        for whole in batches:
            for b in slices(whole, "ids"):
                texts = ["".join(decoder.stream(x)) if x else "" for x in b.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("ids"), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(scan, "doc_id long, ids binary, text string")


def round_trip(docs: DataFrame, *, ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, text): ``decode(encode(docs))`` in one pass and one
    Python process a task."""
    prepare(docs.sparkSession)
    path = ranks_path or public_path("byte_bpe_50k.tiktoken")

    def scan(batches):
        import public_tokenizers

        encoder = _once(("encoder", path), lambda: Encoder(load_ranks(path), public_tokenizers.PATTERN))
        decoder = _once(("decoder", path), lambda: Decoder(encoder.transducer.merges.ranks))
        for whole in batches:
            for b in slices(whole, "text"):
                ids = [encoder.encode(t) if t else b"" for t in b.column("text").to_pylist()]
                texts = ["".join(decoder.stream(x)) for x in ids]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary()), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scan, "doc_id long, ids binary, text string")
