"""Order MinHash fingerprints of texts.

A text's k-mers of code points are numbered by occurrence, so a repeated k-mer
counts as often as it occurs. For each of ``HASHES`` hash functions the
``TUPLE`` numbered k-mers of least hash are taken, put back into text order and
hashed together. Two texts agree in a component if they share those k-mers in
the same order, which falls with their edit distance and, unlike MinHash, with
moved blocks too.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, prepare, width
from .wordhash import LANES, mix, slices, span_sums

K = 9
HASHES = 32
TUPLE = 2
_MULT = (np.random.default_rng(77).integers(0, 1 << 31, HASHES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
#: k-mers hashed at once by all functions; bounds memory for long texts.
_STEP = 1 << 16
NULL_ID = -(1 << 63)


def fingerprint(text: str) -> np.ndarray:
    """HASHES components of 32 bits. k-mers have K code points; a shorter text
    is one k-mer, as is the empty one."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    size = min(K, len(points))
    n = len(points) - size + 1 if len(points) else 1
    if len(points):
        at = np.arange(n)
        kmer = mix(span_sums(points, at, at + size, LANES[0]) + np.uint64(size))
    else:
        kmer = np.zeros(1, np.uint64)
    # occurrence numbers: sort (40 bits of the k-mer, place)
    if n <= 1 << 24:
        packed = (kmer & np.uint64(0xFFFFFFFFFF000000)) | np.arange(n, dtype=np.uint64)
        packed.sort()
        order = (packed & np.uint64(0xFFFFFF)).astype(np.int64)
        key = packed >> np.uint64(24)
    else:
        key = kmer >> np.uint64(24)
        order = np.argsort(key, kind="stable")
        key = key[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    numbered = np.empty(n, np.uint64)
    numbered[order] = mix(key + (np.arange(n) - first).astype(np.uint64) * np.uint64(LANES[1]))
    x = (numbered >> np.uint64(32)).astype(np.uint32)

    count = min(TUPLE, n)
    best = np.full((HASHES, count), 0xFFFFFFFFFFFFFFFF, np.uint64)  # hash << 32 | place, least first
    rows = np.arange(HASHES)
    for lo in range(0, n, _STEP):
        h = x[None, lo : lo + _STEP] * _MULT[:, None]
        found = []
        for c in range(min(count, h.shape[1])):
            at = h.argmin(axis=1)
            found.append((h[rows, at].astype(np.uint64) << np.uint64(32)) | (at + lo).astype(np.uint64))
            if c + 1 < count:
                h[rows, at] = 0xFFFFFFFF
        best = np.sort(np.concatenate([best, np.stack(found, axis=1)], axis=1), axis=1)[:, :count]
    places = np.sort(best & np.uint64(0xFFFFFFFF), axis=1).astype(np.int64)
    out = np.zeros(HASHES, np.uint64)
    for c in range(count):
        out = mix(out * np.uint64(LANES[0]) + numbered[places[:, c]])
    return (out >> np.uint64(32)).astype("<u4")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The last quarter of ``text`` replaced from the start of ``following``."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n] if n else text


def _in_ranges(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows dealt into ranges of (id, hash of the text) and sorted within
    them, so that a row's follower stands next to it: (range, guest, id, text).
    The first row of a range also visits the range before as a guest, that of
    the very first the last.

    Ranges are cut at quantiles of the ids, four to a shuffle partition; an id
    that fills several of them is cut evenly by hash. Only these bounds and
    the numbers of the ranges in use reach the driver. The texts move once.
    """
    n = 4 * width(docs.sparkSession)
    text = F.coalesce(text_col, F.lit(""))
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    found = source.agg(F.percentile_approx("id", [i / n for i in range(n)], 20 * n).alias("cuts")).first()
    ids, times = np.unique(np.array(found["cuts"] or [0], np.int64), return_counts=True)
    base = np.concatenate(([0], np.cumsum(times)[:-1]))

    @F.pandas_udf("int")
    def range_of(id_: pd.Series, h: pd.Series) -> pd.Series:
        at = np.maximum(np.searchsorted(ids, id_.to_numpy(), side="right") - 1, 0)
        share = (h.to_numpy().view(np.uint64) ^ np.uint64(1 << 63)) / np.float64(1 << 64)
        own = ids[at] == id_.to_numpy()  # larger ids follow the last part of a cut one
        part = np.where(own, np.minimum(share * times[at], times[at] - 1), times[at] - 1)
        part = np.where(id_.to_numpy() < ids[0], 0, part)
        return pd.Series((base[at] + part).astype(np.int32))

    dealt = source.select(range_of("id", "h").alias("range"), "id", "h", "text")
    firsts = cut(dealt.groupBy("range").agg(F.min(F.struct("id", "h", "text")).alias("f")))
    used = sorted(r[0] for r in firsts.select("range").collect())
    before = F.create_map(*[F.lit(x) for now, last in zip(used, used[-1:] + used[:-1], strict=True) for x in (now, last)]) if used else F.create_map()
    guests = firsts.select(F.try_element_at(before, F.col("range")).cast("int").alias("range"), F.lit(1).alias("guest"), "f.id", "f.h", "f.text")
    rows = dealt.select("range", F.lit(0).alias("guest"), "id", "h", "text").unionByName(guests)
    return rows.repartition(width(docs.sparkSession), "range").sortWithinPartitions("range", "guest", "id", "h", "text")


def compare_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited form (the last quarter
    replaced from the next document's start) and how alike they are.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. The next document is that of the next larger
    (doc_id, hash of the text, text); after the last comes the first. Null
    texts are empty, null ids come first. One document alone follows itself; an
    empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def row(own, following):
        (doc, text, mark), (_, next_text, next_mark) = own, following
        changed = edited(text, next_text)
        changed_mark = fingerprint(changed)
        return (None if doc == NULL_ID else doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), mark.tobytes().hex(), changed_mark.tobytes().hex(), likeness(mark, changed_mark), likeness(mark, next_mark))

    def scan(batches):
        held, held_range = None, None
        for whole in batches:
            for b in slices(whole, "text"):
                out = []
                for at, guest, doc, text in zip(*(b.column(c).to_pylist() for c in ("range", "guest", "id", "text")), strict=True):
                    if guest and held_range != at:
                        continue
                    now = (doc, text, fingerprint(text))
                    if held is not None and held_range == at:
                        out.append(row(held, now))
                    held, held_range = (None, None) if guest else (now, at)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(names), types, strict=True)], names)

    return _in_ranges(docs, id_col, text_col).mapInArrow(scan, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, fingerprint): hex of the components; null texts are
    empty, equal texts have equal fingerprints."""
    prepare(docs.sparkSession)

    def scan(batches):
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([fingerprint(t).tobytes().hex() for t in texts])], ["doc_id", "n_chars", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scan, "doc_id long, n_chars long, fingerprint string")
