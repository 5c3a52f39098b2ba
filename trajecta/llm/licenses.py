"""Licence scan: winnowed fingerprints, banded alignment, chained pieces.

Templates are winnowed into an inverted index of k-gram hashes; it holds the
templates only, so its size is fixed and it travels with the tasks. Every
document is winnowed the same way: a shared run of ``GRAM + WINDOW - 1`` words
is sure to share a fingerprint. Hits of one template on near diagonals make a
candidate; all candidates of a template in a batch are aligned together,
locally, in a band around their diagonals. What lies in the text around the
aligned runs is aligned again while it holds hits. Runs of one template in the
order of both make a chain, so that words put in between, or left out, part a
notice into spans and do not hide it. One pass, no shuffle.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare
from .license_templates import TEMPLATES
from .wordhash import Batch, slices, windows

GRAM = 3
WINDOW = 2
#: Diagonals that a candidate may spread over, to either side.
BAND = 12
MIN_COVERAGE = 0.8
#: Least coverage and words of a partial match.
MIN_PARTIAL, MIN_WORDS = 0.25, 20
#: A piece is worth its matched words times this, less the text words skipped.
WORTH = 20
#: Template words without a hit that end a candidate, and that it reaches
#: beyond its hits: longer runs than GRAM + WINDOW - 2 words always hold one.
APART, REACH = 64, 2 * BAND
#: Cells of the alignments made together.
CELLS = 8_000_000
#: ASCII other than letters and digits parts words; other bytes belong to them.
_PARTS = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_MATCH, _MISS, _GAP = 2, -1, -1


def _words(texts: pa.Array) -> Batch:
    return Batch(texts, lower=True, separators=_PARTS)


def winnow(grams: np.ndarray) -> np.ndarray:
    """Mask of the hashes that are least in some run of WINDOW (all runs'
    least ones are marked, ties too, which only adds fingerprints)."""
    n = len(grams)
    mask = np.zeros(n, bool)
    if n <= WINDOW:
        if n:
            mask[grams == grams.min()] = True
        return mask
    least = np.min([grams[i : n - WINDOW + 1 + i] for i in range(WINDOW)], axis=0)
    for i in range(WINDOW):
        mask[i : n - WINDOW + 1 + i] |= grams[i : n - WINDOW + 1 + i] == least
    return mask


class Index:
    """Inverted index from fingerprint to (template, place)."""

    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        batch = _words(pa.array([templates[n] for n in self.names], pa.string()))
        h = batch.words()
        self.words = [h[a:b] for a, b in zip(batch.first[:-1], batch.first[1:], strict=True)]
        self.flat, self.base = h, batch.first
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, w in enumerate(self.words):
            g = windows(w, GRAM)
            for p in np.flatnonzero(winnow(g)).tolist():
                self.places[int(g[p])].append((t, p))
        self.hashes = np.sort(np.array(list(self.places), np.uint64))

    def known(self, grams: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(grams), bool)
        at = np.minimum(np.searchsorted(self.hashes, grams), len(self.hashes) - 1)
        return self.hashes[at] == grams


def align(flat: np.ndarray, t_low: np.ndarray, t_high: np.ndarray, words: np.ndarray, low: np.ndarray, high: np.ndarray, shift: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Best local alignment of each template stretch ``t_low`` to ``t_high`` of
    ``flat`` with the stretch ``low`` to ``high`` of ``words`` within BAND of
    the diagonal word = place + shift: the places of its matched words in
    ``flat`` and in ``words``."""
    rows, width, n = int((t_high - t_low).max()), 2 * BAND + 1, len(low)
    k = np.arange(width)
    left = (t_low + shift - BAND)[:, None] + k  # word met by the stretch's first, per diagonal
    above = np.zeros((n, width), np.int32)
    step = np.zeros((rows, n, width), np.uint8)
    top, at_row, at_k = np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n, np.int64)
    up = np.full((n, width), _GAP, np.int32)
    for i in range(rows):
        place = left + i
        inside = (place >= low[:, None]) & (place < high[:, None]) & (t_low + i < t_high)[:, None]
        same = words[np.clip(place, 0, len(words) - 1)] == flat[np.minimum(t_low + i, len(flat) - 1)][:, None]
        diagonal = above + np.where(same, _MATCH, _MISS)
        up[:, :-1] = above[:, 1:] + _GAP  # a template word is missing
        here = np.where(inside, np.maximum(np.maximum(diagonal, up), 0), 0)
        # extra text words: the best cell to the left, less the way from it
        here = np.maximum.accumulate(here - _GAP * k, axis=1) + _GAP * k
        here = np.where(inside, here, 0).astype(np.int32)
        step[i] = np.where(here == 0, 0, np.where(here == diagonal, 1, np.where(here == up, 2, 3)))
        best = here.max(axis=1)
        more = best > top
        top[more], at_row[more], at_k[more] = best[more], i, here.argmax(axis=1)[more]
        above = here
    met = np.full((n, rows), -1, np.int64)
    live = np.flatnonzero(top > 0)
    while len(live):
        i, j = at_row[live], at_k[live]
        how, place = step[i, live, j], left[live, j] + i
        hit = (how == 1) & (words[np.clip(place, 0, len(words) - 1)] == flat[t_low[live] + i])
        met[live[hit], i[hit]] = place[hit]
        at_row[live] -= (how == 1) | (how == 2)
        at_k[live] += (how == 2).astype(np.int64) - (how == 3)
        live = live[(how > 0) & (at_row[live] >= 0)]
    found = [np.flatnonzero(m >= 0) for m in met]
    return [(f + t, m[f]) for f, m, t in zip(found, met, t_low, strict=True)]


def chains(pieces: list[tuple[np.ndarray, np.ndarray]], length: int) -> list[list[np.ndarray]]:
    """Pieces of one template of ``length`` words, chained by the order of
    template and text; where two overlap the later one gives way. Best chains
    first, each piece in one: the text places of their matched words."""
    pieces = sorted(pieces, key=lambda x: (x[1][-1], x[1][0]))
    ends, of_ends = np.array([t[-1] for _, t in pieces]), np.array([q[-1] for q, _ in pieces])
    value, back, trim = np.zeros(len(pieces), np.int64), np.full(len(pieces), -1), np.zeros(len(pieces), np.int64)
    for i, (of, at) in enumerate(pieces):
        value[i] = WORTH * len(at)
        # a chain is worth WORTH * length at most: none from farther back gains
        first = int(np.searchsorted(ends[:i], at[0] - WORTH * length))
        if first < i:
            off = np.maximum(np.searchsorted(of, of_ends[first:i] + 1), np.searchsorted(at, ends[first:i] + 1))
            gap = at[np.minimum(off, len(at) - 1)] - ends[first:i] - 1
            worth = np.where(off < len(at), value[first:i] + WORTH * (len(at) - off) - gap, 0)
            j = int(worth.argmax())
            if worth[j] > value[i]:
                value[i], back[i], trim[i] = worth[j], first + j, off[j]
    out, used = [], np.zeros(len(pieces), bool)
    for i in np.argsort(-value, kind="stable").tolist():
        part: list[np.ndarray] = []
        while i >= 0 and not used[i]:
            used[i] = True
            before = int(back[i])
            part.append(pieces[i][1][trim[i] if before >= 0 and not used[before] else 0 :])
            i = before
        if part:
            out.append(part[::-1])
    return out


def _candidates(index: Index, doc: int, first: int, last: int, grams: np.ndarray, hits: np.ndarray) -> list[tuple]:
    """(document, template, its first and end word, hits as rows of shift and
    word) of near diagonals and neighbouring template words in one document."""
    by: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for p in hits.tolist():
        for t, q in index.places[int(grams[p])]:
            by[t].append((first + p - q - int(index.base[t]), first + p))
    out = []
    for t, spots in by.items():
        rows = np.array(sorted(spots))
        start = 0
        while start < len(rows):
            end = int(np.searchsorted(rows[:, 0], rows[start, 0] + BAND, side="right"))
            near = rows[start:end]
            near = near[np.argsort(near[:, 1] - near[:, 0], kind="stable")]
            for part in np.split(near, np.flatnonzero(np.diff(near[:, 1] - near[:, 0]) > APART) + 1):
                out.append((doc, t, first, last, part))
            start = end
    return out


def _aligned(index: Index, words: np.ndarray, todo: list[tuple]) -> dict[tuple[int, int], list]:
    """Pieces of every (document, template): unbroken runs of its alignments."""
    pieces: dict[tuple[int, int], list] = defaultdict(list)
    width = 2 * BAND + 1
    while todo:
        ends = []
        for _, t, _, _, rows in todo:
            q = rows[:, 1] - rows[:, 0]
            ends.append((max(int(index.base[t]), int(q.min()) - REACH), min(int(index.base[t + 1]), int(q.max()) + GRAM + REACH)))
        reach = np.array(ends)
        # stretches of like lengths together
        order = np.argsort(reach[:, 1] - reach[:, 0], kind="stable")
        now, todo, start = todo, [], 0
        while start < len(order):
            size = (reach[order[start:], 1] - reach[order[start:], 0]) * np.arange(1, len(order) - start + 1) * width
            end = start + max(1, int(np.searchsorted(size, CELLS, side="right")))
            part, span = [now[c] for c in order[start:end]], reach[order[start:end]]
            start = end
            shift = np.array([np.sort(c[4][:, 0])[len(c[4]) // 2] for c in part])
            low, high = np.array([c[2] for c in part]), np.array([c[3] for c in part])
            for (doc, t, lo, hi, rows), (of, at) in zip(part, align(index.flat, span[:, 0], span[:, 1], words, low, high, shift), strict=True):
                if not len(at):
                    continue
                runs = np.flatnonzero((np.diff(of) != 1) | (np.diff(at) != 1)) + 1
                own = list(zip(np.split(of, runs), np.split(at, runs), strict=True))
                pieces[doc, t] += own
                # a path beyond this band may fill what lies between
                for a, z in zip([lo, *[int(x[-1]) + 1 for _, x in own]], [*[int(x[0]) for _, x in own], hi], strict=True):
                    rest = rows[(rows[:, 1] >= a) & (rows[:, 1] + GRAM <= z)]
                    if len(rest):
                        todo.append((doc, t, a, z, rest))
    return pieces


def _matches(index: Index, words: np.ndarray, todo: list[tuple], least: float) -> dict[int, list[tuple]]:
    """By document: (template, matched words, spans of words), best first where
    they overlap, else in the order of the text."""
    found: dict[int, list[tuple]] = defaultdict(list)
    for (doc, t), pieces in _aligned(index, words, todo).items():
        length = len(index.words[t])
        for chain in chains(pieces, length):
            matched = sum(map(len, chain))
            if matched >= least * length or (matched >= MIN_WORDS and matched >= MIN_PARTIAL * length):
                spans = [[int(chain[0][0]), int(chain[0][-1]) + 1]]
                for x in chain[1:]:
                    if x[0] - spans[-1][1] <= BAND:
                        spans[-1][1] = int(x[-1]) + 1
                    else:
                        spans.append([int(x[0]), int(x[-1]) + 1])
                found[doc].append((t, matched, spans))
    out = {}
    for doc, rows in found.items():
        rows.sort(key=lambda m: (-m[1], m[1] - len(index.words[m[0]]), m[2][0][0], m[0]))
        origin = min(m[2][0][0] for m in rows)
        taken, kept = np.zeros(max(m[2][-1][1] for m in rows) - origin, bool), []
        for m in rows:
            if not any(taken[a - origin : z - origin].any() for a, z in m[2]):
                kept.append(m)
                for a, z in m[2]:
                    taken[a - origin : z - origin] = True
        out[doc] = sorted(kept, key=lambda m: (m[2][0][0], m[0]))
    return out


_SPANS = pa.list_(pa.struct([(c, pa.int64()) for c in ("start_char", "end_char", "start_word", "end_word")]))


def read_templates(spark: SparkSession, path: str) -> dict[str, str]:
    """A folder of licence texts, one a file, as templates by file name. A
    licence list is short; it is kept on the driver and sent with the tasks."""
    rows = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), "value").collect()
    return {r.name: r.value for r in sorted(rows)}


def scan_licenses(docs: DataFrame, *, templates: dict[str, str] | None = None, min_coverage: float = MIN_COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per match: doc_id, license, coverage (matched words over the
    template's words), whole (coverage of at least ``min_coverage``; others are
    partial, with MIN_PARTIAL and MIN_WORDS at least), n_matched, start_char,
    end_char, start_word, end_word of all of it, and ``spans``, the same of each
    span (runs at most BAND words apart are one). Of matches whose spans overlap in a document the one with more
    matched words is reported, then the one that lacks fewer, then the earlier,
    then the template named first. Null and empty texts match nothing; ids may
    be null or repeat, each row is scanned by itself; other columns are left
    out; an empty table, or no templates, gives an empty result."""
    prepare(docs.sparkSession)
    templates = dict(TEMPLATES if templates is None else templates)
    schema = "doc_id long, license string, coverage double, whole boolean, n_matched int, start_char long, end_char long, start_word long, end_word long, spans array<struct<start_char:long,end_char:long,start_word:long,end_word:long>>"
    names = ["doc_id", "license", "coverage", "whole", "n_matched", "start_char", "end_char", "start_word", "end_word", "spans"]
    types = [pa.int64(), pa.string(), pa.float64(), pa.bool_(), pa.int32(), *[pa.int64()] * 4, _SPANS]

    def scan(batches):
        index = Index(templates)
        for whole in batches:
            for b in slices(whole, "text"):
                batch = _words(b.column("text"))
                h = batch.words()
                g = windows(h, GRAM)
                count = np.maximum(0, np.diff(batch.first) - GRAM + 1)
                docs_hit = np.flatnonzero(np.add.reduceat(np.concatenate((index.known(g), [False] * GRAM)).astype(np.int64), batch.first[:-1]) * (count > 0)) if len(h) else []
                todo, ids, out = [], b.column("doc_id").to_pylist(), []
                for i in docs_hit:
                    first, last = int(batch.first[i]), int(batch.first[i + 1])
                    own = g[first : first + count[i]]
                    hits = np.flatnonzero(winnow(own) & index.known(own))
                    todo += _candidates(index, int(i), first, last, own, hits)
                for i, rows in sorted(_matches(index, h, todo, min_coverage).items()):
                    begin, first = batch.begin[i], int(batch.first[i])
                    chars = np.concatenate(([0], np.cumsum((batch.bytes[begin : batch.ends[batch.first[i + 1] - 1]] & 0xC0) != 0x80)))
                    for t, matched, spans in rows:
                        each = [(int(chars[batch.starts[a] - begin]), int(chars[batch.ends[z - 1] - begin]), a - first, z - first) for a, z in spans]
                        cover = matched / len(index.words[t])
                        out.append((ids[i], index.names[t], cover, cover >= min_coverage, matched, each[0][0], each[-1][1], each[0][2], each[-1][3], [dict(zip(_SPANS.value_type.names, e, strict=True)) for e in each]))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * len(names), types, strict=True)], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scan, schema)
