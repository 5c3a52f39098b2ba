"""Audit of how far the sources of a language diverge in their words.

Every (lang, source) group gives each term that its language keeps a smoothed
probability in whole billionths. Two questions are answered exactly: how far a
group is from each other source of its language, over all kept terms, and
which terms it uses most in excess of its language.

Pairs come from postings. Terms that neither source has are all alike, terms
of one source alone depend on their count only, so that a histogram of counts
sums them; only where a posting list has both does a term add its own share.

Terms are searched best first. A partition's terms of a group fall into buckets
by count; a bucket's largest count and the smallest probability in the language
bound the divergence of every term in it. Buckets are evaluated from the largest
bound down until the bounds left are strictly below the k-th value found.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import best_rows, prepare, written
from .wordhash import LANES, LOWER, Batch, slices

BILLION = 1_000_000_000
#: Bytes between terms: ASCII but for letters.
BETWEEN = np.array([c < 0x80 and not chr(c).isalpha() for c in range(256)])
LEAST_DOCS = 3
TOP = 200
#: Groups up to which their totals are broadcast; more meet in a shuffle.
BROADCAST_GROUPS = 100_000
#: Rows of counts that a task gathers before it adds them up; where more than
#: half are left, it sends them.
GATHERED = 1 << 20
#: Postings that are searched together, pairs of postings made together, and
#: sums of pairs that a task holds at once.
SEARCHED, PAIRS = 1 << 18, 1 << 20

_COUNTS = "lang string, source string, term string, many long, docs long"
_NAMES = ["lang", "source", "term", "many", "docs"]


def _distinct(key: np.ndarray, *others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first places, number of each place's value) of the distinct rows of
    (key, others). ``key`` alone orders them, unless it fails to tell the rest
    apart."""
    _, first, of = np.unique(key, return_index=True, return_inverse=True)
    if all(np.array_equal(c, c[first][of]) for c in others):
        return first, of
    order = np.lexsort((*others, key))
    new = np.ones(len(order), bool)
    new[1:] = False
    for c in (key, *others):
        new[1:] |= c[order][1:] != c[order][:-1]
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    return order[new], of


class _Gathered:
    """Counts of (group, term) in one task. Terms are told apart by two 64-bit
    hashes; ``ref`` is the place of a term's text among the texts kept."""

    def __init__(self):
        self.columns: list[tuple[np.ndarray, ...]] = []
        self.texts: list[pa.Array] = []
        self.n = self.n_texts = 0

    def add(self, batch: Batch, groups: np.ndarray) -> None:
        hashes, second = batch.words(0), batch.words(1)
        first, of = _distinct(hashes, second)
        size = max(1, len(first))
        cells, many = np.unique(batch.owners() * size + of, return_counts=True)
        doc, word = np.divmod(cells, size)
        both, at = np.unique(groups[doc] * size + word, return_inverse=True)
        total, docs = (np.bincount(at, weights=w, minlength=len(both)).astype(np.int64) for w in (many, None))
        group, word = np.divmod(both, size)
        lengths = batch.ends[first] - batch.starts[first]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        place = np.repeat(batch.starts[first] - ends[:-1], lengths) + np.arange(ends[-1])
        self.texts.append(pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(LOWER[batch.bytes[place]])))
        self.columns.append((group, hashes[first][word], second[first][word], total, docs, self.n_texts + word))
        self.n += len(group)
        self.n_texts += len(first)

    def merge(self) -> None:
        if len(self.columns) > 1:
            group, hashes, second, many, docs, ref = (np.concatenate(c) for c in zip(*self.columns, strict=True))
            first, of = _distinct(hashes ^ (group.astype(np.uint64) * np.uint64(LANES[0])), hashes, second, group)
            many, docs = (np.bincount(of, weights=c, minlength=len(first)).astype(np.int64) for c in (many, docs))
            self.texts = [pa.concat_arrays(self.texts).take(pa.array(ref[first]))]
            self.columns = [(group[first], hashes[first], second[first], many, docs, np.arange(len(first)))]
            self.n = self.n_texts = len(first)

    def rows(self, names: list[tuple[str, str]]):
        """Arrow batches of all that is held, which is then let go."""
        self.merge()
        if self.columns:
            group, _, _, many, docs, ref = self.columns[0]
            lang, source = (pa.array([x[i] for x in names], pa.string()) for i in (0, 1))
            for lo in range(0, len(group), 50_000):
                g = pa.array(group[lo : lo + 50_000])
                term = self.texts[0].take(pa.array(ref[lo : lo + 50_000])).cast(pa.string())
                yield pa.RecordBatch.from_arrays([lang.take(g), source.take(g), term, pa.array(many[lo : lo + 50_000]), pa.array(docs[lo : lo + 50_000])], _NAMES)
        self.__init__()


def term_counts(docs: DataFrame, *, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, many, docs), summed within tasks and then over
    them, dealt out by language and term; the term '' marks each group that
    occurs."""
    prepare(docs.sparkSession)

    def scan(batches):
        number: dict[tuple[str, str], int] = {}
        gathered = _Gathered()
        for whole in batches:
            for b in slices(whole, "text"):
                keys = zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), strict=True)
                groups = np.array([number.setdefault(k, len(number)) for k in keys], np.int64)
                gathered.add(Batch(b.column("text"), lower=True, separators=BETWEEN), groups)
                if gathered.n > GATHERED:
                    gathered.merge()
                    if gathered.n > GATHERED // 2:
                        yield from gathered.rows(list(number))
        yield from gathered.rows(list(number))
        if number:
            lang, source = zip(*number, strict=True)
            nothing = np.zeros(len(number), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(source), pa.array([""] * len(number)), pa.array(nothing), pa.array(nothing)], _NAMES)

    empty = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    rows = docs.select(empty(lang_col, "lang"), empty(source_col, "source"), empty(text_col, "text")).mapInArrow(scan, _COUNTS)
    return rows.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("many").alias("many"), F.sum("docs").alias("docs"))


def probability(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 1) / (total + terms)), exact at any size; null
    where nothing is kept. In three steps of 1000, so that no product passes
    64 bits before counts reach 9 * 10^15."""
    whole, rest, out = total + terms, count + 1, F.lit(0).cast("long")
    for _ in range(3):
        out = out * 1000 + F.call_function("div", rest * 1000, whole)
        rest = (rest * 1000) % whole
    return F.when(whole > 0, out + 1)


def excess(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """f = floor((p - q)^2 / q); p, q at most 10^9 + 1, so within 64 bits."""
    return (p - q) * (p - q) // q


def best_first(count: np.ndarray, p: np.ndarray, q: np.ndarray, terms: Callable[[np.ndarray], list[bytes]], best: list[tuple[int, bytes]], top: int = TOP) -> list[tuple[int, bytes]]:
    """The ``top`` of ``best`` and of the terms with p > q by (-f, term)."""
    bucket = np.frexp(count.astype(float))[1]
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    if not len(edges):
        return best
    most, least = np.maximum.reduceat(p[order], edges), np.minimum.reduceat(q[order], edges)
    bounds = np.where(most > least, excess(np.maximum(most, least), least), -1)
    ends = np.append(edges[1:], len(order))
    for i in np.argsort(-bounds, kind="stable").tolist():
        if bounds[i] < 0 or (len(best) == top and bounds[i] < -best[-1][0]):
            break
        at = order[edges[i] : ends[i]]
        at = at[p[at] > q[at]]
        f = excess(p[at], q[at])
        if len(best) == top:
            at, f = at[f >= -best[-1][0]], f[f >= -best[-1][0]]
        if len(f) > top:
            least_f = np.partition(f, len(f) - top)[len(f) - top]
            at, f = at[f >= least_f], f[f >= least_f]
        best = sorted(best + list(zip((-f).tolist(), terms(at), strict=True)))[:top]
    return best


_FOUND = "lang string, i int, j int, term string, value long"


def _postings_scan(postings: DataFrame, top: int) -> DataFrame:
    """From posting lists (lang, term, q, entries of (no, count, p, p0) in
    order of no): partial sums of what pairs of sources add where both have a
    term (i, j), and each partition's best terms of a group (i, term)."""

    def scan(batches):
        best: dict[tuple[str, int], list] = {}
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def add(lang: str, keys: np.ndarray, values: np.ndarray):
            old = sums.get(lang)
            if old is not None:
                keys, values = np.concatenate([old[0], keys]), np.concatenate([old[1], values])
            keys, at = np.unique(keys, return_inverse=True)
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, at, values)
            sums[lang] = keys, total

        def sent(lang: str):
            keys, total = sums.pop(lang)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array((keys >> 31).astype(np.int32)), pa.array((keys & 0x7FFFFFFF).astype(np.int32)), pa.nulls(len(keys), pa.string()), pa.array(total)], ["lang", "i", "j", "term", "value"])

        def take_in(b: pa.RecordBatch):
            entries = b.column("entries")
            n = entries.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = entries.flatten()
            no, count, p, p0 = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("no", "count", "p", "p0"))
            row = np.repeat(np.arange(len(n)), n)
            q = b.column("q").to_numpy()[row]
            term = b.column("term")
            code = pc.dictionary_encode(b.column("lang"))
            langs, code = code.dictionary.to_pylist(), code.indices.to_numpy()
            for c, lang in enumerate(langs):
                mine = np.flatnonzero(code[row] == c)
                for g in np.unique(no[mine]).tolist():
                    at = mine[no[mine] == g]
                    names = lambda k, at=at: term.take(pa.array(row[at[k]])).to_pylist()
                    coded = lambda k, names=names: [x.encode() for x in names(k)]
                    best[lang, g] = best_first(count[at], p[at], q[at], coded, best.get((lang, g), []), top)
            # all ordered pairs of a posting list, some lists at a time
            begin = np.cumsum(n) - n
            for c, lang in enumerate(langs):
                lists = np.flatnonzero((code == c) & (n > 1))
                done = 0
                while done < len(lists):
                    size = np.cumsum(n[lists[done:]] ** 2)
                    take = max(1, int(np.searchsorted(size, PAIRS, "right")))
                    some = lists[done : done + take]
                    done += take
                    for lo in range(0, int(n[some].max()) if take == 1 else 1, max(1, PAIRS // int(n[some].max()))):
                        # a single long list goes by blocks of its first member
                        hi = lo + max(1, PAIRS // int(n[some].max())) if take == 1 else None
                        left = np.concatenate([np.arange(begin[t], begin[t] + n[t])[lo:hi] for t in some])
                        width = n[row[left]]
                        a = np.repeat(left, width)
                        d = np.repeat(begin[row[left]], width) + np.arange(len(a)) - np.repeat(np.cumsum(width) - width, width)
                        a, d = a[a != d], d[a != d]
                        value = excess(p[a], p[d]) - excess(p[a], p0[d]) - excess(p0[a], p[d]) + excess(p0[a], p0[d])
                        add(lang, (no[a] << 31) | no[d], value)
                        if len(sums[lang][0]) > PAIRS:
                            yield sent(lang)
        held, n_held = [], 0
        for b in batches:
            held.append(b)
            n_held += len(b.column("entries").flatten())
            if n_held >= SEARCHED:
                yield from take_in(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                held, n_held = [], 0
        if n_held:
            yield from take_in(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
        for lang in list(sums):
            yield sent(lang)
        for (lang, g), found in best.items():
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), pa.array([g] * len(found), pa.int32()), pa.nulls(len(found), pa.int32()), pa.array([t.decode() for _, t in found]), pa.array([-f for f, _ in found], pa.int64())], ["lang", "i", "j", "term", "value"])

    return postings.mapInArrow(scan, _FOUND)


def _alone(histograms: DataFrame) -> DataFrame:
    """(lang, i, j, value): what the terms of one group alone add to its pairs
    with every other, and the terms of neither. ``histograms``: lang, no, p0,
    kept, ps and times (its terms by probability), numbers and zeros (no and
    p0 of the language's groups)."""

    def pairs(batches):
        for b in batches:
            for r in b.to_pylist():
                j, zero = np.array(r["numbers"], np.int64), np.array(r["zeros"], np.int64)
                p, times = np.array(r["ps"] or [], np.int64), np.array(r["times"] or [], np.int64)
                here, there = excess(np.int64(r["p0"]), zero) * r["kept"], np.zeros(len(j), np.int64)
                step = max(1, PAIRS // max(1, len(j)))
                for lo in range(0, len(p), step):
                    x, w = p[lo : lo + step, None], times[lo : lo + step, None]
                    here += ((excess(x, zero) - excess(np.int64(r["p0"]), zero)) * w).sum(axis=0)
                    there += ((excess(zero, x) - excess(zero, np.int64(r["p0"]))) * w).sum(axis=0)
                mine = np.full(len(j), r["no"])
                other = np.flatnonzero(j != r["no"])
                for i, k, value in ((mine, j, here), (j, mine, there)):
                    yield pa.RecordBatch.from_arrays([pa.array([r["lang"]] * len(other), pa.string()), *(pa.array(c[other].astype(t)) for c, t in ((i, np.int32), (k, np.int32), (value, np.int64)))], ["lang", "i", "j", "value"])

    return histograms.mapInArrow(pairs, "lang string, i int, j int, value long")


def audit(docs: DataFrame, *, least_docs: int = LEAST_DOCS, top: int = TOP, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank. Part ``pair``: every other source
    of the language by divergence. Part ``term``: at most ``top`` terms that
    the group has with p above the language's q. Ranks run from 1 by value
    descending, then item in UTF-8 order.

    Null lang, source and text are ''; a group without terms has pairs, with a
    value of 0 where its language keeps no term; a language of one group has
    no pairs. Repeated rows count as often as they come; an empty table gives
    no rows; other columns are ignored.
    """
    counts = term_counts(docs, lang_col=lang_col, source_col=source_col, text_col=text_col)
    # dealt out by language and term, so that the totals need no other exchange
    term = Window.partitionBy("lang", "term")
    counts = counts.withColumns({"in_lang": F.sum("many").over(term), "of_lang": F.sum("docs").over(term)})
    counts = written(counts.where((F.col("of_lang") >= least_docs) | (F.col("term") == "")).drop("docs", "of_lang"), name="kept")
    kept = counts.where("term != ''")
    languages = kept.groupBy("lang", "term").agg(F.max("in_lang").alias("many")).groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("many").alias("lang_total"))
    single = kept.select("lang", "source", "term", F.col("in_lang").alias("many"), F.col("many").alias("count"))
    totals = single.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    groups = counts.where("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").join(languages, "lang", "left").fillna(0, ["total", "kept", "lang_total"])
    groups = groups.withColumn("no", F.row_number().over(Window.partitionBy("lang").orderBy("source")))
    groups = written(groups.withColumn("p0", F.coalesce(probability(F.lit(0), F.col("total"), F.col("kept")), F.lit(1))), name="groups")
    known = F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups
    met = single.join(known, ["lang", "source"]).withColumns({"p": probability(F.col("count"), F.col("total"), F.col("kept")), "q": probability(F.col("many"), F.col("lang_total"), F.col("kept"))})
    met = met.select("lang", "term", "q", "no", "count", "p", "p0")
    postings = met.groupBy("lang", "term", "q").agg(F.sort_array(F.collect_list(F.struct("no", "count", "p", "p0"))).alias("entries"))
    found = written(_postings_scan(postings, top), name="found")

    times = met.groupBy("lang", "no", "p").agg(F.count(F.lit(1)).alias("n")).groupBy("lang", "no").agg(F.collect_list("p").alias("ps"), F.collect_list("n").alias("times"))
    zeros = groups.groupBy("lang").agg(F.collect_list("no").alias("numbers"), F.collect_list("p0").alias("zeros"))
    histograms = groups.select("lang", "no", "p0", "kept").join(times, ["lang", "no"], "left").join(zeros, "lang")
    pairs = _alone(histograms).unionByName(found.where("term IS NULL").select("lang", "i", "j", "value"))
    pairs = pairs.groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    name = lambda no, column: groups.select("lang", F.col("no").alias(no), F.col("source").alias(column))
    pairs = pairs.join(name("i", "source"), ["lang", "i"]).join(name("j", "item"), ["lang", "j"])
    place = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(place).alias("rank"))
    terms = best_rows(found.where("term IS NOT NULL"), ["lang", "i"], [F.desc("value"), "term"], top).join(name("i", "source"), ["lang", "i"])
    return pairs.unionByName(terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank"))
