"""Toxicity by a learned lexicon, misspellings included, in context.

Lexicon. From a bounded sample of labelled documents, words and word stems are
counted by label in Spark; those are kept that occur in toxic documents beyond
chance (near copies of a document share one vote, so that their common words
gain nothing), without what another kept term implies.

Matching. The lexicon is a trie. Each term allows 0, 1 or 2 edits by its
length; the Levenshtein automata of all terms are run at once over the trie,
determinised lazily: a state is the set of (trie node, edits spent), a move is
made when a text first needs it. Stems match exactly, as a word's start.

Context. A window of words around each hit is read: a hit inside quotation
marks or beside words of reporting is damped, other hits and direct address
strengthen it. Damped and plain sums go into a logistic regression.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare
from .memory import tidy
from .wordhash import mix, slices

#: Bounds of what is learned from.
MAX_PER_LABEL = 3000
#: log of how many candidates there may be over the chance to admit a false one.
EVIDENCE = 14.5
STEM = (4, 8)
WORD = (3, 24)
MAX_STATES = 100_000
MAX_CACHED = 150_000
#: Context window in words to each side.
RADIUS = 8

TOKEN = re.compile(r"[^\W_]+")
_QUOTES = re.compile(r"\"[^\"\n]+\"|“[^”\n]+”|«[^»\n]+»|„[^“”\n]+[“”]|^>.*$", re.M)
#: Words that report or mention rather than abuse; words that address.
REPORTING = frozenset("said says wrote called quote quoted quotes word words term phrase meaning definition dictionary".split())
ADDRESS = frozenset("you your yours youre du dich dein ihr tu te toi vous usted ustedes".split())


def edits_allowed(length: int) -> int:
    return 0 if length <= 4 else 1 if length <= 8 else 2


class Automaton:
    """Levenshtein automata of all terms intersected with their trie."""

    def __init__(self, terms: list[tuple[str, bool, int]]):
        """terms: (text, is_stem, edits allowed)."""
        self.terms = terms
        self.child: list[dict[str, int]] = [{}]
        self.word: list[int] = [-1]
        self.stem: list[int] = [-1]
        self.most: list[int] = [-1]  # edits that some term below allows
        for i, (text, is_stem, edits) in enumerate(terms):
            at, path = 0, [0]
            for ch in text:
                if ch not in self.child[at]:
                    self.child[at][ch] = len(self.child)
                    self.child.append({})
                    self.word.append(-1)
                    self.stem.append(-1)
                    self.most.append(-1)
                at = self.child[at][ch]
                path.append(at)
            (self.stem if is_stem else self.word)[at] = i
            for node in path:
                self.most[node] = max(self.most[node], 0 if is_stem else edits)
        self.reset()

    def reset(self) -> None:
        self.ids: dict = {}
        self.sets: list[tuple] = []
        self.moves: list[dict[str, int]] = []
        self.hit: list[tuple[int, int] | None] = []
        self.start = self.add({(0, "", 0): 0}, -1)

    def add(self, items: dict, stem: int) -> int:
        """items: (node, awaited character of a swap, stem lost) -> edits."""
        pending = list(items.items())
        while pending:  # characters of the term left out of the word
            (node, wait, _), used = pending.pop()
            if wait or used >= self.most[node]:
                continue
            for nxt in self.child[node].values():
                if used + 1 <= self.most[nxt] and items.get((nxt, "", 0), 9) > used + 1:
                    items[nxt, "", 0] = used + 1
                    pending.append(((nxt, "", 0), used + 1))
        key = (frozenset(items.items()), stem)
        found = self.ids.get(key)
        if found is None:
            found = self.ids[key] = len(self.sets)
            self.sets.append((tuple(items.items()), stem))
            self.moves.append({})
            best = None
            for (node, wait, _), used in items.items():
                term = self.word[node]
                if not wait and term >= 0 and used <= self.terms[term][2] and (best is None or used < best[1]):
                    best = (term, used)
            self.hit.append((stem, 0) if stem >= 0 and (best is None or best[1]) else best)
        return found

    def move(self, at: int, ch: str) -> int:
        items, stem = self.sets[at]
        out: dict = {}

        def put(node, wait, used):
            if used <= self.most[node] and out.get((node, wait, 0), 9) > used:
                out[node, wait, 0] = used

        for (node, wait, _), used in items:
            if wait:
                if ch == wait:
                    put(node, "", used)
                continue
            same = self.child[node].get(ch)
            if same is not None:
                put(same, "", used)
                if used == 0 and stem < 0:
                    stem = self.stem[same]
            if used < self.most[node]:
                put(node, "", used + 1)  # a character too many
                for other, nxt in self.child[node].items():
                    if nxt != same:
                        put(nxt, "", used + 1)  # another character
                    swapped = self.child[nxt].get(ch)
                    if swapped is not None and other != ch:
                        put(swapped, other, used + 1)  # two swapped
        if not out and stem < 0:
            self.moves[at][ch] = -1
            return -1
        to = self.moves[at][ch] = self.add(out, stem)
        return to

    def match(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the best match, or None."""
        if len(self.sets) > MAX_STATES:
            self.reset()
        at, moves = self.start, self.moves
        for ch in word:
            to = moves[at].get(ch)
            if to is None:
                to = self.move(at, ch)
            if to < 0:
                return None
            at = to
        return self.hit[at]


@dataclass
class ToxicityModel:
    """Terms (text, is_stem, edits) with weights for exact and for misspelled
    hits, and the regression's weights: bias, plain, damped."""

    terms: list = field(default_factory=list)
    exact: list = field(default_factory=list)
    fuzzy: list = field(default_factory=list)
    weights: tuple = (-3.0, 1.0, 0.3)

    def score(self, sums: tuple[float, float]) -> float:
        z = self.weights[0] + self.weights[1] * np.log1p(sums[0]) + self.weights[2] * np.log1p(sums[1])
        return float(1 / (1 + np.exp(-max(-60.0, min(60.0, z)))))


class Scanner(dict):
    """Words to their match; a dict, so that known words cost one lookup."""

    def __init__(self, terms: list):
        self.automaton = Automaton(terms)

    def __missing__(self, word: str):
        found = self.automaton.match(word)
        if len(word) > 40:
            return found
        if len(self) > MAX_CACHED:
            self.clear()
        self[word] = found
        return found

    def hits(self, text: str) -> list[tuple[int, int, float]]:
        """(term, edits, context): context 1 for a plain hit, below for a
        quoted or reported one, above among other hits or direct address."""
        low = text.lower()
        words = TOKEN.findall(low)
        found = [(i, m) for i, m in enumerate(map(self.__getitem__, words)) if m is not None]
        if not found:
            return []
        places = [m.start() for m in TOKEN.finditer(low)]
        quoted = [m.span() for m in _QUOTES.finditer(low)]
        at = [i for i, _ in found]
        out = []
        for i, (term, edits) in found:
            window = words[max(0, i - RADIUS) : i + RADIUS + 1]
            others = sum(1 for j in at if j != i and abs(j - i) <= RADIUS)
            context = 1.0 + 0.25 * min(3, others) + 0.25 * any(w in ADDRESS for w in window)
            if any(lo <= places[i] < hi for lo, hi in quoted):
                context *= 0.3
            elif any(w in REPORTING for w in window):
                context *= 0.6
            out.append((term, edits, context))
        return out


def _sums(model: ToxicityModel, hits) -> tuple[float, float]:
    plain = damped = 0.0
    for term, edits, context in hits:
        w = (model.fuzzy if edits else model.exact)[term] * context
        if context >= 1:
            plain += w
        else:
            damped += w
    return plain, damped


def _sample(labels: DataFrame, per_label: int) -> DataFrame:
    """At most ``per_label`` ids of each label, those of least hash."""
    order = [F.xxhash64("doc_id", F.lit("sample")), "doc_id"]
    parts = [labels.where(F.col("label") == v).orderBy(*order).limit(per_label) for v in (0, 1)]
    return parts[0].unionByName(parts[1])


def _family(words: set[str]) -> tuple:
    """Near copies mostly share it, others hardly ever: the words that are
    least by each of six hashes."""
    coded = np.array([zlib.crc32(w.encode()) for w in words], np.uint64)
    if not len(coded):
        return ()
    return tuple(int(mix(coded + np.uint64(k << 32)).min() >> np.uint64(1)) for k in range(1, 7))


def _choose(rows: list[tuple[str, bool, list[int], int]], weight: np.ndarray, base: float) -> list[tuple[str, bool]]:
    """Terms (text, is_stem, toxic documents, clean count) whose weighted
    support is too strong for chance, strongest first, without those that an
    earlier one implies."""
    support = np.array([weight[d].sum() for _, _, d, _ in rows])
    clean = np.array([c for *_, c in rows], float)

    def evidence(toxic: float, other: float) -> float:
        share = min(1 - 1e-9, max(1e-9, toxic / max(toxic + other, 1e-9)))
        return (toxic + other) * (share * np.log(share / base) + (1 - share) * np.log((1 - share) / (1 - base))) * (share > base)

    # a clean document weighs as much as ten toxic ones, and within some five
    # in a hundred the longer term wins, so a stem comes after the longer, purer
    # terms that it holds, and must add to them
    strength = np.round(20 * np.log(np.maximum(support - 10 * clean, 1e-3)))
    order = np.lexsort(([-len(r[0]) for r in rows], [r[1] for r in rows], -strength))
    chosen: list[tuple[str, bool, set]] = []
    stems: set[str] = set()
    for i in order:
        text, is_stem, docs, _ = rows[i]
        if any(text[:k] in stems for k in range(1, len(text) + 1)):
            continue
        own = set(docs)
        if is_stem:
            own = own.difference(*[d for t, _, d in chosen if t.startswith(text)])
        if own and evidence(float(weight[list(own)].sum()), clean[i]) >= EVIDENCE:
            chosen.append((text, is_stem, set(docs)))
            if is_stem:
                stems.add(text)
    return [(t, s) for t, s, _ in chosen]


def fit(docs: DataFrame, labels: DataFrame, *, per_label: int = MAX_PER_LABEL, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Learn from ``labels(doc_id, label)``, label 1 toxic, on at most
    ``per_label`` documents of each label. Without documents of both labels
    the model has no terms and scores every text alike."""
    prepare(docs.sparkSession)
    clean = labels.where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    chosen = F.broadcast(_sample(clean, per_label))  # at most 2 * per_label ids
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text IS NOT NULL").join(chosen, "doc_id").dropDuplicates(["doc_id"])

    def count(batches):
        for whole in batches:
            for b in slices(whole, "text"):
                tally: dict = {}
                for doc, text, label in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
                    words = {w for w in TOKEN.findall(text.lower()) if WORD[0] <= len(w) <= WORD[1]}
                    terms = {(w, False) for w in words} | {(w[:n], True) for w in words for n in range(STEM[0], min(STEM[1], len(w) - 1) + 1)}
                    for t in terms:
                        at = tally.setdefault(t, [0, [], 0.0])
                        if label:
                            at[1].append(doc)
                            at[2] += votes[doc]
                        else:
                            at[0] += 1
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in tally]), pa.array([s for _, s in tally], pa.bool_()), pa.array([v[0] for v in tally.values()], pa.int64()), pa.array([v[1] for v in tally.values()], pa.list_(pa.int64())), pa.array([v[2] for v in tally.values()], pa.float64())], ["term", "stem", "clean", "toxic", "support"])

    def family(batches):
        for whole in batches:
            for b in slices(whole, "text"):
                found = [list(_family(set(TOKEN.findall(t.lower())))) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "family"])

    toxic_docs = texts.where("label = 1").select("doc_id", "text").mapInArrow(tidy(family), "doc_id long, family array<long>").collect()  # six numbers each of at most per_label
    n_clean = texts.where("label = 0").count()
    if not toxic_docs or not n_clean:
        return ToxicityModel()
    index = {r.doc_id: i for i, r in enumerate(toxic_docs)}
    families = [tuple(r.family) for r in toxic_docs]
    size = Counter(families)
    weight = np.array([1 / size[f] for f in families])
    votes = {doc: float(weight[i]) for doc, i in index.items()}  # at most per_label

    counted = texts.mapInArrow(tidy(count), "term string, stem boolean, clean long, toxic array<long>, support double")
    counted = counted.groupBy("term", "stem").agg(F.sum("clean").alias("clean"), F.flatten(F.collect_list("toxic")).alias("toxic"), F.sum("support").alias("support"))
    # families vote, not documents; sums of shares are rounded
    base = len(toxic_docs) / (len(toxic_docs) + n_clean)
    v = F.col("support") + 1e-6
    odds = ((v + 0.5) / (len(size) + 1)) / ((F.col("clean") + 0.5) / (n_clean + 1))
    share = F.least(v / (v + F.col("clean")), F.lit(1 - 1e-9))
    strong = (v + F.col("clean")) * (share * F.log(share / base) + (1 - share) * F.log((1 - share) / (1 - base)))
    few = counted.where((v >= 2) & (odds >= 8) & (F.col("clean") <= 0.002 * n_clean + 0.1 * v) & (share > base) & (strong >= EVIDENCE))
    rows = few.orderBy(F.desc("support"), "term", "stem").collect()
    picked = _choose([(r.term, r.stem, [index[d] for d in r.toxic], r.clean) for r in rows], weight, base)
    if not picked:
        return ToxicityModel()
    by = {(r.term, r.stem): r for r in rows}
    terms = [(t, s, 0 if s else edits_allowed(len(t))) for t, s in picked]

    def log_odds(toxic, clean):
        return float(np.log(((toxic + 0.5) / (len(toxic_docs) + 1)) / ((clean + 0.5) / (n_clean + 1))))

    exact = [log_odds(len(by[k].toxic), by[k].clean) for k in picked]

    def features(batches):
        scanner = Scanner(terms)
        for whole in batches:
            for b in slices(whole, "text"):
                hits = [scanner.hits(t) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("label"), pa.array([[h[0] for h in x] for x in hits], pa.list_(pa.int32())), pa.array([[h[1] for h in x] for x in hits], pa.list_(pa.int32())), pa.array([[h[2] for h in x] for x in hits], pa.list_(pa.float64()))], ["label", "term", "edits", "context"])

    seen = texts.mapInArrow(tidy(features), "label int, term array<int>, edits array<int>, context array<double>").collect()
    fuzzy_counts: np.ndarray = np.zeros((len(terms), 2))
    for r in seen:
        for t in {t for t, e in zip(r.term, r.edits, strict=True) if e}:
            fuzzy_counts[t, r.label] += 1
    # misspellings seen in clean texts lose their weight; unseen ones get half
    fuzzy = []
    for i, (clean_n, toxic_n) in enumerate(fuzzy_counts):
        seen_weight = max(0.0, log_odds(toxic_n, clean_n))
        share = (clean_n + toxic_n) / (clean_n + toxic_n + 2)
        fuzzy.append(float((1 - share) * 0.5 * exact[i] + share * min(exact[i], seen_weight)))
    terms = [(t, s, e if f > 0.5 else 0) for (t, s, e), f in zip(terms, fuzzy, strict=True)]
    model = ToxicityModel(terms, exact, fuzzy)
    x, y = np.ones((len(seen), 3)), np.array([r.label for r in seen], float)
    for i, r in enumerate(seen):
        x[i, 1:] = np.log1p(_sums(model, zip(r.term, r.edits, r.context, strict=True)))
    model.weights = tuple(_logistic(x, y, penalty=(0.0, 0.05, 0.05)))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, penalty: tuple) -> list[float]:
    """Newton's method with a ridge penalty."""
    w, ridge = np.zeros(x.shape[1]), np.diag(penalty) + 1e-6 * np.eye(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + ridge, x.T @ (y - p) - ridge @ w)
        norm = float(np.abs(step).max())
        w += step * min(1.0, 5.0 / max(norm, 1e-12))
        if norm < 1e-8:
            break
    return w.tolist()


def score(docs: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, n_hits): score in 0..1, higher: toxic likelier. Whole
    texts are read. Null and empty texts have no hits. Rows are neither merged
    nor ordered; ids may be null or repeat."""
    prepare(docs.sparkSession)

    def scan(batches):
        scanner = Scanner(model.terms)
        for whole in batches:
            for b in slices(whole, "text"):
                hits = [scanner.hits(t) if t else [] for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([model.score(_sums(model, h)) for h in hits], pa.float64()), pa.array([len(h) for h in hits], pa.int32())], ["doc_id", "score", "n_hits"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(scan), "doc_id long, score double, n_hits int")


def keep_clean(docs: DataFrame, model: ToxicityModel, *, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, unchanged, that score below ``threshold``."""
    prepare(docs.sparkSession)
    names = docs.columns

    def scan(batches):
        scanner = Scanner(model.terms)
        for whole in batches:
            for b in slices(whole, text_col):
                hits = [scanner.hits(t) if t else [] for t in b.column(names.index(text_col)).to_pylist()]
                yield b.filter(pa.array([model.score(_sums(model, h)) < threshold for h in hits], pa.bool_()))

    return docs.mapInArrow(tidy(scan), docs.schema)
