"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. A line's features are its own surface
statistics and those of the lines before and after it; the chain's transitions
let a line's label lean on its neighbours' labels. A document's score is the
mean of its lines' forward-backward marginals for "good", weighted by length.

Only documents are labelled. Training relabels lines by the model itself,
held to the document's label in the mean (``_train``), so that good and bad
lines stand next to each other and the transitions have something to learn. The
sample of labelled documents is bounded, as is the block of lines read of each;
its features go to the driver, where the weights are fitted. Scoring reads
every line of every document in one pass without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare
from .memory import tidy
from .wordhash import slices

#: Bounds of what is learned from.
MAX_PER_LABEL = 1500
MAX_LINES = 64
#: Share of a document's length that has its label, at least.
MOSTLY = 0.9
#: Relabellings, and steps of the weights after each.
ROUNDS, STEPS = 3, 25
_SYMBOL = re.compile(r"[^\w\s]")
_RUN = re.compile(r"[^\w\s]{2,}")
_DIGIT = re.compile(r"\d")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
FEATURES = ("length", "words", "symbols", "symbol_runs", "digits", "upper", "upper_words", "repeats", "variety", "word_length", "lone_symbols", "again")
N = len(FEATURES)
#: With both neighbours' features, and whether there is a neighbour.
WIDTH = 3 * N + 2


def line_features(lines: list[str]) -> np.ndarray:
    """One row of surface statistics a line."""
    out = np.zeros((len(lines), N))
    seen: set[str] = set()
    for i, line in enumerate(lines):
        words = line.split()
        n, w = max(1, len(line)), max(1, len(words))
        runs = len(_RUN.findall(line))
        repeats = sum(map(eq, words, islice(words, 1, None)))
        out[i] = (np.log1p(len(line)) / 10, np.log1p(len(words)) / 8, len(_SYMBOL.findall(line)) / n, runs / w, len(_DIGIT.findall(line)) / n, len(_UPPER.findall(line)) / n, sum(map(str.isupper, words)) / w, repeats / w, len(set(words)) / w, min(n / w, 40) / 10, sum(x in "|-*•·#=_" for x in words) / w, line in seen and bool(words))
        seen.add(line)
    return out


def with_neighbours(own: np.ndarray) -> np.ndarray:
    n = len(own)
    out = np.zeros((n, WIDTH))
    out[:, :N] = own
    out[1:, N : 2 * N] = own[:-1]
    out[:-1, 2 * N : 3 * N] = own[1:]
    out[0, -2] = out[-1, -1] = 1
    return out


@dataclass
class QualityModel:
    """Weights for "good" over standardised features, a bias and the chain's
    transitions (rows: from bad, good)."""

    mean: np.ndarray = field(default_factory=lambda: np.zeros(WIDTH))
    scale: np.ndarray = field(default_factory=lambda: np.ones(WIDTH))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(WIDTH + 1))
    transitions: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    def good(self, lines: list[str]) -> np.ndarray:
        """Marginal probability of "good" for each line."""
        x = (with_neighbours(line_features(lines)) - self.mean) / self.scale
        unary = (x @ self.weights[:-1] + self.weights[-1]).tolist()
        t = np.exp(self.transitions).tolist()
        # forward and backward messages as the odds of good against bad
        n, top = len(unary), 60.0
        e = [np.exp(max(-top, min(top, u))) for u in unary]
        forward, r = [0.0] * n, 1.0
        for i in range(n):
            r = e[i] if i == 0 else e[i] * (t[0][1] + r * t[1][1]) / (t[0][0] + r * t[1][0])
            r = min(max(r, 1e-30), 1e30)
            forward[i] = r
        back, out = 1.0, np.zeros(n)
        for i in range(n - 1, -1, -1):
            odds = forward[i] * back
            out[i] = odds / (1 + odds)
            r = min(max(e[i] * back, 1e-30), 1e30)
            back = (t[1][0] + r * t[1][1]) / (t[0][0] + r * t[0][1])
        return out

    def score(self, text: str) -> float:
        """Length-weighted mean of the marginals; 0 for a text without any
        character other than white space."""
        lines = [x for x in text.split("\n") if x.strip()]
        if not lines:
            return 0.0
        length = np.array([len(x) for x in lines], float)
        return float(min(1.0, max(0.0, (self.good(lines) * length).sum() / length.sum())))


def _marginals(u: np.ndarray, off: np.ndarray, before: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over all chains at once: the marginals of "good" and
    of every two neighbours' labels. ``u`` are log odds, first lines of all
    chains first (``off`` bounds them), long chains before short ones;
    ``before`` is the place of each later line's predecessor."""
    e = np.stack([np.zeros(len(u)), np.clip(u, -30, 30)], axis=1)
    a, b = e.copy(), np.zeros_like(e)
    for lo, at, hi in zip(off[:-2], off[1:-1], off[2:], strict=True):
        last = a[lo : lo + hi - at]
        a[at:hi] += np.logaddexp(last[:, :1] + trans[0], last[:, 1:] + trans[1])
    for lo, at, hi in zip(off[-3::-1], off[-2:0:-1], off[:1:-1], strict=True):
        after = (e[at:hi] + b[at:hi])[:, None, :] + trans
        b[lo : lo + hi - at] = np.logaddexp(after[..., 0], after[..., 1])
    total = a + b
    z = np.logaddexp(total[:, 0], total[:, 1])
    later = slice(off[1], None)
    pair = np.exp(a[before][:, :, None] + trans + (e + b)[later][:, None, :] - z[later][:, None, None])
    return np.exp(total[:, 1] - z), pair


def _first_weights(x: np.ndarray, y: np.ndarray, share: np.ndarray, ridge: float, steps: int = 12) -> np.ndarray:
    """Logistic regression of lines on their documents' labels, by Newton."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (share * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        w = w + np.linalg.solve(curve, x.T @ (share * (y - p)) - ridge * w)
    return w


def _train(chains: list[np.ndarray], labels: np.ndarray, ridge: float = 1e-3, rounds: int = ROUNDS, steps: int = STEPS, rate: float = 0.05) -> QualityModel:
    """Expectation-maximisation for labels that hold for documents only.

    Lines first take their document's label. Then, in rounds, every chain is
    relabelled by its own marginals, shifted only as far as the length-weighted
    mean needs to reach MOSTLY in good documents and to stay under 1 - MOSTLY
    in bad ones, so lines of both kinds stand side by side and the transitions
    learn from them; the weights then climb the expected likelihood (Adam).
    """
    flat = np.concatenate(chains)
    model = QualityModel(flat.mean(axis=0), flat.std(axis=0) + 1e-3)
    order = sorted(range(len(chains)), key=lambda i: -len(chains[i]))
    count, labels = np.array([len(chains[i]) for i in order]), labels[order]
    first = np.concatenate(([0], np.cumsum([len(c) for c in chains])))[order]
    alive = [(count > t).sum() for t in range(count[0])]
    off = np.concatenate(([0], np.cumsum(alive)))
    chain = np.concatenate([np.arange(k) for k in alive])
    line = np.repeat(np.arange(count[0]), alive)
    before = np.arange(off[1], off[-1]) - np.repeat(alive[:-1], alive[1:])
    flat = flat[first[chain] + line]
    x = np.concatenate([(flat - model.mean) / model.scale, np.ones((len(flat), 1))], axis=1)
    length = np.expm1(10 * flat[:, 0])
    length /= np.bincount(chain, length)[chain]
    # each label weighs the same in sum, and so does each document of a label
    share = (np.where(labels == 1, 0.5 / (labels == 1).sum(), 0.5 / (labels == 0).sum()) / count)[chain]
    theta = np.concatenate([_first_weights(x, labels[chain].astype(float), share, ridge), np.zeros(4)])
    m, v, step = np.zeros_like(theta), np.zeros_like(theta), 0

    for _ in range(rounds):
        u, trans = x @ theta[:-4], theta[-4:].reshape(2, 2)
        lo, hi = np.where(labels == 1, 0.0, -30.0), np.where(labels == 1, 30.0, 0.0)
        for _ in range(12):
            shift = (lo + hi) / 2
            mean = np.bincount(chain, _marginals(u + shift[chain], off, before, trans)[0] * length)
            low = mean < np.where(labels == 1, MOSTLY, 1 - MOSTLY)
            lo, hi = np.where(low, shift, lo), np.where(low, hi, shift)
        shift = np.where(np.where(labels == 1, lo == 0, hi == 0), 0, (lo + hi) / 2)
        want, want_pair = _marginals(u + shift[chain], off, before, trans)
        for _ in range(steps):
            w, trans = theta[:-4], theta[-4:].reshape(2, 2)
            good, pair = _marginals(x @ w, off, before, trans)
            grad_t = ((want_pair - pair) * share[off[1] :, None, None]).sum(axis=0).ravel()
            grad = np.concatenate([((want - good) * share) @ x, grad_t]) - ridge * theta
            step += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model.weights, model.transitions = theta[:-4], theta[-4:].reshape(2, 2)
    return model


def fit(docs: DataFrame, labels: DataFrame, *, per_label: int = MAX_PER_LABEL, max_lines: int = MAX_LINES, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Learn from ``labels(doc_id, label)``, label 1 good, on at most
    ``per_label`` documents of each label (least hash first) and a block of
    at most ``max_lines`` consecutive lines of each. Without both labels every line weighs the
    same and non-empty texts score 0.5."""
    prepare(docs.sparkSession)
    clean = labels.where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.min("label").cast("int").alias("label"))
    order = [F.xxhash64("doc_id", F.lit("quality")), "doc_id"]
    parts = [clean.where(F.col("label") == v).orderBy(*order).limit(per_label) for v in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # at most 2 * per_label ids
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text IS NOT NULL").join(chosen, "doc_id").dropDuplicates(["doc_id"])

    def features(batches):
        for whole in batches:
            for b in slices(whole, "text"):
                out = []
                for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                    lines = [x for x in text.split("\n") if x.strip()]
                    f = with_neighbours(line_features(lines)) if lines else np.zeros((0, WIDTH))
                    if len(f) > max_lines:
                        at = zlib.crc32(str(doc).encode()) % (len(f) - max_lines + 1)
                        f = f[at : at + max_lines]
                    out.append(f.astype("<f4").tobytes())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(out, pa.binary())], ["doc_id", "label", "features"])

    rows = texts.mapInArrow(tidy(features), "doc_id long, label int, features binary").orderBy("doc_id").collect()
    chains = [np.frombuffer(r.features, "<f4").reshape(-1, WIDTH).astype(float) for r in rows]
    keep = [i for i, c in enumerate(chains) if len(c)]
    label = np.array([rows[i].label for i in keep])
    if len(set(label.tolist())) < 2:
        return QualityModel()
    return _train([chains[i] for i in keep], label)


def score(docs: DataFrame, model: QualityModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, n_lines): score in 0..1, higher: good likelier. Null
    and empty texts score 0. Rows are neither merged nor ordered; ids may be
    null or repeat; an empty table gives an empty result."""
    prepare(docs.sparkSession)

    def scan(batches):
        for whole in batches:
            for b in slices(whole, "text"):
                texts = [t or "" for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([model.score(t) for t in texts], pa.float64()), pa.array([sum(1 for x in t.split("\n") if x.strip()) for t in texts], pa.int32())], ["doc_id", "score", "n_lines"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(scan), "doc_id long, score double, n_lines int")


def keep_good(docs: DataFrame, model: QualityModel, *, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, unchanged, that score ``threshold`` or more."""
    prepare(docs.sparkSession)
    names = docs.columns

    def scan(batches):
        for whole in batches:
            for b in slices(whole, text_col):
                yield b.filter(pa.array([model.score(t or "") >= threshold for t in b.column(names.index(text_col)).to_pylist()], pa.bool_()))

    return docs.mapInArrow(tidy(scan), docs.schema)
