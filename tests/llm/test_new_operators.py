"""Divergence audit, ranked search and histogram packing against brute force."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from trajecta.llm import divergence, histogram_packing, lexical_search, queries
from trajecta.llm.bpe import public_path

from ..compare import connect, differences

SF = "/root/testdata/sf0.001"
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ODD = [(1, None, "en", "a"), (2, "", "en", None), (3, "Éa ÉA ça-va_x 9y", None, "b"), (4, "one two", "en", "a"), (4, "one two", "en", "a"), (5, "ONE two Two", "en", "b"), (6, "x y " * 40000, "en", "b"), (None, "one no id", "en", "c"), (None, None, None, None)]
COLUMNS = "doc_id long, text string, lang string, source string"
EXTRA = {c: "x" for c in ("term", "n", "many", "value", "rank", "no", "_no", "_group", "score", "part", "tail", "row")}


@pytest.fixture(scope="module")
def odd(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(ODD, COLUMNS).withColumns({k: F.lit(v) for k, v in EXTRA.items()})


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_lexical_search"])
def test_sql(spark, name):
    missing, extra, got, want = differences(queries.queries()[name](spark, SF), queries.oracle_sql()[name], connect(SF))
    assert got == want and not missing and not extra


def brute_audit(rows, least=3, top=200):
    docs = [((lang or ""), (source or ""), LETTERS.findall((text or "").translate(LOW))) for _, text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = collections.Counter(t for d in mine for t in set(d[2]))
        kept = sorted(t for t in df if df[t] >= least)
        groups = sorted({d[1] for d in mine})
        count = {g: collections.Counter(t for d in mine if d[1] == g for t in d[2] if df[t] >= least) for g in groups}
        whole = sum(count.values(), collections.Counter())
        prob = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p, q = {g: prob(count[g]) for g in groups}, prob(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for g in groups:
            pairs = sorted((-sum(f(p[g][t], p[h][t]) for t in kept), h.encode()) for h in groups if h != g)
            terms = sorted((-f(p[g][t], q[t]), t.encode()) for t in kept if count[g][t] and p[g][t] > q[t])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out |= {(lang, g, part, item.decode(), -v, r) for r, (v, item) in enumerate(found, 1)}
    return out


def audited(df, **options):
    rows = divergence.audit(df, **options).select("lang", "source", "part", "item", "value", "rank").collect()
    assert len(rows) == len(set(rows))
    return set(map(tuple, rows))


def test_audit_against_brute_force(spark, odd):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 4)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None]), f"s{rng.choice([0, 0, 0, 1, 2, 3])}") for i in range(150)]
    df = spark.createDataFrame(rows, COLUMNS).repartition(5)
    assert audited(df) == brute_audit(rows)
    assert audited(df, top=5) == brute_audit(rows, top=5)  # ties at the k-th place
    assert audited(odd) == brute_audit(ODD)
    assert audited(odd.limit(0)) == set()


def test_audit_in_small_portions(spark, monkeypatch):
    """Bounds on what a task holds change nothing."""
    rng = random.Random(4)
    rows = [(i, " ".join(f"{rng.choice('abcdefgh')}{rng.choice('xyz')}" for _ in range(30)), "en", f"s{i % 9}") for i in range(120)]
    postings = spark.createDataFrame([], COLUMNS)
    want = brute_audit(rows)
    for name, value in (("GATHERED", 40), ("SEARCHED", 10), ("PAIRS", 16), ("BROADCAST_GROUPS", 0)):
        monkeypatch.setattr(divergence, name, value)
    assert audited(spark.createDataFrame(rows, COLUMNS)) == want and postings.isEmpty()


def test_best_first_stops_early_and_keeps_ties():
    rng = np.random.default_rng(1)
    count = rng.integers(1, 1 << 12, 5000)
    p, q = count * 1000 + 1, rng.integers(500, 900_000, 5000)
    names = [f"t{i:04d}".encode() for i in range(5000)]
    seen = []

    def terms(at):
        seen.extend(at.tolist())
        return [names[i] for i in at.tolist()]

    got = divergence.best_first(count, p, q, terms, [], 7)
    want = sorted((-int(divergence.excess(p[i : i + 1], q[i : i + 1])[0]), names[i]) for i in range(5000) if p[i] > q[i])[:7]
    assert got == want and len(seen) < 2500


def brute_search(docs, items, top):
    terms = lambda t: ALNUM.findall((t or "").translate(LOW))
    bags = [(i, collections.Counter(terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, total = len(bags), sum(n for _, _, n in bags)
    df = collections.Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, b, n in bags:
            m = 100 - 50 + 50 * n * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 20 * m)) for t in set(terms(text)) if b[t])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


def test_search_against_brute_force(spark, odd, monkeypatch):
    rng = random.Random(5)
    word = lambda: f"{rng.choice('aàB')}{rng.randint(0, 30)}"
    docs = [(i // 2, " ".join(word() for _ in range(rng.randint(0, 40)))) for i in range(300)] + [(r[0], r[1]) for r in ODD]
    items = [(1, "a1 A2 à3 a1"), (2, None), (3, ""), (None, "a4 b5"), (4, "nowhere"), (4, "b7 one"), (4, "b7 one"), (5, "x two")]
    ds, it = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id int, text string")
    got = lambda **o: sorted(map(tuple, lexical_search.search(ds, it, top=9, **o).select("item_id", "rank", "doc_id", "score").collect()), key=repr)
    want = brute_search(docs, items, 9)
    assert got() == want
    monkeypatch.setattr(lexical_search, "BLOCK_ITEMS", 3)
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", 7)
    assert got() == want
    assert got(once=False) != want  # an item that holds a term twice asks twice
    clash = odd.withColumnRenamed("value", "item_id")
    assert lexical_search.search(clash, it, top=2).count() > 0
    assert lexical_search.search(ds.limit(0), it).count() == lexical_search.search(ds, it.limit(0)).count() == 0


def check_packing(rows, texts, capacity):
    """Every id in one piece, sequences gapless and full or of a power of two."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    ids = [np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4") for x in texts]
    want = collections.Counter()
    places = collections.defaultdict(list)
    by_doc = collections.defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for pieces in places.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at == capacity or (at < capacity and at & (at - 1) == 0)
    for x in ids:
        want[len(x)] += 1
    return ids, by_doc, places


@pytest.mark.parametrize("capacity", [2048, 64])
def test_packing_by_histogram(spark, capacity):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = histogram_packing.pack_by_histogram(docs, capacity=capacity).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids, by_doc, places = check_packing(rows, [texts[i] for i in sorted(texts)], capacity)
    for i, x in zip(sorted(texts), ids, strict=True):
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(x) and r.ids_crc32 == zlib.crc32(x[at : at + r.length].tobytes())
            at += r.length
        assert at == len(x)
    total = sum(map(len, ids))
    assert len(places) <= total // capacity + 1 + capacity.bit_length()


def test_packing_of_odd_rows(spark, odd):
    rows = histogram_packing.pack_by_histogram(odd, capacity=256).collect()
    ids, by_doc, _ = check_packing(rows, [r[1] for r in ODD], 256)
    assert sum(r.length for r in rows) == sum(map(len, ids))
    assert {r.doc_id for r in rows} == {r[0] for r in ODD}
    assert histogram_packing.pack_by_histogram(odd.limit(0)).count() == 0


def test_tails_of_known_text_cost_less_than_two_patterns_take(spark, monkeypatch):
    """The scan that tokenises, in this process, once its words are known."""
    import time
    from types import SimpleNamespace

    import pyarrow as pa

    from trajecta.llm import bpe

    monkeypatch.setattr(histogram_packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    docs = SimpleNamespace(sparkSession=spark, select=lambda *_: SimpleNamespace(mapInArrow=lambda scan, _: scan))
    scan = histogram_packing.tails(docs)
    texts = [" ".join(f"lan{(i * k) % 90}mer" for k in range(4000)) for i in range(150)]
    batch = pa.record_batch({"doc_id": pa.array(range(150), pa.int64()), "text": texts})
    assert sum(b.num_rows for b in scan(iter([batch]))) == 150

    def least(what):
        took = []
        for _ in range(4):
            began = time.process_time()
            what()
            took.append(time.process_time() - began)
        return min(took)

    assert least(lambda: list(scan(iter([batch])))) < 2 * least(lambda: [bpe.CHUNK.findall(t) for t in texts])


def test_least_squares_are_optimal():
    """No column gains, and those in use are level."""
    rng = np.random.default_rng(2)
    wanted = np.zeros(256, np.int64)
    np.add.at(wanted, np.clip(rng.lognormal(4, 0.7, 4000).astype(int), 1, 255), 1)
    columns = histogram_packing.combinations(np.flatnonzero(wanted), 256)
    assert ((columns.sum(axis=1) == 256) & ((wanted[columns] > 0) | (columns == 0)).all(axis=1)).all() and len(np.unique(columns, axis=0)) == len(columns)
    held, x = histogram_packing.non_negative_least_squares(columns, wanted, rounds=200, steps=3000)
    rest = wanted - np.bincount(columns[held].ravel(), weights=np.repeat(x, 3), minlength=256)
    rest[0] = 0
    gain = rest[columns].sum(axis=1)
    assert (x > 0).all() and gain.max() < 0.5 and np.abs(gain[held]).max() < 0.5
    chosen = histogram_packing.repeats(columns, wanted)
    used = np.zeros(256, np.int64)
    for lengths, n in chosen:
        assert sum(lengths) == 256
        np.add.at(used, list(lengths), n)
    assert (used <= wanted).all() and used.sum() > 0.5 * wanted.sum()


def test_nearest_with_repeated_ids(spark):
    """An id on several vectors: every row is a candidate and a query."""
    from pyspark.sql import functions as F

    from trajecta.llm import ann

    rng = np.random.default_rng(7)
    rows = [(int(i), [float(x) for x in v]) for i, v in zip([*range(0, 300), *range(0, 300, 50), 100, 100], rng.normal(size=(308, 5)), strict=True)]
    rows += [(100, rows[3][1]), (7, rows[8][1])] + rows[:5]
    odd = [(None, [1.0] * 5), (400, None), (500, [0.0] * 5)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("node", "v", "code", "rank", "dist", "query_id")})
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in ann.nearest(df).collect())
    every = sorted({(i, tuple(v)) for i, v in rows})
    want = []
    for i, v in every:
        if i % 100 == 0:
            near = sorted((math.dist(v, w), j) for j, w in every if (j, w) != (i, v))[:10]
            want += [(i, r, j, round(d, 9)) for r, (d, j) in enumerate(near, 1)]
    want = sorted(want)
    hits = sum((collections.Counter(g for g in [(q, v, s) for q, _, v, s in got]) & collections.Counter((q, v, s) for q, _, v, s in want)).values())
    assert len(got) == len(want) and hits >= 0.97 * len(want)
    assert ann.nearest(df.where("vec_id % 100 <> 0")).count() == 0
