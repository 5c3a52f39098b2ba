"""Operators against brute force on small fixtures, and their edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajecta.llm import ann, bpe, components, licenses, near_dedup, order_minhash, packing, quality, queries, substring_dedup, toxicity, url_filter
from trajecta.llm.common import crc_bucket

from ..compare import connect, differences

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (5, "é" * 3000), (6, "x y " * 4000), (None, "no id at all here"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, clashing extra columns."""
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    return df.withColumns({c: F.lit("extra") for c in ("id", "row_key", "score", "_gone", "_kept", "hot", "label")})


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def texts(df):
    return {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}


def brute_groups(by_id, k, percent):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, t in by_id.items():
        w = WORD.findall(t.translate(low))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in by_id}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(by_id)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates(spark, docs, odd, none):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, words=4).collect()}
    assert got == brute_groups(texts(docs), 4, 80)
    rows = near_dedup.near_duplicates(odd, words=4).collect()
    assert len(rows) == len(ODD) and all(r.kept for r in rows)
    assert near_dedup.near_duplicates(none).count() == 0
    assert near_dedup.keep_one(odd).columns == odd.columns


def test_near_duplicates_of_repeated_ids(spark):
    """An id on a copy and on a text of its own: each row by its own text."""
    text = " ".join(f"a{i}" for i in range(30))
    rows = [(1, text), (5, text), (5, " ".join(f"b{i}" for i in range(30))), (8, " ".join(f"b{i}" for i in range(30))), (None, text), (6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_dedup.near_duplicates(df, words=4).collect())
    assert got == [(0, 0, True), (1, 1, True), (5, 1, False), (5, 5, True), (6, 6, True), (8, 5, False)]
    left = {(r.doc_id, r.text) for r in near_dedup.keep_one(df, words=4).collect()}
    assert left == {rows[0], rows[2], rows[4], rows[5]}


def test_near_duplicates_around_one_base(spark):
    """A large family of edited copies: links to the base, not to each other."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 700):
        w = list(base)
        for at in rng.sample(range(200), 4):
            w[at] = f"z{i}_{at}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, words=4).collect()}
    want = {i: c for i, (_, c) in brute_groups(dict(rows), 4, 80).items()}
    assert sum(got[i] != want[i] for i in got) == 0


def edited_copies(n, rng, edits):
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(n):
        w = list(base)
        for at in rng.sample(range(100), edits[i % len(edits)]):
            w[at] = f"z{i}_{at}"
        rows.append((i, " ".join(w)))
    return rows, " ".join(base)


def test_near_duplicates_of_thousands_of_copies(spark):
    """Copies that reach the threshold with the base alone, in one region."""
    rows, base = edited_copies(5200, random.Random(5), [2])
    df = spark.createDataFrame([*rows, (9000, base)], "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, words=4).collect()}
    assert len(got) == 5201 and set(got.values()) == {0}


def test_near_duplicates_in_overfull_regions(spark, monkeypatch):
    """Regions far above LEAF without a base: every pair is met."""
    rows, _ = edited_copies(300, random.Random(6), [1, 3])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    want = {i: c for i, (_, c) in brute_groups(dict(rows), 4, 87).items()}
    assert 1 < len(set(want.values())) < 300
    monkeypatch.setattr(near_dedup, "LEAF", 16)
    monkeypatch.setattr(near_dedup, "WIDE", 48, raising=False)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, words=4, threshold=87).collect()}
    assert got == want


def brute_leaves(keys, leaf):
    """Parts of (tree, key) rows by their prefixes: the shortest with at most ``leaf`` rows."""
    out, left = set(), keys
    for depth in range(near_dedup.MIN_DEPTH, near_dedup.DEPTH + 1):
        parts = {}
        for i, (tree, key) in left.items():
            parts.setdefault((tree, key[:depth]), []).append(i)
        out |= {(tree, depth, tuple(sorted(m))) for (tree, _), m in parts.items() if 1 < len(m) <= leaf}
        over = {i for m in parts.values() if len(m) > leaf for i in m}
        left = {i: k for i, k in left.items() if i in over}
    return out


@pytest.mark.parametrize("partitions", ["2", "50"])
def test_forest_leaves_against_prefixes(spark, monkeypatch, partitions):
    """Depths adapt region by region, wherever ranges and spans part the order."""
    rng = random.Random(11)
    keys = {i: (rng.randrange(2), tuple(min(rng.randrange(4), rng.randrange(4)) for _ in range(near_dedup.DEPTH))) for i in range(900)}
    keys |= {1000 + i: (0, (1,) * near_dedup.DEPTH) for i in range(40)}
    rows = [(t, np.array(k, ">u4").tobytes(), np.array(k[: near_dedup.MIN_DEPTH], ">u4").tobytes(), i, bytes(24)) for i, (t, k) in keys.items()]
    monkeypatch.setattr(near_dedup, "LEAF", 12)
    monkeypatch.setattr(near_dedup, "SPAN", 30)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        order = near_dedup.forest_order(spark.createDataFrame(rows, "tree int, key binary, prefix binary, rep long, sketch binary"))
        places = sorted((r.pos, r.tree, r.key, r.rep) for r in order.collect())
        found = near_dedup.candidate_groups(order, threshold=80).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert [p[0] for p in places] == list(range(len(places)))
    assert [tuple(p[1:]) for p in places] == sorted(tuple(p[1:]) for p in places)
    groups = {}
    for r in found:
        groups.setdefault((r.tree, r.depth, r.gid), []).append(r.member)
    got = [(t, d, tuple(sorted(m))) for (t, d, _), m in groups.items()]
    want = brute_leaves(keys, 12)
    assert len({d for _, d, _ in want}) > 3
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("partitions", ["2", "50"])
def test_forest_overfull_regions_against_counts(spark, monkeypatch, partitions):
    """Every row of a region above LEAF, once, wherever spans part the order."""
    rng = random.Random(12)
    keys = {i: (rng.randrange(2), tuple(min(rng.randrange(5), rng.randrange(5)) for _ in range(near_dedup.DEPTH))) for i in range(700)}
    keys |= {1000 + i: (1, (7,) * near_dedup.DEPTH) for i in range(90)}
    rows = [(t, np.array(k, ">u4").tobytes(), np.array(k[: near_dedup.MIN_DEPTH], ">u4").tobytes(), i, bytes(24)) for i, (t, k) in keys.items()]
    monkeypatch.setattr(near_dedup, "LEAF", 12)
    monkeypatch.setattr(near_dedup, "SPAN", 30)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        order = near_dedup.forest_order(spark.createDataFrame(rows, "tree int, key binary, prefix binary, rep long, sketch binary"))
        hot = near_dedup.split_order(order, threshold=80).where("depth IS NULL").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    size, same = {}, {}
    for t, k in keys.values():
        size[t, k[:2]] = size.get((t, k[:2]), 0) + 1
        same[t, k] = same.get((t, k), 0) + 1
    assert sorted((r.tree, r.member) for r in hot) == sorted((t, i) for i, (t, k) in keys.items() if size[t, k[:2]] > 12)
    assert all(r.alike == same[keys[r.member]] for r in hot if r.member < 1000)
    blocks = {}
    for r in hot:
        blocks[r.block] = blocks.get(r.block, 0) + 1
    assert max(blocks.values()) <= 12


def test_near_duplicates_in_few_tasks(spark, monkeypatch):
    """Each further pass costs as many tasks as there are partitions, however
    few rows are left: overfull regions take two passes, and one scan for sets."""
    rows, _ = edited_copies(300, random.Random(6), [1, 3])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    monkeypatch.setattr(near_dedup, "LEAF", 16)
    monkeypatch.setattr(near_dedup, "WIDE", 48)
    settings = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in settings}
    sc, group = spark.sparkContext, "few-tasks"
    for k, v in settings.items():
        spark.conf.set(k, v)
    sc.setJobGroup(group, group)
    try:
        near_dedup.near_duplicates(df, words=4, threshold=87).collect()
    finally:
        sc._jsc.clearJobGroup()
        for k, v in old.items():
            spark.conf.set(k, v)
    tracker = sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    tasks = sum(i.numCompletedTasks for i in map(tracker.getStageInfo, stages) if i)
    assert 0 < tasks < 2000


def test_substring_dedup(spark, docs, odd, none):
    seen, want = set(), {}
    for i, t in sorted(texts(docs).items()):
        w = WORD.findall(t)
        cover = [False] * len(w)
        for j in range(len(w) - 19):
            key = tuple(w[j : j + 20])
            if key in seen:
                cover[j : j + 20] = [True] * 20
            seen.add(key)
        kept = " ".join(x for x, c in zip(w, cover) if not c)
        want[i] = (len(w), sum(cover), hashlib.sha256(kept.encode()).hexdigest())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup_report(docs).collect()}
    assert got == want
    rows = substring_dedup.dedup_report(odd).collect()
    assert len(rows) == len(ODD)
    assert substring_dedup.dedup_report(none).count() == 0
    out = substring_dedup.remove_repeats(odd)
    assert out.columns == odd.columns and out.count() == len(ODD)


def test_substring_dedup_of_repeated_and_missing_ids(spark):
    rng = random.Random(8)
    passages = [" ".join(f"p{k}w{j}" for j in range(24)) for k in range(3)]
    rows = [(1, passages[0]), (5, passages[1] + " tail"), (5, passages[0] + " end"), (None, passages[2] + " a"), (None, passages[2] + " b"), (9, passages[2] + " c"), (9, passages[2] + " c")]
    for _ in range(60):
        words = [f"f{rng.randrange(10**6)}" for _ in range(rng.randrange(40))]
        at = rng.randrange(len(words) + 1)
        rows.append((rng.choice([None, *range(6)]), " ".join([*words[:at], rng.choice(passages), *words[at:]])))
    first = {}
    for i, t in rows:
        w = WORD.findall(t)
        for j in range(len(w) - 19):
            key = tuple(w[j : j + 20])
            first[key] = min(first.get(key, 99), -1 if i is None else i)
    want = []
    for i, t in rows:
        w, cover, seen = WORD.findall(t), set(), set()
        for j in range(len(w) - 19):
            key = tuple(w[j : j + 20])
            if first[key] < (-1 if i is None else i) or key in seen:
                cover |= set(range(j, j + 20))
            seen.add(key)
        kept = " ".join(x for j, x in enumerate(w) if j not in cover)
        want.append((-1 if i is None else i, len(w), len(cover), hashlib.sha256(kept.encode()).hexdigest()))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup_report(df).collect()]
    assert sorted(got) == sorted(want)
    assert substring_dedup.remove_repeats(df).count() == len(rows)


def test_packing(spark, docs, odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for df in (docs, odd):
        rows = packing.pack_documents(df).collect()
        by = {}
        for r in rows:
            by.setdefault(r.sequence_id, []).append(r)
        for s in by.values():
            at = 0
            for r in sorted(s, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            assert at <= 2048
        total = sum(r.length for r in rows)
        assert len(by) <= 1.03 * total / 2048 + 2
    got = {}
    for r in packing.pack_documents(docs).collect():
        got.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    for i, text in texts(docs).items():
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4")
        parts = sorted(got[i])
        assert [p[0] for p in parts] == list(range(len(parts))) and sum(p[2] for p in parts) == len(ids)
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for _, s, n, c in parts)
        assert all(n == 2048 for _, _, n, _ in parts[1:])
    assert packing.pack_documents(none).count() == 0


def test_packing_ids_are_those_of_tokenizers():
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, own, rng = Tokenizer.from_file(path), packing.Tokenizer(path), random.Random(5)
    parts = ["<|endoftext|>", "<|endof", "hello", " ", "  ", "\n", "\t", "don't", "é", "漢字", "\u3000", "\x1c", "\x85", "12", "!?", "𝒳", "\ud7ff", "'ll", "x" * 90, "it", "'s", "'", "×", "²", "ß", "#", "_", ".", "α"]
    given = ["".join(rng.choices(parts, k=rng.randrange(0, 30))) for _ in range(500)] + ["", "a  <|endoftext|>  b", "y" * 300_000]
    for texts_ in (given, given[::-1]):  # the second time from the cache
        assert own.encode(texts_) == [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts_]


def test_packing_reads_columns_with_nulls_and_wide_spaces():
    import random

    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, own, rng = Tokenizer.from_file(path), packing.Tokenizer(path), random.Random(6)
    parts = [*sorted(packing.WHITE), *" \n'", "'s", "S", "t", "5", "!", "'", "é", "×", "Ā", "\u0301", "漢", "½", "<|endoftext|>"]
    given = [None if k % 9 == 4 else "".join(rng.choices(parts, k=rng.randrange(20))) for k in range(600)]
    ids, ends = own.encode_column(pa.array(given, pa.string()).slice(3), 7)
    want = [[*plain.encode(t or "", add_special_tokens=False).ids, 7] for t in given[3:]]
    assert ids.tolist() == sum(want, []) and ends.tolist() == np.cumsum([len(w) for w in want]).tolist()
    assert own.encode([]) == [] and own.encode(["", ""]) == [b"", b""]


def test_packing_reads_known_text_in_less_than_a_pattern_takes():
    """A word is learned once whatever signs stand around it, and known words
    cost less than it takes to cut the text by a pattern."""
    import time

    import public_tokenizers

    own = packing.Tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    words = [a + b for a in ("ba", "che", "do", "fi", "gu") for b in ("lan", "mer", "nost")]
    own.encode([" ".join(f"{a}-{b}/{c}" for a in words for b in words for c in words)])
    assert len(own.known) <= 2 * len(words) + 4
    texts = [" ".join(words[(i * k) % len(words)] for k in range(i % 300)) for i in range(6000)]

    def least(what):
        took = []
        for _ in range(4):
            began = time.process_time()
            what()
            took.append(time.process_time() - began)
        return min(took)

    assert least(lambda: own.encode(texts)) < least(lambda: [bpe.CHUNK.findall(t) for t in texts])


def test_open_bins_take_the_best_fit():
    bins = packing.OpenBins(10, 2)
    assert bins.add("a", 6) is None and bins.add("b", 3) is None  # one bin, 1 free
    assert bins.add("c", 5) is None and bins.add("d", 1) == ["a", "b", "d"]
    assert bins.add("e", 7) is None and bins.add("f", 8) == ["e"]  # the fullest closes


@pytest.fixture(scope="module")
def encoder():
    import public_tokenizers

    return bpe.Encoder(bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


def test_bpe_equals_tiktoken(encoder):
    import public_tokenizers
    import tiktoken

    ranks = encoder.transducer.merges.ranks
    want = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng, tokens = random.Random(1), list(ranks)
    cases = ["", " ", "a  b\n\n c\t\td  ", "I'll we've 's 'T", "日本語 😀😀 naïve ²³½", "=" * 50, "a" * 300, "<|endoftext|>", "\x1c\x85x\u3000y\ufeff"]
    cases += [b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 8))).decode("utf-8", "replace") for _ in range(400)]
    cases += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(0, 0x3FF), rng.randint(0x2000, 0x30FF)])) for _ in range(rng.randint(1, 30))) for _ in range(400)]
    decoder = bpe.Decoder(ranks, step=3)
    for text in cases:
        ids = encoder.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == want.encode_ordinary(text)
        assert "".join(decoder.stream(ids)) == text


def test_bpe_bounded_store(encoder, monkeypatch):
    want = [encoder.encode(w) for w in ("strange", "words", "here")]
    monkeypatch.setattr(bpe, "MAX_STATES", 3)
    monkeypatch.setattr(bpe, "MAX_CACHED", 1)
    assert [encoder.encode(w) for w in ("strange", "words", "here")] == want


def test_utf8_stream():
    data = "aé日😀z".encode()
    for step in (1, 2, 3):
        s = bpe.Utf8Stream()
        assert "".join(s.feed(data[i : i + step]) for i in range(0, len(data), step)) + s.close() == "aé日😀z"
    s = bpe.Utf8Stream()
    assert s.feed(b"a\xff\xc3") + s.close() == "a\ufffd\ufffd"


def test_bpe_queries(spark, odd, none):
    rows = bpe.decode(bpe.encode(odd)).collect()
    assert sorted(r.text for r in rows) == sorted(t or "" for _, t in ODD)
    assert bpe.round_trip(none).count() == 0


def test_toxicity(spark, docs, odd, none):
    abuse = "stupid idiot moron trash clown loser".split()
    rng = random.Random(2)
    words = [f"{a}{b}" for a in "lo mi ta ren sul vor kip dan".split() for b in "ba ne ti zor lum pad".split()]
    rows = []
    for i in range(600):
        w = [rng.choice(words) for _ in range(40)]
        toxic = i % 4 == 0
        if toxic:
            for at in rng.sample(range(40), 3):
                w[at] = rng.choice(abuse)
        rows.append((i, " ".join(w), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = toxicity.fit(df.select("doc_id", "text"), df.where("doc_id < 400").select("doc_id", "label"))
    assert set(abuse) <= {t for t, *_ in model.terms}
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    assert all((got[i] >= 0.7) == bool(y) for i, _, y in rows if i >= 400)
    scanner = toxicity.Scanner(model.terms)
    assert scanner["stupdi"] and scanner["stupiid"] and scanner["stpid"] and scanner["idiot"][1] == 0
    assert not scanner["lorba"] and not scanner["study"]
    plain, quoted = (toxicity._sums(model, scanner.hits(t)) for t in ("a moron and an idiot here", 'they said "a moron and an idiot here" once'))
    assert plain[0] > 0 and quoted[0] == 0 and quoted[1] < plain[0]
    assert toxicity.score(odd, model).count() == len(ODD) and toxicity.score(none, model).count() == 0
    assert toxicity.fit(df, df.select("doc_id", "label").limit(0)).terms == []
    assert toxicity.keep_clean(odd, model).columns == odd.columns


def test_toxicity_beside_a_long_family(spark):
    """Copies of one long toxic text do not crowd out words of other texts."""
    rng = random.Random(3)
    name = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    long, common = " ".join(name() for _ in range(1500)), [name() for _ in range(60)]
    rows = [(i, long, 1) for i in range(100)]
    for i in range(100, 400):
        w = [rng.choice(common) for _ in range(20)]
        rows.append((i, " ".join([*w, rng.choice(["scumbag", "halfwit"])] if i % 2 else w), i % 2))
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "label"))
    assert {"scumbag", "halfwit"} <= {t for t, *_ in model.terms} | {w for w in ("scumbag", "halfwit") for t, s, _ in model.terms if s and w.startswith(t)}
    assert toxicity.Scanner([("scum", True, 0)])["scum" + "x" * 60]


def test_automaton_against_edit_distance():
    def distance(a, b):  # with swaps of neighbours
        d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    rng = random.Random(9)
    terms = [("".join(rng.choice("abc") for _ in range(n)), False, e) for n, e in ((3, 0), (4, 1), (5, 1), (6, 2), (7, 2))]
    auto = toxicity.Automaton(terms)
    for _ in range(3000):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
        found = auto.match(word)
        near = [distance(t, word) for t, _, e in terms if distance(t, word) <= e]
        assert (found is not None) == bool(near)
        if near:
            assert found[1] == min(near)


def test_quality(spark, docs, odd, none):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    whole = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = crc_bucket(F.col("doc_id"), 5) == 0
    model = quality.fit(whole, labels.where(~held).select("doc_id", F.col("quality").alias("label")))
    rows = quality.score(whole, model).join(labels.where(held), "doc_id").collect()
    assert np.mean([(r.score >= 0.3) == bool(r.quality) for r in rows]) > 0.95
    got = quality.score(odd, model).collect()
    assert len(got) == len(ODD) and all(r.score == 0 for r in got if r.doc_id in (1, 2, 3))
    assert quality.score(none, model).count() == 0 and quality.keep_good(odd, model).columns == odd.columns


def test_marginals_against_enumeration():
    from itertools import product

    rng = np.random.default_rng(5)
    m = quality.QualityModel(weights=rng.normal(size=quality.WIDTH + 1) * 0.3, transitions=rng.normal(size=(2, 2)))
    lines = ["One two three.", "A | B | C", "x x x x", "GO GO!!"]
    u = (quality.with_neighbours(quality.line_features(lines)) @ m.weights[:-1]) + m.weights[-1]
    total, good = 0.0, np.zeros(4)
    for y in product((0, 1), repeat=4):
        p = np.exp(sum(u[i] for i in range(4) if y[i]) + sum(m.transitions[a, b] for a, b in zip(y, y[1:])))
        total, good = total + p, good + p * np.array(y)
    assert np.allclose(m.good(lines), good / total)


def test_licenses(spark, docs, odd, none):
    text = licenses.TEMPLATES["MIT"].replace("charge", "CHARGE cost").replace("without limitation ", "")
    df = spark.createDataFrame([(1, f"intro words {text} the end"), (2, "permission is hereby"), (3, "a b c Released under the MIT License. d e")], "doc_id long, text string")
    rows = licenses.scan_licenses(df).collect()
    assert [(r.doc_id, r.license) for r in rows] == [(1, "MIT"), (3, "MIT-line")] and rows[0].coverage > 0.95
    assert "a b c Released under the MIT License. d e"[rows[1].start_char : rows[1].end_char] == "Released under the MIT License"
    found = {(r.doc_id, r.start_char) for r in licenses.scan_licenses(docs).where("license = 'Apache-2.0-line'").collect()}
    assert found == {(i, m.start()) for i, t in texts(docs).items() for m in re.finditer("Licensed under the Apache License, Version 2.0", t)}
    assert licenses.scan_licenses(odd).count() == 0 and licenses.scan_licenses(none).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(700, 16))
    v[100:160] = v[100]  # copies
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(701, None), (702, [0.0] * 16), (703, [float("nan")] * 16), (704, [1.0, 2.0]), (5, v[5].tolist())]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    hit = 0
    for q in range(0, 700, 100):
        d = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
        want = [i for i in np.lexsort((np.arange(700), d)) if i != q][:10]
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 11))
        assert np.allclose([r.score for r in own], [d[r.vec_id] for r in own])
        hit += len({r.vec_id for r in own} & set(want))
        if q == 100:
            assert [r.vec_id for r in own] == want
    assert hit / 70 >= 0.9
    assert ann.nearest(spark.createDataFrame(rows[:0], "vec_id long, embedding array<double>")).count() == 0


def slow_fingerprint(text, k=9, functions=32):
    """Order MinHash on plain Python integers."""
    m64, (base, other) = (1 << 64) - 1, order_minhash.LANES

    def mix(x):
        for _ in range(2):
            x = (x ^ (x >> 32)) * 0xD6E8FEB86659FD93 & m64
        return x ^ (x >> 32)

    size = min(k, len(text))
    kmers = [mix(sum((ord(c) + 1) * pow(base, j, 1 << 64) for j, c in enumerate(text[i : i + size])) + size & m64) for i in range(len(text) - size + 1)] if text else [0]
    seen, numbered = {}, []
    for x in kmers:
        key = x >> 24
        numbered.append(mix((key + seen.get(key, 0) * other) & m64))
        seen[key] = seen.get(key, 0) + 1
    out = []
    for j in range(functions):
        least = sorted((((x >> 32) * int(order_minhash._MULT[j])) & 0xFFFFFFFF, i) for i, x in enumerate(numbered))[:2]
        h = 0
        for i in sorted(i for _, i in least):
            h = mix((h * base + numbered[i]) & m64)
        out.append(h >> 32)
    return np.array(out, "<u4").tobytes().hex()


def test_order_minhash_of_hot_ids(spark):
    rows = [(None, f"row {i} " * 3) for i in range(60)] + [(i, f"text {i}") for i in range(30)] + [(7, "same")] * 25
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = order_minhash.compare_edits(df).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_chars) for r in got) == sorted((i is not None, i or 0, len(t)) for i, t in rows)
    own = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id > 7}
    for i in range(8, 29):
        assert own[i].edited_sha256 == hashlib.sha256(order_minhash.edited(f"text {i}", f"text {i + 1}").encode()).hexdigest()


def test_order_minhash(spark, docs, odd, none):
    rows = {r.doc_id: r for r in order_minhash.compare_edits(docs).collect()}
    own = sorted(texts(docs).items())
    for n, (i, t) in enumerate(own):
        want = order_minhash.edited(t, own[(n + 1) % len(own)][1])
        assert rows[i].edited_sha256 == hashlib.sha256(want.encode()).hexdigest() and rows[i].n_chars == len(t)
        if n % 10 == 0 and len(t) < 3000:
            assert rows[i].fingerprint == slow_fingerprint(t) and rows[i].edited_fingerprint == slow_fingerprint(want)
    for t in ("", "a", "12345678", "123456789", "aaaaaaaaaaaaaaaaaa", "日本語" * 20):
        assert order_minhash.fingerprint(t).tobytes().hex() == slow_fingerprint(t)
    sixty, cut_ = "ten chars! nine char eight ch seven c six ch five four th tw", "ten chars! nine char eight ch seven c six ch fi"
    assert order_minhash.likeness(order_minhash.fingerprint(sixty), order_minhash.fingerprint(cut_)) > 0.3
    long = [r for r in rows.values() if r.n_chars > 200]
    assert np.mean([r.near_edited > r.near_next for r in long]) > 0.95
    a, b = "the quick brown fox jumps over the lazy dog " * 5, "lazy dog the quick brown fox jumps over the " * 5
    assert order_minhash.likeness(order_minhash.fingerprint(a), order_minhash.fingerprint(a)) == 1
    assert order_minhash.likeness(order_minhash.fingerprint(a), order_minhash.fingerprint(b)) < 1
    assert order_minhash.compare_edits(odd).count() == len(ODD)
    assert order_minhash.compare_edits(none).count() == 0
    assert order_minhash.fingerprints(odd).count() == len(ODD)


def test_urls(spark):
    con = connect(SF)
    missing, extra, cols, names = differences(queries.queries()["op10_url_filter"](spark, SF), queries.oracle_sql()["op10_url_filter"], con)
    assert cols == names and not missing and not extra
    pages = spark.createDataFrame([(1, "http://A.example.COM/en/7x?q"), (2, None), (3, "no scheme"), (4, "x://h"), (5, "a://b.net/de/8#t"), (None, "a://b.example.net/de/8"), (7, "q://bad.io/x")], "page_id long, url string")
    outcomes = spark.createDataFrame([(7, True)] * 200 + [(None, True), (4, None), (4, False)], "page_id long, bad boolean")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, outcomes).collect()}
    assert got[1] == ("a.example.com", "/en/7x", "example.com/en/7", "allow") and got[2][:3] == ("", "", None) and got[3][:2] == ("", "")
    assert got[4][:2] == ("h", "") and got[5] == ("b.net", "/de/8", "net/de/", "allow") and got[None][2:] == ("example.net/de/8", "block") and got[7][3] == "block"
    assert url_filter.judge_urls(pages.limit(0), outcomes).count() == 0


@pytest.mark.parametrize("shape", ["paths", "cycles", "stars", "random", "ties"])
def test_components(spark, monkeypatch, shape):
    rng = random.Random(shape)
    links = {
        "paths": [(i, i + 1) for i in range(120)] + [(i + 1, i) for i in range(500, 560)],
        "cycles": [(i, (i + 1) % 40) for i in range(40)] + [(100, 100), (101, None)],
        "stars": [(900, i) for i in range(80)] + [(901, i) for i in range(60, 140)],
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(220)],
        "ties": [(1, 2), (2, 1), (1, 2), (3, 4)],
    }[shape]
    rng.shuffle(links)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    monkeypatch.setattr(components, "CHUNK", 7)
    got = components.components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()
    assert sorted((r.node, r.component) for r in got) == sorted((x, find(x)) for x in root)
