"""The pipeline's stages, each against a plain version on the rows it got."""

import hashlib
import zlib

import numpy as np
import pytest

import corpus_pipeline
from trajecta.llm import queries

from .test_operators import ODD, SF, WORD, brute_groups, docs, none, odd, texts  # noqa: F401


@pytest.fixture(scope="module")
def steps(spark, docs, tmp_path_factory):  # noqa: F811
    """The input and the output of every stage, by its name."""
    base, out, before = tmp_path_factory.mktemp("steps"), {}, docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(base / str(i))
        stage(spark, before, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out[name], before = (before, after), after
    return out


@pytest.mark.parametrize(("stage", "query", "label", "bad"), [(corpus_pipeline.classify_quality, "op3_quality_classifier", "quality", 0), (corpus_pipeline.drop_toxic, "op1_toxicity", "toxic", 1)])
def test_classifiers_drop_what_they_reject(spark, stage, query, label, bad):
    """On sf0.01: sf0.001 has some six toxic texts to learn from, of which no
    term is sure enough."""
    sf = "/root/testdata/sf0.01"
    before = spark.read.parquet(f"{sf}/documents.parquet")
    after = stage(spark, before, sf)
    assert after.columns == before.columns
    left = {r.doc_id for r in after.select("doc_id").collect()}
    gone = {r.doc_id for r in before.select("doc_id").collect()} - left
    assert gone == {r.doc_id for r in queries.queries()[query](spark, sf).select("doc_id", "predicted").collect() if r.predicted == bad}
    known = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    right = [known[i] == bad for i in gone if i in known]
    assert len(right) > 10 and sum(right) > 0.8 * len(right)


def test_one_of_each_group_stays(steps):
    before, after = steps["near-dedup"]
    groups = brute_groups(texts(before), 5, 80)
    assert sorted(r.doc_id for r in after.collect()) == sorted(i for i, (_, c) in groups.items() if i == c)
    assert {tuple(r) for r in after.collect()} <= {tuple(r) for r in before.collect()}


def test_repeated_windows_go(steps):
    before, after = steps["substring dedup"]
    seen, want = set(), {}
    for i, t in sorted(texts(before).items()):
        w = WORD.findall(t)
        cover = [False] * len(w)
        for j in range(len(w) - 19):
            key = tuple(w[j : j + 20])
            if key in seen:
                cover[j : j + 20] = [True] * 20
            seen.add(key)
        want[i] = [x for x, c in zip(w, cover, strict=True) if not c]
    assert {r.doc_id: WORD.findall(r.text or "") for r in after.collect()} == want


def test_packing_holds_every_id_and_run_equals_the_stages(spark, steps):
    import public_tokenizers
    from tokenizers import Tokenizer

    before, after = steps["packing"]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got, places = {}, {}
    for r in after.collect():
        got.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got.keys() == {r.doc_id for r in before.collect()}
    for i, text in texts(before).items():
        ids, at = np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4"), 0
        for start, n, crc in sorted(got[i]):
            assert start == at and zlib.crc32(ids[start : start + n].tobytes()) == crc
            at += n
        assert at == len(ids)
    for parts in places.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1].tolist()] and ends[-1] <= 2048
    # which texts share a sequence may differ; what is in them may not
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    digest = [hashlib.sha256(repr(sorted(tuple(r) for r in df.select(*columns).collect())).encode()).hexdigest() for df in (after, corpus_pipeline.run(spark, SF))]
    assert digest[0] == digest[1]


def test_stages_on_odd_and_empty_tables(spark, odd, none):  # noqa: F811
    """Nulls, empty texts, repeated rows and clashing columns: columns stay;
    an empty table stays empty."""
    for name, stage in corpus_pipeline.STAGES[2:]:
        last = name == "packing"
        out = stage(spark, odd, SF)
        assert last or out.columns == odd.columns
        assert out.count() >= len(ODD), name
        assert stage(spark, none, SF).count() == 0, name
