"""Licence scan against unbanded alignment, and its edge cases."""

import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trajecta.llm import licenses

COMMON = "/usr/share/common-licenses"


def common_words(a, b):
    """Longest common subsequence, unbanded, by plain dynamic programming."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def words(text):
    batch = licenses._words(pa.array([text]))
    return batch.words().tolist()


def edited(rng, template):
    """The template with runs of foreign words put in and runs left out, at
    least 12 words apart."""
    w, out, at = template.split(), [], 0
    while at < len(w):
        keep = rng.randint(12, 40)
        out += w[at : at + keep]
        at += keep
        if at < len(w) - 12:
            if rng.random() < 0.5:
                out += [f"foreign{rng.randint(0, 999)}" for _ in range(rng.randint(1, 60))]
            else:
                at += rng.randint(1, 8)
    return " ".join(out)


def test_against_unbanded_alignment(spark):
    rng = random.Random(7)
    names = ["MIT", "Apache-2.0-notice", "GPL-3.0-notice", "BSD-2-Clause", "BSD-disclaimer", "Unlicense"]
    rows = [(i, names[i % len(names)], edited(rng, licenses.TEMPLATES[names[i % len(names)]])) for i in range(60)]
    df = spark.createDataFrame([(i, f"before it {t} after it") for i, _, t in rows], "doc_id long, text string")
    for name in names:
        own = [r for r in rows if r[1] == name]
        got = {r.doc_id: r for r in licenses.scan_licenses(df, templates={name: licenses.TEMPLATES[name]}).collect()}
        for i, _, text in own:
            want = common_words(words(licenses.TEMPLATES[name]), words(text))
            assert got[i].n_matched == want, (name, i)
            assert got[i].whole == (want >= 0.8 * len(words(licenses.TEMPLATES[name])))
            assert all(a.end_word <= b.start_word for a, b in zip(got[i].spans, got[i].spans[1:]))


def test_words_put_into_the_middle(spark):
    w = licenses.TEMPLATES["MIT"].split()
    text = "Vörwort " + " ".join(w[:80]) + " " + " ".join(["fremd"] * 30) + " " + " ".join(w[80:]) + " end"
    (row,) = licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert row.license == "MIT" and row.coverage == 1 and row.whole and len(row.spans) == 2
    assert text[row.spans[0].start_char : row.spans[0].end_char].startswith("Permission is hereby") and "fremd" not in text[row.spans[1].start_char : row.spans[1].end_char]
    half = " ".join(w[:80])
    (row,) = licenses.scan_licenses(spark.createDataFrame([(1, half)], "doc_id long, text string")).collect()
    assert row.license == "MIT" and not row.whole and row.n_matched == len(words(half))


def test_repeats_ties_and_long_texts(spark):
    line = "Released under the MIT License. "
    rows = [(1, line * 3), (None, line), (None, line), (2, "plain words " * 200_000 + line), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("license", "coverage", "spans", "_pos")})
    got = licenses.scan_licenses(df).collect()
    assert sorted((r.doc_id or 0, r.start_word) for r in got) == [(0, 0), (0, 0), (1, 0), (1, 5), (1, 10), (2, 400_000)]
    assert all(r.license == "MIT-line" and r.coverage == 1 for r in got)
    same = {"b": "one two three four five six", "a": "one two three four five six"}
    (row,) = licenses.scan_licenses(spark.createDataFrame([(1, "one two three four five six")], "doc_id long, text string"), templates=same).collect()
    assert row.license == "b"
    assert licenses.scan_licenses(df, templates={}).count() == 0 and licenses.scan_licenses(df.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(COMMON), reason="no folder of full licence texts on this machine")
def test_full_texts_from_a_folder(spark, tmp_path):
    for name in ("Apache-2.0", "GPL-3", "MPL-2.0"):
        with open(f"{COMMON}/{name}", encoding="utf-8") as f:
            (tmp_path / name).write_text(f.read(), encoding="utf-8")
    templates = licenses.read_templates(spark, str(tmp_path))
    assert list(templates) == ["Apache-2.0", "GPL-3", "MPL-2.0"]
    w = templates["GPL-3"].split()
    cut = " ".join(w[:2000] + ["note"] * 500 + w[2000:4000] + w[4300:])
    df = spark.createDataFrame([(1, "a file " + templates["Apache-2.0"]), (2, cut), (3, "no licence at all")], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(df, templates=templates).collect()}
    assert set(got) == {1, 2} and got[1].license == "Apache-2.0" and got[1].coverage == 1
    assert got[2].license == "GPL-3" and 0.9 < got[2].coverage < 1 and got[2].whole and len(got[2].spans) >= 2
