"""URL filter: shrinkage by brute force, suffixes, ties, large hosts."""

import math
import random

import pytest
from pyspark.sql import functions as F

from trajecta.llm import common, url_filter


def strength(groups):
    """Prior strength of (n, bad) groups and their overall rate."""
    groups = [g for g in groups if g[0]]
    n, bad = sum(g[0] for g in groups), sum(g[1] for g in groups)
    if not n:
        return url_filter.STRENGTH[1], 0.0
    p, k, lo, hi = bad / n, len(groups), *url_filter.STRENGTH
    below = n - sum(g[0] ** 2 for g in groups) / n - (k - 1)
    if p in (0, 1) or not below:
        return hi, p
    rho = (sum(m * (b / m - p) ** 2 for m, b in groups) / (p * (1 - p)) - (k - 1)) / below
    return (hi if rho <= 1 / (1 + hi) else lo if rho >= 1 / (1 + lo) else (1 - rho) / rho), p


def brute(hosts):
    """host -> (n, bad) as host -> (mean, lower bound)."""
    def parts(h):
        w = h.split(".")
        two = ".".join(w[-2:])
        s = two if two in url_filter.TWO_LABEL_SUFFIXES else w[-1]
        return s, ".".join(w[-s.count(".") - 2 :])

    doms, sufs = {}, {}
    for h, (n, b) in hosts.items():
        s, d = parts(h)
        x = doms.get((s, d), (0, 0))
        doms[s, d] = (x[0] + n, x[1] + b)
    for (s, _), (n, b) in doms.items():
        x = sufs.get(s, (0, 0))
        sufs[s] = (x[0] + n, x[1] + b)
    (ks, rate), (kd, _), (kh, _) = strength(list(sufs.values())), strength(list(doms.values())), strength(list(hosts.values()))
    out = {}
    for h, (n, b) in hosts.items():
        s, d = parts(h)
        top = (rate * ks + sufs[s][1]) / (ks + sufs[s][0])
        mid = (top * kd + doms[s, d][1]) / (kd + doms[s, d][0])
        mean = (mid * kh + b) / (kh + n)
        out[h] = (mean, mean - 2 * math.sqrt(mean * (1 - mean) / (kh + n + 1)))
    return out


@pytest.mark.parametrize("hot", [common.HOT_KEYS, 10**9])
def test_shrinkage(spark, monkeypatch, hot):
    rng = random.Random(hot)
    names = [f"{a}{d}.{s}" for s in ("co.uk", "com", "de", "co.jp") for d in ("alpha", "beta", "gamma") for a in ("", "www.", "x.y.")]
    pages, outcomes, want = [], [], {}
    for i, h in enumerate(names):
        n = 1500 if i == 4 else rng.randint(1, 20)
        rate = rng.random()
        want[h] = [0, 0]
        for j in range(n):
            pages.append((i * 10_000 + j, f"http://{h.upper()}/p{j}"))
            if rng.random() < 0.6:
                bad = rng.random() < rate
                outcomes.append((i * 10_000 + j, bad))
                want[h] = [want[h][0] + 1, want[h][1] + bad]
    monkeypatch.setattr(common, "HOT_KEYS", hot)
    df = spark.createDataFrame(pages, "page_id long, url string")
    rows = url_filter.judge_urls(df, spark.createDataFrame(outcomes, "page_id long, bad boolean")).collect()
    assert len(rows) == len(pages) and {r.page_id for r in rows} == {p for p, _ in pages}
    low = brute({h: tuple(v) for h, v in want.items()})
    for r in rows:
        assert abs(r.host_rate - low[r.host][0]) < 1e-9 and abs(r.host_low - low[r.host][1]) < 1e-9
        assert r.verdict == ("block" if low[r.host][1] > 0.5 else "allow")


def test_suffixes_ties_and_odd_rows(spark, tmp_path):
    (tmp_path / "list").write_text("// names\n\ncom\nco.uk\nblog.example.org\n*.ck\n!www.ck\n")
    suffixes = url_filter.read_suffixes(spark, str(tmp_path / "list"))
    assert suffixes == ("blog.example.org", "co.uk")
    df = spark.createDataFrame([("a.b.co.uk",), ("co.uk",), ("x.me.blog.example.org",), ("q.example.org",), ("",)], "host string")
    got = [tuple(r) for r in df.select(url_filter.suffix_of(F.col("host"), suffixes), url_filter.domain_of(F.col("host"), suffixes)).collect()]
    assert got == [("co.uk", "b.co.uk"), ("co.uk", "co.uk"), ("blog.example.org", "me.blog.example.org"), ("org", "example.org"), ("", "")]
    pages = spark.createDataFrame([(1, "a://x.org/ab"), (1, "a://x.org/ab"), (None, None), (2, "")], "page_id long, url string").withColumns({c: F.lit("x") for c in ("host", "n", "bad", "n_pages", "rule", "domain")})
    outcomes = spark.createDataFrame([], "page_id long, bad boolean")
    rules = (("block", "org", "/ab"), ("allow", "x.org", "/"))
    got = sorted((r.page_id or 0, r.rule or "", r.verdict) for r in url_filter.judge_urls(pages, outcomes, rules=rules).collect())
    assert got == [(0, "", "allow"), (1, "x.org/", "allow"), (1, "x.org/", "allow"), (2, "", "allow")]
