"""URL filtering: explicit rules first, else an empirical-Bayes reputation.

Labelled page outcomes (bad or not) are counted per host. A host with few
labels borrows from its registered domain, that from its suffix, that from all
labels: at each level the rate of the level above is the mean of a beta prior
whose strength is the beta-binomial moment estimate over that level's groups.
A page is blocked if the lower end of its host's posterior lies above a limit.

Only DataFrame functions; the counts are aggregated before they are shuffled.
Pages meet one row per host and hosts one row per domain, the large ones of both
by broadcast, so that no host of a third of the pages fills a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, join_by_size, prepare

#: (action, host, path): the host itself and its subdomains, paths that start so.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Suffixes of several labels under which names are registered; others have
#: one label. A short list for want of the public one, which ``read_suffixes``
#: takes from a file.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "ne.jp", "or.jp", "org.uk")
#: Posterior standard deviations below the mean, and the bad rate to exceed.
Z = 2.0
LIMIT = 0.5
#: Bounds of a prior's strength in pseudo-labels.
STRENGTH = (1.0, 10_000.0)


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end."""
    return _lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def read_suffixes(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Suffixes of two labels and more from a text file of one suffix a line;
    lines that are empty or start with ``//``, ``!`` or ``*`` are left out. A
    list of some ten thousand names: it stays in the plan."""
    line = F.trim("value")
    rows = spark.read.text(path).where(line.contains(".") & ~line.rlike(r"^(//|!|\*)")).select(_lower(line).alias("suffix")).distinct().collect()
    return tuple(sorted(r.suffix for r in rows))


def suffix_of(host: Column, suffixes=TWO_LABEL_SUFFIXES) -> Column:
    """The longest of ``suffixes`` that ends the host at a dot, else its last label."""
    labels, found = F.split(host, r"\."), F.element_at(F.split(host, r"\."), -1)
    for n in sorted({s.count(".") + 1 for s in suffixes}):
        last = F.when(F.size(labels) >= n, F.concat_ws(".", F.slice(labels, F.greatest(F.lit(1), F.size(labels) - n + 1), n)))
        found = F.when(last.isin(*[s for s in suffixes if s.count(".") + 1 == n]), last).otherwise(found)
    return found


def domain_of(host: Column, suffixes=TWO_LABEL_SUFFIXES) -> Column:
    """The registered domain: the suffix and one label before it."""
    labels, n = F.split(host, r"\."), F.size(F.split(suffix_of(host, suffixes), r"\.")) + 1
    return F.concat_ws(".", F.slice(labels, F.greatest(F.lit(1), F.size(labels) - n + 1), n))


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule, action) of the longest fitting rule, nulls where none fits."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, at, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        rule, action = F.when(fits, at + start).otherwise(rule), F.when(fits, act).otherwise(action)
    return rule, action


def _strength(groups: DataFrame, n: str, bad: str) -> DataFrame:
    """One row with the prior strength from the spread of the groups' rates:
    intra-class correlation by moments, kappa = (1 - rho) / rho."""
    lo, hi = STRENGTH
    total = groups.agg(F.count(F.lit(1)).alias("k"), F.sum(n).alias("n"), F.sum(bad).alias("bad"), F.sum(F.col(n) * F.col(n)).alias("nn"), F.sum(F.col(bad) * F.col(bad) / F.col(n)).alias("bb"))
    p = F.col("bad") / F.col("n")
    spread = F.col("bb") - F.col("bad") * p  # sum of n_i (p_i - p)^2
    rho = (F.try_divide(spread, p * (1 - p)) - (F.col("k") - 1)) / F.nullif(F.col("n") - F.col("nn") / F.col("n") - (F.col("k") - 1), F.lit(0.0))
    kappa = F.when(rho <= 1 / (1 + hi), F.lit(hi)).when(rho >= 1 / (1 + lo), F.lit(lo)).otherwise((1 - rho) / rho)
    return total.select(F.coalesce(kappa, F.lit(hi)).alias("kappa"), p.alias("rate"))


def reputation(outcomes: DataFrame, *, suffixes=TWO_LABEL_SUFFIXES) -> DataFrame:
    """``outcomes(host, n, bad)``: counts of labelled and of bad pages per host
    -> (host, host_rate, host_low): posterior mean and lower bound. Hosts
    without labels (n = 0) take their domain's, suffix's or overall rate."""
    hosts = outcomes.select("host", domain_of(F.col("host"), suffixes).alias("domain"), suffix_of(F.col("host"), suffixes).alias("suffix"), F.col("n").cast("double").alias("n"), F.col("bad").cast("double").alias("bad"))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("n_hosts"))
    tops = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    # three pairs of numbers, whatever the data's size
    prior = [_strength(x.where("n > 0"), "n", "bad").first() for x in (tops, domains, hosts)]
    overall = prior[0]["rate"]
    if overall is None:
        overall = 0.0
    ks, kd, kh = (F.lit(float(p["kappa"])) for p in prior)
    total_domains, total_hosts = domains.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_hosts"), F.lit(0))).first()
    tops = domains.groupBy("suffix").agg(F.count(F.lit(1)).alias("n_domains")).join(tops, "suffix")
    tops = tops.select("suffix", "n_domains", ((F.lit(float(overall)) * ks + F.col("bad")) / (ks + F.col("n"))).alias("suffix_rate"))
    domains = join_by_size(domains, tops, ["suffix"], "n_domains", total_domains).select("domain", "n_hosts", ((F.col("suffix_rate") * kd + F.col("bad")) / (kd + F.col("n"))).alias("domain_rate"))
    domains = cut(domains)  # read for the large ones and for the rest
    a = F.col("domain_rate") * kh + F.col("bad")
    total = kh + F.col("n")
    mean = a / total
    low = mean - Z * F.sqrt(mean * (1 - mean) / (total + 1))
    return join_by_size(hosts, domains, ["domain"], "n_hosts", total_hosts).select("host", mean.alias("host_rate"), low.alias("host_low"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, *, rules=RULES, suffixes=TWO_LABEL_SUFFIXES, limit: float = LIMIT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, host_rate, host_low.

    ``outcomes(page_id, bad)`` labels pages with a boolean; rows with a null or
    an unknown page count for nothing, several labels of one page count each.
    The verdict is the longest fitting rule's action, else ``block`` if the
    host's lower bound exceeds ``limit``, else ``allow``. Null urls and urls
    without ``://`` have an empty host and path, fit no rule and share the
    reputation of the empty host. Of fitting rules of one length the greater
    text wins. Every row gets one verdict, repeated and null ids too; other
    columns are left out; an empty table gives an empty one. ``rules`` is a
    short list kept in the plan.
    """
    prepare(pages.sparkSession)
    seen = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    labels = outcomes.where("bad IS NOT NULL AND page_id IS NOT NULL").groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))
    marked = seen.join(labels, "page_id", "left")
    counts = marked.groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.count(F.lit(1)).alias("n_pages"))
    counts = cut(counts)  # one row per host, read several times below
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    bound = cut(reputation(counts, suffixes=suffixes).join(counts.select("host", "n_pages"), "host"))
    total = counts.agg(F.coalesce(F.sum("n_pages"), F.lit(0))).first()[0]
    method = F.when(F.col("host_low") > limit, "block").otherwise("allow")
    return join_by_size(seen, bound, ["host"], "n_pages", total, how="left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(action, method).alias("verdict"), "host_rate", "host_low")
