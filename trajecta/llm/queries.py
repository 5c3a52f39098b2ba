"""Registered queries of this subpackage: ``opN_<name>(spark, sf_dir)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, quality, toxicity
from .ann import nearest
from .common import crc_bucket, prepare
from .divergence import audit
from .histogram_packing import pack_by_histogram
from .lexical_search import search
from .licenses import scan_licenses
from .near_dedup import near_duplicates
from .order_minhash import compare_edits
from .packing import pack_documents
from .substring_dedup import dedup_report
from .url_filter import TWO_LABEL_SUFFIXES, judge_urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _scored(spark, sf_dir, operator, label: str, folds: int, held: int, threshold: float) -> DataFrame:
    """Fit on labelled rows outside the held-out fold, score every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = crc_bucket(F.col("doc_id"), folds)
    model = operator.fit(docs, labels.where(fold != held).select("doc_id", F.col(label).alias("label")))
    return operator.score(docs, model).withColumn("held_out", fold == held).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, toxicity, "toxic", 3, 1, 0.7)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, quality, "quality", 5, 0, 0.3)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_report(table(spark, sf_dir, "documents"), window=20)


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, threshold=80)


def op6_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.round_trip(table(spark, sf_dir, "documents"))
    n = (F.octet_length("ids") / 4).cast("long")
    return coded.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    return found.withColumn("spans", F.to_json("spans"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edits(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are read as page outcomes: bad where of low quality or toxic."""
    labels = table(spark, sf_dir, "labels")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    judged = judge_urls(table(spark, sf_dir, "pages"), outcomes)
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("host_rate", 6).alias("host_rate"), F.round("host_low", 6).alias("host_low"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), top=50)


def op13_histogram_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_by_histogram(table(spark, sf_dir, "documents"))


_TWO = ", ".join(f"'{x}'" for x in TWO_LABEL_SUFFIXES)


def _strength_sql(level: str) -> str:
    return f"""SELECT CASE WHEN rho <= 1 / 10001.0 THEN 10000.0 WHEN rho >= 0.5 THEN 1.0 ELSE coalesce((1 - rho) / rho, 10000.0) END AS kappa, p FROM (
      SELECT p, ((bb - bad * p) / nullif(p * (1 - p), 0) - (k - 1)) / nullif(n - nn / n - (k - 1), 0) AS rho FROM (
        SELECT count(*) AS k, sum(n) AS n, sum(bad) AS bad, sum(n * n) AS nn, sum(bad * bad / n) AS bb, sum(bad) / sum(n) AS p FROM {level} WHERE n > 0))"""


OP10_SQL = f"""WITH seen AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
lab AS (SELECT doc_id AS page_id, count(*) AS n, sum(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE (quality = 0 OR toxic = 1) IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1),
counts AS (SELECT host, coalesce(sum(n), 0)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad FROM seen LEFT JOIN lab USING (page_id) GROUP BY 1),
split AS (SELECT *, string_split(host, '.') AS p, concat_ws('.', string_split(host, '.')[-2], string_split(host, '.')[-1]) AS two FROM counts),
suf AS (SELECT *, CASE WHEN two IN ({_TWO}) THEN two ELSE p[-1] END AS suffix, CASE WHEN two IN ({_TWO}) THEN 3 ELSE 2 END AS w FROM split),
hosts AS (SELECT host, suffix, array_to_string(p[greatest(1, len(p) - w + 1):len(p)], '.') AS domain, n, bad FROM suf),
domains AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY 1, 2),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY 1),
ks AS ({_strength_sql("suffixes")}), kd AS ({_strength_sql("domains")}), kh AS ({_strength_sql("hosts")}),
sr AS (SELECT suffix, (coalesce(ks.p, 0.0) * ks.kappa + bad) / (ks.kappa + n) AS r FROM suffixes, ks),
dr AS (SELECT domain, (sr.r * kd.kappa + d.bad) / (kd.kappa + d.n) AS r FROM domains d JOIN sr USING (suffix), kd),
rep AS (SELECT host, (dr.r * kh.kappa + h.bad) / (kh.kappa + h.n) AS m, kh.kappa + h.n AS t FROM hosts h JOIN dr USING (domain), kh),
low AS (SELECT host, m, m - 2.0 * sqrt(m * (1 - m) / (t + 1)) AS l FROM rep),
ruled AS (SELECT *, CASE
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
  WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
  WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/en/') THEN 'com/en/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/de/') THEN 'net/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/es/') THEN 'org/es/' END AS rule FROM seen)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN l > 0.5 THEN 'block' ELSE 'allow' END AS verdict,
       round(m, 6) AS host_rate, round(l, 6) AS host_low FROM ruled JOIN low USING (host)"""


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_P = "1 + (1000000000 * ({} + 1)) // ({} + v)"

OP11_SQL = rf"""WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
words AS (SELECT d, lang, source, unnest(words) AS term FROM docs),
lt AS (SELECT lang, term, count(*) AS many FROM words GROUP BY 1, 2 HAVING count(DISTINCT d) >= 3),
ls AS (SELECT lang, count(*) AS v, sum(many)::BIGINT AS total FROM lt GROUP BY 1),
gt AS (SELECT lang, source, term, count(*) AS many FROM words JOIN (SELECT lang, term FROM lt) USING (lang, term) GROUP BY 1, 2, 3),
gs AS (SELECT lang, source, coalesce(sum(many), 0)::BIGINT AS n FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN gt USING (lang, source) GROUP BY 1, 2),
dense AS (SELECT lang, source, term, coalesce(gt.many, 0) AS many, {_P.format("coalesce(gt.many, 0)", "n")} AS p, {_P.format("lt.many", "total")} AS q
  FROM gs JOIN lt USING (lang) JOIN ls USING (lang) LEFT JOIN gt USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value FROM dense a JOIN dense b USING (lang, term) WHERE a.source <> b.source GROUP BY 1, 2, 3),
every AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM gs a JOIN gs b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM dense WHERE many > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM every
UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM terms
  QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= 200"""

OP12_SQL = rf"""WITH words AS (
  SELECT d, doc_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT *, row_number() OVER () AS d FROM documents)),
tf AS (SELECT d, doc_id, term, count(*) AS tf FROM words GROUP BY 1, 2, 3),
lengths AS (SELECT d, sum(tf)::BIGINT AS n FROM tf GROUP BY 1),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths),
asked AS (SELECT DISTINCT i, item_id, term FROM (SELECT i, item_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT *, row_number() OVER () AS i FROM benchmark))),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, whole GROUP BY term, docs),
scored AS (SELECT i, item_id, d, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN lengths USING (d), whole GROUP BY 1, 2, 3, 4)
SELECT item_id, (row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0
  QUALIFY row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) <= 50"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_toxicity, op2_best_fit_packing, op3_quality_classifier, op4_substring_dedup, op5_minhash_near_dedup, op6_byte_level_bpe, op7_license_scan, op8_nearest_neighbours, op9_order_minhash, op10_url_filter, op11_source_divergence, op12_lexical_search, op13_histogram_packing)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """The other operators learn, iterate or tokenise beyond SQL; their tests
    hold them against brute force, round trips and held-out rows."""
    return {"op10_url_filter": OP10_SQL, "op11_source_divergence": OP11_SQL, "op12_lexical_search": OP12_SQL}
