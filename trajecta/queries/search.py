"""Vocabulary, questions, nearest neighbours, fusion and citations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..adapters import SAMPLES_SQL, samples, table
from ..config import Association
from ..functions import text as tx
from ..functions import vectors as ve
from ..functions import vocabulary as V
from ..operators import linking as ln
from ..operators import retrieval as rt
from ..operators import merging as mg
from ..operators.matching import assign
from ..plans import answers as an


def _color_sql(column: str) -> str:
    whens = " ".join(f"WHEN regexp_matches(lower({column}), '\\b(?:{'|'.join(f)})\\b') THEN '{v}'" for v, f in V.COLOR.items())
    return f"CASE {whens} END"


def h1_color(spark, d):
    p = table(spark, d, "part").withColumn("color", tx.match_vocabulary(F.col("p_name"), V.COLOR))
    return p.groupBy("color").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first"))


H1 = f"SELECT {_color_sql('p_name')} AS color, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1"


def h5_all_colors(spark, d):
    p = table(spark, d, "part").select("p_partkey", tx.find_all(F.col("p_name"), V.COLOR).alias("c"))
    return p.select("p_partkey", F.size("c").alias("n"), F.array_join("c", ",").alias("colors"))


H5 = "SELECT p_partkey, len(c) AS n, array_to_string(c, ',') AS colors FROM (SELECT p_partkey, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(p_name), '\\b(?:{'|'.join(x + '(?:e?s)?' for x in f)})\\b') THEN '{v}' END" for v, f in V.COLOR.items()) + "], lambda x: x IS NOT NULL) AS c FROM part)"


def _cited(spark, d):
    """Answers that cite each user's events, every third with a wrong time."""
    e = table(spark, d, "events").select(F.col("user_id").alias("answer_id"), F.concat(F.lit("obj_"), F.col("user_id").cast("string")).alias("id"), F.date_format("ts", "HH:mm:ss").alias("at"), "event_id")
    wrong = F.when(F.col("event_id") % 3 == 0, F.lit("00:00:00")).otherwise(F.col("at"))
    piece = F.concat(F.lit("Seen ["), "id", F.lit(" @ "), wrong, F.lit("]."))
    text = e.withColumn("p", F.struct("event_id", piece.alias("s"))).groupBy("answer_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["s"]), " ").alias("text"))
    return e, text


def q17_citations(spark, d):
    e, text = _cited(spark, d)
    found = text.select("answer_id", F.posexplode(tx.citations(F.col("text"))).alias("pos", "c")).select("answer_id", "pos", "c.id", "c.at")
    v = rt.validate_citations(found, e.select("answer_id", "id", "at"))
    return v.select("answer_id", "id", F.col("at").alias("cited_at"), "supported")


Q17 = """WITH e AS (SELECT user_id AS answer_id, 'obj_' || user_id AS id, strftime(ts, '%H:%M:%S') AS cited_at, event_id FROM events), c AS (SELECT DISTINCT answer_id, id, CASE WHEN event_id % 3 = 0 THEN '00:00:00' ELSE cited_at END AS cited_at FROM e)
SELECT answer_id, id, cited_at, EXISTS (SELECT 1 FROM e WHERE e.answer_id = c.answer_id AND e.id = c.id AND e.cited_at = c.cited_at) AS supported FROM c"""


def _vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("vector"))


def _hits(spark, d, k):
    v = _vectors(spark, d)
    q = v.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "vector")
    return rt.knn(q, v.select(F.col("vec_id").alias("id"), "vector"), k)


_KNN = """q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 100 = 0),
r AS (SELECT query_id, vec_id AS id, round(1 - list_cosine_similarity(CAST(qv AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 9) AS distance FROM q, embeddings),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM r QUALIFY rank <= 20)"""


def g1_knn(spark, d):
    return _hits(spark, d, 20).select("query_id", "id", "rank", F.round("distance", 6).alias("distance"))


G1 = f"WITH {_KNN} SELECT query_id, id, rank, round(distance, 6) AS distance FROM hits"


def q16_fuse(spark, d):
    """Hits fused with the graph's candidates, the 20 surest of the query's
    own label."""
    v = _vectors(spark, d)
    hits = _hits(spark, d, 20).select("query_id", F.col("id").alias("global_id"), "rank", F.lit(None).cast("string").alias("hit_class"))
    own = v.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "label")
    sure = v.select(F.col("vec_id").alias("global_id"), "label", ((F.col("vec_id") % 10) / 10).alias("confidence"))
    best = Window.partitionBy("label").orderBy(F.desc("confidence"), "global_id")
    sure = sure.withColumn("r", F.row_number().over(best)).where("r <= 20")
    rows = own.join(sure, "label").select("query_id", "global_id", F.col("label").cast("string").alias("class"), "confidence")
    return rt.fuse(hits, rows, constrained=False, keys=("query_id", "global_id")).select("query_id", "global_id", "class", "rank", "score")


Q16 = f"""WITH {_KNN}, sure AS (SELECT * FROM (SELECT vec_id, label, (vec_id % 10) / 10 AS confidence, row_number() OVER (PARTITION BY label ORDER BY vec_id % 10 DESC, vec_id) AS r FROM embeddings) WHERE r <= 20),
rows_ AS (SELECT a.vec_id AS query_id, b.vec_id AS global_id, CAST(b.label AS VARCHAR) AS class, confidence FROM embeddings a JOIN sure b USING (label) WHERE a.vec_id % 100 = 0)
SELECT coalesce(h.query_id, r.query_id) AS query_id, coalesce(h.id, r.global_id) AS global_id, coalesce(r.class, 'unknown') AS class, h.rank,
 round(0.5 * coalesce(61 / (60 + h.rank), 0) + 0.35 * CASE WHEN r.global_id IS NULL THEN 0 ELSE 1 END + 0.15 * coalesce(r.confidence, 0), 6) AS score
FROM hits h FULL JOIN rows_ r ON h.query_id = r.query_id AND h.id = r.global_id"""


def f7_mean_embedding(spark, d):
    """Mean vector per label, normalised."""
    v = _vectors(spark, d).select("label", F.posexplode("vector").alias("i", "x"))
    m = v.groupBy("label", "i").agg(F.avg("x").alias("m"))
    n = F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy("label")))
    return m.withColumn("u", F.col("m") / n).select("label", "i", F.round("u", 6).alias("u"))


F7 = """WITH x AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding) AS x FROM embeddings), m AS (SELECT label, i, avg(x) AS m FROM x GROUP BY 1, 2)
SELECT label, CAST(i AS INTEGER) AS i, u FROM (SELECT label, i, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 6) AS u FROM m)"""


def _fragments(spark, d):
    """Orders as fragments of their customer's trajectory, days as seconds."""
    o = table(spark, d, "orders")
    day = F.expr("timestampdiff(DAY, TIMESTAMP_NTZ'1970-01-01 00:00:00', o_orderdate)").cast("double")
    p, y = F.col("o_totalprice") / 1000.0, F.lit(0.0)
    boxes = {f"{s}_{c}": e for s in ("head", "tail") for c, e in (("x1", p), ("y1", y), ("x2", p + 40), ("y2", y + 30))}
    return o.select(F.col("o_custkey").alias("video_id"), F.lit(0).alias("clip_id"), F.col("o_orderkey").alias("track"), F.col("o_orderpriority").alias("class"), day.alias("t_first"), day.alias("t_last"), F.lit(0.0).alias("exit_vx"), F.lit(0.0).alias("exit_vy"), (F.col("o_orderstatus") == "F").alias("stationary"), F.array(p, F.lit(100.0)).alias("embedding"), *[e.alias(n) for n, e in boxes.items()])


CFG = Association(max_gap=60.0, min_cosine=0.7, max_error=2.5, stationary_iou=0.05)


def e3_gate_join(spark, d):
    p = ln.fragment_pairs(_fragments(spark, d), CFG)
    return p.select(F.col("video_id").alias("custkey"), "a", "b", "gap", F.round("motion_error", 6).alias("motion_error"), F.round("cosine", 6).alias("cosine"), "failed_gate", F.round("score", 6).alias("score"))


E3 = """WITH f AS (SELECT o_custkey AS k, o_orderkey AS track, o_orderpriority AS class, CAST(date_diff('day', DATE '1970-01-01', o_orderdate) AS DOUBLE) AS t, o_totalprice / 1000.0 AS p, o_orderstatus = 'F' AS still FROM orders),
j AS (SELECT a.k, a.track AS a, b.track AS b, b.t - a.t AS gap, a.class = b.class AS same, a.still AND b.still AS still, abs(a.p - b.p) / 50.0 AS error,
  greatest(0.0, least(a.p, b.p) + 40 - greatest(a.p, b.p)) * 30 AS inter, (a.p * b.p + 10000.0) / (sqrt(a.p * a.p + 10000.0) * sqrt(b.p * b.p + 10000.0)) AS cosine FROM f a JOIN f b ON a.k = b.k AND a.track <> b.track AND b.t - a.t > 0 AND b.t - a.t <= 60),
g AS (SELECT *, inter / (2400 - inter) AS iou, CASE WHEN NOT still THEN error END AS motion_error FROM j),
x AS (SELECT *, CASE WHEN NOT same THEN 'class' WHEN CASE WHEN still THEN iou < 0.05 ELSE error > 2.5 END THEN 'motion' WHEN cosine < 0.7 THEN 'appearance' END AS failed_gate FROM g)
SELECT k AS custkey, a, b, gap, round(motion_error, 6) AS motion_error, round(cosine, 6) AS cosine, failed_gate,
 CASE WHEN failed_gate IS NULL THEN round(0.5 * cosine + 0.3 * CASE WHEN still THEN iou ELSE 1 / (1 + error) END + 0.2 * (1 - gap / 60), 6) END AS score FROM x"""


def k4_greedy_links(spark, d):
    p = ln.associate(ln.fragment_pairs(_fragments(spark, d), CFG))
    return p.where("status <> 'rejected'").select(F.col("video_id").alias("custkey"), "a", "b", "status", F.round("score", 6).alias("score"))


def k3_assignment(spark, d):
    """Orders of a customer assigned to their line items' suppliers by value."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    c = o.join(li, o.o_orderkey == li.l_orderkey).groupBy(F.col("o_custkey").alias("scope"), F.col("o_orderkey").alias("a"), F.col("l_suppkey").alias("b")).agg(F.round(F.sum("l_extendedprice") / 1000, 4).alias("score"))
    return assign(c, ["scope"])


def g4_cosine(spark, d):
    """Cosine of each vector to its label's mean."""
    v = _vectors(spark, d)
    m = v.select("label", F.posexplode("vector").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    m = m.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean"))
    return v.join(m, "label").select("vec_id", F.round(ve.cosine(F.col("vector"), F.col("mean")), 6).alias("cosine"))


G4 = """WITH x AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM x GROUP BY 1, 2), a AS (SELECT label, list(x ORDER BY i) AS mean FROM m GROUP BY 1)
SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), mean), 6) AS cosine FROM embeddings JOIN a USING (label)"""



def _pieces(spark, d):
    """Every seven samples of a user are a fragment; fragments are linked where
    the pause between is at most a day."""
    s = samples(spark, d).withColumn("part", F.floor(F.col("pos") / 7)).withColumn("track", F.col("obj") * 1000 + F.col("part")).withColumn("clip_id", F.lit(0))
    t = s.groupBy("obj", "clip_id", "track", "part").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.min_by("class", "pos").alias("class"), F.array(F.avg("x"), F.lit(50.0), F.avg("y")).alias("embedding"))
    gap = F.lead("first").over(Window.partitionBy("obj").orderBy("part")) - F.col("last")
    links = t.withColumn("b", F.when(gap <= 24, F.col("track") + 1)).where("b IS NOT NULL").select("obj", "clip_id", F.col("track").alias("a"), "b")
    crops = s.select("obj", "clip_id", "track", F.format_string("c%08d", "event_id").alias("path"), F.when(F.col("event_id") % 5 != 0, F.round("x")).alias("score"))
    return t, s.select("obj", "clip_id", "track", "pos", "t", "x", "y"), crops, links


SCOPE = ("obj", "clip_id")


def k6_merge_tracks(spark, d):
    """Merged tracks: fragments, path, weighted mean embedding, best crops."""
    rows, _ = mg.merge_tracks(*_pieces(spark, d), scope=SCOPE)
    e = [F.round(F.col("embedding")[i], 6).alias(f"e{i}") for i in range(3)]
    return rows.select("obj", "track", "class", "n_fragments", "n_samples", F.round("heading", 5).alias("heading"), *e, F.array_join(F.transform("crops", lambda c: c["path"]), ",").alias("crops"))


_CHAINS = f"""WITH {SAMPLES_SQL}, s AS (SELECT *, pos // 7 AS part, obj * 1000 + pos // 7 AS piece FROM samples),
f AS (SELECT obj, piece, part, min(t) AS first, max(t) AS last, arg_min(class, pos) AS class, count(*) AS n, avg(x) AS a, avg(y) AS b FROM s GROUP BY 1, 2, 3),
g AS (SELECT *, CASE WHEN first - lag(last) OVER (PARTITION BY obj ORDER BY part) <= 24 THEN 0 ELSE 1 END AS opens FROM f),
c AS (SELECT *, sum(opens) OVER (PARTITION BY obj ORDER BY part) AS chain FROM g),
m AS (SELECT *, min(piece) OVER (PARTITION BY obj, chain) AS track FROM c),
w AS (SELECT s.*, m.track, row_number() OVER (PARTITION BY s.obj, m.track ORDER BY s.part, s.pos) - 1 AS p FROM s JOIN m USING (obj, piece))"""

K6 = _CHAINS + """, u AS (SELECT *, sqrt(a * a + 2500 + b * b) AS l FROM m),
e AS (SELECT obj, track, arg_min(class, part) AS class, count(*) AS n_fragments, sum(n) AS n_samples, sum(n * a / l) AS x, sum(n * 50 / l) AS y, sum(n * b / l) AS z FROM u GROUP BY 1, 2),
h AS (SELECT obj, track, arg_max(x, p) - arg_min(x, p) AS dx, arg_max(y, p) - arg_min(y, p) AS dy FROM w GROUP BY 1, 2),
r AS (SELECT obj, track, 'c' || lpad(CAST(event_id AS VARCHAR), 8, '0') AS path, row_number() OVER (PARTITION BY obj, track ORDER BY CASE WHEN event_id % 5 <> 0 THEN round(x) ELSE 0 END DESC, event_id) AS r FROM w),
b AS (SELECT obj, track, string_agg(path, ',' ORDER BY r) AS crops FROM r WHERE r <= 5 GROUP BY 1, 2)
SELECT obj, track, class, n_fragments, CAST(n_samples AS BIGINT) AS n_samples, CASE WHEN dx <> 0 OR dy <> 0 THEN round(degrees(atan2(dy, dx)), 5) END AS heading,
 round(x / sqrt(x * x + y * y + z * z), 6) AS e0, round(y / sqrt(x * x + y * y + z * z), 6) AS e1, round(z / sqrt(x * x + y * y + z * z), 6) AS e2, crops FROM e JOIN h USING (obj, track) JOIN b USING (obj, track)"""


def k6_merged_samples(spark, d):
    """Samples of the merged tracks, with velocities over the repaired gaps."""
    _, s = mg.merge_tracks(*_pieces(spark, d), scope=SCOPE)
    return s.select("obj", "track", "part_of", "pos", *[F.round(c, 6).alias(c) for c in ("t", "vx", "vy")])


K6S = _CHAINS + """, v AS (SELECT *, t - lag(t) OVER q AS dt, x - lag(x) OVER q AS dx, y - lag(y) OVER q AS dy FROM w WINDOW q AS (PARTITION BY obj, track ORDER BY p))
SELECT obj, track, piece AS part_of, CAST(p AS INTEGER) AS pos, round(t, 6) AS t, CASE WHEN dt > 0 THEN round(dx / dt, 6) ELSE 0.0 END AS vx, CASE WHEN dt > 0 THEN round(dy / dt, 6) ELSE 0.0 END AS vy FROM v"""


def f6_running_embedding(spark, d):
    """Running mean of the vectors of a label in order of their ids."""
    v = table(spark, d, "embeddings").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    m = mg.running_mean(v, ["label"], "vec_id")
    return m.select("label", "n", F.posexplode("embedding").alias("i", "x")).select("label", "n", "i", F.round("x", 6).alias("x"))


F6 = """WITH u AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS l FROM embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) - 1 AS k, count(*) OVER (PARTITION BY label) AS n FROM u WHERE l > 1e-12),
w AS (SELECT label, n, v, l, CASE WHEN k = n - 1 THEN pow(0.9, k) ELSE 0.1 * pow(0.9, k) END AS w FROM r),
x AS (SELECT label, n, generate_subscripts(v, 1) - 1 AS i, w * unnest(v) / l AS x FROM w)
SELECT label, n, CAST(i AS INTEGER) AS i, round(sum(x), 6) AS x FROM x GROUP BY 1, 2, 3"""


def h12_citation_pieces(spark, d):
    """Answers cut at their citations."""
    _, text = _cited(spark, d)
    p = text.select("answer_id", F.posexplode(an.citation_pieces(F.col("text"))).alias("no", "p"))
    return p.select("answer_id", "no", "p.offset", "p.kind", "p.piece", "p.id", "p.at")


H12 = """WITH e AS (SELECT user_id AS answer_id, event_id, '[obj_' || user_id || ' @ ' || CASE WHEN event_id % 3 = 0 THEN '00:00:00' ELSE strftime(ts, '%H:%M:%S') END || ']' AS c FROM events),
t AS (SELECT answer_id, event_id, row_number() OVER (PARTITION BY answer_id ORDER BY event_id) AS r, c, lead(c) OVER (PARTITION BY answer_id ORDER BY event_id) IS NULL AS last FROM e),
p AS (SELECT answer_id, r * 3 AS k, CASE WHEN r = 1 THEN 'Seen ' ELSE '. Seen ' END AS piece, 'text' AS kind FROM t UNION ALL SELECT answer_id, r * 3 + 1, c, 'citation' FROM t UNION ALL SELECT answer_id, r * 3 + 2, '.', 'text' FROM t WHERE last)
SELECT answer_id, CAST(row_number() OVER w - 1 AS INTEGER) AS no, CAST(sum(length(piece)) OVER w - length(piece) AS INTEGER) AS "offset", kind, piece,
 CASE WHEN kind = 'citation' THEN 'obj_' || answer_id END AS id, CASE WHEN kind = 'citation' THEN substr(piece, length(piece) - 8, 8) END AS "at" FROM p WINDOW w AS (PARTITION BY answer_id ORDER BY k)"""


def m10_transcripts(spark, d):
    """Events of a user as captions, sixteen of them in at most 220 characters."""
    s = samples(spark, d)
    captions = s.select("obj", "pos", F.date_format("ts", "HH:mm:ss").alias("at"), F.concat("class", F.lit(" "), F.floor("x").cast("string")).alias("caption"))
    return an.transcripts(captions, most=16, budget=220, keys=("obj",))


M10 = f"""WITH {SAMPLES_SQL}, c AS (SELECT obj, pos, '[' || strftime(ts, '%H:%M:%S') || '] ' || class || ' ' || CAST(CAST(floor(x) AS BIGINT) AS VARCHAR) AS line, count(*) OVER (PARTITION BY obj) AS n FROM samples),
k AS (SELECT * FROM c WHERE n <= 16 OR EXISTS (SELECT 1 FROM range(16) t(i) WHERE CAST(round_even(i * (n - 1) / 15.0, 0) AS BIGINT) = pos)),
e AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY obj ORDER BY pos) - 1 AS e FROM k)
SELECT obj, count(*) FILTER (WHERE e <= 220) AS n_lines, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE e <= 220), '') AS transcript FROM e GROUP BY obj"""


def q19_evidence_frames(spark, d):
    """First frames of the objects with a supported citation, by answer."""
    e, text = _cited(spark, d)
    found = text.select("answer_id", F.posexplode(tx.citations(F.col("text"))).alias("pos", "c")).select("answer_id", "pos", "c.id", "c.at")
    v = rt.validate_citations(found, e.select("answer_id", "id", "at"))
    f = an.evidence_frames(v, e.select("id", F.col("event_id").alias("frame_id")))
    return f.select("answer_id", "id", F.array_join(F.col("frames").cast("array<string>"), ",").alias("frames"))


Q19 = f"""WITH v AS ({Q17}), f AS (SELECT 'obj_' || user_id AS id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events)
SELECT answer_id, id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS frames FROM (SELECT DISTINCT answer_id, id FROM v WHERE supported) JOIN f USING (id) WHERE r <= 5 GROUP BY 1, 2"""

QUERIES = {
    "h12_citation_pieces": (h12_citation_pieces, H12), "m10_transcripts": (m10_transcripts, M10), "q19_evidence_frames": (q19_evidence_frames, Q19),
    "k6_merge_tracks": (k6_merge_tracks, K6), "k6_merged_samples": (k6_merged_samples, K6S), "f6_running_embedding": (f6_running_embedding, F6),
    "h1_color": (h1_color, H1), "h5_all_colors": (h5_all_colors, H5), "q17_citations": (q17_citations, Q17), "g1_knn": (g1_knn, G1),
    "q16_fuse": (q16_fuse, Q16), "f7_mean_embedding": (f7_mean_embedding, F7), "g4_cosine": (g4_cosine, G4), "e3_gate_join": (e3_gate_join, E3), "k4_greedy_links": (k4_greedy_links, None), "k3_assignment": (k3_assignment, None),
}
