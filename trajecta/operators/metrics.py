"""Tracking, attribute and question-answering metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import box, iou
from ..functions.text import first_count, is_abstention
from .matching import assign

#: Question types whose cited objects are compared with the expected ones.
CORRECTNESS_TYPES = ("factual", "counting", "temporal")


def box_pairs(truth: DataFrame, found: DataFrame, scope: list[str]) -> DataFrame:
    """Overlapping boxes of one frame: (scope, a: true id, b: found id, score)."""
    t = truth.select(*scope, F.col("identity").alias("a"), *[F.col(c).alias(f"t_{c}") for c in ("x1", "y1", "x2", "y2")])
    f = found.select(*scope, F.col("identity").alias("b"), *[F.col(c).alias(f"f_{c}") for c in ("x1", "y1", "x2", "y2")])
    return t.join(f, scope).select(*scope, "a", "b", iou(box("t_"), box("f_")).alias("score"))


def frame_matches(pairs: DataFrame, scope: list[str], least: float = 0.5) -> DataFrame:
    """Assignment of the largest total overlap per frame; the threshold comes
    after it."""
    return assign(pairs.where("score > 0"), scope).where(F.col("score") >= least)


def identity_changes(truth: DataFrame, matches: DataFrame, scope: list[str], *, order: str = "frame_no") -> DataFrame:
    """Per true id: switches (another match than the last one, any time ago)
    and fragments (matched, then present but unmatched, then matched)."""
    keys = [c for c in scope if c != order]
    rows = truth.select(*scope, F.col("identity").alias("a")).join(matches.select(*scope, "a", "b"), [*scope, "a"], "left")
    w = Window.partitionBy(*keys, "a").orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    last = F.last("b", ignorenulls=True).over(before)
    gap = F.lag("b").over(w).isNull() & last.isNotNull()
    marked = rows.withColumns({"_switch": F.col("b").isNotNull() & last.isNotNull() & (last != F.col("b")), "_frag": F.col("b").isNotNull() & gap})
    return marked.groupBy(*keys, "a").agg(F.count_if("_switch").alias("switches"), F.count_if("_frag").alias("fragments"))


def mota(truth: DataFrame, found: DataFrame, scope: list[str], *, order: str = "frame_no", least: float = 0.5) -> DataFrame:
    """One row: tp, fp, fn, switches, fragments, mota (not clamped; 0 without
    true boxes)."""
    matches = frame_matches(box_pairs(truth, found, scope), scope, least)
    n_true, n_found = truth.agg(F.count(F.lit(1)).alias("n_true")), found.agg(F.count(F.lit(1)).alias("n_found"))
    tp = matches.agg(F.count(F.lit(1)).alias("tp"))
    changes = identity_changes(truth, matches, scope, order=order).agg(F.coalesce(F.sum("switches"), F.lit(0)).alias("switches"), F.coalesce(F.sum("fragments"), F.lit(0)).alias("fragments"))
    one = tp.join(n_true, F.lit(True)).join(n_found, F.lit(True)).join(changes, F.lit(True))  # one row each
    fn, fp = F.col("n_true") - F.col("tp"), F.col("n_found") - F.col("tp")
    score = F.when(F.col("n_true") == 0, 0.0).otherwise(1 - (fn + fp + F.col("switches")) / F.col("n_true"))
    return one.select("tp", fp.alias("fp"), fn.alias("fn"), "switches", "fragments", F.round(score, 6).alias("mota"))


def idf1(truth: DataFrame, found: DataFrame, scope: list[str], *, keys: list[str], least: float = 0.5) -> DataFrame:
    """Per ``keys`` (a video): identity F1 by one assignment of true to found
    ids on the number of frames in which they overlap enough."""
    shared = box_pairs(truth, found, scope).where(F.col("score") >= least).groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).cast("double").alias("score"))
    hit = assign(shared, keys).groupBy(*keys).agg(F.sum("score").alias("hit"))
    n = truth.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_true")).join(found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_found")), keys, "full_outer")
    total = F.coalesce("n_true", F.lit(0)) + F.coalesce("n_found", F.lit(0))
    return n.join(hit, keys, "left").select(*keys, F.round(F.coalesce(2 * F.col("hit") / total, F.lit(0.0)), 6).alias("idf1"))


def attribute_accuracy(rows: DataFrame, keys: list[str] | tuple = ()) -> DataFrame:
    """``(keys.., attribute, truth, value, uncertain)`` -> per key and attribute
    the counts and the precision of what was answered and its coverage."""
    known = F.col("truth").isNotNull()
    said = F.col("value").isNotNull() & ~F.coalesce("uncertain", F.lit(False))
    df = rows.groupBy(*keys, "attribute").agg(F.count_if(known & said & (F.col("value") == F.col("truth"))).alias("correct"), F.count_if(known & said & (F.col("value") != F.col("truth"))).alias("wrong"), F.count_if(known & ~said).alias("abstained"), F.count_if(~known).alias("missing_truth"))
    answered = F.col("correct") + F.col("wrong")
    return df.withColumns({"precision": F.round(F.try_divide(F.col("correct"), answered), 4), "coverage": F.round(F.try_divide(answered, answered + F.col("abstained")), 4)})


def consistency(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Certain values of one object over its sightings: single, consistent or
    inconsistent."""
    good = F.when(~F.coalesce("uncertain", F.lit(False)), F.col("value"))
    df = rows.groupBy(*keys).agg(F.count(good).alias("n"), F.count_distinct(good).alias("n_distinct"))
    return df.withColumn("consistency", F.when(F.col("n") < 2, "single").when(F.col("n_distinct") == 1, "consistent").otherwise("inconsistent"))


def set_scores(found: str, expected: str, *, digits: int | None = 4) -> dict:
    """Columns precision, recall, f1 of two array columns, null without any
    expected element; unrounded where they go into a mean (``digits`` None)."""
    both = F.size(F.array_intersect(found, expected))
    n, m = F.size(F.array_distinct(found)), F.size(F.array_distinct(expected))
    ok = m > 0
    cut = lambda c: c if digits is None else F.round(c, digits)
    return {"precision": F.when(ok, cut(F.coalesce(F.try_divide(both, n), F.lit(0.0)))), "recall": F.when(ok, cut(both / m)), "f1": F.when(ok, cut(2 * both / (n + m)))}


def frame_boxes(tracks: DataFrame, frames: DataFrame, *, prefix: str = "") -> DataFrame:
    """Tracks with aligned arrays ``frames`` and ``boxes`` (struct x1, y1, x2,
    y2) as one row per frame of ``frames(frame_id)`` and identity. Of boxes of
    one identity in one frame the last one of the list stays, of repeated
    tracks the one with the larger ``pos``."""
    identity = F.concat(F.lit(prefix), F.concat_ws(":", "clip_id", F.col("track_id").cast("string")))
    each = tracks.select(identity.alias("identity"), "pos", F.posexplode(F.arrays_zip("frames", "boxes")).alias("at", "z"))
    each = each.select("identity", "z.frames", "z.boxes", F.struct("pos", "at").alias("o")).where("boxes IS NOT NULL").withColumnRenamed("frames", "frame_id")
    last = each.groupBy("frame_id", "identity").agg(F.max_by("boxes", "o").alias("b"))
    return frames.select("frame_id").distinct().join(last, "frame_id").select("frame_id", "identity", "b.*")


def identity_votes(matches: DataFrame, keys: tuple = ()) -> DataFrame:
    """``matches(keys.., a: true id, b: found id)``, one row a frame, as the true
    id that each found id met most often, ties to the smaller: (keys.., b, a, n)."""
    n = matches.groupBy(*keys, "b", "a").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys, "b").orderBy(F.desc("n"), "a")
    return n.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def answer_scores(items: DataFrame, answers: DataFrame, true_ids: DataFrame, *, scored: tuple = CORRECTNESS_TYPES) -> DataFrame:
    """One row per answer; a metric that does not apply is null, never 0.

    ``items(question_id, question_type, answerable, expected_count,
    expected_ids)``, ``answers(question_id, system, answer, said_count,
    cited_ids, retrieved_ids)``, ``true_ids(b: cited id, a: true id)``. Ids
    without a true id count for nothing. Without ``said_count`` the count is
    the first number of the answer."""
    if "said_count" not in answers.columns:
        answers = answers.withColumn("said_count", first_count(F.col("answer")))
    cited = answers.select("question_id", "system", F.explode("cited_ids").alias("b")).join(true_ids.select("b", "a"), "b")
    mapped = cited.groupBy("question_id", "system").agg(F.collect_set("a").alias("mapped"))
    df = items.join(answers, "question_id").join(mapped, ["question_id", "system"], "left")
    df = df.withColumn("mapped", F.coalesce("mapped", F.array().cast("array<string>")))
    quiet, ask = is_abstention(F.col("answer")), F.col("answerable")
    judged = ask & F.col("question_type").isin(*scored) & (F.size("expected_ids") > 0)
    some = {f"object_{k}": F.when(judged, v) for k, v in set_scores("mapped", "expected_ids", digits=None).items()}
    counted = ask & (F.col("question_type") == "counting") & F.col("expected_count").isNotNull()
    own = {"grounded": F.size(F.array_except("cited_ids", "retrieved_ids")) == 0, "abstention_correct": quiet != ask, "counting_correct": F.when(counted, F.col("said_count").eqNullSafe(F.col("expected_count")))}
    return df.select("question_id", "question_type", "system", *[c.alias(n) for n, c in {**own, **some}.items()])


def answer_summary(scores: DataFrame, keys: tuple = ("system",)) -> DataFrame:
    """Means over the answers that a metric applies to, null where none is."""
    share = lambda c: F.round(F.avg(F.col(c).cast("double")), 4)
    return scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_questions"), share("counting_correct").alias("counting_accuracy"), share("object_f1").alias("object_f1"), share("abstention_correct").alias("abstention_accuracy"), share("grounded").alias("grounded_rate"))
