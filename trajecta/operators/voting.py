"""Attribute evidence: weighted votes, merging and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Voting


def weigh(readings: DataFrame, cfg: Voting = Voting()) -> DataFrame:
    """Adds weight: quality times visibility, less for a retried caption."""
    w = F.when(F.col("from_retry"), cfg.retry_weight).otherwise(1.0) * F.col("crop_quality") * (1 - F.col("occlusion"))
    return readings.withColumn("weight", F.greatest(F.lit(cfg.floor), w))


#: Weights are summed in whole billionths, so that no order of addition shows;
#: shares are whole millionths until the end.
UNIT, SHARE = 1_000_000_000, 1_000_000


def _units(weight: Column) -> Column:
    return F.round(weight * UNIT).cast("decimal(20,0)")


def _millionths(part: str, whole: str) -> Column:
    """part / whole in whole millionths, halves up."""
    return F.expr(f"CAST((2 * {part} * {SHARE} + {whole}) DIV (2 * {whole}) AS BIGINT)")


def shares(votes: DataFrame, keys: list[str]) -> DataFrame:
    """``votes(keys, value, weight)`` -> one row per value: n, weight, share
    (6 digits) and rank (heaviest first, ties by value)."""
    by = votes.where("value IS NOT NULL").groupBy(*keys, "value").agg(F.sum(_units(F.col("weight"))).alias("_w"), F.count(F.lit(1)).alias("n"))
    all_ = Window.partitionBy(*keys)
    ranked = by.withColumns({"_all": F.sum("_w").over(all_), "rank": F.row_number().over(all_.orderBy(F.desc("_w"), "value"))})
    return ranked.withColumns({"weight": F.col("_w").cast("double") / UNIT, "ppm": _millionths("_w", "_all")}).withColumn("share", F.col("ppm") / SHARE).drop("_w", "_all")


def vote(votes: DataFrame, keys: list[str], cfg: Voting = Voting()) -> DataFrame:
    """One row per key: winner, n_votes, margin, uncertain and why. Keys whose
    values are all null (nothing admitted) get a row too."""
    s = shares(votes, keys)
    top = s.groupBy(*keys).agg(F.max(F.when(F.col("rank") == 1, F.col("value"))).alias("winner"), F.sum("n").alias("n_votes"), F.max(F.when(F.col("rank") == 1, F.col("ppm"))).alias("_a"), F.max(F.when(F.col("rank") == 2, F.col("ppm"))).alias("_b"))
    out = votes.select(*keys).distinct().join(top, keys, "left").withColumn("margin", (F.col("_a") - F.coalesce("_b", F.lit(0))) / SHARE)
    n = F.coalesce("n_votes", F.lit(0))
    reason = F.when(n == 0, "no_evidence").when(n < cfg.min_evidence, "insufficient_evidence").when(F.col("margin") < cfg.min_margin, "low_margin")
    return out.select(*keys, "winner", n.alias("n_votes"), "margin", reason.isNotNull().alias("uncertain"), reason.alias("uncertain_reason"))


def merge_clips(clip_votes: DataFrame, keys: list[str]) -> DataFrame:
    """Winners of clips to one value: certain ones only, each with the support
    of its votes; confidence is the winner's part of all support."""
    good = clip_votes.where("NOT uncertain AND winner IS NOT NULL")
    by = good.groupBy(*keys, F.col("winner").alias("value")).agg(F.sum(F.greatest("n_votes", F.lit(1))).alias("support"))
    all_ = Window.partitionBy(*keys)
    ranked = by.withColumn("_total", F.sum("support").over(all_)).withColumn("_r", F.row_number().over(all_.orderBy(F.desc("support"), "value")))
    return ranked.where("_r = 1").select(*keys, "value", "support", (F.col("support") / F.col("_total")).alias("confidence"))


def merge_distributions(value_shares: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, value, share, n_votes)`` of several sightings to one
    distribution: shares weighted by votes, uncertain ones included."""
    by = value_shares.groupBy(*keys, "value").agg(F.sum((F.greatest("n_votes", F.lit(1)) * F.round(F.col("share") * SHARE)).cast("decimal(20,0)")).alias("_w"))
    by = by.withColumn("_all", F.sum("_w").over(Window.partitionBy(*keys)))
    return by.select(*keys, "value", (_millionths("_w", "_all") / SHARE).alias("share"))


def reconcile(pairs: DataFrame, cfg: Voting = Voting()) -> DataFrame:
    """Clip-level answer against best-shot answer: ``(attribute, clip_value,
    clip_confidence, best_value, best_uncertain)`` -> outcome, value,
    confidence, source, uncertain. Fine attributes follow the best shot, coarse
    ones the clip, direction is never confirmed."""
    clip, conf = F.col("clip_value"), F.coalesce("clip_confidence", F.lit(0.0))
    silent = (F.col("attribute") == "direction") | F.col("best_value").isNull() | F.coalesce("best_uncertain", F.lit(False))
    outcome = F.when(silent, "unconfirmed").when(clip.isNull(), "filled").when(clip == F.col("best_value"), "confirmed").when(F.col("attribute").isin("make", "model"), "corrected").otherwise("retained")
    df = pairs.withColumn("outcome", outcome)
    o = F.col("outcome")
    value = F.when(o.isin("filled", "corrected"), F.col("best_value")).otherwise(clip)
    confidence = F.when(o.isin("filled", "corrected"), 1.0).when(o == "confirmed", F.least(F.lit(1.0), conf + cfg.boost)).when(o == "retained", conf * (1 - cfg.penalty)).otherwise(conf)
    source = F.when(o.isin("filled", "corrected"), "best_shot").when(o == "confirmed", "agreed").when(o == "retained", "clip_voting").otherwise("unconfirmed")
    return df.withColumns({"value": value, "confidence": F.round(confidence, 6), "source": source}).withColumn("uncertain", F.col("value").isNull())


def majority(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Most frequent value per key; ties go to the one seen first."""
    by = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_first"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "_first")
    return by.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_first")
