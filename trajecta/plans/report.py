"""Evaluation reports of many videos as rows.

Every report has one form: a row for each cell, (keys.., label, line, row,
column, metric, value, reason). A cell without a value carries the reason and
never a zero; a report that a video can't have is one cell with the reason.
Reports are aggregates: some rows a video, whatever its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.text import latex_escaped
from ..operators.metrics import attribute_accuracy

NO_TRUTH = "no ground truth for this video"
NO_FINAL = "no reconciled objects for this video"
NO_VALUES = "the ground truth has boxes but no attribute values"
NO_ANSWER = "nothing was answered"
NOTHING = "nothing to measure"
ONE_CLIP = "every object was seen in one clip only"
#: Outcomes of the reconciliation and what they mean.
OUTCOMES = {
    "confirmed": "best shot agreed with clip-level voting",
    "filled": "best shot answered where voting was uncertain",
    "corrected": "best shot overturned a confident clip-level answer",
    "retained": "clip-level voting overruled a disagreeing best shot",
}


def write_counted(df: DataFrame, path: str, counts: dict[str, Column]) -> tuple[DataFrame, dict]:
    """Write ``df`` to a new folder and take ``counts`` (aggregates) in the same
    pass: the table as read back, and the counts by name."""
    seen = Observation()
    df.observe(seen, *[c.alias(n) for n, c in counts.items()]).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get


def cells(df: DataFrame, keys: list[str], label: str, line: Column, row: Column, metrics: dict[str, Column], *, reason: Column | None = None, missing: dict[str, str | Column] | None = None) -> DataFrame:
    """``df``, one row a line, in the form of reports. ``reason`` holds for a
    whole line, whose values it hides; ``missing`` says by metric why a value
    may be null."""
    whole = F.lit(None).cast("string") if reason is None else reason
    each = []
    for i, (name, value) in enumerate(metrics.items()):
        value = F.when(whole.isNull(), value.cast("double"))
        why = F.when(value.isNull(), F.coalesce(whole, F.lit((missing or {}).get(name, NOTHING)), F.lit(NOTHING)))
        each.append(F.struct(F.lit(i).alias("column"), F.lit(name).alias("metric"), value.alias("value"), why.alias("reason")))
    out = df.select(*keys, F.lit(label).alias("label"), line.cast("int").alias("line"), row.alias("row"), F.explode(F.array(*each)).alias("c"))
    return out.select(*keys, "label", "line", "row", "c.*")


def _unavailable(videos: DataFrame, keys: list[str], label: str, reason: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    df = videos.withColumn("_why", reason).where("_why IS NOT NULL")
    return df.select(*keys, F.lit(label).alias("label"), F.lit(0).alias("line"), none.alias("row"), F.lit(0).alias("column"), none.alias("metric"), F.lit(None).cast("double").alias("value"), F.col("_why").alias("reason"))


def stage_summary(tracks: DataFrame, associated: DataFrame, objects: DataFrame, keys: list[str]) -> DataFrame:
    """Identities after each stage: rows of ``tracks``, of
    ``associated(n_fragments)`` with the merges made, of ``objects(n_sightings)``
    with those of several clips. A video that a stage left empty counts 0."""
    zero = F.lit(0).cast("long")
    parts = [
        tracks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), zero.alias("more")).withColumn("at", F.lit(0)),
        associated.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("n_fragments") - 1).cast("long").alias("more")).withColumn("at", F.lit(1)),
        objects.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_sightings") > 1).alias("more")).withColumn("at", F.lit(2)),
    ]
    pick = lambda c, i: F.coalesce(F.sum(F.when(F.col("at") == i, F.col(c))), zero)
    one = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy(*keys).agg(*[pick("n", i).alias(f"n{i}") for i in range(3)], pick("more", 1).alias("merges"), pick("more", 2).alias("several"))
    stages = F.array(*[F.struct(F.lit(i).alias("line"), F.lit(s).alias("stage"), F.col(f"n{i}").alias("identities"), (F.col(m) if m else F.lit(None).cast("long")).alias("more"), F.lit(note).alias("note")) for i, (s, m, note) in enumerate((("tracking", None, "raw per-clip tracks"), ("association", "merges", "fragment merges"), ("linking", "several", "span multiple clips")))])
    out = one.select(*keys, F.explode(stages).alias("s")).select(*keys, "s.*")
    return out.withColumn("note", F.concat_ws(" ", F.col("more").cast("string"), "note")).drop("more")


def roster(objects: DataFrame, keys: list[str], column: str = "class") -> DataFrame:
    """Objects by class, most first, ties by name."""
    n = objects.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), column)))


def accuracy_report(rows: DataFrame, videos: DataFrame, keys: list[str], *, label: str = "attribute accuracy") -> DataFrame:
    """``rows(keys.., attribute, truth, value, uncertain)`` of ``videos(keys..,
    has_truth, has_final)``, one row each."""
    n = attribute_accuracy(rows, keys)
    total = n.groupBy(*keys).agg(F.sum(F.col("correct") + F.col("wrong") + F.col("abstained")).alias("scorable"))
    known = videos.join(total, keys, "left")
    why = F.when(~F.col("has_truth"), NO_TRUTH).when(~F.col("has_final"), NO_FINAL).when(F.coalesce("scorable", F.lit(0)) == 0, NO_VALUES)
    scored = n.join(known.where(why.isNull()).select(*keys), keys)
    line = F.row_number().over(Window.partitionBy(*keys).orderBy("attribute"))
    scored = scored.withColumn("line", line)
    metrics = {c: F.col(c) for c in ("correct", "wrong", "abstained", "precision", "coverage")}
    return cells(scored, keys, label, F.col("line"), F.col("attribute"), metrics, missing={"precision": NO_ANSWER, "coverage": NO_VALUES}).unionByName(_unavailable(known, keys, label, why))


def consistency_report(objects: DataFrame, videos: DataFrame, keys: list[str], *, label: str = "attribute consistency") -> DataFrame:
    """``objects(keys.., attribute, consistency)`` as ``metrics.consistency``
    marks them: single, consistent or inconsistent."""
    kind = lambda k: F.count_if(F.col("consistency") == k)
    n = objects.groupBy(*keys, "attribute").agg(*[kind(k).alias(k) for k in ("consistent", "inconsistent", "single")])
    both = F.col("consistent") + F.col("inconsistent")
    n = n.withColumns({"rate": F.round(F.try_divide(F.col("consistent"), both), 4), "line": F.row_number().over(Window.partitionBy(*keys).orderBy("attribute"))})
    total = n.groupBy(*keys).agg(F.sum(both).alias("measurable"))
    known = videos.join(total, keys, "left")
    why = F.when(~F.col("has_final"), NO_FINAL).when(F.coalesce("measurable", F.lit(0)) == 0, ONE_CLIP)
    scored = n.join(known.where(why.isNull()).select(*keys), keys)
    metrics = {c: F.col(c) for c in ("consistent", "inconsistent", "rate", "single")}
    return cells(scored, keys, label, F.col("line"), F.col("attribute"), metrics, missing={"rate": ONE_CLIP}).unionByName(_unavailable(known, keys, label, why))


def correction_report(log: DataFrame, videos: DataFrame, keys: list[str], *, label: str = "confirmation outcomes") -> DataFrame:
    """Outcomes of ``log(keys.., outcome)``; others than OUTCOMES count for
    nothing. A reconciled video without any has zeros, as they were counted."""
    n = log.groupBy(*keys).agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES])
    known = videos.where("has_final").join(n, keys, "left")
    lines = F.array(*[F.struct(F.lit(i).alias("line"), F.lit(o).alias("outcome"), F.coalesce(F.col(o), F.lit(0)).alias("count")) for i, o in enumerate(OUTCOMES)])
    each = known.select(*keys, F.explode(lines).alias("x")).select(*keys, "x.*")
    return cells(each, keys, label, F.col("line"), F.col("outcome"), {"count": F.col("count")}).unionByName(_unavailable(videos, keys, label, F.when(~F.col("has_final"), NO_FINAL)))


def answer_report(summary: DataFrame, runs: DataFrame, keys: list[str], *, label: str = "answers") -> DataFrame:
    """Systems side by side: ``summary(keys.., system, ..)`` of
    ``metrics.answer_summary`` over the questions that ran, and the questions
    that failed of ``runs(keys.., system, error)``, which spoil no other."""
    failed = runs.groupBy(*keys, "system").agg(F.count("error").alias("failed"), F.count(F.lit(1)).alias("asked"))
    df = failed.join(summary, [*keys, "system"], "left").withColumn("line", F.row_number().over(Window.partitionBy(*keys).orderBy("system")))
    metrics = {"questions": F.coalesce("n_questions", F.lit(0)), "failed": F.col("failed")} | {c: F.col(c) for c in ("counting_accuracy", "object_f1", "abstention_accuracy", "grounded_rate")}
    gone = F.when(F.col("failed") == F.col("asked"), "every question failed")
    missing = {"counting_accuracy": F.coalesce(gone, F.lit("no counting question ran")), "object_f1": F.coalesce(gone, F.lit("no question with expected objects ran")), "abstention_accuracy": gone, "grounded_rate": gone}
    return cells(df, keys, label, F.col("line"), F.col("system"), metrics, missing=missing)


def latex(report: DataFrame, keys: list[str]) -> DataFrame:
    """One document a video: a tabular for each label, in their order; a report
    without any value is a note with its reason. Built from sorted lists of a
    video's cells, as many as its reports have."""
    number = F.when(F.col("value") == F.floor("value"), F.col("value").cast("long").cast("string")).otherwise(F.round("value", 4).cast("string"))
    lines = report.groupBy(*keys, "label", "line", "row").agg(F.array_sort(F.collect_list(F.struct("column", "metric", F.coalesce(number, F.lit("-")).alias("cell"), F.col("value").isNotNull().alias("has"), "reason"))).alias("c"))
    tables = lines.groupBy(*keys, "label").agg(F.array_sort(F.collect_list(F.struct("line", "row", "c"))).alias("l"))
    joined = lambda first, rest: F.concat(F.array_join(F.concat(F.array(latex_escaped(first)), F.transform(rest, latex_escaped)), " & "), F.lit(r" \\"))
    head = joined(F.lit("name"), F.col("l")[0]["c"]["metric"])
    body = F.array_join(F.transform("l", lambda x: joined(F.coalesce(x["row"], F.lit("")), x["c"]["cell"])), "\n")
    shape = F.concat(F.lit("l"), F.repeat(F.lit("r"), F.size(F.col("l")[0]["c"])))
    full = F.concat(F.lit(r"\begin{tabular}{"), shape, F.lit("}\n\\toprule\n"), head, F.lit("\n\\midrule\n"), body, F.lit("\n\\bottomrule\n\\end{tabular}"))
    note = F.concat(F.lit(r"\textit{Not available: "), latex_escaped(F.col("l")[0]["c"][0]["reason"]), F.lit("}"))
    some = F.exists("l", lambda x: F.exists(x["c"], lambda c: c["has"]))
    table = F.concat(F.lit("\\begin{table}[h]\n\\centering\n\\caption{"), latex_escaped(F.col("label")), F.lit("}\n"), F.when(some, full).otherwise(note), F.lit("\n\\end{table}\n"))
    parts = tables.select(*keys, F.struct("label", table.alias("text")).alias("t"))
    return parts.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("t"))["text"], "\n").alias("document"))
