"""Answers in pieces, transcripts under a budget and what stands behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CITATION
from ..operators.trajectory import spread


def citation_pieces(text: Column) -> Column:
    """array of struct(offset, kind, piece, id, at): the text cut at its
    citations, in order. The pieces join to the text again; offsets count
    characters from 0; empty pieces of text are left out, a null text is
    null."""
    said = F.split(text, CITATION, -1)
    part = lambda i: F.regexp_extract_all(text, F.lit(CITATION), F.lit(i))
    none = F.lit(None).cast("string")
    plain = F.transform(said, lambda s, i: F.struct((i * 2).alias("no"), F.lit("text").alias("kind"), s.alias("piece"), none.alias("id"), none.alias("at")))
    named = F.arrays_zip(part(0).alias("whole"), part(1).alias("id"), part(2).alias("at"))
    cited = F.transform(named, lambda c, i: F.struct((i * 2 + 1).alias("no"), F.lit("citation").alias("kind"), c["whole"].alias("piece"), c["id"].alias("id"), F.lpad(c["at"], 8, "0").alias("at")))
    ordered = F.array_sort(F.filter(F.concat(plain, cited), lambda p: p["piece"] != ""))
    kind = "array<struct<offset:int,kind:string,piece:string,id:string,at:string>>"

    def add(state: Column, p: Column) -> Column:
        one = F.array(F.struct(state["end"].alias("offset"), p["kind"].alias("kind"), p["piece"].alias("piece"), p["id"].alias("id"), p["at"].alias("at")))
        return F.struct((state["end"] + F.length(p["piece"])).alias("end"), F.concat(state["out"], one.cast(kind)).alias("out"))

    start = F.struct(F.lit(0).alias("end"), F.expr(f"cast(array() as {kind})").alias("out"))
    return F.when(text.isNotNull(), F.aggregate(ordered, start, add, lambda s: s["out"]))


def transcripts(captions: DataFrame, *, most: int = 16, budget: int | None = None, keys: tuple = ("video_id",)) -> DataFrame:
    """``captions(keys, pos, at, caption)`` -> (keys, n_lines, transcript): at
    most ``most`` captions spread evenly over a video's, as lines ``[at]
    caption``; the first ones whose lines, with the breaks between them, stay
    within ``budget`` characters. A video whose first line is longer than that
    has an empty transcript. Null captions are no lines."""
    w = Window.partitionBy(*keys)
    rows = captions.where("caption IS NOT NULL").withColumns({"_i": F.row_number().over(w.orderBy("pos")) - 1, "_n": F.count(F.lit(1)).over(w)})
    rows = rows.where(F.array_contains(spread(F.col("_n").cast("int"), most), F.col("_i"))).withColumn("line", F.concat(F.lit("["), F.col("at"), F.lit("] "), F.col("caption")))
    rows = rows.withColumn("_end", F.sum(F.length("line") + 1).over(w.orderBy("pos")) - 1)
    fits = F.lit(True) if budget is None else F.col("_end") <= budget
    lines = F.array_sort(F.collect_list(F.when(fits, F.struct("_i", "line"))))
    return rows.groupBy(*keys).agg(F.count_if(fits).alias("n_lines"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("transcript"))


def distribution(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates of an attribute in the order in which they are shown: the
    largest share first, then by value. ``edges(keys, value, share, ..)``."""
    return edges.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("share"), "value")))


def best_shot_audit(edges: DataFrame) -> DataFrame:
    """Final values that a best shot decided: of attribute edges the winners
    with that source."""
    return edges.where("winner AND source = 'best_shot'").select("global_id", "type", "value", "share", "confidence")


def evidence_frames(cited: DataFrame, frames: DataFrame, *, most: int = 5, keys: tuple = ("answer_id",)) -> DataFrame:
    """(keys, id, frames): of every object with a supported citation its first
    ``most`` frames. ``cited(keys, id, supported)``, ``frames(id, frame_id)``;
    objects without frames are left out. Frames are cut before they meet
    citations."""
    r = F.row_number().over(Window.partitionBy("id").orderBy("frame_id"))
    few = frames.select("id", "frame_id").distinct().withColumn("_r", r).where(F.col("_r") <= most).groupBy("id").agg(F.array_sort(F.collect_list("frame_id")).alias("frames"))
    return cited.where("supported").select(*keys, "id").distinct().join(few, "id").select(*keys, "id", "frames")
