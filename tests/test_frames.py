"""Frame ranges, plug-in decoders and models."""

from pyspark.sql import functions as F

from trajecta.operators import inference as nf
from trajecta.sources import frames as fr


def videos(spark):
    return spark.createDataFrame([("v", 100_000, 25.0, "p1"), ("w", 7, 10.0, "p2"), ("none", 0, 25.0, "p3"), ("odd", 5, None, "p4")], "video_id string, n_frames long, fps double, path string").withColumn("start", F.lit("2026-01-01 00:00:00").cast("timestamp"))


def test_ranges_cover_the_sampled_frames(spark):
    v = videos(spark)
    index = fr.frame_index(v, every_seconds=0.5)
    got = {(r.video_id, r.frame_no) for r in index.collect()}
    assert got == {("v", i) for i in range(0, 100_000, 12)} | {("w", 0), ("w", 5)}
    ranges = fr.frame_ranges(v, every_seconds=0.5, frames=1000).collect()
    assert all(r.hi - r.lo < 1000 and r.lo % r.step == 0 for r in ranges) and sum((r.hi - r.lo) // r.step + 1 for r in ranges) == len(got)
    some = fr.frame_index(v, every_seconds=0.5, between=(100, 130)).collect()
    assert {(r.video_id, r.frame_no) for r in some} == {("v", 108), ("v", 120)}


def test_decoder_sees_only_the_wanted_range(spark):
    def decoder(path, lo, hi, step):
        assert hi - lo < 50, "asked for more than the range"
        for no in range(lo, hi + 1, step):
            yield no, f"{path}:{no}:{lo}-{hi}".encode()

    ranges = fr.frame_ranges(videos(spark), every_seconds=0.2, frames=50, between=(990, 1040))
    rows = {r.frame_no: bytes(r.image).decode() for r in fr.decoded(ranges, decoder).collect()}
    assert sorted(rows) == list(range(990, 1041, 5)) and rows[990].startswith("p1:990:")


def test_model_is_asked_once_a_content(spark, tmp_path):
    log, cache = str(tmp_path / "log"), str(tmp_path / "cache")

    def load():
        def model(contents):
            if "bad" in contents:
                raise ValueError("cannot read bad")
            with open(log, "a") as f:
                f.writelines(f"{c}\n" for c in contents)
            return [c.upper() for c in contents]

        return model

    rows = [(i, f"text {i % 7}") for i in range(60)] + [(100, None), (101, "bad")]
    df = spark.createDataFrame(rows, "id long, content string").repartition(6)
    first = {r.id: (r.answer, r.error) for r in nf.cached_answers(df, "m1", load, cache).collect()}
    assert first[3] == ("TEXT 3", None) and first[100] == (None, None) and first[101][0] is None and "cannot read bad" in first[101][1]
    more = spark.createDataFrame([*rows, (200, "new")], "id long, content string")
    second = {r.id: r.answer for r in nf.cached_answers(more, "m1", load, cache).collect()}
    assert second[3] == "TEXT 3" and second[200] == "NEW"
    assert sorted(open(log).read().split("\n")[:-1]) == sorted([f"text {i}" for i in range(7)] + ["new"])
    nf.cached_answers(more, "m2", load, cache).count()  # another model has no answers yet
    assert len(open(log).read().split("\n")[:-1]) == 16
