"""Running clips against their batch twin, over restarts."""

from pyspark.sql import functions as F

from trajecta.streaming import clips, live

SCHEMA = "video_id long, frame_no long, ts timestamp"


def test_stream_equals_batch_over_restarts(spark, tmp_path):
    frames = spark.range(900).select((F.col("id") % 3).alias("video_id"), F.floor(F.col("id") / 3).alias("frame_no"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 7 + (F.col("id") % 3) * 5).alias("ts"))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for part in range(3):  # the query stops and starts again from its checkpoint
        frames.where(F.floor(F.col("frame_no") / 100) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = clips.running_clips(live.read(spark, str(tmp_path / "in"), frames.schema), seconds=300, every=5, late="60 seconds")
        live.run_once(stream, out, state)
    got = sorted(map(tuple, spark.read.parquet(out).select("video_id", "clip_no", "first_frame", "last_frame", "n_frames", "n_sampled", "late").collect()))
    want = sorted(map(tuple, clips.closed_clips(frames, seconds=300, every=5, late_seconds=60).select("video_id", "clip_no", "first_frame", "last_frame", "n_frames", "n_sampled", "late").collect()))
    assert got == want and len(got) > 50
    # a frame of a closed clip is told, not lost
    frames.where("frame_no = 0").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live.run_once(clips.running_clips(live.read(spark, str(tmp_path / "in"), frames.schema), seconds=300, every=5, late="30 days"), str(tmp_path / "out2"), str(tmp_path / "state2"))
    assert spark.read.parquet(str(tmp_path / "out2")).agg(F.sum("n_frames")).first()[0] > 0


def test_state_holds_open_clips_only():
    """Clips that begin and end in the same rows are sent without being kept."""
    from types import SimpleNamespace

    import pandas as pd

    held, wrote, timers, sent = {}, [], [], [None]
    p = clips._Clips(10, 2)
    p.handle = SimpleNamespace(registerTimer=timers.append)
    p.open = SimpleNamespace(iterator=lambda: iter([((k,), v) for k, v in held.items()]), updateValue=lambda k, v: (wrote.append(k[0]), held.update({k[0]: v})), removeKey=lambda k: held.pop(k[0]), containsKey=lambda k: k[0] in held, getValue=lambda k: held[k[0]])
    p.closed = SimpleNamespace(exists=lambda: sent[0] is not None, get=lambda: sent[0], update=lambda v: sent.__setitem__(0, v))
    at = lambda *s: pd.to_datetime(pd.Series(s), unit="s")
    frames = lambda *s: pd.DataFrame({"ts": at(*s), "frame_no": list(s), "clip_no": [x // 10 for x in s]})
    first = pd.concat(p.handleInputRows((1,), iter([frames(25, 1, 4), frames(2, 31, 12)]), None))
    assert first[["clip_no", "n_frames", "n_sampled", "late"]].values.tolist() == [[0, 3, 2, False], [1, 1, 1, False], [2, 1, 0, False]]
    assert wrote == [3] == list(held) and timers == [40_000] and sent[0] == (2,)
    second = pd.concat(p.handleInputRows((1,), iter([frames(5, 36), frames(6, 44)]), None))
    assert second[["clip_no", "n_frames", "late"]].values.tolist() == [[0, 2, True], [3, 2, False]] and list(held) == [4]
    assert second["first_frame"].tolist() == [*at(5, 31)]
