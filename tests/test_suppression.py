"""Suppression by groups in tasks and by rounds against the sequential rule."""

import numpy as np

from trajecta.operators import detections as de


def test_groups_and_rounds_keep_the_same(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g in range(30):
        for i in range(int(rng.integers(1, 60))):
            x, y, w, h = rng.integers(0, 40), rng.integers(0, 40), rng.integers(0, 30), rng.integers(1, 30)
            sure = None if i % 17 == 5 else float(rng.integers(1, 6))
            rows.append((None if g == 3 else g, i, sure, float(x), float(y), float(x + w), float(y + h)))
    df = spark.createDataFrame(rows, "frame int, id long, confidence double, x1 double, y1 double, x2 double, y2 double")
    want = {}
    for g in {r[0] for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: (-(r[2] or 0), r[1])):
            live = g is not None and r[2] is not None and r[5] > r[3]
            over = [max(0, min(r[5], k[5]) - max(r[3], k[3])) * max(0, min(r[6], k[6]) - max(r[4], k[4])) for k in kept]
            area = [(k[5] - k[3]) * (k[6] - k[4]) + (r[5] - r[3]) * (r[6] - r[4]) for k in kept]
            want[g, r[1]] = not live or not any(o / (a - o) > 0.4 for o, a in zip(over, area, strict=True))
            if live and want[g, r[1]]:
                kept.append(r)
    for largest in (4096, 20, 0):
        got = {(r.frame, r.id): r.kept for r in de.suppress(df, ["frame"], threshold=0.4, largest=largest).collect()}
        assert got == want, largest
    assert not all(want.values())
    one = de.overlaps(df, ["frame"], 0.4)
    assert one.count() == one.distinct().count()
    assert de.suppress(df.limit(0), ["frame"]).count() == 0
