"""Plane geometry as Column expressions; boxes are (x1, y1, x2, y2) columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    return tuple(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2"))


def overlap(a: Box, b: Box) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def area(a: Box) -> Column:
    return F.greatest(F.lit(0.0), a[2] - a[0]) * F.greatest(F.lit(0.0), a[3] - a[1])


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 for disjoint or empty boxes."""
    inter = overlap(a, b)
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def covered(a: Box, b: Box) -> Column:
    """Share of ``a`` that ``b`` hides."""
    return F.when(area(a) > 0, overlap(a, b) / area(a)).otherwise(F.lit(0.0))


def diagonal(a: Box) -> Column:
    return F.hypot(F.greatest(F.lit(0.0), a[2] - a[0]), F.greatest(F.lit(0.0), a[3] - a[1]))


def center(a: Box) -> tuple[Column, Column]:
    return (a[0] + a[2]) / 2, (a[1] + a[3]) / 2


def turn(a: Column, b: Column) -> Column:
    """Signed difference of two headings in degrees, in [-180, 180)."""
    return F.pmod(b - a + 180, F.lit(360.0)) - 180


def clip01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def _side(ax, ay, bx, by, cx, cy) -> Column:
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def segments_cross(p: tuple, q: tuple, a: tuple, b: tuple) -> Column:
    """Whether segment pq properly crosses ab; touching does not count."""
    d1, d2 = _side(*a, *b, *p), _side(*a, *b, *q)
    d3, d4 = _side(*p, *q, *a), _side(*p, *q, *b)
    return (d1 * d2 < 0) & (d3 * d4 < 0)


def in_polygon(x: Column, y: Column, points: Column) -> Column:
    """Even-odd rule over ``points`` (array of x, y structs); edges are
    half-open in y, so a vertex counts once."""
    n = F.size(points)

    def crossing(i):
        a, b = F.element_at(points, i + 1), F.element_at(points, F.pmod(i + 1, n) + 1)
        spans = (a["y"] > y) != (b["y"] > y)
        at = (b["x"] - a["x"]) * F.try_divide(y - a["y"], b["y"] - a["y"]) + a["x"]
        return spans & (x < at)

    hits = F.filter(F.sequence(F.lit(0), n - 1), crossing)
    return (n >= 3) & (F.pmod(F.size(hits), F.lit(2)) == 1)


def along(dx: Column, dy: Column, heading: Column) -> tuple[Column, Column]:
    """(longitudinal, lateral) parts of a displacement; lateral unsigned."""
    c, s = F.cos(F.radians(heading)), F.sin(F.radians(heading))
    lon = dx * c + dy * s
    return lon, F.hypot(dx - lon * c, dy - lon * s)


def prediction_error(px, py, vx, vy, gap, qx, qy, diag) -> Column:
    """Distance from the constant-velocity prediction, in box diagonals."""
    return F.hypot(px + vx * gap - qx, py + vy * gap - qy) / F.coalesce(F.nullif(diag, F.lit(0.0)), F.lit(1.0))
