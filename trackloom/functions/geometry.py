"""Box, pose and angle expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Area of a box, never negative."""
    return F.greatest(x2 - x1, F.lit(0)) * F.greatest(y2 - y1, F.lit(0))


def intersection(a: str, b: str) -> Column:
    """Common area of the boxes ``{a}x1 .. {a}y2`` and ``{b}x1 .. {b}y2``."""
    c = F.col
    wide = F.least(c(f"{a}x2"), c(f"{b}x2")) - F.greatest(c(f"{a}x1"), c(f"{b}x1"))
    high = F.least(c(f"{a}y2"), c(f"{b}y2")) - F.greatest(c(f"{a}y1"), c(f"{b}y1"))
    return F.greatest(wide, F.lit(0)) * F.greatest(high, F.lit(0))


def box_area(a: str) -> Column:
    return area(*(F.col(f"{a}{k}") for k in ("x1", "y1", "x2", "y2")))


def io_min(a: str, b: str) -> Column:
    """Intersection over the smaller area."""
    return intersection(a, b) / F.greatest(F.least(box_area(a), box_area(b)), F.lit(1e-9))


def iou(a: str, b: str) -> Column:
    """Intersection over union."""
    both = intersection(a, b)
    return both / F.greatest(box_area(a) + box_area(b) - both, F.lit(1e-9))


def wrap(angle: Column) -> Column:
    """The same angle between -pi and pi."""
    return F.atan2(F.sin(angle), F.cos(angle))


def octant(angle: Column) -> Column:
    """Which of the eight 45-degree sectors, from 0."""
    return F.floor(F.pmod(angle, F.lit(2 * 3.141592653589793)) / (3.141592653589793 / 4)).cast("int")


def point_in_polygon(x: Column, y: Column, polygon: list[tuple[float, float]]) -> Column:
    """Even-odd rule: whether an odd number of edges lies to the right of the point."""
    inside = F.lit(False)
    for (ax, ay), (bx, by) in zip(polygon, polygon[1:] + polygon[:1], strict=True):
        if ay == by:
            continue
        crosses = (F.lit(ay) > y) != (F.lit(by) > y)
        inside = inside != (crosses & (x < (bx - ax) * (y - ay) / (by - ay) + ax))
    return inside
