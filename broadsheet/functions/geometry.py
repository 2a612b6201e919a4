"""Layout geometry as column expressions on boxes: structs, or column prefixes, of x1, y1, x2, y2 in page pixels.

The overlap measures look alike and differ on purpose: ``col_iou`` goes by both widths, ``col_overlap`` by the narrower one, ``containment`` by the
candidate's, ``row_overlap`` by the lower height, ``inside`` by the area of one box.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    """The columns of a box, prefix + x1 and so on, made when they are asked for (a module may name boxes before there is a session)."""

    prefix: str = ""

    x1 = property(lambda self: F.col(f"{self.prefix}x1"))
    y1 = property(lambda self: F.col(f"{self.prefix}y1"))
    x2 = property(lambda self: F.col(f"{self.prefix}x2"))
    y2 = property(lambda self: F.col(f"{self.prefix}y2"))

    @property
    def width(self) -> Column:
        return self.x2 - self.x1

    @property
    def height(self) -> Column:
        return self.y2 - self.y1

    @property
    def area(self) -> Column:
        zero = F.lit(0)
        return F.greatest(self.width, zero) * F.greatest(self.height, zero)

    @property
    def center_x(self) -> Column:
        return (self.x1 + self.x2) / 2

    @property
    def center_y(self) -> Column:
        return (self.y1 + self.y2) / 2


def box(prefix: str = "") -> Box:
    """The box in columns prefix + x1 and so on; a prefix like "a." names a relation or struct."""
    return Box(prefix)


def x_overlap(a: Box, b: Box) -> Column:
    return F.greatest(F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1), F.lit(0))


def y_overlap(a: Box, b: Box) -> Column:
    return F.greatest(F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1), F.lit(0))


def at_least_one(c: Column) -> Column:
    return F.greatest(c, F.lit(1))


def col_iou(a: Box, b: Box) -> Column:
    """Shared width over the width of both together."""
    shared = x_overlap(a, b)
    return shared / at_least_one(at_least_one(a.width) + at_least_one(b.width) - shared)


def col_overlap(a: Box, b: Box) -> Column:
    """Shared width over the narrower width."""
    return x_overlap(a, b) / at_least_one(F.least(a.width, b.width))


def containment(candidate: Box, root: Box) -> Column:
    """Shared width over the candidate's width."""
    return x_overlap(candidate, root) / at_least_one(candidate.width)


def row_overlap(a: Box, b: Box) -> Column:
    """Shared height over the lower height; 0 for flat boxes."""
    least = F.least(a.height, b.height)
    return F.when(least > 0, y_overlap(a, b) / least).otherwise(F.lit(0.0))


def intersection(a: Box, b: Box) -> Column:
    return x_overlap(a, b) * y_overlap(a, b)


def iou(a: Box, b: Box) -> Column:
    shared = intersection(a, b)
    union = a.area + b.area - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def inside(a: Box, b: Box) -> Column:
    """The part of a's area that lies in b."""
    return F.when(a.area > 0, intersection(a, b) / a.area).otherwise(F.lit(0.0))


def vertical_gap(a: Box, b: Box) -> Column:
    """Empty height between two boxes, 0 where they share rows."""
    return F.greatest(b.y1 - a.y2, a.y1 - b.y2, F.lit(0))


def horizontal_gap(a: Box, b: Box) -> Column:
    return F.greatest(b.x1 - a.x2, a.x1 - b.x2, F.lit(0))


def edge_distance(a: Box, b: Box) -> Column:
    """Euclidean distance between the nearest edges."""
    return F.sqrt(F.pow(horizontal_gap(a, b), 2) + F.pow(vertical_gap(a, b), 2))


def layout_distance(a: Box, b: Box) -> Column:
    """Vertical gap, plus 100,000 for columns that have nothing in common."""
    return vertical_gap(a, b) + (1 - col_iou(a, b)) * 100_000


def single_line_pair(a: Box, b: Box) -> Column:
    """Two boxes that read as parts of one banner line. Whole pixels are compared exactly: 63 is 0.35 of 180, which doubles deny."""
    low = at_least_one(F.least(a.height, b.height))
    shift = F.lit(Decimal("0.35")) * low
    side = F.greatest(a.x1, b.x1) - F.least(a.x2, b.x2)  # negative: they overlap by so much
    return (
        (low / at_least_one(F.greatest(a.height, b.height)) >= 0.75) & (F.abs(a.y1 - b.y1) <= shift) & (F.abs(a.y2 - b.y2) <= shift)
        & (side <= 0.75 * low) & (-side <= 0.5 * at_least_one(F.least(a.width, b.width)))
    )


def box_of_points(points: Column) -> Column:
    """The box around an array of (x, y) pairs; zeros where there is none."""
    of = lambda k, f: F.coalesce(f(F.transform(points, lambda p: F.get(p, F.lit(k)))), F.lit(0.0))
    return F.struct(of(0, F.array_min).alias("x1"), of(1, F.array_min).alias("y1"), of(0, F.array_max).alias("x2"), of(1, F.array_max).alias("y2"))


def l_shape(outer: Box, hole: Box) -> Column:
    """The two rectangles left of outer when hole takes one corner; null unless it touches one vertical and one horizontal side (within 8 %)."""
    tx, ty = 0.08 * outer.width, 0.08 * outer.height
    left, right = hole.x1 - outer.x1 <= tx, outer.x2 - hole.x2 <= tx
    top, bottom = hole.y1 - outer.y1 <= ty, outer.y2 - hole.y2 <= ty
    rect = lambda x1, y1, x2, y2: F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
    band = F.when(top, rect(outer.x1, hole.y2, outer.x2, outer.y2)).otherwise(rect(outer.x1, outer.y1, outer.x2, hole.y1))
    y1, y2 = F.when(top, outer.y1).otherwise(hole.y1), F.when(top, hole.y2).otherwise(outer.y2)
    rest = F.when(left, rect(hole.x2, y1, outer.x2, y2)).otherwise(rect(outer.x1, y1, hole.x1, y2))
    return F.when((left != right) & (top != bottom), F.array(band, rest))


def scaled(a: Box, width: Column, height: Column, grid: int = 1000) -> Column:
    """A box on a 0..grid scale in pixels: rounded half to even, clamped, null if empty."""
    px = lambda v, size: F.greatest(F.lit(0), F.least(F.bround(v * size / grid).cast("int"), size))
    x1, y1, x2, y2 = px(a.x1, width), px(a.y1, height), px(a.x2, width), px(a.y2, height)
    return F.when((x2 > x1) & (y2 > y1), F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")))
