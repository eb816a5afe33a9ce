"""Geometry of boxes (top, left, bottom, right) and points (x, y) as column expressions.

All of it is plain arithmetic on columns, so it stays in generated code and under the
optimiser. ``faithful`` variants keep the known defects of the usual definitions.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    t: Column
    l: Column  # noqa: E741
    b: Column
    r: Column


class Point(NamedTuple):
    x: Column
    y: Column


def box(alias: str = "") -> Box:
    """The box columns t, l, b, r of a (possibly aliased) relation."""
    p = f"{alias}." if alias else ""
    return Box(*(F.col(p + c) for c in "tlbr"))


def point_box(p: Point) -> Box:
    return Box(p.y, p.x, p.y, p.x)


def width(a: Box) -> Column:
    return a.r - a.l


def height(a: Box) -> Column:
    return a.b - a.t


def area(a: Box) -> Column:
    return width(a) * height(a)


def aspect_ratio(a: Box) -> Column:
    """Width over height; null for flat boxes."""
    return F.try_divide(width(a).cast("double"), height(a).cast("double"))


def perimeter(a: Box) -> Column:
    return 2 * height(a) + 2 * width(a)


def length(dx: Column, dy: Column) -> Column:
    return F.sqrt((dx * dx + dy * dy).cast("double"))


def diagonal(a: Box) -> Column:
    return length(width(a), height(a))


def center(a: Box, faithful: bool = False) -> Point:
    """(x, y); the faithful x is null where the right edge is 0."""
    x = (a.l + a.r) / F.lit(2.0)
    return Point(F.when(a.r != 0, x) if faithful else x, (a.t + a.b) / F.lit(2.0))


def rounded_center(a: Box) -> Point:
    """The center rounded half to even."""
    c = center(a)
    return Point(F.rint(c.x).cast("int"), F.rint(c.y).cast("int"))


def center_separation(a: Box, b: Box) -> Column:
    p, q = center(a), center(b)
    return length(p.x - q.x, p.y - q.y)


class Orientation(NamedTuple):
    """Where the other box lies as seen from the first."""

    top: Column
    left: Column
    bottom: Column
    right: Column


def orientation(a: Box, b: Box) -> Orientation:
    return Orientation(b.b < a.t, b.r < a.l, a.b < b.t, a.r < b.l)


def edge_separation(a: Box, b: Box, faithful: bool = False) -> Column:
    """Distance of the closest edges or corners, 0 where boxes touch or overlap. The faithful
    form measures three of the four diagonal cases between wrong corners, so isn't symmetric."""
    zero = F.lit(0)
    dx = F.greatest(a.l - b.r, b.l - a.r, zero)
    dy = F.greatest(a.t - b.b, b.t - a.b, zero)
    right = length(dx, dy)
    if not faithful:
        return right
    o = orientation(a, b)
    return (
        F.when(o.bottom & o.left, length(b.r - a.l, b.t - a.t))
        .when(o.bottom & o.right, length(b.l - a.r, b.t - a.t))
        .when(o.right & o.top, length(b.l - a.r, b.b - a.b))
        .otherwise(right)
    )


def contains(a: Box, b: Box) -> Column:
    return (a.t <= b.t) & (a.l <= b.l) & (a.b >= b.b) & (a.r >= b.r)


def contains_point(a: Box, p: Point) -> Column:
    return p.x.between(a.l, a.r) & p.y.between(a.t, a.b)


def overlaps(a: Box, b: Box) -> Column:
    return (F.least(a.r, b.r) > F.greatest(a.l, b.l)) & (F.least(a.b, b.b) > F.greatest(a.t, b.t))


def overlaps_vertically(a: Box, b: Box) -> Column:
    """The boxes share a range of columns."""
    return F.least(a.r, b.r) > F.greatest(a.l, b.l)


def intersection_area(a: Box, b: Box) -> Column:
    zero = F.lit(0)
    return F.greatest(F.least(a.r, b.r) - F.greatest(a.l, b.l), zero) * F.greatest(F.least(a.b, b.b) - F.greatest(a.t, b.t), zero)


def ioa(a: Box, b: Box) -> Column:
    """Intersection over the area of ``a``; null for a flat ``a``."""
    return F.try_divide(intersection_area(a, b).cast("double"), area(a).cast("double"))


def iou(a: Box, b: Box, faithful: bool = False) -> Column:
    """Intersection over union; the faithful form takes boxes as (x, y, width, height)."""
    if not faithful:
        i = intersection_area(a, b)
        return F.coalesce(F.try_divide(i.cast("double"), (area(a) + area(b) - i).cast("double")), F.lit(0.0))
    w = F.least(a.t + a.b, b.t + b.b) - F.greatest(a.t, b.t)
    h = F.least(a.l + a.r, b.l + b.r) - F.greatest(a.l, b.l)
    union = a.b * a.r + b.b * b.r - w * h
    return F.when((w < 0) | (h < 0), F.lit(0.0)).otherwise(F.try_divide((w * h).cast("double"), union.cast("double")))


def union_box(a: Box, b: Box) -> Box:
    return Box(F.least(a.t, b.t), F.least(a.l, b.l), F.greatest(a.b, b.b), F.greatest(a.r, b.r))


def intersection_box(a: Box, b: Box) -> Box:
    """The common box, with null edges where there is none."""
    some = (F.least(a.r, b.r) >= F.greatest(a.l, b.l)) & (F.least(a.b, b.b) >= F.greatest(a.t, b.t))
    cut = (F.greatest(a.t, b.t), F.greatest(a.l, b.l), F.least(a.b, b.b), F.least(a.r, b.r))
    return Box(*(F.when(some, c) for c in cut))


def direction_angle(p: Point, q: Point) -> Column:
    """Degrees (0 to 180) between the y axis and the way from p to q; 90 for equal points."""
    dy, d = q.y - p.y, length(q.x - p.x, q.y - p.y)
    return F.degrees(F.acos(dy / F.greatest(d, F.lit(1e-5))))


def points_on_line(p: Point, dx: Column, dy: Column, distance: Column) -> tuple[Point, Point]:
    a = distance / length(dx, dy)
    return Point(p.x + a * dx, p.y + a * dy), Point(p.x - a * dx, p.y - a * dy)


def lies_along_normal(arrow: Box, dir_x: Column, dir_y: Column, long_side: Column, other: Box) -> Column:
    """Whether the center of ``other`` is nearest to one of the two points on the arrow's
    normal rather than to those on its axis; the axis wins ties."""
    c, o, half = center(arrow), center(other), long_side / F.lit(2.0)
    axis = points_on_line(c, dir_x, dir_y, half * 1.5)
    normal = points_on_line(c, -dir_y, dir_x, half * 0.5)
    gap = lambda p: length(p.x - o.x, p.y - o.y)
    return F.least(*map(gap, normal)) < F.least(*map(gap, axis))


def slope(p: Point, q: Point) -> Column:
    """Rise over run; null for vertical lines."""
    return F.try_divide((q.y - p.y).cast("double"), (q.x - p.x).cast("double"))


def intercept(p: Point, q: Point) -> Column:
    return p.y - slope(p, q) * p.x


def line_distance(p: Point, a: Point, b: Point) -> Column:
    """Distance of p from the line through a and b; null if they are equal."""
    cross = F.abs((b.x - a.x) * (a.y - p.y) - (a.x - p.x) * (b.y - a.y)).cast("double")
    return F.try_divide(cross, length(b.x - a.x, b.y - a.y))


def raster(p: Point, q: Point) -> Column:
    """Pixels (array of x, y) between two integer points: one per column, or per row of steep
    lines, from the lesser end on; vertical lines leave out their last pixel."""
    dx, dy = q.x - p.x, q.y - p.y
    steep = F.abs(dy) >= F.abs(dx)
    swap = F.when(steep, p.y > q.y).otherwise(p.x > q.x)
    ax, ay = F.when(swap, q.x).otherwise(p.x), F.when(swap, q.y).otherwise(p.y)
    bx, by = F.when(swap, p.x).otherwise(q.x), F.when(swap, p.y).otherwise(q.y)
    run, rise = F.when(steep, by - ay).otherwise(bx - ax), F.when(steep, F.abs(bx - ax)).otherwise(F.abs(by - ay))
    way = F.when(steep, F.signum((bx - ax).cast("double"))).otherwise(F.signum((by - ay).cast("double"))).cast("int")
    off = lambda k: F.floor((2 * k * rise + run).cast("double") / F.greatest(2 * run, F.lit(1))).cast("int") * way
    last = F.when(dx == 0, run - 1).otherwise(run)
    ks = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(ks, lambda k: F.struct(F.when(steep, ax + off(k)).otherwise(ax + k).alias("x"), F.when(steep, ay + k).otherwise(ay + off(k)).alias("y")))


def unscaled(a: Box, scale: Column) -> Box:
    """Coordinates in the original figure, rounded half to even."""
    return Box(*(F.rint(c / scale).cast("int") for c in a))


def in_main(a: Box, crop: Box, pad_top: Column, pad_left: Column, faithful: bool = False) -> Box:
    """From crop to figure coordinates; the faithful form subtracts the padding twice from the
    bottom and right edges."""
    again = 1 if faithful else 0
    t, x = a.t + crop.t - pad_top, a.l + crop.l - pad_left
    return Box(t, x, t + height(a) - again * pad_top, x + width(a) - again * pad_left)


def in_crop(a: Box, crop: Box) -> Box:
    return Box(a.t - crop.t, a.l - crop.l, a.b - crop.t, a.r - crop.l)


def clamped(a: Box, fig_width: Column, fig_height: Column) -> Box:
    zero = F.lit(0)
    return Box(F.greatest(a.t, zero), F.greatest(a.l, zero), F.least(a.b, fig_height), F.least(a.r, fig_width))


def extended(a: Box, n: int, fig_width: Column, fig_height: Column) -> Box:
    return clamped(Box(a.t - n, a.l - n, a.b + n, a.r + n), fig_width, fig_height)


def rescaled_detection(x1: Column, y1: Column, x2: Column, y2: Column, scale: Column) -> Box:
    """Detector order (x1, y1, x2, y2) to a box in pixels, cut to integers."""
    return Box(*((c * scale).cast("int") for c in (y1, x1, y2, x2)))


def euclidean(a: Column, b: Column) -> Column:
    """Distance of two number arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y).cast("double") * (x - y).cast("double")), F.lit(0.0), lambda s, x: s + x))


def text_of(a: Box) -> Column:
    return F.format_string("[%d, %d, %d, %d]", *a)


def dilation_steps(ratio: Column) -> Column:
    """Dilations that join a structure's strokes, by the share of dark pixels around it."""
    return F.when(ratio >= 0.03, 4).when((ratio > 0.005) & (ratio < 0.03), F.ceil(10 - 200 * ratio)).otherwise(18).cast("int")
