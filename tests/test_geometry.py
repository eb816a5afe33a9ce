"""Golden rows of boxes, derived by hand."""

import math

import pytest
from pyspark.sql import functions as F

from figurant.functions import geometry as g
from figurant.functions.geometry import Box, Point


def lit(t, l, b, r):  # noqa: E741
    return Box(*map(F.lit, (t, l, b, r)))


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("a", "b", "faithful", "intended"),
    [
        ((0, 0, 10, 10), (20, 20, 30, 30), math.sqrt(500), math.sqrt(200)),
        ((20, 20, 30, 30), (0, 0, 10, 10), math.sqrt(200), math.sqrt(200)),
        ((0, 20, 10, 30), (20, 0, 30, 10), math.sqrt(500), math.sqrt(200)),
        ((20, 0, 30, 10), (0, 20, 10, 30), math.sqrt(500), math.sqrt(200)),
        ((0, 0, 10, 10), (0, 15, 10, 25), 5, 5),
        ((0, 0, 10, 10), (0, 10, 10, 20), 0, 0),
    ],
)
def test_edge_separation(spark, a, b, faithful, intended):
    assert value(spark, g.edge_separation(lit(*a), lit(*b), faithful=True)) == pytest.approx(faithful)
    assert value(spark, g.edge_separation(lit(*a), lit(*b))) == pytest.approx(intended)
    assert value(spark, g.edge_separation(lit(*b), lit(*a))) == pytest.approx(intended)


def test_overlap_measures(spark):
    a, b = lit(0, 0, 10, 10), lit(5, 5, 20, 20)
    assert value(spark, g.ioa(a, b)) == 0.25
    assert value(spark, g.iou(a, b)) == pytest.approx(25 / 300)
    assert value(spark, g.iou(a, b, faithful=True)) == pytest.approx(25 / 475)
    assert value(spark, g.ioa(lit(0, 0, 0, 9), b)) is None


def test_directions(spark):
    p = lambda x, y: Point(F.lit(x), F.lit(y))
    assert value(spark, g.direction_angle(p(0, 0), p(0, 10))) == 0
    assert value(spark, g.direction_angle(p(0, 0), p(0, -10))) == 180
    assert value(spark, g.direction_angle(p(3, 3), p(3, 3))) == 90
    arrow = lit(45, 0, 55, 100)
    side = lambda box: value(spark, g.lies_along_normal(arrow, F.lit(1.0), F.lit(0.0), F.lit(100.0), box))
    assert side(lit(0, 40, 20, 60)) and not side(lit(40, 130, 60, 150))


def test_faithful_center_and_crop(spark):
    assert value(spark, g.center(lit(0, -4, 2, 0), faithful=True).x) is None
    assert value(spark, g.center(lit(0, -4, 2, 0)).x) == -2
    inner, crop, pad = lit(5, 5, 15, 25), lit(100, 200, 300, 400), F.lit(2)
    assert value(spark, g.in_main(inner, crop, pad, pad).b) == 113 and value(spark, g.in_main(inner, crop, pad, pad, True).b) == 111
    assert value(spark, g.in_main(inner, crop, pad, pad).r - g.in_main(inner, crop, pad, pad).l) == 20


@pytest.mark.parametrize(
    ("p", "q", "pixels"),
    [
        ((0, 0), (4, 2), [(0, 0), (1, 1), (2, 1), (3, 2), (4, 2)]),
        ((0, 0), (0, 3), [(0, 0), (0, 1), (0, 2)]),
        ((2, 0), (0, 4), [(2, 0), (1, 1), (1, 2), (0, 3), (0, 4)]),
        ((4, 0), (0, 0), [(0, 0), (1, 0), (2, 0), (3, 0), (4, 0)]),
    ],
)
def test_raster(spark, p, q, pixels):
    got = value(spark, g.raster(Point(*map(F.lit, p)), Point(*map(F.lit, q))))
    assert [(x.x, x.y) for x in got] == pixels
