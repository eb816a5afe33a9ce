import pytest

from figurant.operators import outlines

PIXELS = "fig_id long, panel_id int, y int, x int"


def test_axes(spark):
    rows = [(1, 1, 5, x) for x in range(21)] + [(1, 2, y, 3) for y in range(11)] + [(2, 1, k, k) for k in range(11)]
    got = {(r.fig_id, r.panel_id): (round(r.dir_x, 6), round(r.dir_y, 6), round(r.long_side, 6)) for r in outlines.axes(spark.createDataFrame(rows, PIXELS)).collect()}
    half = round(0.5**0.5, 6)
    assert got == {(1, 1): (1, 0, 20), (1, 2): (0, 1, 10), (2, 1): (half, half, pytest.approx(10 * 2**0.5, abs=1e-5))}


def test_bond_lengths(spark):
    lines = [(1, k, 100 - k, float(v)) for k in range(3) for v in (10 * (k + 1), 20 * (k + 1))]
    assert outlines.rough_bond_length(spark.createDataFrame(lines, "fig_id int, panel_id int, area int, length double")).first().bond == pytest.approx((18.5 + 37) / 2)
    corners = [(1, 1, 1, 0.0, 0.0), (1, 1, 2, 3.0, 4.0), (1, 1, 3, 3.0, 10.0), (1, 2, 4, 0.0, 0.0)]
    assert outlines.bond_length(spark.createDataFrame(corners, "fig_id int, panel_id int, corner_id int, x double, y double")).first().bond == pytest.approx(16 / 3)


def test_curly_arrow(spark):
    stroke = {(50, x) for x in range(10, 111)} | {(51, x) for x in range(10, 111)}
    head = {(50 + d, 110 - k) for k in range(15) for d in range(-k // 2, k // 2 + 1)}
    pixels = spark.createDataFrame([(1, 1, y, x) for y, x in stroke | head], PIXELS)
    ends = {(r.x < 60): r for r in outlines.curly_ends(pixels).collect() if r.x < 20 or r.x > 90}
    assert ends[True].spread < 5 <= ends[False].spread and ends[True].width == 101
    diagrams = spark.createDataFrame([(1, 7, 40, -30, 60, 5), (1, 8, 40, 118, 60, 160), (1, 9, 400, 400, 420, 420)], "fig_id long, panel_id int, t int, l int, b int, r int")
    got = {r.side: (r.diagram_id, round(r.dir_x)) for r in outlines.curly_scans(outlines.curly_ends(pixels), diagrams).collect()}
    assert got == {"reactants": (7, -1), "products": (8, 1)}
