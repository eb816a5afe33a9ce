import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from figurant.operators import cluster, detections, graph, pixels, probe, spatial
from figurant.plans import extraction

PANEL = "fig_id long, panel_id int, t int, l int, b int, r int"


def boxes(seed, n=60, figs=6):
    r = random.Random(seed)
    out = []
    for i in range(n):
        t, x = r.randrange(80), r.randrange(80)
        out.append((i % figs, i, t, x, t + r.randrange(1, 30), x + r.randrange(1, 30)))
    return out


def apart(p, q):
    return max(p[3] - q[5], q[3] - p[5], p[2] - q[4], q[2] - p[4]) > 0


@pytest.mark.parametrize("seed", range(3))
def test_duplicates_against_the_loop(spark, seed):
    rows, want = boxes(seed), set()
    size = lambda p: (p[4] - p[2]) * (p[5] - p[3])
    inside = lambda p, q: p[2] <= q[2] and p[3] <= q[3] and p[4] >= q[4] and p[5] >= q[5]
    for f in range(6):
        left = [p for p in rows if p[0] == f]
        while left:
            group = [left[0], *(p for p in left[1:] if not apart(left[0], p))]
            left = [p for p in left if p not in group]
            best = max(group, key=lambda p: (size(p), -p[1]))
            want |= {best, *(p for p in group if not inside(best, p))}
    got = spatial.without_duplicates(spark.createDataFrame(rows, PANEL)).collect()
    assert set(map(tuple, got)) == want and len(got) == len(want)


def test_nearest_breaks_ties_by_id_and_keeps_lonely(spark):
    rows = [(1, 1, 0, 0, 10, 10), (1, 2, 0, 20, 10, 30), (1, 3, 20, 0, 30, 10), (2, 1, 0, 0, 5, 5)]
    p = spark.createDataFrame(rows, PANEL)
    got = {(r.fig_id, r.panel_id): r.parent_id for r in spatial.nearest(p, p, keep_lonely=True).collect()}
    assert got == {(1, 1): 2, (1, 2): 1, (1, 3): 1, (2, 1): None}
    assert spatial.nearest(p, p).count() == 3


@pytest.mark.parametrize("seed", range(3))
def test_pixel_components_against_flooding(spark, seed):
    r = random.Random(seed)
    lit = {(f, y, x) for f in range(3) for y in range(12) for x in range(12) if r.random() < 0.4}
    rows = [(f, y, x, 255 if (f, y, x) in lit else 0) for f in range(3) for y in range(12) for x in range(12)]
    want, left = [], set(lit)
    while left:
        stack, part = [left.pop()], []
        while stack:
            f, y, x = stack.pop()
            part.append((f, y, x))
            near = {(f, y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
            left -= near
            stack += near
        want.append((part[0][0], min(p[1] for p in part), min(p[2] for p in part), max(p[1] for p in part) + 1, max(p[2] for p in part) + 1, len(part)))
    got = pixels.components(spark.createDataFrame(rows, "fig_id long, y int, x int, v int"), 70).collect()
    assert sorted((g.fig_id, g.t, g.l, g.b, g.r, g.n) for g in got) == sorted(want)


def test_islands(spark):
    p = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([1, 2, 3, 10, 20, 21])], "k int, i int, v double")
    got = {r.v: r.cluster for r in cluster.islands(p, "k", "v", F.lit(1.5), "i").collect()}
    assert got == {1: 0, 2: 0, 3: 0, 10: -1, 20: 2, 21: 2}


def test_pruned_points(spark):
    points = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(0).alias("y")) for x in (0, 1, 5, 6, 12)))
    assert [p.x for p in spark.range(1).select(cluster.pruned_points(points, F.lit(3.0)).alias("p")).first().p] == [0, 5, 12]


def test_graph(spark):
    steps = spark.createDataFrame([(1, 0, 1, [1], [7], [2]), (1, 1, 2, [2], [], [3])], "fig_id long, step_id int, arrow_id int, reactants array<int>, conditions array<int>, products array<int>")
    placed = graph.step_nodes(steps)
    n = graph.nodes(placed)
    assert [(r.node_id, r.key) for r in n.orderBy("node_id").collect()] == [(0, "D:1"), (1, "C:7"), (2, "D:2"), (3, "P:2"), (4, "D:3")]
    e = graph.edges(placed, n)
    assert {r.src: r.successors for r in graph.adjacency(e).collect()} == {0: [1], 1: [2], 2: [3], 3: [4]}
    assert graph.isolated(n, e).count() == 0
    out = extraction.scheme(steps).first()
    assert out.json == '{"adjacency":{"0":[1],"1":[2],"2":[3],"3":[4]},"nodes":["D:1","C:7","D:2","P:2","D:3"],"is_incomplete":false}'


def test_merged_corners():
    got = pixels.merged_corners(np.array([[0, 0], [1, 0], [10, 0], [10.5, 0], [20, 0]]), np.array([0, 0, 1, 0, 0]), 2)
    assert sorted(map(tuple, got)) == [(0.5, 0.0), (10.0, 0.0), (20.0, 0.0)]


def test_corner_links(spark):
    c = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 10.0, 0.0), (1, 3, 40.0, 0.0), (2, 4, 0.0, 0.0)], "fig_id int, corner_id int, x double, y double")
    assert [(r.src, r.dst) for r in pixels.corner_links(c, 10.0, 1.54, 2.12).collect()] == [(1, 2)]


def test_scan_and_assignment(spark):
    arrow = [(1, 1, 95, 100, 105, 200, 1.0, 0.0, 100.0)]
    arrows = spark.createDataFrame(arrow, PANEL + ", dir_x double, dir_y double, long_side double")
    diagrams = spark.createDataFrame([(1, 2, 80, 300, 120, 340), (1, 3, 80, 10, 120, 50)], PANEL)
    conditions = spark.createDataFrame([(1, 9, 1)], "fig_id long, panel_id int, arrow_id int")
    got = extraction.reaction_steps(arrows, diagrams, conditions, 1000, 1000, 20.0).collect()
    assert [(r.reactants, r.conditions, r.products, r.single_line) for r in got] == [([3], [9], [2], True)]
    assert probe.scan_points(arrows.withColumn("dir_x", F.lit(0.0)), F.lit(20.0), F.lit(10.0), F.lit(0.0), 1).count() == 0


def test_missing_side_is_found_in_the_next_row(spark):
    arrows = spark.createDataFrame([(1, 1, 95, 100, 105, 200, 1.0, 0.0, 100.0)], PANEL + ", dir_x double, dir_y double, long_side double")
    diagrams = spark.createDataFrame([(1, 3, 80, 10, 120, 50), (1, 4, 480, 10, 520, 50), (1, 5, 480, 60, 520, 90)], PANEL)
    none = spark.createDataFrame([], "fig_id long, panel_id int, arrow_id int")
    got = extraction.reaction_steps(arrows, diagrams, none, 300, 1000, 20.0).collect()
    assert len(got) == 1 and got[0].reactants == [3] and set(got[0].products) <= {4, 5} and got[0].products and not got[0].single_line


def test_arrow_candidates(spark):
    c = spark.createDataFrame([(1, i, 0, 0, 50 + i, 50, 1000, 1000) for i in range(5)] + [(1, 7, 0, 0, 2, 2, 1000, 1000)], PANEL + ", fig_width int, fig_height int")
    s = lambda k: [float(j == k) for j in range(5)]
    scores = spark.createDataFrame([(1, 0, s(1)), (1, 1, s(2)), (1, 2, s(1)), (1, 3, s(0)), (1, 4, s(4)), (1, 7, s(4))], "fig_id long, panel_id int, scores array<double>")
    got = sorted((r.panel_id, r.arrow_type, r.source_rank) for r in extraction.arrow_candidates(c, scores).collect())
    assert got == [(1, "equilibrium", 3), (2, "solid", 0), (4, "curly", 1)]


def test_text_regions(spark):
    schema = PANEL + ", role string, text string"
    cand = spark.createDataFrame([(1, 10, 60, 120, 80, 180, "label", "rt, Zn"), (1, 11, 150, 300, 160, 330, "label", "1"), (1, 12, 300, 300, 310, 305, "label", "+"), (2, 13, 0, 0, 5, 5, "conditions", "x")], schema)
    arrows = spark.createDataFrame([(1, 1, 95, 100, 105, 200, 1.0, 0.0, 100.0)], PANEL + ", dir_x double, dir_y double, long_side double")
    diagrams = spark.createDataFrame([(1, 2, 80, 300, 120, 340)], PANEL)
    out = extraction.text_regions(cand, arrows, diagrams)
    assert [(r.panel_id, r.arrow_id, r.parsed.other_species) for r in out.conditions.collect()] == [(10, 1, ["Zn"])]
    assert sorted((r.panel_id, r.parent_id or 0) for r in out.labels.collect()) == [(11, 2), (13, 0)]


def test_tiles_cover_the_figure(spark):
    f = spark.createDataFrame([(1, 1700, 650), (2, 800, 600)], "fig_id int, width int, height int")
    got = detections.tiles(f, 600, 800, 100).orderBy("fig_id", "tile_id").collect()
    assert [tuple(r)[2:] for r in got if r.fig_id == 2] == [(0, 0, 600, 800)]
    assert [(r.top, r.left, r.bottom, r.right) for r in got if r.fig_id == 1][:2] == [(0, 0, 425, 666), (0, 466, 425, 1233)]


def test_completed_diagrams(spark):
    p = spark.createDataFrame([(1, 1, 50, 50, 60, 60, 1000, 1000, 0.05), (1, 2, 500, 500, 505, 505, 1000, 1000, 0.001)], PANEL + ", fig_width int, fig_height int, share double")
    c = spark.createDataFrame([(1, 5, 45, 58, 70, 90), (1, 6, 515, 515, 540, 530), (1, 7, 900, 900, 910, 910)], PANEL)
    got = sorted((r.panel_id, r.t, r.l, r.b, r.r) for r in extraction.completed(p, c, F.col("share")).collect())
    assert got == [(1, 45, 58, 70, 90), (2, 515, 515, 540, 530)]


def test_no_simple_path_is_left_out(spark):
    n = spark.read.parquet("/root/testdata/sf0.001/nation.parquet").selectExpr("int(n_nationkey) k", "int(n_regionkey) r")
    n.selectExpr("r src", "k + 5 dst").union(n.selectExpr("k + 5", "k % 3")).distinct().createOrReplaceTempView("path_edges")
    after = {}
    for a, b in spark.table("path_edges").collect():
        after.setdefault(a, []).append(b)

    def walk(path):
        yield tuple(path)
        for x in after.get(path[-1], ()):
            if x not in path:
                yield from walk([*path, x])

    want = sorted(walk([1]))
    assert sorted(tuple(r.path) for r in graph.paths(spark, "path_edges", 1).collect()) == want
    assert len(want) == 54 and sum(len(p) > 5 for p in want) == 25
    spark.range(30).selectExpr("int(id) src", "int(id + 1) dst").createOrReplaceTempView("path_line")
    assert graph.paths(spark, "path_line", 0).count() == 31


def test_shared_pixels_against_sets(spark):
    r = random.Random(5)
    rows = [(f, i, t := r.randrange(20), x := r.randrange(20), t + r.randrange(0, 8), x + r.randrange(0, 8)) for f in range(6) for i in range(12)]
    pixels_of = {(f, i): {(y, x) for y in range(t, b) for x in range(left, right)} for f, i, t, left, b, right in rows}
    want = sorted((f, i, j) for f, i in pixels_of for g, j in pixels_of if f == g and pixels_of[f, i] & pixels_of[g, j])
    panels = spark.createDataFrame(rows, "fig_id long, panel_id int, t int, l int, b int, r int").repartition("fig_id").cache()
    out = spatial.shared_pixels(panels, panels)
    assert sorted(map(tuple, out.collect())) == want
    odd = lambda a, b: F.filter(spatial.full_runs(a, b), lambda s: s["y"] % 2 == 1)
    want = sorted((f, i, j) for f, i in pixels_of for g, j in pixels_of if f == g and any(y % 2 for y, _ in pixels_of[f, i] & pixels_of[g, j]))
    assert sorted(map(tuple, spatial.shared_pixels(panels, panels, odd).collect())) == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan  # no rows of pixels, so none are shuffled
