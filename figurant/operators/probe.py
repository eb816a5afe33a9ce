"""Roles of diagrams around arrows, by scans along the arrow's axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figurant.functions import geometry as g
from figurant.functions.geometry import Point, box


def scan_points(arrows: DataFrame, step: Column, fig_width: Column, fig_height: Column, switch: int) -> DataFrame:
    """fig_id, panel_id, n, x, y: points along each arrow's direction (dir_x, dir_y) from past
    its tip (switch 1) or tail (-1) to the figure's bounds, one per step. The start lies half
    the arrow's length and two steps away from its center, where so many steps fit."""
    least = lambda c: F.when(F.abs(c) >= 1e-5, c).otherwise(F.lit(1e-5))
    sx, sy = least(step * F.col("dir_x")), least(step * F.col("dir_y"))
    n = F.least(F.abs(F.floor(fig_width / sx)), F.abs(F.floor(fig_height / sy))).cast("int")
    b, c = box(), g.center(box())
    skip = F.floor(F.greatest(g.width(b), g.height(b)) / 2.0 / F.greatest(F.abs(sx), F.abs(sy))).cast("int") + 2
    a = arrows.select("fig_id", "panel_id", sx.alias("sx"), sy.alias("sy"), n.alias("count"), skip.alias("skip"), c.x.alias("cx"), c.y.alias("cy"))
    a = a.where("count > 0").withColumn("first", F.when(F.col("skip") <= F.col("count"), F.col("skip")).otherwise(0))
    a = a.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("count"))))
    k = (F.col("first") + F.col("n")) * switch
    return a.select("fig_id", "panel_id", "n", (F.col("cx") + F.col("sx") * k).alias("x"), (F.col("cy") + F.col("sy") * k).alias("y"))


def blocked_at(points: DataFrame, arrows: DataFrame, limit: Column) -> DataFrame:
    """fig_id, panel_id, stop: the first point near another arrow; null if there is none, or
    if it is one of the first two."""
    p, a = points.alias("p"), arrows.alias("a")
    gap = g.edge_separation(box("a"), g.point_box(Point(F.col("p.x"), F.col("p.y"))))
    near = gap < F.greatest(F.greatest(g.width(box("a")), g.height(box("a"))) * 0.2, limit)
    j = p.join(a, (F.col("p.fig_id") == F.col("a.fig_id")) & (F.col("p.panel_id") != F.col("a.panel_id")) & near, "left")
    first = F.min(F.when(F.col("a.panel_id").isNotNull(), F.col("p.n")))
    return j.groupBy("p.fig_id", "p.panel_id").agg(F.when(first > 2, first).alias("stop"))


def open_points(points: DataFrame, stops: DataFrame) -> DataFrame:
    return points.join(stops, ["fig_id", "panel_id"]).where("stop is null or n < stop").drop("stop")


def probe_distance(arrows: DataFrame, least: float, factor: float) -> DataFrame:
    """fig_id, panel_id, probe: ``factor`` times the other arrows' mean long side, ``least`` at
    least, and where there is no other."""
    size = F.greatest(g.width(box()), g.height(box()))
    sums = arrows.withColumn("size", size).groupBy("fig_id").agg(F.sum("size").alias("s"), F.count("*").alias("c"))
    mean = F.try_divide((F.col("s") - F.col("size")).cast("double"), (F.col("c") - 1).cast("double"))
    return arrows.withColumn("size", size).join(sums, "fig_id").select("fig_id", "panel_id", F.greatest(F.lit(float(least)), F.coalesce(mean * factor, F.lit(float(least)))).alias("probe"))


def found_diagrams(points: DataFrame, probes: DataFrame, diagrams: DataFrame) -> DataFrame:
    """fig_id, panel_id (arrow), diagram_id: diagrams nearer to a scan point than the probe
    distance, each once."""
    p, d = points.join(probes, ["fig_id", "panel_id"]).alias("p"), diagrams.alias("d")
    near = g.edge_separation(box("d"), g.point_box(Point(F.col("p.x"), F.col("p.y")))) < F.col("p.probe")
    return p.join(d, (F.col("p.fig_id") == F.col("d.fig_id")) & near).select("p.fig_id", "p.panel_id", F.col("d.panel_id").alias("diagram_id")).distinct()


def assigned(members: DataFrame, single_line: bool = True) -> DataFrame:
    """fig_id, arrow_id, products_group. ``members`` has fig_id, arrow_id, grp (1, 2), a
    diagram's box, the arrow's center (cx, cy) and reference point (rx, ry). Distances fall
    towards the reference point for products. Single line: the group with the least change
    (ties: group 1). Else the closer group decides: products if its change is below 0."""
    at = lambda x, y: F.min(g.edge_separation(box(), g.point_box(Point(F.col(x), F.col(y)))))
    groups = members.groupBy("fig_id", "arrow_id", "grp").agg(at("cx", "cy").alias("c"), at("rx", "ry").alias("r"))
    of = lambda k, e: F.max(F.when(F.col("grp") == k, e))
    change = F.col("r") - F.col("c")
    two = groups.groupBy("fig_id", "arrow_id").agg(of(1, change).alias("g1"), of(2, change).alias("g2"), of(1, F.col("c")).alias("d1"), of(2, F.col("c")).alias("d2")).where("g1 is not null and g2 is not null")
    if single_line:
        pick = F.when(F.col("g1") <= F.col("g2"), 1).otherwise(2)
    else:
        first = F.col("d1") <= F.col("d2")
        pick = F.when(first, F.when(F.col("g1") < 0, 1).otherwise(2)).otherwise(F.when(F.col("g2") < 0, 2).otherwise(1))
    return two.select("fig_id", "arrow_id", pick.alias("products_group"))
