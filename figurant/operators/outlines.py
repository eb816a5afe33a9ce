"""What is read off the pixels of single components: axes, bond lengths, ends of curly arrows.

``pixels`` here has fig_id, panel_id, y, x: the lit pixels of each component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from figurant.functions import geometry as g
from figurant.functions.geometry import Point, box


def axes(pixels: DataFrame) -> DataFrame:
    """fig_id, panel_id, dir_x, dir_y, long_side: the unit direction of each component's main
    axis (from the covariance of its pixels; x is never negative) and its extent along it."""
    c = pixels.groupBy("fig_id", "panel_id").agg(F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"), F.covar_pop("x", "y").alias("xy"))
    turn = F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy")) / 2
    c = c.select("fig_id", "panel_id", F.cos(turn).alias("dir_x"), F.sin(turn).alias("dir_y"))
    along = F.col("x") * F.col("dir_x") + F.col("y") * F.col("dir_y")
    return pixels.join(c, ["fig_id", "panel_id"]).groupBy("fig_id", "panel_id", "dir_x", "dir_y").agg((F.max(along) - F.min(along)).alias("long_side"))


def rough_bond_length(lines: DataFrame) -> DataFrame:
    """fig_id, bond: the 85th percentile of the line lengths of each of the two largest
    components, averaged. ``lines``: fig_id, panel_id, area, length."""
    each = lines.groupBy("fig_id", "panel_id", "area").agg(F.percentile("length", F.lit(0.85)).alias("p"))
    first = F.row_number().over(Window.partitionBy("fig_id").orderBy(F.desc("area"), "panel_id"))
    return each.withColumn("k", first).where("k <= 2").groupBy("fig_id").agg(F.avg("p").alias("bond"))


def bond_length(corners: DataFrame) -> DataFrame:
    """fig_id, bond: the mean distance from a corner to the nearest other one of its component.
    ``corners``: fig_id, panel_id, corner_id, x, y."""
    a, b = corners.alias("a"), corners.alias("b")
    same = (F.col("a.fig_id") == F.col("b.fig_id")) & (F.col("a.panel_id") == F.col("b.panel_id")) & (F.col("a.corner_id") != F.col("b.corner_id"))
    d = g.length(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y"))
    near = a.join(b, same).groupBy("a.fig_id", "a.panel_id", "a.corner_id").agg(F.min(d).alias("d"))
    return near.groupBy("fig_id").agg(F.avg("d").alias("bond"))


_ENDS = "fig_id long, panel_id int, x int, y int, spread int, width int"


def curly_ends(pixels: DataFrame) -> DataFrame:
    """fig_id, panel_id, x, y, spread, width of the ends of each arrow: its outermost pixels to
    the four sides that are far enough from each other. ``spread`` is how much the stroke's
    thickness varies near the end: much at an arrow's head. A component's pixels are one group
    of its task's sorted rows."""

    def one(f: pd.DataFrame) -> pd.DataFrame:
        y, x = f.y.to_numpy(), f.x.to_numpy()
        w, h = x.max() - x.min() + 1, y.max() - y.min() + 1
        order = np.lexsort((x, y))
        y, x = y[order], x[order]
        strip_w = max(int(0.05 * w), 5)
        left, right = np.flatnonzero(x < x.min() + strip_w), np.flatnonzero(x > x.max() - strip_w)
        kept: list[tuple[int, int]] = []
        for k in (0, len(x) - 1, left[0], right[-1]):
            if all(np.hypot(x[k] - p, y[k] - q) > 0.3 * max(w, h) for p, q in kept):
                kept.append((int(x[k]), int(y[k])))
        reach = max(25, int(w * h * 3e-4))
        rows = []
        for p, q in kept:
            near = (np.abs(x - p) <= reach) & (np.abs(y - q) <= reach)
            at = np.stack([x[near] - x[near].mean(), y[near] - y[near].mean()])
            _, vectors = np.linalg.eigh(at @ at.T)
            along, across = vectors[:, 1] @ at, vectors[:, 0] @ at
            n = np.bincount((np.rint(along) - np.rint(along).min()).astype(int)[np.abs(across) <= 10])
            n = n[n > 0]
            rows.append((f.fig_id.iloc[0], f.panel_id.iloc[0], p, q, int(n.max() - n.min()) if len(n) else 0, int(w)))
        return pd.DataFrame(rows, columns=["fig_id", "panel_id", "x", "y", "spread", "width"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for f in frames:
            f = f if held is None else pd.concat([held, f])
            if len(f):
                last = (f.fig_id == f.fig_id.iloc[-1]) & (f.panel_id == f.panel_id.iloc[-1])
                done, held = f[~last], f[last]
                for _, part in done.groupby(["fig_id", "panel_id"], sort=False):
                    yield one(part)
        if held is not None and len(held):
            yield one(held)

    return pixels.select("fig_id", "panel_id", "y", "x").repartition("fig_id", "panel_id").sortWithinPartitions("fig_id", "panel_id").mapInPandas(run, _ENDS)


def curly_scans(ends: DataFrame, diagrams: DataFrame, head: int = 5, factor: float = 0.3) -> DataFrame:
    """fig_id, panel_id, side ('reactants', 'products'), x, y, diagram_id, dir_x, dir_y: for
    each side the end whose nearest diagram (nearer than ``factor`` times the arrow's width) is
    the largest, and the way from it to that diagram's center. Heads lead to products."""
    e, d = ends.alias("e"), diagrams.alias("d")
    p, c = Point(F.col("e.x"), F.col("e.y")), g.center(box("d"))
    dist = g.edge_separation(box("d"), g.point_box(p))
    j = e.join(d, F.col("e.fig_id") == F.col("d.fig_id")).select("e.*", dist.alias("dist"), F.col("d.panel_id").alias("diagram_id"), g.area(box("d")).alias("size"), (c.x - p.x).alias("dx"), (c.y - p.y).alias("dy"))
    near = F.row_number().over(Window.partitionBy("fig_id", "panel_id", "x", "y").orderBy("dist", "diagram_id"))
    j = j.withColumn("k", near).where((F.col("k") == 1) & (F.col("dist") < factor * F.col("width")))
    j = j.withColumn("side", F.when(F.col("spread") < head, "reactants").otherwise("products"))
    best = F.row_number().over(Window.partitionBy("fig_id", "panel_id", "side").orderBy(F.desc("size"), "diagram_id", "x", "y"))
    far = F.greatest(g.length(F.col("dx"), F.col("dy")), F.lit(1e-5))
    return j.withColumn("k", best).where("k = 1").select("fig_id", "panel_id", "side", "x", "y", "diagram_id", (F.col("dx") / far).alias("dir_x"), (F.col("dy") / far).alias("dir_y"))
