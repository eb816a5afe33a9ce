"""Pixel kernels over a table of pixels (fig_id, y, x, v), one row per pixel, and connected
components over runs. Intended for figures of a few megapixels at most."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_background(pixels: DataFrame, desired: int) -> DataFrame:
    """Invert figures whose commonest value (the least of equals) lies at the other end: 250 to
    255 where 0 is desired, 0 to 9 where 255 is. The counts are one row per figure and value."""
    counts = pixels.groupBy("fig_id", "v").agg(F.count("*").alias("n"))
    first = F.row_number().over(Window.partitionBy("fig_id").orderBy(F.desc("n"), "v"))
    mode = counts.withColumn("k", first).where("k = 1").select("fig_id", F.col("v").alias("mode"))
    flip = F.col("mode").between(250, 255) if desired == 0 else F.col("mode").between(0, 9)
    return pixels.join(mode, "fig_id").select("fig_id", "y", "x", F.when(flip, 255 - F.col("v")).otherwise(F.col("v")).alias("v"))


def normalised(pixels: DataFrame) -> DataFrame:
    """Values stretched to 0 .. 255 per figure, cut to integers; null in constant figures."""
    ends = pixels.groupBy("fig_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    v = F.try_divide((F.col("v") - F.col("lo")) * 255.0, (F.col("hi") - F.col("lo")).cast("double"))
    return pixels.join(ends, "fig_id").select("fig_id", "y", "x", v.cast("int").alias("v"))


def binarised(pixels: DataFrame, threshold: int) -> DataFrame:
    return pixels.withColumn("v", F.when(F.col("v") > threshold, 255).otherwise(0))


def erased(pixels: DataFrame, areas: DataFrame) -> DataFrame:
    """Pixels inside any of the figure's areas (t, l, b, r; edges included) set to 0."""
    inside = F.col("p.y").between(F.col("a.t"), F.col("a.b")) & F.col("p.x").between(F.col("a.l"), F.col("a.r"))
    p = pixels.alias("p")
    hit = p.join(areas.alias("a"), (F.col("p.fig_id") == F.col("a.fig_id")) & inside, "left_semi").withColumn("v", F.lit(0))
    return hit.unionByName(p.join(areas.alias("a"), (F.col("p.fig_id") == F.col("a.fig_id")) & inside, "left_anti"))


def dilated(pixels: DataFrame, steps: int) -> DataFrame:
    """fig_id, y, x of lit pixels after ``steps`` dilations by a plus shape: each grows to all
    points within that many steps, so one explode and one distinct do."""
    ys = F.explode(F.sequence(F.lit(-steps), F.lit(steps)))
    p = pixels.where("v > 0").select("fig_id", "y", "x").withColumn("dy", ys)
    p = p.withColumn("dx", F.explode(F.sequence(F.abs("dy") - steps, F.lit(steps) - F.abs("dy"))))
    return p.select("fig_id", (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x")).where("y >= 0 and x >= 0").distinct()


def pixel_ratio(pixels: DataFrame, areas: DataFrame) -> DataFrame:
    """fig_id, panel_id, ratio: lit pixels in each area over its size."""
    inside = F.col("p.y").between(F.col("a.t"), F.col("a.b") - 1) & F.col("p.x").between(F.col("a.l"), F.col("a.r") - 1)
    j = areas.alias("a").join(pixels.where("v > 0").alias("p"), (F.col("p.fig_id") == F.col("a.fig_id")) & inside, "left")
    size = ((F.col("a.r") - F.col("a.l")) * (F.col("a.b") - F.col("a.t"))).cast("double")
    return j.groupBy("a.fig_id", "a.panel_id", size.alias("size")).agg(F.count("p.v").alias("n")).select("fig_id", "panel_id", F.try_divide(F.col("n").cast("double"), F.col("size")).alias("ratio"))


def center_of_mass(pixels: DataFrame, least: int = 200) -> DataFrame:
    return pixels.where(F.col("v") > least).groupBy("fig_id").agg(F.avg("x").cast("int").alias("x"), F.avg("y").cast("int").alias("y"))


def components(pixels: DataFrame, threshold: int) -> DataFrame:
    """fig_id, label, t, l, b, r, n: the connected components (eight neighbours) of pixels above
    ``threshold``, numbered from 1 by their first pixel; b and r are excluded edges.

    A figure is one group of its task's sorted rows: its runs are joined by union-find.
    """
    lit = pixels.where(F.col("v") > threshold).select("fig_id", "y", "x")
    dealt = lit.repartition("fig_id").sortWithinPartitions("fig_id", "y", "x")
    return dealt.mapInPandas(_by_figure, "fig_id long, label int, t int, l int, b int, r int, n int")


def _by_figure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = None
    for f in frames:
        f = f if held is None else pd.concat([held, f])
        last = f.fig_id.iloc[-1] if len(f) else None
        done, held = f[f.fig_id != last], f[f.fig_id == last]
        for _, g in done.groupby("fig_id", sort=False):
            yield label_runs(g)
    if held is not None and len(held):
        yield label_runs(held)


def label_runs(g: pd.DataFrame) -> pd.DataFrame:
    y, x = g.y.to_numpy(), g.x.to_numpy()
    new = np.append(True, (np.diff(y) != 0) | (np.diff(x) > 1))
    at = np.flatnonzero(new)
    rows, left, right = y[at], x[at], x[np.append(at[1:] - 1, len(x) - 1)]
    top = np.arange(len(at))

    def find(i: int) -> int:
        while top[i] != i:
            top[i] = i = top[top[i]]
        return i

    start = {r: i for i, r in reversed(list(enumerate(rows.tolist())))}
    for i in range(len(at)):
        j = start.get(int(rows[i]) - 1)
        while j is not None and j < i and rows[j] == rows[i] - 1 and left[j] <= right[i] + 1:
            if right[j] >= left[i] - 1:
                a, b = sorted((find(i), find(j)))
                top[b] = a
            j += 1
    root = np.array([find(i) for i in range(len(at))])
    runs = pd.DataFrame({"root": root, "t": rows, "l": left, "b": rows + 1, "r": right + 1, "n": right - left + 1})
    out = runs.groupby("root").agg(t=("t", "min"), l=("l", "min"), b=("b", "max"), r=("r", "max"), n=("n", "sum")).reset_index(drop=True)
    out.insert(0, "label", np.arange(1, len(out) + 1))
    out.insert(0, "fig_id", g.fig_id.iloc[0])
    return out


def merged_corners(corners: np.ndarray, fixed: np.ndarray, limit: float) -> np.ndarray:
    """Corners (x, y) after merging the nearest pair closer than ``limit`` again and again:
    to their mean, or to the one that is fixed. Two fixed corners are never merged."""
    points, held = [tuple(map(float, p)) for p in corners], [bool(f) for f in fixed]
    while len(points) > 1:
        d = [(np.hypot(points[i][0] - points[j][0], points[i][1] - points[j][1]), i, j) for i in range(len(points)) for j in range(i) if not (held[i] and held[j])]
        d = [x for x in d if x[0] < limit]
        if not d:
            break
        _, i, j = min(d)
        one = points[i] if held[i] else points[j] if held[j] else ((points[i][0] + points[j][0]) / 2, (points[i][1] + points[j][1]) / 2)
        keep = held[i] or held[j]
        for k in sorted((i, j), reverse=True):
            del points[k], held[k]
        points.append(one)
        held.append(keep)
    return np.array(points)


def corner_links(corners: DataFrame, bond: float, unit: float, limit: float) -> DataFrame:
    """Pairs of a figure's corners (fig_id, corner_id, x, y) that are as near as bonded atoms,
    for an average bond of ``bond`` pixels and ``unit`` length."""
    a, b = corners.alias("a"), corners.alias("b")
    d = F.sqrt(F.pow(F.col("a.x") - F.col("b.x"), 2) + F.pow(F.col("a.y") - F.col("b.y"), 2))
    near = (F.col("a.fig_id") == F.col("b.fig_id")) & (F.col("a.corner_id") < F.col("b.corner_id")) & (d / bond * unit < limit)
    return a.join(b, near).select("a.fig_id", F.col("a.corner_id").alias("src"), F.col("b.corner_id").alias("dst"))
