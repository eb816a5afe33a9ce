"""One-dimensional clusters and rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(points: DataFrame, key: str, value: str, eps: Column, order: str) -> DataFrame:
    """Density clusters of points on a line with at least two members: sorted, they part where
    a gap exceeds ``eps``. Adds ``island`` (numbered by value within ``key``) and ``cluster``:
    the island, or -1 for single points, which form one pooled cluster."""
    w = Window.partitionBy(key).orderBy(value, order)
    gap = F.col(value) - F.lag(value).over(w)
    p = points.withColumn("__break", F.when(gap > eps, 1).otherwise(0))
    p = p.withColumn("island", F.sum("__break").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__break")
    size = F.count("*").over(Window.partitionBy(key, "island"))
    return p.withColumn("cluster", F.when(size > 1, F.col("island")).otherwise(-1))


def row_centers(clustered: DataFrame, key: str, value: str) -> DataFrame:
    return clustered.groupBy(key, "cluster").agg(F.avg(value).alias("center"))


def adjacent_rows(seeds: DataFrame, centers: DataFrame, key: str, value: str) -> DataFrame:
    """For each seed (key, id, value, own cluster) the nearest row center below and above it."""
    j = seeds.alias("s").join(centers.alias("c"), (F.col(f"s.{key}") == F.col(f"c.{key}")) & (F.col("s.cluster") != F.col("c.cluster")), "left")
    below = F.min(F.when(F.col("c.center") > F.col(f"s.{value}"), F.col("c.center")))
    above = F.max(F.when(F.col("c.center") < F.col(f"s.{value}"), F.col("c.center")))
    return j.groupBy(f"s.{key}", "s.panel_id").agg(below.alias("below"), above.alias("above"))


def pruned_points(points: Column, limit: Column) -> Column:
    """Points (array of x, y) kept in order if farther than ``limit`` from all kept before."""
    far = lambda kept, p: F.forall(kept, lambda q: F.sqrt(((p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"])).cast("double")) > limit)
    return F.aggregate(points, F.slice(points, 1, 0), lambda kept, p: F.when(far(kept, p), F.concat(kept, F.array(p))).otherwise(kept))
