"""Detections: classes, scores, tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a detector's and the arrow classifier's classes stand for.
CLASSES = {0: "diagram", 1: "conditions", 2: "label"}
ARROWS = {1: "solid", 2: "equilibrium", 3: "resonance", 4: "curly"}


def named(cls: Column, names: dict[int, str]) -> Column:
    """The name of a class index; null for others, whose rows are dropped."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), cls)


def argmax(scores: Column) -> Column:
    """Index of the greatest score, the first of equal ones."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def above_score(detections: DataFrame, least: float) -> DataFrame:
    return detections.where(F.col("score") > least)


def below_percentile(boxes: DataFrame, main: DataFrame, p: float) -> DataFrame:
    """Boxes with an area under the main boxes' ``p`` quantile (linear). The quantile is one
    row, so it is broadcast."""
    area = (F.col("r") - F.col("l")) * (F.col("b") - F.col("t"))
    cut = main.agg(F.percentile(area, F.lit(p)).alias("cut"))
    return boxes.crossJoin(F.broadcast(cut)).where(area < F.col("cut")).drop("cut")


def tiles(figures: DataFrame, tile_height: int, tile_width: int, extension: int) -> DataFrame:
    """fig_id, tile_id, top, left, bottom, right of the overlapping tiles of figures (fig_id,
    width, height), row by row."""
    f = figures.withColumn("nh", F.ceil(F.col("height") / float(tile_height)).cast("int")).withColumn("nw", F.ceil(F.col("width") / float(tile_width)).cast("int"))
    f = f.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("nh") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nw") - 1)))
    cut = lambda k, size, n: F.floor(k * F.col(size) / F.col(n)).cast("int")
    return f.select(
        "fig_id", (F.col("i") * F.col("nw") + F.col("j")).alias("tile_id"),
        F.greatest(cut(F.col("i"), "height", "nh") - extension, F.lit(0)).alias("top"), F.greatest(cut(F.col("j"), "width", "nw") - extension, F.lit(0)).alias("left"),
        F.least(cut(F.col("i") + 1, "height", "nh") + extension, F.col("height")).alias("bottom"), F.least(cut(F.col("j") + 1, "width", "nw") + extension, F.col("width")).alias("right"),
    )


def from_tiles(detections: DataFrame, tile_rows: DataFrame) -> DataFrame:
    """Detections (fig_id, tile_id, x1, y1, x2, y2, ...) in figure coordinates."""
    o = tile_rows.select("fig_id", "tile_id", F.col("top").alias("__y"), F.col("left").alias("__x"))
    moved = {"x1": "__x", "x2": "__x", "y1": "__y", "y2": "__y"}
    d = detections.join(o, ["fig_id", "tile_id"])
    return d.select(*((F.col(c) + F.col(moved[c])).alias(c) if c in moved else c for c in detections.columns))


def combined(*parts: DataFrame) -> DataFrame:
    """All parts as one relation with ``source_rank``, their order."""
    out = parts[0].withColumn("source_rank", F.lit(0))
    for k, p in enumerate(parts[1:], 1):
        out = out.unionByName(p.withColumn("source_rank", F.lit(k)))
    return out
