"""The extraction, composed from the operators, for detections that a model has made."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figurant.config import DEFAULT, Config
from figurant.functions import geometry as g
from figurant.functions import text
from figurant.functions.geometry import box
from figurant.operators import cluster, detections, graph, probe, spatial


def arrow_candidates(components: DataFrame, scores: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Typed arrows: components and pairs of them with their class scores (fig_id, panel_id,
    scores); background goes, as do tiny curly arrows and solid ones inside an equilibrium."""
    kind = detections.named(detections.argmax(F.col("scores")), detections.ARROWS)
    typed = components.join(scores.select("fig_id", "panel_id", kind.alias("arrow_type")), ["fig_id", "panel_id"]).where("arrow_type is not null")
    share = g.area(box()) / (F.col("fig_width") * F.col("fig_height")).cast("double") * 100
    typed = typed.where((F.col("arrow_type") != "curly") | (share >= config.curly_area_percent))
    solid, double = typed.where("arrow_type = 'solid'"), typed.where("arrow_type = 'equilibrium'")
    free = spatial.anti(solid, double, lambda a, b: g.contains(b, a))
    order = [free, typed.where("arrow_type = 'curly'"), typed.where("arrow_type = 'resonance'"), double]
    return detections.combined(*order)


class Regions(NamedTuple):
    diagrams: DataFrame
    conditions: DataFrame
    labels: DataFrame


def text_regions(candidates: DataFrame, arrows: DataFrame, diagrams: DataFrame, config: Config = DEFAULT) -> Regions:
    """Final classes of text regions (fig_id, panel_id, box, role, text) with their parents.
    Figures without arrows keep all their text as labels."""
    key = ["fig_id", "panel_id"]
    judged = spatial.reclassified(candidates, arrows, diagrams, config.reclassify_factor)
    some = arrows.select("fig_id").distinct().withColumn("__arrows", F.lit(True))
    roles = candidates.drop("role").join(candidates.select(*key, F.col("role").alias("prior")), key).join(judged, key, "left").join(some, "fig_id", "left")
    final = F.when(F.col("__arrows").isNull(), F.lit("label")).otherwise(F.coalesce("role", "prior"))
    roles = roles.withColumn("role", final).drop("prior", "__arrows").where(~text.is_plus_sign(F.col("text")))
    kept = lambda name: roles.join(spatial.without_duplicates(roles.where(F.col("role") == name)).select(*key), key, "left_semi")
    labels = kept("label")
    below = spatial.nearest(labels, diagrams).select(*key, "parent_id")
    labels = labels.join(below, key, "left")
    moved = spatial.reparented_labels(labels.where("parent_id is not null"), diagrams, config.label_reassignment_distance)
    labels = labels.drop("parent_id").join(moved, key, "left")
    conditions = kept("conditions")
    near = spatial.nearest(conditions, arrows).where(F.col("dist") < config.conditions_arrow_distance).select(*key, F.col("parent_id").alias("arrow_id"))
    most = diagrams.groupBy("fig_id").agg(F.max(g.area(box())).alias("__most"))
    fits = g.area(box()) < config.conditions_area_fraction * F.col("__most")
    conditions = conditions.join(near, key).join(most, "fig_id").where(fits).drop("__most")
    conditions = conditions.withColumn("parsed", text.parsed_conditions(F.split("text", "\n", -1)))
    return Regions(diagrams, conditions, labels)


def completed(priors: DataFrame, components: DataFrame, pixel_share: Column, config: Config = DEFAULT) -> DataFrame:
    """Diagram priors grown to the components inside them after dilation: fig_id, panel_id and
    the union box, without those that would cover too much of the figure."""
    steps = g.dilation_steps(pixel_share)
    grown = priors.select("fig_id", "panel_id", *((F.col(c) - steps if c in "tl" else F.col(c) + steps).alias(c) for c in "tlbr"), "fig_width", "fig_height")
    j = spatial.pairs(grown, components.select("fig_id", "panel_id", "t", "l", "b", "r"), g.overlaps).select("a.fig_id", "a.panel_id", "a.fig_width", "a.fig_height", "b.t", "b.l", "b.b", "b.r")
    out = spatial.unions(j, "fig_id", "panel_id", "fig_width", "fig_height")
    share = g.area(box()) / (F.col("fig_width") * F.col("fig_height")).cast("double")
    return spatial.drop_contained(out.where(share < config.diagram_area_fraction))


def reaction_steps(arrows: DataFrame, diagrams: DataFrame, conditions: DataFrame, fig_width: int, fig_height: int, step: float = 50.0, config: Config = DEFAULT) -> DataFrame:
    """fig_id, step_id, arrow_id, reactants, conditions, products, single_line: what a scan to
    both sides of each arrow finds. A side without a find is looked for in the next row of
    diagrams (products) or the one before (reactants), from the figure's edge."""
    leads = spatial.neighbourhoods(arrows, config.arrow_cluster_distance)
    arrows = arrows.join(leads, ["fig_id", "panel_id"], "left_semi")
    probes = probe.probe_distance(arrows, config.least_probe_distance, config.probe_factor)
    w, h = F.lit(float(fig_width)), F.lit(float(fig_height))

    def found(starts: DataFrame, switch: int) -> DataFrame:
        points = probe.scan_points(starts, F.lit(step), w, h, switch)
        stops = probe.blocked_at(points, arrows, F.least(F.lit(step * 4), F.lit(50.0)))
        hits = probe.found_diagrams(probe.open_points(points, stops), probes, diagrams)
        return hits.groupBy("fig_id", F.col("panel_id").alias("arrow_id")).agg(F.sort_array(F.collect_set("diagram_id")).alias("found"))

    ahead, behind = found(arrows, 1), found(arrows, -1)
    c = arrows.select("fig_id", F.col("panel_id").alias("arrow_id"))
    sides = c.join(ahead.withColumnRenamed("found", "products"), ["fig_id", "arrow_id"], "left").join(behind.withColumnRenamed("found", "reactants"), ["fig_id", "arrow_id"], "left")
    sides = sides.withColumn("single_line", F.col("products").isNotNull() & F.col("reactants").isNotNull())

    y = lambda d: d.select("fig_id", "panel_id", g.center(box()).y.alias("cy"))
    eps = diagrams.groupBy("fig_id").agg((F.avg(g.height(box())) * config.row_eps_factor).alias("eps"))
    rows = y(diagrams).withColumn("seed", F.lit(False)).union(y(arrows).withColumn("seed", F.lit(True)))
    placed = cluster.islands(rows.join(eps, "fig_id"), "fig_id", "cy", F.col("eps"), "panel_id")
    near = cluster.adjacent_rows(placed.where("seed"), cluster.row_centers(placed, "fig_id", "cy"), "fig_id", "cy")
    edge = lambda level, x, lost, switch: found(
        arrows.join(near, ["fig_id", "panel_id"]).join(sides.where(F.col(lost).isNull()).select("fig_id", F.col("arrow_id").alias("panel_id")), ["fig_id", "panel_id"], "left_semi")
        .where(F.col(level).isNotNull()).withColumn("t", F.col(level)).withColumn("b", F.col(level)).withColumn("l", F.lit(x)).withColumn("r", F.lit(x)), switch)
    more_products = edge("below", 0, "products", 1).withColumnRenamed("found", "next")
    more_reactants = edge("above", fig_width, "reactants", -1).withColumnRenamed("found", "previous")
    out = sides.join(more_products, ["fig_id", "arrow_id"], "left").join(more_reactants, ["fig_id", "arrow_id"], "left")
    none = F.array().cast("array<int>")
    text_of = conditions.groupBy("fig_id", "arrow_id").agg(F.sort_array(F.collect_list("panel_id")).alias("conditions"))
    out = out.join(text_of, ["fig_id", "arrow_id"], "left")
    return out.select("fig_id", F.col("arrow_id").alias("step_id"), "arrow_id", F.coalesce("reactants", "previous", none).alias("reactants"), F.coalesce("conditions", none).alias("conditions"), F.coalesce("products", "next", none).alias("products"), "single_line")


def scheme(steps: DataFrame) -> DataFrame:
    """fig_id, json: the figures' graphs; incomplete where a step lost a side."""
    placed = graph.step_nodes(steps)
    numbered = graph.nodes(placed)
    edges = graph.edges(placed, numbered)
    lost = steps.groupBy("fig_id").agg(F.bool_or((F.size("reactants") == 0) | (F.size("products") == 0)).alias("is_incomplete"))
    return graph.exported(graph.adjacency(edges), numbered.withColumnRenamed("key", "members"), lost)
