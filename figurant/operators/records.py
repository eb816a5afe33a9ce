"""Records of figures: merging, dictionaries as relations, choices and guarded lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ordered(order: str, value: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda x: x["v"])


def merged(rows: DataFrame, key: str, order: str, lists: list[str], scalars: list[str]) -> DataFrame:
    """One record for each ``key``: lists joined in the order of ``order``, the first non-null of
    each scalar, and the union of the boxes (t, l, b, r)."""
    firsts = [F.min(F.when(F.col(c).isNotNull(), F.struct(order, c)))[c].alias(c) for c in scalars]
    box = [F.min("t").alias("t"), F.min("l").alias("l"), F.max("b").alias("b"), F.max("r").alias("r")]
    return rows.groupBy(key).agg(*(F.flatten(_ordered(order, F.col(c))).alias(c) for c in lists), *firsts, *box)


def merged_maps(rows: DataFrame, key: str, order: str, column: str) -> DataFrame:
    """key, name, values: maps of lists merged by appending the lists of equal names."""
    each = rows.select(key, order, F.explode(column).alias("name", "values"))
    return each.groupBy(key, "name").agg(F.flatten(_ordered(order, F.col("values"))).alias("values"))


def without(components: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    """The components that aren't listed in ``gone``."""
    return components.join(gone, list(keys), "left_anti")


def flattened(nested: Column, depth: int) -> Column:
    """A list of lists, ``depth`` levels of them, as one list."""
    for _ in range(depth):
        nested = F.flatten(nested)
    return nested


def guarded_slice(items: Column, start: Column, end: Column) -> Column:
    """``items[start:end]`` where negative bounds count as 0 instead of from the end."""
    low = F.greatest(start, F.lit(0))
    return F.slice(items, low + 1, F.greatest(F.greatest(end, F.lit(0)) - low, F.lit(0)))


def best_reading(readings: Column) -> Column:
    """Of readings (confidence, text) the surest; the first of equally sure ones."""
    numbered = F.transform(readings, lambda x, i: F.struct(x["confidence"].alias("confidence"), (-i).alias("o"), x["text"].alias("text")))
    return F.array_max(numbered)["text"]


def with_structures(conditions: DataFrame, diagrams: DataFrame) -> DataFrame:
    """``conditions`` (fig_id, panel_id, other_species, structure_panels: boxes t, l, b, r) with
    the names (smiles) of the diagrams that have such a box appended to ``other_species``, in the
    order of the boxes."""
    boxes = conditions.select("fig_id", "panel_id", F.posexplode("structure_panels").alias("pos", "box")).select("fig_id", "panel_id", "pos", "box.*")
    named = boxes.join(diagrams.select("fig_id", "t", "l", "b", "r", "smiles"), ["fig_id", "t", "l", "b", "r"])
    found = named.groupBy("fig_id", "panel_id").agg(_ordered("pos", F.col("smiles")).alias("found"))
    out = conditions.join(found, ["fig_id", "panel_id"], "left")
    return out.withColumn("other_species", F.when(F.col("found").isNull(), F.col("other_species")).otherwise(F.concat("other_species", "found"))).drop("found", "structure_panels")


def listed(entities: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``entities`` (with entity) with ``listed``: whether the entity has a slash or holds a value
    of the dictionary. A dictionary is a file of some hundred lines, which joins as a relation."""
    found = F.contains(F.col("entity"), F.col("value"))
    hits = entities.select("entity").distinct().join(dictionary.select("value").distinct(), found, "left_semi")
    marked = entities.join(hits.withColumn("hit", F.lit(True)), "entity", "left")
    return marked.withColumn("listed", F.contains("entity", F.lit("/")) | F.coalesce("hit", F.lit(False))).drop("hit")


def superatom(texts: DataFrame, dictionary: DataFrame, slack: int = 4) -> DataFrame:
    """``texts`` (with text) with ``superatom``: the first value of the dictionary (position,
    value) that the text holds without being more than ``slack`` characters longer, or null."""
    fits = F.contains(F.col("text"), F.col("value")) & (F.length("text") <= F.length("value") + slack)
    hits = texts.select("text").distinct().join(dictionary, fits).groupBy("text").agg(F.min(F.struct("position", "value"))["value"].alias("superatom"))
    return texts.join(hits, "text", "left")


def largest(components: DataFrame, *crop: str) -> DataFrame:
    """The component of the largest box in each crop; the first (least panel_id) of equals."""
    area = (F.col("b") - F.col("t")) * (F.col("r") - F.col("l"))
    return components.groupBy(*crop).agg(F.max(F.struct(area.alias("area"), (-F.col("panel_id")).alias("o"), "panel_id"))["panel_id"].alias("panel_id"))


def not_oversize(diagrams: DataFrame, figure_area: Column, diagrams_only: Column, share: float) -> DataFrame:
    """Diagrams that take less than ``share`` of their figure, or all where it holds only
    diagrams."""
    area = ((F.col("b") - F.col("t")) * (F.col("r") - F.col("l"))).cast("double")
    return diagrams.where(diagrams_only | (area / figure_area < share))


def merged_underlying(components: DataFrame, areas: DataFrame) -> DataFrame:
    """fig_id, panel_id, n, t, l, b, r: for each area the number and the union of the components
    that lie in it; areas without any are left out."""
    a, c = areas.alias("a"), components.alias("c")
    inside = (F.col("a.fig_id") == F.col("c.fig_id")) & (F.col("a.t") <= F.col("c.t")) & (F.col("a.l") <= F.col("c.l")) & (F.col("a.b") >= F.col("c.b")) & (F.col("a.r") >= F.col("c.r"))
    box = [F.min("c.t").alias("t"), F.min("c.l").alias("l"), F.max("c.b").alias("b"), F.max("c.r").alias("r")]
    return a.join(c, inside).groupBy("a.fig_id", "a.panel_id").agg(F.count("*").alias("n"), *box)


def scheme_sides(steps: DataFrame) -> DataFrame:
    """fig_id, reactants of the first step, products of the last, and is_incomplete: whether any
    step has lost a side."""
    lost = (F.size("reactants") == 0) | (F.size("products") == 0)
    return steps.groupBy("fig_id").agg(
        F.min(F.struct("step_id", "reactants"))["reactants"].alias("reactants"), F.max(F.struct("step_id", "products"))["products"].alias("products"), F.bool_or(lost).alias("is_incomplete")
    )


def isolated_patches(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """``pixels`` (fig_id, y, x, v) with v 0 outside the boxes, whose ends are included."""
    p, b = pixels.alias("p"), boxes.alias("b")
    inside = (F.col("p.fig_id") == F.col("b.fig_id")) & F.col("p.y").between(F.col("b.t"), F.col("b.b")) & F.col("p.x").between(F.col("b.l"), F.col("b.r"))
    kept = p.join(b, inside, "left_semi").select("fig_id", "y", "x", F.lit(True).alias("kept"))
    out = pixels.join(kept, ["fig_id", "y", "x"], "left")
    return out.select("fig_id", "y", "x", F.when(F.coalesce("kept", F.lit(False)), F.col("v")).otherwise(0).alias("v"))
