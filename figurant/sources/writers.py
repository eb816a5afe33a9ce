"""Results as JSON, one record per figure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def save_graphs(exported: DataFrame, folder: str) -> None:
    """Write (fig_id, json) as text, a folder per figure; what was there is replaced."""
    exported.select("fig_id", F.col("json").alias("value")).write.mode("overwrite").partitionBy("fig_id").text(folder)


def diagrams_json(diagrams: DataFrame) -> DataFrame:
    """fig_id, json: for figures without arrows the list of smiles, panel and labels of their
    diagrams (fig_id, panel_id, smiles, t, l, b, r, labels)."""
    panel = F.array("t", "l", "b", "r").alias("panel")
    row = F.struct("panel_id", F.struct("smiles", panel, "labels").alias("d"))
    return diagrams.groupBy("fig_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["d"])).alias("json"))


def conditions_text(parsed: Column) -> Column:
    """'key : value' lines of the fields that hold something, between dashed rules."""
    rule = "-" * 20
    names = ("catalysts", "coreactants", "other_species", "temperature", "pressure", "time", "yield")
    line = lambda k: F.when(F.size(parsed[k]) > 0, F.concat(F.lit(f"{k} : "), F.to_json(parsed[k])))
    return F.concat_ws("\n", F.lit(rule), *(line(k) for k in names), F.lit(rule))


def rectangles(panels: DataFrame) -> DataFrame:
    """What an overlay would draw: fig_id, role, x, y, width, height."""
    return panels.select("fig_id", "role", F.col("l").alias("x"), F.col("t").alias("y"), (F.col("r") - F.col("l")).alias("width"), (F.col("b") - F.col("t")).alias("height"))
