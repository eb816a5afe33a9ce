"""Reaction graphs: set-valued nodes, ordered edges, paths, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def canonical(ids: Column) -> Column:
    """The identity of a set-valued node: its sorted distinct members."""
    return F.array_sort(F.array_distinct(ids))


def step_nodes(steps: DataFrame) -> DataFrame:
    """fig_id, pos, key: for each step (fig_id, step_id, arrow_id, reactants, conditions,
    products) its three nodes in order. Steps without conditions have a placeholder that is
    named by their arrow."""
    tag = lambda p, a: F.array_join(F.concat(F.array(F.lit(p)), canonical(a).cast("array<string>")), ":")
    middle = F.when(F.coalesce(F.size("conditions"), F.lit(0)) > 0, tag("C", F.col("conditions"))).otherwise(F.concat(F.lit("P:"), F.col("arrow_id").cast("string")))
    keys = F.array(tag("D", F.col("reactants")), middle, tag("D", F.col("products")))
    return steps.select("fig_id", "step_id", F.posexplode(keys).alias("part", "key")).select("fig_id", "step_id", "part", (F.col("step_id") * 3 + F.col("part")).alias("pos"), "key")


def nodes(placed: DataFrame) -> DataFrame:
    """fig_id, key, node_id: dense numbers from 0 by first appearance."""
    first = placed.groupBy("fig_id", "key").agg(F.min("pos").alias("pos"))
    return first.withColumn("node_id", F.row_number().over(Window.partitionBy("fig_id").orderBy("pos")) - 1).select("fig_id", "key", "node_id")


def edges(placed: DataFrame, numbered: DataFrame) -> DataFrame:
    """fig_id, src, dst, pos: reactants to conditions to products; repeats are kept."""
    n = placed.join(numbered, ["fig_id", "key"])
    after = F.lead("node_id").over(Window.partitionBy("fig_id", "step_id").orderBy("part"))
    return n.withColumn("dst", after).where("dst is not null").select("fig_id", F.col("node_id").alias("src"), "dst", "pos")


def adjacency(edge_rows: DataFrame) -> DataFrame:
    """fig_id, src, successors in order of insertion."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "dst"))), lambda x: x["dst"])
    return edge_rows.groupBy("fig_id", "src").agg(ordered.alias("successors"))


def isolated(numbered: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """Nodes that no edge touches."""
    ends = edge_rows.select("fig_id", F.col("src").alias("node_id")).union(edge_rows.select("fig_id", "dst"))
    return numbered.join(ends, ["fig_id", "node_id"], "left_anti")


def paths(spark: SparkSession, edge_view: str, source: int, limit: int | None = None) -> DataFrame:
    """All simple paths from ``source`` in the view (src, dst): node, path. With ``limit`` only
    those of at most so many nodes. Where Spark's own bounds on recursion
    (``spark.sql.cteRecursionLevelLimit`` and ``RowLimit``) don't suffice, the query fails;
    no path is left out in silence."""
    bound = "" if limit is None else f" AND size(w.path) < {int(limit)}"
    return spark.sql(f"""
        WITH RECURSIVE walk(node, path) AS (
          SELECT CAST({int(source)} AS INT), array(CAST({int(source)} AS INT))
          UNION ALL
          SELECT e.dst, concat(w.path, array(e.dst)) FROM walk w JOIN {edge_view} e ON e.src = w.node
          WHERE NOT array_contains(w.path, e.dst){bound})
        SELECT node, path FROM walk""")


def exported(adjacent: DataFrame, members: DataFrame, incomplete: DataFrame) -> DataFrame:
    """fig_id and its JSON: adjacency by node id, node members, is_incomplete."""
    a = adjacent.groupBy("fig_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("src", "successors")))).alias("adjacency"))
    n = members.groupBy("fig_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "members"))), lambda x: x["members"]).alias("nodes"))
    j = a.join(n, "fig_id").join(incomplete, "fig_id")
    return j.select("fig_id", F.to_json(F.struct("adjacency", "nodes", "is_incomplete")).alias("json"))
