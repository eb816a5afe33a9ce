"""Views that give the driver's tables the shape of the extraction's relations.

Each view exists as a DataFrame and as the SQL text of common table expressions, so queries
and their SQL start from the same rows. Panels are keyed and partitioned by figure, which the
joins that follow reuse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH, HEIGHT = 1400, 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def role(panel_id: Column, flag: Column) -> Column:
    return F.when(panel_id == 1, "arrow").when(flag == "R", "diagram").when(flag == "A", "conditions").otherwise("label")


#: Unit directions of arrows by pk % 4, exact in binary or equal in both engines.
DIRECTIONS = ((1.0, 0.0), (0.0, 1.0), (0.6, 0.8), (-0.8, 0.6))


def panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fig_id, panel_id, pk, sk, q, t, l, b, r, role, dir_x, dir_y, long_side: one row per
    distinct order line. The one shuffle is by figure; the later joins need no other."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag").repartition("l_orderkey")
    p = rows.groupBy(F.col("l_orderkey").alias("fig_id"), F.col("l_linenumber").alias("panel_id")).agg(
        F.min("l_partkey").alias("pk"), F.min("l_suppkey").alias("sk"), F.min("l_quantity").cast("int").alias("q"), F.min("l_returnflag").alias("rf")
    )
    t = ((F.col("pk") * 37 + F.col("panel_id") * 101) % 900).cast("int")
    x = ((F.col("sk") * 53 + F.col("panel_id") * 211) % 1200).cast("int")
    p = p.withColumn("t", t).withColumn("l", x)
    p = p.withColumn("b", F.col("t") + 10 + F.col("q")).withColumn("r", F.col("l") + 10 + (F.col("pk") % 150).cast("int"))
    way = lambda i: F.element_at(F.array(*(F.lit(d[i]) for d in DIRECTIONS)), (F.col("pk") % 4 + 1).cast("int"))
    p = p.withColumn("role", role(F.col("panel_id"), F.col("rf"))).withColumn("dir_x", way(0)).withColumn("dir_y", way(1))
    return p.withColumn("long_side", F.greatest(F.col("r") - F.col("l"), F.col("b") - F.col("t")).cast("double")).drop("rf")


PANELS_SQL = """
base AS (SELECT l_orderkey AS fig_id, l_linenumber AS panel_id, min(l_partkey) AS pk, min(l_suppkey) AS sk,
                CAST(min(l_quantity) AS INTEGER) AS q, min(l_returnflag) AS rf FROM lineitem GROUP BY 1, 2),
boxes AS (SELECT *, CAST((pk * 37 + panel_id * 101) % 900 AS INTEGER) AS t, CAST((sk * 53 + panel_id * 211) % 1200 AS INTEGER) AS l FROM base),
panels AS (SELECT fig_id, panel_id, pk, sk, q, t, l, t + 10 + q AS b, CAST(l + 10 + pk % 150 AS INTEGER) AS r,
                  CASE WHEN panel_id = 1 THEN 'arrow' WHEN rf = 'R' THEN 'diagram' WHEN rf = 'A' THEN 'conditions' ELSE 'label' END AS role,
                  CASE pk % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.0::DOUBLE WHEN 2 THEN 0.6::DOUBLE ELSE -0.8::DOUBLE END AS dir_x,
                  CASE pk % 4 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.8::DOUBLE ELSE 0.6::DOUBLE END AS dir_y,
                  CAST(greatest(10 + pk % 150, 10 + q) AS DOUBLE) AS long_side FROM boxes)"""


def of_role(p: DataFrame, name: str) -> DataFrame:
    return p.where(F.col("role") == name)


def condition_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fig_id, panel_id, line: a conditions text for each panel, of several shapes."""
    p = panels(spark, sf_dir)
    n = lambda c: c.cast("string")
    pk, q, i = F.col("pk"), F.col("q"), F.col("panel_id")
    line = (
        F.when(pk % 5 == 0, F.concat(F.lit("base ("), n(q), F.lit(" equiv), cat ("), n(i), F.lit(" mol%), "), n(pk % 100), F.lit(" h, "), n(pk % 120), F.lit(" °C")))
        .when(pk % 5 == 1, F.concat(F.lit("K2CO3, DMF, rt, "), n(q), F.lit(" min, "), n(pk % 99), F.lit("%")))
        .when(pk % 5 == 2, F.concat(n(pk % 30), F.lit(" atm H2, reflux, 2,5 mL Et3N, "), n(q), F.lit(".5 h,")))
        .when(pk % 5 == 3, F.concat(F.lit("A,B/C, "), n(pk % 400), F.lit("K, gram scale, vacuum")))
        .otherwise(F.concat(F.lit("tert-butanol, "), n(q), F.lit(" days, Pd(OAc)2 (5 mol %)")))
    )
    return p.select("fig_id", "panel_id", line.alias("line"))


LINES_SQL = PANELS_SQL + """,
lines AS (SELECT fig_id, panel_id, CASE pk % 5
  WHEN 0 THEN concat('base (', q, ' equiv), cat (', panel_id, ' mol%), ', pk % 100, ' h, ', pk % 120, ' °C')
  WHEN 1 THEN concat('K2CO3, DMF, rt, ', q, ' min, ', pk % 99, '%')
  WHEN 2 THEN concat(pk % 30, ' atm H2, reflux, 2,5 mL Et3N, ', q, '.5 h,')
  WHEN 3 THEN concat('A,B/C, ', pk % 400, 'K, gram scale, vacuum')
  ELSE concat('tert-butanol, ', q, ' days, Pd(OAc)2 (5 mol %)') END AS line FROM panels)"""


def label_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fig_id, panel_id, text: labels of each shape, some without text."""
    p = panels(spark, sf_dir)
    pk, q = F.col("pk"), F.col("q")
    n = lambda c: c.cast("string")
    letter = lambda k: F.substr(F.lit("abcdefghijklmnopqrstuvwxyz"), (k % 26 + 1).cast("int"), F.lit(1))
    text = (
        F.when(pk % 5 == 0, n(pk % 20)).when(pk % 5 == 1, F.concat(n(pk % 20), letter(pk), F.lit("-"), letter(pk + q)))
        .when(pk % 5 == 2, F.concat(n(pk % 9), F.lit("-"), n(pk % 9 + q % 7 - 1))).when(pk % 5 == 3, F.concat(n(q), F.lit(" +")))
    )
    return p.select("fig_id", "panel_id", text.alias("text"))


LABELS_SQL = PANELS_SQL + """,
texts AS (SELECT fig_id, panel_id, CASE pk % 5
  WHEN 0 THEN CAST(pk % 20 AS VARCHAR)
  WHEN 1 THEN concat(pk % 20, substr('abcdefghijklmnopqrstuvwxyz', CAST(pk % 26 + 1 AS INTEGER), 1), '-', substr('abcdefghijklmnopqrstuvwxyz', CAST((pk + q) % 26 + 1 AS INTEGER), 1))
  WHEN 2 THEN concat(pk % 9, '-', pk % 9 + q % 7 - 1)
  WHEN 3 THEN concat(q, ' +') END AS text FROM panels)"""


def reaction_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fig_id, step_id, arrow_id, reactants, conditions, products: a chain through each order's
    lines, some of which share members."""
    p = panels(spark, sf_dir)
    i = F.col("panel_id")
    conditions = F.when(F.col("pk") % 3 == 0, F.array(F.lit(100) + i)).otherwise(F.array().cast("array<int>"))
    return p.select("fig_id", (i - 1).alias("step_id"), i.alias("arrow_id"), F.array(i % 3, i % 4).alias("reactants"), conditions.alias("conditions"), F.array((i + 1) % 3, (i + 1) % 4).alias("products"))


STEPS_SQL = PANELS_SQL + """,
steps AS (SELECT fig_id, panel_id - 1 AS step_id, panel_id AS arrow_id, pk % 3 = 0 AS has, panel_id AS i FROM panels),
placed AS (
  SELECT fig_id, step_id, 0 AS part, step_id * 3 AS pos, concat('D:', array_to_string(list_sort(list_distinct([i % 3, i % 4])), ':')) AS key FROM steps
  UNION ALL SELECT fig_id, step_id, 1, step_id * 3 + 1, CASE WHEN has THEN concat('C:', 100 + i) ELSE concat('P:', arrow_id) END FROM steps
  UNION ALL SELECT fig_id, step_id, 2, step_id * 3 + 2, concat('D:', array_to_string(list_sort(list_distinct([(i + 1) % 3, (i + 1) % 4])), ':')) FROM steps),
firsts AS (SELECT fig_id, key, min(pos) AS pos FROM placed GROUP BY 1, 2),
nodes AS (SELECT fig_id, key, CAST(row_number() OVER (PARTITION BY fig_id ORDER BY pos) - 1 AS INTEGER) AS node_id FROM firsts),
edges AS (SELECT fig_id, src, dst, pos FROM (SELECT p.fig_id, n.node_id AS src, lead(n.node_id) OVER (PARTITION BY p.fig_id, p.step_id ORDER BY p.part) AS dst, p.pos
          FROM placed p JOIN nodes n ON p.fig_id = n.fig_id AND p.key = n.key) WHERE dst IS NOT NULL)"""


def ocr_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lines (array of array of words) of each document."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", F.transform(F.split("text", "\n", -1), lambda x: F.split(x, " ", -1)).alias("lines"))
