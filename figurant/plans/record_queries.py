"""Queries over records of figures, dictionaries and lists, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from figurant.config import DEFAULT as C
from figurant.functions import geometry as g
from figurant.functions import text
from figurant.operators import records, spatial
from figurant.plans import views
from figurant.plans.geometry_queries import _WIDE, _in, _inter, _wide
from figurant.plans.text_queries import _ENTITIES, _PIX, _binary
from figurant.plans.views import HEIGHT, LABELS_SQL, PANELS_SQL, WIDTH

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: Dictionaries as relations: species in the lines, superatoms in the labels.
SPECIES = ("K2CO3", "Et3N", "DMF", "OAc", "tert", "H2")
SUPERATOMS = ("-1", "1", " +", "a-", "5", "12")
_SPECIES = ", ".join(f"('{s}')" for s in SPECIES)
_SUPERATOMS = ", ".join(f"({i}, '{s}')" for i, s in enumerate(SUPERATOMS))


def register(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _text(items: str) -> F.Column:
    return F.array_join(F.transform(items, lambda x: x.cast("string")), ",")


_RECORDS = f"""WITH {PANELS_SQL}, recs AS (SELECT *, CASE WHEN pk % 3 = 0 THEN q END AS temperature, concat('c', pk % 7) AS cat FROM panels WHERE role IN ('conditions', 'label'))"""


@register(_RECORDS + " SELECT fig_id, array_to_string(list(cat ORDER BY panel_id), ',') AS catalysts, arg_min(temperature, panel_id) FILTER (temperature IS NOT NULL) AS temperature, min(t) AS t, min(l) AS l, max(b) AS b, max(r) AS r FROM recs GROUP BY 1")
def merged_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.panels(spark, sf_dir).where(F.col("role").isin("conditions", "label"))
    p = p.withColumn("catalysts", F.array(F.concat(F.lit("c"), (F.col("pk") % 7).cast("string")))).withColumn("temperature", F.when(F.col("pk") % 3 == 0, F.col("q")))
    return records.merged(p, "fig_id", "panel_id", ["catalysts"], ["temperature"]).withColumn("catalysts", _text("catalysts"))


@register(f"WITH {PANELS_SQL} SELECT fig_id, concat('R', pk % 3) AS name, array_to_string(flatten(list([pk % 11, pk % 13] ORDER BY panel_id)), ',') AS variants FROM panels GROUP BY 1, 2")
def merged_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.panels(spark, sf_dir)
    p = p.select("fig_id", "panel_id", F.create_map(F.concat(F.lit("R"), (F.col("pk") % 3).cast("string")), F.array(F.col("pk") % 11, F.col("pk") % 13)).alias("m"))
    return records.merged_maps(p, "fig_id", "panel_id", "m").select("fig_id", "name", _text("values").alias("variants"))


@register(f"WITH {PANELS_SQL} SELECT fig_id, panel_id, t, l, b, r FROM panels WHERE NOT (role = 'arrow' OR q < 10)")
def remaining_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.panels(spark, sf_dir)
    gone = p.where("role = 'arrow' or q < 10").select("fig_id", "panel_id")
    return records.without(p, gone, "fig_id", "panel_id").select("fig_id", "panel_id", "t", "l", "b", "r")


@register(f"WITH {PANELS_SQL} SELECT fig_id, panel_id, concat_ws(',', t, l, b, r, q, pk) AS items FROM panels")
def flattened_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.panels(spark, sf_dir)
    n = lambda *c: F.array(*(F.col(x).cast("long") for x in c))
    nested = F.array(F.array(n("t", "l"), n("b")), F.array(n("r", "q", "pk")))
    return p.select("fig_id", "panel_id", records.flattened(nested, 2).alias("items")).withColumn("items", _text("items"))


@register(f"WITH {PANELS_SQL} SELECT fig_id, panel_id, array_to_string([t, l, b, r][greatest(panel_id - 3, 0) + 1:greatest(q % 6 - 1, 0)], ',') AS items FROM panels")
def guarded_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.panels(spark, sf_dir)
    return p.select("fig_id", "panel_id", records.guarded_slice(F.array("t", "l", "b", "r"), F.col("panel_id") - 3, F.col("q") % 6 - 1).alias("items")).withColumn("items", _text("items"))


@register(f"WITH {PANELS_SQL} SELECT fig_id, panel_id, CASE WHEN pk % 5 >= sk % 5 THEN concat('a', q) ELSE concat('b', q) END AS text FROM panels")
def best_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.panels(spark, sf_dir)
    one = lambda c, name: F.struct((F.col(c) % 5).alias("confidence"), F.concat(F.lit(name), F.col("q").cast("string")).alias("text"))
    return p.select("fig_id", "panel_id", records.best_reading(F.array(one("pk", "a"), one("sk", "b"))).alias("text"))


@register(f"""WITH {PANELS_SQL}, d AS (SELECT *, concat('S', pk) AS smiles FROM panels WHERE role = 'diagram'),
  c AS (SELECT * FROM panels WHERE role = 'conditions'),
  f AS (SELECT c.fig_id, c.panel_id, list(d.smiles ORDER BY d.panel_id) AS found FROM c JOIN d ON c.fig_id = d.fig_id AND (d.panel_id + c.panel_id) % 2 = 0 GROUP BY 1, 2)
  SELECT c.fig_id, c.panel_id, concat_ws(',', concat('o', c.q), array_to_string(found, ',')) AS other_species FROM c LEFT JOIN f ON c.fig_id = f.fig_id AND c.panel_id = f.panel_id""")
def diagrams_in_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.panels(spark, sf_dir)
    d = p.where("role = 'diagram'").withColumn("smiles", F.concat(F.lit("S"), F.col("pk").cast("string")))
    c = p.where("role = 'conditions'").select("fig_id", "panel_id", F.array(F.concat(F.lit("o"), F.col("q").cast("string"))).alias("other_species"))
    boxes = d.groupBy("fig_id").agg(F.array_sort(F.collect_list(F.struct("panel_id", F.struct("t", "l", "b", "r").alias("box")))).alias("boxes"))
    inside = F.filter("boxes", lambda x: (x["panel_id"] + F.col("panel_id")) % 2 == 0)
    c = c.join(boxes, "fig_id", "left").withColumn("structure_panels", F.transform(inside, lambda x: x["box"])).drop("boxes")
    return records.with_structures(c, d).withColumn("other_species", _text("other_species"))


@register(f"WITH {_ENTITIES}, dict AS (SELECT * FROM (VALUES {_SPECIES}) v(value)) SELECT fig_id, panel_id, n, e AS entity, contains(e, '/') OR EXISTS (SELECT 1 FROM dict WHERE contains(e, value)) AS listed FROM ents")
def species_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.condition_lines(spark, sf_dir).select("fig_id", "panel_id", F.posexplode(text.entities(F.col("line"))).alias("n", "entity"))
    return records.listed(e, spark.createDataFrame([(s,) for s in SPECIES], "value string")).select("fig_id", "panel_id", "n", "entity", "listed")


@register(f"""WITH {LABELS_SQL}, dict AS (SELECT * FROM (VALUES {_SUPERATOMS}) v(position, value)),
  hits AS (SELECT text, arg_min(value, position) AS superatom FROM (SELECT DISTINCT text FROM texts) x JOIN dict ON contains(text, value) AND length(text) <= length(value) + 4 GROUP BY 1),
  regions AS (SELECT p.*, x.text, h.superatom FROM panels p JOIN texts x ON p.fig_id = x.fig_id AND p.panel_id = x.panel_id LEFT JOIN hits h ON x.text = h.text WHERE role <> 'diagram')
  SELECT a.fig_id, a.panel_id, a.superatom, a.superatom IS NOT NULL AND EXISTS (SELECT 1 FROM {_WIDE} b WHERE b.role = 'diagram' AND a.fig_id = b.fig_id AND {_inter('a', 'b')} / CAST((a.r - a.l) * (a.b - a.t) AS DOUBLE) > 0.9::DOUBLE) AS dropped FROM regions a""")
def superatom_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.panels(spark, sf_dir)
    named = records.superatom(views.label_texts(spark, sf_dir), spark.createDataFrame(list(enumerate(SUPERATOMS)), "position int, value string"))
    regions = p.where("role <> 'diagram'").select("fig_id", "panel_id", "t", "l", "b", "r").join(named, ["fig_id", "panel_id"])
    covered = spatial.semi(regions.where("superatom is not null"), _wide(p).where("role = 'diagram'"), lambda a, b: g.ioa(a, b) > C.ioa_filter).select("fig_id", "panel_id", F.lit(True).alias("d"))
    return regions.join(covered, ["fig_id", "panel_id"], "left").select("fig_id", "panel_id", "superatom", F.coalesce("d", F.lit(False)).alias("dropped"))


@register(f"WITH {PANELS_SQL} SELECT fig_id, CAST(l // 300 AS INTEGER) AS crop, arg_max(panel_id, (b - t) * (r - l) * 1000 - panel_id) AS panel_id FROM panels GROUP BY 1, 2")
def largest_in_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.largest(views.panels(spark, sf_dir).withColumn("crop", F.floor(F.col("l") / 300).cast("int")), "fig_id", "crop")


_HUGE = "(SELECT fig_id, panel_id, role, t - 400 AS t, l - 400 AS l, b + 400 AS b, r + 400 AS r FROM panels)"


@register(f"WITH {PANELS_SQL} SELECT fig_id, panel_id FROM {_HUGE} WHERE role = 'diagram' AND (fig_id % 4 = 0 OR CAST((b - t) * (r - l) AS DOUBLE) / {WIDTH * HEIGHT}.0::DOUBLE < 0.45::DOUBLE)")
def sized_diagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.panels(spark, sf_dir).where("role = 'diagram'")
    p = p.select("fig_id", "panel_id", (F.col("t") - 400).alias("t"), (F.col("l") - 400).alias("l"), (F.col("b") + 400).alias("b"), (F.col("r") + 400).alias("r"))
    return records.not_oversize(p, F.lit(float(WIDTH * HEIGHT)), F.col("fig_id") % 4 == 0, 0.45).select("fig_id", "panel_id")


@register(f"WITH {PANELS_SQL} SELECT a.fig_id, a.panel_id, count(*) AS n, min(c.t) AS t, min(c.l) AS l, max(c.b) AS b, max(c.r) AS r FROM {_WIDE} a JOIN panels c ON a.fig_id = c.fig_id AND {_in('a', 'c')} GROUP BY 1, 2")
def underlying_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.panels(spark, sf_dir)
    return records.merged_underlying(p, _wide(p))


@register(f"""WITH {PANELS_SQL}, s AS (SELECT fig_id, panel_id, CASE WHEN pk % 4 = 0 THEN '' ELSE concat('C', q) END AS re, CASE WHEN sk % 3 = 0 THEN '' ELSE concat('N', sk) END AS pr FROM panels)
  SELECT fig_id, arg_min(re, panel_id) AS reactants, arg_max(pr, panel_id) AS products, bool_or(re = '' OR pr = '') AS is_incomplete FROM s GROUP BY 1""")
def scheme_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.panels(spark, sf_dir)
    none = F.array().cast("array<string>")
    re = F.when(F.col("pk") % 4 == 0, none).otherwise(F.array(F.concat(F.lit("C"), F.col("q").cast("string"))))
    pr = F.when(F.col("sk") % 3 == 0, none).otherwise(F.array(F.concat(F.lit("N"), F.col("sk").cast("string"))))
    out = records.scheme_sides(p.select("fig_id", F.col("panel_id").alias("step_id"), re.alias("reactants"), pr.alias("products")))
    return out.withColumn("reactants", _text("reactants")).withColumn("products", _text("products"))


@register(f"WITH {_PIX} SELECT fig_id, y, x, CASE WHEN (y BETWEEN 2 AND 6 AND x BETWEEN 3 AND 9) OR (y BETWEEN 5 AND 12 AND x BETWEEN 8 AND 15) THEN v ELSE 0 END AS v FROM bn")
def isolated_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _binary(spark, sf_dir)
    boxes = F.explode(F.array(*(F.struct(*(F.lit(v).alias(c) for c, v in zip("tlbr", box, strict=True))) for box in ((2, 3, 6, 9), (5, 8, 12, 15)))))
    return records.isolated_patches(p, p.select("fig_id").distinct().select("fig_id", boxes.alias("x")).select("fig_id", "x.*"))


@register(f"WITH {PANELS_SQL} SELECT fig_id, panel_id FROM panels WHERE (b - t) * (r - l) > 100 * 20")
def gated_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.panels(spark, sf_dir).where((F.col("b") - F.col("t")) * (F.col("r") - F.col("l")) > C.ocr_piece_area * 20).select("fig_id", "panel_id")
