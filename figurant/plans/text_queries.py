"""Queries over text, graphs and pixels, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from figurant.functions import text
from figurant.operators import graph, pixels
from figurant.plans import views
from figurant.plans.views import LABELS_SQL, LINES_SQL, PANELS_SQL, STEPS_SQL

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- conditions --------------------------------------------------------------------------

# The grammars without lookaround, for the engine of the SQL.
_NUM = r"((?:\d\.)?\d{1,3})"
_RULES = {
    "coreactants": _NUM + r"\s?(equivalents?|equiv\.?|eq\.?|m?L)",
    "catalysts": _NUM + r"\s?(mol\s?%|M|wt\s?%|%\s\w+)",
    "temperature": r"(?i)(-?\d{1,4}\s?)(\s?[o0°]C|K)|(r\.?\s?t\.?|heat|reflux|room\s?temp)(\s?[o0°]C|K)?",
    "time": r"(?:^|[^0-9A-Za-z_])" + _NUM + r"\s?(h(?:ours?)?|m(?:in)?|s(?:econds)?|days?)(?:$|\s?,)",
    "pressure": r"(\d{1,4}\s?)([mhkM]?Pa|m?bar|atm)|(U?HV|vacuum)([mhkM]?Pa|m?bar|atm)?",
    "yield": r"(\d{1,2}\s?)(%)|(gram scale)(%)?",
}
_ROUTE = "CASE " + " ".join(f"WHEN regexp_matches(e, '{p}') THEN '{k}'" for k, p in _RULES.items()) + " ELSE 'other_species' END"


def _group(k: str, i: int) -> str:
    pair = [i, i + 2] if k != "time" else [i]
    return "coalesce(" + ", ".join(f"nullif(regexp_extract(e, '{_RULES[k]}', {j}), '')" for j in pair) + ", '')"


_VALUE, _UNITS = ("CASE kind " + " ".join(f"WHEN '{k}' THEN {_group(k, i)}" for k in text.QUANTITIES) + " END" for i in (1, 2))
_ENTITIES = LINES_SQL + """,
split AS (SELECT fig_id, panel_id, string_split_regex(replace(replace(regexp_replace(line, ',(\\d)', chr(1) || '\\1', 'g'), ',', '#'), chr(1), ','), '#.') AS parts FROM lines),
ents AS (SELECT fig_id, panel_id, CAST(n AS INTEGER) AS n, trim(trim(parts[n + 1], '#')) AS e FROM (SELECT *, unnest(range(0, len(parts))) AS n FROM split)),
routed AS (SELECT *, """ + _ROUTE + f""" AS kind FROM ents),
valued AS (SELECT *, {_VALUE} AS v, {_UNITS} AS u FROM routed)"""


@register(f"WITH {_ENTITIES} SELECT fig_id, panel_id, n, e AS entity, kind, TRY_CAST(trim(v) AS DOUBLE) AS value_num, CASE WHEN v IS NOT NULL AND TRY_CAST(trim(v) AS DOUBLE) IS NULL THEN v END AS value_text, CASE WHEN v IS NOT NULL THEN coalesce(nullif(u, ''), 'N/A') END AS units FROM valued")
def condition_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.condition_lines(spark, sf_dir).select("fig_id", "panel_id", F.posexplode(text.entities(F.col("line"))).alias("n", "entity"))
    e = e.withColumn("kind", text.route(F.col("entity")))
    value = F
    for k in text.QUANTITIES:
        value = value.when(F.col("kind") == k, text.quantity(F.col("entity"), k))
    return e.withColumn("v", value).select("fig_id", "panel_id", "n", "entity", "kind", "v.value_num", "v.value_text", "v.units")


def _names(kind: str) -> str:
    return f"coalesce(array_to_string(list(e ORDER BY n) FILTER (kind = '{kind}'), ' | '), '')"


@register(f"WITH {_ENTITIES} SELECT fig_id, panel_id, {_names('catalysts')} AS catalysts, {_names('coreactants')} AS coreactants, {_names('other_species')} AS other_species, min(TRY_CAST(trim(v) AS DOUBLE)) FILTER (kind = 'temperature') AS coldest, CAST(count(*) FILTER (kind = 'time') AS INTEGER) AS times, CAST(nullif(count(*) FILTER (kind = 'yield'), 0) AS INTEGER) AS yields FROM valued GROUP BY 1, 2")
def parsed_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.condition_lines(spark, sf_dir).select("fig_id", "panel_id", text.parsed_conditions(F.array("line")).alias("c"))
    names = [F.array_join(f"c.{k}", " | ").alias(k) for k in ("catalysts", "coreactants", "other_species")]
    coldest = F.array_min(F.transform("c.temperature", lambda x: x["value_num"])).alias("coldest")
    return c.select("fig_id", "panel_id", *names, coldest, F.coalesce(F.size("c.time"), F.lit(0)).alias("times"), F.size(F.col("c")["yield"]).alias("yields"))


@register(f"WITH {_ENTITIES} SELECT fig_id, panel_id, n, kind, (contains(e, '/') OR contains(e, 'K2CO3') OR contains(e, 'Et3N')) AS listed, CAST(CASE WHEN regexp_matches(e, 'OAc') AND length(e) <= 3 + 20 THEN 0 WHEN regexp_matches(e, 'tert') THEN 1 END AS INTEGER) AS first_match FROM routed")
def dictionary_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.condition_lines(spark, sf_dir).select("fig_id", "panel_id", F.posexplode(text.entities(F.col("line"))).alias("n", "entity"))
    words = F.array(F.lit("/"), F.lit("K2CO3"), F.lit("Et3N"))
    listed = F.exists(words, lambda w: F.contains(F.col("entity"), w))
    first = F.when(F.col("entity").rlike("OAc") & (F.length("entity") <= 23), 0).when(F.col("entity").rlike("tert"), 1)
    return e.select("fig_id", "panel_id", "n", text.route(F.col("entity")).alias("kind"), listed.alias("listed"), first.alias("first_match"))


# --- labels ------------------------------------------------------------------------------

_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LET = r"\d+([A-Za-z])-([A-Za-z])$"
_TYPE = r"CASE WHEN text IS NULL THEN 'UNKNOWN' WHEN (length(text) < 8 AND regexp_matches(text, '\d+-\d+$')) OR regexp_matches(text, '\d+[A-Za-z]-[A-Za-z]$') THEN 'VARIANTS' ELSE 'SIMPLE' END"


@register(f"""WITH {LABELS_SQL}, typed AS (SELECT *, {_TYPE} AS type FROM texts) SELECT fig_id, panel_id, text, type,
  CASE WHEN type = 'SIMPLE' THEN text WHEN regexp_matches(text, '{_LET}') THEN regexp_extract(text, '(\\d+)[A-Za-z]-[A-Za-z]$', 1) END AS root,
  CASE WHEN type = 'VARIANTS' AND regexp_matches(text, '{_LET}') THEN substr('{_LETTERS}', CAST(strpos('{_LETTERS}', regexp_extract(text, '{_LET}', 1)) AS INTEGER), CAST(greatest(0, strpos('{_LETTERS}', regexp_extract(text, '{_LET}', 2)) - strpos('{_LETTERS}', regexp_extract(text, '{_LET}', 1)) + 1) AS INTEGER))
       WHEN type = 'VARIANTS' THEN array_to_string(range(CAST(regexp_extract(text, '(\\d+)-(\\d+)$', 1) AS INTEGER), CAST(regexp_extract(text, '(\\d+)-(\\d+)$', 2) AS INTEGER) + 1), '') END AS variants,
  coalesce(regexp_matches(text, '\\+') AND length(text) < 4, false) AS plus_sign, nullif(regexp_extract(text, '^\\d+'), '') AS digits FROM typed""")
def label_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.label_texts(spark, sf_dir)
    c = F.col("text")
    return t.select("fig_id", "panel_id", "text", text.label_type(c).alias("type"), text.label_root(c).alias("root"), F.array_join(text.label_variants(c), "").alias("variants"), text.is_plus_sign(c).alias("plus_sign"), text.leading_digits(c).alias("digits"))


@register(f"WITH {LABELS_SQL} SELECT a.fig_id, a.panel_id, b.panel_id AS other_id FROM texts a JOIN texts b ON a.fig_id = b.fig_id AND a.panel_id < b.panel_id AND nullif(regexp_extract(a.text, '^\\d+'), '') = nullif(regexp_extract(b.text, '^\\d+'), '')")
def similar_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.label_texts(spark, sf_dir).withColumn("d", text.leading_digits(F.col("text")))
    a, b = t.alias("a"), t.alias("b")
    on = (F.col("a.fig_id") == F.col("b.fig_id")) & (F.col("a.d") == F.col("b.d")) & (F.col("a.panel_id") < F.col("b.panel_id"))
    return a.join(b, on).select("a.fig_id", "a.panel_id", F.col("b.panel_id").alias("other_id"))


# --- recognised text ---------------------------------------------------------------------

_OCR = """docs AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
ls AS (SELECT doc_id, CAST(k AS INTEGER) AS line_no, ls[k + 1] AS line FROM (SELECT *, unnest(range(0, len(ls))) AS k FROM docs)),
counted AS (SELECT *, CAST(len(string_split(line, ' ')) AS INTEGER) AS n_words FROM ls)"""


@register(f"WITH {_OCR} SELECT doc_id, line_no, n_words, CAST(coalesce(sum(n_words) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset_, string_split(line, ' ')[1] AS first_word FROM counted")
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.ocr_trees(spark, sf_dir).select("doc_id", F.posexplode("lines").alias("line_no", "words")).withColumn("n_words", F.size("words"))
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return t.select("doc_id", "line_no", "n_words", F.coalesce(F.sum("n_words").over(before), F.lit(0)).alias("offset_"), F.element_at("words", 1).alias("first_word"))


_WORDS = _OCR + """, ws AS (SELECT doc_id, line_no, w, hash_ % 101 AS conf FROM (SELECT doc_id, line_no, w, length(w) * 37 + line_no * 11 AS hash_ FROM (SELECT doc_id, line_no, unnest(string_split(line, ' ')) AS w FROM ls)))"""


@register(f"WITH {_WORDS} SELECT doc_id, CAST(count(*) FILTER (conf > 70) AS BIGINT) AS sure, CAST(count(*) FILTER (conf <= 70) AS BIGINT) AS again, round(avg(conf), 6) AS confidence, CAST(sum(length(regexp_replace(w, '[^A-Za-z0-9+-]', '', 'g'))) AS BIGINT) AS allowed FROM ws GROUP BY 1")
def gated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.ocr_trees(spark, sf_dir).select("doc_id", F.posexplode("lines").alias("line_no", "words")).select("doc_id", "line_no", F.explode("words").alias("w"))
    t = t.withColumn("conf", (F.length("w") * 37 + F.col("line_no") * 11) % 101)
    return t.groupBy("doc_id").agg(F.count_if(F.col("conf") > 70).alias("sure"), F.count_if(F.col("conf") <= 70).alias("again"), F.round(F.avg("conf"), 6).alias("confidence"), F.sum(F.length(text.whitelisted(F.col("w"), "A-Za-z0-9+-"))).alias("allowed"))


@register("SELECT p_partkey, array_to_string(list_transform([p_size % 5, p_partkey % 5, 0, 4, 9], lambda i: CASE i WHEN 1 THEN 'C' WHEN 2 THEN 'O' WHEN 3 THEN '(=O)' ELSE '' END), '') AS smiles FROM part")
def decoded_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.table(spark, sf_dir, "part")
    tokens = F.array(F.col("p_size") % 5, (F.col("p_partkey") % 5).cast("int"), F.lit(0), F.lit(4), F.lit(9))
    return p.select("p_partkey", text.decoded_tokens(tokens, {0: "<start>", 1: "C", 2: "O", 3: "(=O)", 4: "<end>"}).alias("smiles"))


# --- graphs ------------------------------------------------------------------------------


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    placed = graph.step_nodes(views.reaction_steps(spark, sf_dir))
    numbered = graph.nodes(placed)
    return placed, numbered, graph.edges(placed, numbered)


@register(f"WITH {STEPS_SQL} SELECT fig_id, key, node_id FROM nodes")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir)[1]


@register(f"WITH {STEPS_SQL} SELECT fig_id, src, dst, CAST(pos AS INTEGER) AS pos FROM edges")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir)[2]


@register(f"WITH {STEPS_SQL} SELECT fig_id, src, array_to_string(list(dst ORDER BY pos), ' ') AS successors FROM edges GROUP BY 1, 2")
def graph_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.adjacency(_graph(spark, sf_dir)[2]).withColumn("successors", F.array_join(F.col("successors").cast("array<string>"), " "))


@register(f"WITH {STEPS_SQL} SELECT n.fig_id, n.node_id, n.key FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.fig_id = n.fig_id AND e.src <> e.dst AND (e.src = n.node_id OR e.dst = n.node_id))")
def isolated_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, numbered, edges = _graph(spark, sf_dir)
    return graph.isolated(numbered, edges.where("src <> dst"))


@register(f"""WITH {STEPS_SQL}, adj AS (SELECT fig_id, src, concat('"', src, '":[', array_to_string(list(dst ORDER BY pos), ','), ']') AS s FROM edges GROUP BY 1, 2),
  a AS (SELECT fig_id, concat('{{', array_to_string(list(s ORDER BY src), ','), '}}') AS a FROM adj GROUP BY 1), n AS (SELECT fig_id, concat('["', array_to_string(list(key ORDER BY node_id), '","'), '"]') AS n FROM nodes GROUP BY 1),
  i AS (SELECT fig_id, bool_or(NOT has) AS f FROM steps GROUP BY 1)
  SELECT a.fig_id, concat('{{"adjacency":', a, ',"nodes":', n, ',"is_incomplete":', CASE WHEN f THEN 'true' ELSE 'false' END, '}}') AS json FROM a JOIN n ON a.fig_id = n.fig_id JOIN i ON a.fig_id = i.fig_id""")
def exported_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = views.reaction_steps(spark, sf_dir)
    _, numbered, edges = _graph(spark, sf_dir)
    lost = steps.groupBy("fig_id").agg(F.bool_or(F.size("conditions") == 0).alias("is_incomplete"))
    return graph.exported(graph.adjacency(edges), numbered.withColumnRenamed("key", "members"), lost)


@register("""WITH RECURSIVE e AS (SELECT DISTINCT CAST(n_regionkey AS INTEGER) AS src, CAST(5 + n_nationkey AS INTEGER) AS dst FROM nation UNION SELECT CAST(5 + n_nationkey AS INTEGER), CAST(n_nationkey % 3 AS INTEGER) FROM nation),
  walk(node, path) AS (SELECT 1::INTEGER, [1::INTEGER] UNION ALL SELECT e.dst, list_append(w.path, e.dst) FROM walk w JOIN e ON e.src = w.node WHERE NOT list_contains(w.path, e.dst))
  SELECT node, array_to_string(path, '>') AS path FROM walk""")
def graph_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = views.table(spark, sf_dir, "nation")
    there = n.select(F.col("n_regionkey").cast("int").alias("src"), (F.col("n_nationkey") + 5).cast("int").alias("dst"))
    back = n.select((F.col("n_nationkey") + 5).cast("int"), (F.col("n_nationkey") % 3).cast("int"))
    view = f"figurant_edges_{uuid.uuid4().hex}"
    there.union(back).distinct().createOrReplaceTempView(view)
    return graph.paths(spark, view, 1).select("node", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@register(f"WITH {PANELS_SQL} SELECT fig_id, panel_id, concat(CASE WHEN pk % 4 = 0 THEN '???' ELSE concat('C', q) END, ' + ', 'O', '  -->  ', CASE WHEN sk % 3 = 0 THEN '???' ELSE concat('N', sk) END) AS step FROM panels")
def step_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.panels(spark, sf_dir)
    left = F.array(F.when(F.col("pk") % 4 != 0, F.concat(F.lit("C"), F.col("q").cast("string"))), F.lit("O"))
    right = F.array(F.when(F.col("sk") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("N"), F.col("sk").cast("string"))))
    return p.select("fig_id", "panel_id", text.step_text(left, right).alias("step"))


# --- pixels ------------------------------------------------------------------------------


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A figure of 20 by 20 pixels for each 400 customers."""
    c = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    v = F.when((F.col("k") * 7919) % 11 < 7, F.lit(252)).otherwise(((F.col("k") * 7919) % 200).cast("int"))
    return c.select(F.floor(F.col("k") / 400).alias("fig_id"), F.floor(F.col("k") % 400 / 20).cast("int").alias("y"), (F.col("k") % 20).cast("int").alias("x"), v.alias("v"))


_PIX = """px AS (SELECT c_custkey // 400 AS fig_id, CAST(c_custkey % 400 // 20 AS INTEGER) AS y, CAST(c_custkey % 20 AS INTEGER) AS x, CAST(CASE WHEN c_custkey * 7919 % 11 < 7 THEN 252 ELSE c_custkey * 7919 % 200 END AS INTEGER) AS v FROM customer),
md AS (SELECT fig_id, v AS mode FROM (SELECT fig_id, v, row_number() OVER (PARTITION BY fig_id ORDER BY count(*) DESC, v) AS k FROM px GROUP BY 1, 2) WHERE k = 1),
fl AS (SELECT p.fig_id, y, x, CAST(CASE WHEN mode BETWEEN 250 AND 255 THEN 255 - v ELSE v END AS INTEGER) AS v FROM px p JOIN md ON p.fig_id = md.fig_id),
ends AS (SELECT fig_id, min(v) AS lo, max(v) AS hi FROM fl GROUP BY 1),
nm AS (SELECT f.fig_id, y, x, CAST(trunc((v - lo) * 255.0::DOUBLE / nullif(CAST(hi - lo AS DOUBLE), 0)) AS INTEGER) AS v FROM fl f JOIN ends e ON f.fig_id = e.fig_id),
bn AS (SELECT fig_id, y, x, CASE WHEN v > 70 THEN 255 ELSE 0 END AS v FROM nm)"""


def _binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.binarised(pixels.normalised(pixels.with_background(_pixels(spark, sf_dir), 0)), 70)


@register(f"WITH {_PIX} SELECT * FROM bn")
def binary_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _binary(spark, sf_dir)


@register(f"WITH {_PIX} SELECT DISTINCT fig_id, y + dy AS y, x + dx AS x FROM (SELECT fig_id, y, x, unnest([-1, 0, 0, 0, 1]) AS dy, unnest([0, -1, 0, 1, 0]) AS dx FROM bn WHERE v > 0) WHERE y + dy >= 0 AND x + dx >= 0")
def dilated_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.dilated(_binary(spark, sf_dir), 1)


@register(f"WITH {_PIX}, ar AS (SELECT DISTINCT fig_id, CAST(1 AS INTEGER) AS panel_id, 3 AS t, 4 AS l, 11 AS b, 30 AS r FROM px) SELECT a.fig_id, a.panel_id, count(p.v) / 208.0::DOUBLE AS ratio FROM ar a LEFT JOIN bn p ON p.fig_id = a.fig_id AND p.v > 0 AND p.y BETWEEN 3 AND 10 AND p.x BETWEEN 4 AND 29 GROUP BY 1, 2")
def pixel_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _binary(spark, sf_dir)
    areas = p.select("fig_id").distinct().select("fig_id", F.lit(1).alias("panel_id"), *(F.lit(v).alias(c) for c, v in zip("tlbr", (3, 4, 11, 30), strict=True)))
    return pixels.pixel_ratio(p, areas)


@register(f"WITH {_PIX} SELECT fig_id, CAST(trunc(avg(x)) AS INTEGER) AS x, CAST(trunc(avg(y)) AS INTEGER) AS y FROM bn WHERE v > 200 GROUP BY 1")
def centers_of_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.center_of_mass(_binary(spark, sf_dir))


@register(f"WITH {_PIX} SELECT fig_id, y, x, CASE WHEN y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 9 THEN 0 ELSE v END AS v FROM bn")
def erased_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _binary(spark, sf_dir)
    areas = p.select("fig_id").distinct().select("fig_id", *(F.lit(v).alias(c) for c, v in zip("tlbr", (2, 2, 5, 9), strict=True)))
    return pixels.erased(p, areas)


@register()
def pixel_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.components(_binary(spark, sf_dir), 70)
