"""Queries over boxes: measures, relations, filters, joins, aggregates; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from figurant.config import DEFAULT as C
from figurant.functions import geometry as g
from figurant.functions.geometry import Box, Point, box
from figurant.operators import cluster, detections, probe, spatial
from figurant.plans import views
from figurant.plans.views import HEIGHT, PANELS_SQL, WIDTH, of_role

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- SQL fragments -----------------------------------------------------------------------


def _edge(a: str, b: str) -> str:
    dx = f"greatest({a}.l - {b}.r, {b}.l - {a}.r, 0)"
    dy = f"greatest({a}.t - {b}.b, {b}.t - {a}.b, 0)"
    return f"sqrt(CAST({dx} * {dx} + {dy} * {dy} AS DOUBLE))"


def _len(dx: str, dy: str) -> str:
    return f"sqrt(CAST(({dx}) * ({dx}) + ({dy}) * ({dy}) AS DOUBLE))"


def _faithful(a: str, b: str) -> str:
    left, right, bottom, top = f"{b}.r < {a}.l", f"{a}.r < {b}.l", f"{a}.b < {b}.t", f"{b}.b < {a}.t"
    return (
        f"CASE WHEN {bottom} AND {left} THEN {_len(f'{b}.r - {a}.l', f'{b}.t - {a}.t')} WHEN {bottom} AND {right} THEN {_len(f'{b}.l - {a}.r', f'{b}.t - {a}.t')} "
        f"WHEN {right} AND {top} THEN {_len(f'{b}.l - {a}.r', f'{b}.b - {a}.b')} ELSE {_edge(a, b)} END"
    )


def _cx(a: str) -> str:
    return f"(({a}.l + {a}.r) / 2.0::DOUBLE)"


def _cy(a: str) -> str:
    return f"(({a}.t + {a}.b) / 2.0::DOUBLE)"


def _center_sep(a: str, b: str) -> str:
    return _len(f"{_cx(a)} - {_cx(b)}", f"{_cy(a)} - {_cy(b)}")


def _in(a: str, b: str) -> str:
    """a contains b"""
    return f"({a}.t <= {b}.t AND {a}.l <= {b}.l AND {a}.b >= {b}.b AND {a}.r >= {b}.r)"


def _inter(a: str, b: str) -> str:
    return f"(greatest(least({a}.r, {b}.r) - greatest({a}.l, {b}.l), 0) * greatest(least({a}.b, {b}.b) - greatest({a}.t, {b}.t), 0))"


def _area(a: str) -> str:
    return f"(({a}.r - {a}.l) * ({a}.b - {a}.t))"


def _angle(a: str, b: str) -> str:
    d = _len(f"{_cx(b)} - {_cx(a)}", f"{_cy(b)} - {_cy(a)}")
    return f"degrees(acos(({_cy(b)} - {_cy(a)}) / greatest({d}, 1e-5::DOUBLE)))"


def _normal(w: str, o: str) -> str:
    unit = _len(f"{w}.dir_x", f"{w}.dir_y")

    def gap(dx: str, dy: str, far: str, sign: str) -> str:
        a = f"({w}.long_side / 2.0::DOUBLE * {far}::DOUBLE / {unit})"
        return _len(f"({_cx(w)} {sign} {a} * {dx}) - {_cx(o)}", f"({_cy(w)} {sign} {a} * {dy}) - {_cy(o)}")

    axis = [gap(f"{w}.dir_x", f"{w}.dir_y", "1.5", s) for s in "+-"]
    normal = [gap(f"(-{w}.dir_y)", f"{w}.dir_x", "0.5", s) for s in "+-"]
    return f"(least({', '.join(normal)}) < least({', '.join(axis)}))"


_PAIR = "FROM panels a JOIN panels b ON a.fig_id = b.fig_id AND a.panel_id <> b.panel_id"


def _sql(body: str) -> str:
    """The body over the panels view; a body that starts with a comma adds expressions."""
    return f"WITH {PANELS_SQL}{body}" if body.startswith(",") else f"WITH {PANELS_SQL}\n{body}"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.panels(spark, sf_dir)
    return spatial.pairs(p, p).where("a.panel_id <> b.panel_id")


def _ids() -> list:
    return [F.col("a.fig_id"), F.col("a.panel_id"), F.col("b.panel_id").alias("other_id")]


_SIDS = "a.fig_id, a.panel_id, b.panel_id AS other_id"


# --- measures ----------------------------------------------------------------------------


@register(_sql("""SELECT fig_id, panel_id, r - l AS width, b - t AS height, (r - l) * (b - t) AS area, (r - l) / CAST(b - t AS DOUBLE) AS aspect_ratio,
  2 * (b - t) + 2 * (r - l) AS perimeter, sqrt(CAST((r - l) * (r - l) + (b - t) * (b - t) AS DOUBLE)) AS diagonal, (l + r) / 2.0::DOUBLE AS center_x, (t + b) / 2.0::DOUBLE AS center_y,
  CAST(round_even((l + r) / 2.0::DOUBLE, 0) AS INTEGER) AS mid_x, CAST(round_even((t + b) / 2.0::DOUBLE, 0) AS INTEGER) AS mid_y, concat('[', t, ', ', l, ', ', b, ', ', r, ']') AS panel FROM panels"""))
def box_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = box()
    c, m = g.center(a), g.rounded_center(a)
    return views.panels(spark, sf_dir).select("fig_id", "panel_id", g.width(a).alias("width"), g.height(a).alias("height"), g.area(a).alias("area"), g.aspect_ratio(a).alias("aspect_ratio"), g.perimeter(a).alias("perimeter"), g.diagonal(a).alias("diagonal"), c.x.alias("center_x"), c.y.alias("center_y"), m.x.alias("mid_x"), m.y.alias("mid_y"), g.text_of(a).alias("panel"))


@register(_sql(f"SELECT {_SIDS}, {_edge('a', 'b')} AS intended, {_faithful('a', 'b')} AS faithful, {_center_sep('a', 'b')} AS centers {_PAIR}"))
def edge_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = box("a"), box("b")
    return _pairs(spark, sf_dir).select(*_ids(), g.edge_separation(a, b).alias("intended"), g.edge_separation(a, b, faithful=True).alias("faithful"), g.center_separation(a, b).alias("centers"))


@register(_sql(f"""SELECT {_SIDS}, b.b < a.t AS above, b.r < a.l AS leftward, a.b < b.t AS below, a.r < b.l AS rightward, {_in('a', 'b')} AS contains,
  ({_cx('b')} BETWEEN a.l AND a.r AND {_cy('b')} BETWEEN a.t AND a.b) AS contains_center,
  (least(a.r, b.r) > greatest(a.l, b.l) AND least(a.b, b.b) > greatest(a.t, b.t)) AS overlaps, least(a.r, b.r) > greatest(a.l, b.l) AS overlaps_vertically,
  {_inter('a', 'b')} / CAST({_area('a')} AS DOUBLE) AS ioa, {_inter('a', 'b')} / CAST({_area('a')} + {_area('b')} - {_inter('a', 'b')} AS DOUBLE) AS iou,
  CASE WHEN least(a.t + a.b, b.t + b.b) < greatest(a.t, b.t) OR least(a.l + a.r, b.l + b.r) < greatest(a.l, b.l) THEN 0.0::DOUBLE
       ELSE CAST((least(a.t + a.b, b.t + b.b) - greatest(a.t, b.t)) * (least(a.l + a.r, b.l + b.r) - greatest(a.l, b.l)) AS DOUBLE)
            / nullif(CAST(a.b * a.r + b.b * b.r - (least(a.t + a.b, b.t + b.b) - greatest(a.t, b.t)) * (least(a.l + a.r, b.l + b.r) - greatest(a.l, b.l)) AS DOUBLE), 0) END AS iou_faithful {_PAIR}"""))
def box_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = box("a"), box("b")
    o = g.orientation(a, b)
    return _pairs(spark, sf_dir).select(*_ids(), o.top.alias("above"), o.left.alias("leftward"), o.bottom.alias("below"), o.right.alias("rightward"), g.contains(a, b).alias("contains"), g.contains_point(a, g.center(b)).alias("contains_center"), g.overlaps(a, b).alias("overlaps"), g.overlaps_vertically(a, b).alias("overlaps_vertically"), g.ioa(a, b).alias("ioa"), g.iou(a, b).alias("iou"), g.iou(a, b, faithful=True).alias("iou_faithful"))


@register(_sql(f"SELECT {_SIDS}, round({_angle('a', 'b')}, 6) AS angle, {_normal('a', 'b')} AS on_normal {_PAIR} WHERE a.role = 'arrow'"))
def directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = box("a"), box("b")
    rows = _pairs(spark, sf_dir).where("a.role = 'arrow'")
    return rows.select(*_ids(), F.round(g.direction_angle(g.center(a), g.center(b)), 6).alias("angle"), g.lies_along_normal(a, F.col("a.dir_x"), F.col("a.dir_y"), F.col("a.long_side"), b).alias("on_normal"))


@register(_sql(f"""SELECT {_SIDS}, (b.t - a.t) / nullif(CAST(b.l - a.l AS DOUBLE), 0) AS slope, a.t - (b.t - a.t) / nullif(CAST(b.l - a.l AS DOUBLE), 0) * a.l AS intercept, {_len('b.l - a.l', 'b.t - a.t')} AS separation,
  CAST(abs((b.l - a.l) * (a.t - a.b) - (a.l - a.r) * (b.t - a.t)) AS DOUBLE) / nullif({_len('b.l - a.l', 'b.t - a.t')}, 0) AS corner_distance,
  (a.l + 10.0::DOUBLE / {_len('a.dir_x', 'a.dir_y')} * a.dir_x) AS ahead_x, (a.t - 10.0::DOUBLE / {_len('a.dir_x', 'a.dir_y')} * a.dir_y) AS behind_y {_PAIR}"""))
def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, q, c = Point(F.col("a.l"), F.col("a.t")), Point(F.col("b.l"), F.col("b.t")), Point(F.col("a.r"), F.col("a.b"))
    ahead, behind = g.points_on_line(p, F.col("a.dir_x"), F.col("a.dir_y"), F.lit(10.0))
    return _pairs(spark, sf_dir).select(*_ids(), g.slope(p, q).alias("slope"), g.intercept(p, q).alias("intercept"), g.length(q.x - p.x, q.y - p.y).alias("separation"), g.line_distance(c, p, q).alias("corner_distance"), ahead.x.alias("ahead_x"), behind.y.alias("behind_y"))


@register(_sql("""SELECT fig_id, panel_id, k AS n, CAST(CASE WHEN steep THEN ax + off ELSE ax + k END AS INTEGER) AS x, CAST(CASE WHEN steep THEN ay + k ELSE ay + off END AS INTEGER) AS y FROM (
  SELECT *, floor((2 * k * rise + run) / CAST(greatest(2 * run, 1) AS DOUBLE)) * way AS off FROM (
    SELECT fig_id, panel_id, steep, ax, ay, run, rise, way, unnest(range(0, CASE WHEN dx = 0 THEN run ELSE run + 1 END)) AS k FROM (
      SELECT fig_id, panel_id, w AS dx, h >= w AS steep, l AS ax, t AS ay, CASE WHEN h >= w THEN h ELSE w END AS run, CASE WHEN h >= w THEN w ELSE h END AS rise, 1 AS way
      FROM (SELECT fig_id, panel_id, l, t, r - l AS w, b - t AS h FROM panels WHERE role = 'arrow'))))"""))
def line_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = of_role(views.panels(spark, sf_dir), "arrow")
    pixels = g.raster(Point(F.col("l"), F.col("t")), Point(F.col("r"), F.col("b")))
    return p.select("fig_id", "panel_id", F.posexplode(pixels).alias("n", "p")).select("fig_id", "panel_id", F.col("n").cast("long").alias("n"), "p.x", "p.y")


@register(_sql(f"""SELECT fig_id, panel_id, CAST(round_even(t / 1.5::DOUBLE, 0) AS INTEGER) AS original_t, CAST(round_even(r / 1.5::DOUBLE, 0) AS INTEGER) AS original_r, t + 20 - 3 AS main_t, b + 20 - 3 AS main_b, b + 20 - 6 AS main_b_faithful,
  t - 20 AS crop_t, r - 30 AS crop_r, greatest(t - 50, 0) AS wide_t, least(b + 50, {HEIGHT}) AS wide_b, least(r + 50, {WIDTH}) AS wide_r, CAST(trunc(t * 1.37::DOUBLE) AS INTEGER) AS det_t, CAST(trunc(r * 1.37::DOUBLE) AS INTEGER) AS det_r FROM panels"""))
def coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, crop, pad = box(), Box(F.lit(20), F.lit(30), F.lit(500), F.lit(700)), F.lit(3)
    o, m, f, c = g.unscaled(a, F.lit(1.5)), g.in_main(a, crop, pad, pad), g.in_main(a, crop, pad, pad, faithful=True), g.in_crop(a, crop)
    e, d = g.extended(a, C.dilation_extent, F.lit(WIDTH), F.lit(HEIGHT)), g.rescaled_detection(a.l, a.t, a.r, a.b, F.lit(1.37))
    return views.panels(spark, sf_dir).select("fig_id", "panel_id", o.t.alias("original_t"), o.r.alias("original_r"), m.t.alias("main_t"), m.b.alias("main_b"), f.b.alias("main_b_faithful"), c.t.alias("crop_t"), c.r.alias("crop_r"), e.t.alias("wide_t"), e.b.alias("wide_b"), e.r.alias("wide_r"), d.t.alias("det_t"), d.r.alias("det_r"))


@register(_sql(f"""SELECT {_SIDS}, least(a.t, b.t) AS union_t, greatest(a.r, b.r) AS union_r,
  CASE WHEN least(a.r, b.r) >= greatest(a.l, b.l) AND least(a.b, b.b) >= greatest(a.t, b.t) THEN greatest(a.t, b.t) END AS common_t,
  CASE WHEN least(a.r, b.r) >= greatest(a.l, b.l) AND least(a.b, b.b) >= greatest(a.t, b.t) THEN least(a.r, b.r) END AS common_r {_PAIR}"""))
def merged_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, i = g.union_box(box("a"), box("b")), g.intersection_box(box("a"), box("b"))
    return _pairs(spark, sf_dir).select(*_ids(), u.t.alias("union_t"), u.r.alias("union_r"), i.t.alias("common_t"), i.r.alias("common_r"))


@register(_sql("""SELECT fig_id, bool_and(abs(s) > 10) OR coalesce(stddev_pop(s), 0) <= 0.5 AS consistent, round(avg(s), 6) AS mean_slope
  FROM (SELECT fig_id, (b - t) / CAST(r - l AS DOUBLE) AS s FROM panels) GROUP BY fig_id"""))
def slope_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = g.slope(Point(F.col("l"), F.col("t")), Point(F.col("r"), F.col("b")))
    rows = views.panels(spark, sf_dir).select("fig_id", s.alias("s"))
    return rows.groupBy("fig_id").agg((F.bool_and(F.abs("s") > 10) | (F.coalesce(F.stddev_pop("s"), F.lit(0.0)) <= 0.5)).alias("consistent"), F.round(F.avg("s"), 6).alias("mean_slope"))


@register(_sql("""SELECT fig_id, panel_id, round((x - avg(x) OVER w) / nullif(stddev_pop(x) OVER w, 0), 6) AS z, (x - min(x) OVER w) / nullif(CAST(max(x) OVER w - min(x) OVER w AS DOUBLE), 0) AS unit
  FROM (SELECT fig_id, panel_id, (r - l) * (b - t) AS x FROM panels) WINDOW w AS (PARTITION BY fig_id)"""))
def standardised_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("fig_id")
    x = views.panels(spark, sf_dir).select("fig_id", "panel_id", g.area(box()).alias("x"))
    z = F.try_divide(F.col("x") - F.avg("x").over(w), F.stddev_pop("x").over(w))
    unit = F.try_divide((F.col("x") - F.min("x").over(w)).cast("double"), (F.max("x").over(w) - F.min("x").over(w)).cast("double"))
    return x.select("fig_id", "panel_id", F.round(z, 6).alias("z"), unit.alias("unit"))


@register("""SELECT a.vec_id, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(CAST(a.embedding[i] - b.embedding[i] AS DOUBLE), 2)))), 4) AS distance,
  round(sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE), 2)))), 4) AS distance_double
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def euclidean_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "embeddings")
    j = e.alias("a").join(e.alias("b"), F.col("b.vec_id") == F.col("a.vec_id") + 1)
    wide = lambda c: F.col(c).cast("array<double>")
    return j.select("a.vec_id", F.round(g.euclidean(F.col("a.embedding"), F.col("b.embedding")), 4).alias("distance"), F.round(g.euclidean(wide("a.embedding"), wide("b.embedding")), 4).alias("distance_double"))


# --- filters -----------------------------------------------------------------------------


def _detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 5).alias("scores"))
    return e.select("vec_id", detections.argmax(F.col("scores")).alias("cls"), F.array_max("scores").alias("score"))


_DET = "dets AS (SELECT vec_id, CAST(list_position(s, list_max(s)) - 1 AS INTEGER) AS cls, list_max(s) AS score FROM (SELECT vec_id, embedding[1:5] AS s FROM embeddings))"


@register(f"WITH {_DET} SELECT vec_id, cls, CASE cls WHEN 1 THEN 'solid' WHEN 2 THEN 'equilibrium' WHEN 3 THEN 'resonance' WHEN 4 THEN 'curly' END AS arrow_type, CASE cls WHEN 0 THEN 'diagram' WHEN 1 THEN 'conditions' WHEN 2 THEN 'label' END AS role FROM dets WHERE score > 0.1::FLOAT")
def classified_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections.above_score(_detections(spark, sf_dir), F.lit(0.1).cast("float"))
    return d.select("vec_id", "cls", detections.named(F.col("cls"), detections.ARROWS).alias("arrow_type"), detections.named(F.col("cls"), detections.CLASSES).alias("role"))


@register(_sql(f"""SELECT fig_id, panel_id, (r - l) * (b - t) < {C.component_area_fraction} * {WIDTH * HEIGHT} AS plausible, r > l AND b > t AS has_pixels, (r - l) * (b - t) / {WIDTH * HEIGHT}.0::DOUBLE < 0.005::DOUBLE AS small_enough,
  NOT ((r - l) * (b - t) / {WIDTH * HEIGHT}.0::DOUBLE * 100 < {C.curly_area_percent}::DOUBLE) AS curly_enough, role <> 'arrow' AS allowed FROM panels"""))
def component_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = g.area(box())
    part = a / float(WIDTH * HEIGHT)
    return views.panels(spark, sf_dir).select("fig_id", "panel_id", (a < C.component_area_fraction * WIDTH * HEIGHT).alias("plausible"), ((F.col("r") > F.col("l")) & (F.col("b") > F.col("t"))).alias("has_pixels"), (part < 0.005).alias("small_enough"), (~(part * 100 < C.curly_area_percent)).alias("curly_enough"), (F.col("role") != "arrow").alias("allowed"))


@register(_sql(f"""SELECT c.fig_id, c.panel_id FROM panels c WHERE c.role = 'conditions'
  AND {_area('c')} < {C.conditions_area_fraction} * (SELECT max({_area('d')}) FROM panels d WHERE d.role = 'diagram' AND d.fig_id = c.fig_id)
  AND (SELECT min({_edge('c', 'w')}) FROM panels w WHERE w.role = 'arrow' AND w.fig_id = c.fig_id) < 200"""))
def clean_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.panels(spark, sf_dir)
    regions, most = of_role(p, "conditions"), of_role(p, "diagram").groupBy("fig_id").agg(F.max(g.area(box())).alias("most"))
    near = spatial.nearest(regions, of_role(p, "arrow")).where("dist < 200")
    fit = regions.join(most, "fig_id").where(g.area(box()) < C.conditions_area_fraction * F.col("most"))
    return fit.join(near.select("fig_id", "panel_id"), ["fig_id", "panel_id"], "left_semi").select("fig_id", "panel_id")


@register(_sql("SELECT fig_id, panel_id FROM panels WHERE role = 'label' AND (r - l) * (b - t) < (SELECT quantile_cont((r - l) * (b - t), 0.2) FROM panels WHERE role = 'diagram')"))
def small_tile_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.panels(spark, sf_dir)
    return detections.below_percentile(of_role(p, "label"), of_role(p, "diagram"), C.tile_area_percentile).select("fig_id", "panel_id")


# --- joins -------------------------------------------------------------------------------


@register(_sql(f"""SELECT fig_id, panel_id, parent_id, dist FROM (SELECT a.fig_id, a.panel_id, b.panel_id AS parent_id, {_edge('a', 'b')} AS dist,
  row_number() OVER (PARTITION BY a.fig_id, a.panel_id ORDER BY {_edge('a', 'b')}, b.panel_id) AS k FROM panels a JOIN panels b ON a.fig_id = b.fig_id WHERE a.role = 'label' AND b.role = 'diagram') WHERE k = 1"""))
def nearest_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.panels(spark, sf_dir)
    return spatial.nearest(of_role(p, "label"), of_role(p, "diagram")).select("fig_id", "panel_id", "parent_id", "dist")


@register(_sql(f"""SELECT a.fig_id, a.panel_id, n.parent_id FROM panels a LEFT JOIN (SELECT a.fig_id, a.panel_id, b.panel_id AS parent_id,
  row_number() OVER (PARTITION BY a.fig_id, a.panel_id ORDER BY {_edge('a', 'b')}, b.panel_id) AS k FROM panels a JOIN panels b ON a.fig_id = b.fig_id
  WHERE a.role = 'label' AND b.role = 'diagram' AND ((least(a.r, b.r) > greatest(a.l, b.l) AND least(a.b, b.b) > greatest(a.t, b.t)) OR b.b < a.t)) n
  ON a.fig_id = n.fig_id AND a.panel_id = n.panel_id AND n.k = 1 WHERE a.role = 'label'"""))
def nearest_parent_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.panels(spark, sf_dir)
    on = lambda a, b: g.overlaps(a, b) | g.orientation(a, b).top
    return spatial.nearest(of_role(p, "label"), of_role(p, "diagram"), eligible=on, keep_lonely=True).select("fig_id", "panel_id", "parent_id")


@register(_sql(f"""SELECT fig_id, panel_id, parent_id, CAST(k AS INTEGER) AS rank FROM (SELECT a.fig_id, a.panel_id, b.panel_id AS parent_id,
  row_number() OVER (PARTITION BY a.fig_id, a.panel_id ORDER BY {_edge('a', 'b')}, b.panel_id) AS k FROM panels a JOIN panels b ON a.fig_id = b.fig_id WHERE a.role = 'conditions' AND b.role = 'diagram') WHERE k <= 2"""))
def two_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.panels(spark, sf_dir)
    return spatial.nearest(of_role(p, "conditions"), of_role(p, "diagram"), 2).select("fig_id", "panel_id", "parent_id", "rank")


@register(_sql(f"""SELECT fig_id, panel_id, other_id, t, l, b, r FROM (SELECT a.fig_id, a.panel_id, b.panel_id AS other_id, least(a.t, b.t) AS t, least(a.l, b.l) AS l, greatest(a.b, b.b) AS b, greatest(a.r, b.r) AS r,
  {_edge('a', 'b')} AS e, row_number() OVER (PARTITION BY a.fig_id, a.panel_id ORDER BY {_center_sep('a', 'b')}, b.panel_id) AS k FROM panels a JOIN panels b ON a.fig_id = b.fig_id AND b.panel_id > a.panel_id) WHERE k = 1 AND e < 150"""))
def later_component_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.later_pairs(views.panels(spark, sf_dir), 150.0)


_ATTACHED = f"""att AS (SELECT a.fig_id, b.panel_id AS arrow_id, list_sort(list(a.panel_id)) AS ids, min(a.t) AS t, min(a.l) AS l, max(a.b) AS b, max(a.r) AS r
  FROM panels a JOIN panels b ON a.fig_id = b.fig_id WHERE a.role = 'diagram' AND b.role = 'arrow' AND {_normal('b', 'a')} AND {_edge('a', 'b')} < 300 GROUP BY 1, 2)"""


@register(_sql(f""", {_ATTACHED}, c AS (SELECT fig_id, 1 AS arrow_id, panel_id, t, l, b, r, row_number() OVER (PARTITION BY fig_id ORDER BY panel_id) AS k FROM panels WHERE role = 'conditions')
  SELECT coalesce(c.fig_id, d.fig_id) AS fig_id, coalesce(c.arrow_id, d.arrow_id) AS arrow_id, c.panel_id, array_to_string(coalesce(d.ids, []), ' ') AS diagram_ids,
  least(coalesce(c.t, d.t), coalesce(d.t, c.t)) AS t, least(coalesce(c.l, d.l), coalesce(d.l, c.l)) AS l, greatest(coalesce(c.b, d.b), coalesce(d.b, c.b)) AS b, greatest(coalesce(c.r, d.r), coalesce(d.r, c.r)) AS r
  FROM c FULL JOIN att d ON c.fig_id = d.fig_id AND c.arrow_id = d.arrow_id AND c.k = 1"""))
def attached_diagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.panels(spark, sf_dir)
    attached = spatial.attached_diagrams(of_role(p, "diagram"), of_role(p, "arrow"), 300.0)
    conditions = of_role(p, "conditions").select("fig_id", F.lit(1).alias("arrow_id"), "panel_id", "t", "l", "b", "r")
    return spatial.upsert_conditions(conditions, attached).withColumn("diagram_ids", F.array_join(F.col("diagram_ids").cast("array<string>"), " "))


@register(_sql(f", {_ATTACHED} SELECT p.fig_id, p.panel_id FROM panels p WHERE p.role = 'diagram' AND NOT EXISTS (SELECT 1 FROM (SELECT fig_id, unnest(ids) AS id FROM att) x WHERE x.fig_id = p.fig_id AND x.id = p.panel_id)"))
def free_diagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.panels(spark, sf_dir)
    used = spatial.attached_diagrams(of_role(p, "diagram"), of_role(p, "arrow"), 300.0).select("fig_id", F.explode("diagram_ids").alias("panel_id"))
    return of_role(p, "diagram").join(used, ["fig_id", "panel_id"], "left_anti").select("fig_id", "panel_id")


@register(_sql(f"SELECT a.fig_id, a.panel_id FROM panels a WHERE NOT EXISTS (SELECT 1 FROM panels b WHERE a.fig_id = b.fig_id AND a.panel_id <> b.panel_id AND {_in('b', 'a')} AND NOT ({_in('a', 'b')} AND a.panel_id < b.panel_id))"))
def uncontained_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.drop_contained(views.panels(spark, sf_dir)).select("fig_id", "panel_id")


_WIDE = "(SELECT fig_id, panel_id, role, t - 60 AS t, l - 60 AS l, b + 60 AS b, r + 60 AS r FROM panels)"


def _wide(p: DataFrame) -> DataFrame:
    return p.select("fig_id", "panel_id", "role", (F.col("t") - 60).alias("t"), (F.col("l") - 60).alias("l"), (F.col("b") + 60).alias("b"), (F.col("r") + 60).alias("r"))


@register(_sql(f"""SELECT a.fig_id, a.panel_id, EXISTS (SELECT 1 FROM {_WIDE} b WHERE b.role = 'diagram' AND a.fig_id = b.fig_id AND {_in('b', 'a')}) AS shadowed,
  EXISTS (SELECT 1 FROM {_WIDE} b WHERE b.role = 'diagram' AND a.fig_id = b.fig_id AND {_inter('a', 'b')} / CAST({_area('a')} AS DOUBLE) > 0.9::DOUBLE) AS covered,
  EXISTS (SELECT 1 FROM {_WIDE} b WHERE b.role = 'diagram' AND a.fig_id = b.fig_id AND {_inter('a', 'b')} / CAST({_area('a')} + {_area('b')} - {_inter('a', 'b')} AS DOUBLE) >= 0.2::DOUBLE) AS alike
  FROM panels a WHERE a.role <> 'diagram'"""))
def shadow_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.panels(spark, sf_dir)
    regions, diagrams = p.where("role <> 'diagram'").select("fig_id", "panel_id", "t", "l", "b", "r"), of_role(_wide(p), "diagram")
    free = spatial.anti(regions, diagrams, lambda a, b: g.contains(b, a)).select("fig_id", "panel_id", F.lit(False).alias("s"))
    covered = spatial.semi(regions, diagrams, lambda a, b: g.ioa(a, b) > C.ioa_filter).select("fig_id", "panel_id", F.lit(True).alias("c"))
    unlike = spatial.anti(regions, diagrams, lambda a, b: g.iou(a, b) >= 0.2).select("fig_id", "panel_id", F.lit(False).alias("i"))
    key = ["fig_id", "panel_id"]
    out = regions.join(free, key, "left").join(covered, key, "left").join(unlike, key, "left")
    return out.select(*key, F.coalesce("s", F.lit(True)).alias("shadowed"), F.coalesce("c", F.lit(False)).alias("covered"), F.coalesce("i", F.lit(True)).alias("alike"))


@register(_sql(f"""SELECT fig_id, panel_id, component_id FROM (SELECT a.fig_id, a.panel_id, b.panel_id AS component_id,
  row_number() OVER (PARTITION BY a.fig_id, a.panel_id ORDER BY {_area('b')}, b.panel_id) AS k FROM panels a JOIN {_WIDE} b ON a.fig_id = b.fig_id AND {_in('b', 'a')} WHERE a.role = 'label') WHERE k = 1"""))
def smallest_containing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.panels(spark, sf_dir)
    return spatial.smallest_containing(of_role(p, "label"), _wide(p))


@register(_sql(f"""SELECT a.fig_id, a.panel_id, (SELECT arg_max(b.role, b.panel_id) FROM {_WIDE} b WHERE a.fig_id = b.fig_id AND {_in('b', 'a')} AND b.role <> 'label') AS role FROM panels a"""))
def component_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.panels(spark, sf_dir)
    return spatial.assigned_roles(p.select("fig_id", "panel_id", "t", "l", "b", "r"), _wide(p).where("role <> 'label'"), F.col("role"))


@register(_sql(f"""SELECT DISTINCT fig_id, panel_id FROM (SELECT a.fig_id, b.panel_id, row_number() OVER (PARTITION BY a.fig_id, a.panel_id ORDER BY b.l, b.panel_id) AS k
  FROM panels a JOIN panels b ON a.fig_id = b.fig_id AND {_edge('a', 'b')} < 120) WHERE k = 1"""))
def arrow_neighbourhoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.panels(spark, sf_dir)
    return spatial.neighbourhoods(p, 120.0)


@register(_sql("""SELECT DISTINCT a.fig_id, a.panel_id, b.panel_id AS other_id FROM panels a JOIN panels b ON a.fig_id = b.fig_id AND a.panel_id < b.panel_id AND greatest(a.t, b.t) < least(a.b, b.b) AND greatest(a.l, b.l) < least(a.r, b.r)"""))
def pixel_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.panels(spark, sf_dir)
    return spatial.shared_pixels(p, p).where("panel_id < other_id")


@register(_sql(f"""SELECT a.fig_id, a.panel_id, CASE WHEN a.ad <= a.dd AND a.ad < a.lim AND {_normal('w', 'a')} THEN 'conditions' WHEN a.dd < a.ad AND a.dd < a.lim AND {_angle('a', 'd')} > 135 THEN 'label' ELSE a.role END AS role
  FROM (SELECT c.*, x.parent_id AS aid, x.dist AS ad, y.parent_id AS did, y.dist AS dd, sqrt(CAST({_area('c')} AS DOUBLE)) * 6.0::DOUBLE AS lim FROM panels c
    JOIN (SELECT a.fig_id, a.panel_id, b.panel_id AS parent_id, {_edge('a', 'b')} AS dist, row_number() OVER (PARTITION BY a.fig_id, a.panel_id ORDER BY {_edge('a', 'b')}, b.panel_id) AS k FROM panels a JOIN panels b ON a.fig_id = b.fig_id AND b.role = 'arrow') x ON x.k = 1 AND x.fig_id = c.fig_id AND x.panel_id = c.panel_id
    JOIN (SELECT a.fig_id, a.panel_id, b.panel_id AS parent_id, {_edge('a', 'b')} AS dist, row_number() OVER (PARTITION BY a.fig_id, a.panel_id ORDER BY {_edge('a', 'b')}, b.panel_id) AS k FROM panels a JOIN panels b ON a.fig_id = b.fig_id AND b.role = 'diagram') y ON y.k = 1 AND y.fig_id = c.fig_id AND y.panel_id = c.panel_id
    WHERE c.role IN ('label', 'conditions')) a JOIN panels w ON w.fig_id = a.fig_id AND w.panel_id = a.aid JOIN panels d ON d.fig_id = a.fig_id AND d.panel_id = a.did"""))
def reclassified_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.panels(spark, sf_dir)
    regions = p.where("role in ('label', 'conditions')").select("fig_id", "panel_id", "t", "l", "b", "r", "role")
    return spatial.reclassified(regions, of_role(p, "arrow"), of_role(p, "diagram"), 6.0)


_LABELS = f"""lab AS (SELECT fig_id, panel_id, parent_id FROM (SELECT a.fig_id, a.panel_id, b.panel_id AS parent_id, row_number() OVER (PARTITION BY a.fig_id, a.panel_id ORDER BY {_edge('a', 'b')}, b.panel_id) AS k
  FROM panels a JOIN panels b ON a.fig_id = b.fig_id WHERE a.role = 'label' AND b.role = 'diagram') WHERE k = 1)"""


@register(_sql(f""", {_LABELS}, cnt AS (SELECT fig_id, parent_id, count(*) AS n FROM lab GROUP BY 1, 2),
  two AS (SELECT fig_id, panel_id, max(CASE WHEN k = 1 THEN d END) AS d1, max(CASE WHEN k = 2 THEN d END) AS d2, max(CASE WHEN k = 2 THEN id END) AS second FROM (
    SELECT a.fig_id, a.panel_id, b.panel_id AS id, {_edge('a', 'b')} AS d, row_number() OVER (PARTITION BY a.fig_id, a.panel_id ORDER BY {_edge('a', 'b')}, b.panel_id) AS k
    FROM panels a JOIN panels b ON a.fig_id = b.fig_id WHERE a.role = 'label' AND b.role = 'diagram') GROUP BY 1, 2)
  SELECT l.fig_id, l.panel_id, CASE WHEN c.n > 1 AND t.second IS NOT NULL AND s.n IS NULL AND t.d2 - t.d1 < {C.label_reassignment_distance} THEN t.second ELSE l.parent_id END AS parent_id
  FROM lab l JOIN two t ON l.fig_id = t.fig_id AND l.panel_id = t.panel_id JOIN cnt c ON c.fig_id = l.fig_id AND c.parent_id = l.parent_id LEFT JOIN cnt s ON s.fig_id = l.fig_id AND s.parent_id = t.second"""))
def reparented_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.panels(spark, sf_dir)
    parents = spatial.nearest(of_role(p, "label"), of_role(p, "diagram")).select("fig_id", "panel_id", "parent_id")
    labels = of_role(p, "label").select("fig_id", "panel_id", "t", "l", "b", "r").join(parents, ["fig_id", "panel_id"])
    return spatial.reparented_labels(labels, of_role(p, "diagram"), C.label_reassignment_distance)


# --- aggregates and windows --------------------------------------------------------------


@register(_sql("SELECT fig_id, role, min(t) AS t, min(l) AS l, max(b) AS b, max(r) AS r FROM panels GROUP BY 1, 2"))
def union_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.unions(views.panels(spark, sf_dir), "fig_id", "role")


@register(_sql(f"""SELECT a.fig_id, a.panel_id, min(b.t) AS t, min(b.l) AS l, max(b.b) AS b, max(b.r) AS r FROM {_WIDE} a JOIN panels b ON a.fig_id = b.fig_id AND {_in('a', 'b')} WHERE a.role = 'diagram' GROUP BY 1, 2"""))
def adjusted_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.panels(spark, sf_dir)
    j = spatial.pairs(of_role(_wide(p), "diagram"), p.select("fig_id", "panel_id", "t", "l", "b", "r"), g.contains)
    return spatial.unions(j.select("a.fig_id", "a.panel_id", "b.t", "b.l", "b.b", "b.r"), "fig_id", "panel_id")


@register(_sql(f""", near AS (SELECT * FROM (SELECT a.fig_id, a.b < b.t AS below, b.b < a.t AS above, b.r < a.l AS lf, a.r < b.l AS rt, row_number() OVER (PARTITION BY a.fig_id, a.panel_id ORDER BY {_edge('a', 'b')}, b.panel_id) AS k
  FROM panels a JOIN panels b ON a.fig_id = b.fig_id WHERE a.role = 'label' AND b.role = 'diagram') WHERE k = 1)
  SELECT fig_id, sum(CASE WHEN below THEN 1 ELSE 0 END) > 0.5 * (count(*) - sum(CASE WHEN NOT (below OR above OR lf OR rt) THEN 1 ELSE 0 END)) AS below FROM near GROUP BY fig_id"""))
def majority_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.panels(spark, sf_dir)
    labels, diagrams = of_role(p, "label"), of_role(p, "diagram")
    near = spatial.nearest(labels, diagrams).alias("n")
    j = near.join(labels.alias("a"), ["fig_id", "panel_id"]).join(diagrams.alias("b"), (F.col("n.fig_id") == F.col("b.fig_id")) & (F.col("parent_id") == F.col("b.panel_id")))
    o = g.orientation(box("a"), box("b"))
    votes = F.count_if(o.bottom) > 0.5 * (F.count("*") - F.count_if(~(o.top | o.left | o.bottom | o.right)))
    return j.groupBy("n.fig_id").agg(votes.alias("below"))


@register(_sql("""SELECT fig_id, min(least(r - l, b - t)) * 0.2::DOUBLE AS step, CAST(floor(avg((r - l + b - t) / 2.0::DOUBLE) / 2) AS BIGINT) AS segment, max((r - l) * (b - t)) AS largest,
  arg_min(panel_id, -((r - l) * (b - t)) * 100 + panel_id) AS largest_id FROM panels WHERE role = 'diagram' GROUP BY 1"""))
def figure_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = box()
    d = of_role(views.panels(spark, sf_dir), "diagram")
    best = F.max(F.struct(g.area(a).alias("area"), (-F.col("panel_id")).alias("k")))
    return d.groupBy("fig_id").agg((F.min(F.least(g.width(a), g.height(a))) * 0.2).alias("step"), F.floor(F.avg((g.width(a) + g.height(a)) / 2.0) / 2).alias("segment"), best["area"].alias("largest"), (-best["k"]).alias("largest_id"))


@register(_sql(f"""SELECT a.fig_id, a.panel_id, greatest(50.0::DOUBLE, coalesce(0.3::DOUBLE * avg(CASE WHEN b.panel_id <> a.panel_id THEN greatest(b.r - b.l, b.b - b.t) END), 50.0::DOUBLE)) AS probe FROM panels a JOIN panels b ON a.fig_id = b.fig_id GROUP BY 1, 2"""))
def probe_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probe.probe_distance(views.panels(spark, sf_dir), C.least_probe_distance, C.probe_factor)


@register(_sql("""SELECT fig_id, panel_id, CAST(island AS INTEGER) AS island, CAST(CASE WHEN count(*) OVER (PARTITION BY fig_id, island) > 1 THEN island ELSE -1 END AS INTEGER) AS cluster FROM (
  SELECT fig_id, panel_id, cy, sum(brk) OVER (PARTITION BY fig_id ORDER BY cy, panel_id ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT fig_id, panel_id, cy, CASE WHEN cy - lag(cy) OVER (PARTITION BY fig_id ORDER BY cy, panel_id) > 60 THEN 1 ELSE 0 END AS brk FROM (SELECT fig_id, panel_id, (t + b) / 2.0::DOUBLE AS cy FROM panels)))"""))
def row_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.panels(spark, sf_dir).select("fig_id", "panel_id", g.center(box()).y.alias("cy"))
    return cluster.islands(p, "fig_id", "cy", F.lit(60.0), "panel_id").select("fig_id", "panel_id", "island", "cluster")


@register(_sql(""", pts AS (SELECT fig_id, panel_id, (t + b) / 2.0::DOUBLE AS cy FROM panels), brk AS (SELECT *, CASE WHEN cy - lag(cy) OVER (PARTITION BY fig_id ORDER BY cy, panel_id) > 60 THEN 1 ELSE 0 END AS k FROM pts),
  isl AS (SELECT *, sum(k) OVER (PARTITION BY fig_id ORDER BY cy, panel_id ROWS UNBOUNDED PRECEDING) AS island FROM brk),
  cl AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY fig_id, island) > 1 THEN island ELSE -1 END AS cluster FROM isl), ctr AS (SELECT fig_id, cluster, avg(cy) AS c FROM cl GROUP BY 1, 2)
  SELECT s.fig_id, s.panel_id, min(CASE WHEN c.c > s.cy THEN c.c END) AS below, max(CASE WHEN c.c < s.cy THEN c.c END) AS above FROM cl s LEFT JOIN ctr c ON s.fig_id = c.fig_id AND s.cluster <> c.cluster WHERE s.panel_id = 1 GROUP BY 1, 2"""))
def adjacent_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.panels(spark, sf_dir).select("fig_id", "panel_id", g.center(box()).y.alias("cy"))
    c = cluster.islands(p, "fig_id", "cy", F.lit(60.0), "panel_id")
    return cluster.adjacent_rows(c.where("panel_id = 1"), cluster.row_centers(c, "fig_id", "cy"), "fig_id", "cy")


@register(_sql("SELECT fig_id, panel_id, CAST(k AS INTEGER) AS rank FROM (SELECT fig_id, panel_id, row_number() OVER (PARTITION BY fig_id ORDER BY (r - l) * (b - t) DESC, panel_id) AS k FROM panels) WHERE k <= 2"))
def two_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("fig_id").orderBy(g.area(box()).desc(), "panel_id")
    return views.panels(spark, sf_dir).withColumn("rank", F.row_number().over(w)).where("rank <= 2").select("fig_id", "panel_id", "rank")


@register()
def without_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.without_duplicates(views.panels(spark, sf_dir))


# --- sets --------------------------------------------------------------------------------


@register(_sql("""SELECT fig_id, panel_id, min(k) AS source_rank FROM (SELECT fig_id, panel_id, 0 AS k FROM panels WHERE role = 'arrow' UNION ALL SELECT fig_id, panel_id, 1 FROM panels WHERE pk % 2 = 0 UNION ALL SELECT fig_id, panel_id, 2 FROM panels WHERE pk % 3 = 0)
  WHERE (fig_id, panel_id) NOT IN (SELECT fig_id, panel_id FROM panels WHERE role = 'label') GROUP BY 1, 2"""))
def combined_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.panels(spark, sf_dir)
    key = p.select("fig_id", "panel_id", "pk", "role")
    all_ = detections.combined(of_role(key, "arrow"), key.where("pk % 2 = 0"), key.where("pk % 3 = 0"))
    rest = all_.join(of_role(key, "label").select("fig_id", "panel_id"), ["fig_id", "panel_id"], "left_anti")
    return rest.groupBy("fig_id", "panel_id").agg(F.min("source_rank").alias("source_rank"))


@register(_sql("SELECT CAST(count_if(role = 'arrow') AS BIGINT) AS arrows, CAST(count_if(role = 'diagram') AS BIGINT) AS diagrams, CAST(count_if(role = 'conditions') AS BIGINT) AS conditions, CAST(count_if(role = 'label') AS BIGINT) AS labels, count(DISTINCT concat(t, ' ', l, ' ', b, ' ', r)) AS boxes FROM panels"))
def separated_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.panels(spark, sf_dir)
    kinds = [F.count_if(F.col("role") == k).alias(n) for k, n in (("arrow", "arrows"), ("diagram", "diagrams"), ("conditions", "conditions"), ("label", "labels"))]
    return p.agg(*kinds, F.countDistinct("t", "l", "b", "r").alias("boxes"))


# --- scans and tiles ---------------------------------------------------------------------

_SCAN = f"""scan AS (SELECT *, unnest(range(1, cnt + 1)) AS n FROM (SELECT *, CASE WHEN skip <= cnt THEN skip ELSE 0 END AS first FROM (
  SELECT fig_id, panel_id, sx, sy, CAST(least(abs(floor({WIDTH} / sx)), abs(floor({HEIGHT} / sy))) AS INTEGER) AS cnt, CAST(floor(long_side / 2.0::DOUBLE / greatest(abs(sx), abs(sy))) AS INTEGER) + 2 AS skip,
    (l + r) / 2.0::DOUBLE AS cx, (t + b) / 2.0::DOUBLE AS cy FROM (SELECT *, CASE WHEN abs(50.0::DOUBLE * dir_x) >= 1e-5 THEN 50.0::DOUBLE * dir_x ELSE 1e-5::DOUBLE END AS sx, CASE WHEN abs(50.0::DOUBLE * dir_y) >= 1e-5 THEN 50.0::DOUBLE * dir_y ELSE 1e-5::DOUBLE END AS sy
    FROM panels WHERE role = 'arrow')) WHERE cnt > 0)),
pts AS (SELECT fig_id, panel_id, CAST(n AS INTEGER) AS n, cx + sx * (first + n) AS x, cy + sy * (first + n) AS y FROM scan)"""


def _points(p: DataFrame) -> DataFrame:
    return probe.scan_points(of_role(p, "arrow"), F.lit(50.0), F.lit(float(WIDTH)), F.lit(float(HEIGHT)), 1)


@register(_sql(f", {_SCAN} SELECT * FROM pts"))
def scan_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(views.panels(spark, sf_dir))


def _point_edge(box_: str, p: str) -> str:
    dx, dy = f"greatest({box_}.l - {p}.x, {p}.x - {box_}.r, 0)", f"greatest({box_}.t - {p}.y, {p}.y - {box_}.b, 0)"
    return f"sqrt({dx} * {dx} + {dy} * {dy})"


@register(_sql(f""", {_SCAN}, stops AS (SELECT fig_id, panel_id, CASE WHEN f > 2 THEN f END AS stop FROM (SELECT p.fig_id, p.panel_id, min(CASE WHEN a.panel_id IS NOT NULL THEN p.n END) AS f FROM pts p
    LEFT JOIN panels a ON a.role = 'label' AND a.fig_id = p.fig_id AND a.panel_id <> p.panel_id AND {_point_edge('a', 'p')} < greatest(greatest(a.r - a.l, a.b - a.t) * 0.2::DOUBLE, 50.0::DOUBLE) GROUP BY 1, 2))
  SELECT DISTINCT p.fig_id, p.panel_id, d.panel_id AS diagram_id FROM pts p JOIN stops s ON p.fig_id = s.fig_id AND p.panel_id = s.panel_id AND (s.stop IS NULL OR p.n < s.stop)
  JOIN panels d ON d.role = 'diagram' AND d.fig_id = p.fig_id AND {_point_edge('d', 'p')} < 50.0::DOUBLE"""))
def scanned_diagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.panels(spark, sf_dir)
    points = _points(p)
    stops = probe.blocked_at(points, of_role(p, "label"), F.lit(50.0))
    probes = probe.probe_distance(of_role(p, "arrow"), C.least_probe_distance, C.probe_factor)
    return probe.found_diagrams(probe.open_points(points, stops), probes, of_role(p, "diagram"))


def _assign_sql(single: bool) -> str:
    at = lambda x, y: f"min(sqrt(greatest(d.l - {x}, {x} - d.r, 0) * greatest(d.l - {x}, {x} - d.r, 0) + greatest(d.t - {y}, {y} - d.b, 0) * greatest(d.t - {y}, {y} - d.b, 0)))"
    cx, cy = _cx("w"), _cy("w")
    rx, ry = f"({cx} + 20.0::DOUBLE * w.dir_x)", f"({cy} + 20.0::DOUBLE * w.dir_y)"
    pick = "CASE WHEN g1 <= g2 THEN 1 ELSE 2 END" if single else "CASE WHEN d1 <= d2 THEN CASE WHEN g1 < 0 THEN 1 ELSE 2 END ELSE CASE WHEN g2 < 0 THEN 2 ELSE 1 END END"
    return _sql(f""", grp AS (SELECT w.fig_id, w.panel_id AS arrow_id, d.panel_id % 2 + 1 AS grp, {at(cx, cy)} AS c, {at(rx, ry)} AS r FROM panels w JOIN panels d ON w.fig_id = d.fig_id WHERE w.role = 'arrow' AND d.role = 'diagram' GROUP BY 1, 2, 3),
  two AS (SELECT fig_id, arrow_id, max(CASE WHEN grp = 1 THEN r - c END) AS g1, max(CASE WHEN grp = 2 THEN r - c END) AS g2, max(CASE WHEN grp = 1 THEN c END) AS d1, max(CASE WHEN grp = 2 THEN c END) AS d2 FROM grp GROUP BY 1, 2)
  SELECT fig_id, arrow_id, {pick} AS products_group FROM two WHERE g1 IS NOT NULL AND g2 IS NOT NULL""")


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.panels(spark, sf_dir)
    c = g.center(box("a"))
    j = spatial.pairs(of_role(p, "arrow"), of_role(p, "diagram"))
    return j.select("a.fig_id", F.col("a.panel_id").alias("arrow_id"), (F.col("b.panel_id") % 2 + 1).alias("grp"), "b.t", "b.l", "b.b", "b.r", c.x.alias("cx"), c.y.alias("cy"), (c.x + 20.0 * F.col("a.dir_x")).alias("rx"), (c.y + 20.0 * F.col("a.dir_y")).alias("ry"))


@register(_assign_sql(True))
def assigned_roles_single_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probe.assigned(_members(spark, sf_dir), single_line=True)


@register(_assign_sql(False))
def assigned_roles_multi_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probe.assigned(_members(spark, sf_dir), single_line=False)


_TILES = """figs AS (SELECT p_partkey AS fig_id, CAST(500 + p_size * 40 AS INTEGER) AS width, CAST(300 + p_partkey % 1700 AS INTEGER) AS height FROM part),
tl AS (SELECT fig_id, CAST(i * nw + j AS INTEGER) AS tile_id, CAST(greatest(i * height // nh - 100, 0) AS INTEGER) AS top, CAST(greatest(j * width // nw - 100, 0) AS INTEGER) AS left_,
  CAST(least((i + 1) * height // nh + 100, height) AS INTEGER) AS bottom, CAST(least((j + 1) * width // nw + 100, width) AS INTEGER) AS right_ FROM (
  SELECT *, unnest(range(0, nw)) AS j FROM (SELECT *, unnest(range(0, nh)) AS i FROM (SELECT *, CAST(ceil(height / 600.0) AS INTEGER) AS nh, CAST(ceil(width / 800.0) AS INTEGER) AS nw FROM figs))))"""


@register(f"WITH {_TILES} SELECT fig_id, tile_id, top, left_, bottom, right_, left_ + 7 AS x1, bottom + top AS y2 FROM tl")
def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    figs = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("fig_id"), (500 + F.col("p_size") * 40).cast("int").alias("width"), (300 + F.col("p_partkey") % 1700).cast("int").alias("height"))
    t = detections.tiles(figs, C.tile_height, C.tile_width, C.tile_extension)
    found = t.select("fig_id", "tile_id", F.lit(7).alias("x1"), F.lit(1).alias("y1"), F.lit(9).alias("x2"), F.col("bottom").alias("y2"), "top", F.col("left").alias("left_"), "bottom", F.col("right").alias("right_"))
    return detections.from_tiles(found, t).select("fig_id", "tile_id", "top", "left_", "bottom", "right_", "x1", "y2")
