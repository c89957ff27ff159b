"""Queries of geometry: points from embeddings; regions are fixed shapes (squares, an L, one with a hole)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions.geo import line_length, polygon_area
from gridloom.operators import spatial as S
from gridloom.plans.fusion import rounded
from gridloom.plans.tables import table

SHAPES = {
    1: [[(-0.5, -0.5), (0.0, -0.5), (0.0, 0.0), (-0.5, 0.0)]],
    2: [[(0.0, -0.5), (0.5, -0.5), (0.5, 0.0), (0.25, 0.0), (0.25, -0.25), (0.0, -0.25)]],
    3: [[(-0.5, 0.0), (0.5, 0.0), (0.5, 0.5), (-0.5, 0.5)], [(-0.1, 0.1), (0.1, 0.1), (0.1, 0.3), (-0.1, 0.3)]],
}
SIZE = 0.25


def _rings(shape) -> str:
    return "array(" + ", ".join("array(" + ", ".join(f"named_struct('x', {x}d, 'y', {y}d)" for x, y in [*r, r[0]]) + ")" for r in shape) + ")"


def regions(spark):
    rows = " UNION ALL ".join(f"SELECT {k} AS region, {_rings(s)} AS rings" for k, s in SHAPES.items())
    return spark.sql(rows)


def points(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


def boxes(spark, sf):
    """A small square around every point, classed by label."""
    p = table(spark, sf, "embeddings").select(F.col("label").alias("class"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    corner = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    r = 0.02
    return p.select("class", F.array(F.array(corner(-r, -r), corner(r, -r), corner(r, r), corner(-r, r), corner(-r, -r))).alias("shape"))


def lines(spark, sf):
    """A horizontal path to the right of every point."""
    p = table(spark, sf, "embeddings").select(F.col("label").alias("class"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return p.select("class", F.array(F.struct("x", "y"), F.struct((F.col("x") + 0.1).alias("x"), F.col("y"))).alias("shape"))


def q_assign(spark, sf):
    ok = F.col("vec_id") % 9 != 0
    return S.assign_regions(points(spark, sf), regions(spark), "x", "y", "region", SIZE, ok).select("vec_id", "region")


def q_point_counts(spark, sf):
    return S.points_per_region(points(spark, sf), regions(spark), "x", "y", SIZE)


def q_areas(spark, sf):
    """Areas of regions and of point squares, and lengths of paths, by class."""
    r = regions(spark).select(F.concat(F.lit("region "), F.col("region")).alias("what"), polygon_area(F.col("rings")).alias("size"))
    b = boxes(spark, sf).groupBy(F.concat(F.lit("class "), F.col("class")).alias("what")).agg(F.sum(polygon_area(F.col("shape"))).alias("size"))
    p = lines(spark, sf).groupBy(F.concat(F.lit("path "), F.col("class")).alias("what")).agg(F.sum(line_length(F.col("shape"))).alias("size"))
    return r.union(b).union(p).select("what", F.round("size", 6).alias("size"))


def q_overlay(spark, sf):
    return S.overlay_polygons(regions(spark), boxes(spark, sf), SIZE).select("region", "class", F.round("area", 6).alias("area"))


def q_overlay_lines(spark, sf):
    return S.overlay_lines(regions(spark), lines(spark, sf), SIZE).select("region", "class", F.round("length", 6).alias("length"), "segments")


def q_context(spark, sf):
    r = regions(spark)
    out = S.region_context(r, S.overlay_polygons(r, boxes(spark, sf), SIZE), "area")
    return out.select("region", F.round("region_area", 6).alias("region_area"), F.round("total_area", 6).alias("total_area"), "n_categories", "dominant", F.round("dominant_share", 6).alias("dominant_share"), F.round("density", 6).alias("density"))


def q_quality(spark, sf):
    """Polygons spoilt by their id: null, empty, short, open, flat, crossed or sound."""
    p = table(spark, sf, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    c = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    k = F.col("vec_id") % 7
    ring = F.when(k == 2, F.array(c(0, 0), c(1, 0), c(0, 0))).when(k == 3, F.array(c(0, 0), c(1, 0), c(1, 1), c(0, 1))).when(k == 4, F.array(c(0, 0), c(0, 0), c(0, 0), c(0, 0))).when(k == 5, F.array(c(0, 0), c(2, 2), c(2, 0), c(0, 1), c(0, 0))).otherwise(F.array(c(0, 0), c(1, 0), c(1, 1), c(0, 0)))
    shapes = p.select("vec_id", F.when(k == 0, None).when(k == 1, F.array().cast(S.RINGS)).otherwise(F.array(ring)).alias("rings"))
    found = S.geometry_quality(shapes)
    return found.groupBy(F.coalesce("problem", F.lit("none")).alias("problem")).agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))


def q_layer(spark, sf):
    p = boxes(spark, sf).withColumnsRenamed({"shape": "rings", "class": "Clase Ñ"})
    return S.prepare_layer(p, "squares", 1000.0).groupBy("clase_n", "layer_source").agg(F.count("*").alias("n"), F.round(F.sum("area"), 2).alias("area"))


def q_locate(spark, sf):
    """A dimension is located once; facts take the region from it by their station id."""
    station = S.assign_regions(points(spark, sf).withColumnRenamed("vec_id", "station"), regions(spark), "x", "y", "region", SIZE).select("station", "region")
    e = table(spark, sf, "events").select(F.col("user_id").alias("station"), "value")
    return rounded(e.join(station, "station", "left").groupBy("region").agg(F.count("*").alias("n"), F.countDistinct("station").alias("stations"), F.sum("value").alias("total")), total=2)


QUERIES = {"assign_regions": q_assign, "points_per_region": q_point_counts, "areas_lengths": q_areas, "overlay_polygons": q_overlay, "overlay_lines": q_overlay_lines, "overlay_context": q_context, "geometry_quality": q_quality, "prepare_layer": q_layer, "locate_stations": q_locate}
_P = "p AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)"
_IN = """CASE WHEN x > -0.5 AND x < 0 AND y > -0.5 AND y < 0 THEN 1 WHEN x > 0 AND x < 0.5 AND y > -0.5 AND y < 0 AND (y < -0.25 OR x > 0.25) THEN 2
 WHEN x > -0.5 AND x < 0.5 AND y > 0 AND y < 0.5 AND NOT (x >= -0.1 AND x <= 0.1 AND y >= 0.1 AND y <= 0.3) THEN 3 END"""
# regions as unions of rectangles with a sign
_RECT = "q(region, sign, x0, x1, y0, y1) AS (VALUES (1, 1, -0.5, 0.0, -0.5, 0.0), (2, 1, 0.0, 0.5, -0.5, -0.25), (2, 1, 0.25, 0.5, -0.25, 0.0), (3, 1, -0.5, 0.5, 0.0, 0.5), (3, -1, -0.1, 0.1, 0.1, 0.3))"
_AREA = f"""{_P}, {_RECT}, o AS (SELECT region, vec_id, label AS class, sum(sign * greatest(0.0, least(x + 0.02, x1) - greatest(x - 0.02, x0)) * greatest(0.0, least(y + 0.02, y1) - greatest(y - 0.02, y0))) AS area FROM p, q GROUP BY 1, 2, 3),
a AS (SELECT region, class, sum(area) AS area FROM o WHERE area > 1e-15 GROUP BY 1, 2)"""
ORACLES = {
    "assign_regions": f"WITH {_P} SELECT vec_id, CASE WHEN vec_id % 9 <> 0 THEN {_IN} END AS region FROM p",
    "points_per_region": f"WITH {_P}, a AS (SELECT {_IN} AS region FROM p) SELECT r.region, count(a.region) AS n FROM (VALUES (1), (2), (3)) AS r(region) LEFT JOIN a ON a.region = r.region GROUP BY 1",
    "areas_lengths": f"WITH {_P} SELECT 'region ' || k AS what, round(v, 6) AS size FROM (VALUES (1, 0.25), (2, 0.1875), (3, 0.46)) AS t(k, v) UNION ALL SELECT 'class ' || label, round(count(*) * 0.0016, 6) FROM p GROUP BY 1 UNION ALL SELECT 'path ' || label, round(count(*) * 0.1, 6) FROM p GROUP BY 1",
    "overlay_polygons": f"WITH {_AREA} SELECT region, class, round(area, 6) AS area FROM a",
    "overlay_lines": f"WITH {_P}, {_RECT}, o AS (SELECT region, vec_id, label AS class, sum(CASE WHEN y > y0 AND y < y1 THEN sign * greatest(0.0, least(x + 0.1, x1) - greatest(x, x0)) ELSE 0.0 END) AS l FROM p, q GROUP BY 1, 2, 3) SELECT region, class, round(sum(l), 6) AS length, count(*) AS segments FROM o WHERE l > 1e-15 GROUP BY 1, 2",
    "overlay_context": f"""WITH {_AREA}, s(region, ra) AS (VALUES (1, 0.25), (2, 0.1875), (3, 0.46)), r AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY area DESC, class) AS r, sum(area) OVER (PARTITION BY region) AS t, count(*) OVER (PARTITION BY region) AS n FROM a)
  SELECT s.region, CAST(ra AS DOUBLE) AS region_area, round(t, 6) AS total_area, n AS n_categories, class AS dominant, round(area / t, 6) AS dominant_share, round(t / ra, 6) AS density FROM s LEFT JOIN r ON r.region = s.region AND r.r = 1""",
    "geometry_quality": "SELECT CASE vec_id % 7 WHEN 0 THEN 'null' WHEN 1 THEN 'empty' WHEN 2 THEN 'short' WHEN 3 THEN 'open' WHEN 4 THEN 'flat' WHEN 5 THEN 'crossed' ELSE 'none' END AS problem, count(*) AS n, min(vec_id) AS first FROM embeddings GROUP BY 1",
    "prepare_layer": "SELECT label AS clase_n, 'squares' AS layer_source, count(*) AS n, round(count(*) * 1600.0, 2) AS area FROM embeddings GROUP BY 1",
    "locate_stations": f"WITH {_P}, s AS (SELECT vec_id AS station, {_IN} AS region FROM p) SELECT region, count(*) AS n, count(DISTINCT user_id) AS stations, round(sum(value), 2) AS total FROM events LEFT JOIN s ON station = user_id GROUP BY 1",
}
