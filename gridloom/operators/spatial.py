"""Point-in-polygon assignment and overlays by a grid of cells.

Polygons, paths and points meet in the cells of a grid by an equi join. Polygons are cut to cells for overlays; for points
a cell holds the edges that a test needs, and cells wholly inside a polygon answer without one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.geo import polygon_area, signed_area
from gridloom.functions.names import fresh
from gridloom.operators import sweep
from gridloom.operators.fusion import dominant
from gridloom.staging import staged

RINGS = "array<array<struct<x:double,y:double>>>"
#: Areas below this share of a cell are rounding.
LEAST_AREA = 1e-15


def points_of(ring: list[dict] | None) -> np.ndarray:
    """Points of a ring or path, without the last where it repeats the first."""
    r = np.array([(p["x"], p["y"]) for p in ring or []], float).reshape(-1, 2)
    return r[:-1] if len(r) > 2 and (r[0] == r[-1]).all() else r


def cell_candidates(polygons: DataFrame, region: str, size: float) -> DataFrame:
    """(i, j, candidates): for each cell the polygons that may hold its points, with what a test of a point needs.

    As many as overlap in a cell stand in one row, so the cell should be about as large as a typical region.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(c, pa.float64()) for c in ("x1", "y1", "x2", "y2")]))
        for b in batches:
            for k, rings in enumerate(b.column("rings").to_pylist()):
                found = list(sweep.cell_edges([points_of(r) for r in rings or []], size))
                for s in range(0, len(found), 1_000):
                    part = found[s : s + 1_000]
                    i, j, base = (pa.array([x[c] for x in part], pa.int64()) for c in range(3))
                    edges = pa.array([[dict(zip(("x1", "y1", "x2", "y2"), y)) for y in x[3].tolist()] for x in part], kind)
                    yield pa.RecordBatch.from_arrays([b.column("region").take(pa.array([k] * len(part), pa.int64())), i, j, base, edges], ["region", "i", "j", "base", "edges"])

    shapes = polygons.select(F.col(region).alias("region"), "rings")
    cover = shapes.mapInArrow(run, f"region {shapes.schema['region'].dataType.simpleString()}, i long, j long, base long, edges array<struct<x1:double,y1:double,x2:double,y2:double>>")
    return cover.groupBy("i", "j").agg(F.collect_list(F.struct("region", "base", "edges")).alias("candidates"))


def holds(candidate: Column, x: Column, y: Column) -> Column:
    """Whether a candidate of the point's cell strictly holds it: whole cells do without a test."""
    e = candidate["edges"]
    crossed = F.aggregate(e, candidate["base"], lambda n, s: n + (((s["y1"] > y) != (s["y2"] > y)) & (x < (s["x2"] - s["x1"]) * F.try_divide(y - s["y1"], s["y2"] - s["y1"]) + s["x1"])).cast("long"))
    touched = F.exists(e, lambda s: ((s["x2"] - s["x1"]) * (y - s["y1"]) == (s["y2"] - s["y1"]) * (x - s["x1"])) & x.between(F.least(s["x1"], s["x2"]), F.greatest(s["x1"], s["x2"])) & y.between(F.least(s["y1"], s["y2"]), F.greatest(s["y1"], s["y2"])))
    return (crossed % 2 == 1) & ~touched


def assign_regions(points: DataFrame, polygons: DataFrame, x: str, y: str, region: str, size: float, valid: Column | None = None) -> DataFrame:
    """Each point with the smallest region whose polygon strictly holds it, else null; invalid points bypass the join.

    One left join of the points with the cells' candidates: no row is dealt out or grouped anew. Points without a cell
    spread by the hash of their row. points: any columns; polygons: region, rings; a point on an edge is outside.
    """
    ok = F.col(x).isNotNull() & F.col(y).isNotNull() & (F.lit(True) if valid is None else F.coalesce(valid, F.lit(False)))
    i, j, known = (fresh(c, points.columns) for c in ("_i", "_j", "_known"))
    plain = [f.name for f in points.schema if not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType, T.VariantType))]
    at = lambda c: F.floor(F.col(c) / size).cast("long")
    p = points.withColumns({i: F.when(ok, at(x)).otherwise(F.xxhash64(*plain)), j: F.when(ok, at(y)).otherwise(F.lit(0).cast("long")), known: ok})
    own = {c: fresh(f"_{c}", p.columns) for c in ("ci", "cj", "candidates")}
    g = cell_candidates(polygons, region, size).select(F.col("i").alias(own["ci"]), F.col("j").alias(own["cj"]), F.col("candidates").alias(own["candidates"]))
    near = F.filter(F.col(own["candidates"]), lambda c: holds(c, F.col(x), F.col(y)))
    found = F.array_min(F.transform(near, lambda c: c["region"]))
    joined = p.join(g, (F.col(i) == F.col(own["ci"])) & (F.col(j) == F.col(own["cj"])) & F.col(known), "left")
    return joined.select(*(c for c in points.columns if c != region), found.alias(region))


def cell_pieces(shapes: DataFrame, keys: list[str], rings: str, size: float) -> DataFrame:
    """(keys, i, j, piece): polygons cut to the cells that they touch with area; a null piece is a whole cell.

    A piece holds its rings as bytes of coordinates.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, shape in enumerate(b.column(rings).to_pylist()):
                found = list(sweep.cell_pieces([points_of(r) for r in shape or []], size))
                for s in range(0, len(found), 1_000):
                    part = found[s : s + 1_000]
                    own = pa.array([k] * len(part), pa.int64())
                    pieces = pa.array([None if x[2] is None else [r.tobytes() for r in x[2]] for x in part], pa.list_(pa.binary()))
                    yield pa.RecordBatch.from_arrays([*(b.column(c).take(own) for c in keys), pa.array([x[0] for x in part], pa.int64()), pa.array([x[1] for x in part], pa.int64()), pieces], [*keys, "i", "j", "piece"])

    kinds = ", ".join(f"`{c}` {shapes.schema[c].dataType.simpleString()}" for c in keys)
    return shapes.select(*keys, rings).mapInArrow(run, f"{kinds}, i long, j long, piece array<binary>")


def rings_of(piece: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(r).reshape(-1, 2) for r in piece]


def overlay_polygons(regions: DataFrame, layer: DataFrame, size: float) -> DataFrame:
    """(region, class, area): area shared by regions (region, rings) and layer polygons (class, shape: rings).

    Both sides are cut to cells, pieces meet by cell, and areas of pieces add up: a task holds two pieces at a time.
    Whole cells need no sweep. Null and empty shapes share nothing; overlapping layer polygons count each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            areas = []
            for mine, other in zip(b.column("piece").to_pylist(), b.column("other").to_pylist()):
                if mine is None or other is None:
                    both = mine or other
                    areas.append(size * size if both is None else sweep.area_of(rings_of(both)))
                else:
                    areas.append(sweep.shared_area(rings_of(mine), rings_of(other)))
            yield pa.RecordBatch.from_arrays([b.column("region"), b.column("class"), pa.array(areas, pa.float64())], ["region", "class", "area"])

    mine, other = cell_pieces(regions, ["region"], "rings", size), cell_pieces(layer, ["class"], "shape", size).withColumnRenamed("piece", "other")
    pairs = mine.join(other, ["i", "j"]).select("region", "class", "piece", "other")
    shared = pairs.mapInArrow(run, f"region {regions.schema['region'].dataType.simpleString()}, class {layer.schema['class'].dataType.simpleString()}, area double")
    return shared.filter(F.col("area") > LEAST_AREA * size * size).groupBy("region", "class").agg(F.sum("area").alias("area"))


def overlay_lines(regions: DataFrame, layer: DataFrame, size: float) -> DataFrame:
    """(region, class, length, segments): length of layer paths (class, shape: points) within regions, and how many of them.

    Paths are cut to cells as polygons are; the pieces of a path in a region add up before paths are counted.
    """
    numbered = staged(layer.select("class", "shape").withColumn("path", F.monotonically_increasing_id()), "paths")  # written: a path keeps its number

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, shape in enumerate(b.column("shape").to_pylist()):
                path = np.array([(p["x"], p["y"]) for p in shape or []], float).reshape(-1, 2)
                by_cell: dict[tuple[int, int], list[np.ndarray]] = {}
                for p, q in zip(path, path[1:]):
                    for i, j, s, t in sweep.clip_segment(p, q, size):
                        by_cell.setdefault((i, j), []).append(np.concatenate([s, t]))
                own = pa.array([k] * len(by_cell), pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("class").take(own), b.column("path").take(own), pa.array([c[0] for c in by_cell], pa.int64()), pa.array([c[1] for c in by_cell], pa.int64()), pa.array([np.array(x).tobytes() for x in by_cell.values()], pa.binary())], ["class", "path", "i", "j", "steps"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = []
            for piece, raw in zip(b.column("piece").to_pylist(), b.column("steps").to_pylist()):
                steps = np.frombuffer(raw).reshape(-1, 4)
                lengths.append(float(np.hypot(steps[:, 2] - steps[:, 0], steps[:, 3] - steps[:, 1]).sum()) if piece is None else sweep.length_inside(steps, rings_of(piece)))
            yield pa.RecordBatch.from_arrays([b.column("region"), b.column("class"), b.column("path"), pa.array(lengths, pa.float64())], ["region", "class", "path", "length"])

    kind, region = layer.schema["class"].dataType.simpleString(), regions.schema["region"].dataType.simpleString()
    paths = numbered.mapInArrow(cut, f"class {kind}, path long, i long, j long, steps binary")
    pairs = cell_pieces(regions, ["region"], "rings", size).join(paths, ["i", "j"]).select("region", "class", "path", "piece", "steps")
    within = pairs.mapInArrow(run, f"region {region}, class {kind}, path long, length double").filter("length > 0")
    by_path = within.groupBy("region", "class", "path").agg(F.sum("length").alias("length"))
    return by_path.groupBy("region", "class").agg(F.sum("length").alias("length"), F.count("*").alias("segments"))


def region_context(regions: DataFrame, pieces: DataFrame, measure: str) -> DataFrame:
    """Per region: total of a measure, number of classes, the dominant class with its share, and density over the region's area."""
    area = regions.select("region", polygon_area(F.col("rings")).alias("region_area"))
    pieces = staged(pieces, "pieces")  # an overlay is worked out once
    total = pieces.groupBy("region").agg(F.sum(measure).alias(f"total_{measure}"))
    best = dominant(pieces, ["region"], "class", F.col(measure))
    return area.join(total, "region", "left").join(best, "region", "left").withColumn("density", F.try_divide(f"total_{measure}", "region_area"))


def points_per_region(points: DataFrame, regions: DataFrame, x: str, y: str, size: float) -> DataFrame:
    found = assign_regions(points.select(x, y), regions, x, y, "region", size).filter("region is not null").groupBy("region").agg(F.count("*").alias("n"))
    return regions.select("region").join(found, "region", "left").select("region", F.coalesce("n", F.lit(0)).alias("n"))


def geometry_quality(shapes: DataFrame) -> DataFrame:
    """Adds ``problem`` to (…, rings): null, empty, short, open, flat or crossed; null for sound polygons."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bad = [any(sweep.crosses_itself(points_of(x)) for x in r or []) for r in b.column("rings").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bad, pa.bool_())], [*b.schema.names, "_crossed"])

    crossed = shapes.mapInArrow(run, T.StructType([*shapes.schema.fields, T.StructField("_crossed", T.BooleanType())]))
    rings = F.col("rings")
    problem = (
        F.when(rings.isNull(), "null")
        .when((F.size(rings) == 0) | (F.size(rings[0]) == 0), "empty")
        .when(F.exists(rings, lambda r: F.size(r) < 4), "short")
        .when(F.exists(rings, lambda r: (F.element_at(r, 1)["x"] != F.element_at(r, -1)["x"]) | (F.element_at(r, 1)["y"] != F.element_at(r, -1)["y"])), "open")
        .when(signed_area(rings[0]) == 0, "flat")
        .when(F.col("_crossed"), "crossed")
    )
    return crossed.withColumn("problem", problem).drop("_crossed")


def prepare_layer(shapes: DataFrame, source: str, scale: float = 1.0) -> DataFrame:
    """Sound polygons of a layer with their tags, coordinates scaled to metres and attribute names normalised."""
    from gridloom.functions.text import with_normal_names

    good = geometry_quality(with_normal_names(shapes)).filter("problem is null").drop("problem")
    scaled = F.transform("rings", lambda r: F.transform(r, lambda p: F.struct((p["x"] * scale).alias("x"), (p["y"] * scale).alias("y"))))
    return good.withColumns({"rings": scaled, "layer_source": F.lit(source)}).withColumn("area", polygon_area(F.col("rings")))

