"""Coordinate and plane-geometry expressions. Rings are arrays of points (x, y) in one metric system."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dms(degrees: Column, minutes: Column, seconds: Column, west: bool = False) -> Column:
    """Degrees, minutes and seconds as decimal degrees; a longitude is put in the west."""
    value = F.abs(degrees) + F.coalesce(minutes, F.lit(0)) / 60 + F.coalesce(seconds, F.lit(0)) / 3600
    return -F.abs(value) if west else F.when(degrees < 0, -value).otherwise(value)


def zero_to_null(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """Both coordinates null where either is zero or null."""
    ok = (F.col(lat) != 0) & (F.col(lon) != 0)
    return df.withColumns({lat: F.when(ok, F.col(lat)), lon: F.when(ok, F.col(lon))})


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot(x1 - x2, y1 - y2)


def same(a: Column, b: Column) -> Column:
    """Equal and not null."""
    return F.coalesce(a == b, F.lit(False))


def same_within(a: Column, b: Column, tolerance: float) -> Column:
    return F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))


def percentage(part: Column, whole: Column) -> Column:
    return F.round(F.try_divide(part * 100.0, whole), 4)


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    """Within (least latitude, largest latitude, least longitude, largest longitude), nulls outside."""
    return F.coalesce(lat.between(box[0], box[1]) & lon.between(box[2], box[3]), F.lit(False))


def signed_area(ring: Column) -> Column:
    """Shoelace area of a closed ring, positive counter-clockwise."""
    steps = F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.aggregate(steps, F.lit(0.0), lambda a, s: a + s) / 2


def polygon_area(rings: Column) -> Column:
    """Area of the first ring less that of the others (holes)."""
    return F.aggregate(rings, F.lit(None).cast("double"), lambda a, r: F.when(a.isNull(), F.abs(signed_area(r))).otherwise(a - F.abs(signed_area(r))))


def line_length(path: Column) -> Column:
    steps = F.zip_with(F.slice(path, F.lit(1), F.size(path) - 1), F.slice(path, F.lit(2), F.size(path) - 1), lambda p, q: F.hypot(p["x"] - q["x"], p["y"] - q["y"]))
    return F.aggregate(steps, F.lit(0.0), lambda a, s: a + s)


def crossings(ring: Column, x: Column, y: Column) -> Column:
    """Edges of a closed ring that a ray from (x, y) to the right crosses."""
    crossed = F.zip_with(
        F.slice(ring, F.lit(1), F.size(ring) - 1),
        F.slice(ring, F.lit(2), F.size(ring) - 1),
        lambda p, q: (((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * F.try_divide(y - p["y"], q["y"] - p["y"]) + p["x"])).cast("int"),
    )
    return F.aggregate(crossed, F.lit(0), lambda a, s: a + F.coalesce(s, F.lit(0)))


def on_edge(ring: Column, x: Column, y: Column) -> Column:
    touched = F.zip_with(
        F.slice(ring, F.lit(1), F.size(ring) - 1),
        F.slice(ring, F.lit(2), F.size(ring) - 1),
        lambda p, q: ((q["x"] - p["x"]) * (y - p["y"]) == (q["y"] - p["y"]) * (x - p["x"])) & x.between(F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"])) & y.between(F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"])),
    )
    return F.exists(touched, lambda t: t)


def inside(rings: Column, x: Column, y: Column) -> Column:
    """Strictly within a polygon: an odd number of crossings over all rings, and on none of their edges."""
    total = F.aggregate(F.transform(rings, lambda r: crossings(r, x, y)), F.lit(0), lambda a, s: a + s)
    return (total % 2 == 1) & ~F.exists(rings, lambda r: on_edge(r, x, y))


def best_pair(df: DataFrame, pairs: list[tuple[str, str]], box: tuple[float, float, float, float]) -> tuple[str, str]:
    """The coordinate pair with most points in the box, ties to the first."""
    row = df.agg(*(F.count_if(in_box(F.col(a).try_cast("double"), F.col(b).try_cast("double"), box)).alias(f"p{i}") for i, (a, b) in enumerate(pairs))).first()
    return pairs[max(range(len(pairs)), key=lambda i: (row[i], -i))]


def fix_swapped(df: DataFrame, lat: str, lon: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Exchanges the two columns if more points lie in the box that way round."""
    straight, swapped = df.agg(F.count_if(in_box(F.col(lat), F.col(lon), box)), F.count_if(in_box(F.col(lon), F.col(lat), box))).first()
    return df.withColumns({lat: F.col(lon), lon: F.col(lat)}) if swapped > straight else df
