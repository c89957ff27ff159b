"""Catalogs, publication tables and the queries of a service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.dates import within
from gridloom.operators.ranking import quantiles, running_id

LEVELS = ("low", "medium", "high")  # below the lower third, between, from the upper third on
# Colour, order and use of a cluster by its levels of detections and events; then the names.
STYLES = "detection string, event string, colour string, order int, usage string, name string, name_if_observed string"
STYLE_ROWS = [
    ("high", "high", "#B91C1C", 1, "first in maps, filters and details", "much activity, confirmed by events", None),
    ("high", "medium", "#EA580C", 2, "first in maps, filters and details", "much activity, few events", None),
    ("high", "low", "#EA580C", 2, "first in maps, filters and details", "much activity, few events", None),
    ("medium", "high", "#D97706", 3, "first in maps, filters and details", "some activity, many events", None),
    ("medium", "medium", "#D97706", 3, "comparison over space and time", "some activity", None),
    ("medium", "low", "#D97706", 3, "comparison over space and time", "some activity", None),
    ("low", "high", "#2563EB", 4, "first in maps, filters and details", "little activity", "little activity, well observed"),
    ("low", "medium", "#2563EB", 4, "background", "little activity", "little activity, well observed"),
    ("low", "low", "#2563EB", 4, "background", "little activity", "little activity, well observed"),
]


def level(value: str, low: Column, high: Column) -> Column:
    return F.when(F.col(value) >= high, LEVELS[2]).when(F.col(value) >= low, LEVELS[1]).otherwise(LEVELS[0])


def cluster_catalog(profile: DataFrame, detection: str, event: str, station: str) -> DataFrame:
    """Level of three rates against their 33 and 66 % quantiles over the profile's rows (clusters, or states and clusters),
    and the style of its levels: name, colour, order, use, and a description."""
    names = {"detection": detection, "event": event, "station": station}
    cuts = {r["_c"]: r["_q"] for r in quantiles(profile, list(names.values()), [[]], [0.33, 0.66]).collect()}  # three rows
    out = profile.withColumns({f"{n}_level": level(c, *(F.lit(x).cast("double") for x in cuts.get(c, [None, None]))) for n, c in names.items()})
    styles = F.broadcast(profile.sparkSession.createDataFrame(STYLE_ROWS, STYLES))  # nine rows
    styled = out.join(styles, (out["detection_level"] == styles["detection"]) & (out["event_level"] == styles["event"]), "left").drop("detection", "event")
    observed = F.when(F.col("station_level") == LEVELS[2], F.col("name_if_observed"))
    text = F.format_string("%.1f %% of days with detections, %.1f %% with events", F.col(detection) * 100, F.col(event) * 100)
    return styled.withColumns({"name": F.coalesce(observed, "name"), "description": text}).drop("name_if_observed")


def publication(base: DataFrame, clusters: DataFrame, catalog: DataFrame, keys: list[str], cluster: str) -> DataFrame:
    """The base table with each key's cluster and the cluster's catalog entry."""
    return base.join(clusters.select(*keys, cluster), keys, "left").join(F.broadcast(catalog), cluster, "left")


def alignment(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of two tables: in both, in the first only, in the second only."""
    x, y = (t.select(*keys).distinct().withColumn(n, F.lit(True)) for t, n in ((a, "_a"), (b, "_b")))
    both = x.join(y, keys, "full_outer")
    return both.agg(F.count_if(F.col("_a") & F.col("_b")).alias("matched"), F.count_if(F.col("_b").isNull()).alias("first_only"), F.count_if(F.col("_a").isNull()).alias("second_only"))


def search(df: DataFrame, equal: dict | None = None, like: dict[str, str] | None = None, ranges: dict[str, tuple] | None = None, dates: tuple[str, str, str] | None = None, order: list | None = None) -> DataFrame:
    """Rows that meet every given condition; a condition without a value is left out."""
    for c, v in (equal or {}).items():
        if v is not None:
            df = df.filter(F.col(c) == v)
    for c, v in (like or {}).items():
        if v:
            df = df.filter(F.col(c).rlike("(?i)" + v))
    for c, (low, high) in (ranges or {}).items():
        if low is not None:
            df = df.filter(F.col(c) >= low)
        if high is not None:
            df = df.filter(F.col(c) <= high)
    if dates:
        df = df.filter(within(F.to_date(dates[0]), dates[1], dates[2]))
    return df.orderBy(*order) if order else df


def features(df: DataFrame, lon: str, lat: str, properties: list[str], order: list, most: int = 5000) -> DataFrame:
    """At most ``most`` rows (the service's limit) as GeoJSON point features."""
    point = F.struct(F.lit("Point").alias("type"), F.array(F.col(lon), F.col(lat)).alias("coordinates"))
    return df.orderBy(*order).limit(most).select(F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*properties).alias("properties"))).alias("feature"))


def feature_pages(df: DataFrame, lon: str, lat: str, properties: list[str], order: list[str], size: int = 5000) -> DataFrame:
    """(page, n, document): all rows as GeoJSON documents of at most ``size`` features each, in a total order.

    A page is as large as the service allows and no larger, so no task gathers more than that.
    """
    numbered = running_id(df, order, "_place")
    point = F.struct(F.lit("Point").alias("type"), F.array(F.col(lon), F.col(lat)).alias("coordinates"))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*properties).alias("properties")))
    page = ((F.col("_place") - 1) / size).cast("long")
    held = numbered.groupBy(page.alias("page")).agg(F.count("*").cast("int").alias("n"), F.array_sort(F.collect_list(F.struct("_place", feature.alias("feature")))).alias("f"))
    body = F.array_join(F.transform("f", lambda x: x["feature"]), ",")
    return held.select("page", "n", F.concat(F.lit('{"type":"FeatureCollection","features":['), body, F.lit("]}")).alias("document"))


def in_period(year: Column, month: Column, day: Column, kind: str, value: tuple) -> Column:
    """A year, a year and month, a range of years, or a range of dates."""
    if kind == "year":
        return year == value[0]
    if kind == "month":
        return (year == value[0]) & (month == value[1])
    if kind == "years":
        return year.between(value[0], value[1])
    return within(day, value[0], value[1])


def territory(df: DataFrame, level: str, state: str, region: str, value) -> DataFrame:
    """All rows, those of a state, or those of a region."""
    return df if level == "country" else df.filter(F.col(state if level == "state" else region) == value)


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, rows, columns) of published tables."""
    out = None
    for n, t in tables.items():
        one = t.agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "rows", F.lit(len(t.columns)).alias("columns"))
        out = one if out is None else out.union(one)
    return out
