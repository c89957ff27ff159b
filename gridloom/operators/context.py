"""Sources in one common form, contexts at several grains, feature matrices, and checks of a model's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gridloom.functions import dates as D
from gridloom.functions import geo as G
from gridloom.functions import text as T
from gridloom.operators.fusion import means_by_key
from gridloom.operators.models import log_features


def prepare_source(df: DataFrame, renames: dict[str, str], dates: list[str] = (), durations: list[str] = (), numbers: list[str] = (), codes: dict[str, int] | None = None, titles: list[str] = (), keys: list[str] = (), dms: dict[str, tuple[str, str, str, bool]] | None = None) -> DataFrame:
    """One event source in the common form, by one projection: renamed columns, dates, durations, numbers, padded codes,
    titles, text keys (``name_key``) and decimal coordinates of (degrees, minutes, seconds, west)."""
    df = df.withColumnsRenamed(renames)
    made = {c: D.registry_date(F.col(c)) for c in dates} | {c: D.duration(F.col(c)) for c in durations} | {c: T.clean_number(F.col(c)) for c in numbers}
    made |= {c: T.pad_code(F.col(c), width) for c, width in (codes or {}).items()} | {c: T.title(F.col(c)) for c in titles} | {f"{c}_key": T.text_key(F.col(c)) for c in keys}
    made |= {c: G.dms(*(T.clean_number(F.col(p)) for p in parts[:3]), west=parts[3]) for c, parts in (dms or {}).items()}
    return df.withColumns(made)


def typed_points(df: DataFrame, numbers: list[str], days: list[str], lat: str, lon: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Fields of events or detections typed before a spatial join; rows without coordinates inside the box go."""
    out = df.withColumns({c: T.number_or_null(F.col(c).cast("string")) for c in (*numbers, lat, lon)} | {c: D.file_date(F.col(c)) for c in days})
    return out.filter(G.in_box(F.col(lat), F.col(lon), box))


def canonical(df: DataFrame, synonyms: dict[str, list[str]]) -> DataFrame:
    """Adds canonical columns from the first synonym that the table has (names compared without accents and case); null without one."""
    found = {name: T.find_column(df.columns, words) for name, words in synonyms.items()}
    return df.withColumns({name: F.col(c) if c else F.lit(None).cast("string") for name, c in found.items()})


def category_column(df: DataFrame, key: str, priority: list[str], most: int = 500) -> tuple[str | None, int]:
    """The column that tells categories, and its number of values: the first of the priority list that is there, else the
    text column (not the key) of most values up to ``most``, the first by name of equal ones."""
    texts = sorted(f.name for f in df.schema if isinstance(f.dataType, StringType) and f.name != key)
    first = [c for c in priority if c in df.columns][:1]
    wanted = first or texts
    if not wanted:
        return None, 0
    values = df.select(*(F.col(c).cast("string").alias(c) for c in wanted)).unpivot([], wanted, "column", "value").dropna().distinct()
    n = {r["column"]: r["n"] for r in values.groupBy("column").agg(F.count("*").alias("n")).collect()}  # one row a column
    fit = [c for c in wanted if first or 0 < n.get(c, 0) <= most]
    return (max(fit, key=lambda c: (n.get(c, 0), -wanted.index(c))), max(n.get(c, 0) for c in fit)) if fit else (None, 0)


def assert_keys(df: DataFrame, keys: list[str], name: str) -> None:
    """Raises if a key is null or repeated anywhere in the table."""
    bad = df.groupBy(*keys).agg(F.count("*").alias("n")).filter((F.col("n") > 1) | F.greatest(*(F.col(k).isNull().cast("int") for k in keys), F.lit(0)).cast("boolean"))
    if not bad.isEmpty():
        raise ValueError(f"{name}: null or repeated keys {keys}")


def with_contexts(daily: DataFrame, contexts: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Static contexts joined many to one to daily rows: every daily row stays once; each context's keys are checked."""
    for name, (context, keys) in contexts.items():
        assert_keys(context, keys, name)
        daily = daily.join(context, keys, "left")
    return daily


def cycles_to_columns(df: DataFrame, keys: list[str], cycle: str, cycles: list[str], values: list[str]) -> DataFrame:
    """One row for each key, with a column ``value_cycle`` for each value and named cycle."""
    of = lambda v, c: F.max(F.when(F.col(cycle) == c, F.col(v))).alias(f"{v}_{c}")
    return df.groupBy(*keys).agg(*(of(v, c) for c in cycles for v in values))


def merge_contexts(base: DataFrame, tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """Wide context tables joined one after another to a base on the same keys."""
    for t in tables:
        base = base.join(t, keys, "left")
    return base


def inventory_context(table: DataFrame, grains: dict[str, list[str]], cycle: str, columns: list[str]) -> DataFrame:
    """Mean and valid count of the mostly numeric columns at each grain and cycle; keys that a grain lacks are null."""
    out, every = None, list(dict.fromkeys(k for g in grains.values() for k in g))
    for name, keys in grains.items():
        means = means_by_key(table, [*keys, cycle], columns)
        part = means.select(F.lit(name).alias("grain"), *(F.col(k) if k in keys else F.lit(None).cast(table.schema[k].dataType).alias(k) for k in every), *(c for c in means.columns if c not in keys))
        out = part if out is None else out.unionByName(part)
    return out


def feature_matrix(daily: DataFrame, day: str, counts: list[str], contexts: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Daily rows of one grain with calendar, logarithms of their counts and their contexts."""
    return with_contexts(log_features(D.calendar(daily, day), counts), contexts)


def modelling_base(df: DataFrame, keys: list[str], candidates: list[str], profile: list[str]) -> DataFrame:
    """Keys, candidate and profile columns of a matrix, in this order; raises if a column is missing or a key null or repeated."""
    wanted = list(dict.fromkeys([*keys, *candidates, *profile]))
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    base = df.select(*wanted)
    assert_keys(base, keys, "modelling base")
    return base


def model_checks(base: DataFrame, assigned: DataFrame, keys: list[str], node: str, cluster: str, variance: DataFrame, ratio: str, clusters: int, least_variance: float = 0.9) -> DataFrame:
    """(check, value, expected, ok): rows, nulls, one cluster for each node, number of clusters, and variance kept."""
    null = lambda c: F.count_if(F.col(c).isNull())
    one = assigned.agg(F.count("*").cast("double").alias("rows"), sum((null(c) for c in (*keys, node, cluster)), F.lit(0)).cast("double").alias("nulls"), F.countDistinct(cluster).cast("double").alias("clusters"))
    split = assigned.groupBy(node).agg(F.min(cluster).alias("a"), F.max(cluster).alias("b")).agg(F.count_if(F.col("a") != F.col("b")).alias("split_nodes"))
    rows, nulls, found = one.first()  # one row of totals each
    kept = variance.agg(F.round(F.sum(ratio), 6)).first()[0] or 0.0
    wanted, mixed = float(base.count()), float(split.first()[0])
    checks = [("rows", rows, wanted, rows == wanted), ("nulls", nulls, 0.0, not nulls), ("split_nodes", mixed, 0.0, not mixed), ("clusters", found, float(clusters), found == clusters), ("variance", float(kept), least_variance, kept >= least_variance)]
    return base.sparkSession.createDataFrame(checks, "check string, value double, expected double, ok boolean")


def export_rows(df: DataFrame, columns: dict[str, str | Column]) -> DataFrame:
    """The fixed columns of an export, in order and under their names, from names or expressions of the table."""
    return df.select(*((F.col(v) if isinstance(v, str) else v).alias(n) for n, v in columns.items()))
