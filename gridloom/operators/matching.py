"""Registry matching: 1:1 checks, agreement scores, reconciliation and keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.geo import same, same_within
from gridloom.functions.names import fresh


def one_of_each(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The table itself; a key that repeats stops the job that reads it, with an error that names the key.

    Keys are counted in the shuffle that a join on them needs anyway. Null keys count as one key.
    """
    rest = [c for c in df.columns if c not in keys]
    n, row = fresh("_n", df.columns), fresh("_row", df.columns)
    counted = df.groupBy(*keys).agg(F.count("*").alias(n), F.first(F.struct(*rest) if rest else F.lit(0)).alias(row))
    told = F.raise_error(F.concat(F.lit(f"{name}: a key of {keys} repeats: "), F.to_json(F.struct(*keys))))
    return counted.filter(F.when(F.col(n) > 1, told.cast("boolean")).otherwise(F.lit(True))).select(*(F.col(c) if c in keys else F.col(row)[c].alias(c) for c in df.columns))


def match(left: DataFrame, right: DataFrame, key: str, exact: list[str], tolerant: dict[str, float], position: tuple[str, str], position_tolerance: float) -> DataFrame:
    """Full outer 1:1 match of two registries with the same columns: side, agreement tests, score and class.

    Columns come back as left_<c> and right_<c>. A test of nulls fails; the class follows the number of tests passed.
    """
    l, r = left.select([F.col(c).alias(f"left_{c}") for c in left.columns]), right.select([F.col(c).alias(f"right_{c}") for c in right.columns])
    both = l.join(r, F.col(f"left_{key}") == F.col(f"right_{key}"), "full_outer")
    a, b = position
    away = F.hypot(F.col(f"left_{a}") - F.col(f"right_{a}"), F.col(f"left_{b}") - F.col(f"right_{b}"))
    tests = {f"same_{c}": same(F.col(f"left_{c}"), F.col(f"right_{c}")) for c in exact}
    tests |= {f"same_{c}": same_within(F.col(f"left_{c}"), F.col(f"right_{c}"), t) for c, t in tolerant.items()}
    tests["same_position"] = F.coalesce(away <= position_tolerance, F.lit(False))
    side = F.when(F.col(f"right_{key}").isNull(), "left_only").when(F.col(f"left_{key}").isNull(), "right_only").otherwise("both")
    out = both.withColumns({"side": side, "distance": away, **tests})
    out = out.withColumn("score", sum((F.col(t).cast("int") for t in tests), F.lit(0)))
    level = F.when(F.col("score") >= 5, "match_high").when(F.col("score") >= 3, "match_medium").when(F.col("score") >= 1, "match_weak").otherwise("match_conflict")
    return out.withColumn("class", F.when(F.col("side") == "both", level).otherwise(F.col("side")))


def reconcile(matched: DataFrame, key: str, prefer_left: list[str], prefer_right: list[str], position: tuple[str, str], valid: Column | None = None) -> DataFrame:
    """One row for each match: the preferred side's values where it has them, and the first valid position with its origin."""
    a, b = position
    ok = lambda s: F.col(f"{s}_{a}").isNotNull() & F.col(f"{s}_{b}").isNotNull() & (F.col(f"{s}_{a}") != 0)
    pos = lambda c: F.when(ok("left"), F.col(f"left_{c}")).when(ok("right"), F.col(f"right_{c}"))
    return matched.select(
        F.coalesce(f"left_{key}", f"right_{key}").alias(key),
        *(F.coalesce(f"left_{c}", f"right_{c}").alias(c) for c in prefer_left),
        *(F.coalesce(f"right_{c}", f"left_{c}").alias(c) for c in prefer_right),
        pos(a).alias(a),
        pos(b).alias(b),
        F.when(ok("left"), "left").when(ok("right"), "right").alias("position_from"),
        "side",
        "class",
    )


def by_vocabulary(first: Column, second: Column, words: dict[str, str]) -> Column:
    """An attribute that stands in either of two mixed columns, told by its vocabulary."""
    pairs = F.create_map(*(F.lit(x) for kv in words.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, F.lower(first)), F.try_element_at(pairs, F.lower(second)))


def final_schema(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Exactly these columns in this order; missing ones are null, values that can't be cast too."""
    return df.select([(F.col(c).try_cast(t) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in schema.items()])


def complete_keys(df: DataFrame, states: DataFrame, regions: DataFrame) -> DataFrame:
    """Fills missing state codes by state name, then region codes by state code and region name.

    df: state, state_name, region, region_name; states: state, state_name; regions: state, region, region_name.
    """
    s = states.select(F.col("state").alias("_state"), F.lower("state_name").alias("_sn")).dropDuplicates(["_sn"])
    r = regions.select(F.col("state").alias("_s"), F.col("region").alias("_region"), F.lower("region_name").alias("_rn")).dropDuplicates(["_s", "_rn"])
    out = df.join(s, F.lower("state_name") == F.col("_sn"), "left").withColumn("state", F.coalesce("state", "_state"))
    out = out.join(r, (F.col("state") == F.col("_s")) & (F.lower("region_name") == F.col("_rn")), "left").withColumn("region", F.coalesce("region", "_region"))
    return out.select(df.columns)


def prefer_spatial(df: DataFrame, spatial: str, declared: str) -> DataFrame:
    """The spatial key where there is one, else the declared one; the method and whether both disagree."""
    s, d = F.col(spatial), F.col(declared)
    return df.withColumns({"key": F.coalesce(s, d), "method": F.when(s.isNotNull(), "spatial").when(d.isNotNull(), "declared").otherwise("none"), "conflict": F.coalesce(s != d, F.lit(False))})


def orphans(df: DataFrame, dim: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys).distinct().join(dim, keys, "left_anti")


def totals_agree(a: DataFrame, b: DataFrame, key: str, value: str, tolerance: float) -> DataFrame:
    """Per-key sums of two tables side by side, their difference and whether it is within the tolerance."""
    x, y = (t.groupBy(key).agg(F.sum(value).alias(n)) for t, n in ((a, "first"), (b, "second")))
    return x.join(y, key, "full_outer").withColumn("difference", F.abs(F.coalesce("first", F.lit(0.0)) - F.coalesce("second", F.lit(0.0)))).withColumn("agrees", F.col("difference") <= tolerance)


def uniqueness(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.count(key).alias("filled"), F.countDistinct(key).alias("distinct"), (F.count(key) - F.countDistinct(key)).alias("surplus"))


def reasons(flags: list[str], separator: str = "; ") -> Column:
    """Names of the flags that are set, null if none is."""
    return F.nullif(F.concat_ws(separator, *(F.when(F.col(f), F.lit(f)) for f in flags)), F.lit(""))
