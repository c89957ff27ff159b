"""Three daily sources fused to one row for each region and day, and rolled up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.dates import within


def event_days(events: DataFrame, keys: list[str], amount: str, prefix: str = "event") -> DataFrame:
    """Count, sum (0 where all amounts are null) and mean of events."""
    return events.groupBy(*keys).agg(F.count("*").alias(f"{prefix}_count"), F.coalesce(F.sum(amount), F.lit(0.0)).alias(f"{prefix}_amount_sum"), F.avg(amount).alias(f"{prefix}_amount_mean"))


def detection_days(detections: DataFrame, keys: list[str], power: str, is_day: Column, measures: list[str] = (), prefix: str = "detection") -> DataFrame:
    """Counts by day and night, the power's sum, and mean and valid count of power and further measures."""
    means = [f(m).alias(f"{prefix}_{m}_{n}") for m in [power, *measures] for f, n in ((F.avg, "mean"), (F.count, "valid_count"))]
    return detections.groupBy(*keys).agg(F.count("*").alias(f"{prefix}_count"), F.coalesce(F.sum(power), F.lit(0.0)).alias(f"{prefix}_{power}_sum"), F.count_if(is_day).alias(f"{prefix}_day_count"), F.count_if(~is_day).alias(f"{prefix}_night_count"), *means)


def station_days(readings: DataFrame, keys: list[str], station: str, measures: list[str], prefix: str = "station") -> DataFrame:
    """Distinct stations, and mean and valid count of each measure."""
    means = [f(m).alias(f"{prefix}_{m}_{n}") for m in measures for f, n in ((F.avg, "mean"), (F.count, "valid_count"))]
    return readings.groupBy(*keys).agg(F.countDistinct(station).alias(f"{prefix}_n"), *means)


def key_universe(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    out = sources[0].select(*keys)
    for s in sources[1:]:
        out = out.union(s.select(*keys))
    return out.distinct()


def fuse(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """Every key of any source with the columns of all: full outer joins on the keys, which share one partitioning."""
    out = sources[0]
    for s in sources[1:]:
        out = out.join(s, keys, "full_outer")
    return out


def availability(base: DataFrame, marks: dict[str, str], zero: list[str], period: tuple[str, str, str], in_period_zero: list[str], day: str = "day") -> DataFrame:
    """Flags has_<source> from the column that marks it, zero-filled counts and the source mask.

    ``zero`` columns become 0 where null; ``in_period_zero`` only between the dates of ``period`` (name, first, last),
    since before its source began nothing is known. Means stay null.
    """
    name, first, last = period
    covered = within(F.col(day), first, last)
    flags = {f"has_{s}": F.col(c).isNotNull().cast("int") for s, c in marks.items()}
    out = base.withColumns({**flags, f"{name}_available": covered.cast("int")})
    out = out.withColumns({**{c: F.coalesce(c, F.lit(0)) for c in zero}, **{c: F.when(covered, F.coalesce(c, F.lit(0))).otherwise(F.col(c)) for c in in_period_zero}})
    return out.withColumn("source_mask", F.concat_ws("|", *(F.concat(F.lit(f"{s.upper()}:"), F.col(f"has_{s}")) for s in marks)))


def weighted_mean(mean: str, count: str) -> Column:
    """Mean of means weighted by their valid counts, null without valid values."""
    valid = F.col(mean).isNotNull() & (F.col(count) > 0)
    return F.try_divide(F.sum(F.when(valid, F.col(mean) * F.col(count))), F.sum(F.when(valid, F.col(count))))


def roll_up(base: DataFrame, keys: list[str], region: str, sums: list[str], flags: list[str], means: dict[str, str]) -> DataFrame:
    """Coarser regions: distinct regions, regions with each flag, flag maxima, sums (null if all are) and weighted means."""
    return base.groupBy(*keys).agg(
        F.countDistinct(region).alias("n_regions"),
        *(F.count_if(F.col(f) == 1).alias(f"n_regions_{f}") for f in flags),
        *(F.max(f).alias(f) for f in flags),
        *(F.sum(c).alias(c) for c in sums),
        *(weighted_mean(m, c).alias(m) for m, c in means.items()),
    )


def control_totals(detail: DataFrame, rolled: DataFrame, columns: list[str], tolerance: float = 1e-4) -> DataFrame:
    """One row for each column: its sum in both tables and whether they agree."""
    a, b = (t.agg(*(F.sum(F.col(c).cast("double")).alias(c) for c in columns)).unpivot([], columns, "column", n) for t, n in ((detail, "detail"), (rolled, "rolled")))
    return a.join(b, "column").withColumn("agrees", F.coalesce(F.abs(F.col("detail") - F.col("rolled")) <= tolerance, F.lit(False)))


def cubes(df: DataFrame, grains: dict[str, list[str]], measures: list[Column]) -> DataFrame:
    """One row for each group of each grain, named in ``grain``; keys that a grain lacks are null."""
    keys = list(dict.fromkeys(k for g in grains.values() for k in g))
    sets = [[F.col(k) for k in g] for g in grains.values()]
    number = lambda g: sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in g)
    name = F.lit(None).cast("string")
    for n, g in grains.items():
        name = F.when(F.col("_id") == number(g), n).otherwise(name)
    return df.groupingSets(sets, *map(F.col, keys)).agg(F.grouping_id().alias("_id"), *measures).withColumn("grain", name).drop("_id")


def dominant(df: DataFrame, keys: list[str], category: str, weight: Column | None = None) -> DataFrame:
    """The category of most rows (or weight) in each group, ties to the smaller one; its weight, share and the number of categories."""
    per = df.filter(F.col(category).isNotNull()).groupBy(*keys, category).agg((F.count("*") if weight is None else F.sum(weight)).alias("_w"))
    w = F.col("_w")
    first = F.min(F.when(w.isNotNull(), F.struct(~F.isnan(w.cast("double")), (-w).alias("least"), F.col(category).alias("category"), w.alias("weight"))))  # one pass: sums of doubles computed twice may differ in their last digit
    best = per.groupBy(*keys).agg(first.alias("_best"), F.sum("_w").alias("_all"), F.count("*").alias("n_categories")).filter("_best is not null")
    return best.select(*keys, F.col("_best.category").alias("dominant"), F.col("_best.weight").alias("dominant_weight"), "n_categories", F.try_divide("_best.weight", "_all").alias("dominant_share"))


def numeric_share(df: DataFrame, columns: list[str], least: float = 0.5) -> list[str]:
    """Columns of which at least a share of non-null values are numbers; one pass."""
    row = df.agg(*(F.avg(F.when(F.col(c).isNotNull(), F.col(c).cast("string").try_cast("double").isNotNull().cast("double"))).alias(c) for c in columns)).first()
    return [c for c in columns if (row[c] or 0) >= least]


def means_by_key(df: DataFrame, keys: list[str], columns: list[str], prefix: str = "") -> DataFrame:
    """Mean and valid count of each column that is mostly numeric."""
    chosen = numeric_share(df, columns)
    return df.groupBy(*keys).agg(*(f(F.col(c).cast("string").try_cast("double")).alias(f"{prefix}{c}_{n}") for c in chosen for f, n in ((F.avg, "mean"), (F.count, "valid_count"))))


def context_roll_up(context: DataFrame, keys: list[str], area: str, category: str, sums: list[str]) -> DataFrame:
    """Context of coarser regions: sums, and the category that covers most area."""
    return context.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums)).join(dominant(context, keys, category, F.col(area)), keys, "left")


def scopes(df: DataFrame, grains: dict[str, list[str]], measures: list[Column], domain: str, top: int = 10) -> DataFrame:
    """Quality summary at several scopes in one pass of grouping sets, with the most frequent values of a domain.

    Values are counted by grouping sets too; only the ``top`` of each scope are joined to text.
    """
    from pyspark.sql import Window

    keys = list(dict.fromkeys(k for g in grains.values() for k in g))
    totals = cubes(df, grains, measures)
    counted = cubes(df, {n: [*g, domain] for n, g in grains.items()}, [F.count("*").alias("_n")])
    order = Window.partitionBy("grain", *keys).orderBy(F.desc("_n"), F.asc_nulls_first(domain))
    few = counted.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= top)
    text = F.concat_ws(":", F.coalesce(F.col(domain).cast("string"), F.lit("null")), F.col("_n").cast("string"))
    few = few.groupBy("grain", *keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", text.alias("t")))), lambda s: s["t"]), ",").alias("top_values"))
    same = [totals[k].eqNullSafe(few[k]) for k in ("grain", *keys)]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    return totals.join(few, condition, "left").select(*(totals[c] for c in totals.columns), "top_values")
