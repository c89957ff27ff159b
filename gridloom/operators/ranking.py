"""De-duplication, ranking, shares, filling, samples and running ids."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.names import fresh
from gridloom.staging import staged


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row of each key, the first in an order that should be total."""
    n = fresh("_n", df.columns)
    return df.withColumn(n, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(n) == 1).drop(n)


def flag_repeated(df: DataFrame, keys: list[str], name: str = "repeated") -> DataFrame:
    """Flags every row whose key, if not null, occurs more than once.

    Filled keys are counted and the rows take a mark from those that repeat: a hot key, or no key at all, is a side of
    a join that adaptive execution splits, not one task's window.
    """
    times, own = fresh("_times", df.columns), [fresh(f"_repeated_{i}", df.columns) for i in range(len(keys))]
    counted = df.dropna(subset=keys).groupBy(*(F.col(k).alias(o) for k, o in zip(keys, own))).agg(F.count("*").alias(times)).filter(F.col(times) > 1)
    same = [F.col(k) == F.col(o) for k, o in zip(keys, own)]
    return df.join(counted, same, "left").withColumn(name, F.col(times).isNotNull()).select(*(c for c in df.columns if c != name), name)


def most_frequent(df: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """The attribute values that most rows of a key hold, ties to the smaller values, and how many rows hold them."""
    counted = df.groupBy(key, *attributes).agg(F.count("*").alias("n"))
    return keep_first(counted, [key], [F.desc("n"), *(F.asc_nulls_last(a) for a in attributes)])


def value_bucket(v: Column) -> Column:
    """A whole number that never falls as ``v`` rises, about 1,000 for each factor e; NaN is the largest.

    Java's log1p is monotone, so equal buckets are runs of values, wherever rounding puts their ends.
    """
    return F.when(F.isnan(v), F.lit(1 << 62)).otherwise(F.floor(F.signum(v) * F.least(F.log1p(F.abs(v) * 1_000), F.lit(1e6)) * 1_000))


def quantiles(df: DataFrame, columns: list[str], levels: list[list[str]], probabilities: list[float]) -> DataFrame:
    """(_level, _g, _c, _total, _q): exact interpolated quantiles of each column's filled values in the groups of each level.

    ``_level`` is the place in ``levels`` (an empty list is all rows), ``_g`` a struct of all levels' keys, null where a
    level doesn't use them. Rows are first counted by buckets of values (``value_bucket``), for the finest groups, and the
    counts are added up for the levels; only values of the buckets that hold the wanted ranks are then counted one by one,
    so a task holds a few thousand counts for each group and not each different value. Ranges of (group, value) are dealt
    to tasks and written; sums of the ranges tell which hold the wanted ranks, and only those are put in order. Ranges
    follow the rows, so no task holds a group, however large, also where most values share a bucket.
    """
    keys = list(dict.fromkeys(k for level in levels for k in level))
    finest = [F.struct(F.lit(0).alias("_all"), *keys).alias("_k"), *(F.col(c).cast("double").alias(c) for c in columns)]
    long = df.select(*finest).unpivot("_k", columns, "_c", "_v").filter("_v is not null").withColumn("_b", value_bucket(F.col("_v")))
    group = lambda level: F.struct(F.lit(0).alias("_all"), *((F.col(f"_k.`{k}`") if k in level else F.lit(None).cast(df.schema[k].dataType)).alias(k) for k in keys))
    by = ["_level", "_g", "_c"]

    def counted(rows: DataFrame, *of: str) -> DataFrame:
        counts = rows.groupBy("_k", "_c", *of).agg(F.count("*").alias("_n"))
        if len(levels) == 1:
            return counts.select(F.lit(0).alias("_level"), group(levels[0]).alias("_g"), "_c", *of, "_n")
        each = F.explode(F.array(*(F.struct(F.lit(i).alias("_level"), group(level).alias("_g")) for i, level in enumerate(levels)))).alias("_e")
        return counts.select(each, "_c", *of, "_n").select("_e.*", "_c", *of, "_n").groupBy(*by, *of).agg(F.sum("_n").alias("_n"))

    place = lambda p: (F.col("_total") - 1) * F.lit(float(p))
    ranks = [f(place(p)).cast("long") for p in probabilities for f in (F.floor, F.ceil)]
    asked = reduce(or_, ((r >= F.col("_before")) & (r < F.col("_before") + F.col("_in")) for r in ranks))
    whole = Window.partitionBy(*by)  # a row for each bucket of a group
    buckets = counted(long, "_b").withColumnRenamed("_n", "_in")
    buckets = buckets.withColumns({"_total": F.sum("_in").over(whole), "_before": F.sum("_in").over(whole.orderBy("_b")) - F.col("_in")})
    wanted = staged(buckets.filter(asked).select(*by, "_b", "_total", F.col("_before").alias("_first")), "buckets")
    values = counted(long.join(wanted.select("_c", "_b").distinct(), ["_c", "_b"], "left_semi"), "_b", "_v").join(wanted, [*by, "_b"])
    placed = staged(values.repartitionByRange(*by, "_v").withColumn("_p", F.spark_partition_id()), "ranges")
    sums = placed.groupBy("_p", *by, "_b", "_total", "_first").agg(F.sum("_n").alias("_in"))
    inner = Window.partitionBy(*by, "_b").orderBy("_p")  # a row for each range and bucket in it
    sums = sums.withColumn("_before", F.col("_first") + F.sum("_in").over(inner) - F.col("_in"))
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy("_p", *by, "_b").orderBy("_v"))
    ranked = placed.join(sums.filter(asked).select("_p", *by, "_b", "_before"), ["_p", *by, "_b"]).withColumn("_upto", upto)
    at = [F.max(F.when((F.col("_upto") > r) & (F.col("_upto") - F.col("_n") <= r), F.col("_v"))) for r in ranks]
    found = ranked.groupBy(*by, "_total").agg(*(v.alias(f"_r{i}") for i, v in enumerate(at)))
    low, high = (lambda i: F.col(f"_r{2 * i}")), (lambda i: F.col(f"_r{2 * i + 1}"))
    value = lambda i, p: F.when(low(i) == high(i), low(i)).otherwise(low(i) + (place(p) - F.floor(place(p))) * (high(i) - low(i)))
    return staged(found.select(*by, "_total", F.array(*(value(i, p) for i, p in enumerate(probabilities))).alias("_q")), "quantiles")


def _wide_medians(found: DataFrame, columns: list[str], level: int, groups: list[str], name: str) -> DataFrame:
    own = found.filter(F.col("_level") == level).groupBy("_g").agg(*(F.max(F.when(F.col("_c") == c, F.col("_q")[0])).alias(f"{name}{c}") for c in columns))
    return own.select(*(F.col(f"_g.`{g}`").alias(g) for g in groups), *(f"{name}{c}" for c in columns))


def medians(df: DataFrame, columns: list[str], groups: list[str]) -> DataFrame:
    """Exact medians ``_m_<column>`` of each group's filled values; groups without any have no row."""
    return _wide_medians(quantiles(df, columns, [groups], [0.5]), columns, 0, groups, "_m_")


def fill_medians(df: DataFrame, columns: list[str], levels: list[list[str]], measured: DataFrame | None = None) -> DataFrame:
    """Nulls filled by the median of the first level of groups that has one, then of all rows, then by 0.

    Medians are those of ``measured``, if given: the table before other columns were filled, which spares its joins.
    All levels share one table of counted values; each level is one join on its keys, and all rows are one row.
    """
    names = df.columns
    found = quantiles(df if measured is None else measured, columns, [*levels, []], [0.5])
    tables = [_wide_medians(found, columns, i, level, f"_m{i}_") for i, level in enumerate(levels)]
    return filled_from(df, columns, levels, tables, _wide_medians(found, columns, len(levels), [], "_m_").first()).select(*names)


def filled_from(df: DataFrame, columns: list[str], levels: list[list[str]], tables: list[DataFrame], total) -> DataFrame:
    """Nulls filled from tables of medians (``_m<level>_<column>``), then from ``total`` (``_m_<column>``), then by 0."""
    out = df
    for level, table in zip(levels, tables):
        out = out.join(table, level, "left")
    return out.withColumns({c: F.coalesce(c, *(f"_m{i}_{c}" for i in range(len(levels))), F.lit(total and total[f"_m_{c}"] or 0.0)) for c in columns})


def share(df: DataFrame, value: str, keys: list[str], name: str = "share", digits: int = 6) -> DataFrame:
    return df.withColumn(name, F.round(F.try_divide(F.col(value), F.sum(value).over(Window.partitionBy(*keys))), digits))


def cumulative(df: DataFrame, value: str, order: str, levels: tuple[float, ...] = (0.7, 0.8, 0.85, 0.9, 0.95)) -> tuple[DataFrame, DataFrame]:
    """Running sums in order, and for each level the first place that reaches it. For tables of components, not of rows."""
    run = df.withColumn("cumulative", F.sum(value).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    first = run.agg(*(F.min(F.when(F.col("cumulative") >= x, F.col(order))).alias(f"at_{round(x * 100)}") for x in levels))
    return run, first


def rank_loadings(loadings: DataFrame, component: str, feature: str, loading: str) -> DataFrame:
    """Rank by absolute loading within a component, and the percentage of its squared loadings."""
    w = Window.partitionBy(component)
    square = F.col(loading) * F.col(loading)
    return loadings.withColumns({"rank": F.row_number().over(w.orderBy(F.desc(F.abs(loading)), feature)), "contribution": F.round(F.try_divide(square * 100, F.sum(square).over(w)), 6)})


def renumber(df: DataFrame, label: str, weight: Column | None = None, noise: int | None = None, start: int = 1, name: str = "cluster") -> DataFrame:
    """New labels from ``start`` on by descending size, ties to the smaller old label; a noise label stays."""
    sizes = df.groupBy(label).agg((F.count("*") if weight is None else F.sum(weight)).alias("_size"))
    real = sizes if noise is None else sizes.filter(F.col(label) != noise)
    numbers = real.withColumn(name, (F.row_number().over(Window.orderBy(F.desc("_size"), label)) + start - 1).cast("int")).select(label, name)  # one row for each label
    return df.join(F.broadcast(numbers), label, "left").withColumn(name, F.coalesce(name, F.lit(noise)))


def fill_down(df: DataFrame, keys: list[str], order: list[str], column: str) -> DataFrame:
    """Nulls take the last value above them."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(column, F.last(column, ignorenulls=True).over(w))


def running_id(df: DataFrame, order: list[str], name: str = "id", partitions: int | None = None) -> DataFrame:
    """A dense id from 1 on in a total order, without a window over all rows.

    Rows are dealt by ranges of the order and written once; each file range counts its rows, and a row's id is its place
    in its range behind the counts of the ranges before.
    """
    part, n, before, inner = (fresh(c, df.columns) for c in ("_p", "_n", "_before", "_i"))
    dealt = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    placed = staged(dealt.withColumn(part, F.spark_partition_id()), "ranges")
    counts = placed.groupBy(part).agg(F.count("*").alias(n))
    sums = counts.withColumn(before, F.coalesce(F.sum(n).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(part, before)  # one row for each range
    place = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return placed.withColumn(inner, place).join(F.broadcast(sums), part).withColumn(name, F.col(before) + F.col(inner)).select(*(c for c in df.columns if c != name), name)


def top_n(df: DataFrame, order: list, n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def top_values(df: DataFrame, column: str, n: int) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last(column)).limit(n)


def capped_sample(df: DataFrame, group: str, cap: int, order: list) -> DataFrame:
    """At most ``cap`` rows of each group, the first in ``order`` (a hash makes that a repeatable random sample)."""
    n = fresh("_n", df.columns)
    return df.withColumn(n, F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col(n) <= cap).drop(n)


def digest(keys: list[str]) -> Column:
    """MD5 of the keys as text, the same in every engine; null keys are left out."""
    return F.md5(F.concat_ws("\x1f", *(F.col(k).cast("string") for k in keys)))


def largest_remainder(sizes: DataFrame, group: str, n: int, cap: int | None = None) -> DataFrame:
    """Adds ``quota`` to (group, size): ``n`` places in proportion to the sizes, whole, adding up to n (or to all rows, if
    fewer); the places that are left go to the largest remainders, ties to the smaller group. Then each is cut to ``cap``."""
    all_groups = Window.partitionBy(F.lit(1))  # a row for each group
    total = F.sum("size").over(all_groups)
    places = F.least(F.lit(n).cast("long"), F.col("_total"))
    shared = sizes.withColumn("_total", total).withColumns({"_whole": F.expr("cast(least(cast(%d as bigint), _total) * cast(size as decimal(38, 0)) div _total as bigint)" % n)})
    shared = shared.withColumn("_rest", places * F.col("size").cast("decimal(20,0)") - F.col("_whole").cast("decimal(20,0)") * F.col("_total"))
    left = places - F.sum("_whole").over(all_groups)
    order = F.row_number().over(all_groups.orderBy(F.desc("_rest"), F.asc_nulls_first(group)))
    quota = F.col("_whole") + (F.col("_order") <= F.col("_left")).cast("long")
    out = shared.withColumns({"_left": left, "_order": order})
    return out.select(group, "size", (quota if cap is None else F.least(quota, F.lit(cap).cast("long"))).alias("quota"))


def quota_sample(df: DataFrame, group: str, quotas: DataFrame, keys: list[str]) -> DataFrame:
    """As many rows of each group as its ``quota`` (group, quota) says: those of the smallest digests of the keys.

    Rows are counted by the start of their digest; whole starts are taken until the quota, and only the start where it
    ends is put in order. So neither a sort of the rows nor a group in one task is needed, and the sample is the same in
    any layout. Equal keys are told apart by the row's other plain columns; groups without a quota give no row.
    """
    names = {c: fresh(f"_{c}", df.columns) for c in ("digest", "start", "group", "rank", "quota", "before", "size")}
    d, start, own, rank, quota, before, size = names.values()
    marked = df.withColumns({d: digest(keys), own: F.struct(F.col(group))}).withColumn(start, F.substring(d, 1, 3))
    counts = marked.groupBy(own, start).agg(F.count("*").alias(size))
    held = counts.withColumn(before, F.sum(size).over(Window.partitionBy(own).orderBy(start)) - F.col(size))  # 4,096 starts a group
    wanted = quotas.select(F.struct(F.col(group).alias(group)).alias(own), F.col("quota").alias(quota))
    taken = held.join(wanted, own).filter(F.col(before) < F.col(quota)).select(own, start, (F.col(quota) - F.col(before)).alias(quota))
    plain = [f.name for f in df.schema if isinstance(f.dataType, T.AtomicType)]
    order = F.row_number().over(Window.partitionBy(own, start).orderBy(d, *plain))
    return marked.join(taken, [own, start]).withColumn(rank, order).filter(F.col(rank) <= F.col(quota)).select(*df.columns)


def fixed_sample(df: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """Exactly ``n`` rows (all, if fewer): those of the smallest digests of the keys."""
    one = fresh("_one", df.columns)
    quotas = df.sparkSession.createDataFrame([(1, n)], f"{one} int, quota long")
    return quota_sample(df.withColumn(one, F.lit(1)), one, quotas, keys).drop(one)


def proportional_sample(df: DataFrame, group: str, n: int, cap: int | None, keys: list[str]) -> DataFrame:
    """``n`` rows shared among the groups in proportion to their sizes, then at most ``cap`` of each group."""
    sizes = df.groupBy(group).agg(F.count("*").alias("size"))
    return quota_sample(df, group, largest_remainder(sizes, group, n, cap), keys)


def hash_sample(df: DataFrame, fraction: float, keys: list[str]) -> DataFrame:
    """A repeatable share of rows: those whose key's MD5 starts below that share of all 32-bit values, the same in every engine."""
    if fraction >= 1:
        return df
    return df.filter(F.substring(digest(keys), 1, 8) < f"{int(fraction * (1 << 32)):08x}")


def ordered(df: DataFrame, first: list[str]) -> DataFrame:
    """Columns of a priority list first, the others behind them."""
    lead = [c for c in first if c in df.columns]
    return df.select(*lead, *(c for c in df.columns if c not in lead))
