"""Quality flags, column profiles, contracts and reports."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.names import fresh
from gridloom.operators.ranking import quantiles

from gridloom.functions.geo import in_box
from gridloom.functions.text import has_mojibake
from gridloom.operators.matching import reasons
from gridloom.operators.ranking import flag_repeated

def any_flag(flags: list[str]) -> Column:
    return reduce(or_, (F.coalesce(F.col(f), F.lit(False)) for f in flags), F.lit(False))


def with_flags(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """Named Boolean columns; a test that can't be made is false."""
    return df.withColumns({n: F.coalesce(c, F.lit(False)) for n, c in flags.items()})


def keep_valid(df: DataFrame, blocking: list[str]) -> DataFrame:
    """Rows without a blocking flag; warnings stay as columns."""
    return df.filter(~any_flag(blocking))


def invalid_report(df: DataFrame, blocking: list[str]) -> DataFrame:
    return df.filter(any_flag(blocking)).withColumn("reasons", reasons(blocking))


def count_flags(df: DataFrame, flags: list[str]) -> DataFrame:
    """(flag, n) for every flag and the number of rows, from one pass."""
    one = df.agg(F.count("*").alias("rows"), *(F.count_if(F.col(f)).alias(f) for f in flags))
    return one.unpivot([], ["rows", *flags], "flag", "n")


def event_flags(df: DataFrame, key: str, year: str, begin: str, finish: str, lat: str, lon: str, state: str, region: str, texts: list[str], years: tuple[int, int], box: tuple[float, float, float, float]) -> tuple[DataFrame, list[str], list[str]]:
    """Ten blocking and six warning flags of an event table, fitness for three uses, and reasons."""
    c, missing = F.col, lambda n: F.col(n).isNull()
    errors = {
        "key_missing": missing(key),
        "key_repeated": c("_repeated"),
        "year_missing": missing(year),
        "year_outside": ~c(year).between(*years),
        "begin_missing": missing(begin),
        "lat_missing": missing(lat),
        "lon_missing": missing(lon),
        "outside_box": c(lat).isNotNull() & c(lon).isNotNull() & ~in_box(c(lat), c(lon), box),
        "state_width": ~c(state).rlike(r"^\d{2}$"),
        "region_width": ~c(region).rlike(r"^\d{3}$"),
    }
    warnings = {
        "finish_missing": missing(finish),
        "finish_before_begin": c(finish) < c(begin),
        "state_missing": missing(state),
        "region_missing": missing(region),
        "year_differs": c(year) != F.year(begin),
        "mojibake": reduce(or_, (has_mojibake(c(t)) for t in texts), F.lit(False)),
    }
    out = with_flags(flag_repeated(df, [key], "_repeated"), errors | warnings).drop("_repeated")
    out = out.withColumns({"blocking": any_flag(list(errors)), "warning": any_flag(list(warnings))})
    fit = ~c("blocking")
    out = out.withColumns({"fit_spatial": fit, "fit_regional": fit & c(state).isNotNull() & c(region).isNotNull(), "fit_duration": fit & F.coalesce(c(finish) >= c(begin), F.lit(False)), "reasons": reasons([*errors, *warnings])})
    return out, list(errors), list(warnings)


def measured(df: DataFrame) -> DataFrame:
    """(column, type, rows, missing, distinct, least, largest, whole) of each column, by counts of its values.

    Values are unpivoted and counted before they are told apart, so no row is expanded for each distinct count. least,
    largest and whole (no fractions) are of numbers.
    """
    types = F.create_map(*(F.lit(x) for name, kind in df.dtypes for x in (name, kind)))
    numbers = [name for name, kind in df.dtypes if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")]
    values = df.select(*(F.col(c).cast("string").alias(c) for c in df.columns)).unpivot([], df.columns, "column", "value")
    counts = values.groupBy("column", "value").agg(F.count("*").alias("n"))
    number = F.when(F.col("column").isin(numbers), F.col("value").try_cast("double"))
    out = counts.groupBy("column").agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing"), F.count("value").alias("distinct"), F.min(number).alias("least"), F.max(number).alias("largest"), F.every(F.coalesce(number == F.floor(number), F.lit(True))).alias("whole"))
    return out.withColumn("type", types[F.col("column")])


def roles(columns: DataFrame, known: dict[str, str] | None = None, identifier: float = 0.95, categories: int = 50) -> DataFrame:
    """Adds ``role``: the caller's own for columns in ``known``, else what the measures of ``measured`` say.

    Dates are times; values nearly all different are identifiers; two values or fewer are a flag; numbers without
    fractions are counts, within 0 and 1 shares, else measures; few texts are a category, many are text.
    """
    c, own = F.col, F.lit(None).cast("string")
    for name, given in (known or {}).items():
        own = F.when(c("column") == name, given).otherwise(own)
    numeric, filled = c("least").isNotNull(), F.nullif(c("rows") - c("missing"), F.lit(0))
    told = F.when(c("distinct") == 0, "empty").when(c("type").isin("date", "timestamp", "timestamp_ntz"), "time").when(c("distinct") <= 2, "flag")
    told = told.when((~numeric | c("whole")) & (c("distinct") >= identifier * filled), "identifier").when(numeric & c("whole"), "count").when(numeric & (c("least") >= 0) & (c("largest") <= 1), "share")
    told = told.when(numeric, "measure").when(c("distinct") <= categories, "category").otherwise("text")
    return columns.withColumn("role", F.coalesce(own, told))


def leakage(columns: DataFrame, targets: list[str], sources: dict[str, str] | None = None) -> DataFrame:
    """Adds ``leakage``: "target" for the caller's target columns, "same_source" for others of a target's source, else "none"."""
    origin = sources or {}
    near = [c for c, s in origin.items() if s in {origin[t] for t in targets if t in origin}]
    return columns.withColumn("leakage", F.when(F.col("column").isin(targets), "target").when(F.col("column").isin(near), "same_source").otherwise("none"))


def profile(df: DataFrame, columns: list[str] | None = None, exact: bool = True, known: dict[str, str] | None = None) -> DataFrame:
    """One row for each column: rows, nulls, distinct, top value; min, max, mean, median, deviation and tails of numbers.

    The statistics of all columns are one wide aggregate; distinct and top values come from unpivoted counts, so no
    column costs a pass of its own and no row is expanded for each of them. Roles are those of ``roles``, with the
    caller's ``known`` ones. Exact quantiles of all columns come from one table of counted values; ``exact=False`` takes
    approximate ones in the wide aggregate.
    """
    columns = columns or df.columns
    kinds = dict(df.dtypes)
    number = lambda c: kinds[c] in ("tinyint", "smallint", "int", "bigint", "float", "double") or kinds[c].startswith("decimal")
    quantile = lambda x, p: F.lit(None).cast("double") if exact else F.percentile_approx(x, p)
    parts = []
    for c in columns:
        x = F.col(c).cast("double") if number(c) else F.lit(None).cast("double")
        stats = [F.lit(c).alias("column"), F.count("*").alias("rows"), F.count_if(F.col(c).isNull()).alias("nulls"), F.min(x).alias("least"), F.max(x).alias("largest"), F.avg(x).alias("mean"), quantile(x, 0.5).alias("median"), F.stddev_samp(x).alias("deviation"), quantile(x, 0.01).alias("p01"), quantile(x, 0.99).alias("p99"), F.count_if(x < 0).alias("negatives"), F.count_if(x == 0).alias("zeros"), F.count_if(F.abs(x) == float("inf")).alias("infinities")]
        parts.append(F.struct(*stats).alias(c))
    wide = df.agg(*parts).select(F.explode(F.array(*(F.col(f"`{c}`") for c in columns))).alias("s")).select("s.*")
    if exact and (numbers := [c for c in columns if number(c)]):
        found = quantiles(df.select(*numbers), numbers, [[]], [0.01, 0.5, 0.99]).select(F.col("_c").alias("column"), *(F.col("_q")[i].alias(f"_{n}") for i, n in enumerate(("p01", "median", "p99"))))
        wide = wide.join(found, "column", "left").withColumns({n: F.col(f"_{n}") for n in ("p01", "median", "p99")}).drop("_p01", "_median", "_p99")
    values = df.select([F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column", "value").filter("value is not null")
    counted = values.groupBy("column", "value").agg(F.count("*").alias("n"))
    most = counted.groupBy("column").agg(F.max("n").alias("top_n"))
    top = counted.join(most, "column").filter("n = top_n").groupBy("column").agg(F.min("value").alias("top_value"), F.first("top_n").alias("top_n"))
    told = roles(measured(df.select(*columns)), known).select("column", "distinct", "role")
    out = wide.join(top, "column", "left").join(told, "column", "left")  # an empty table has no values to count
    return out.withColumns({"distinct": F.coalesce("distinct", F.lit(0)), "role": F.coalesce("role", F.lit("empty"))}).withColumn("constant", F.col("distinct") <= 1)


def select_columns(profiled: DataFrame, keep: list[str], most_null: float = 1.0, drop_roles: tuple[str, ...] = ("trace",)) -> list[str]:
    """Columns worth keeping: not all null, not constant, not of a dropped role; ``keep`` stay in any case."""
    rows = profiled.select("column", "rows", "nulls", "constant", "role").collect()  # one row for each column
    return [r["column"] for r in rows if r["column"] in keep or not (r["constant"] or r["nulls"] >= most_null * max(r["rows"], 1) or r["role"] in drop_roles)]


def semantic_types(df: DataFrame, columns: list[str], least: float = 0.9, few: int = 20) -> DataFrame:
    """(column, kind): date, integer, number, category or text, by the share of strings that parse."""
    from gridloom.functions.dates import file_date

    aggs = []
    for c in columns:
        s = F.trim(F.col(c).cast("string"))
        filled = F.count_if(s != "")
        rate = lambda ok: F.try_divide(F.count_if(ok), filled)
        number = s.try_cast("double")
        kind = F.when(filled == 0, "empty").when(rate(file_date(s).isNotNull()) >= least, "date").when(rate(s.rlike(r"^-?\d+$")) >= least, "integer").when(rate(number.isNotNull()) >= least, "number").when(F.countDistinct(s) <= few, "category").otherwise("text")
        aggs.append(F.struct(F.lit(c).alias("column"), kind.alias("kind")).alias(c))
    return df.agg(*aggs).select(F.explode(F.array(*map(F.col, columns))).alias("s")).select("s.*")


def severity(rate: Column, critical: Column) -> Column:
    return F.when(rate == 0, "none").when(critical & (rate >= 0.05), "high").when(critical | (rate >= 0.5), "medium").otherwise("low")


def null_findings(df: DataFrame, critical: list[str]) -> DataFrame:
    """Missing values of each column with their severity."""
    one = df.agg(F.count("*").alias("_rows"), *(F.count_if(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).alias(c) for c in df.columns))
    out = one.unpivot(["_rows"], df.columns, "column", "missing")
    rate = F.try_divide("missing", "_rows")
    return out.select("column", "missing", F.round(rate * 100, 4).alias("pct"), severity(rate, F.col("column").isin(*critical)).alias("severity"))


def outside(df: DataFrame, column: str, least: float, largest: float) -> DataFrame:
    return df.agg(F.count(column).alias("n"), F.count_if(~F.col(column).between(least, largest)).alias("outside"))


def not_finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """Cells that are null, not a number or infinite."""
    return df.agg(*(F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))).alias(c) for c in columns)).unpivot([], columns, "column", "bad")


CHECK = "check string, value string, status string, note string"


def check_unique(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Contract: no key repeats."""
    bad = df.groupBy(*keys).count().filter("count > 1").agg(F.count("*").alias("n"))
    return bad.select(F.lit(f"{name}: unique {'+'.join(keys)}").alias("check"), F.col("n").cast("string").alias("value"), F.when(F.col("n") == 0, "ok").otherwise("error").alias("status"), F.lit("keys that repeat").alias("note"))


def check_counts(df: DataFrame, name: str, tests: dict[str, tuple[Column, str]]) -> DataFrame:
    """Contracts on rows: each test is a condition that no row may meet, and the status if one does."""
    one = df.agg(*(F.count_if(c).alias(n) for n, (c, _) in tests.items())).unpivot([], list(tests), "test", "n")
    status = F.create_map(*(F.lit(x) for n, (_, s) in tests.items() for x in (n, s)))
    return one.select(F.concat(F.lit(f"{name}: "), F.col("test")).alias("check"), F.col("n").cast("string").alias("value"), F.when(F.col("n") == 0, "ok").otherwise(status[F.col("test")]).alias("status"), F.lit("rows").alias("note"))


def check_columns(df: DataFrame, required: list[str], forbidden: list[str], name: str) -> DataFrame:
    """Contract on the schema."""
    missing, extra = [c for c in required if c not in df.columns], [c for c in forbidden if c in df.columns]
    rows = [(f"{name}: required columns", ",".join(missing), "error" if missing else "ok", "missing"), (f"{name}: forbidden columns", ",".join(extra), "error" if extra else "ok", "present")]
    return df.sparkSession.createDataFrame(rows, CHECK)


def check_rows(df: DataFrame, base: DataFrame, name: str) -> DataFrame:
    """Contract: as many rows as the base table."""
    tagged = df.select(F.lit(1).alias("mine")).union(base.select(F.lit(0)))
    both = tagged.agg(F.count_if(F.col("mine") == 1).alias("n"), F.count_if(F.col("mine") == 0).alias("m"))
    return both.select(F.lit(f"{name}: rows of base").alias("check"), F.concat_ws("/", F.col("n").cast("string"), F.col("m").cast("string")).alias("value"), F.when(F.col("n") == F.col("m"), "ok").otherwise("error").alias("status"), F.lit("rows/expected").alias("note"))


def check_values(df: DataFrame, name: str, but: list[str] | None = None) -> DataFrame:
    """Contract: no column is null throughout (error), and none holds one value in all rows (warning); ``but`` are free.

    One aggregate over all columns; the columns that fail are named. An empty table has neither.
    """
    columns = [c for c in df.columns if c not in (but or [])]
    text, rows = (lambda c: F.col(f"`{c}`").cast("string")), fresh("_rows", columns)
    one = df.agg(F.count("*").alias(rows), *(F.struct(F.count(text(c)).alias("n"), F.min(text(c)).alias("least"), F.max(text(c)).alias("largest")).alias(c) for c in columns))
    some = F.col(rows) > 0
    empty = F.concat_ws(",", *(F.when(some & (F.col(f"`{c}`.n") == 0), c) for c in columns))
    constant = F.concat_ws(",", *(F.when((F.col(rows) > 1) & (F.col(f"`{c}`.n") == F.col(rows)) & (F.col(f"`{c}`.least") == F.col(f"`{c}`.largest")), c) for c in columns))
    row = lambda what, value, bad: F.struct(F.lit(f"{name}: {what}").alias("check"), value.alias("value"), F.when(value == "", "ok").otherwise(bad).alias("status"), F.lit("columns").alias("note"))
    return one.select(F.explode(F.array(row("columns without values", empty, "error"), row("columns of one value", constant, "warning"))).alias("c")).select("c.*")


def stop_on_error(report: DataFrame) -> DataFrame:
    """The report, or an error that names the failed checks."""
    bad = report.filter("status = 'error'").select("check").limit(20).collect()
    if bad:
        raise ValueError("failed: " + ", ".join(r[0] for r in bad))
    return report


def clean_catalog(df: DataFrame, code: str, width: int, name: str) -> DataFrame:
    """A catalog of padded codes: one row for each code, rows without a code of the width left out."""
    from gridloom.functions.text import pad_code

    return df.withColumn(code, pad_code(F.col(code), width)).filter(F.length(code) == width).groupBy(code).agg(F.min(name).alias(name), F.count("*").alias("n_source_rows"))
