"""Rules as data: a table of rules becomes one aggregate over the rows, and its counts become findings with severity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.dates import registry_date
from gridloom.functions.text import missing_to_null

#: A rule: its name, the columns it reads, the test with its arguments, and severities by the least share of bad rows.
RULES = "finding string, columns array<string>, test string, args array<string>, grades array<struct<least:double,severity:string>>"


def filled(c: str) -> Column:
    """The value as text, null where it is blank or a missing token."""
    return missing_to_null(F.col(f"`{c}`").cast("string"))


def number(c: str) -> Column:
    return filled(c).try_cast("double")


def _range(c: Column, low: Column, high: Column) -> Column:
    return F.coalesce((c < low) | (c > high), F.lit(False))


#: Test -> condition of a bad row, from the columns and the arguments. Values that are missing are bad for ``missing`` only.
TESTS = {
    "missing": lambda c, a: reduce(lambda x, y: x | y, (filled(x).isNull() for x in c)),
    "not_number": lambda c, a: filled(c[0]).isNotNull() & number(c[0]).isNull(),
    "outside": lambda c, a: _range(number(c[0]), F.lit(float(a[0])), F.lit(float(a[1]))),
    "negative": lambda c, a: F.coalesce(number(c[0]) < 0, F.lit(False)),
    "not_date": lambda c, a: filled(c[0]).isNotNull() & registry_date(filled(c[0])).isNull(),
    "date_outside": lambda c, a: _range(registry_date(filled(c[0])), F.lit(a[0]).cast("date"), F.lit(a[1]).cast("date")),
    "before": lambda c, a: F.coalesce(registry_date(filled(c[1])) < registry_date(filled(c[0])), F.lit(False)),
    "domain": lambda c, a: F.coalesce(~filled(c[0]).isin(*a), F.lit(False)),
    "pattern": lambda c, a: F.coalesce(~filled(c[0]).rlike(a[0]), F.lit(False)),
}


def rules_of(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, RULES)


def audit(df: DataFrame, rules: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, finding, columns, n, share, severity): what the rules find, one row for each rule and group with bad rows.

    All rules are one aggregate, one pass over the rows. ``repeated`` counts the rows beyond the first of each key
    (all columns, if a rule names none); keys with a missing part are left out unless all columns are meant. Rules whose
    columns the table lacks find ``no_column`` with severity "high". A share below the least grade has severity "low".
    """
    by = by or []
    table, own = rules.collect(), {c.lower() for c in df.columns}  # one row for each rule
    lacking = [r for r in table if any(c.lower() not in own for c in r["columns"])]
    known = [r for r in table if r not in lacking]
    counts = [F.count("*").alias("_rows")]
    for i, r in enumerate(known):
        if r["test"] == "repeated":
            keys = [F.struct(*(F.col(f"`{c}`") for c in df.columns if c not in by))] if not r["columns"] else [F.when(reduce(lambda x, y: x & y, (filled(c).isNotNull() for c in r["columns"])), F.struct(*(filled(c) for c in r["columns"])))]
            counts.append((F.count(keys[0]) - F.countDistinct(keys[0])).alias(f"_n{i}"))
        else:
            counts.append(F.count_if(TESTS[r["test"]](r["columns"], r["args"] or [])).alias(f"_n{i}"))
    one = df.groupBy(*by).agg(*counts)

    def graded(grades: list, share: Column) -> Column:
        out = F.when(F.lit(False), F.lit(""))
        for g in sorted(grades or [], key=lambda g: -g["least"]):
            out = out.when(share >= g["least"], g["severity"])
        return out.otherwise("low")

    share = lambda n: F.try_divide(F.col(n), F.col("_rows"))
    found = [F.struct(F.lit(r["finding"]).alias("finding"), F.lit(",".join(r["columns"])).alias("columns"), F.col(f"_n{i}").alias("n"), share(f"_n{i}").alias("share"), graded(r["grades"], share(f"_n{i}")).alias("severity")) for i, r in enumerate(known)]
    found += [F.struct(F.lit("no_column").alias("finding"), F.lit(",".join(r["columns"])).alias("columns"), F.col("_rows").alias("n"), F.lit(1.0).alias("share"), F.lit("high").alias("severity")) for r in lacking]
    if not found:
        found = [F.struct(F.lit("").alias("finding"), F.lit("").alias("columns"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("share"), F.lit("").alias("severity"))]
    return one.select(*by, F.explode(F.array(*found)).alias("f")).select(*by, "f.*").filter("n > 0")


def inventory_report(df: DataFrame, dataset: str, keys: list[str], year: str, period: tuple[int, int], measures: list[str], rows_read: int | None = None) -> DataFrame:
    """One row about an inventory table: rows, years, keys, values, totals of its measures, and "ok" or "review" with notes."""
    y = F.col(year)
    key = F.struct(*keys)
    some = lambda f: reduce(lambda a, b: a + b, (F.count_if(f(F.col(m))) for m in measures))
    one = df.agg(
        F.count("*").alias("rows"),
        F.min(y).alias("least_year"),
        F.max(y).alias("largest_year"),
        F.countDistinct(y).alias("years"),
        F.count_if(~y.between(*period)).alias("years_outside"),
        F.count_if(reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))).alias("null_keys"),
        some(lambda c: c.isNull()).alias("null_values"),
        some(lambda c: c < 0).alias("negative_values"),
        (F.count("*") - F.countDistinct(F.struct(*df.columns))).alias("repeated_rows"),
        (F.count("*") - F.countDistinct(key)).alias("repeated_keys"),
        *(F.sum(m).alias(f"total_{m}") for m in measures),
    )
    faults = {
        "no rows": F.col("rows") == 0,
        "other period": ~(F.col("least_year").eqNullSafe(F.lit(period[0])) & F.col("largest_year").eqNullSafe(F.lit(period[1]))),
        "years missing": F.col("years") != period[1] - period[0] + 1,
        **{f"{n.replace('_', ' ')}": F.col(n) > 0 for n in ("null_keys", "null_values", "negative_values", "repeated_rows", "repeated_keys")},
    }
    notes = F.concat_ws("; ", *(F.when(c, n) for n, c in faults.items()))
    left_out = F.lit(rows_read).cast("long") - F.col("rows")
    return one.withColumns({"dataset": F.lit(dataset), "left_out": left_out, "columns": F.lit(len(df.columns)), "notes": notes, "status": F.when(notes == "", "ok").otherwise("review")})
