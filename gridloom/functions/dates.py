"""Date, time and duration expressions. Each returns null where a value can't be read."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.text import MISSING_TOKENS, find_column


def _guarded(s: Column, rules: list[tuple[str, str]]) -> Column:
    """The first rule (pattern, format) whose pattern matches reads the date."""
    out = F.when(F.lit(False), F.lit(None).cast("date"))
    for pattern, form in rules:
        out = out.when(s.rlike(pattern), F.to_date(F.try_to_timestamp(s, F.lit(form))))
    return out


# The forms of dates in event registries and in detection and station files.
REGISTRY_FORMS = [
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$", "d/M/yyyy H:mm:ss"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}:\d{2}$", "yyyy-M-d H:mm:ss"),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
]
FILE_FORMS = [
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{8}$", "yyyyMMdd"),
]


# The days that a spreadsheet's serial number may name, and forms tried after serial numbers.
SERIAL_DAYS = (date(1677, 9, 22), date(2262, 4, 11))
LATE_FORMS = [(r"^\d{8}$", "yyyyMMdd"), (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"), (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy")]


def registry_date(c: Column) -> Column:
    """Dates in four forms, else days since 1899-12-30 as spreadsheets count them, else compact or free day-first text.

    A number that would name a day outside SERIAL_DAYS is no serial number.
    """
    s = F.trim(c.cast("string"))
    s = F.when(~s.isin("", "nan", "NaN", "<NA>", "None"), s)
    serial = F.when(s.rlike(r"^-?\d+(\.\d+)?$"), F.floor(s.try_cast("double")))
    first, last = ((d - date(1899, 12, 30)).days for d in SERIAL_DAYS)
    return F.coalesce(_guarded(s, REGISTRY_FORMS), F.date_add(F.lit("1899-12-30").cast("date"), F.when(serial.between(first, last), serial).cast("int")), _guarded(s, LATE_FORMS), F.when(~s.rlike(r"^-?\d+(\.\d+)?$"), day_first(s)))


# Names of months, English and Spanish, by their first three letters.
MONTHS = {"jan": 1, "ene": 1, "feb": 2, "mar": 3, "apr": 4, "abr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "ago": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12, "dic": 12}


def day_first(c: Column) -> Column:
    """Dates in free text: three parts, of numbers and at most one name of a month, the day before the month unless that
    can't be.

    Parts stand apart by blanks, slashes, points, dashes, commas or "de"; weekdays before them and clocks behind them
    are left out. A part of four digits is the year, last or first (even then the day comes first of the other two); one of two digits after day and month is a year of
    1969 to 2068. A name of a month takes its place, so that the other part is the day. Days that don't exist are null.
    """
    s = F.lower(F.trim(c.cast("string")))
    s = F.regexp_replace(s, r"[t ,]+\d{1,2}(:\d{1,2}){1,2}(\.\d+)?( ?[ap]\.?m\.?)?( ?(z|utc|gmt|[+-]\d{2}:?\d{2}))?$", "")
    s = F.regexp_replace(s, r"^(mon|tue|wed|thu|fri|sat|sun|lunes|martes|mi[eé]rcoles|jueves|viernes|s[aá]bado|domingo)[a-z]*\.?,? +", "")
    parts = F.filter(F.split(F.regexp_replace(s, r"(?<=\d)(st|nd|rd|th|º|°)\b|\bde[l]?\b", " "), r"[ /.,\-]+"), lambda x: x != "")
    names = F.create_map(*(F.lit(x) for kv in MONTHS.items() for x in kv))

    def told(p: Column) -> Column:
        word = F.transform(p, lambda x: F.when(x.rlike("^[a-z]{3,}$"), F.try_element_at(names, F.left(x, F.lit(3)))))
        n = F.transform(p, lambda x: F.when(x.rlike(r"^\d{1,4}$"), x.cast("int")))
        long = F.transform(p, lambda x: x.rlike(r"^\d{4}$"))
        at = lambda a, i: F.get(a, F.lit(i))
        short_year = lambda x: F.when(at(long, x), at(n, x)).otherwise(F.when(at(n, x) <= 68, at(n, x) + 2000).when(at(n, x) <= 99, at(n, x) + 1900))
        made = lambda y, m, d: F.try_to_timestamp(F.format_string("%04d-%02d-%02d", y, m, d), F.lit("yyyy-MM-dd")).cast("date")
        by_name = F.when(at(word, 0).isNotNull(), made(short_year(2), at(word, 0), at(n, 1))).when(at(word, 1).isNotNull() & at(long, 0), made(at(n, 0), at(word, 1), at(n, 2))).when(at(word, 1).isNotNull(), made(short_year(2), at(word, 1), at(n, 0)))
        year_first = F.when(at(n, 2) <= 12, made(at(n, 0), at(n, 2), at(n, 1))).otherwise(made(at(n, 0), at(n, 1), at(n, 2)))
        day_month = F.when(at(n, 1) <= 12, made(short_year(2), at(n, 1), at(n, 0))).otherwise(made(short_year(2), at(n, 0), at(n, 1)))
        named = F.size(F.filter(word, lambda x: x.isNotNull()))
        return F.when((F.size(p) == 3) & (named == 1), by_name).when((F.size(p) == 3) & (named == 0), F.when(at(long, 0), year_first).otherwise(day_month))

    return F.get(F.transform(F.array(parts), told), F.lit(0))


def file_date(c: Column) -> Column:
    """Dates in five forms."""
    return _guarded(F.trim(c.cast("string")), FILE_FORMS)


def clock(c: Column) -> Column:
    """``HHMM``, ``HMM``, ``MM`` or ``H:MM`` as ``HH:MM``; hours to 23 and minutes to 59."""
    s = F.regexp_replace(F.trim(c.cast("string")), r"\.0$", "")
    four = F.when(s.rlike(r"^\d{1,4}$"), F.lpad(s, 4, "0"))
    h = F.coalesce(F.left(four, F.lit(2)), F.nullif(F.regexp_extract(s, r"^(\d{1,2}):(\d{2})(:\d{2})?$", 1), F.lit(""))).try_cast("int")
    m = F.coalesce(F.right(four, F.lit(2)), F.nullif(F.regexp_extract(s, r"^(\d{1,2}):(\d{2})(:\d{2})?$", 2), F.lit(""))).try_cast("int")
    return F.when((h <= 23) & (m <= 59), F.format_string("%02d:%02d", h, m))


def duration(c: Column) -> Column:
    """``H:M``, ``H:M:S`` or ``N days, H:M:S`` as total hours ``HH:MM:SS``, which may exceed a day.

    ``;`` counts as ``:``, and a fraction of a second is left out.
    """
    s = F.regexp_replace(F.translate(F.trim(c.cast("string")), ";", ":"), r"^(.*\d:\d{1,2}:\d{1,2})\.\d+$", "$1")
    pattern = r"^(?:(\d+)\s+days?,\s*(?=\d+:\d+:))?(\d{1,5}):(\d{1,2})(?::(\d{1,2}))?$"
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(s, pattern, i), F.lit("")).try_cast("int"), F.lit(0))
    return F.when(s.rlike(pattern) & (part(3) <= 59) & (part(4) <= 59), F.format_string("%02d:%02d:%02d", part(1) * 24 + part(2), part(3), part(4)))


def is_duration(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^\d{2,}:[0-5]\d:[0-5]\d$"), F.lit(False))


def timestamp_of(date: Column, time: Column) -> Column:
    return F.try_to_timestamp(F.concat_ws(" ", F.date_format(date, "yyyy-MM-dd"), time), F.lit("yyyy-MM-dd HH:mm"))


def calendar(df: DataFrame, day: str) -> DataFrame:
    """year, month, day, day of year, ISO week, quarter and a flag for the first half of the year."""
    d = F.col(day)
    return df.withColumns({"year": F.year(d), "month": F.month(d), "day_of_month": F.dayofmonth(d), "day_of_year": F.dayofyear(d), "week": F.weekofyear(d), "quarter": F.quarter(d), "first_half": (F.month(d) <= 6).cast("int")})


def within(day: Column, first: str, last: str) -> Column:
    return day.between(F.lit(first).cast("date"), F.lit(last).cast("date"))


def year_mismatches(df: DataFrame, year: str, day: str) -> DataFrame:
    """Rows with both values, and those whose year isn't the date's."""
    y = F.col(year).try_cast("int")
    return df.agg(F.count_if(y.isNotNull() & F.col(day).isNotNull()).alias("compared"), F.count_if(y != F.year(day)).alias("different"))


def cycle_of(name: Column, default: str | None = None) -> Column:
    """The years a file name covers: ``2015-2020`` as ``2015_2020``, one year as itself, ``default`` for a name without any."""
    both = F.regexp_extract(name, r"((?:19|20)\d{2})\D{1,3}((?:19|20)\d{2})", 0)
    a, b = F.regexp_extract(name, r"((?:19|20)\d{2})\D{1,3}((?:19|20)\d{2})", 1), F.regexp_extract(name, r"((?:19|20)\d{2})\D{1,3}((?:19|20)\d{2})", 2)
    return F.when(both != "", F.concat_ws("_", a, b)).otherwise(F.coalesce(F.nullif(F.regexp_extract(name, r"((?:19|20)\d{2})", 1), F.lit("")), F.lit(default)))


def coverage(df: DataFrame, date_names: list[str], year_names: list[str]) -> DataFrame:
    """One row (source, first, last, n) of the first date-like column that holds dates, else of the year column."""
    d, y = find_column(df.columns, date_names, partial=True), find_column(df.columns, year_names)
    years = lambda f: f(F.col(y).try_cast("int").cast("string")) if y else F.lit(None).cast("string")
    dates = file_date(F.col(d)) if d else F.lit(None).cast("date")
    out = df.agg(F.date_format(F.min(dates), "yyyy-MM-dd").alias("d0"), F.date_format(F.max(dates), "yyyy-MM-dd").alias("d1"), F.count(dates).alias("dn"), years(F.min).alias("y0"), years(F.max).alias("y1"), (F.count(F.col(y).try_cast("int")) if y else F.sum(F.lit(0))).alias("yn"))
    use = F.col("dn") > 0
    return out.select(F.when(use, F.lit(d)).otherwise(F.lit(y)).alias("source"), F.when(use, F.col("d0")).otherwise(F.col("y0")).alias("first"), F.when(use, F.col("d1")).otherwise(F.col("y1")).alias("last"), F.when(use, F.col("dn")).otherwise(F.col("yn")).alias("n"))


def date_column(df: DataFrame, columns: list[str]) -> DataFrame:
    """The column whose non-missing values parse as dates most often: (column, parsed, filled), ties to the first name."""
    stats = df.agg(*(F.struct(F.lit(c).alias("column"), F.count(file_date(F.col(c))).alias("parsed"), F.count_if(~F.trim(F.col(c).cast("string")).isin(*MISSING_TOKENS)).alias("filled")).alias(c) for c in columns))
    return stats.select(F.explode(F.array(*map(F.col, columns))).alias("s")).select("s.*").orderBy(F.desc(F.try_divide("parsed", "filled")), "column").limit(1)
