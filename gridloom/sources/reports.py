"""Station text reports and sheets of cells as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.dates import file_date
from gridloom.functions.text import normal_name, number_or_null, station_id, strip_accents, unique_names


def lines(files: DataFrame, path: str = "path", text: str = "value") -> DataFrame:
    """(path, n, line) of whole text files, one row each; a file is one row, so reports should be of report size."""
    return files.select(F.col(path).alias("path"), F.posexplode(F.split(text, r"\r?\n")).alias("n", "line"))


def header(rows: DataFrame, keys: dict[str, str], stop: str = "FECHA") -> DataFrame:
    """One row for each file: the values of ``KEY : value`` lines (keys: name to KEY, accents aside) and ``table``, the line where the table starts."""
    plain = F.upper(strip_accents(F.trim("line")))
    key = F.trim(F.regexp_extract(plain, r"^([^:]+?)\s*:", 1))
    value = F.nullif(F.trim(F.regexp_extract("line", r":\s*(.*)$", 1)), F.lit(""))
    picked = [F.min(F.when(key == k, F.struct("n", value.alias("v"))))["v"].alias(n) for n, k in keys.items()]
    return rows.groupBy("path").agg(*picked, F.min(F.when(plain.startswith(stop), F.col("n"))).alias("table"))


def station_rows(files: DataFrame, measures: list[str], keys: dict[str, str], path: str = "path", text: str = "value") -> DataFrame:
    """Daily rows of station reports: header values, date and measures, the id from the header or else the file name."""
    rows = lines(files, path, text)
    head = header(rows, keys)
    cells = F.split(F.trim("line"), r"\s+")
    body = rows.join(head.filter("table is not null"), "path").filter(F.col("n") > F.col("table")).withColumn("c", cells)
    day = file_date(F.col("c")[0])
    out = body.filter(day.isNotNull() & (F.size("c") >= len(measures) + 1))
    return out.select(F.coalesce(F.lpad("station", 5, "0"), station_id(F.col("path"))).alias("station"), *(k for k in keys if k != "station"), day.alias("day"), *(number_or_null(F.col("c")[i + 1]).alias(m) for i, m in enumerate(measures)), F.element_at(F.split("path", "/"), -1).alias("source_file"))


def sections(files: DataFrame, expected: list[str], path: str = "path", text: str = "value") -> DataFrame:
    """Expected sections that a report has and lacks, and its rows that start with a year."""
    line = F.upper(strip_accents(F.trim("line")))
    found = lines(files, path, text).groupBy("path").agg(F.array_sort(F.array_distinct(F.collect_list(F.when(line.isin(*expected), line)))).alias("found"), F.count_if(F.col("line").rlike(r"^\s*(19|20)\d{2}\s")).alias("year_rows"))
    return found.withColumn("missing", F.array_sort(F.array_except(F.array(*map(F.lit, expected)), "found")))


def station_audit(daily: DataFrame, raw: DataFrame, station: str, day: str) -> DataFrame:
    """Per station: days, months covered, repeated days, and raw tokens of each class (raw: station, token_class)."""
    per = daily.groupBy(station).agg(F.count("*").alias("rows"), F.countDistinct(day).alias("days"), F.countDistinct(F.trunc(day, "month")).alias("months"))
    kinds = raw.groupBy(station).pivot("token_class", ["text_sentinel", "numeric_sentinel", "numeric", "other"]).count().na.fill(0)
    return per.withColumn("repeated", F.col("rows") - F.col("days")).join(kinds, station, "left")


def header_row(cells: DataFrame, words: list[str], within: int = 20) -> DataFrame:
    """(sheet, header): the row among the first that looks most like a header, by filled text cells and known words."""
    text = F.col("value").isNotNull() & F.col("value").try_cast("double").isNull()
    known = F.lower(strip_accents(F.col("value"))).rlike("|".join(words))
    scored = cells.filter(F.col("row") < within).groupBy("sheet", "row").agg((F.count_if(text) + 3 * F.count_if(known & text)).alias("score"))
    best = scored.withColumn("r", F.row_number().over(Window.partitionBy("sheet").orderBy(F.desc("score"), "row"))).filter("r = 1")
    return best.select("sheet", F.col("row").alias("header"))


def sheet_names(cells: DataFrame, header: int, two: bool = False) -> dict[int, str]:
    """Column names of one sheet: the header row, with a second row's names behind the first's, filled to the right."""
    rows = cells.filter(F.col("row").isin([header] + [header + 1] * two)).select("row", "col", "value").collect()  # cells of one or two rows
    at = {(r["row"], r["col"]): (r["value"] or "").strip() for r in rows}
    cols, names, last = sorted({c for _, c in at}), [], ""
    for c in cols:
        first, second = at.get((header, c), ""), at.get((header + 1, c), "") if two else ""
        last = first or (last if two else "")
        names.append(" ".join(x for x in (last, second) if x) or f"column {c}")
    return dict(zip(cols, unique_names(names)))


def sheet_table(cells: DataFrame, header: int, two: bool = False) -> DataFrame:
    """One sheet's cells (row, col, value) as a table of strings with its row number; empty rows and columns are left out."""
    names = sheet_names(cells, header, two)
    body = cells.filter((F.col("row") > header + int(two)) & F.col("value").isNotNull())
    filled = {r[0] for r in body.select("col").distinct().collect()}  # one row for each column
    keep = [c for c in names if c in filled]
    return body.groupBy("row").pivot("col", keep).agg(F.first("value")).toDF("row", *(names[c] for c in keep))


def choose_sheet(cells: DataFrame, priorities: list[str], skip: str) -> DataFrame:
    """(workbook, sheet): the sheet whose name meets the earliest pattern, then the one of most cells; dictionaries are skipped."""
    name = F.lower(strip_accents(F.col("sheet")))
    place = F.lit(len(priorities))
    for i, p in reversed(list(enumerate(priorities))):
        place = F.when(name.rlike(p), i).otherwise(place)
    sizes = cells.filter(~name.rlike(skip)).groupBy("workbook", "sheet").agg(F.count("value").alias("n")).withColumn("place", place)
    best = F.row_number().over(Window.partitionBy("workbook").orderBy("place", F.desc("n"), "sheet"))
    return sizes.withColumn("r", best).filter("r = 1").select("workbook", "sheet")


def sheet_profile(cells: DataFrame) -> DataFrame:
    """Filled cells, numbers, distinct and a sample value of every sheet column."""
    v = F.nullif(F.trim("value"), F.lit(""))
    return cells.groupBy("sheet", "col").agg(F.count(v).alias("filled"), F.count(v.try_cast("double")).alias("numbers"), F.countDistinct(v).alias("distinct"), F.min(v).alias("sample"), F.round(F.avg(v.isNull().cast("double")), 4).alias("empty_share"))


def metadata_title(cells: DataFrame) -> DataFrame:
    """The line above each sheet's header."""
    return cells.filter("row = 0 and value is not null").groupBy("sheet").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "value"))), lambda x: x["value"]), " ").alias("title"))


__all__ = ["choose_sheet", "header", "header_row", "lines", "metadata_title", "normal_name", "sections", "sheet_profile", "sheet_table", "station_audit", "station_rows"]
