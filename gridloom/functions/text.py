"""Text, code and number normalisation as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What counts as missing in detection files, station reports and event registries.
MISSING_TOKENS = ("", "NA", "N/A", "NULL", "NONE", "NULO", "nan", "NaN", "-", "--", "S/D", "SD", "SIN DATO")
TEXT_SENTINELS = ("", "NULO", "NULL", "NA", "N/A", "ND", "S/D", "NR")
NUMERIC_SENTINELS = (-9999.0, -999.0, 9999.0, 99999.0, 99.99, 999.9, 8888.0, 7777.0)
# Latin letters and what is left of them without their marks.
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿĀāĂăĄąĆćČčĎďĒēĘęĚěĞğĪīŁłŃńŇňŌōŐőŘřŚśŞşŠšŤťŪūŮůŰűŹźŻżŽž"
PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyyAaAaAaCcCcDdEeEeEeGgIiLlNnNnOoOoRrSsSsSsTtUuUuUuZzZzZz"
MOJIBAKE = "[ÃÂ�]"


def strip_accents(c: Column) -> Column:
    """Letters without their marks, for the letters of ACCENTED."""
    return F.translate(c, ACCENTED, PLAIN)


def normal_name(name: str) -> str:
    """A column name in lower case ASCII, words joined by underscores."""
    plain = name.strip().lower().translate(str.maketrans(ACCENTED.lower(), PLAIN.lower()))
    return re.sub(r"_+", "_", re.sub(r"[^0-9a-z]+", "_", plain)).strip("_") or "column"


def unique_names(names: list[str]) -> list[str]:
    """Normal names; the second and later uses of one get a running number."""
    seen: dict[str, int] = {}
    out = []
    for n in map(normal_name, names):
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return out


def with_normal_names(df: DataFrame) -> DataFrame:
    return df.toDF(*unique_names(df.columns))


def pad_code(c: Column, width: int) -> Column:
    """First run of digits, without a trailing ``.0``, padded with zeros on the left; longer runs stay whole."""
    digits = F.nullif(F.regexp_extract(F.regexp_replace(F.trim(c.cast("string")), r"\.0$", ""), r"(\d+)", 1), F.lit(""))
    return F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0"))


def last_digits(c: Column, width: int) -> Column:
    """All digits, without a trailing ``.0``; the last ``width`` of them, padded with zeros on the left."""
    digits = F.nullif(F.regexp_replace(F.regexp_replace(F.trim(c.cast("string")), r"\.0$", ""), r"\D", ""), F.lit(""))
    return F.lpad(F.right(digits, F.lit(width)), width, "0")


def clean_number(c: Column) -> Column:
    """Decimal comma to point, everything but digits, sign and point dropped, null where that is no number."""
    return F.regexp_replace(F.regexp_replace(c.cast("string"), ",", "."), r"[^0-9.\-]", "").try_cast("double")


def number_or_null(c: Column) -> Column:
    """A number with decimal comma or point; text and numeric sentinels are null."""
    s = F.trim(c.cast("string"))
    v = F.regexp_replace(s, ",", ".").try_cast("double")
    return F.when(~F.upper(s).isin(*TEXT_SENTINELS) & ~v.isin(*NUMERIC_SENTINELS), v)


def thousands(c: Column) -> Column:
    """A number whose commas and blanks part thousands."""
    return F.regexp_replace(F.trim(c.cast("string")), r"[,\s]", "").try_cast("double")


def rounded_int(c: Column) -> Column:
    """Nearest integer, halves to even."""
    return F.bround(c.try_cast("double"), 0).try_cast("bigint")


def identifier(c: Column) -> Column:
    """Without blanks and a trailing ``.0``; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.regexp_replace(F.trim(c.cast("string")), r"\.0$", ""), r"\s+", ""), F.lit(""))


def missing_to_null(c: Column, tokens: tuple[str, ...] = MISSING_TOKENS) -> Column:
    s = F.trim(c)
    return F.when(~s.isin(*tokens), s)


def null_missing(df: DataFrame, tokens: tuple[str, ...] = MISSING_TOKENS) -> DataFrame:
    """Missing tokens of every string column as nulls."""
    return df.select([missing_to_null(F.col(n), tokens).alias(n) if t == "string" else F.col(n) for n, t in df.dtypes])


def text_key(c: Column, synonyms: dict[str, str] | None = None) -> Column:
    """Lower case without accents, punctuation and blanks to one blank; then its synonym if it has one; null if empty.

    The key is the element of a one-element array, so the rest of the expression doesn't compute it again.
    """
    key = F.trim(F.regexp_replace(strip_accents(F.lower(c)), r"[^0-9a-z]+", " "))
    named = F.create_map(*(F.lit(x) for kv in (synonyms or {}).items() for x in kv))
    told = lambda k: F.coalesce(F.try_element_at(named, k), k) if synonyms else k
    return F.get(F.transform(F.array(key), lambda k: F.when(k != "", told(k))), F.lit(0))


def with_alias(df: DataFrame, aliases: DataFrame, keys: list[str], name: str, alias: str) -> DataFrame:
    """``name`` replaced by the alias listed for its keys. ``aliases``: a dimension of key columns and ``alias``."""
    return df.join(aliases.select(*keys, F.col(alias).alias("_alias")).dropDuplicates(keys), keys, "left").withColumn(name, F.coalesce("_alias", name)).drop("_alias")


def title(c: Column) -> Column:
    return F.initcap(F.lower(F.trim(F.regexp_replace(c, r"\s+", " "))))


def has_mojibake(c: Column) -> Column:
    return F.coalesce(c.rlike(MOJIBAKE), F.lit(False))


# What windows-1252 shows for the bytes 80 to 9F where Latin-1 has control characters.
WINDOWS_1252 = dict(zip((0x80, *range(0x82, 0x8D), 0x8E, *range(0x91, 0x9D), 0x9E, 0x9F), "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"))


def repair_mojibake(c: Column, rounds: int = 3) -> Column:
    """UTF-8 that was read as Latin-1 or windows-1252, up to three times over; text that doesn't decode stays."""
    shown, bytes_of = "".join(WINDOWS_1252.values()), "".join(map(chr, WINDOWS_1252))

    def step(t: Column) -> Column:
        latin = F.translate(t, shown, bytes_of)
        raw = F.encode(latin, "ISO-8859-1").cast("string")
        return F.when(t.rlike(MOJIBAKE) & ~latin.rlike("[^\\x{00}-\\x{ff}]"), F.coalesce(F.when(F.is_valid_utf8(raw), raw), t)).otherwise(t)

    for _ in range(rounds):  # each round reads the element of a one-element array: nothing is computed twice over
        c = F.get(F.transform(F.array(c), lambda t: step(t)), F.lit(0))
    return c


def compact_key(c: Column) -> Column:
    """Upper case without blanks; null if empty."""
    return F.nullif(F.upper(F.regexp_replace(c.cast("string"), r"\s+", "")), F.lit(""))


def printable(c: Column) -> Column:
    """Control characters to blanks, blanks collapsed, null if empty."""
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(c, r"\p{Cntrl}", " "), r" +", " ")), F.lit(""))


def token_class(c: Column) -> Column:
    s = F.trim(c)
    v = F.regexp_replace(s, ",", ".").try_cast("double")
    return F.when(s.isNull() | F.upper(s).isin(*TEXT_SENTINELS), "text_sentinel").when(v.isin(*NUMERIC_SENTINELS), "numeric_sentinel").when(v.isNotNull(), "numeric").otherwise("other")


def find_column(columns: list[str], candidates: list[str], required: bool = False, partial: bool = False) -> str | None:
    """The column that has a candidate's normal name, in the candidates' order; then, if asked, one that contains it."""
    by_name = {normal_name(c): c for c in reversed(columns)}
    for c in map(normal_name, candidates):
        if c in by_name:
            return by_name[c]
    if partial:
        for c in map(normal_name, candidates):
            for name in columns:
                if c in normal_name(name):
                    return name
    if required:
        raise KeyError(f"none of {candidates} in {columns}")
    return None


def cast_by_name(df: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Casts by the first rule (pattern, kind) whose pattern is found in the normal name; kinds: id, integer, number."""
    kinds = {"id": identifier, "integer": rounded_int, "number": thousands}
    pick = lambda n: next((kinds[k] for p, k in rules if re.search(p, normal_name(n))), None)
    return df.select([f(F.col(n)).alias(n) if (f := pick(n)) else F.col(n) for n in df.columns])


def station_id(path: Column, width: int = 5) -> Column:
    """First digits of a path's file name, padded."""
    return pad_code(F.element_at(F.split(path, "/"), -1), width)


def complete_pair(df: DataFrame, catalog: DataFrame, code: str, name: str) -> DataFrame:
    """Fills a missing name from the code and a missing code from the name's text key."""
    dim = catalog.select(F.col(code).alias("_code"), F.col(name).alias("_name"))
    keyed = dim.groupBy(text_key(F.col("_name")).alias("_key")).agg(F.min("_code").alias("_found"))
    out = df.join(dim, df[code] == F.col("_code"), "left").withColumn(name, F.coalesce(F.col(name), "_name")).drop("_code", "_name")
    return out.withColumn("_k", text_key(F.col(name))).join(keyed, F.col("_k") == F.col("_key"), "left").withColumn(code, F.coalesce(F.col(code), "_found")).drop("_k", "_key", "_found")


def samples(df: DataFrame, keys: list[str], value: str, most: int = 5, width: int = 200, separator: str = " | ") -> DataFrame:
    """The first ``most`` distinct values of each group in order, joined and cut to ``width``."""
    from pyspark.sql import Window

    order = Window.partitionBy(*keys).orderBy(value)
    few = df.select(*keys, value).dropna(subset=[value]).distinct().withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most)
    return few.groupBy(*keys).agg(F.left(F.array_join(F.array_sort(F.collect_list(F.col(value).cast("string"))), separator), F.lit(width)).alias("samples"))
