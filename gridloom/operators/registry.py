"""Event registries of other years and makers, brought to one schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.dates import registry_date
from gridloom.functions.text import compact_key, missing_to_null, normal_name, number_or_null, repair_mojibake, unique_names
from gridloom.operators.matching import by_vocabulary, complete_keys, final_schema


def visible(c: Column) -> Column:
    """Text as it is shown: repaired where it is broken, trimmed, null where it is a missing token.

    The element of a one-element array, so that the repair is computed once.
    """
    return F.get(F.transform(F.array(repair_mojibake(c.cast("string"))), lambda v: missing_to_null(v)), F.lit(0))


def read_as(c: Column, kind: str) -> Column:
    """A column of text by kind: key, date, number, year or text."""
    if kind == "key":
        return compact_key(c)
    if kind == "date":
        return registry_date(c)
    if kind == "number":
        return number_or_null(c.cast("string"))
    if kind == "year":
        return number_or_null(c.cast("string")).cast("int")
    return visible(c)


def cleaned(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Columns with normal names, those of ``kinds`` read by kind and null where the table lacks them, others left out."""
    out = df.toDF(*unique_names([normal_name(c) for c in df.columns]))
    return out.select(*((read_as(F.col(c), k) if c in out.columns else read_as(F.lit(None).cast("string"), k)).alias(c) for c, k in kinds.items()))


def historical_registry(df: DataFrame, columns: dict[str, str], kinds: dict[str, str], mixed: dict[str, tuple[str, str, dict[str, str]]], constants: dict[str, str], schema: dict[str, str], states: DataFrame, regions: DataFrame) -> DataFrame:
    """A registry of another maker in the common schema.

    ``columns``: its names -> ours. ``kinds``: how ours are read. ``mixed``: ours -> two of its columns in either of which
    the attribute may stand, told by the vocabulary. ``constants``: what all its rows are marked with. Keys of state and
    region are completed from the catalogs by code or name. Columns of the schema that it lacks are null.
    """
    source = df.toDF(*unique_names([normal_name(c) for c in df.columns]))
    told = {c: by_vocabulary(visible(F.col(a)), visible(F.col(b)), words) for c, (a, b, words) in mixed.items()}
    renamed = source.select(*(F.col(a).alias(b) for a, b in columns.items() if a in source.columns), *(v.alias(c) for c, v in told.items()))
    read = cleaned(renamed, kinds | {c: "text" for c in mixed})
    keyed = complete_keys(read, states, regions)
    return final_schema(keyed.withColumns({c: F.lit(v) for c, v in constants.items()}), schema)


def reread_registry(df: DataFrame, kinds: dict[str, str], schema: dict[str, str], states: DataFrame, regions: DataFrame) -> DataFrame:
    """An integrated registry read back from text: names and values in normal form again, keys resolved anew."""
    return final_schema(complete_keys(cleaned(df, kinds), states, regions), schema)
