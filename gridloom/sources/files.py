"""Files in and out: text encodings, delimiters, provenance, inventories and exports. All paths are read by Spark."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.text import find_column, unique_names

BOM = "﻿"
DELIMITERS = (",", ";", "|", "\t")


def file_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 if every file of the path is valid UTF-8, else Latin-1 (which reads any bytes)."""
    files = spark.read.format("binaryFile").load(path)
    return "UTF-8" if files.filter(~F.is_valid_utf8(F.col("content").cast("string"))).limit(1).count() == 0 else "ISO-8859-1"


def sniff_delimiter(spark: SparkSession, path: str, encoding: str = "UTF-8") -> str:
    """The delimiter that stands most often in the first line, commas first on ties."""
    head = spark.read.option("encoding", encoding).text(path).limit(1).collect()
    line = head[0][0] if head else ""
    return max(DELIMITERS, key=lambda d: (line.count(d), -DELIMITERS.index(d)))


def read_table(spark: SparkSession, path: str, delimiter: str | None = None, drop_empty: bool = False) -> DataFrame:
    """A delimited file with header as strings, the charset and delimiter told from the file, the mark of UTF-8 cut off."""
    encoding = file_encoding(spark, path)
    df = spark.read.csv(path, header=True, inferSchema=False, encoding=encoding, sep=delimiter or sniff_delimiter(spark, path, encoding))
    df = df.toDF(*(c.removeprefix(BOM) for c in df.columns))
    if drop_empty:
        filled = df.agg(*(F.count(F.nullif(F.trim(F.col(f"`{c}`")), F.lit(""))).alias(c) for c in df.columns)).first()
        df = df.select([F.col(f"`{c}`") for c in df.columns if filled[c]])
    return df


def with_provenance(df: DataFrame, products: list[tuple[str, str]], name: str = "source_file") -> DataFrame:
    """Adds the file's name and the product of the first rule (pattern, product) that its path matches."""
    product = F.lit(None).cast("string")
    for pattern, p in reversed(products):
        product = F.when(F.col("_metadata.file_path").rlike(pattern), p).otherwise(product)
    return df.select("*", F.col("_metadata.file_name").alias(name), product.alias("source_product"))


def load_many(spark: SparkSession, paths: list[str], expected: list[str], products: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """Files of different columns as one table of the expected columns with provenance, and the log of rows by file."""
    out = None
    for p in paths:
        df = with_provenance(spark.read.csv(p, header=True, inferSchema=False), products)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    present = {find_column([c], [e]): e for e in expected for c in out.columns if find_column([c], [e])}
    out = out.withColumnsRenamed(present)
    out = out.select(*((F.col(e) if e in out.columns else F.lit(None).cast("string").alias(e)) for e in expected), "source_file", "source_product")
    return out, out.groupBy("source_file", "source_product").agg(F.count("*").alias("rows"))


def inventory(spark: SparkSession, path: str, rules: list[tuple[str, str]], valid: str, glob: str = "*") -> DataFrame:
    """Files below a path without their content: name, size, the kind of the first rule that the path matches, name validity."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "length", "modificationTime")
    kind = F.lit("other")
    for pattern, k in reversed(rules):
        kind = F.when(F.col("path").rlike(pattern), k).otherwise(kind)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("name"), F.col("length").alias("bytes"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("extension"), kind.alias("kind"), name.rlike(valid).alias("valid_name"))


def replace_source(df: DataFrame, path: str, source: str = "source") -> None:
    """Writes rows by source, replacing the sources that they bring and leaving others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(source).parquet(path)


def point(lon: Column, lat: Column) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))


def export(df: DataFrame, path: str, kind: str = "json") -> None:
    """Records as JSON with nulls written out, or as quoted CSV with header."""
    if kind == "json":
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    else:
        df.write.mode("overwrite").csv(path, header=True, quoteAll=True)


MANIFEST = "batch string, folder string, rows long, columns array<string>, kind string, published timestamp"


def publish_batch(df: DataFrame, path: str, batch: str, kind: str = "parquet", stem: str = "export") -> bool:
    """Adds the rows as one batch to an export, visible as a whole or not at all; False if the batch is there already.

    The rows go to a folder of their own with a time in its name; then a manifest names it with its count. Readers see
    only what manifests list: a write that fails on the way leaves nothing visible, and a batch that is sent twice
    counts once. Of manifests of the same batch (two writers at once) the earliest folder counts.
    """
    spark = df.sparkSession
    listed = manifests(spark, path)
    if listed is not None and listed.filter(F.col("batch") == batch).limit(1).count():
        return False
    folder = f"{stem}_{datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}_{uuid.uuid4().hex[:8]}"
    writer = df.write.mode("error")
    {"csv": lambda w, at: w.csv(at, header=True, quoteAll=True), "json": lambda w, at: w.option("ignoreNullFields", "false").json(at), "parquet": lambda w, at: w.parquet(at)}[kind](writer, f"{path}/data/{folder}")
    back = {"csv": lambda at: spark.read.csv(at, header=True), "json": lambda at: spark.read.json(at), "parquet": lambda at: spark.read.parquet(at)}[kind](f"{path}/data/{folder}")
    row = spark.createDataFrame([(batch, folder, back.count(), df.columns, kind, datetime.now(timezone.utc))], MANIFEST)
    row.coalesce(1).write.mode("append").json(f"{path}/manifests")
    return True


def manifests(spark: SparkSession, path: str) -> DataFrame | None:
    """The batches of an export, one row each, or None before the first."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifests")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    listed = spark.read.schema(MANIFEST).json(f"{path}/manifests")
    return listed.groupBy("batch").agg(F.min_by(F.struct("folder", "rows", "columns", "kind", "published"), "folder").alias("m")).select("batch", "m.*")


def read_published(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The rows of all batches that manifests list, with their ``batch``; an error if a batch's count doesn't hold.

    ``schema`` is needed for text kinds whose columns shouldn't be told from the rows.
    """
    listed = manifests(spark, path)
    if listed is None:
        raise FileNotFoundError(f"nothing is published at {path}")
    rows = listed.orderBy("batch").collect()  # one row for each batch
    kinds = {r["kind"] for r in rows}
    if len(kinds) > 1:
        raise ValueError(f"batches of kinds {sorted(kinds)} at {path}")
    reader = spark.read.option("header", "true") if kinds == {"csv"} else spark.read.option("mergeSchema", "true")
    reader = reader.schema(schema) if schema else reader
    found = reader.format(kinds.pop()).load([f"{path}/data/{r['folder']}" for r in rows])
    at = F.regexp_extract(F.col("_metadata.file_path"), r"/data/([^/]+)/", 1)
    out = found.select("*", at.alias("_folder"))
    counts = {r["_folder"]: r["n"] for r in out.groupBy("_folder").agg(F.count("*").alias("n")).collect()}
    if wrong := [r["batch"] for r in rows if counts.get(r["folder"], 0) != r["rows"]]:
        raise ValueError(f"batches {wrong} at {path} don't hold the rows that their manifests list")
    names = F.create_map(*(F.lit(x) for r in rows for x in (r["folder"], r["batch"])))
    return out.withColumn("batch", names[F.col("_folder")]).drop("_folder")


def band_statistics(pixels: DataFrame, no_data: str = "no_data") -> DataFrame:
    """Statistics of raster bands from a table of blocks: band, no_data, values (array of double)."""
    v = pixels.select("band", F.col(no_data).alias("_none"), F.explode("values").alias("v"))
    ok = F.col("v").isNotNull() & ~F.col("v").eqNullSafe(F.col("_none"))
    x = F.when(ok, F.col("v"))
    return v.groupBy("band").agg(F.count("*").alias("cells"), F.count(x).alias("valid"), F.count_if(~ok).alias("no_data"), F.min(x).alias("least"), F.max(x).alias("largest"), F.avg(x).alias("mean"))

