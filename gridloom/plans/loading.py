"""Queries of sources and sinks: files written to the shared folder from the given tables, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators.quality import profile
from gridloom.plans.fusion import rounded
from gridloom.plans.tables import table
from gridloom.sources import files as S
from gridloom.sources import reports as R
from gridloom.staging import scratch


def _folder(spark, name: str) -> str:
    return scratch(spark, name)


def q_delimited(spark, sf):
    """A semicolon file in Latin-1 with an empty column, told and read back as strings."""
    at = _folder(spark, "latin")
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("clave"), F.concat(F.lit("Ñandú "), "n_name").alias("nombre"), F.lit(None).cast("string").alias("vacío"))
    n.coalesce(1).write.csv(at, header=True, sep=";", encoding="ISO-8859-1")
    return S.read_table(spark, at, drop_empty=True)


def q_many(spark, sf):
    """Files of different columns as one table with provenance."""
    a, b = _folder(spark, "MODIS_2001"), _folder(spark, "VIIRS_2012")
    table(spark, sf, "supplier").select(F.col("s_suppkey").alias("Latitude"), F.col("s_nationkey").alias("FRP")).write.csv(a, header=True)
    table(spark, sf, "customer").select(F.col("c_custkey").alias("latitude"), F.col("c_mktsegment").alias("confidence")).write.csv(b, header=True)
    out, _ = S.load_many(spark, [a, b], ["latitude", "frp", "confidence", "type"], [("MODIS", "modis"), ("VIIRS", "viirs")])
    return out.groupBy("source_product").agg(F.count("*").alias("rows"), F.count("latitude").alias("latitude"), F.count("frp").alias("frp"), F.count("confidence").alias("confidence"), F.count("type").alias("type"))


def q_inventory(spark, sf):
    """The files of a written table, by kind and name validity."""
    at = _folder(spark, "inventory")
    table(spark, sf, "customer").select("c_mktsegment", "c_custkey").write.partitionBy("c_mktsegment").json(at)
    found = S.inventory(spark, at, [("c_mktsegment=BUILDING", "building"), ("c_mktsegment=", "segment")], r"^part-.*\.json$", "*.json")
    return found.groupBy("kind", "extension", "valid_name").agg((F.count("*") > 0).alias("there"), (F.sum("bytes") > 0).alias("filled"))


def _reports(spark, sf):
    """Station reports: one text for every user below 200 from their events."""
    e = table(spark, sf, "events").withColumn("station", (F.col("user_id") % 200).cast("string"))
    row = F.concat_ws("  ", F.date_format("ts", "dd/MM/yyyy"), F.when(F.col("event_id") % 7 == 0, "Nulo").when(F.col("event_id") % 11 == 0, "-9999").otherwise(F.format_string("%d,5", F.floor("value"))), (F.col("event_id") % 40).cast("string"))
    body = e.groupBy("station").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lpad(F.col("event_id").cast("string"), 12, "0"), F.lit("#"), row))), "\n").alias("rows"))
    text = F.concat(F.lit("INSTITUTO\nESTACIÓN : "), F.when(F.col("station").cast("int") % 3 != 0, F.col("station")).otherwise(F.lit("")), F.lit("\nSITUACIÓN: OPERANDO\n\nFECHA   LLUVIA  TMAX\n"), F.regexp_replace("rows", r"\d{12}#", ""), F.lit("\nFIN"))
    return body.select(F.concat(F.lit("/x/dia"), "station", F.lit(".txt")).alias("path"), text.alias("value"))


def q_reports(spark, sf):
    """Reports written as text files, one a station, and read back as daily rows."""
    at = _folder(spark, "reports")
    _reports(spark, sf).select(F.regexp_extract("path", r"(\d+)", 1).alias("s"), "value").write.partitionBy("s").text(at)
    files = spark.read.option("recursiveFileLookup", "true").text(at, wholetext=True).select(F.concat(F.regexp_extract("_metadata.file_path", r"s=(\d+)", 1), F.lit(".txt")).alias("path"), "value")
    rows = R.station_rows(files, ["rain", "tmax"], {"station": "ESTACION", "status": "SITUACION"})
    return rounded(rows.groupBy("station", "status").agg(F.count("*").alias("n"), F.count("rain").alias("rain_n"), F.sum("rain").alias("rain"), F.sum("tmax").alias("tmax"), F.min("day").alias("first"), F.max("day").alias("last")), rain=1)


def q_audit(spark, sf):
    """Reports' sections and token classes by station."""
    from gridloom.functions.text import token_class

    reports = _reports(spark, sf)
    found = R.sections(reports, ["INSTITUTO", "FIN", "EXTREMOS"]).select(F.regexp_extract("path", r"(\d+)", 1).alias("s"), F.array_join("found", ",").alias("found"), F.array_join("missing", ",").alias("missing"))
    e = table(spark, sf, "events").select((F.col("user_id") % 200).cast("string").alias("s"), F.to_date("ts").alias("day"), F.when(F.col("event_id") % 7 == 0, "Nulo").when(F.col("event_id") % 11 == 0, "-9999").otherwise(F.col("value").cast("string")).alias("token"))
    audit = R.station_audit(e, e.select("s", token_class(F.col("token")).alias("token_class")), "s", "day")
    return audit.join(found, "s")


def _cells(spark, sf):
    """A sheet of cells: a title, a two-row header and the parts of one size class below."""
    p = table(spark, sf, "part").select((F.col("p_partkey") + 10).cast("int").alias("row"), F.col("p_partkey").cast("string").alias("c0"), "p_brand", F.col("p_size").cast("string").alias("c2"), F.lit(None).cast("string").alias("c3"))
    body = p.select("row", F.posexplode(F.array("c0", "p_brand", "c2", "c3")).alias("col", "value"))
    head = spark.createDataFrame([(0, 0, "Inventario"), (0, 1, "2015"), (1, 0, "Clave"), (1, 1, "Parte"), (1, 2, None), (2, 1, "marca"), (2, 2, "tamaño"), (2, 3, "vacía")], "row int, col int, value string")
    cells = head.union(body).withColumns({"workbook": F.lit("w.xlsx"), "sheet": F.lit("Datos")})
    return cells.unionByName(head.withColumns({"workbook": F.lit("w.xlsx"), "sheet": F.lit("Diccionario")}))


def q_sheet(spark, sf):
    """The chosen sheet of a workbook of cells as a table."""
    c = _cells(spark, sf)
    sheet = R.choose_sheet(c, ["datos", "hoja"], "diccionario").first()["sheet"]
    mine = c.filter(F.col("sheet") == sheet)
    at = R.header_row(mine, ["clave", "parte"]).first()["header"]
    return R.sheet_table(mine, at, two=True).select("row", "clave", "parte_marca", "parte_tamano")


def q_sheet_profile(spark, sf):
    c = _cells(spark, sf)
    return R.sheet_profile(c).join(R.metadata_title(c), "sheet", "left")


def q_bands(spark, sf):
    b = table(spark, sf, "embeddings").select((F.col("label") % 3).alias("band"), F.lit(0.0).alias("no_data"), F.transform(F.col("embedding"), lambda x: F.round(x.cast("double") * 10, 0)).alias("values"))
    return S.band_statistics(b).select("band", "cells", "valid", "no_data", "least", "largest", F.round("mean", 6).alias("mean"))


def q_replace(spark, sf):
    """Two loads into one store by source; the second replaces its own source only."""
    at = _folder(spark, "store")
    o = table(spark, sf, "supplier").select("s_suppkey", S.point((F.col("s_suppkey") % 180).cast("double"), F.when(F.col("s_suppkey") % 4 != 0, (F.col("s_suppkey") % 90).cast("double"))).alias("location"), F.when(F.col("s_suppkey") % 2 == 0, "even").otherwise("odd").alias("source"))
    S.replace_source(o, at)
    S.replace_source(o.filter((F.col("source") == "odd") & (F.col("s_suppkey") % 3 == 0) & F.col("location.coordinates")[1].isNotNull()), at)
    return spark.read.parquet(at).groupBy("source").agg(F.count("*").alias("n"), F.sum("s_suppkey").alias("total"), F.sum(F.col("location.coordinates")[0]).alias("lon"))


def q_reduce(spark, sf):
    """A pruned copy without rows of low confidence; rows without confidence stay."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_partkey") % 5 != 0, F.when(F.col("l_returnflag") == "N", "Low").otherwise(F.lower("l_returnflag"))).alias("confidence"))
    return li.filter(F.coalesce(F.lower("confidence") != "low", F.lit(True)))


def q_export(spark, sf):
    """Records exported as JSON with nulls and as quoted CSV, counted and summed from what was written."""
    c = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("segment"))
    a, b = _folder(spark, "json"), _folder(spark, "csv")
    S.export(c, a)
    S.export(c, b, "csv")
    j, v = spark.read.text(a), spark.read.csv(b, header=True, schema="c_custkey bigint, segment string")
    return j.agg(F.lit("json").alias("kind"), F.count("*").alias("rows"), F.count_if(F.col("value").contains('"segment":null')).alias("nulls")).union(v.agg(F.lit("csv"), F.count("*"), F.count_if(F.col("segment").isNull())))


def q_attributes(spark, sf):
    """Attribute profile of a layer's columns, with the least and largest text length."""
    p = table(spark, sf, "part").select("p_brand", "p_type")
    sizes = p.agg(*(F.struct(F.lit(c).alias("column"), F.min(F.length(c)).alias("shortest"), F.max(F.length(c)).alias("longest")).alias(c) for c in p.columns)).select(F.explode(F.array(*p.columns)).alias("s")).select("s.*")
    return profile(p).select("column", "rows", "nulls", "distinct").join(sizes, "column")


QUERIES = {"read_delimited": q_delimited, "load_many_files": q_many, "file_inventory": q_inventory, "station_reports": q_reports, "report_audit": q_audit, "sheet_table": q_sheet, "sheet_profile": q_sheet_profile, "band_statistics": q_bands, "replace_source": q_replace, "reduced_copy": q_reduce, "export_records": q_export, "layer_attributes": q_attributes}
_T = "t AS (SELECT CAST(user_id % 200 AS VARCHAR) AS s, event_id, CAST(ts AS DATE) AS day, value FROM events)"
_CELL = """p AS (SELECT p_partkey AS k, p_brand AS b, p_size AS z FROM part), c(sheet, row, col, value) AS (SELECT 'Datos', k + 10, unnest([0, 1, 2, 3]), unnest([CAST(k AS VARCHAR), b, CAST(z AS VARCHAR), NULL]) FROM p UNION ALL SELECT s, r, c, v FROM (VALUES (0, 0, 'Inventario'), (0, 1, '2015'), (1, 0, 'Clave'), (1, 1, 'Parte'), (1, 2, NULL), (2, 1, 'marca'), (2, 2, 'tamaño'), (2, 3, 'vacía')) AS h(r, c, v), (VALUES ('Datos'), ('Diccionario')) AS w(s))"""
ORACLES = {
    "read_delimited": "SELECT CAST(n_nationkey AS VARCHAR) AS clave, 'Ñandú ' || n_name AS nombre FROM nation",
    "load_many_files": "SELECT 'modis' AS source_product, count(*) AS rows, count(*) AS latitude, count(*) AS frp, 0 AS confidence, 0 AS type FROM supplier UNION ALL SELECT 'viirs', count(*), count(*), 0, count(*), 0 FROM customer",
    "file_inventory": "SELECT DISTINCT CASE WHEN c_mktsegment = 'BUILDING' THEN 'building' ELSE 'segment' END AS kind, 'json' AS extension, true AS valid_name, true AS there, true AS filled FROM customer",
    "station_reports": f"WITH {_T}, r AS (SELECT *, CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN NULL ELSE floor(value) + 0.5 END AS rain FROM t), v AS (SELECT *, CASE WHEN rain NOT IN (999.9, 9999) THEN rain END AS ok FROM r) SELECT lpad(s, 5, '0') AS station, 'OPERANDO' AS status, count(*) AS n, count(ok) AS rain_n, round(sum(ok), 1) AS rain, CAST(sum(event_id % 40) AS DOUBLE) AS tmax, strftime(min(day), '%Y-%m-%d') AS first, strftime(max(day), '%Y-%m-%d') AS last FROM v GROUP BY s",
    "report_audit": f"WITH {_T} SELECT s, count(*) AS rows, count(DISTINCT day) AS days, count(DISTINCT date_trunc('month', day)) AS months, count(*) - count(DISTINCT day) AS repeated, count(*) FILTER (event_id % 7 = 0) AS text_sentinel, count(*) FILTER (event_id % 7 <> 0 AND (event_id % 11 = 0 OR value IN (99.99, 999.9, 9999))) AS numeric_sentinel, count(*) FILTER (event_id % 7 <> 0 AND event_id % 11 <> 0 AND value NOT IN (99.99, 999.9, 9999)) AS numeric, 0 AS other, 'FIN,INSTITUTO' AS found, 'EXTREMOS' AS missing FROM t GROUP BY s",
    "sheet_table": "SELECT CAST(p_partkey + 10 AS INTEGER) AS row, CAST(p_partkey AS VARCHAR) AS clave, p_brand AS parte_marca, CAST(p_size AS VARCHAR) AS parte_tamano FROM part",
    "sheet_profile": f"WITH {_CELL} SELECT sheet, CAST(col AS INTEGER) AS col, count(value) AS filled, count(try_cast(value AS DOUBLE)) AS numbers, count(DISTINCT value) AS distinct, min(value) AS sample, round(avg(CAST(value IS NULL AS INTEGER)), 4) AS empty_share, 'Inventario 2015' AS title FROM c GROUP BY 1, 2",
    "band_statistics": "WITH v AS (SELECT label % 3 AS band, unnest(list_transform(embedding, lambda x: round(CAST(x AS DOUBLE) * 10, 0))) AS v FROM embeddings) SELECT band, count(*) AS cells, count(*) FILTER (v <> 0) AS valid, count(*) FILTER (v = 0) AS no_data, min(v) FILTER (v <> 0) AS least, max(v) FILTER (v <> 0) AS largest, round(avg(v) FILTER (v <> 0), 6) AS mean FROM v GROUP BY 1",
    "replace_source": "SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'even' ELSE 'odd' END AS source, count(*) AS n, CAST(sum(s_suppkey) AS BIGINT) AS total, CAST(sum(s_suppkey % 180) AS DOUBLE) AS lon FROM supplier WHERE s_suppkey % 2 = 0 OR (s_suppkey % 3 = 0 AND s_suppkey % 4 <> 0) GROUP BY 1",
    "reduced_copy": "WITH l AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 5 <> 0 THEN CASE WHEN l_returnflag = 'N' THEN 'Low' ELSE lower(l_returnflag) END END AS confidence FROM lineitem) SELECT * FROM l WHERE confidence IS NULL OR confidence <> 'Low'",
    "export_records": "SELECT 'json' AS kind, count(*) AS rows, count(*) FILTER (c_custkey % 2 <> 0) AS nulls FROM customer UNION ALL SELECT 'csv', count(*), count(*) FILTER (c_custkey % 2 <> 0) FROM customer",
    "layer_attributes": "SELECT 'p_brand' AS \"column\", count(*) AS rows, count(*) - count(p_brand) AS nulls, count(DISTINCT p_brand) AS distinct, CAST(min(length(p_brand)) AS INTEGER) AS shortest, CAST(max(length(p_brand)) AS INTEGER) AS longest FROM part UNION ALL SELECT 'p_type', count(*), count(*) - count(p_type), count(DISTINCT p_type), CAST(min(length(p_type)) AS INTEGER), CAST(max(length(p_type)) AS INTEGER) FROM part",
}
