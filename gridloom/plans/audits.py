"""Queries of audits by rules, contracts on values, published exports, free dates and registries of other makers."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions.dates import day_first
from gridloom.operators import audit as A
from gridloom.operators import quality as Q
from gridloom.operators import registry as G
from gridloom.plans.fusion import rounded
from gridloom.plans.tables import iso, table
from gridloom.sources import files as S
from gridloom.staging import scratch

HIGH, MEDIUM = ("high", "medium")
# finding, columns, test, arguments, severities by share
EVENT_RULES = [
    ("repeated_rows", [], "repeated", [], [(0.01, HIGH), (0.0, MEDIUM)]),
    ("repeated_key", ["key"], "repeated", [], [(0.0, MEDIUM)]),
    ("missing_key", ["key"], "missing", [], [(0.2, HIGH), (0.0, MEDIUM)]),
    ("missing_begin", ["begin"], "missing", [], [(0.2, HIGH), (0.0, MEDIUM)]),
    ("missing_name", ["name"], "missing", [], [(0.5, MEDIUM)]),
    ("unreadable_begin", ["begin"], "not_date", [], [(0.05, HIGH), (0.0, MEDIUM)]),
    ("begin_outside", ["begin"], "date_outside", ["1995-06-01", "1999-12-31"], [(0.0, MEDIUM)]),
    ("finish_before_begin", ["begin", "finish"], "before", [], [(0.1, HIGH), (0.0, MEDIUM)]),
    ("area_not_number", ["area"], "not_number", [], []),
    ("area_negative", ["area"], "negative", [], [(0.0, HIGH)]),
    ("latitude_outside", ["lat"], "outside", ["14", "60"], []),
    ("no_such_column", ["cause"], "missing", [], []),
]
DETECTION_RULES = [
    ("missing_power", ["power"], "missing", [], [(0.1, HIGH)]),
    ("repeated", ["lat", "lon", "day", "time"], "repeated", [], [(0.01, HIGH), (0.0, MEDIUM)]),
    ("power_outside", ["power"], "outside", ["0", "90"], [(0.05, MEDIUM)]),
    ("time_form", ["time"], "pattern", ["^([01][0-9]|2[0-3])[0-5][0-9]$"], [(0.0, HIGH)]),
    ("day_outside", ["day"], "date_outside", ["2024-01-01", "2024-01-20"], [(0.5, HIGH)]),
    ("kind_unknown", ["kind"], "domain", ["click", "view", "error"], []),
]


def _events(spark, sf):
    k, d = F.col("o_orderkey"), F.to_date("o_orderdate")
    o = table(spark, sf, "orders")
    rows = o.select(
        F.when(k % 17 != 0, (k - F.when(k % 19 == 0, 1).otherwise(0)).cast("string")).otherwise(F.when(k % 2 == 0, " ")).alias("key"),
        F.when(k % 13 == 0, "soon").when(k % 11 != 0, iso(d)).alias("begin"),
        F.when(k % 5 != 0, F.date_format(F.date_add(d, (k % 4 - 1).cast("int")), "d/M/yyyy")).alias("finish"),
        F.when(k % 29 != 0, F.col("o_orderpriority")).alias("name"),
        F.when(k % 7 == 0, "many").when(k % 23 == 0, "-5").otherwise((k % 100).cast("string")).alias("area"),
        (F.col("o_custkey") % 70).cast("string").alias("lat"),
    )
    return rows.union(rows.filter("key = '2'"))


def q_event_audit(spark, sf):
    """Findings of the event rules, from one pass."""
    return rounded(A.audit(_events(spark, sf), A.rules_of(spark, EVENT_RULES)), share=6)


def q_detection_findings(spark, sf):
    """Findings of the detection rules for each file."""
    e, k = table(spark, sf, "events"), F.col("event_id")
    rows = e.select((F.col("user_id") % 3).cast("string").alias("file"), F.when(k % 9 != 0, F.col("value")).alias("power"), (k % 40).alias("lat"), (k % 7).alias("lon"), iso("ts").alias("day"), F.when(k % 50 == 0, "2460").otherwise(F.date_format("ts", "HHmm")).alias("time"), F.col("event_type").alias("kind"))
    return rounded(A.audit(rows, A.rules_of(spark, DETECTION_RULES), ["file"]), share=6)


def q_inventory_reports(spark, sf):
    """Reports on two inventory tables: orders by year and customer, items by year and supplier."""
    o = table(spark, sf, "orders").select(F.year("o_orderdate").alias("year"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey")).alias("place"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("area"))
    i = table(spark, sf, "lineitem").groupBy(F.year("l_shipdate").alias("year"), F.col("l_suppkey").alias("place")).agg(F.sum("l_quantity").alias("area"))
    a = A.inventory_report(o, "orders", ["year", "place"], "year", (1995, 2001), ["area"])
    b = A.inventory_report(i, "items", ["year", "place"], "year", (1995, 2001), ["area"])
    return rounded(a.unionByName(b).drop("left_out", "columns"), total_area=2)


def q_value_checks(spark, sf):
    """Columns of a matrix that are null throughout or hold one value, its keys, and its rows against the base."""
    base = table(spark, sf, "part")
    m = base.select("p_partkey", "p_size", F.lit(None).cast("double").alias("gone"), F.lit("x").alias("same"), F.when(F.col("p_size") > 10, 1).alias("some"), F.lit(3.5).alias("free"))
    return Q.check_values(m, "matrix", ["free"]).union(Q.check_rows(m, base, "matrix")).union(Q.check_unique(m, ["p_partkey"], "matrix")).union(Q.check_columns(m, ["p_partkey", "p_brand"], ["free"], "matrix")).select("check", "value", "status")


def q_published(spark, sf):
    """Orders published in batches of priorities; one batch is sent twice, and a folder without a manifest is no part."""
    at = scratch(spark, "published")
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    for p in ("1-URGENT", "2-HIGH", "1-URGENT"):
        S.publish_batch(o.filter(F.col("o_orderpriority") == p), at, p, "parquet", "orders")
    o.write.parquet(f"{at}/data/orders_lost")
    return S.read_published(spark, at).select("batch", "o_orderkey", "o_totalprice")


def q_free_dates(spark, sf):
    """Dates of orders written in free forms, read back day first."""
    k, d = F.col("o_orderkey"), F.to_date("o_orderdate")
    forms = ["d MMMM yyyy", "d-MMM-yy", "MMMM d, yyyy", "dd.MM.yyyy", "d/M/yy", "EEE, d MMM yyyy HH:mm:ss", "yyyy MMM d"]
    text = F.lit("31/31/1999")
    for i, form in enumerate(forms):
        text = F.when(k % 8 == i, F.date_format("o_orderdate", form)).otherwise(text)
    return table(spark, sf, "orders").select("o_orderkey", iso(day_first(text)).alias("day"))


KINDS = {"year": "year", "key": "key", "state": "text", "state_name": "text", "region": "text", "region_name": "text", "begin": "date", "finish": "date", "area": "number"}
COMMON = {"year": "int", "key": "string", "state": "bigint", "region": "bigint", "begin": "date", "finish": "date", "area": "double", "impact": "string", "cause": "string", "origin": "string", "preferred": "string"}
IMPACT = {"1-urgent": "severe", "2-high": "severe", "5-low": "light"}


def _catalogs(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return r.select(F.col("r_regionkey").alias("state"), F.col("r_name").alias("state_name")), n.select(F.col("n_regionkey").alias("state"), F.col("n_nationkey").alias("region"), F.col("n_name").alias("region_name"))


def _historical(spark, sf):
    """Orders as another maker's registry: names, mixed attributes and keys in its own form."""
    k = F.col("o_orderkey")
    places = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    o = table(spark, sf, "orders").join(places, F.col("o_custkey") == F.col("c_custkey"))
    return o.select(
        F.year("o_orderdate").cast("string").alias("Año"),
        F.concat(F.lit(" 00-"), k.cast("string"), F.lit(" ")).alias("Clave Evento"),
        F.when(k % 3 != 0, F.col("n_regionkey").cast("string")).alias("CVE_ENT"),
        F.lower("r_name").alias("Estado"),
        F.when(k % 2 != 0, F.col("n_nationkey").cast("string")).alias("CVE_MUN"),
        F.concat(F.lit(" "), F.initcap("n_name")).alias("Municipio"),
        F.date_format("o_orderdate", "d/M/yyyy").alias("Fecha inicio"),
        F.when(k % 4 == 0, "-").otherwise(F.date_format(F.date_add("o_orderdate", 2), "yyyy-MM-dd")).alias("Fecha término"),
        F.when(k % 9 == 0, "s/d").otherwise(F.col("o_totalprice").cast("string")).alias("Superficie"),
        F.when(k % 2 == 0, F.col("o_orderpriority")).otherwise("F").alias("clasificac"),
        F.when(k % 2 == 0, "F").otherwise(F.col("o_orderpriority")).alias("clasifi_01"),
    )


NAMES = {"ano": "year", "clave_evento": "key", "cve_ent": "state", "estado": "state_name", "cve_mun": "region", "municipio": "region_name", "fecha_inicio": "begin", "fecha_termino": "finish", "superficie": "area"}


def _shown(df):
    return rounded(df.withColumns({"begin": iso("begin"), "finish": iso("finish")}), area=2)


def _common(spark, sf):
    states, regions = _catalogs(spark, sf)
    return G.historical_registry(_historical(spark, sf), NAMES, KINDS, {"impact": ("clasificac", "clasifi_01", IMPACT)}, {"origin": "historical", "preferred": "shapes"}, COMMON, states.withColumn("state", F.col("state").cast("string")), regions.withColumns({c: F.col(c).cast("string") for c in ("state", "region")}))


def q_historical(spark, sf):
    return _shown(_common(spark, sf))


def q_reread(spark, sf):
    """The common registry written as text with broken letters and lost keys, read back and resolved anew."""
    at = scratch(spark, "registry")
    states, regions = (t.withColumns({c: F.col(c).cast("string") for c in t.columns}) for t in _catalogs(spark, sf))
    named = _common(spark, sf).withColumns({c: F.col(c).cast("string") for c in ("state", "region")}).join(regions.select("region", "region_name"), "region", "left").join(states, "state", "left")
    lost = F.coalesce(F.col("year") % 2 == 0, F.lit(False))
    named.withColumns({"region": F.when(~lost, F.col("region")), "impact": F.when(F.col("impact") == "light", "ligÃ©ro").otherwise(F.col("impact"))}).write.csv(at, header=True)
    out = G.reread_registry(spark.read.csv(at, header=True), KINDS | {"impact": "text", "origin": "text"}, COMMON, states, regions)
    return _shown(out)


QUERIES = {"event_audit": q_event_audit, "detection_findings": q_detection_findings, "inventory_reports": q_inventory_reports, "value_checks": q_value_checks, "published_batches": q_published, "free_dates": q_free_dates, "historical_registry": q_historical, "registry_reread": q_reread}
_EVENTS = """k AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, o_custkey AS c, o_orderpriority AS p FROM orders),
  r AS (SELECT CASE WHEN k % 17 <> 0 THEN CAST(k - CASE WHEN k % 19 = 0 THEN 1 ELSE 0 END AS VARCHAR) END AS key, CASE WHEN k % 13 = 0 THEN 0 WHEN k % 11 <> 0 THEN 1 END AS readable, CASE WHEN k % 13 <> 0 AND k % 11 <> 0 THEN d END AS begin, CASE WHEN k % 5 <> 0 THEN d + CAST(k % 4 - 1 AS INTEGER) END AS finish, CASE WHEN k % 29 <> 0 THEN p END AS name, CASE WHEN k % 7 = 0 THEN 'many' WHEN k % 23 = 0 THEN '-5' ELSE CAST(k % 100 AS VARCHAR) END AS area, c % 70 AS lat, CASE WHEN k % 17 = 0 AND k % 2 = 0 THEN 1 ELSE 0 END AS blank FROM k),
  e AS (SELECT * FROM r UNION ALL SELECT * FROM r WHERE key = '2'), n AS (SELECT count(*) AS n FROM e)"""
_SEV = "(VALUES ('repeated_rows', '', 0.01, 'high', 'medium'), ('repeated_key', 'key', 9, '', 'medium'), ('missing_key', 'key', 0.2, 'high', 'medium'), ('missing_begin', 'begin', 0.2, 'high', 'medium'), ('missing_name', 'name', 0.5, 'medium', 'low'), ('unreadable_begin', 'begin', 0.05, 'high', 'medium'), ('begin_outside', 'begin', 9, '', 'medium'), ('finish_before_begin', 'begin,finish', 0.1, 'high', 'medium'), ('area_not_number', 'area', 9, '', 'low'), ('area_negative', 'area', 9, '', 'high'), ('latitude_outside', 'lat', 9, '', 'low'), ('no_column', 'cause', 9, '', 'high')) AS s(finding, columns, cut, over, under)"
_ORDERS_PLACES = "p AS (SELECT o.*, n_regionkey, n_nationkey, n_name, r_name FROM orders AS o JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"
_COMMON = """h AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, '00-' || o_orderkey AS key, n_regionkey AS state, n_nationkey AS region, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS begin, CASE WHEN o_orderkey % 4 <> 0 THEN strftime(CAST(o_orderdate AS DATE) + 2, '%Y-%m-%d') END AS finish, CASE WHEN o_orderkey % 9 <> 0 THEN round(o_totalprice, 2) END AS area,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'severe' WHEN o_orderpriority = '5-LOW' THEN 'light' END AS impact, CAST(NULL AS VARCHAR) AS cause, 'historical' AS origin, 'shapes' AS preferred FROM p)"""
_REPORT = """SELECT '{0}' AS dataset, count(*) AS rows, min(year) AS least_year, max(year) AS largest_year, count(DISTINCT year) AS years, count_if(year NOT BETWEEN 1995 AND 2001) AS years_outside, count_if(year IS NULL OR place IS NULL) AS null_keys, count_if(area IS NULL) AS null_values, count_if(area < 0) AS negative_values, count(*) - count(DISTINCT (year, place, area)) AS repeated_rows, count(*) - count(DISTINCT (year, place)) AS repeated_keys, round(sum(area), 2) AS total_area FROM {1}"""
ORACLES = {
    "event_audit": f"""WITH {_EVENTS}, f AS (SELECT unnest(['repeated_rows', 'repeated_key', 'missing_key', 'missing_begin', 'missing_name', 'unreadable_begin', 'begin_outside', 'finish_before_begin', 'area_not_number', 'area_negative', 'latitude_outside', 'no_column']) AS finding,
    unnest([count(*) - count(DISTINCT (coalesce(key, CASE WHEN blank = 1 THEN ' ' ELSE '?' END), coalesce(CAST(begin AS VARCHAR), CAST(readable AS VARCHAR), '?'), coalesce(CAST(finish AS VARCHAR), '?'), coalesce(name, '?'), area, lat)), count(key) - count(DISTINCT key), count_if(key IS NULL), count_if(readable IS NULL), count_if(name IS NULL), count_if(readable = 0), count_if(begin < DATE '1995-06-01' OR begin > DATE '1999-12-31'), count_if(finish < begin), count_if(area = 'many'), count_if(area = '-5'), count_if(lat < 14 OR lat > 60), count(*)]) AS n FROM e)
    SELECT f.finding, s.columns, f.n, round(CAST(f.n AS DOUBLE) / n.n, 6) AS share, CASE WHEN f.n / n.n >= cut THEN over ELSE under END AS severity FROM f CROSS JOIN n JOIN {_SEV} ON s.finding = f.finding WHERE f.n > 0""",
    "detection_findings": """WITH e AS (SELECT CAST(user_id % 3 AS VARCHAR) AS file, CASE WHEN event_id % 9 <> 0 THEN value END AS power, event_id % 40 AS lat, event_id % 7 AS lon, CAST(ts AS DATE) AS day, CASE WHEN event_id % 50 = 0 THEN '2460' ELSE strftime(ts, '%H%M') END AS time, event_type AS kind FROM events), n AS (SELECT file, count(*) AS n FROM e GROUP BY 1),
  f AS (SELECT file, unnest(['missing_power', 'repeated', 'power_outside', 'time_form', 'day_outside', 'kind_unknown']) AS finding, unnest([count_if(power IS NULL), count(*) - count(DISTINCT (lat, lon, day, time)), count_if(power < 0 OR power > 90), count_if(time = '2460'), count_if(day < DATE '2024-01-01' OR day > DATE '2024-01-20'), count_if(kind NOT IN ('click', 'view', 'error'))]) AS n FROM e GROUP BY file)
  SELECT f.file, f.finding, s.columns, f.n, round(CAST(f.n AS DOUBLE) / n.n, 6) AS share, CASE WHEN f.n / n.n >= cut THEN over ELSE under END AS severity FROM f JOIN n ON n.file = f.file JOIN (VALUES ('missing_power', 'power', 0.1, 'high', 'low'), ('repeated', 'lat,lon,day,time', 0.01, 'high', 'medium'), ('power_outside', 'power', 0.05, 'medium', 'low'), ('time_form', 'time', 9, '', 'high'), ('day_outside', 'day', 0.5, 'high', 'low'), ('kind_unknown', 'kind', 9, '', 'low')) AS s(finding, columns, cut, over, under) ON s.finding = f.finding WHERE f.n > 0""",
    "inventory_reports": f"""WITH o AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END AS place, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS area FROM orders), i AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, l_suppkey AS place, sum(l_quantity) AS area FROM lineitem GROUP BY 1, 2), r AS ({_REPORT.format("orders", "o")} UNION ALL {_REPORT.format("items", "i")}),
  t AS (SELECT *, concat_ws('; ', CASE WHEN rows = 0 THEN 'no rows' END, CASE WHEN least_year <> 1995 OR largest_year <> 2001 THEN 'other period' END, CASE WHEN years <> 7 THEN 'years missing' END, CASE WHEN null_keys > 0 THEN 'null keys' END, CASE WHEN null_values > 0 THEN 'null values' END, CASE WHEN negative_values > 0 THEN 'negative values' END, CASE WHEN repeated_rows > 0 THEN 'repeated rows' END, CASE WHEN repeated_keys > 0 THEN 'repeated keys' END) AS notes FROM r) SELECT *, CASE WHEN notes = '' THEN 'ok' ELSE 'review' END AS status FROM t""",
    "value_checks": "SELECT * FROM (VALUES ('matrix: columns without values', 'gone', 'error'), ('matrix: columns of one value', 'same', 'warning'), ('matrix: unique p_partkey', '0', 'ok'), ('matrix: required columns', 'p_brand', 'error'), ('matrix: forbidden columns', 'free', 'error')) AS t(\"check\", value, status) UNION ALL SELECT 'matrix: rows of base', count(*) || '/' || count(*), 'ok' FROM part",
    "published_batches": "SELECT o_orderpriority AS batch, o_orderkey, o_totalprice FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')",
    "free_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 8 <> 7 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders",
    "historical_registry": f"WITH {_ORDERS_PLACES}, {_COMMON} SELECT * FROM h",
    "registry_reread": f"WITH {_ORDERS_PLACES}, {_COMMON} SELECT * REPLACE (CASE WHEN impact = 'light' THEN 'ligéro' ELSE impact END AS impact, CAST(NULL AS VARCHAR) AS preferred) FROM h",
}
