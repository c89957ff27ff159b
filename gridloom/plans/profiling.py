"""Queries of quality flags, profiles and contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import quality as Q
from gridloom.operators.ranking import keep_first
from gridloom.plans.fusion import _REGION_DAY, fused, rounded, state_days
from gridloom.plans.tables import iso, table
from gridloom.staging import staged

BOX = (10.0, 60.0, -150.0, -20.0)


def _events(spark, sf):
    k = F.col("o_orderkey")
    d = F.to_date("o_orderdate")
    return table(spark, sf, "orders").select(
        F.when(k % 17 != 0, (k - F.when(k % 19 == 0, 1).otherwise(0)).cast("string")).alias("key"),
        F.when(k % 23 != 0, F.year(d) + F.when(k % 29 == 0, 1).otherwise(0)).alias("year"),
        F.when(k % 31 != 0, d).alias("begin"),
        F.when(k % 5 != 0, F.date_add(d, (k % 4 - 1).cast("int"))).alias("finish"),
        F.when(k % 37 != 0, (F.col("o_custkey") % 70).cast("double")).alias("lat"),
        (-(F.col("o_custkey") % 160)).cast("double").alias("lon"),
        F.when(k % 6 != 0, F.lpad((F.col("o_custkey") % 32).cast("string"), 2, "0")).alias("state"),
        F.when(k % 7 != 0, (F.col("o_custkey") % 1200).cast("string")).alias("region"),
        F.when(k % 41 == 0, F.lit("MÃ©xico")).otherwise(F.col("o_orderpriority")).alias("name"),
        k.alias("id"),
    )


def _flagged(spark, sf):
    return Q.event_flags(_events(spark, sf), "key", "year", "begin", "finish", "lat", "lon", "state", "region", ["name"], (1993, 1997), BOX)


def q_flags(spark, sf):
    out, _, _ = _flagged(spark, sf)
    return out.select("id", "blocking", "warning", "fit_spatial", "fit_regional", "fit_duration", "reasons")


def q_flag_counts(spark, sf):
    out, errors, warnings = _flagged(spark, sf)
    return Q.count_flags(out, [*errors, *warnings])


def q_invalid(spark, sf):
    out, errors, _ = _flagged(spark, sf)
    return Q.invalid_report(out, errors).select("id", "reasons")


def q_detections(spark, sf):
    """Detections after the base filter: critical values there, ranges, period, exact and logical copies."""
    k = F.col("l_orderkey") + F.col("l_linenumber")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(k % 50 != 0, (F.col("l_partkey") % 95).cast("double")).alias("lat"), (F.col("l_suppkey") % 200 - 100).cast("double").alias("lon"), F.to_date("l_shipdate").alias("day"), "l_returnflag", F.round("l_extendedprice", 2).alias("power"))
    li = Q.with_flags(li, {"missing": F.col("lat").isNull() | F.col("day").isNull(), "range": ~F.col("lat").between(-90, 90) | ~F.col("lon").between(-180, 180), "period": ~F.col("day").between(F.lit("1993-01-01").cast("date"), F.lit("1997-12-31").cast("date"))})
    kept = Q.keep_valid(li, ["missing", "range", "period"]).dropDuplicates()
    first = keep_first(kept, ["lat", "lon", "day", "l_returnflag"], ["l_orderkey", "l_linenumber", "power"])
    return rounded(first.select("l_orderkey", "l_linenumber", "lat", "lon", "day", "l_returnflag", "power"))


def q_detection_counts(spark, sf):
    """What the base filter finds, counted before anything is removed, by file (return flag)."""
    li = table(spark, sf, "lineitem").select("l_returnflag", (F.col("l_partkey") % 95).cast("double").alias("lat"), F.year("l_shipdate").alias("year"))
    return li.groupBy("l_returnflag").agg(F.count("*").alias("rows"), F.count_if(F.col("lat") > 90).alias("range"), F.count_if(~F.col("year").between(1993, 1997)).alias("period"), (F.count("*") - F.countDistinct("lat", "year")).alias("copies"))


def q_readings(spark, sf):
    """Station rows that pass the rules: not all missing, no negative rain, maximum not below minimum."""
    e = table(spark, sf, "events").select("event_id", "value", F.when(F.col("event_id") % 3 != 0, F.col("value") - 50).alias("rain"), F.when(F.col("event_id") % 4 != 0, F.col("user_id") % 40).alias("tmax"), F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 40).alias("tmin"))
    flags = {"all_missing": F.col("rain").isNull() & F.col("tmax").isNull() & F.col("tmin").isNull(), "negative": F.col("rain") < 0, "crossed": F.col("tmax") < F.col("tmin")}
    return rounded(Q.keep_valid(Q.with_flags(e, flags), list(flags)).select("event_id", "rain", "tmax", "tmin"))


def q_inventory(spark, sf):
    """Inventory rows with their required values, years in range, positive values, no totals, each once."""
    p = table(spark, sf, "orders").select(F.when(F.col("o_custkey") % 9 != 0, F.year("o_orderdate")).alias("year"), F.when(F.col("o_orderstatus") == "P", "TOTAL").otherwise(F.col("o_orderstatus")).alias("kind"), (F.col("o_custkey") % 6).alias("value"))
    return p.dropna(subset=["year", "kind"]).filter(F.col("year").between(1993, 1997) & (F.col("value") > 0) & ~F.upper("kind").isin("TOTAL", "TOTALES")).dropDuplicates()


def q_profile(spark, sf):
    p = table(spark, sf, "part").select("p_brand", "p_type", "p_size", F.round(F.col("p_retailprice") - 1000, 2).alias("price_sum"), F.when(F.col("p_size") > 25, F.col("p_size")).alias("area"), F.lit(1).alias("source"))
    return rounded(Q.profile(p, known={"source": "trace"}), mean=4, deviation=4, median=4, p01=4, p99=4)


def q_selected(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal", F.lit(None).cast("double").alias("empty"), F.lit(7).alias("constant"), F.col("c_name").alias("source_file"), "c_mktsegment")
    kept = Q.select_columns(Q.profile(c, known={"source_file": "trace"}), ["c_custkey"])
    return rounded(c.select(*kept), c_acctbal=2)


def q_types(spark, sf):
    o = table(spark, sf, "orders").select(F.date_format("o_orderdate", "dd/MM/yyyy").alias("when"), F.col("o_custkey").cast("string").alias("who"), F.format_string("%.2f", "o_totalprice").alias("much"), F.col("o_orderstatus").alias("status"), F.md5(F.col("o_orderkey").cast("string")).alias("note"))
    return Q.semantic_types(o, o.columns)


def q_nulls(spark, sf):
    e = _events(spark, sf)
    return Q.null_findings(e.select(*(F.col(c).cast("string").alias(c) for c in e.columns)), ["key", "lat"])


def q_contract(spark, sf):
    """Contracts on the fused table, written once, and on its roll-up."""
    f = staged(fused(spark, sf), "fused")
    s = state_days(spark, sf, f)
    tests = {"null region": (F.col("region").isNull(), "error"), "before 1990": (F.col("day") < F.lit("1990-01-01").cast("date"), "error"), "no source": ((F.col("has_event") + F.col("has_detection") + F.col("has_station")) == 0, "error"), "no event": (F.col("has_event") == 0, "warning")}
    report = Q.check_unique(f, ["region", "day"], "region-day").union(Q.check_counts(f, "region-day", tests)).union(Q.check_columns(f, ["region", "day", "event_count"], ["future"], "region-day")).union(Q.check_unique(s, ["state", "day"], "state-day")).union(Q.check_rows(f.select("region", "day").distinct(), f, "region-day"))
    return Q.stop_on_error(staged(report, "report"))


def q_outside(spark, sf):
    e = table(spark, sf, "events")
    finite = Q.not_finite(e.select("value", F.when(F.col("event_id") % 8 == 0, float("inf")).otherwise(F.col("value")).alias("v")), ["value", "v"])
    return Q.outside(e, "value", 10.0, 90.0).select(F.lit("outside").alias("column"), F.col("outside").alias("bad")).union(finite)


def q_catalog(spark, sf):
    c = table(spark, sf, "customer").select(F.when(F.col("c_custkey") % 10 == 0, F.lit("x")).otherwise((F.col("c_custkey") % 150).cast("string")).alias("code"), F.col("c_name").alias("name"))
    return Q.clean_catalog(c, "code", 2, "name")


#: For each column of the line items its role by SQL: rules of the operator in the terms of one column.
_TARGETS, _SOURCES = ["l_returnflag"], {"l_returnflag": "state", "l_linestatus": "state"}


def q_roles(spark, sf):
    """Roles of the line items' columns by their measures, and what would leak the return flag."""
    found = Q.roles(Q.measured(table(spark, sf, "lineitem")), {"l_linenumber": "order"})
    return Q.leakage(found, _TARGETS, _SOURCES).select("column", "rows", "missing", "distinct", "role", "leakage")


def _told(x: str, number: bool) -> str:
    """A column's role by SQL."""
    n, distinct = f"CAST({x} AS DOUBLE)", f"count(DISTINCT {x})"
    same, whole = f"{distinct} >= 0.95 * count({x})", f"bool_and({n} = floor({n}))"
    start = f"CASE WHEN {distinct} = 0 THEN 'empty' WHEN {distinct} <= 2 THEN 'flag'"
    if number:
        return f"{start} WHEN {whole} AND {same} THEN 'identifier' WHEN {whole} THEN 'count' WHEN min({n}) >= 0 AND max({n}) <= 1 THEN 'share' ELSE 'measure' END"
    return f"{start} WHEN {same} THEN 'identifier' WHEN {distinct} <= 50 THEN 'category' ELSE 'text' END"


def _role_sql(column: str, kind: str) -> str:
    role = "'order'" if column == "l_linenumber" else "'time'" if kind == "time" else _told(column, kind == "number")
    leak = "target" if column in _TARGETS else "same_source" if column in _SOURCES else "none"
    return f"SELECT '{column}' AS \"column\", count(*) AS rows, count(*) - count({column}) AS missing, count(DISTINCT {column}) AS \"distinct\", {role} AS role, '{leak}' AS leakage FROM lineitem"


QUERIES = {"event_flags": q_flags, "flag_counts": q_flag_counts, "invalid_report": q_invalid, "detection_filter": q_detections, "detection_audit": q_detection_counts, "reading_rules": q_readings, "inventory_filter": q_inventory, "column_profile": q_profile, "column_selection": q_selected, "semantic_types": q_types, "null_findings": q_nulls, "contract_report": q_contract, "range_checks": q_outside, "region_catalog": q_catalog, "column_roles": q_roles}
_V = """v AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_orderkey - CASE WHEN o_orderkey % 19 = 0 THEN 1 ELSE 0 END AS VARCHAR) END AS key, CASE WHEN o_orderkey % 23 <> 0 THEN year(o_orderdate) + CASE WHEN o_orderkey % 29 = 0 THEN 1 ELSE 0 END END AS year,
  CASE WHEN o_orderkey % 31 <> 0 THEN CAST(o_orderdate AS DATE) END AS b, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 4 - 1 AS INTEGER) END AS f, CASE WHEN o_orderkey % 37 <> 0 THEN o_custkey % 70 END AS lat, -(o_custkey % 160) AS lon,
  CASE WHEN o_orderkey % 6 <> 0 THEN lpad(CAST(o_custkey % 32 AS VARCHAR), 2, '0') END AS state, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_custkey % 1200 AS VARCHAR) END AS region FROM orders),
w AS (SELECT *, key IS NULL AS e1, key IS NOT NULL AND count(*) OVER (PARTITION BY key) > 1 AS e2, year IS NULL AS e3, coalesce(year NOT BETWEEN 1993 AND 1997, false) AS e4, b IS NULL AS e5, lat IS NULL AS e6, false AS e7, coalesce(lat IS NOT NULL AND NOT (lat BETWEEN 10 AND 60 AND lon BETWEEN -150 AND -20), false) AS e8, coalesce(length(state) <> 2, false) AS e9, coalesce(length(region) <> 3, false) AS e10,
  f IS NULL AS w1, coalesce(f < b, false) AS w2, state IS NULL AS w3, region IS NULL AS w4, coalesce(year <> year(b), false) AS w5, k % 41 = 0 AS w6 FROM v),
z AS (SELECT *, e1 OR e2 OR e3 OR e4 OR e5 OR e6 OR e7 OR e8 OR e9 OR e10 AS blocking, w1 OR w2 OR w3 OR w4 OR w5 OR w6 AS warning FROM w)"""
_N = [("e1", "key_missing"), ("e2", "key_repeated"), ("e3", "year_missing"), ("e4", "year_outside"), ("e5", "begin_missing"), ("e6", "lat_missing"), ("e7", "lon_missing"), ("e8", "outside_box"), ("e9", "state_width"), ("e10", "region_width"), ("w1", "finish_missing"), ("w2", "finish_before_begin"), ("w3", "state_missing"), ("w4", "region_missing"), ("w5", "year_differs"), ("w6", "mojibake")]
_WHY = lambda names: "nullif(concat_ws('; ', " + ", ".join(f"CASE WHEN {a} THEN '{n}' END" for a, n in names) + "), '')"
_PROFILED = [("p_brand", "p_brand", 0, None), ("p_type", "p_type", 0, None), ("p_size", "p_size", 1, None), ("price_sum", "round(p_retailprice - 1000, 2)", 1, None), ("area", "CASE WHEN p_size > 25 THEN p_size END", 1, None), ("source", "p_size * 0 + 1", 1, "trace")]


def _profile_sql(name: str, x: str, number: int, given: str | None) -> str:
    role = f"'{given}'" if given else _told(f"({x})", bool(number))
    n = f"CAST({x} AS DOUBLE)" if number else "CAST(NULL AS DOUBLE)"
    return f"""SELECT '{name}' AS "column", count(*) AS rows, count(*) FILTER (({x}) IS NULL) AS nulls, count(DISTINCT {x}) AS distinct, round(min({n}), 3) AS least, round(max({n}), 3) AS largest, round(avg({n}), 4) AS mean, round(quantile_cont({n}, 0.5), 4) AS median, round(stddev_samp({n}), 4) AS deviation,
  round(quantile_cont({n}, 0.01), 4) AS p01, round(quantile_cont({n}, 0.99), 4) AS p99, count(*) FILTER ({n} < 0) AS negatives, count(*) FILTER ({n} = 0) AS zeros, 0 AS infinities,
  (SELECT max(c) FROM (SELECT count(*) AS c FROM part WHERE ({x}) IS NOT NULL GROUP BY {x})) AS top_n, (SELECT min(v) FROM (SELECT CAST({x} AS VARCHAR) AS v, count(*) AS c FROM part WHERE ({x}) IS NOT NULL GROUP BY 1) WHERE c = (SELECT max(c) FROM (SELECT count(*) AS c FROM part WHERE ({x}) IS NOT NULL GROUP BY {x}))) AS top_value, count(DISTINCT {x}) <= 1 AS constant, {role} AS role FROM part"""


_NULLS = ("key", "year", "b", "f", "lat", "lon", "state", "region", "name", "id")
ORACLES = {
    "event_flags": f"WITH {_V} SELECT k AS id, blocking, warning, NOT blocking AS fit_spatial, NOT blocking AND state IS NOT NULL AND region IS NOT NULL AS fit_regional, NOT blocking AND coalesce(f >= b, false) AS fit_duration, {_WHY(_N)} AS reasons FROM z",
    "flag_counts": f"WITH {_V} SELECT 'rows' AS flag, count(*) AS n FROM z" + "".join(f" UNION ALL SELECT '{n}', count(*) FILTER ({a}) FROM z" for a, n in _N),
    "invalid_report": f"WITH {_V} SELECT k AS id, {_WHY(_N[:10])} AS reasons FROM z WHERE blocking",
    "detection_filter": """WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber, CASE WHEN (l_orderkey + l_linenumber) % 50 <> 0 THEN CAST(l_partkey % 95 AS DOUBLE) END AS lat, CAST(l_suppkey % 200 - 100 AS DOUBLE) AS lon, CAST(l_shipdate AS DATE) AS d, l_returnflag, round(l_extendedprice, 2) AS power FROM lineitem)
  SELECT l_orderkey, l_linenumber, lat, lon, strftime(d, '%Y-%m-%d') AS day, l_returnflag, power FROM l WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND d BETWEEN DATE '1993-01-01' AND DATE '1997-12-31' QUALIFY row_number() OVER (PARTITION BY lat, lon, d, l_returnflag ORDER BY l_orderkey, l_linenumber, power) = 1""",
    "detection_audit": "SELECT l_returnflag, count(*) AS rows, count(*) FILTER (l_partkey % 95 > 90) AS range, count(*) FILTER (year(l_shipdate) NOT BETWEEN 1993 AND 1997) AS period, count(*) - count(DISTINCT (l_partkey % 95, year(l_shipdate))) AS copies FROM lineitem GROUP BY 1",
    "reading_rules": "WITH e AS (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN value - 50 END AS rain, CASE WHEN event_id % 4 <> 0 THEN user_id % 40 END AS tmax, CASE WHEN event_id % 5 <> 0 THEN event_id % 40 END AS tmin FROM events) SELECT event_id, round(rain, 3) AS rain, tmax, tmin FROM e WHERE NOT (rain IS NULL AND tmax IS NULL AND tmin IS NULL) AND coalesce(rain >= 0, true) AND coalesce(tmax >= tmin, true)",
    "inventory_filter": "SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderstatus AS kind, o_custkey % 6 AS value FROM orders WHERE o_custkey % 9 <> 0 AND o_orderstatus <> 'P' AND year(o_orderdate) BETWEEN 1993 AND 1997 AND o_custkey % 6 > 0",
    "column_profile": " UNION ALL ".join(_profile_sql(*p) for p in _PROFILED),
    "column_selection": "SELECT c_custkey, round(c_acctbal, 2) AS c_acctbal, c_mktsegment FROM customer",
    "semantic_types": "SELECT * FROM (VALUES ('when', 'date'), ('who', 'integer'), ('much', 'number'), ('status', 'category'), ('note', 'text')) AS t(\"column\", kind)",
    "null_findings": f"WITH {_V}, n AS (SELECT *, 'x' AS name, k AS id FROM v), c AS (" + " UNION ALL ".join(f"SELECT '{dict(b='begin', f='finish').get(c, c)}' AS \"column\", count(*) - count({c}) AS missing, count(*) AS r FROM n" for c in _NULLS) + ") SELECT \"column\", missing, round(missing * 100.0 / r, 4) AS pct, CASE WHEN missing = 0 THEN 'none' WHEN \"column\" IN ('key', 'lat') AND missing / r >= 0.05 THEN 'high' WHEN \"column\" IN ('key', 'lat') OR missing / r >= 0.5 THEN 'medium' ELSE 'low' END AS severity FROM c",
    "range_checks": "SELECT 'outside' AS \"column\", count(*) FILTER (value NOT BETWEEN 10 AND 90) AS bad FROM events UNION ALL SELECT 'value', 0 UNION ALL SELECT 'v', count(*) FILTER (event_id % 8 = 0) FROM events",
    "region_catalog": "WITH c AS (SELECT lpad(CAST(c_custkey % 150 AS VARCHAR), 2, '0') AS code, c_name FROM customer WHERE c_custkey % 10 <> 0 AND c_custkey % 150 < 100) SELECT code, min(c_name) AS name, count(*) AS n_source_rows FROM c GROUP BY 1",
}


ORACLES["column_roles"] = " UNION ALL ".join(_role_sql(c, k) for c, k in (("l_orderkey", "number"), ("l_partkey", "number"), ("l_suppkey", "number"), ("l_linenumber", "number"), ("l_quantity", "number"), ("l_extendedprice", "number"), ("l_discount", "number"), ("l_tax", "number"), ("l_returnflag", "text"), ("l_linestatus", "text"), ("l_shipdate", "time")))
_ROWS = (("null region", "region IS NULL", "error"), ("before 1990", "day < DATE '1990-01-01'", "error"), ("no source", "has_event + has_detection + has_station = 0", "error"), ("no event", "has_event = 0", "warning"))
ORACLES["contract_report"] = f"""WITH {_REGION_DAY}, u AS (SELECT 'region-day: unique region+day' AS c, (SELECT count(*) FROM (SELECT 1 FROM f GROUP BY region, day HAVING count(*) > 1)) AS n, 'error' AS bad, 'keys that repeat' AS note
  UNION ALL SELECT 'state-day: unique state+day', (SELECT count(*) FROM (SELECT 1 FROM g GROUP BY state, day HAVING count(*) > 1)), 'error', 'keys that repeat'
  {" ".join(f"UNION ALL SELECT 'region-day: {n}', (SELECT count(*) FILTER ({t}) FROM f), '{s}', 'rows'" for n, t, s in _ROWS)}),
b AS (SELECT (SELECT count(*) FROM f) AS n, (SELECT count(*) FROM (SELECT DISTINCT region, day FROM f)) AS m)
SELECT c AS "check", CAST(n AS VARCHAR) AS value, CASE WHEN n = 0 THEN 'ok' ELSE bad END AS status, note FROM u UNION ALL SELECT 'region-day: rows of base', m || '/' || n, CASE WHEN n = m THEN 'ok' ELSE 'error' END, 'rows/expected' FROM b
UNION ALL SELECT 'region-day: required columns', '', 'ok', 'missing' UNION ALL SELECT 'region-day: forbidden columns', '', 'ok', 'present'"""
