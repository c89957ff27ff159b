"""Queries of text, code, number, date and coordinate cleaning, on strings built from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import dates as D
from gridloom.functions import geo as G
from gridloom.functions import text as T
from gridloom.plans.tables import iso, table


def _orders(spark, sf):
    return table(spark, sf, "orders")


def q_codes(spark, sf):
    raw = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.col("o_custkey"), F.lit(".0"))).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit(" A-"), F.col("o_custkey"), F.lit("-7 "))).when(F.col("o_orderkey") % 4 == 2, F.lit("none")).otherwise(F.col("o_custkey").cast("string"))
    return _orders(spark, sf).withColumn("raw", raw).select("o_orderkey", T.pad_code(F.col("raw"), 3).alias("padded"), T.last_digits(F.col("raw"), 3).alias("last"), T.identifier(F.col("raw")).alias("identifier"), T.compact_key(F.col("raw")).alias("compact"), T.station_id(F.concat(F.lit("/data/x9/dia"), F.col("o_custkey"), F.lit(".txt"))).alias("station"))


def q_numbers(spark, sf):
    p = F.col("o_totalprice").cast("decimal(15,2)").cast("string")
    raw = F.when(F.col("o_orderkey") % 5 == 0, F.regexp_replace(p, r"\.", ",")).when(F.col("o_orderkey") % 5 == 1, F.concat(p, F.lit(" ha"))).when(F.col("o_orderkey") % 5 == 2, F.lit("-9999")).when(F.col("o_orderkey") % 5 == 3, F.lit("Nulo")).otherwise(p)
    out = _orders(spark, sf).withColumn("raw", raw)
    return out.select("o_orderkey", T.clean_number(F.col("raw")).alias("cleaned"), T.number_or_null(F.col("raw")).alias("number"), T.token_class(F.col("raw")).alias("kind"), T.missing_to_null(F.when(F.col("o_orderkey") % 5 == 2, F.lit(" S/D ")).otherwise(F.col("o_orderstatus"))).alias("status"), T.rounded_int((F.col("o_orderkey") / 2).cast("string")).alias("half_even"), T.thousands(F.concat(F.lit("1,"), F.lpad((F.col("o_custkey") % 1000).cast("string"), 3, "0"))).alias("thousands"))


def q_text(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("t"))
    return d.select("doc_id", T.strip_accents(F.col("t")).alias("plain"), T.text_key(F.col("t"), {"the": "article"}).alias("key"), T.printable(F.col("t")).alias("printable"))


def q_titles(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("  "), F.upper("c_mktsegment"), F.lit("  DE  "), F.lower("c_mktsegment")).alias("t"))
    return c.select("c_custkey", T.title(F.col("t")).alias("title"))


def q_aliases(spark, sf):
    """Display names by a dimension keyed on two columns, and codes and names completed both ways."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("state"))
    aliases = n.filter(F.col("code").cast("int") % 3 == 0).select("state", "name", F.lower("name").alias("display"))
    c = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey").cast("string")).alias("code"), F.col("c_nationkey").cast("string").alias("real"))
    c = c.join(n.select(F.col("code").alias("real"), F.upper("name").alias("full")), "real").select("c_custkey", "code", F.when(F.col("c_custkey") % 2 == 1, F.col("full")).alias("name"))
    full = T.complete_pair(c.select("c_custkey", "code", "name"), n, "code", "name").join(n.select("code", "state"), "code", "left")
    return T.with_alias(full, aliases, ["state", "name"], "name", "display")


def q_mojibake(spark, sf):
    """Text broken once and twice by a wrong charset, repaired."""
    wrong = lambda c: F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")
    d = table(spark, sf, "documents").select("doc_id", F.regexp_replace("text", "[^\\x{20}-\\x{ff}]", " ").alias("t"))
    shown = F.translate(wrong(F.col("t")), "".join(map(chr, T.WINDOWS_1252)), "".join(T.WINDOWS_1252.values()))
    d = d.withColumns({"once": wrong(F.col("t")), "twice": wrong(wrong(F.col("t"))), "shown": shown})
    return d.select("doc_id", T.repair_mojibake(F.col("shown")).alias("from_windows"), T.repair_mojibake(F.col("once")).alias("from_once"), T.repair_mojibake(F.col("twice")).alias("from_twice"), T.has_mojibake(F.col("once")).alias("broken"), T.has_mojibake(T.repair_mojibake(F.col("once"))).alias("left_over"))


def q_samples(spark, sf):
    return T.samples(table(spark, sf, "part"), ["p_brand"], "p_type", 3, 60)


def q_types(spark, sf):
    """Columns found by synonyms and cast by their names."""
    p = table(spark, sf, "part").select(F.concat(F.col("p_partkey"), F.lit(".0")).alias("Part ID"), F.col("p_size").cast("string").alias("Año (size)"), F.concat(F.lit("1,"), F.lpad(F.col("p_size").cast("string"), 3, "0")).alias("Área Total"), F.col("p_brand").alias("Marca"), F.lit("x").alias("Marca "))
    p = T.with_normal_names(p)
    p = T.cast_by_name(p, [(r"(^|_)id$", "id"), (r"size", "integer"), (r"area", "number")])
    size = T.find_column(p.columns, ["tamano", "size"], required=True, partial=True)
    return p.select("part_id", F.col(size).alias("size"), "area_total", "marca", "marca_2")


def q_dates(spark, sf):
    d, k = F.to_date("o_orderdate"), F.col("o_orderkey") % 6
    raw = F.when(k == 0, F.date_format(d, "dd/MM/yyyy")).when(k == 1, F.date_format(d, "yyyy-MM-dd 10:11:12")).when(k == 2, F.datediff(d, F.lit("1899-12-30").cast("date")).cast("string")).when(k == 3, F.date_format(d, "d-M-yyyy")).when(k == 4, F.lit("31/02/2001")).otherwise(F.date_format(d, "yyyyMMdd"))
    o = _orders(spark, sf).withColumn("raw", raw)
    return o.select("o_orderkey", iso(D.registry_date(F.col("raw"))).alias("registry"), iso(D.file_date(F.col("raw"))).alias("file"))


def q_times(spark, sf):
    k = F.col("o_orderkey")
    raw = F.when(k % 3 == 0, (k % 2500).cast("string")).when(k % 3 == 1, F.concat((k % 26).cast("string"), F.lit(":"), F.lpad((k % 61).cast("string"), 2, "0"))).otherwise(F.lit("x"))
    span = F.when(k % 3 == 0, F.concat((k % 90).cast("string"), F.when(k % 2 == 0, ";").otherwise(":"), F.lpad((k % 70).cast("string"), 2, "0"))).when(k % 3 == 1, F.concat((k % 5).cast("string"), F.lit(" days, 0"), (k % 10).cast("string"), F.when(k % 4 == 0, ":05:09.500").otherwise(":05:09"))).otherwise(F.lit("soon"))
    o = _orders(spark, sf).select("o_orderkey", F.to_date("o_orderdate").alias("d"), raw.alias("raw"), span.alias("span"))
    t = D.clock(F.col("raw"))
    return o.select("o_orderkey", t.alias("clock"), F.date_format(D.timestamp_of(F.col("d"), t), "yyyy-MM-dd HH:mm").alias("moment"), D.duration(F.col("span")).alias("duration"), D.is_duration(D.duration(F.col("span"))).alias("valid"))


def q_period(spark, sf):
    o = _orders(spark, sf).select(F.to_date("o_orderdate").alias("day"), (F.year("o_orderdate") + F.when(F.col("o_orderkey") % 7 == 0, 1).otherwise(0)).alias("year"))
    inside = o.agg(F.count_if(D.within(F.col("day"), "1995-01-01", "1996-12-31")).alias("inside"), F.count_if(~D.within(F.col("day"), "1995-01-01", "1996-12-31")).alias("outside"))
    return inside.unpivot([], ["inside", "outside"], "test", "n").union(D.year_mismatches(o, "year", "day").unpivot([], ["compared", "different"], "test", "n"))


def q_coverage(spark, sf):
    o = _orders(spark, sf).select(F.col("o_orderstatus").alias("fecha_nota"), F.year("o_orderdate").alias("anio"))
    p = _orders(spark, sf).select(F.date_format("o_orderdate", "dd/MM/yyyy").alias("fecha"), F.col("o_orderpriority").alias("note"), F.col("o_orderstatus").alias("x"))
    found = D.date_column(p, ["fecha", "note", "x"]).select(F.col("column").alias("source"), F.lit("detected").alias("first"), F.lit(None).cast("string").alias("last"), F.col("parsed").alias("n"))
    return D.coverage(o, ["fecha"], ["anio"]).union(D.coverage(p, ["fecha"], ["anio"])).union(found)


def q_cycles(spark, sf):
    n = F.concat(F.lit("inv_"), F.year("o_orderdate"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("-"), F.year("o_orderdate") + 5)).otherwise(F.lit("")), F.lit(".csv"))
    n = F.when(F.col("o_orderkey") % 9 == 0, F.lit("inventory.csv")).otherwise(n)
    return _orders(spark, sf).groupBy(D.cycle_of(n, "whole").alias("cycle")).agg(F.count("*").alias("n"))


def q_coordinates(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 34).cast("double").alias("deg"), (F.col("c_custkey") % 60).cast("double").alias("min"), (F.col("c_custkey") % 7).cast("double").alias("sec"))
    c = c.withColumns({"lat": G.dms(F.col("deg"), F.col("min"), F.col("sec")), "lon": G.dms(F.col("deg") + 84, F.col("min"), F.col("sec"), west=True)})
    c = G.zero_to_null(c, "lat", "lon")
    box = (14.0, 33.0, -119.0, -86.0)
    swapped = G.fix_swapped(c.withColumns({"a": F.col("lon"), "b": F.col("lat")}), "a", "b", box)
    pair = G.best_pair(c, [("deg", "sec"), ("lat", "lon")], box)
    return swapped.select("c_custkey", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), G.in_box(F.col("lat"), F.col("lon"), box).alias("inside"), F.round("a", 6).alias("fixed_lat"), F.round(G.distance(F.col("lat"), F.col("lon"), F.lit(23.0), F.lit(-102.0)), 6).alias("away"), G.same_within(F.col("lat"), F.col("deg"), 0.5).alias("near"), G.same(F.col("lat"), F.col("deg")).alias("same"), G.percentage(F.col("sec"), F.nullif(F.col("min"), F.lit(0.0))).alias("share"), F.lit(pair[0]).alias("pair"))


QUERIES = {
    "clean_codes": q_codes,
    "clean_numbers": q_numbers,
    "clean_text": q_text,
    "clean_titles": q_titles,
    "clean_aliases": q_aliases,
    "clean_mojibake": q_mojibake,
    "clean_samples": q_samples,
    "clean_types": q_types,
    "clean_dates": q_dates,
    "clean_times": q_times,
    "clean_period": q_period,
    "clean_coverage": q_coverage,
    "clean_cycles": q_cycles,
    "clean_coordinates": q_coordinates,
}
_SPAN = "CASE WHEN k % 3 = 0 THEN (k % 90) || ':' || lpad(CAST(k % 70 AS VARCHAR), 2, '0') WHEN k % 3 = 1 THEN (k % 5) || ' days, 0' || (k % 10) || ':05:09' ELSE 'soon' END"
ORACLES = {
    "clean_codes": """WITH r AS (SELECT o_orderkey, o_custkey, CASE o_orderkey % 4 WHEN 0 THEN o_custkey || '.0' WHEN 1 THEN ' A-' || o_custkey || '-7 ' WHEN 2 THEN 'none' ELSE CAST(o_custkey AS VARCHAR) END AS raw FROM orders),
  c AS (SELECT *, regexp_replace(trim(raw), '\\.0$', '') AS s FROM r), e AS (SELECT *, nullif(regexp_extract(s, '\\d+'), '') AS d, nullif(regexp_replace(s, '\\D', '', 'g'), '') AS a FROM c)
  SELECT o_orderkey, CASE WHEN length(d) >= 3 THEN d ELSE lpad(d, 3, '0') END AS padded, lpad(right(a, 3), 3, '0') AS last, nullif(regexp_replace(s, '\\s+', '', 'g'), '') AS identifier, nullif(upper(regexp_replace(raw, '\\s+', '', 'g')), '') AS compact,
  CASE WHEN length(CAST(o_custkey AS VARCHAR)) >= 5 THEN CAST(o_custkey AS VARCHAR) ELSE lpad(CAST(o_custkey AS VARCHAR), 5, '0') END AS station FROM e""",
    "clean_numbers": """WITH r AS (SELECT o_orderkey, o_custkey, o_orderstatus, CAST(CAST(o_totalprice AS DECIMAL(15, 2)) AS VARCHAR) AS p FROM orders),
  q AS (SELECT *, CASE o_orderkey % 5 WHEN 0 THEN replace(p, '.', ',') WHEN 1 THEN p || ' ha' WHEN 2 THEN '-9999' WHEN 3 THEN 'Nulo' ELSE p END AS raw FROM r)
  SELECT o_orderkey, try_cast(regexp_replace(replace(raw, ',', '.'), '[^0-9.-]', '', 'g') AS DOUBLE) AS cleaned, CASE WHEN o_orderkey % 5 IN (0, 4) THEN CAST(p AS DOUBLE) END AS number,
  CASE o_orderkey % 5 WHEN 2 THEN 'numeric_sentinel' WHEN 3 THEN 'text_sentinel' WHEN 1 THEN 'other' ELSE 'numeric' END AS kind, CASE WHEN o_orderkey % 5 <> 2 THEN o_orderstatus END AS status,
  CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey // 2 WHEN (o_orderkey // 2) % 2 = 0 THEN o_orderkey // 2 ELSE o_orderkey // 2 + 1 END AS half_even, CAST(1000 + o_custkey % 1000 AS DOUBLE) AS thousands FROM q""",
    "clean_text": """WITH d AS (SELECT doc_id, text AS t FROM documents), k AS (SELECT *, nullif(trim(regexp_replace(regexp_replace(strip_accents(lower(t)), '[^0-9a-z ]', ' ', 'g'), ' +', ' ', 'g')), '') AS key FROM d)
  SELECT doc_id, strip_accents(t) AS plain, CASE WHEN key = 'the' THEN 'article' ELSE key END AS key, nullif(trim(regexp_replace(regexp_replace(t, '[[:cntrl:]]', ' ', 'g'), ' +', ' ', 'g')), '') AS printable FROM k""",
    "clean_titles": "SELECT c_custkey, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) || ' De ' || upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS title FROM customer",
    "clean_aliases": "SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS code, n_regionkey AS state, CASE WHEN c_nationkey % 3 = 0 THEN lower(n_name) ELSE n_name END AS name FROM customer JOIN nation ON n_nationkey = c_nationkey",
    "clean_mojibake": "WITH d AS (SELECT doc_id, regexp_replace(text, '[^\\x{20}-\\x{ff}]', ' ', 'g') AS t FROM documents) SELECT doc_id, t AS from_windows, t AS from_once, t AS from_twice, regexp_matches(t, '[\\x{80}-\\x{ff}]') AS broken, regexp_matches(t, '[ÃÂ]') AS left_over FROM d",
    "clean_samples": "WITH d AS (SELECT DISTINCT p_brand, p_type FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_type) AS r FROM d) SELECT p_brand, left(string_agg(p_type, ' | ' ORDER BY p_type), 60) AS samples FROM r WHERE r <= 3 GROUP BY 1",
    "clean_types": "SELECT CAST(p_partkey AS VARCHAR) AS part_id, CAST(p_size AS BIGINT) AS size, CAST(1000 + p_size AS DOUBLE) AS area_total, p_brand AS marca, 'x' AS marca_2 FROM part",
    "clean_dates": """WITH r AS (SELECT o_orderkey, o_orderkey % 6 AS k, CAST(o_orderdate AS DATE) AS d FROM orders) SELECT o_orderkey, CASE WHEN k <> 4 THEN strftime(d, '%Y-%m-%d') END AS registry, CASE WHEN k IN (0, 3, 5) THEN strftime(d, '%Y-%m-%d') END AS file FROM r""",
    "clean_times": f"""WITH r AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders), s AS (SELECT k, d, CASE WHEN k % 3 = 0 THEN (k % 2500) // 100 WHEN k % 3 = 1 THEN k % 26 END AS h, CASE WHEN k % 3 = 0 THEN (k % 2500) % 100 WHEN k % 3 = 1 THEN k % 61 END AS m FROM r),
  t AS (SELECT *, CASE WHEN h <= 23 AND m <= 59 THEN lpad(CAST(h AS VARCHAR), 2, '0') || ':' || lpad(CAST(m AS VARCHAR), 2, '0') END AS clock, CASE WHEN k % 3 = 0 AND k % 70 <= 59 THEN lpad(CAST(k % 90 AS VARCHAR), 2, '0') || ':' || lpad(CAST(k % 70 AS VARCHAR), 2, '0') || ':00'
  WHEN k % 3 = 1 THEN CASE WHEN (k % 5) * 24 + k % 10 >= 100 THEN CAST((k % 5) * 24 + k % 10 AS VARCHAR) ELSE lpad(CAST((k % 5) * 24 + k % 10 AS VARCHAR), 2, '0') END || ':05:09' END AS duration FROM s)
  SELECT k AS o_orderkey, clock, strftime(d, '%Y-%m-%d') || ' ' || clock AS moment, duration, duration IS NOT NULL AS valid FROM t""",
    "clean_period": "SELECT 'inside' AS test, count(*) FILTER (CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1996-12-31') AS n FROM orders UNION ALL SELECT 'outside', count(*) FILTER (CAST(o_orderdate AS DATE) NOT BETWEEN DATE '1995-01-01' AND DATE '1996-12-31') FROM orders UNION ALL SELECT 'compared', count(*) FROM orders UNION ALL SELECT 'different', count(*) FILTER (o_orderkey % 7 = 0) FROM orders",
    "clean_coverage": "SELECT 'anio' AS source, CAST(min(year(o_orderdate)) AS VARCHAR) AS first, CAST(max(year(o_orderdate)) AS VARCHAR) AS last, count(*) AS n FROM orders UNION ALL SELECT 'fecha', strftime(min(o_orderdate), '%Y-%m-%d'), strftime(max(o_orderdate), '%Y-%m-%d'), count(*) FROM orders UNION ALL SELECT 'fecha', 'detected', NULL, count(*) FROM orders",
    "clean_cycles": "SELECT CASE WHEN o_orderkey % 9 = 0 THEN 'whole' WHEN o_orderkey % 2 = 0 THEN year(o_orderdate) || '_' || (year(o_orderdate) + 5) ELSE CAST(year(o_orderdate) AS VARCHAR) END AS cycle, count(*) AS n FROM orders GROUP BY 1",
    "clean_coordinates": """WITH c AS (SELECT c_custkey, CAST(c_custkey % 34 AS DOUBLE) AS deg, CAST(c_custkey % 60 AS DOUBLE) AS mi, CAST(c_custkey % 7 AS DOUBLE) AS sec FROM customer), d AS (SELECT *, deg + mi / 60 + sec / 3600 AS la, -(deg + 84 + mi / 60 + sec / 3600) AS lo FROM c),
  e AS (SELECT *, CASE WHEN la <> 0 THEN la END AS lat, CASE WHEN la <> 0 THEN lo END AS lon FROM d)
  SELECT c_custkey, round(lat, 6) AS lat, round(lon, 6) AS lon, coalesce(lat BETWEEN 14 AND 33 AND lon BETWEEN -119 AND -86, false) AS inside, round(lat, 6) AS fixed_lat, round(sqrt((lat - 23) * (lat - 23) + (lon + 102) * (lon + 102)), 6) AS away, coalesce(abs(lat - deg) <= 0.5, false) AS near, coalesce(lat = deg, false) AS same, round(sec * 100.0 / nullif(mi, 0), 4) AS share, 'lat' AS pair FROM e""",
}
