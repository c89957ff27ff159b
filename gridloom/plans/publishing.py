"""Queries of catalogs, publication tables and the service's reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import publish as P
from gridloom.operators.fusion import cubes
from gridloom.operators.ranking import running_id
from gridloom.plans.fusion import fused, rounded
from gridloom.plans.tables import iso, table


def _profile(spark, sf):
    i = table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 7).cast("int").alias("cluster"))
    return i.agg(F.count("*").alias("n"), F.avg((F.col("l_returnflag") == "R").cast("double")).alias("detection_rate"), F.avg((F.col("l_linestatus") == "F").cast("double")).alias("event_rate"), F.avg((F.col("l_quantity") > 25).cast("double")).alias("station_rate"))


def _catalog(spark, sf):
    return P.cluster_catalog(_profile(spark, sf), "detection_rate", "event_rate", "station_rate")


def q_catalog(spark, sf):
    return _catalog(spark, sf).select("cluster", "detection_level", "event_level", "station_level", "name", "colour", "order", "usage", "description")


def _app(spark, sf):
    base = fused(spark, sf).select("region", "day", "event_count", "detection_count", "station_n")
    clusters = base.select("region", "day", F.pmod(F.col("region") + F.dayofyear("day"), F.lit(7)).cast("int").alias("cluster"))
    return P.publication(base, clusters, _catalog(spark, sf).select("cluster", "name", "order"), ["region", "day"], "cluster")


def q_app(spark, sf):
    """The publication table with a dense id in the order of day and region."""
    out = running_id(_app(spark, sf), ["day", "region"], "id")
    return out.select("id", "region", iso("day").alias("day"), "cluster", "name", "order", "event_count", "detection_count", "station_n")


def q_alignment(spark, sf):
    b = fused(spark, sf).select("region", "day")
    return P.alignment(b.filter(F.col("region") % 5 != 0), b.filter(F.month("day") != 1), ["region", "day"])


def q_summaries(spark, sf):
    """Six summaries of the publication table in one pass."""
    a = _app(spark, sf).withColumns({"year": F.year("day"), "month": F.month("day"), "state": (F.col("region") / 5).cast("int")})
    grains = {"cluster": ["cluster"], "year_month": ["year", "month"], "state": ["state"], "region": ["region"], "state_cluster": ["state", "cluster"], "region_cluster": ["region", "cluster"]}
    return cubes(a, grains, [F.count("*").alias("n"), F.sum("event_count").alias("events"), F.sum("detection_count").alias("detections")])


def q_search(spark, sf):
    o = table(spark, sf, "orders")
    return rounded(P.search(o, {"o_orderstatus": "F", "o_custkey": None}, {"o_orderpriority": "HIGH|urgent"}, {"o_totalprice": (50000.0, 200000.0)}, ("o_orderdate", "1994-01-01", "1995-06-30"), [F.desc("o_orderdate"), "o_orderkey"]).select("o_orderkey", iso("o_orderdate").alias("day"), "o_totalprice"), o_totalprice=2)


def q_map(spark, sf):
    """The map's features: condition, projection and the service's limit of 5000, largest amounts first."""
    o = P.search(table(spark, sf, "orders"), {"o_orderstatus": "O"}).select("o_orderkey", F.round("o_totalprice", 2).alias("amount"), (F.col("o_custkey") % 180).alias("lon"), (F.col("o_custkey") % 90).alias("lat"))
    return P.features(o, "lon", "lat", ["o_orderkey"], [F.desc("amount"), "o_orderkey"])


def q_collection(spark, sf):
    c = table(spark, sf, "supplier").select("s_suppkey", (F.col("s_suppkey") % 180).alias("lon"), (F.col("s_suppkey") % 90).alias("lat"))
    """All suppliers as documents of 40 features, read back: place in the page, key and coordinates."""
    doc = P.feature_pages(c, "lon", "lat", ["s_suppkey"], ["s_suppkey"], 40)
    parsed = F.from_json("document", "type string, features array<struct<type:string,geometry:struct<type:string,coordinates:array<double>>,properties:struct<s_suppkey:bigint>>>")
    rows = doc.select("page", "n", parsed.alias("d")).select("page", "n", "d.type", F.posexplode("d.features").alias("place", "f"))
    return rows.select("page", "n", "type", "place", F.col("f.geometry.type").alias("shape"), F.col("f.properties.s_suppkey").alias("s_suppkey"), F.col("f.geometry.coordinates")[0].alias("lon"), F.col("f.geometry.coordinates")[1].alias("lat"))


def q_periods(spark, sf):
    """Rows and amounts of four kinds of period, in the whole country, one state and one region."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("region")), "o_custkey").select(F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("amount"), "region", (F.col("region") / 5).cast("int").alias("state"))
    y, m, d = F.year("day"), F.month("day"), F.col("day")
    kinds = {"year": (1994,), "month": (1994, 5), "years": (1993, 1995), "dates": ("1994-02-01", "1994-08-15")}
    out = None
    for level, value in (("country", None), ("state", 2), ("region", 7)):
        t = P.territory(o, level, "state", "region", value)
        one = t.agg(*(F.struct(F.lit(level).alias("level"), F.lit(k).alias("period"), F.count_if(P.in_period(y, m, d, k, v)).alias("n"), F.round(F.sum(F.when(P.in_period(y, m, d, k, v), F.col("amount"))), 2).alias("amount")).alias(k) for k, v in kinds.items()))
        one = one.select(F.explode(F.array(*kinds)).alias("s")).select("s.*")
        out = one if out is None else out.union(one)
    return out


def q_manifest(spark, sf):
    return P.manifest({n: table(spark, sf, n) for n in ("orders", "customer", "events", "documents")})


QUERIES = {"cluster_catalog": q_catalog, "publication_table": q_app, "key_alignment": q_alignment, "publication_summaries": q_summaries, "service_search": q_search, "service_map": q_map, "feature_collection": q_collection, "period_totals": q_periods, "manifest": q_manifest}
_C = """p AS (SELECT CAST(l_suppkey % 7 AS INTEGER) AS cluster, avg(CAST(l_returnflag = 'R' AS INTEGER)) AS d, avg(CAST(l_linestatus = 'F' AS INTEGER)) AS e, avg(CAST(l_quantity > 25 AS INTEGER)) AS s FROM lineitem GROUP BY 1),
c AS (SELECT *, CASE WHEN d >= (SELECT quantile_cont(d, 0.66) FROM p) THEN 'high' WHEN d >= (SELECT quantile_cont(d, 0.33) FROM p) THEN 'medium' ELSE 'low' END AS dl, CASE WHEN e >= (SELECT quantile_cont(e, 0.66) FROM p) THEN 'high' WHEN e >= (SELECT quantile_cont(e, 0.33) FROM p) THEN 'medium' ELSE 'low' END AS el,
  CASE WHEN s >= (SELECT quantile_cont(s, 0.66) FROM p) THEN 'high' WHEN s >= (SELECT quantile_cont(s, 0.33) FROM p) THEN 'medium' ELSE 'low' END AS sl FROM p),
z(dl, el, colour, "order", usage, style, observed) AS (VALUES ('high', 'high', '#B91C1C', 1, 'first in maps, filters and details', 'much activity, confirmed by events', CAST(NULL AS VARCHAR)),
  ('high', 'medium', '#EA580C', 2, 'first in maps, filters and details', 'much activity, few events', CAST(NULL AS VARCHAR)),
  ('high', 'low', '#EA580C', 2, 'first in maps, filters and details', 'much activity, few events', CAST(NULL AS VARCHAR)),
  ('medium', 'high', '#D97706', 3, 'first in maps, filters and details', 'some activity, many events', CAST(NULL AS VARCHAR)),
  ('medium', 'medium', '#D97706', 3, 'comparison over space and time', 'some activity', CAST(NULL AS VARCHAR)),
  ('medium', 'low', '#D97706', 3, 'comparison over space and time', 'some activity', CAST(NULL AS VARCHAR)),
  ('low', 'high', '#2563EB', 4, 'first in maps, filters and details', 'little activity', 'little activity, well observed'),
  ('low', 'medium', '#2563EB', 4, 'background', 'little activity', 'little activity, well observed'),
  ('low', 'low', '#2563EB', 4, 'background', 'little activity', 'little activity, well observed')),
k AS (SELECT c.*, z.colour, z."order", z.usage, coalesce(CASE WHEN sl = 'high' THEN z.observed END, z.style) AS name FROM c JOIN z USING (dl, el))"""
_F = """ev AS (SELECT c_nationkey AS region, CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), de AS (SELECT s_nationkey AS region, CAST(l_shipdate AS DATE) AS day, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
st AS (SELECT CAST(user_id % 25 AS INTEGER) AS region, CAST(ts AS DATE) AS day, count(DISTINCT user_id) AS n FROM events GROUP BY 1, 2), u AS (SELECT region, day FROM ev UNION SELECT region, day FROM de UNION SELECT region, day FROM st),
f AS (SELECT u.region, u.day, CASE WHEN u.day BETWEEN DATE '1995-01-01' AND DATE '1998-12-31' THEN coalesce(ev.n, 0) ELSE ev.n END AS event_count, coalesce(de.n, 0) AS detection_count, st.n AS station_n, CAST((u.region + dayofyear(u.day)) % 7 AS INTEGER) AS cluster FROM u LEFT JOIN ev USING (region, day) LEFT JOIN de USING (region, day) LEFT JOIN st USING (region, day))"""
_PERIOD = {"year": "year(o_orderdate) = 1994", "month": "year(o_orderdate) = 1994 AND month(o_orderdate) = 5", "years": "year(o_orderdate) BETWEEN 1993 AND 1995", "dates": "CAST(o_orderdate AS DATE) BETWEEN DATE '1994-02-01' AND DATE '1994-08-15'"}
_LEVEL = {"country": "true", "state": "CAST(floor(c_nationkey / 5) AS INTEGER) = 2", "region": "c_nationkey = 7"}
ORACLES = {
    "cluster_catalog": f"""WITH {_C} SELECT cluster, dl AS detection_level, el AS event_level, sl AS station_level, name, colour, "order", usage, printf('%.1f %% of days with detections, %.1f %% with events', d * 100, e * 100) AS description FROM k""",
    "publication_table": f"""WITH {_C}, {_F} SELECT row_number() OVER (ORDER BY day, region) AS id, region, strftime(day, '%Y-%m-%d') AS day, f.cluster, name, "order", event_count, detection_count, station_n FROM f LEFT JOIN k ON k.cluster = f.cluster""",
    "key_alignment": f"WITH {_F} SELECT count(*) FILTER (region % 5 <> 0 AND month(day) <> 1) AS matched, count(*) FILTER (region % 5 <> 0 AND month(day) = 1) AS first_only, count(*) FILTER (region % 5 = 0 AND month(day) <> 1) AS second_only FROM f",
    "publication_summaries": f"""WITH {_F}, a AS (SELECT *, CAST(year(day) AS INTEGER) AS year, CAST(month(day) AS INTEGER) AS month, CAST(floor(region / 5) AS INTEGER) AS state FROM f), g AS (SELECT cluster, year, month, state, region, count(*) AS n, sum(event_count) AS e, sum(detection_count) AS d, grouping_id(cluster, year, month, state, region) AS i FROM a GROUP BY GROUPING SETS ((cluster), (year, month), (state), (region), (state, cluster), (region, cluster)))
  SELECT CASE i WHEN 15 THEN 'cluster' WHEN 19 THEN 'year_month' WHEN 29 THEN 'state' WHEN 30 THEN 'region' WHEN 13 THEN 'state_cluster' ELSE 'region_cluster' END AS grain, cluster, year, month, state, region, n, CAST(e AS BIGINT) AS events, CAST(d AS BIGINT) AS detections FROM g""",
    "service_search": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, round(o_totalprice, 2) AS o_totalprice FROM orders WHERE o_orderstatus = 'F' AND regexp_matches(o_orderpriority, '(?i)HIGH|urgent') AND o_totalprice BETWEEN 50000 AND 200000 AND CAST(o_orderdate AS DATE) BETWEEN DATE '1994-01-01' AND DATE '1995-06-30'",
    "service_map": """SELECT '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || o_custkey % 180 || ',' || o_custkey % 90 || ']},"properties":{"o_orderkey":' || o_orderkey || '}}' AS feature FROM orders WHERE o_orderstatus = 'O' ORDER BY round(o_totalprice, 2) DESC, o_orderkey LIMIT 5000""",
    "feature_collection": "WITH r AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS k FROM supplier) SELECT k // 40 AS page, CAST(count(*) OVER (PARTITION BY k // 40) AS INTEGER) AS n, 'FeatureCollection' AS type, CAST(k % 40 AS INTEGER) AS place, 'Point' AS shape, s_suppkey, CAST(s_suppkey % 180 AS DOUBLE) AS lon, CAST(s_suppkey % 90 AS DOUBLE) AS lat FROM r",
    "period_totals": " UNION ALL ".join(f"SELECT '{lv}' AS level, '{k}' AS period, count(*) AS n, round(sum(o_totalprice), 2) AS amount FROM orders JOIN customer ON o_custkey = c_custkey WHERE {c} AND {l}" for lv, l in _LEVEL.items() for k, c in _PERIOD.items()),
    "manifest": "SELECT 'orders' AS name, count(*) AS rows, 6 AS columns FROM orders UNION ALL SELECT 'customer', count(*), 5 FROM customer UNION ALL SELECT 'events', count(*), 6 FROM events UNION ALL SELECT 'documents', count(*), 5 FROM documents",
}
