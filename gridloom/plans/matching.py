"""Queries of registry matching: orders against a copy with rows left out, added and changed by key."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import matching as M
from gridloom.plans.fusion import rounded
from gridloom.plans.tables import iso, table

LEVELS = {"1-urgent": "high", "2-high": "high", "3-medium": "medium", "4-not specified": "unknown", "5-low": "low"}


def _left(spark, sf):
    o = table(spark, sf, "orders")
    return o.filter(F.col("o_orderkey") % 11 != 0).select(F.col("o_orderkey").alias("key"), iso("o_orderdate").alias("begin"), iso(F.date_add("o_orderdate", 3)).alias("finish"), F.col("o_orderstatus").alias("state"), F.col("o_orderpriority").alias("place"), (F.col("o_custkey") % 25).cast("string").alias("site"), F.col("o_totalprice").alias("area"), (F.col("o_custkey") % 90).cast("double").alias("lat"), (F.col("o_custkey") % 180).cast("double").alias("lon"))


def _right(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.filter(k % 13 != 0).select(k.alias("key"), iso(F.date_add("o_orderdate", F.when(k % 5 == 0, 1).otherwise(0))).alias("begin"), F.when(k % 7 != 0, iso(F.date_add("o_orderdate", 3))).alias("finish"), F.when(k % 3 == 0, "X").otherwise(F.col("o_orderstatus")).alias("state"), F.when(k % 4 == 0, F.lower("o_orderpriority")).otherwise(F.col("o_orderpriority")).alias("place"), F.when(k % 6 != 0, (F.col("o_custkey") % 25).cast("string")).alias("site"), (F.col("o_totalprice") + F.when(k % 2 == 0, 0.5).otherwise(0.75)).alias("area"), (F.col("o_custkey") % 90 + F.when(k % 9 == 0, 0.02).otherwise(0.0)).cast("double").alias("lat"), F.when(k % 10 != 0, (F.col("o_custkey") % 180).cast("double")).alias("lon"))


def _matched(spark, sf):
    left, right = M.one_of_each(_left(spark, sf), ["key"], "left"), M.one_of_each(_right(spark, sf), ["key"], "right")
    return M.match(left, right, "key", ["begin", "finish", "state", "place", "site"], {"area": 0.6}, ("lat", "lon"), 0.01)


def q_match(spark, sf):
    return rounded(_matched(spark, sf).select(F.coalesce("left_key", "right_key").alias("key"), "side", "score", "class", "same_area", "same_position", F.round("distance", 6).alias("distance")), distance=6)


def q_match_summary(spark, sf):
    return rounded(_matched(spark, sf).groupBy("class").agg(F.count("*").alias("n"), F.avg("score").alias("score_mean"), F.percentile("score", F.lit(0.5)).alias("score_median")))


def q_reconcile(spark, sf):
    out = M.reconcile(_matched(spark, sf), "key", ["begin", "state"], ["finish", "place"], ("lat", "lon"))
    out = out.withColumn("level", M.by_vocabulary(F.col("state"), F.col("place"), LEVELS))
    return M.final_schema(out, {"key": "bigint", "begin": "string", "finish": "string", "state": "string", "level": "string", "lat": "double", "lon": "double", "position_from": "string", "cause": "string"})


def q_uniqueness(spark, sf):
    return M.uniqueness(table(spark, sf, "orders").select(F.when(F.col("o_custkey") % 8 != 0, F.col("o_custkey")).alias("key")), "key")


def q_complete(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    states = r.select(F.col("r_regionkey").alias("state"), F.col("r_name").alias("state_name"))
    regions = n.select(F.col("n_regionkey").alias("state"), F.col("n_nationkey").alias("region"), F.col("n_name").alias("region_name"))
    c = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("c_custkey")
    df = c.select("c_custkey", F.when(k % 3 != 0, F.col("n_regionkey")).alias("state"), F.lower("r_name").alias("state_name"), F.when(k % 2 != 0, F.col("n_nationkey")).alias("region"), F.when(k % 5 != 0, F.upper("n_name")).alias("region_name"))
    full = M.complete_keys(df, states, regions)
    return M.prefer_spatial(full.withColumn("declared", F.when(k % 7 == 0, F.lit(0)).otherwise(F.col("region"))).withColumn("spatial", F.when(k % 4 != 0, F.col("region"))), "spatial", "declared").select("c_custkey", "state", "region", "key", "method", "conflict")


def q_orphans(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return M.orphans(o, table(spark, sf, "customer").filter(F.col("c_custkey") % 3 != 0).select("c_custkey"), ["c_custkey"])


def q_totals(spark, sf):
    o = table(spark, sf, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("area"), "o_orderkey")
    b = o.withColumn("area", F.col("area") + F.when((F.col("year") == 1996) & (F.col("o_orderkey") % 50 == 0), 10.0).otherwise(0.0)).filter(F.col("year") != 1992)
    return rounded(M.totals_agree(o, b, "year", "area", 0.5), first=1, second=1, difference=1)


QUERIES = {"registry_match": q_match, "match_summary": q_match_summary, "registry_reconcile": q_reconcile, "key_uniqueness": q_uniqueness, "complete_keys": q_complete, "orphan_keys": q_orphans, "totals_agree": q_totals}
_M = """l AS (SELECT o_orderkey AS key, strftime(o_orderdate, '%Y-%m-%d') AS b, strftime(o_orderdate + INTERVAL 3 DAY, '%Y-%m-%d') AS f, o_orderstatus AS s, o_orderpriority AS p, CAST(o_custkey % 25 AS VARCHAR) AS w, o_totalprice AS a, CAST(o_custkey % 90 AS DOUBLE) AS y, CAST(o_custkey % 180 AS DOUBLE) AS x FROM orders WHERE o_orderkey % 11 <> 0),
r AS (SELECT o_orderkey AS key, strftime(o_orderdate + CASE WHEN o_orderkey % 5 = 0 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END, '%Y-%m-%d') AS b, CASE WHEN o_orderkey % 7 <> 0 THEN strftime(o_orderdate + INTERVAL 3 DAY, '%Y-%m-%d') END AS f, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS s,
  CASE WHEN o_orderkey % 4 = 0 THEN lower(o_orderpriority) ELSE o_orderpriority END AS p, CASE WHEN o_orderkey % 6 <> 0 THEN CAST(o_custkey % 25 AS VARCHAR) END AS w, o_totalprice + CASE WHEN o_orderkey % 2 = 0 THEN CAST(0.5 AS DOUBLE) ELSE CAST(0.75 AS DOUBLE) END AS a, CAST(o_custkey % 90 AS DOUBLE) + CASE WHEN o_orderkey % 9 = 0 THEN CAST(0.02 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS y, CASE WHEN o_orderkey % 10 <> 0 THEN CAST(o_custkey % 180 AS DOUBLE) END AS x FROM orders WHERE o_orderkey % 13 <> 0),
m AS (SELECT coalesce(l.key, r.key) AS key, l.key AS lk, r.key AS rk, l.b AS lb, r.b AS rb, l.f AS lf, r.f AS rf, l.s AS ls, r.s AS rs, l.p AS lp, r.p AS rp, l.y AS ly, r.y AS ry, l.x AS lx, r.x AS rx, coalesce(abs(l.a - r.a) <= 0.6, false) AS same_area, sqrt((l.y - r.y) * (l.y - r.y) + (l.x - r.x) * (l.x - r.x)) AS d,
  CAST(coalesce(l.b = r.b, false) AS INTEGER) + CAST(coalesce(l.f = r.f, false) AS INTEGER) + CAST(coalesce(l.s = r.s, false) AS INTEGER) + CAST(coalesce(l.p = r.p, false) AS INTEGER) + CAST(coalesce(l.w = r.w, false) AS INTEGER) + CAST(coalesce(abs(l.a - r.a) <= 0.6, false) AS INTEGER) AS part FROM l FULL OUTER JOIN r ON l.key = r.key),
s AS (SELECT *, coalesce(d <= 0.01, false) AS same_position, part + CAST(coalesce(d <= 0.01, false) AS INTEGER) AS score, CASE WHEN rk IS NULL THEN 'left_only' WHEN lk IS NULL THEN 'right_only' ELSE 'both' END AS side FROM m),
c AS (SELECT *, CASE WHEN side <> 'both' THEN side WHEN score >= 5 THEN 'match_high' WHEN score >= 3 THEN 'match_medium' WHEN score >= 1 THEN 'match_weak' ELSE 'match_conflict' END AS class FROM s)"""
ORACLES = {
    "registry_match": f"WITH {_M} SELECT key, side, score, class, same_area, same_position, round(d, 6) AS distance FROM c",
    "match_summary": f"WITH {_M} SELECT class, count(*) AS n, round(avg(score), 6) AS score_mean, round(quantile_cont(score, 0.5), 3) AS score_median FROM c GROUP BY 1",
    "registry_reconcile": f"""WITH {_M}, z AS (SELECT *, coalesce(lb, rb) AS begin, coalesce(rf, lf) AS finish, coalesce(ls, rs) AS state, coalesce(rp, lp) AS place, ly IS NOT NULL AND lx IS NOT NULL AND ly <> 0 AS lok, ry IS NOT NULL AND rx IS NOT NULL AND ry <> 0 AS rok FROM c)
  SELECT key, begin, finish, state, CASE lower(place) WHEN '1-urgent' THEN 'high' WHEN '2-high' THEN 'high' WHEN '3-medium' THEN 'medium' WHEN '4-not specified' THEN 'unknown' WHEN '5-low' THEN 'low' END AS level,
  CASE WHEN lok THEN ly WHEN rok THEN ry END AS lat, CASE WHEN lok THEN lx WHEN rok THEN rx END AS lon, CASE WHEN lok THEN 'left' WHEN rok THEN 'right' END AS position_from, CAST(NULL AS VARCHAR) AS cause FROM z""",
    "key_uniqueness": "WITH k AS (SELECT CASE WHEN o_custkey % 8 <> 0 THEN o_custkey END AS key FROM orders) SELECT count(*) AS rows, count(key) AS filled, count(DISTINCT key) AS distinct, count(key) - count(DISTINCT key) AS surplus FROM k",
    "complete_keys": """WITH d AS (SELECT c_custkey AS k, n_regionkey AS state, CASE WHEN c_custkey % 2 <> 0 OR c_custkey % 5 <> 0 THEN n_nationkey END AS region FROM customer JOIN nation ON n_nationkey = c_nationkey), e AS (SELECT *, CASE WHEN k % 7 = 0 THEN 0 ELSE region END AS de, CASE WHEN k % 4 <> 0 THEN region END AS sp FROM d)
  SELECT k AS c_custkey, state, region, coalesce(sp, de) AS key, CASE WHEN sp IS NOT NULL THEN 'spatial' WHEN de IS NOT NULL THEN 'declared' ELSE 'none' END AS method, coalesce(sp <> de, false) AS conflict FROM e""",
    "orphan_keys": "SELECT DISTINCT o_custkey AS c_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)",
    "totals_agree": """WITH a AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, sum(o_totalprice) AS f FROM orders GROUP BY 1), b AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, sum(o_totalprice + CASE WHEN year(o_orderdate) = 1996 AND o_orderkey % 50 = 0 THEN 10 ELSE 0 END) AS s FROM orders WHERE year(o_orderdate) <> 1992 GROUP BY 1)
  SELECT year, round(f, 1) AS first, round(s, 1) AS second, round(abs(coalesce(f, 0) - coalesce(s, 0)), 1) AS difference, abs(coalesce(f, 0) - coalesce(s, 0)) <= 0.5 AS agrees FROM a FULL OUTER JOIN b USING (year)""",
}
