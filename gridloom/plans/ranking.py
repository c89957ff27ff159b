"""Queries of de-duplication, ranking, windows, set operations and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import ranking as R
from gridloom.plans.fusion import rounded
from gridloom.plans.tables import iso, table


def _e(spark, sf):
    return table(spark, sf, "events").select("event_id", "event_type", "user_id", "value", F.to_date("ts").alias("day"))


def q_first(spark, sf):
    return rounded(R.keep_first(_e(spark, sf), ["user_id", "event_type", "day"], ["value", "event_id"]))


def q_repeated(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 10 != 0, F.md5("text")).alias("digest"))
    return R.flag_repeated(d, ["digest"])


def q_mode(spark, sf):
    return R.most_frequent(table(spark, sf, "part"), "p_brand", ["p_type", "p_size"])


def q_medians(spark, sf):
    e = _e(spark, sf).select("event_id", "event_type", F.month("day").alias("month"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"), F.when((F.col("event_id") % 2 == 0) & (F.col("event_type") != "click"), F.col("value") * 2).alias("double_value"))
    return rounded(R.fill_medians(e, ["value", "double_value"], [["event_type", "month"], ["event_type"]]))


def q_share(spark, sf):
    c = table(spark, sf, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"))
    return R.share(c, "n", ["c_mktsegment"])


def q_cumulative(spark, sf):
    p = table(spark, sf, "part").groupBy("p_size").agg(F.count("*").alias("n"))
    total = p.agg(F.sum("n")).first()[0]
    run, first = R.cumulative(p.select("p_size", (F.col("n") / total).alias("ratio")), "ratio", "p_size")
    return run.select("p_size", F.round("cumulative", 6).alias("cumulative"), *(F.lit(v).alias(k) for k, v in first.first().asDict().items()))


def q_loadings(spark, sf):
    p = table(spark, sf, "part").groupBy("p_brand", "p_size").agg((F.avg("p_retailprice") - 1200).alias("loading"))
    return R.rank_loadings(p, "p_brand", "p_size", "loading").select("p_brand", "p_size", "rank", "contribution")


def q_renumber(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_nationkey") == 3, -1).otherwise(F.col("c_nationkey")).cast("int").alias("label"))
    return R.renumber(c, "label", noise=-1)


def q_fill_down(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_partkey") % 3 == 1, F.col("l_returnflag")).alias("flag"), F.round("l_extendedprice", 2).alias("price"))
    return R.fill_down(li, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "price"], "flag")


def q_running_id(spark, sf):
    return R.running_id(_e(spark, sf).select("event_id", "day"), ["day", "event_id"], "id").select("event_id", iso("day").alias("day"), "id")


def q_top(spark, sf):
    c = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"))
    return rounded(R.top_n(c, [F.desc("total"), "o_custkey"], 10), total=2)


def q_top_values(spark, sf):
    return R.top_values(table(spark, sf, "part"), "p_type", 10)


def q_sample(spark, sf):
    return R.capped_sample(_e(spark, sf), "event_type", 50, [F.md5(F.col("event_id").cast("string")), "event_id"]).select("event_id", "event_type")


def q_hash_sample(spark, sf):
    """All rows of a repeatable fifth of the users."""
    return R.hash_sample(_e(spark, sf), 0.2, ["user_id"]).select("event_id", "user_id")


def q_fixed_sample(spark, sf):
    """Exactly 300 events, whatever the layout."""
    return R.fixed_sample(_e(spark, sf), 300, ["event_id"]).select("event_id", "user_id")


def q_proportional_sample(spark, sf):
    """400 events in proportion to their types, then at most 90 of a type."""
    return R.proportional_sample(_e(spark, sf), "event_type", 400, 90, ["event_id"]).select("event_id", "event_type")


def q_union(spark, sf):
    """Tables of different columns as one, and its distinct rows."""
    a = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("kind"))
    return R.ordered(a.unionByName(b, allowMissingColumns=True).dropDuplicates(), ["kind", "nation"])


def q_sorted(spark, sf):
    """The place of every row in a sort of several keys, nulls last."""
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderstatus")).alias("status"), "o_totalprice")
    placed = R.running_id(o, [F.asc_nulls_last("status"), F.desc("o_totalprice"), F.col("o_orderkey")], "place")
    return rounded(placed, o_totalprice=2)


QUERIES = {
    "keep_first": q_first,
    "flag_repeated": q_repeated,
    "most_frequent": q_mode,
    "fill_medians": q_medians,
    "group_share": q_share,
    "cumulative_variance": q_cumulative,
    "rank_loadings": q_loadings,
    "renumber_clusters": q_renumber,
    "fill_down": q_fill_down,
    "running_id": q_running_id,
    "top_territories": q_top,
    "top_values": q_top_values,
    "capped_sample": q_sample,
    "hash_sample": q_hash_sample,
    "fixed_sample": q_fixed_sample,
    "proportional_sample": q_proportional_sample,
    "union_distinct": q_union,
    "multi_key_sort": q_sorted,
}
_E = "e AS (SELECT event_id, event_type, user_id, value, CAST(ts AS DATE) AS day FROM events)"
ORACLES = {
    "keep_first": f"WITH {_E} SELECT event_id, event_type, user_id, round(value, 3) AS value, strftime(day, '%Y-%m-%d') AS day FROM e QUALIFY row_number() OVER (PARTITION BY user_id, event_type, day ORDER BY value, event_id) = 1",
    "flag_repeated": "WITH d AS (SELECT doc_id, CASE WHEN doc_id % 10 <> 0 THEN md5(text) END AS digest FROM documents) SELECT doc_id, digest, digest IS NOT NULL AND count(*) OVER (PARTITION BY digest) > 1 AS repeated FROM d",
    "most_frequent": "WITH c AS (SELECT p_brand, p_type, p_size, count(*) AS n FROM part GROUP BY ALL) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type, p_size) = 1",
    "fill_medians": f"""WITH {_E}, v AS (SELECT event_id, event_type, CAST(month(day) AS INTEGER) AS month, CASE WHEN event_id % 3 <> 0 THEN value END AS a, CASE WHEN event_id % 2 = 0 AND event_type <> 'click' THEN value * 2 END AS b FROM e)
  SELECT event_id, event_type, month, round(coalesce(a, quantile_cont(a, 0.5) OVER (PARTITION BY event_type, month), quantile_cont(a, 0.5) OVER (PARTITION BY event_type), quantile_cont(a, 0.5) OVER (), 0), 3) AS value,
  round(coalesce(b, quantile_cont(b, 0.5) OVER (PARTITION BY event_type, month), quantile_cont(b, 0.5) OVER (PARTITION BY event_type), quantile_cont(b, 0.5) OVER (), 0), 3) AS double_value FROM v""",
    "group_share": "SELECT c_mktsegment, c_nationkey, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY c_mktsegment), 6) AS share FROM customer GROUP BY 1, 2",
    "cumulative_variance": "WITH p AS (SELECT p_size, count(*) / (SELECT count(*) FROM part) AS r FROM part GROUP BY 1), c AS (SELECT p_size, sum(r) OVER (ORDER BY p_size) AS c FROM p) SELECT p_size, round(c, 6) AS cumulative, (SELECT min(p_size) FROM c WHERE c >= 0.7) AS at_70, (SELECT min(p_size) FROM c WHERE c >= 0.8) AS at_80, (SELECT min(p_size) FROM c WHERE c >= 0.85) AS at_85, (SELECT min(p_size) FROM c WHERE c >= 0.9) AS at_90, (SELECT min(p_size) FROM c WHERE c >= 0.95) AS at_95 FROM c",
    "rank_loadings": "WITH p AS (SELECT p_brand, p_size, avg(p_retailprice) - 1200 AS l FROM part GROUP BY 1, 2) SELECT p_brand, p_size, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY abs(l) DESC, p_size) AS INTEGER) AS rank, round(l * l * 100 / sum(l * l) OVER (PARTITION BY p_brand), 6) AS contribution FROM p",
    "renumber_clusters": "WITH c AS (SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN -1 ELSE c_nationkey END AS label FROM customer), n AS (SELECT label, row_number() OVER (ORDER BY count(*) DESC, label) AS k FROM c WHERE label <> -1 GROUP BY label) SELECT c_custkey, c.label, CAST(coalesce(k, -1) AS INTEGER) AS cluster FROM c LEFT JOIN n ON n.label = c.label",
    "fill_down": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice, 2) AS price, last_value(CASE WHEN l_partkey % 3 = 1 THEN l_returnflag END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, round(l_extendedprice, 2) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS flag FROM lineitem",
    "running_id": f"WITH {_E} SELECT event_id, strftime(day, '%Y-%m-%d') AS day, row_number() OVER (ORDER BY day, event_id) AS id FROM e",
    "top_territories": "SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC, 1 LIMIT 10",
    "top_values": "SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_type LIMIT 10",
    "capped_sample": f"WITH {_E} SELECT event_id, event_type FROM e QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY md5(CAST(event_id AS VARCHAR)), event_id) <= 50",
    "fixed_sample": f"WITH {_E} SELECT event_id, user_id FROM e ORDER BY md5(CAST(event_id AS VARCHAR)) LIMIT 300",
    "proportional_sample": f"""WITH {_E}, g AS (SELECT event_type, count(*) AS n, sum(count(*)) OVER () AS t FROM e GROUP BY 1), q AS (SELECT *, least(400, t) * n // t AS w, least(400, t) * n % t AS r FROM g),
  p AS (SELECT event_type, least(90, w + CAST(row_number() OVER (ORDER BY r DESC, event_type) <= least(400, t) - sum(w) OVER () AS BIGINT)) AS quota FROM q)
  SELECT event_id, event_type FROM (SELECT event_id, e.event_type, quota, row_number() OVER (PARTITION BY e.event_type ORDER BY md5(CAST(event_id AS VARCHAR))) AS k FROM e JOIN p ON p.event_type = e.event_type) WHERE k <= quota""",
    "hash_sample": f"WITH {_E} SELECT event_id, user_id FROM e WHERE substr(md5(CAST(user_id AS VARCHAR)), 1, 8) < '{int(0.2 * 2**32):08x}'",
    "union_distinct": "SELECT DISTINCT NULL AS kind, c_nationkey AS nation, c_mktsegment AS segment FROM customer UNION ALL SELECT DISTINCT 'supplier', s_nationkey, NULL FROM supplier",
    "multi_key_sort": "WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderstatus END AS status, o_totalprice FROM orders) SELECT o_orderkey, status, round(o_totalprice, 2) AS o_totalprice, row_number() OVER (ORDER BY status NULLS LAST, o_totalprice DESC, o_orderkey) AS place FROM o",
}
