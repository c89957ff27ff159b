"""Queries of sources in common form, contexts, feature matrices and model checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import context as C
from gridloom.operators import publish as P
from gridloom.plans.tables import iso, table

YEARS = ["1993", "1994", "1995"]


def _daily(spark, sf, grain: str):
    """Orders of each nation or region and day."""
    places = table(spark, sf, "customer").select("c_custkey", "c_nationkey").join(table(spark, sf, "nation").select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
    o = table(spark, sf, "orders").join(places, F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(F.col(grain).alias("place"), F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("orders"))


def _suppliers(spark, sf):
    return table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("place")).agg(F.count("*").alias("suppliers"))


def q_daily_contexts(spark, sf):
    names = table(spark, sf, "nation").select(F.col("n_nationkey").alias("place"), F.col("n_name").alias("name"))
    return C.with_contexts(_daily(spark, sf, "n_nationkey"), {"names": (names, ["place"]), "suppliers": (_suppliers(spark, sf), ["place"])}).withColumn("day", iso("day"))


def _matrix(spark, sf):
    regions = table(spark, sf, "region").select(F.col("r_regionkey").alias("place"), F.col("r_name").alias("name"))
    return C.feature_matrix(_daily(spark, sf, "n_regionkey"), "day", ["orders"], {"regions": (regions, ["place"])})


def q_state_matrix(spark, sf):
    return _matrix(spark, sf).select("place", iso("day").alias("day"), "orders", "month", "week", "first_half", F.round("log_orders", 6).alias("log_orders"), "name")


def q_modelling_base(spark, sf):
    return C.modelling_base(_matrix(spark, sf).withColumn("day", iso("day")), ["place", "day"], ["orders", "month"], ["name"])


def _inventory(spark, sf):
    places = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("region")).join(table(spark, sf, "nation").select(F.col("n_nationkey").alias("region"), F.col("n_regionkey").alias("state")), "region")
    o = table(spark, sf, "orders").join(places, F.col("o_custkey") == F.col("c_custkey"))
    price = F.when(F.col("o_orderkey") % 10 == 0, "n/a").otherwise((F.col("o_custkey") % 1000).cast("string"))
    return o.select("state", "region", F.year("o_orderdate").cast("string").alias("cycle"), price.alias("price"), F.col("o_orderpriority").alias("note"))


def q_inventory_context(spark, sf):
    """Mostly numeric columns at state grain and at region grain, for each cycle."""
    out = C.inventory_context(_inventory(spark, sf), {"state": ["state"], "region": ["state", "region"]}, "cycle", ["price", "note"])
    return out.withColumn("price_mean", F.round("price_mean", 6))


def q_cycle_columns(spark, sf):
    """Cycles as columns, joined to the nations."""
    means = C.inventory_context(_inventory(spark, sf), {"region": ["region"]}, "cycle", ["price"]).withColumn("price", F.round("price_mean", 6))
    wide = C.cycles_to_columns(means, ["region"], "cycle", YEARS, ["price"])
    return C.merge_contexts(table(spark, sf, "nation").select(F.col("n_nationkey").alias("region"), F.col("n_name").alias("name")), [wide], ["region"])


def q_event_source(spark, sf):
    k, d = F.col("o_orderkey"), F.to_date("o_orderdate")
    raw = table(spark, sf, "orders").select(k.alias("Clave"), F.when(k % 2 == 0, F.date_format(d, "dd/MM/yyyy")).otherwise(F.date_format(d, "yyyyMMdd")).alias("Inicio"), F.concat((k % 30).cast("string"), F.lit(";30")).alias("Tiempo"), F.concat((k % 500).cast("string"), F.lit(",5 ha")).alias("Total"), (k % 90).cast("string").alias("Estado"), F.concat(F.lit("  "), F.upper("o_orderstatus"), F.lit(" DE  "), F.lower("o_orderpriority")).alias("Causa"), (k % 33).cast("string").alias("g"), (k % 60).cast("string").alias("m"))
    out = C.prepare_source(raw, {"Clave": "id", "Inicio": "begin", "Tiempo": "span", "Total": "area", "Estado": "state", "Causa": "cause"}, dates=["begin"], durations=["span"], numbers=["area"], codes={"state": 2}, keys=["cause"], dms={"lat": ("g", "m", "g", False), "lon": ("g", "m", "g", True)})
    return out.select("id", iso("begin").alias("begin"), "span", "area", "state", "cause_key", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


def q_typed_points(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 6 == 0, "nulo").otherwise((F.col("user_id") % 40).cast("string")).alias("lat"), (-(F.col("user_id") % 130)).cast("string").alias("lon"), F.date_format("ts", "dd/MM/yyyy").alias("day"))
    return C.typed_points(e, [], ["day"], "lat", "lon", (14.0, 33.0, -119.0, -86.0)).withColumn("day", iso("day"))


def q_canonical(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("CLAVE"), F.col("c_nationkey").alias("Nación"), F.col("c_name").alias("nombre"))
    return C.canonical(c, {"id": ["id", "clave"], "place": ["estado", "nacion"], "time": ["fecha"]}).select("id", "place", "time", "nombre")


def q_category(spark, sf):
    """Category columns of three tables: by priority, by number of values, and none."""
    rows = [(n, *C.category_column(table(spark, sf, n), key, priority, most)) for n, key, priority, most in (("orders", "o_orderkey", ["o_orderstatus"], 500), ("part", "p_partkey", [], 500), ("region", "r_regionkey", [], 1))]
    return spark.createDataFrame(rows, "name string, column string, values long")


def _assigned(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 90).alias("node"), (F.col("l_suppkey") % 90 % 9).alias("cluster"))


def q_model_checks(spark, sf):
    lines = table(spark, sf, "lineitem")
    variance = lines.groupBy("l_linenumber").agg((F.count("*") / lines.count()).alias("ratio")).filter("l_linenumber <= 5")
    return C.model_checks(table(spark, sf, "lineitem"), _assigned(spark, sf), ["l_orderkey", "l_linenumber"], "node", "cluster", variance, "ratio", 9)


def _states(spark, sf):
    i = table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 5).cast("int").alias("state"), (F.col("l_partkey") % 7).cast("int").alias("cluster"))
    profile = i.agg(F.avg((F.col("l_returnflag") == "R").cast("double")).alias("d"), F.avg((F.col("l_linestatus") == "F").cast("double")).alias("e"), F.avg((F.col("l_quantity") > 25).cast("double")).alias("s"))
    return P.cluster_catalog(profile, "d", "e", "s")


def q_state_catalog(spark, sf):
    return _states(spark, sf).select("state", "cluster", "name", "colour", "order", "usage", "description")


def q_export_rows(spark, sf):
    """The export of the state grain: fixed columns and names."""
    return C.export_rows(_states(spark, sf), {"Entity": F.lpad(F.col("state").cast("string"), 2, "0"), "Cluster": "cluster", "Pattern": "name", "Detections (%)": F.round(F.col("d") * 100, 4), "Use": "usage"})


QUERIES = {"daily_contexts": q_daily_contexts, "state_matrix": q_state_matrix, "modelling_base": q_modelling_base, "inventory_context": q_inventory_context, "cycle_columns": q_cycle_columns, "event_source": q_event_source, "typed_points": q_typed_points, "canonical_columns": q_canonical, "category_choice": q_category, "model_checks": q_model_checks, "state_catalog": q_state_catalog, "export_rows": q_export_rows}

_D = "d AS (SELECT {g} AS place, CAST(o_orderdate AS DATE) AS day, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)"
_I = "i AS (SELECT n_regionkey AS state, n_nationkey AS region, CAST(year(o_orderdate) AS VARCHAR) AS cycle, CASE WHEN o_orderkey % 10 <> 0 THEN CAST(o_custkey % 1000 AS DOUBLE) END AS price FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"
_LEVEL = lambda c: f"CASE WHEN {c} >= (SELECT quantile_cont({c}, 0.66) FROM p) THEN 'high' WHEN {c} >= (SELECT quantile_cont({c}, 0.33) FROM p) THEN 'medium' ELSE 'low' END"
_S = "p AS (SELECT CAST(l_suppkey % 5 AS INTEGER) AS state, CAST(l_partkey % 7 AS INTEGER) AS cluster, avg(CAST(l_returnflag = 'R' AS INTEGER)) AS d, avg(CAST(l_linestatus = 'F' AS INTEGER)) AS e, avg(CAST(l_quantity > 25 AS INTEGER)) AS s FROM lineitem GROUP BY 1, 2), z(dl, el, colour, \"order\", usage, style, observed) AS (VALUES ('high', 'high', '#B91C1C', 1, 'first in maps, filters and details', 'much activity, confirmed by events', CAST(NULL AS VARCHAR)), ('high', 'medium', '#EA580C', 2, 'first in maps, filters and details', 'much activity, few events', CAST(NULL AS VARCHAR)), ('high', 'low', '#EA580C', 2, 'first in maps, filters and details', 'much activity, few events', CAST(NULL AS VARCHAR)), ('medium', 'high', '#D97706', 3, 'first in maps, filters and details', 'some activity, many events', CAST(NULL AS VARCHAR)), ('medium', 'medium', '#D97706', 3, 'comparison over space and time', 'some activity', CAST(NULL AS VARCHAR)), ('medium', 'low', '#D97706', 3, 'comparison over space and time', 'some activity', CAST(NULL AS VARCHAR)), ('low', 'high', '#2563EB', 4, 'first in maps, filters and details', 'little activity', 'little activity, well observed'), ('low', 'medium', '#2563EB', 4, 'background', 'little activity', 'little activity, well observed'), ('low', 'low', '#2563EB', 4, 'background', 'little activity', 'little activity, well observed')" + f"), c AS (SELECT *, {_LEVEL('d')} AS dl, {_LEVEL('e')} AS el, {_LEVEL('s')} AS sl FROM p), k AS (SELECT c.*, z.colour, z.\"order\", z.usage, coalesce(CASE WHEN sl = 'high' THEN z.observed END, z.style) AS name FROM c JOIN z USING (dl, el))"
ORACLES = {
    "daily_contexts": f"WITH {_D.format(g='n_nationkey')}, s AS (SELECT s_nationkey AS place, count(*) AS suppliers FROM supplier GROUP BY 1) SELECT place, strftime(day, '%Y-%m-%d') AS day, orders, n_name AS name, suppliers FROM d LEFT JOIN nation ON place = n_nationkey LEFT JOIN s USING (place)",
    "state_matrix": f"WITH {_D.format(g='n_regionkey')} SELECT place, strftime(day, '%Y-%m-%d') AS day, orders, month(day) AS month, weekofyear(day) AS week, CAST(month(day) <= 6 AS INTEGER) AS first_half, round(ln(1 + orders), 6) AS log_orders, r_name AS name FROM d LEFT JOIN region ON place = r_regionkey",
    "modelling_base": f"WITH {_D.format(g='n_regionkey')} SELECT place, strftime(day, '%Y-%m-%d') AS day, orders, month(day) AS month, r_name AS name FROM d LEFT JOIN region ON place = r_regionkey",
    "inventory_context": f"WITH {_I} SELECT CASE WHEN grouping(region) = 1 THEN 'state' ELSE 'region' END AS grain, state, region, cycle, round(avg(price), 6) AS price_mean, count(price) AS price_valid_count FROM i GROUP BY GROUPING SETS ((state, cycle), (state, region, cycle))",
    "cycle_columns": f"WITH {_I} SELECT n_nationkey AS region, n_name AS name, " + ", ".join(f"round(avg(CASE WHEN cycle = '{y}' THEN price END), 6) AS price_{y}" for y in YEARS) + " FROM nation LEFT JOIN i ON n_nationkey = region GROUP BY 1, 2",
    "event_source": "SELECT o_orderkey AS id, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS begin, lpad(CAST(o_orderkey % 30 AS VARCHAR), 2, '0') || ':30:00' AS span, o_orderkey % 500 + 0.5 AS area, lpad(CAST(o_orderkey % 90 AS VARCHAR), 2, '0') AS state, lower(o_orderstatus) || ' de ' || trim(regexp_replace(regexp_replace(lower(o_orderpriority), '[^0-9a-z ]', ' ', 'g'), ' +', ' ', 'g')) AS cause_key, round(o_orderkey % 33 + o_orderkey % 60 / 60.0 + o_orderkey % 33 / 3600.0, 6) AS lat, round(-(o_orderkey % 33 + o_orderkey % 60 / 60.0 + o_orderkey % 33 / 3600.0), 6) AS lon FROM orders",
    "typed_points": "SELECT event_id, CAST(user_id % 40 AS DOUBLE) AS lat, CAST(-(user_id % 130) AS DOUBLE) AS lon, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE event_id % 6 <> 0 AND user_id % 40 BETWEEN 14 AND 33 AND user_id % 130 BETWEEN 86 AND 119",
    "canonical_columns": "SELECT c_custkey AS id, c_nationkey AS place, CAST(NULL AS VARCHAR) AS time, c_name AS nombre FROM customer",
    "category_choice": "SELECT 'orders' AS name, 'o_orderstatus' AS \"column\", count(DISTINCT o_orderstatus) AS \"values\" FROM orders UNION ALL (SELECT 'part', c, n FROM (SELECT 'p_brand' AS c, count(DISTINCT p_brand) AS n FROM part UNION ALL SELECT 'p_name', count(DISTINCT p_name) FROM part UNION ALL SELECT 'p_type', count(DISTINCT p_type) FROM part) WHERE n <= 500 ORDER BY n DESC, c LIMIT 1) UNION ALL SELECT 'region', NULL, 0",
    "model_checks": "WITH l AS (SELECT CAST(count(*) AS DOUBLE) AS n, round(count(*) FILTER (l_linenumber <= 5) / count(*), 6) AS v, CAST(count(DISTINCT l_suppkey % 90 % 9) AS DOUBLE) AS c FROM lineitem) SELECT 'rows' AS \"check\", n AS value, n AS expected, true AS ok FROM l UNION ALL SELECT 'nulls', 0, 0, true UNION ALL SELECT 'split_nodes', 0, 0, true UNION ALL SELECT 'clusters', c, 9, c = 9 FROM l UNION ALL SELECT 'variance', v, 0.9, v >= 0.9 FROM l",
    "state_catalog": f"WITH {_S} SELECT state, cluster, name, colour, \"order\", usage, printf('%.1f %% of days with detections, %.1f %% with events', d * 100, e * 100) AS description FROM k",
    "export_rows": f"WITH {_S} SELECT lpad(CAST(state AS VARCHAR), 2, '0') AS \"Entity\", cluster AS \"Cluster\", name AS \"Pattern\", round(d * 100, 4) AS \"Detections (%)\", usage AS \"Use\" FROM k",
}
