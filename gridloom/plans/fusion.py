"""Queries of the fusion and its roll-ups. Region is the nation, state the nation's region, day the calendar date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.dates import calendar
from gridloom.operators import fusion as O
from gridloom.plans.tables import iso, table
from gridloom.staging import staged

KEYS = ["region", "day"]
PERIOD = ("event", "1995-01-01", "1998-12-31")


def events(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("region"))
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("amount"), "o_orderstatus")
    return o.join(c, "c_custkey")


def detections(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("region"))
    i = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), F.to_date("l_shipdate").alias("day"), F.col("l_extendedprice").alias("power"), F.col("l_quantity").alias("brightness"), "l_returnflag", "l_linestatus")
    return i.join(s, "s_suppkey")


def readings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select((F.col("user_id") % 25).cast("int").alias("region"), F.to_date("ts").alias("day"), F.col("user_id").alias("station"), F.col("value").alias("rain"))


def event_source(spark: SparkSession, sf: str) -> DataFrame:
    return O.event_days(events(spark, sf), KEYS, "amount")


def detection_source(spark: SparkSession, sf: str) -> DataFrame:
    return O.detection_days(detections(spark, sf), KEYS, "power", F.col("l_returnflag") == "R", ["brightness"])


def station_source(spark: SparkSession, sf: str) -> DataFrame:
    return O.station_days(readings(spark, sf), KEYS, "station", ["rain"])


def fused(spark: SparkSession, sf: str) -> DataFrame:
    base = O.fuse([event_source(spark, sf), detection_source(spark, sf), station_source(spark, sf)], KEYS)
    zero = ["detection_count", "detection_power_sum", "detection_day_count", "detection_night_count", "detection_power_valid_count", "detection_brightness_valid_count", "station_rain_valid_count"]
    return O.availability(base, {"event": "event_count", "detection": "detection_count", "station": "station_n"}, zero, PERIOD, ["event_count", "event_amount_sum"])


def with_state(df: DataFrame, spark: SparkSession, sf: str) -> DataFrame:
    """Adds the state of a region from the catalog, a dimension of fixed size."""
    return df.join(F.broadcast(table(spark, sf, "nation").select(F.col("n_nationkey").alias("region"), F.col("n_regionkey").alias("state"), "n_name")), "region", "left")


def state_days(spark: SparkSession, sf: str, days: DataFrame | None = None) -> DataFrame:
    """The roll-up of the fused table, or of a written copy of it."""
    sums = ["event_count", "event_amount_sum", "detection_count", "detection_power_sum", "detection_day_count", "station_n", "detection_power_valid_count", "station_rain_valid_count"]
    return O.roll_up(with_state(fused(spark, sf) if days is None else days, spark, sf), ["state", "day"], "region", sums, ["has_event", "has_detection", "has_station", "event_available"], {"detection_power_mean": "detection_power_valid_count", "station_rain_mean": "station_rain_valid_count"})


def rounded(df: DataFrame, **places: int) -> DataFrame:
    """Doubles rounded for comparison and days as text."""
    return df.select([iso(c).alias(c) if t == "date" else F.round(c, places.get(c, 6 if c.endswith("_mean") else 3)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def q_event_days(spark, sf):
    return rounded(event_source(spark, sf))


def q_detection_days(spark, sf):
    return rounded(detection_source(spark, sf))


def q_station_days(spark, sf):
    return rounded(station_source(spark, sf))


def q_fused(spark, sf):
    return rounded(fused(spark, sf))


def q_universe(spark, sf):
    return rounded(O.key_universe([event_source(spark, sf), detection_source(spark, sf), station_source(spark, sf)], KEYS))


def q_state_days(spark, sf):
    return rounded(state_days(spark, sf))


def q_control(spark, sf):
    days = staged(fused(spark, sf), "fused")
    out = O.control_totals(days, state_days(spark, sf, days), ["event_count", "detection_count", "detection_power_sum"], 0.01)
    return rounded(out, detail=1, rolled=1)


def q_calendar(spark, sf):
    return rounded(calendar(table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")).distinct(), "day"))


def q_cubes(spark, sf):
    d = with_state(detections(spark, sf), spark, sf).withColumns({"year": F.year("day"), "month": F.month("day")})
    grains = {"cluster": ["l_returnflag"], "year_month": ["year", "month"], "state": ["state"], "region": ["state", "region"], "state_cluster": ["state", "l_returnflag"], "region_cluster": ["state", "region", "l_returnflag"]}
    return rounded(O.cubes(d, grains, [F.count("*").alias("n"), F.sum("power").alias("power_sum"), F.avg("brightness").alias("brightness_mean"), F.countDistinct("day").alias("days")]))


def q_yearly(spark, sf):
    d = with_state(detections(spark, sf), spark, sf).withColumn("year", F.year("day"))
    keys = ["year", "state", "region"]
    base = d.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("power").alias("power_mean"), F.max("power").alias("power_max"), F.avg("brightness").alias("brightness_mean"))
    return rounded(base.join(O.dominant(d, keys, "l_returnflag"), keys, "left"), dominant_share=4)


def q_inventory(spark, sf):
    p = table(spark, sf, "part").select("p_brand", F.col("p_size").cast("string").alias("size"), F.col("p_retailprice").cast("string").alias("price"), F.col("p_type").alias("kind"))
    return rounded(O.means_by_key(p, ["p_brand"], ["size", "price", "kind"], "m_"))


def q_context(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("region"), "c_mktsegment", F.abs("c_acctbal").alias("area"))
    return rounded(O.context_roll_up(with_state(c, spark, sf), ["state"], "area", "c_mktsegment", ["area"]), dominant_share=4)


def q_state_amounts(spark, sf):
    c = table(spark, sf, "customer").filter(F.col("c_acctbal") > 0)
    return rounded(c.groupBy(F.when(F.col("c_nationkey") % 5 != 0, F.col("c_nationkey")).alias("region")).agg(F.sum("c_acctbal").alias("amount"), F.count("*").alias("n")))


def q_scopes(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.year("ts").alias("year"), "value", (F.col("user_id") % 7).cast("int").alias("domain"))
    return rounded(O.scopes(e, {"total": [], "type": ["event_type"], "year": ["year"]}, [F.count("*").alias("n"), F.count_if(F.col("value") < 0).alias("negative"), F.min("value").alias("least"), F.max("value").alias("largest")], "domain", 3))


def q_file_findings(spark, sf):
    """Sums, common and all columns, and the period over per-file rows; a file is an event type."""
    e = table(spark, sf, "events").withColumn("columns", F.when(F.col("event_type") < "m", F.array(F.lit("ts"), F.lit("value"))).otherwise(F.array(F.lit("ts"), F.lit("user"))))
    per = e.groupBy("event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.first("columns").alias("columns"))
    lists = F.collect_list("columns")
    return per.agg(F.count("*").alias("files"), F.sum("n").alias("n"), iso(F.min("first")).alias("first"), iso(F.max("last")).alias("last"), F.array_join(F.array_sort(F.reduce(lists, F.array().cast("array<string>"), F.array_union)), ",").alias("all_columns"), F.array_join(F.array_sort(F.reduce(lists, F.first("columns"), F.array_intersect)), ",").alias("common_columns"))


def q_groups(spark, sf):
    """Activity groups of clusters, their totals and the group with most rows."""
    e = table(spark, sf, "events").withColumns({"cluster": (F.col("user_id") % 9).cast("int"), "year": F.year("ts"), "month": F.month("ts")})
    group = F.when(F.col("cluster") < 3, "low").when(F.col("cluster") < 6, "mid").otherwise("high")
    per = e.groupBy("year", "month", group.alias("activity")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    top = O.dominant(e.withColumn("activity", group), ["year", "month"], "activity").select("year", "month", F.col("dominant").alias("top_activity"))
    return rounded(per.join(top, ["year", "month"]), total=2)


_REGION_DAY = """
ev AS (SELECT c_nationkey AS region, CAST(o_orderdate AS DATE) AS day, count(*) AS event_count, coalesce(sum(o_totalprice), 0) AS event_amount_sum, avg(o_totalprice) AS event_amount_mean
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
de AS (SELECT s_nationkey AS region, CAST(l_shipdate AS DATE) AS day, count(*) AS detection_count, coalesce(sum(l_extendedprice), 0) AS detection_power_sum,
    count(*) FILTER (l_returnflag = 'R') AS detection_day_count, count(*) FILTER (l_returnflag <> 'R') AS detection_night_count,
    avg(l_extendedprice) AS detection_power_mean, count(l_extendedprice) AS detection_power_valid_count, avg(l_quantity) AS detection_brightness_mean, count(l_quantity) AS detection_brightness_valid_count
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
st AS (SELECT CAST(user_id % 25 AS INTEGER) AS region, CAST(ts AS DATE) AS day, count(DISTINCT user_id) AS station_n, avg(value) AS station_rain_mean, count(value) AS station_rain_valid_count FROM events GROUP BY 1, 2),
k AS (SELECT region, day FROM ev UNION SELECT region, day FROM de UNION SELECT region, day FROM st),
f AS (SELECT k.region, k.day,
    CASE WHEN k.day BETWEEN DATE '1995-01-01' AND DATE '1998-12-31' THEN coalesce(event_count, 0) ELSE event_count END AS event_count,
    CASE WHEN k.day BETWEEN DATE '1995-01-01' AND DATE '1998-12-31' THEN coalesce(event_amount_sum, 0) ELSE event_amount_sum END AS event_amount_sum, event_amount_mean,
    coalesce(detection_count, 0) AS detection_count, coalesce(detection_power_sum, 0) AS detection_power_sum, coalesce(detection_day_count, 0) AS detection_day_count, coalesce(detection_night_count, 0) AS detection_night_count,
    detection_power_mean, coalesce(detection_power_valid_count, 0) AS detection_power_valid_count, detection_brightness_mean, coalesce(detection_brightness_valid_count, 0) AS detection_brightness_valid_count,
    station_n, station_rain_mean, coalesce(station_rain_valid_count, 0) AS station_rain_valid_count,
    CAST(ev.region IS NOT NULL AS INTEGER) AS has_event, CAST(de.region IS NOT NULL AS INTEGER) AS has_detection, CAST(st.region IS NOT NULL AS INTEGER) AS has_station,
    CAST(k.day BETWEEN DATE '1995-01-01' AND DATE '1998-12-31' AS INTEGER) AS event_available
  FROM k LEFT JOIN ev ON k.region = ev.region AND k.day = ev.day LEFT JOIN de ON k.region = de.region AND k.day = de.day LEFT JOIN st ON k.region = st.region AND k.day = st.day),
g AS (SELECT n_regionkey AS state, day, count(DISTINCT region) AS n_regions, count(*) FILTER (has_event = 1) AS n_regions_has_event, count(*) FILTER (has_detection = 1) AS n_regions_has_detection,
    count(*) FILTER (has_station = 1) AS n_regions_has_station, count(*) FILTER (event_available = 1) AS n_regions_event_available, max(has_event) AS has_event, max(has_detection) AS has_detection, max(has_station) AS has_station, max(event_available) AS event_available,
    sum(event_count) AS event_count, sum(event_amount_sum) AS event_amount_sum, sum(detection_count) AS detection_count, sum(detection_power_sum) AS detection_power_sum, sum(detection_day_count) AS detection_day_count,
    sum(station_n) AS station_n, sum(detection_power_valid_count) AS detection_power_valid_count, sum(station_rain_valid_count) AS station_rain_valid_count,
    sum(detection_power_mean * detection_power_valid_count) / nullif(sum(CASE WHEN detection_power_mean IS NOT NULL THEN detection_power_valid_count END), 0) AS detection_power_mean,
    sum(station_rain_mean * station_rain_valid_count) / nullif(sum(CASE WHEN station_rain_mean IS NOT NULL THEN station_rain_valid_count END), 0) AS station_rain_mean
  FROM f LEFT JOIN nation ON n_nationkey = region GROUP BY 1, 2)
"""
_D = """d AS (SELECT s_nationkey AS region, n_regionkey AS state, CAST(l_shipdate AS DATE) AS day, year(l_shipdate) AS year, month(l_shipdate) AS month, l_extendedprice AS power, l_quantity AS brightness, l_returnflag, l_linestatus
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON n_nationkey = s_nationkey)"""

QUERIES = {
    "event_days": q_event_days,
    "detection_days": q_detection_days,
    "station_days": q_station_days,
    "key_universe": q_universe,
    "fused_region_day": q_fused,
    "fused_state_day": q_state_days,
    "control_totals": q_control,
    "calendar_features": q_calendar,
    "summary_cubes": q_cubes,
    "yearly_summary": q_yearly,
    "inventory_means": q_inventory,
    "context_roll_up": q_context,
    "state_amounts": q_state_amounts,
    "quality_scopes": q_scopes,
    "file_findings": q_file_findings,
    "activity_groups": q_groups,
}
_DAY = "strftime(day, '%Y-%m-%d') AS day"
ORACLES = {
    "event_days": f"WITH {_REGION_DAY} SELECT region, {_DAY}, event_count, round(event_amount_sum, 3) AS event_amount_sum, round(event_amount_mean, 6) AS event_amount_mean FROM ev",
    "detection_days": f"WITH {_REGION_DAY} SELECT region, {_DAY}, detection_count, round(detection_power_sum, 3) AS detection_power_sum, detection_day_count, detection_night_count, round(detection_power_mean, 6) AS detection_power_mean, detection_power_valid_count, round(detection_brightness_mean, 6) AS detection_brightness_mean, detection_brightness_valid_count FROM de",
    "station_days": f"WITH {_REGION_DAY} SELECT region, {_DAY}, station_n, round(station_rain_mean, 6) AS station_rain_mean, station_rain_valid_count FROM st",
    "key_universe": f"WITH {_REGION_DAY} SELECT region, {_DAY} FROM k",
    "fused_region_day": f"""WITH {_REGION_DAY} SELECT region, {_DAY}, event_count, round(event_amount_sum, 3) AS event_amount_sum, round(event_amount_mean, 6) AS event_amount_mean, detection_count, round(detection_power_sum, 3) AS detection_power_sum, detection_day_count, detection_night_count,
  round(detection_power_mean, 6) AS detection_power_mean, detection_power_valid_count, round(detection_brightness_mean, 6) AS detection_brightness_mean, detection_brightness_valid_count, station_n, round(station_rain_mean, 6) AS station_rain_mean, station_rain_valid_count, has_event, has_detection, has_station, event_available,
  'EVENT:' || has_event || '|DETECTION:' || has_detection || '|STATION:' || has_station AS source_mask FROM f""",
    "fused_state_day": f"""WITH {_REGION_DAY} SELECT state, {_DAY}, n_regions, n_regions_has_event, n_regions_has_detection, n_regions_has_station, n_regions_event_available, has_event, has_detection, has_station, event_available, CAST(event_count AS BIGINT) AS event_count, round(event_amount_sum, 3) AS event_amount_sum, CAST(detection_count AS BIGINT) AS detection_count,
  round(detection_power_sum, 3) AS detection_power_sum, CAST(detection_day_count AS BIGINT) AS detection_day_count, CAST(station_n AS BIGINT) AS station_n, CAST(detection_power_valid_count AS BIGINT) AS detection_power_valid_count, CAST(station_rain_valid_count AS BIGINT) AS station_rain_valid_count, round(detection_power_mean, 6) AS detection_power_mean, round(station_rain_mean, 6) AS station_rain_mean FROM g""",
    "control_totals": f"""WITH {_REGION_DAY}, t AS (SELECT 'event_count' AS "column", (SELECT sum(event_count) FROM f) AS detail, (SELECT sum(event_count) FROM g) AS rolled UNION ALL SELECT 'detection_count', (SELECT sum(detection_count) FROM f), (SELECT sum(detection_count) FROM g)
  UNION ALL SELECT 'detection_power_sum', (SELECT sum(detection_power_sum) FROM f), (SELECT sum(detection_power_sum) FROM g)) SELECT "column", round(CAST(detail AS DOUBLE), 1) AS detail, round(CAST(rolled AS DOUBLE), 1) AS rolled, abs(detail - rolled) <= 0.01 AS agrees FROM t""",
    "calendar_features": f"SELECT {_DAY}, CAST(year(day) AS INTEGER) AS year, CAST(month(day) AS INTEGER) AS month, CAST(day(day) AS INTEGER) AS day_of_month, CAST(dayofyear(day) AS INTEGER) AS day_of_year, CAST(weekofyear(day) AS INTEGER) AS week, CAST(quarter(day) AS INTEGER) AS quarter, CAST(month(day) <= 6 AS INTEGER) AS first_half FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)",
    "summary_cubes": f"""WITH {_D}, a AS (SELECT CASE grouping_id(l_returnflag, year, month, state, region) WHEN 15 THEN 'cluster' WHEN 19 THEN 'year_month' WHEN 29 THEN 'state' WHEN 28 THEN 'region' WHEN 13 THEN 'state_cluster' WHEN 12 THEN 'region_cluster' END AS grain,
  l_returnflag, year, month, state, region, count(*) AS n, sum(power) AS p, avg(brightness) AS b, count(DISTINCT day) AS days
  FROM d GROUP BY GROUPING SETS ((l_returnflag), (year, month), (state), (state, region), (state, l_returnflag), (state, region, l_returnflag)))
  SELECT grain, l_returnflag, CAST(year AS INTEGER) AS year, CAST(month AS INTEGER) AS month, state, region, n, round(p, 3) AS power_sum, round(b, 6) AS brightness_mean, days FROM a""",
    "yearly_summary": f"""WITH {_D}, c AS (SELECT year, state, region, l_returnflag, count(*) AS w FROM d GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY year, state, region ORDER BY w DESC, l_returnflag) AS r, count(*) OVER (PARTITION BY year, state, region) AS nc, sum(w) OVER (PARTITION BY year, state, region) AS sw FROM c),
  a AS (SELECT year, state, region, count(*) AS n, round(avg(power), 6) AS power_mean, round(max(power), 3) AS power_max, round(avg(brightness), 6) AS brightness_mean FROM d GROUP BY 1, 2, 3)
  SELECT CAST(a.year AS INTEGER) AS year, a.state, a.region, n, power_mean, power_max, brightness_mean, l_returnflag AS dominant, w AS dominant_weight, nc AS n_categories, round(w / sw, 4) AS dominant_share FROM a JOIN r ON a.year = r.year AND a.state = r.state AND a.region = r.region AND r.r = 1""",
    "inventory_means": "SELECT p_brand, round(avg(p_size), 6) AS m_size_mean, count(p_size) AS m_size_valid_count, round(avg(p_retailprice), 6) AS m_price_mean, count(p_retailprice) AS m_price_valid_count FROM part GROUP BY 1",
    "context_roll_up": """WITH c AS (SELECT n_regionkey AS state, c_mktsegment, sum(abs(c_acctbal)) AS w FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY w DESC, c_mktsegment) AS r, sum(w) OVER (PARTITION BY state) AS s, count(*) OVER (PARTITION BY state) AS n FROM c)
  SELECT state, round(s, 3) AS area, c_mktsegment AS dominant, round(w, 3) AS dominant_weight, n AS n_categories, round(w / s, 4) AS dominant_share FROM r WHERE r = 1""",
    "state_amounts": "SELECT CASE WHEN c_nationkey % 5 <> 0 THEN c_nationkey END AS region, round(sum(c_acctbal), 3) AS amount, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1",
    "quality_scopes": """WITH e AS (SELECT event_type, CAST(year(ts) AS INTEGER) AS year, value, CAST(user_id % 7 AS INTEGER) AS domain FROM events), a AS (
  SELECT 'total' AS grain, NULL AS event_type, NULL AS year, * FROM (SELECT count(*) AS n, count(*) FILTER (value < 0) AS negative, min(value) AS least, max(value) AS largest FROM e)
  UNION ALL SELECT 'type', event_type, NULL, count(*), count(*) FILTER (value < 0), min(value), max(value) FROM e GROUP BY event_type
  UNION ALL SELECT 'year', NULL, year, count(*), count(*) FILTER (value < 0), min(value), max(value) FROM e GROUP BY year), v AS (
  SELECT 'total' AS grain, NULL AS event_type, NULL AS year, domain, count(*) AS n FROM e GROUP BY domain UNION ALL SELECT 'type', event_type, NULL, domain, count(*) FROM e GROUP BY event_type, domain UNION ALL SELECT 'year', NULL, year, domain, count(*) FROM e GROUP BY year, domain),
  r AS (SELECT *, row_number() OVER (PARTITION BY grain, event_type, year ORDER BY n DESC, domain) AS r FROM v), t AS (SELECT grain, event_type, year, string_agg(domain || ':' || n, ',' ORDER BY r) AS top_values FROM r WHERE r <= 3 GROUP BY 1, 2, 3)
  SELECT a.grain, a.event_type, CAST(a.year AS INTEGER) AS year, n, negative, round(least, 3) AS least, round(largest, 3) AS largest, top_values FROM a JOIN t ON a.grain = t.grain AND a.event_type IS NOT DISTINCT FROM t.event_type AND a.year IS NOT DISTINCT FROM t.year""",
    "file_findings": """SELECT count(DISTINCT event_type) AS files, count(*) AS n, strftime(min(ts), '%Y-%m-%d') AS first, strftime(max(ts), '%Y-%m-%d') AS last,
  'ts' || CASE WHEN max(event_type) >= 'm' THEN ',user' ELSE '' END || CASE WHEN min(event_type) < 'm' THEN ',value' ELSE '' END AS all_columns, CASE WHEN min(event_type) >= 'm' THEN 'ts,user' WHEN max(event_type) < 'm' THEN 'ts,value' ELSE 'ts' END AS common_columns FROM events""",
    "activity_groups": """WITH e AS (SELECT CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, CASE WHEN user_id % 9 < 3 THEN 'low' WHEN user_id % 9 < 6 THEN 'mid' ELSE 'high' END AS activity, value FROM events), p AS (SELECT year, month, activity, count(*) AS n, round(sum(value), 2) AS total FROM e GROUP BY 1, 2, 3)
  SELECT *, first_value(activity) OVER (PARTITION BY year, month ORDER BY n DESC, activity) AS top_activity FROM p""",
}
