"""Queries of features and models, on line items and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import density as D
from gridloom.operators import fitted as S
from gridloom.operators import models as M
from gridloom.operators.ranking import cumulative, rank_loadings, renumber
from gridloom.plans.fusion import rounded
from gridloom.plans.tables import iso, table
from gridloom.staging import scratch, staged

FEATURES = ["quantity", "price", "discount", "tax"]
EPS, LEAST = [0.1, 0.25], [4, 8]


def _items(spark, sf):
    return table(spark, sf, "lineitem").select((F.col("l_suppkey") % 9).cast("int").alias("cluster"), (F.col("l_suppkey") % 5).cast("int").alias("state"), F.to_date("l_shipdate").alias("day"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), (F.col("l_returnflag") == "R").cast("int").alias("has_return"))


def _vectors(spark, sf):
    """All components of the vectors as columns e0, e1, and so on, and their names."""
    v = table(spark, sf, "embeddings")
    names = [f"e{i}" for i in range(v.agg(F.max(F.size("embedding"))).first()[0] or 0)]
    return v.select("vec_id", "label", *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(names))), names


def q_logs(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("value").alias("count"), (F.col("value") - 1000).alias("shifted"), (F.col("user_id") % 30).cast("double").alias("low"), (F.col("user_id") % 45).cast("double").alias("high"))
    out = M.weather_features(M.log_features(e, ["count", "shifted"]), "low", "high")
    assert "log_shifted" not in out.columns
    return out.select("event_id", F.round("log_count", 6).alias("log_count"), "mean_temperature", "amplitude")


def q_impute(spark, sf):
    k = F.col("event_id")
    e = table(spark, sf, "events").select("event_id", F.col("event_type").alias("state"), F.month("ts").alias("month"), F.when(k % 4 != 0, F.col("value")).alias("seen"), F.when(k % 3 != 0, F.col("value")).alias("rain"), F.when(k % 5 != 0, F.col("value") / 2).alias("area"), F.when(k % 2 != 0, F.col("value") * 3).alias("rest"))
    return rounded(M.impute(e, {"seen": "detection", "rain": "weather", "area": "context", "rest": "other"}, "state", "month").drop("state", "month"))


def q_standard(spark, sf):
    out = M.standardize(_items(spark, sf), FEATURES)
    return out.agg(*(F.round(F.avg(c), 6).alias(f"{c}_mean") for c in FEATURES), *(F.round(F.stddev_pop(c), 6).alias(f"{c}_deviation") for c in FEATURES), *(F.round(F.max(c), 4).alias(f"{c}_max") for c in FEATURES)).select([(F.col(c) + 0.0).alias(c) if not c.endswith("_mean") else F.abs(c).alias(c) for c in [f"{f}_{s}" for f in FEATURES for s in ("mean", "deviation", "max")]])


def q_fitted(spark, sf):
    """Medians, means and ranges learnt from the items shipped before 1999, saved, loaded and applied to all items."""
    k = F.col("l_orderkey") + F.col("l_linenumber")
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("day"), F.col("l_returnflag").alias("state"), F.month(F.to_date("l_shipdate")).alias("month"), F.when(k % 3 != 0, F.col("l_quantity")).alias("quantity"), F.when(k % 4 != 0, F.col("l_extendedprice")).alias("price"), F.when(k % 5 != 0, F.col("l_discount")).alias("discount"), F.when(k % 7 != 0, F.col("l_tax")).alias("tax"))
    before = rows.filter(F.col("day") < F.lit("1999-01-01").cast("date"))
    imputer = S.fit_imputer(before, {"quantity": "weather", "price": "context", "discount": "other", "tax": "detection"}, "state", "month")
    filled = imputer.apply(before)
    fits = [imputer, S.fit_standard(filled, ["quantity", "price"]), S.fit_ranges(filled, ["discount"])]
    root = scratch(spark, "fits")
    for i, fit in enumerate(fits):
        fit.save(f"{root}/{i}")
    out = S.apply_all([S.Fitted.load(spark, f"{root}/{i}") for i in range(len(fits))], rows)
    return out.select("l_orderkey", "l_linenumber", *(F.round(c, 5).alias(c) for c in ("quantity", "price", "discount", "tax")))


def _scored(spark, sf):
    vectors, names = _vectors(spark, sf)
    return M.components(M.standardize(vectors, names), names, len(names))


def q_variance(spark, sf):
    """Variance of each component, the running share and the components that the levels need."""
    _, variance, _ = _scored(spark, sf)
    run, first = cumulative(variance, "ratio", "component", (0.5, 0.7))
    return run.select("component", F.round("variance", 4).alias("variance"), F.round("ratio", 5).alias("ratio"), F.round("cumulative", 5).alias("cumulative"), *(F.lit(v).alias(k) for k, v in first.first().asDict().items()))


def q_loadings(spark, sf):
    _, _, loadings = _scored(spark, sf)
    return rank_loadings(loadings, "component", "feature", "loading").select("component", "feature", F.round("loading", 4).alias("loading"), "rank", F.round("contribution", 3).alias("contribution"))


def _ninety(spark, sf):
    """Rows with the leading components that reach 90 % of the variance, scaled to 0..1, and the components' names."""
    vectors, names = _vectors(spark, sf)
    scored, variance, _ = M.components(M.standardize(vectors, names), names, len(names))
    kept = [f"PC{i + 1}" for i in range(M.pick_components(variance, 0.9))]
    return M.min_max(scored, kept).select("vec_id", "label", *kept), kept


def q_scores(spark, sf):
    """Scores of the leading components that reach 90 % of the variance, scaled to 0..1."""
    rows, kept = _ninety(spark, sf)
    return rows.select("vec_id", *(F.round(c, 4).alias(c) for c in kept))


def _som(spark, sf):
    data, kept = _ninety(spark, sf)
    data = staged(data, "components")
    som = M.SelfOrganisingMap(6, 6, kept, epochs=5).fit(data)
    return som, som.assign(data)


def q_som(spark, sf):
    """The map's nodes with activation and distance to their neighbours."""
    som, assigned = _som(spark, sf)
    return som.nodes(assigned).select("node", "som_x", "som_y", "activation", "occupied", F.round("u_distance", 3).alias("u_distance"))


def q_som_errors(spark, sf):
    som, assigned = _som(spark, sf)
    return M.map_errors(assigned).select(F.round("quantization_error", 3).alias("quantization_error"), F.round("topographic_error", 3).alias("topographic_error"), F.lit(som.errors[-1] <= som.errors[0]).alias("error_fell"))


def q_node_clusters(spark, sf):
    """Clusters of the map's nodes, numbered by size, for every row."""
    som, assigned = _som(spark, sf)
    nodes = som.nodes(assigned)
    labels, scores = M.kmeans_sweep(nodes, som.columns, "activation", [3, 4, 5])
    k = M.choose_k(scores)
    numbered = renumber(labels[k], "label", F.col("activation"), name="cluster")
    return M.propagate(assigned.select("vec_id", "node"), numbered, "node", "cluster").groupBy("cluster").agg(F.count("*").alias("n"))


def q_configurations(spark, sf):
    """All tried settings of both kinds of clusters with their scores and the chosen ones."""
    som, assigned = _som(spark, sf)
    nodes = staged(som.nodes(assigned), "nodes")
    _, scores = M.kmeans_sweep(nodes, som.columns, "activation", [3, 4, 5])
    means = scores.select(F.lit("kmeans").alias("model"), F.format_string("k=%d", "k").alias("setting"), F.col("k").alias("clusters"), F.round("silhouette", 3).alias("silhouette"), F.round("smallest_share", 3).alias("smallest_share"), (F.col("k") == M.choose_k(scores)).alias("chosen"))
    _, grid = D.density_grid(nodes.filter("occupied"), "node", som.columns, [0.5, 0.6], [10], "activation")
    eps, least = D.choose_density(grid) if grid.filter("n_clusters >= 2").count() else (None, None)
    dense = grid.select(F.lit("density").alias("model"), F.format_string("eps=%.2f, least=%.0f", "eps", "least").alias("setting"), F.col("n_clusters").alias("clusters"), F.round("silhouette", 3).alias("silhouette"), F.round("noise_share", 3).alias("noise_share"), F.coalesce((F.col("eps") == F.lit(eps)) & (F.col("least") == F.lit(least)), F.lit(False)).alias("chosen"))
    return means.unionByName(dense, allowMissingColumns=True)


def _plane(spark, sf):
    """Sums of the first and of the second half of the vectors' components."""
    total = lambda part: F.round(F.aggregate(part, F.lit(0.0), lambda a, x: a + x.cast("double")), 6)
    v, half = table(spark, sf, "embeddings"), F.expr("cast(size(embedding) / 2 as int)")
    return v.select("vec_id", total(F.slice("embedding", F.lit(1), half)).alias("first"), total(F.slice("embedding", half + 1, F.size("embedding"))).alias("second"))


def q_density(spark, sf):
    """Dense groups of vectors in the plane of the sums of the first and of the second half of their components."""
    return D.density_clusters(_plane(spark, sf), "vec_id", ["first", "second"], 0.1, 5)


def q_density_grid(spark, sf):
    """Settings of the density clusters with their noise and indices, and the one that the rule chooses."""
    _, grid = D.density_grid(_plane(spark, sf), "vec_id", ["first", "second"], EPS, LEAST)
    eps, least = D.choose_density(grid)
    return grid.select("eps", "least", "n_clusters", "noise", *(F.round(c, 5).alias(c) for c in ("noise_share", "silhouette", "davies_bouldin", "calinski_harabasz")), ((F.col("eps") == eps) & (F.col("least") == least)).alias("chosen"))


def q_cluster_profile(spark, sf):
    out = M.cluster_profile(_items(spark, sf), "cluster", ["quantity", "price"], ["has_return"], "day", "state")
    return out.select("cluster", "n", "n_states", iso("first").alias("first"), iso("last").alias("last"), F.round("has_return_rate", 6).alias("has_return_rate"), *(F.round(f"{c}_{k}", 4).alias(f"{c}_{k}") for c in ("quantity", "price") for k in ("mean", "median")), F.round("share", 6).alias("share"))


def q_feature_profile(spark, sf):
    out = M.feature_profile(_items(spark, sf), "cluster", FEATURES)
    return out.select("cluster", "feature", "n", F.round("mean", 5).alias("mean"), F.round("global_mean", 5).alias("global_mean"), F.round("ratio", 5).alias("ratio"), F.round("z", 5).alias("z"), F.round("median", 5).alias("median"), F.round("global_median", 5).alias("global_median"), F.round("least", 3).alias("least"), F.round("largest", 3).alias("largest"))


def q_report(spark, sf):
    return M.distinguishing(M.feature_profile(_items(spark, sf), "cluster", FEATURES, False), "cluster", 2)


def q_distribution(spark, sf):
    i = _items(spark, sf).withColumn("month", F.month("day"))
    return M.distribution(i, "cluster", "state").select("cluster", F.lit("state").alias("by"), F.col("state").alias("value"), "n", F.round("share", 6).alias("share")).union(M.distribution(i, "cluster", "month").select("cluster", F.lit("month"), "month", "n", F.round("share", 6)))


def q_matrix(spark, sf):
    out = M.profile_matrix(M.feature_profile(_items(spark, sf), "cluster", FEATURES, False), "cluster", FEATURES)
    return out.select("cluster", *(F.round(c, 4).alias(c) for c in FEATURES))


QUERIES = {"log_features": q_logs, "impute_families": q_impute, "standardize": q_standard, "fitted_models": q_fitted, "component_variance": q_variance, "component_loadings": q_loadings, "component_scores": q_scores, "som_nodes": q_som, "som_errors": q_som_errors, "node_clusters": q_node_clusters, "configurations": q_configurations, "density_clusters": q_density, "density_grid": q_density_grid, "cluster_profile": q_cluster_profile, "feature_profile": q_feature_profile, "profile_report": q_report, "cluster_distribution": q_distribution, "profile_matrix": q_matrix}
_I = "i AS (SELECT CAST(l_suppkey % 9 AS INTEGER) AS cluster, CAST(l_suppkey % 5 AS INTEGER) AS state, CAST(l_shipdate AS DATE) AS day, l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax, CAST(l_returnflag = 'R' AS INTEGER) AS has_return FROM lineitem)"
_FP = f"""{_I}, u AS (SELECT cluster, unnest(['quantity', 'price', 'discount', 'tax']) AS feature, unnest([quantity, price, discount, tax]) AS v FROM i), g AS (SELECT feature, avg(v) AS gm, stddev_samp(v) AS sd, quantile_cont(v, 0.5) AS gq FROM u GROUP BY 1),
c AS (SELECT cluster, u.feature, count(*) AS n, avg(v) AS m, min(v) AS least, max(v) AS largest, quantile_cont(v, 0.5) AS q FROM u GROUP BY 1, 2), f AS (SELECT c.*, gm, gq, m / gm AS ratio, (m - gm) / sd AS z FROM c JOIN g ON g.feature = c.feature)"""
_GRID = """WITH RECURSIVE d AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, CAST(len(embedding) // 2 AS BIGINT) AS h FROM embeddings), v AS (SELECT vec_id, round(coalesce(list_sum(e[1:h]), 0), 6) AS x, round(coalesce(list_sum(e[h + 1:]), 0), 6) AS y FROM d),
  s AS (SELECT * FROM (VALUES (CAST(0.1 AS DOUBLE)), (0.25)) AS e(eps), (VALUES (CAST(4 AS DOUBLE)), (8)) AS l(least)), two AS (SELECT p.vec_id AS a, q.vec_id AS b, (q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) AS d FROM v AS p, v AS q),
  near AS (SELECT eps, least, a, b FROM two, s WHERE d <= eps * eps), core AS (SELECT eps, least, a FROM near GROUP BY 1, 2, 3 HAVING count(*) >= least),
  dense AS (SELECT n.eps, n.least, n.a, n.b FROM near AS n JOIN core AS c ON (c.eps, c.least, c.a) = (n.eps, n.least, n.a) JOIN core AS g ON (g.eps, g.least, g.a) = (n.eps, n.least, n.b)),
  reach(eps, least, a, c) AS (SELECT eps, least, a, a FROM core UNION SELECT d.eps, d.least, d.b, r.c FROM reach AS r JOIN dense AS d ON (d.eps, d.least, d.a) = (r.eps, r.least, r.a) WHERE d.b > r.c),
  own AS (SELECT eps, least, a, min(c) AS c FROM reach GROUP BY 1, 2, 3), edge AS (SELECT n.eps, n.least, n.a, min(c) AS c FROM near AS n JOIN own AS o ON (o.eps, o.least, o.a) = (n.eps, n.least, n.b) GROUP BY 1, 2, 3),
  raw AS (SELECT s.eps, s.least, vec_id, x, y, coalesce(own.c, edge.c, -1) AS c FROM v CROSS JOIN s LEFT JOIN own ON (own.eps, own.least, own.a) = (s.eps, s.least, vec_id) LEFT JOIN edge ON (edge.eps, edge.least, edge.a) = (s.eps, s.least, vec_id)),
  sums AS (SELECT eps, least, count(DISTINCT CASE WHEN c <> -1 THEN c END) AS n_clusters, count_if(c = -1) AS noise, count(*) AS n FROM raw GROUP BY 1, 2),
  kept AS (SELECT r.* FROM raw AS r JOIN sums USING (eps, least) WHERE c <> -1 AND n_clusters > 1), mid AS (SELECT eps, least, c, count(*) AS n, avg(x) AS mx, avg(y) AS my FROM kept GROUP BY 1, 2, 3),
  far AS (SELECT k.eps, k.least, k.c, avg(sqrt((x - mx) * (x - mx) + (y - my) * (y - my))) AS scatter, sum((x - mx) * (x - mx) + (y - my) * (y - my)) AS inner_sum FROM kept AS k JOIN mid AS m ON (m.eps, m.least, m.c) = (k.eps, k.least, k.c) GROUP BY 1, 2, 3),
  worst AS (SELECT m.eps, m.least, m.c, max((f.scatter + g.scatter) / sqrt((m.mx - o.mx) * (m.mx - o.mx) + (m.my - o.my) * (m.my - o.my))) AS r FROM mid AS m JOIN mid AS o ON (o.eps, o.least) = (m.eps, m.least) AND o.c <> m.c JOIN far AS f ON (f.eps, f.least, f.c) = (m.eps, m.least, m.c) JOIN far AS g ON (g.eps, g.least, g.c) = (o.eps, o.least, o.c) GROUP BY 1, 2, 3),
  db AS (SELECT eps, least, avg(r) AS davies_bouldin FROM worst GROUP BY 1, 2), centre AS (SELECT eps, least, sum(n) AS n, count(*) AS k, sum(n * mx) / sum(n) AS gx, sum(n * my) / sum(n) AS gy FROM mid GROUP BY 1, 2),
  ch AS (SELECT c.eps, c.least, (sum(m.n * ((mx - gx) * (mx - gx) + (my - gy) * (my - gy))) / (any_value(c.k) - 1)) / (sum(f.inner_sum) / (any_value(c.n) - any_value(c.k))) AS calinski_harabasz FROM centre AS c JOIN mid AS m ON (m.eps, m.least) = (c.eps, c.least) JOIN far AS f ON (f.eps, f.least, f.c) = (m.eps, m.least, m.c) GROUP BY 1, 2),
  mean AS (SELECT p.eps, p.least, p.vec_id, p.c, q.c AS other, sum(d) AS total, count(*) AS n FROM kept AS p JOIN kept AS q ON (q.eps, q.least) = (p.eps, p.least) JOIN two ON two.a = p.vec_id AND two.b = q.vec_id GROUP BY 1, 2, 3, 4, 5),
  ab AS (SELECT eps, least, vec_id, max(CASE WHEN other = c THEN n END) AS own_n, max(CASE WHEN other = c THEN total / greatest(n - 1, 1) END) AS a, min(CASE WHEN other <> c THEN total / n END) AS b FROM mean GROUP BY 1, 2, 3),
  si AS (SELECT eps, least, avg(CASE WHEN own_n = 1 THEN 0 WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1 ELSE 0 END) AS silhouette FROM ab GROUP BY 1, 2),
  t AS (SELECT sums.eps, sums.least, n_clusters, noise, noise / n AS noise_share, silhouette, davies_bouldin, calinski_harabasz FROM sums LEFT JOIN si USING (eps, least) LEFT JOIN db USING (eps, least) LEFT JOIN ch USING (eps, least))
  SELECT eps, least, CAST(n_clusters AS INTEGER) AS n_clusters, CAST(noise AS DOUBLE) AS noise, round(noise_share, 5) AS noise_share, round(silhouette, 5) AS silhouette, round(davies_bouldin, 5) AS davies_bouldin, round(calinski_harabasz, 5) AS calinski_harabasz,
    row_number() OVER (ORDER BY n_clusters >= 2 DESC, noise_share <= 0.4 DESC, silhouette DESC NULLS LAST, noise_share, davies_bouldin NULLS LAST, eps, least) = 1 AS chosen FROM t"""
ORACLES = {
    "density_grid": _GRID,
    "log_features": "SELECT event_id, round(ln(1 + value), 6) AS log_count, (CAST(user_id % 30 AS DOUBLE) + user_id % 45) / 2 AS mean_temperature, CAST(user_id % 45 - user_id % 30 AS DOUBLE) AS amplitude FROM events",
    "impute_families": """WITH e AS (SELECT event_id, event_type AS s, month(ts) AS m, CASE WHEN event_id % 4 <> 0 THEN value END AS a, CASE WHEN event_id % 3 <> 0 THEN value END AS b, CASE WHEN event_id % 5 <> 0 THEN value / 2 END AS c, CASE WHEN event_id % 2 <> 0 THEN value * 3 END AS d FROM events)
  SELECT event_id, round(coalesce(a, 0), 3) AS seen, round(coalesce(b, quantile_cont(b, 0.5) OVER (PARTITION BY s, m), quantile_cont(b, 0.5) OVER (PARTITION BY s), quantile_cont(b, 0.5) OVER (), 0), 3) AS rain, round(coalesce(c, quantile_cont(c, 0.5) OVER (PARTITION BY s), quantile_cont(c, 0.5) OVER (), 0), 3) AS area, round(coalesce(d, quantile_cont(d, 0.5) OVER (), 0), 3) AS rest FROM e""",
    "fitted_models": """WITH i AS (SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS d, l_returnflag AS s, month(CAST(l_shipdate AS DATE)) AS m, CASE WHEN (l_orderkey + l_linenumber) % 3 <> 0 THEN l_quantity END AS q, CASE WHEN (l_orderkey + l_linenumber) % 4 <> 0 THEN l_extendedprice END AS p, CASE WHEN (l_orderkey + l_linenumber) % 5 <> 0 THEN l_discount END AS c, CASE WHEN (l_orderkey + l_linenumber) % 7 <> 0 THEN l_tax END AS t FROM lineitem),
  b AS (SELECT * FROM i WHERE d < DATE '1999-01-01'), sm AS (SELECT s, m, quantile_cont(q, 0.5) AS q FROM b GROUP BY 1, 2), st AS (SELECT s, quantile_cont(q, 0.5) AS q, quantile_cont(p, 0.5) AS p FROM b GROUP BY 1), al AS (SELECT quantile_cont(q, 0.5) AS q, quantile_cont(p, 0.5) AS p, quantile_cont(c, 0.5) AS c FROM b),
  f AS (SELECT i.*, coalesce(i.q, sm.q, st.q, al.q, 0) AS fq, coalesce(i.p, st.p, al.p, 0) AS fp, coalesce(i.c, al.c, 0) AS fc, coalesce(t, 0) AS ft FROM i CROSS JOIN al LEFT JOIN sm ON sm.s = i.s AND sm.m = i.m LEFT JOIN st ON st.s = i.s),
  g AS (SELECT avg(fq) AS mq, stddev_pop(fq) AS sq, avg(fp) AS mp, stddev_pop(fp) AS sp, min(fc) AS lc, max(fc) AS hc FROM f WHERE d < DATE '1999-01-01')
  SELECT l_orderkey, l_linenumber, round((fq - mq) / sq, 5) AS quantity, round((fp - mp) / sp, 5) AS price, round((fc - lc) / (hc - lc), 5) AS discount, round(ft, 5) AS tax FROM f, g""",
    "standardize": f"WITH {_I} SELECT " + ", ".join(f"CAST(0 AS DOUBLE) AS {c}_mean, CAST(1 AS DOUBLE) AS {c}_deviation, round((max({c}) - avg({c})) / stddev_pop({c}), 4) AS {c}_max" for c in FEATURES) + " FROM i",
    "density_clusters": """WITH RECURSIVE d AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, CAST(len(embedding) // 2 AS BIGINT) AS h FROM embeddings), v AS (SELECT vec_id, round(coalesce(list_sum(e[1:h]), 0), 6) AS x, round(coalesce(list_sum(e[h + 1:]), 0), 6) AS y FROM d),
  near AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v AS p JOIN v AS q ON (q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) <= 0.1 * 0.1), core AS (SELECT a FROM near GROUP BY a HAVING count(*) >= 5),
  dense AS (SELECT a, b FROM near WHERE a IN (SELECT a FROM core) AND b IN (SELECT a FROM core)), reach(a, c) AS (SELECT a, a FROM core UNION SELECT d.b, r.c FROM reach AS r JOIN dense AS d ON d.a = r.a WHERE d.b > r.c), own AS (SELECT a, min(c) AS c FROM reach GROUP BY a),
  edge AS (SELECT n.a, min(c) AS c FROM near AS n JOIN own ON own.a = n.b GROUP BY n.a), raw AS (SELECT vec_id, coalesce(own.c, edge.c, -1) AS c FROM v LEFT JOIN own ON own.a = vec_id LEFT JOIN edge ON edge.a = vec_id),
  k AS (SELECT c, row_number() OVER (ORDER BY count(*) DESC, c) AS label FROM raw WHERE c <> -1 GROUP BY c) SELECT vec_id, CAST(coalesce(label, -1) AS INTEGER) AS label FROM raw LEFT JOIN k ON k.c = raw.c""",
    "cluster_profile": f"WITH {_I} SELECT cluster, count(*) AS n, count(DISTINCT state) AS n_states, strftime(min(day), '%Y-%m-%d') AS first, strftime(max(day), '%Y-%m-%d') AS last, round(avg(has_return), 6) AS has_return_rate, round(avg(quantity), 4) AS quantity_mean, round(quantile_cont(quantity, 0.5), 4) AS quantity_median, round(avg(price), 4) AS price_mean, round(quantile_cont(price, 0.5), 4) AS price_median, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM i GROUP BY cluster",
    "feature_profile": f"WITH {_FP} SELECT cluster, feature, n, round(m, 5) AS mean, round(gm, 5) AS global_mean, round(ratio, 5) AS ratio, round(z, 5) AS z, round(q, 5) AS median, round(gq, 5) AS global_median, round(least, 3) AS least, round(largest, 3) AS largest FROM f",
    "profile_report": f"WITH {_FP}, r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY abs(z) DESC, feature) AS r FROM f) SELECT cluster, string_agg(printf('%s (z=%.2f)', feature, z), '; ' ORDER BY r) AS features FROM r WHERE r <= 2 GROUP BY 1",
    "cluster_distribution": f"WITH {_I} SELECT cluster, 'state' AS by, state AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY cluster), 6) AS share FROM i GROUP BY cluster, state UNION ALL SELECT cluster, 'month', CAST(month(day) AS INTEGER), count(*), round(count(*) / sum(count(*)) OVER (PARTITION BY cluster), 6) FROM i GROUP BY cluster, month(day)",
    "profile_matrix": f"WITH {_I} SELECT cluster, " + ", ".join(f"round(avg({c}), 4) AS {c}" for c in FEATURES) + " FROM i GROUP BY 1",
}
