import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.operators import density, fitted, fusion, graph, matching, models, publish, quality, ranking, sweep
from gridloom.sources import reports
from gridloom.staging import staged


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(10, 40)] + [(2, 1), (5, 5), (None, 3)], "src long, dst long")
    got = {r["node"]: r["component"] for r in graph.connected_components(e).collect()}
    assert got == {**{i: 10 for i in range(10, 41)}, 1: 1, 2: 1}
    assert graph.connected_components(e.filter("src < 0")).count() == 0


def test_weighted_mean_and_availability(spark):
    df = spark.createDataFrame([("a", 2.0, 3), ("a", None, 0), ("a", 5.0, 1), ("b", None, 0)], "k string, m double, c int")
    assert dict(df.groupBy("k").agg(fusion.weighted_mean("m", "c")).collect()) == {"a": 11 / 4, "b": None}
    base = spark.createDataFrame([("1994-05-01", None, 2), ("1996-05-01", None, None)], "day string, event_count long, detection_count long").withColumn("day", F.to_date("day"))
    got = fusion.availability(base, {"event": "event_count", "detection": "detection_count"}, ["detection_count"], ("event", "1995-01-01", "1998-12-31"), ["event_count"]).orderBy("day").collect()
    assert [(r["event_count"], r["detection_count"], r["source_mask"]) for r in got] == [(None, 2, "EVENT:0|DETECTION:1"), (0, 0, "EVENT:0|DETECTION:0")]


def test_dominant_takes_smaller_on_ties(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (2, None)], "k int, c string")
    got = {r["k"]: (r["dominant"], r["n_categories"]) for r in fusion.dominant(df, ["k"], "c").collect()}
    assert got == {1: ("a", 2), 2: ("c", 1)}


def test_dominant_when_sums_depend_on_the_order_of_rows(spark):
    """Rows come in another order whenever they are read, as they do from other machines."""

    def shuffled(batches):
        for b in batches:
            yield b.take(pa.array(np.random.default_rng().permutation(b.num_rows)))

    rows = [(k, c, w) for k in range(40) for c in "ab" for w in (1e16, 1.0, 3.0, 5.0, -1e16, 0.1)]
    df = spark.createDataFrame(rows, "k int, c string, w double").coalesce(1).mapInArrow(shuffled, "k int, c string, w double")
    before = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        found = fusion.dominant(df, ["k"], "c", F.col("w")).collect()
    finally:
        spark.conf.set("spark.sql.exchange.reuse", before)
    assert sorted(r["k"] for r in found) == list(range(40))


def test_unique_key_is_demanded(spark):
    df = spark.createDataFrame([(1, 2, 3), (2, 2, 3), (None, 4, None)], "k int, _n int, _row int")
    assert sorted(map(str, matching.one_of_each(df, ["k"], "t").collect())) == sorted(map(str, df.collect()))
    for twice in (df.union(df.filter("k = 1")), df.union(df.filter("k is null"))):
        with pytest.raises(Exception, match="repeats"):
            matching.one_of_each(twice, ["k"], "t").collect()


def test_reasons_and_contract(spark):
    df = spark.createDataFrame([(True, False), (False, False)], "a boolean, b boolean")
    assert [r[0] for r in df.select(matching.reasons(["a", "b"])).collect()] == ["a", None]
    with pytest.raises(ValueError):
        quality.stop_on_error(quality.check_unique(spark.createDataFrame([(1,), (1,)], "k int"), ["k"], "t"))


def test_running_id_is_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    got = ranking.running_id(df, ["v"], "n", 7).orderBy("v").collect()
    assert [r["n"] for r in got] == list(range(1, 1001))


def test_overlap_area_of_concave_shapes():
    ell = [np.array([(0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2)], float)]
    box = [np.array([(0.5, 0.5), (1.5, 0.5), (1.5, 1.5), (0.5, 1.5)], float)]
    diamond = [np.array([(1, 0), (2, 1), (1, 2), (0, 1)], float)]
    assert sweep.shared_area(ell, box) == pytest.approx(0.75)
    assert sweep.shared_area(ell, diamond) == pytest.approx(1.5)
    assert sweep.shared_area(diamond, [diamond[0] + 5]) == 0
    assert sweep.length_inside(np.array([(-1.0, 0.5, 3.0, 0.5)]), ell) == pytest.approx(2.0)
    half = sweep.clip_half(box[0], 0, 1.0, True)
    assert half[:, 0].min() == 1.0 and len(half) == 4


def test_som_and_labels(spark):
    rng = np.random.default_rng(0)
    rows = [(float(x), float(y)) for c in ((0, 0), (1, 1), (0, 1)) for x, y in rng.normal(c, 0.05, (60, 2))]
    df = spark.createDataFrame(rows, "a double, b double")
    som = models.SelfOrganisingMap(4, 4, ["a", "b"], epochs=6).fit(df)
    assert som.errors[-1] < som.errors[0]
    nodes = som.nodes(som.assign(df))
    assert nodes.count() == 16 and nodes.agg(F.sum("activation")).first()[0] == 180
    labels = density.density_clusters(df.withColumn("k", F.monotonically_increasing_id()), "k", ["a", "b"], 0.15, 5)
    sizes = {r[0]: r[1] for r in labels.groupBy("label").count().collect()}
    assert set(sizes) - {-1} == {1, 2, 3} and sizes.get(-1, 0) < 10


def test_choose_k(spark):
    t = spark.createDataFrame([(3, 0.9, 1.0, 5.0, 0.001, 0.9), (4, 0.5, 1.0, 5.0, 0.1, 0.4)], "k int, silhouette double, davies_bouldin double, calinski_harabasz double, smallest_share double, largest_share double")
    assert models.choose_k(t) == 4 and models.choose_k(t.filter("k = 3")) == 3


def test_standard_scores_and_components(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i + (i % 3), 5.0) for i in range(50)], "a double, b double, c double")
    out = models.standardize(df, ["a", "b", "c"])
    got = out.agg(F.stddev_pop("a"), F.avg("b"), F.max("c")).first()
    assert got[0] == pytest.approx(1) and got[1] == pytest.approx(0) and got[2] == 0
    scored, variance, loadings = models.components(out, ["a", "b"], 2)
    assert variance.agg(F.sum("ratio")).first()[0] == pytest.approx(1)
    assert scored.agg(F.avg("PC1")).first()[0] == pytest.approx(0)
    assert loadings.groupBy("component").agg(F.sum(F.col("loading") ** 2).alias("s")).agg(F.max("s")).first()[0] == pytest.approx(1)


def test_station_report(spark):
    text = "ESTACIÓN : 7\r\nSITUACIÓN: OPERANDO\n\nFECHA LLUVIA TMAX\n01/02/2003 1,5 30\n02/02/2003 NULO -9999\n03/02/2003 x\nFIN"
    f = spark.createDataFrame([("/a/dia00007.txt", text), ("/a/dia12.txt", "no table")], "path string, value string")
    got = reports.station_rows(f, ["rain", "tmax"], {"station": "ESTACION", "status": "SITUACION"}).orderBy("day").collect()
    assert [(r["station"], r["status"], str(r["day"]), r["rain"], r["tmax"]) for r in got] == [("00007", "OPERANDO", "2003-02-01", 1.5, 30.0), ("00007", "OPERANDO", "2003-02-02", None, None)]


def test_search_leaves_out_empty_conditions(spark):
    df = spark.createDataFrame([("A", 1), ("b", 5)], "n string, v int")
    assert publish.search(df, {"n": None}, {"n": ""}, {"v": (None, 3)}).count() == 1
    assert publish.search(df, like={"n": "B"}).first()["v"] == 5


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "k int, c string, v double")
    assert fusion.dominant(empty, ["k"], "c").count() == 0
    assert ranking.fill_medians(empty, ["v"], [["k"]]).count() == 0
    assert ranking.running_id(empty, ["k"]).count() == 0
    assert quality.profile(empty).filter("rows = 0").count() == 3


def test_medians_equal_sorted_lists(spark):
    r = np.random.default_rng(3)
    rows = [(g, float(v), float(i % 5) if i % 3 else None) for g, n in (("a", 4001), ("b", 300), ("c", 1), (None, 10)) for i, v in enumerate(r.normal(size=n).round(2))]
    df = spark.createDataFrame([*rows, ("d", None, None), ("b", float("inf"), 7.0)], "g string, x double, y double").repartition(5)
    got = {m["g"]: (m["_m_x"], m["_m_y"]) for m in ranking.medians(df, ["x", "y"], ["g"]).collect()}
    want = {}
    for g in ("a", "b", "c", None):
        xs, ys = ([v for v in (row[i] for row in [*rows, ("b", float("inf"), 7.0)] if row[0] == g) if v is not None] for i in (1, 2))
        want[g] = (float(np.median(xs)), float(np.median(ys)) if ys else None)
    assert got == want
    assert ranking.medians(df.filter("g = 'd'"), ["x"], ["g"]).count() == 0
    assert ranking.medians(df, ["x"], []).first()["_m_x"] == float(np.median([row[1] for row in rows] + [np.inf]))


def test_filled_medians_of_groups_without_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), ("b", None), (None, None)], "g string, x double")
    assert sorted((r["g"] or "", r["x"]) for r in ranking.fill_medians(df, ["x"], [["g"]]).collect()) == [("", 2.0), ("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 2.0)]
    assert [r["x"] for r in ranking.fill_medians(df.filter("g = 'b'"), ["x"], [["g"]]).collect()] == [0.0]


def test_repeated_keys_and_samples(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (1, None), (None, None), (None, None), (2, "x")], "k int, c string")
    got = sorted((r["k"] or 0, r["c"] or "", r["repeated"]) for r in ranking.flag_repeated(df, ["k", "c"]).collect())
    assert got == [(0, "", False), (0, "", False), (1, "", False), (1, "x", True), (1, "x", True), (2, "x", False)]
    ids = spark.range(20_000)
    part = ranking.hash_sample(ids, 0.25, ["id"])
    assert abs(part.count() - 5_000) < 300 and part.exceptAll(ranking.hash_sample(ids, 0.5, ["id"])).count() == 0
    assert ranking.hash_sample(ids, 1.0, ["id"]).count() == 20_000 and ranking.hash_sample(ids, 0.0, ["id"]).count() == 0


def test_deviations_of_large_means(spark):
    df = spark.createDataFrame([(i % 2, 1e9 + i % 4) for i in range(400)], "c int, v double")
    z = {r["c"]: r["z"] for r in models.feature_profile(df, "c", ["v"]).collect()}
    x = np.array([1e9 + i % 4 for i in range(400)])
    assert z[1] == pytest.approx(0.5 / x.std(ddof=1), rel=1e-6) and z[0] == pytest.approx(-z[1])


def dbscan(points, eps, least):
    """Labels by all pairs: dense rows joined, border rows with the group of the smallest dense key."""
    n = len(points)
    near = ((points[:, None] - points[None]) ** 2).sum(-1) <= eps * eps
    dense = near.sum(1) >= least
    group = np.arange(n)
    for _ in range(n):
        least_near = np.array([min(group[j] for j in np.flatnonzero(near[i] & dense)) if dense[i] else group[i] for i in range(n)])
        if (least_near == group).all():
            break
        group = least_near
    raw = [group[i] if dense[i] else min((group[j] for j in np.flatnonzero(near[i] & dense)), default=-1) for i in range(n)]
    sizes = sorted({g for g in raw if g >= 0}, key=lambda g: (-raw.count(g), g))
    return [sizes.index(g) + 1 if g >= 0 else -1 for g in raw]


@pytest.mark.parametrize("d, eps, least", [(2, 0.08, 4), (2, 0.3, 10), (3, 0.2, 3), (1, 0.01, 3), (5, 0.5, 3)])
def test_density_equals_all_pairs(spark, d, eps, least):
    """Two heaps that are apart by little more or less than eps, one place that many rows share, and scattered rows."""
    rng = np.random.default_rng(d)
    heap = rng.uniform(0, eps / 4, (60, d))
    near, far = heap.copy(), heap.copy()
    near[:, 0], far[:, 0] = 3 + heap[:, 0], 3 - eps * 0.999 - heap[:, 0]
    near[0, 0], far[0, 0] = 3, 3 - eps * 0.999
    near[0, 1:], far[0, 1:] = 0, 0
    points = np.concatenate([rng.random((120, d)), near, far, np.full((30, d), 5.0), near[:40] + 6, far[:40] + 6 - np.eye(1, d)[0] * eps * 0.01])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "k long, " + ", ".join(f"c{i} double" for i in range(d))).repartition(3)
    got = {r["k"]: r["label"] for r in density.density_clusters(df, "k", [f"c{i}" for i in range(d)], eps, least).collect()}
    assert [got[i] for i in range(len(points))] == dbscan(points, eps, least)


def test_density_writes_no_pairs_of_a_full_cell(spark):
    """Thousands of rows in one place and in the next cell: links stay few."""
    rng = np.random.default_rng(1)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 0.1, (4_000, 2)))] + [(9_000, None, 0.0), (9_001, float("nan"), 0.0), (9_002, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "k long, a double, b double")
    got = {r["k"]: r["label"] for r in density.density_clusters(df, "k", ["a", "b"], 0.1, 5).collect()}
    assert set(got.values()) == {1, -1} and sorted(k for k, v in got.items() if v == -1) == [9_000, 9_001, 9_002]
    core = df.filter("k < 9000").select(F.array(F.floor(F.col("a") / 0.07).cast("long"), F.floor(F.col("b") / 0.07).cast("long")).alias("cell"), F.col("a").alias("x0"), F.col("b").alias("x1"))
    assert density.linked_cells(core, ["x0", "x1"], 0.07, 0.1, density.offsets(2, 0.07, 0.1)).count() <= 6
    assert density.density_clusters(df.limit(0), "k", ["a", "b"], 0.1, 5).count() == 0


def test_choice_of_density(spark):
    t = lambda *rows: spark.createDataFrame(rows, density.GRID)
    noisy, few, good = (0.1, 4.0, 5, 50.0, 0.5, 0.9, 0.1, 9.0), (0.2, 4.0, 1, 0.0, 0.0, None, None, None), (0.3, 4.0, 2, 10.0, 0.1, 0.4, 0.5, 3.0)
    assert density.choose_density(t(noisy, few, good)) == (0.3, 4.0) and density.choose_density(t(noisy, few)) == (0.1, 4.0)
    with pytest.raises(ValueError):
        density.choose_density(t(few))


def test_quantiles_of_levels_equal_numpy(spark):
    """A group of a third of all rows and of few values, others of one row; plan without a buffer of values."""
    rng = np.random.default_rng(4)
    rows = [("hot", i % 2, float(v), float(w)) for i, (v, w) in enumerate(zip(rng.integers(0, 5, 900), rng.normal(size=900)))] + [(f"g{i % 40}", i % 3, float(v), None if i % 4 else float(v) / 3) for i, v in enumerate(rng.normal(size=700))] + [("one", 0, 2.5, None), (None, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, m int, x double, y double").repartition(5)
    ps = [0.01, 0.33, 0.5, 0.99]
    found = ranking.quantiles(df, ["x", "y"], [["g", "m"], ["g"], []], ps)
    assert found.count() == len({(r["_level"], r["_g"], r["_c"]) for r in found.collect()})
    for r in found.collect():
        same = [(x, y) for g, m, x, y in rows if r["_level"] == 2 or (g == r["_g"]["g"] and (r["_level"] == 1 or m == r["_g"]["m"]))]
        values = [v[0 if r["_c"] == "x" else 1] for v in same]
        values = [v for v in values if v is not None]
        assert r["_total"] == len(values) and r["_q"] == pytest.approx(np.quantile(values, ps))
    out = quality.profile(df, ["x", "y"])
    assert {r["column"]: r["median"] for r in out.collect()}["x"] == pytest.approx(np.median([r[2] for r in rows]))
    assert "percentile" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_quantiles_count_only_values_near_the_wanted_ranks(spark, monkeypatch):
    """As many different values as rows: a few of them are counted one by one, extremes and NaN included."""
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.lognormal(9, 1, 20_000), -rng.lognormal(2, 1, 3_000), [0.0, -0.0, 1e308, -1e308, np.inf, -np.inf, np.nan, 5e-324]])
    df = spark.createDataFrame([(i % 3, float(v)) for i, v in enumerate(values)], "g int, x double")
    rows = {}

    def counting(df, name="table"):
        out = staged(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(ranking, "staged", counting)
    ps = [0.1, 0.5]
    found = {r["_g"]["g"]: r["_q"] for r in ranking.quantiles(df, ["x"], [["g"], []], ps).collect()}
    assert rows["ranges"] < 1_500
    for g in (0, 1, 2, None):
        own = np.sort([v for i, v in enumerate(values) if g is None or i % 3 == g])
        place = (len(own) - 1) * np.array(ps)
        low, high = own[np.floor(place).astype(int)], own[np.ceil(place).astype(int)]
        assert found[g] == pytest.approx(list(low + (place % 1) * (high - low)))


def test_samples_are_whole_and_layouts_do_not_matter(spark):
    rows = [(i % 700, "abc"[(i > 500) + (i > 900)], i) for i in range(1000)] + [(5, None, 5)] * 3
    df = spark.createDataFrame(rows, "_start int, g string, _digest long")
    for n in (0, 1, 77, 5_000):
        took = [sorted(map(str, ranking.fixed_sample(df.repartition(k), n, ["_start"]).collect())) for k in (1, 4)]
        assert took[0] == took[1] and len(took[0]) == min(n, len(rows))
    quotas = {r["g"]: r["quota"] for r in ranking.largest_remainder(df.groupBy("g").agg(F.count("*").alias("size")), "g", 100).collect()}
    assert sum(quotas.values()) == 100 and quotas == {"a": 50, "b": 40, "c": 10, None: 0}
    got = ranking.proportional_sample(df, "g", 100, 45, ["_start"]).groupBy("g").count().collect()
    assert dict(map(tuple, got)) == {"a": 45, "b": 40, "c": 10}


def test_text_key_is_computed_once(spark):
    from gridloom.functions.text import text_key

    df = spark.createDataFrame([("  Ácme, Inc. ",), ("--",), (None,), ("OLD  name",)], "t string").select(text_key(F.col("t"), {"old name": "new", "x": "y"}).alias("k"))
    assert [r["k"] for r in df.collect()] == ["acme inc", None, None, "new"]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1


def test_fits_are_saved_loaded_and_applied_to_other_rows(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(i, "st"[i % 2], i % 3, None if i % 5 == 0 else float(a), None if i % 7 == 0 else float(b), float(a + 2 * b), 1.0) for i, (a, b) in enumerate(rng.normal(size=(200, 2)))]
    df = spark.createDataFrame(rows, "k long, state string, month int, a double, b double, c double, d double")
    old, new = df.filter("k < 150"), df.filter("k >= 100").union(spark.createDataFrame([(900, "unseen", 9, None, None, 0.5, 2.0), (901, None, None, None, 1.0, 0.5, None)], df.schema))
    imputer = fitted.fit_imputer(old, {"a": "weather", "b": "context", "d": "detection"}, "state", "month")
    filled = imputer.apply(old)
    fits = [imputer, fitted.fit_standard(filled, ["a", "b"]), fitted.fit_ranges(filled, ["c", "d"])]
    fits.append(fitted.fit_components(fitted.apply_all(fits, old), ["a", "b", "c"], least=0.5))
    fits.append(fitted.fit_map(fitted.apply_all(fits, old), ["PC1"], 3, 2, 3))
    for i, f in enumerate(fits):
        f.save(f"file://{tmp_path}/{i}")
    loaded = [fitted.Fitted.load(spark, f"file://{tmp_path}/{i}") for i in range(len(fits))]
    once, again = (sorted(map(str, fitted.apply_all(f, new).collect())) for f in (fits, loaded))
    assert once == again and len(once) == 102
    # one fit used on its own rows gives what the single step gives
    assert sorted(map(str, imputer.apply(old).collect())) == sorted(map(str, models.impute(old, {"a": "weather", "b": "context", "d": "detection"}, "state", "month").select(*old.columns).collect()))
    assert sorted(map(str, fits[1].apply(filled).collect())) == sorted(map(str, models.standardize(filled, ["a", "b"]).collect()))
    ready = fitted.apply_all(fits[:3], old)
    scores = {r["k"]: r["PC1"] for r in models.components(ready, ["a", "b", "c"], 1)[0].collect()}
    assert {r["k"]: r["PC1"] for r in fits[3].apply(ready).collect()} == pytest.approx(scores)
    medians = {(s, m): np.median([r[3] for r in rows[:150] if r[3] is not None and r[1] == s and r[2] == m]) for s in "st" for m in range(3)}
    overall = np.median([r[3] for r in rows[:150] if r[3] is not None])
    for r in imputer.apply(new).collect():
        given = dict((x[0], x[3]) for x in rows).get(r["k"])
        assert r["a"] == pytest.approx(given if given is not None else medians.get((r["state"], r["month"]), overall)) and r["d"] is not None
    with pytest.raises(Exception):
        fits[1].save(f"file://{tmp_path}/1")


def test_staged_tables_leave_no_shuffle_files(spark):
    """The shuffle files of a staged write go when it ends; the session's own settings come back."""
    import time

    from pyspark.sql import functions as F

    from gridloom.staging import staged

    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for i in range(files.size()) if (f := files.apply(i).getName()).startswith("shuffle_")}

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = shuffled(), spark.conf.get(key)
    rows = spark.range(10_000).repartition(7).groupBy((F.col("id") % 10).alias("k")).count()
    out = staged(rows)
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.2)
    assert not shuffled() - before and spark.conf.get(key) == setting
    assert out.count() == 10 and rows.count() == 10
