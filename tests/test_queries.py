import numpy as np
import pytest

from gridloom.plans import registered
from tests.compare import connection, differences

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registered()


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, name):
    assert differences(spark, con, SF, QUERIES[name], ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert len(QUERIES[name](spark, SF).take(1)) == 1


def test_components_equal_numpy(spark):
    vectors = np.array([list(map(float, r[0])) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("embedding").collect()])
    values, axes = np.linalg.eigh(np.corrcoef(vectors.T))
    values, axes = values[::-1], axes[:, ::-1]
    n = len(vectors)
    rows = sorted(QUERIES["component_variance"](spark, SF).collect(), key=lambda r: r["component"])
    assert [r["variance"] for r in rows] == pytest.approx(values * n / (n - 1), abs=2e-4)
    assert [r["cumulative"] for r in rows] == pytest.approx(np.cumsum(values) / values.sum(), abs=2e-5)
    first = {r["feature"]: r["loading"] for r in QUERIES["component_loadings"](spark, SF).filter("component = 1").collect()}
    assert len(first) == vectors.shape[1]
    assert abs(sum(first[f"e{i}"] * axes[i, 0] for i in range(len(first)))) == pytest.approx(1, abs=1e-3)


def test_maps_and_clusters_hold_all_rows(spark):
    n = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    nodes = QUERIES["som_nodes"](spark, SF).collect()
    assert len(nodes) == 36 and sum(r["activation"] for r in nodes) == n and all(r["occupied"] == (r["activation"] > 0) for r in nodes)
    assert {(r["som_x"], r["som_y"]) for r in nodes} == {(i, j) for i in range(6) for j in range(6)} and all(r["u_distance"] >= 0 for r in nodes)
    errors = QUERIES["som_errors"](spark, SF).first()
    assert errors["quantization_error"] > 0 and 0 <= errors["topographic_error"] <= 1 and errors["error_fell"]
    clusters = sorted((r["cluster"], r["n"]) for r in QUERIES["node_clusters"](spark, SF).collect())
    assert sum(k for _, k in clusters) == n and [c for c, _ in clusters] == list(range(1, len(clusters) + 1)) and [k for _, k in clusters] == sorted((k for _, k in clusters), reverse=True)


def test_scores_reach_ninety_percent_and_stay_in_range(spark):
    rows = QUERIES["component_scores"](spark, SF)
    variance = sorted((r["component"], r["ratio"]) for r in QUERIES["component_variance"](spark, SF).collect())
    needed = next(i for i, _ in enumerate(variance, 1) if sum(r for _, r in variance[:i]) >= 0.9 - 1e-4)
    assert abs(len(rows.columns) - 1 - needed) <= 1
    for c in rows.columns[1:]:
        values = [r[0] for r in rows.select(c).collect()]
        assert min(values) == 0 and max(values) == 1


def test_configurations_choose_one_of_each_kind(spark):
    rows = QUERIES["configurations"](spark, SF).collect()
    assert sorted((r["model"], r["setting"]) for r in rows) == [("density", "eps=0.50, least=10"), ("density", "eps=0.60, least=10"), ("kmeans", "k=3"), ("kmeans", "k=4"), ("kmeans", "k=5")]
    assert sum(r["chosen"] for r in rows if r["model"] == "kmeans") == 1 and sum(r["chosen"] for r in rows if r["model"] == "density") <= 1
    assert all(r["clusters"] == int(r["setting"][2:]) for r in rows if r["model"] == "kmeans")
