import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import nn_descent, va_search
from gridloom.staging import staged
from tests.compare import connection, differences

SCHEMA = "vec_id long, embedding array<float>, label int, gid long, v string"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(300, 8)) * rng.uniform(0.5, 2, (300, 1))
    x[100:160] = x[7]  # one common vector
    rows = [(i, [float(c) for c in v], 0, i, "x") for i, v in enumerate(x.astype(np.float32))]
    rows += [(300, None, 0, 0, ""), (301, [1.0, None] * 4, 0, 0, ""), (302, [math.nan] * 8, 0, 0, ""), (303, [math.inf] * 8, 0, 0, ""), (304, [], 0, 0, ""), (305, [0.0] * 8, 0, 0, ""), (306, [1.0, 2.0], 0, 0, ""), rows[3], (None, [1.0] * 8, 0, 0, "")]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def usable(vectors, zero):
    rows = {r["vec_id"]: r["embedding"] for r in vectors.collect()}
    return {i: np.array(e, float) for i, e in rows.items() if i is not None and e is not None and len(e) == 8 and all(c is not None and math.isfinite(c) for c in e) and (zero or any(e))}


def check(got, x, queries, k, score):
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(by) == set(queries)
    for q in queries:
        want = sorted((-score(x[q], v), i) for i, v in x.items() if i != q)[:k]
        assert [(n + 1, i) for n, (_, i) in enumerate(want)] == [(a, b) for a, b, _ in sorted(by[q])]
        assert [s for _, _, s in sorted(by[q])] == pytest.approx([-s for s, _ in want], abs=1e-12)


@pytest.mark.parametrize("k,block", [(5, 4096), (5, 7), (400, 4096)])
def test_exact_search(vectors, k, block):
    x = usable(vectors, True)
    whole = {i: np.floor(256 * v) for i, v in x.items()}
    got = va_search.top_k(vectors, vectors.filter("vec_id % 10 = 0 or vec_id is null"), k, block=block).collect()
    check(got, whole, [i for i in x if i % 10 == 0], k, lambda a, b: int(a @ b))


def test_large_integers(spark):
    rows = [(i, [1e9 * (i + 1), -3e8]) for i in range(3)]
    got = va_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), spark.createDataFrame(rows[:1], "vec_id long, embedding array<double>"), 2).collect()
    q = [int(256 * 1e9), int(256 * -3e8)]
    assert got[0]["vec_id"] == 1 and got[0]["score"] == min(q[0] * int(256 * 2e9) + q[1] * q[1], 2**63 - 1) or got[0]["score"] == 2**63 - 1


def test_neighbour_search_with_copies_and_unequal_norms(vectors):
    x = usable(vectors, False)
    by = {}
    for r in nn_descent.nearest(vectors, vectors.filter("vec_id % 20 = 0"), 20).collect():
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(by) == {i for i in x if i % 20 == 0}
    hits = 0
    for q, rows in by.items():
        rows.sort()
        assert [a for a, _, _ in rows] == list(range(1, 21)) and q not in {i for _, i, _ in rows}
        assert [s for _, _, s in rows] == pytest.approx([float(x[q] @ x[i]) for _, i, _ in rows], abs=1e-12)
        assert rows == sorted(rows, key=lambda r: (-r[2], r[1]))
        hits += len({i for _, i, _ in rows} & {i for _, i in sorted((-float(x[q] @ v), i) for i, v in x.items() if i != q)[:20]})
    assert hits >= 0.9 * 20 * len(by)


def found_share(df, x, every, **options):
    """The share of each query's exact 20 nearest that the search found."""
    got = nn_descent.nearest(df, df.filter(f"vec_id % {every} = 0"), 20, **options).collect()
    found = {}
    for r in got:
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    s = x[::every].astype(float) @ x.T.astype(float)
    s[np.arange(len(s)), np.arange(0, len(x), every)] = -np.inf
    return sum(len(found[q] & set(np.argsort(-row)[:20].tolist())) for q, row in zip(range(0, len(x), every), s)) / (20 * len(s))


def frame(spark, x):
    return spark.createDataFrame([(i, v) for i, v in enumerate(x.astype(np.float32).tolist())], "vec_id long, embedding array<float>")


def test_recall_on_clusters_and_unequal_norms(spark):
    rng = np.random.default_rng(12)
    x = (rng.normal(size=(3000, 16)) + 2 * rng.normal(size=(20, 16))[rng.integers(0, 20, 3000)]).astype(np.float32)
    assert found_share(frame(spark, x), x, 50) >= 0.95
    y = (rng.normal(size=(4000, 48)) * rng.uniform(0.5, 2, (4000, 1))).astype(np.float32)
    assert found_share(frame(spark, y), y, 100) >= 0.9


def test_descent_makes_the_graph(spark):
    """The share of exact neighbours in the lists after the start alone, and when few lists change."""
    from gridloom.llm.vectors import packed
    from gridloom.llm.vectors import usable as valid
    from gridloom.staging import staged

    rng = np.random.default_rng(13)
    x = (rng.normal(size=(4000, 48)) * rng.uniform(0.5, 2, (4000, 1))).astype(np.float32).astype(float)
    limit = float((x * x).sum(1).max())
    codes = staged(nn_descent.coded(packed(valid(frame(spark, x), "vec_id", "embedding")).withColumnRenamed("id", "gid"), limit, 1.0), "codes")
    more = np.column_stack([x, np.sqrt(limit - (x * x).sum(1))])
    near = more @ more.T - (more * more).sum(1) / 2
    np.fill_diagonal(near, -np.inf)
    exact = np.argsort(-near, axis=1)[:, : nn_descent.DEGREE]
    shares = []
    for rounds in (0, nn_descent.MOST_ROUNDS):
        lists = {}
        for r in nn_descent.build_graph(codes, len(x), 49, most_rounds=rounds).collect():
            lists.setdefault(r["a"], set()).add(r["b"])
        shares.append(np.mean([len(lists[i] & set(e.tolist())) / len(e) for i, e in enumerate(exact)]))
    assert shares[1] >= shares[0] + 0.2 and shares[1] >= 0.8, shares


def test_recall_on_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rows = sorted((r["vec_id"], r["embedding"]) for r in df.collect())
    assert [i for i, _ in rows] == list(range(len(rows)))
    assert found_share(df, np.array([v for _, v in rows], np.float32), 20) >= 0.95


@pytest.mark.parametrize("search", [va_search.top_k, nn_descent.nearest])
def test_a_vector_of_another_length_takes_no_part(spark, search):
    rows = [(i, [float(i + 1), 1.0]) for i in range(50)] + [(100, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = search(df, df.filter("vec_id % 50 = 0"), 5).collect()
    assert {r["query_id"] for r in got} == {0} and [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"])] == [49, 48, 47, 46, 45]


def test_no_vectors(vectors):
    none = vectors.filter("vec_id < 0")
    assert va_search.top_k(none, none).count() == 0 and nn_descent.nearest(none, none).count() == 0
    assert va_search.top_k(vectors, none).count() == 0 and nn_descent.nearest(vectors, none).count() == 0


def test_exact_query_equals_sql(spark):
    from gridloom.llm.queries import ORACLES, QUERIES

    sf = "/root/testdata/sf0.01"
    assert differences(spark, connection(sf), sf, QUERIES["op8_exact_top_k"], ORACLES["op8_exact_top_k"]) == ""


def test_neighbour_search_beside_a_few_large_vectors(spark):
    """Vectors a thousand times longer than the others are found, and don't hide the differences among the others."""
    rng = np.random.default_rng(15)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[[11, 500, 2001]] *= 1000
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    asked = [i for i in range(0, 3000, 50) if i != 500]
    got = nn_descent.nearest(df, df.filter("vec_id % 50 = 0 and vec_id <> 500"), 20).collect()
    found = {q: {r["vec_id"] for r in got if r["query_id"] == q} for q in asked}
    score = x.astype(float) @ x.astype(float).T
    np.fill_diagonal(score, -np.inf)
    hits = sum(len(found[q] & set(np.argsort(-score[q])[:20].tolist())) for q in asked)
    assert hits >= 0.9 * 20 * len(asked), hits / (20 * len(asked))


def test_first_rows_of_a_key_that_half_of_all_rows_hold(spark):
    rng = np.random.default_rng(16)
    key, value = np.where(rng.random(30_000) < 0.5, 7, rng.integers(0, 900, 30_000)), rng.integers(0, 50, 30_000)
    rows = spark.createDataFrame(list(zip(key.tolist(), value.tolist(), range(30_000))), "a long, s long, b long").repartition(6)
    got = sorted(map(tuple, nn_descent.first_of_each(rows, "a", [F.desc("s"), "b"], 5).collect()))
    want = {}
    for a, s, b in sorted(zip(key.tolist(), value.tolist(), range(30_000)), key=lambda r: (r[0], -r[1], r[2])):
        want.setdefault(a, []).append((a, s, b))
    assert got == sorted(r for rs in want.values() for r in rs[:5])
    assert nn_descent.first_of_each(rows.limit(0), "a", ["b"], 5).count() == 0


def test_graph_around_a_hub_that_all_nodes_list(spark):
    """Points on a sphere all have its centre as their nearest neighbour; the centre's lists stay short."""
    rng = np.random.default_rng(17)
    x = rng.normal(size=(2_000, 24))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype("f4")
    x[0] = 0
    codes = spark.createDataFrame([(i, v.tobytes()) for i, v in enumerate(x)], "gid long, code binary")
    edges = nn_descent.build_graph(codes, len(x), 24)
    lists = {}
    for r in edges.collect():
        lists.setdefault(r["a"], set()).add(r["b"])
    assert sum(0 in b for b in lists.values()) >= 0.9 * len(x)
    assert all(len(b) == nn_descent.DEGREE for b in lists.values())
    near = {r["a"]: r["near"] for r in nn_descent.adjacency(edges).collect()}
    assert len(near) == len(x) and max(map(len, near.values())) <= 2 * nn_descent.DEGREE


def test_a_search_goes_on_while_it_finds_nearer_vectors(spark):
    """More patience finds no less, and with none a query still has what stands around its start."""
    rng = np.random.default_rng(18)
    x = (rng.normal(size=(6_000, 48)) * rng.uniform(0.5, 2, (6_000, 1))).astype(np.float32)
    df = frame(spark, x)
    little, more = (found_share(df, x, 100, patience=p, beam=16) for p in (16, 256))
    assert little < more and more >= 0.93, (little, more)


def test_scored_pairs_do_not_follow_the_number_of_tasks(spark, monkeypatch):
    """Each pair of a query and a node is a row; lists packed in each task would be more with more tasks."""
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(150, 4)))], "vec_id long, embedding array<double>")
    plans = []

    def noted(table, name="table"):
        if name == "search":
            plans.append(table._jdf.queryExecution().analyzed().toString())
        return staged(table, name)

    monkeypatch.setattr(nn_descent, "staged", noted)
    assert nn_descent.nearest(df, df.filter("vec_id < 2"), 3, trees=1, most_rounds=1).count() == 6
    assert plans and all(re.search(r"MapInArrow partial\(.*\)\S*, \[q#\w+, gid#\w+, s#\w+\]", p) for p in plans)
