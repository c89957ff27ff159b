"""Density clusters with noise by a grid of cells, a grid of settings, and the rule that chooses one.

Cells are so small that all their rows are neighbours. A cell that holds enough of them is dense by its count alone,
rows of other cells are counted, and cells are linked, not rows: what is compared are boxes around rows, which are cut
finer only where they don't decide.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.graph import connected_components
from gridloom.operators.models import assemble, cluster_scores
from gridloom.operators.ranking import renumber
from gridloom.staging import release, staged

#: Boxes that a cell is cut into at most in one round, and the columns that make cells.
BOXES, INDEXED = 256, 3


def offsets(dimensions: int, side: float, eps: float) -> list[tuple[int, ...]]:
    """Steps to the cells that may hold neighbours of a cell's rows, itself included."""
    most = int(eps / side) + 1
    apart = lambda step: sum((max(abs(k) - 1, 0) * side) ** 2 for k in step)
    return [s for s in product(range(-most, most + 1), repeat=dimensions) if apart(s) <= eps * eps * (1 + 1e-9)]


def square(a: list[str], b: list[str]) -> Column:
    return sum(((F.col(p) - F.col(q)) * (F.col(p) - F.col(q)) for p, q in zip(a, b)), F.lit(0.0))


def decided(batches: Iterator[pa.RecordBatch], d: int, eps: float) -> Iterator[pa.RecordBatch]:
    """(a, b, box_a, box_b, linked) of pairs of cells: linked, or the pairs of boxes that may still link them."""
    for batch in batches:
        out: list[tuple] = []
        for a, b, mine, other in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "mine", "other"))):
            p, q = (np.array([[*x["low"], *x["high"], *x["one"]] for x in boxes]).reshape(-1, 3, d) for boxes in (mine, other))
            if (((p[:, None, 2] - q[None, :, 2]) ** 2).sum(-1) <= eps * eps).any():
                out.append((a, b, None, None, True))
                continue
            gap = np.maximum(np.maximum(p[:, None, 0] - q[None, :, 1], q[None, :, 0] - p[:, None, 1]), 0)
            single = (p[:, 0] == p[:, 1]).all(-1)[:, None] & (q[:, 0] == q[:, 1]).all(-1)[None]
            for i, j in np.argwhere(((gap**2).sum(-1) <= eps * eps) & ~single):
                out.append((a, b, mine[i]["box"], other[j]["box"], False))
        cells = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], cells), pa.array([r[1] for r in out], cells), pa.array([r[2] for r in out], pa.string()), pa.array([r[3] for r in out], pa.string()), pa.array([r[4] for r in out], pa.bool_())], ["a", "b", "box_a", "box_b", "linked"])


def linked_cells(core: DataFrame, x: list[str], side: float, eps: float, steps: list[tuple[int, ...]]) -> DataFrame:
    """(a, b): pairs of cells of which two dense rows lie within ``eps``.

    Boxes of each cell hold the bounds of their rows and one row. Two such rows within reach link the cells; bounds out
    of reach, or single places, settle a pair of boxes; the rest is cut into finer boxes in the next round.
    """
    d = len(x)
    cuts = max(2, int(BOXES ** (1 / d) + 1e-9))
    half = [s for s in steps if s > (0,) * d]
    cells = core.select("cell").distinct()
    ahead = cells.select(F.col("cell").alias("a"), F.explode(F.array(*(F.array(*((F.col("cell")[i] + k).cast("long") for i, k in enumerate(s))) for s in half))).alias("b"))
    open_pairs = staged(ahead.join(cells.select(F.col("cell").alias("b")), "b").select("a", "b", F.lit("").alias("box_a"), F.lit("").alias("box_b")), "open")
    rows, found, level = core.select("cell", *x).withColumn("box", F.lit("")), [], 0
    while not open_pairs.isEmpty():
        level += 1
        width = side / cuts**level
        wanted = open_pairs.select(F.col("a").alias("cell"), F.col("box_a").alias("box")).union(open_pairs.select("b", "box_b")).distinct()
        inner = F.concat_ws(",", "box", *(F.floor(F.col(c) / width).cast("string") for c in x))
        finer = staged(rows.join(wanted, ["cell", "box"]).withColumn("inner", inner), "boxed")
        bounds = finer.groupBy("cell", "box", "inner").agg(F.array(*(F.min(c) for c in x)).alias("low"), F.array(*(F.max(c) for c in x)).alias("high"), F.min(F.array(*x)).alias("one"))
        boxes = staged(bounds.groupBy("cell", "box").agg(F.collect_list(F.struct(F.col("inner").alias("box"), "low", "high", "one")).alias("boxes")), "boxes")
        mine = boxes.select(F.col("cell").alias("a"), F.col("box").alias("box_a"), F.col("boxes").alias("mine"))
        other = boxes.select(F.col("cell").alias("b"), F.col("box").alias("box_b"), F.col("boxes").alias("other"))
        met = open_pairs.join(mine, ["a", "box_a"]).join(other, ["b", "box_b"]).select("a", "b", "mine", "other")
        told = staged(met.mapInArrow(lambda batches: decided(batches, d, eps), "a array<long>, b array<long>, box_a string, box_b string, linked boolean"), "decided")
        release(boxes, open_pairs)
        linked = told.filter("linked").select("a", "b").distinct()
        found.append(staged(linked, "links"))
        rest = told.filter("not linked").select("a", "b", "box_a", "box_b").join(found[-1], ["a", "b"], "left_anti")
        open_pairs = staged(rest, "open")
        release(told)
        if level > 1:
            release(held)
        held, rows = finer, finer.select("cell", *x, F.col("inner").alias("box"))
    release(open_pairs)
    out = found[0] if found else cells.select(F.col("cell").alias("a"), F.col("cell").alias("b")).limit(0)
    for more in found[1:]:
        out = out.union(more)
    return out


def density_clusters(df: DataFrame, key: str, columns: list[str], eps: float, least: float, weight: str | None = None) -> DataFrame:
    """(key, label): groups of dense rows within ``eps`` of each other, border rows with them, -1 for noise.

    A row is dense if rows within ``eps``, itself included, weigh ``least`` or more. A border row takes the group of the
    smallest dense key among those that reach it. Labels count from 1 by weight. Rows with a null or NaN column are
    noise; keys have to be unique. Of rows of more than three columns (codebooks) each pair within reach in the first
    three is compared.
    """
    n = len(columns)
    x = [f"x{i}" for i in range(n)]
    whole = n <= INDEXED
    side = eps / math.sqrt(n) * (1 - 1e-9) if whole else eps
    known = F.lit(True)
    for c in columns:
        known = known & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    base = staged(df.select(F.col(key).alias("k"), *(F.col(c).cast("double").alias(v) for c, v in zip(columns, x)), (F.col(weight) if weight else F.lit(1)).alias("w"), known.alias("known")), "points")
    at = F.array(*(F.floor(F.col(v) / side).cast("long") for v in x[:INDEXED]))
    points = base.filter("known").withColumn("cell", at)
    steps = offsets(min(n, INDEXED), side, eps)
    full = staged(points.groupBy("cell").agg(F.sum("w").alias("total")).filter(F.col("total") >= least).select("cell"), "full") if whole else None
    sparse = points.join(full, "cell", "left_anti") if whole else points
    near_cells = F.explode(F.array(*(F.array(*((F.col("cell")[i] + k).cast("long") for i, k in enumerate(s))) for s in steps)))
    asked = sparse.select(F.col("k").alias("a"), *(F.col(v).alias(f"a{v}") for v in x), near_cells.alias("cell"))
    within = square(x, [f"a{v}" for v in x]) <= eps * eps
    counted = asked.join(points, "cell").filter(within).groupBy("a").agg(F.sum("w").alias("total")).filter(F.col("total") >= least).select(F.col("a").alias("k"))
    dense = points.join(counted, "k", "left_semi")
    core = staged(points.join(full, "cell", "left_semi").unionByName(dense) if whole else dense, "core")
    if whole:
        links = linked_cells(core, x, side, eps, steps)
        named = core.groupBy("cell").agg(F.min("k").alias("first"))
        ends = links.join(named.select(F.col("cell").alias("a"), F.col("first").alias("src")), "a").join(named.select(F.col("cell").alias("b"), F.col("first").alias("dst")), "b").select("src", "dst")
        parts = connected_components(ends)
        by_cell = named.join(parts, named["first"] == parts["node"], "left").select("cell", F.coalesce("component", "first").alias("component"))
        labelled = staged(core.join(by_cell, "cell"), "labelled")
    else:
        pairs = core.select(F.col("k").alias("src"), *(F.col(v).alias(f"a{v}") for v in x), near_cells.alias("cell")).join(core, "cell").filter(within & (F.col("src") < F.col("k"))).select("src", F.col("k").alias("dst"))
        parts = connected_components(pairs)
        labelled = staged(core.join(parts, core["k"] == parts["node"], "left").select(core["*"], F.coalesce("component", "k").alias("component")), "labelled")
    border = asked.join(labelled.select("k", "cell", *x, "component"), "cell").filter(within).groupBy("a").agg(F.min("component").alias("reach"))
    own = labelled.select(F.col("k").alias("own_k"), "component")
    out = base.select("k", "w").join(own, F.col("k") == F.col("own_k"), "left").join(border, F.col("k") == F.col("a"), "left").withColumn("raw", F.coalesce("component", "reach", F.lit(-1)))
    return renumber(out, "raw", F.col("w"), noise=-1, name="label").select(F.col("k").alias(key), "label")


GRID = "eps double, least double, n_clusters int, noise double, noise_share double, silhouette double, davies_bouldin double, calinski_harabasz double"


def density_grid(df: DataFrame, key: str, columns: list[str], eps: list[float], least: list[float], weight: str | None = None) -> tuple[dict[tuple[float, float], DataFrame], DataFrame]:
    """Labels of each setting, and a table of settings with clusters, weight and share of noise, and indices of the rest.

    Indices are null with fewer than two clusters. The silhouette is that of squared distances, one pass over the rows.
    """
    labels, rows = {}, []
    for e, n in product(eps, least):
        found = staged(density_clusters(df, key, columns, e, n, weight), "density")
        labels[e, n] = found
        own = df.join(found, key)
        w = F.col(weight) if weight else F.lit(1)
        clusters, noise, total = own.agg(F.countDistinct(F.when(F.col("label") > 0, F.col("label"))), F.coalesce(F.sum(F.when(F.col("label") == -1, w)), F.lit(0)), F.coalesce(F.sum(w), F.lit(0))).first()
        indices = (None, None, None)
        if clusters > 1:
            kept = own.filter("label > 0")
            other = cluster_scores(kept, columns, "label").first()
            indices = (ClusteringEvaluator(predictionCol="label", featuresCol="features").evaluate(assemble(kept, columns)), other[1], other[2])
        rows.append((float(e), float(n), clusters, float(noise), float(noise) / float(total) if total else None, *indices))
    return labels, df.sparkSession.createDataFrame(rows, GRID)


def choose_density(table: DataFrame, most_noise: float = 0.4) -> tuple[float, float]:
    """(eps, least) of the best setting: two clusters at least, noise within bounds if any setting keeps to them, then the
    best silhouette, the least noise, the least Davies-Bouldin index, and the smallest values."""
    best = table.filter("n_clusters >= 2").orderBy(F.desc(F.col("noise_share") <= most_noise), F.desc_nulls_last("silhouette"), "noise_share", F.asc_nulls_last("davies_bouldin"), "eps", "least").first()
    if best is None:
        raise ValueError("no setting gives two clusters")
    return best["eps"], best["least"]
