"""Exact top-k search over vector-approximation files.

Each vector has an approximation of one byte a component: its cell between the least and largest value of the
component. A scan of the cells bounds every score from both sides. The (k+1)th best lower bound of a query, found in
the first scan, leaves few vectors in the second one; exact vectors are then read in order of their bounds, the first
k + 1 of each query at once, and beyond them only those whose bound reaches the kth exact score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.vectors import common_width, grouped, matrix, packed, usable
from gridloom.staging import staged

CELLS = 256
#: Queries that one scan serves; their vectors (8 bytes a component) are what a task gets from the driver.
QUERY_BLOCK = 4_096
PARTS = 16


def component_bounds(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest value of each component, one pair of rows from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(0), "i8")
                low = x.min(0) if low is None else np.minimum(low, x.min(0))
                high = x.max(0) if high is None else np.maximum(high, x.max(0))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(low))), pa.array(low), pa.array(high)], ["d", "low", "high"])

    rows = vectors.select("v").mapInArrow(run, "d long, low long, high long").groupBy("d").agg(F.min("low"), F.max("high")).orderBy("d").collect()
    return np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float)


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of rows, by floating point where every sum stays below 2^53."""
    largest = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if largest < 2**53:
        return np.einsum("ij,ij->i", q.astype(float), x.astype(float)).astype(np.int64)
    return np.array([min(max(sum(a * b for a, b in zip(r, s)), -(2**63)), 2**63 - 1) for r, s in zip(q.tolist(), x.tolist())], np.int64)


def top_k(table: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", cells: int = CELLS, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` the k largest integer inner products over ``table``.

    Components count as floor(scale * x). A query's own id is no candidate; ties go to the smaller id; with fewer
    candidates all are returned. Vectors that are null, empty or hold null or non-finite components, and those of
    another length than most (the longer one if equally many), take no part, as query or candidate. Equal vectors are searched as one.
    Scores beyond 64 bits are cut to their range. Other columns are not read; empty tables give no rows.
    """
    spark = table.sparkSession
    out_schema = "query_id long, rank int, vec_id long, score long"
    whole = lambda x: np.clip(np.floor(x * scale), -(2.0**62), 2.0**62).astype("<i8")
    vectors = staged(grouped(packed(usable(table, id_col, vector_col), whole), k + 1), "vectors")
    width = common_width(vectors)
    if width is None:
        return spark.createDataFrame([], out_schema)
    vectors = vectors.filter(F.length("v") == width)
    asked = staged(packed(usable(queries, id_col, vector_col), whole).filter(F.length("v") == width).withColumnRenamed("id", "query_id").dropDuplicates(["query_id", "v"]), "queries")
    n_blocks = -(-asked.count() // block)
    low, high = component_bounds(vectors)
    step = np.maximum((high - low + 1) / cells, 1e-9)

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = np.clip((matrix(b.column(1), "i8") - low) / step, 0, cells - 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in c], pa.binary())], ["gid", "cells"])

    approximations = staged(vectors.select("gid", "v").mapInArrow(to_cells, "gid long, cells binary"), "approximations")
    found = [search_block(approximations, vectors, asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == i), k, low, step) for i in range(n_blocks)]
    if not found:
        return spark.createDataFrame([], out_schema)
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def search_block(approximations: DataFrame, vectors: DataFrame, asked: DataFrame, k: int, low: np.ndarray, step: np.ndarray) -> DataFrame:
    """The answer to the queries of one block, gathered on the driver: about QUERY_BLOCK rows, whatever the table.

    Each block is one scan of the approximations, a byte a component; blocks follow one another.
    """
    spark = approximations.sparkSession
    rows = asked.collect()
    ids, q = [r["query_id"] for r in rows], np.array([np.frombuffer(r["v"], "<i8") for r in rows], float).reshape(len(rows), len(low))
    slack = np.abs(q) @ (step / 2) + 1e-9 * (np.abs(q) @ (np.abs(low) + 256 * step)) + 1e-6

    def middles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                yield part.column(0), q @ (low + (matrix(part.column(1), "u1") + 0.5) * step).T

    def best_lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(ids), k + 1), -np.inf)
        for _, score in middles(batches):
            best = -np.partition(-np.hstack([best, score - slack[:, None]]), k, axis=1)[:, : k + 1]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(ids))), pa.array(best.tolist(), pa.list_(pa.float64()))], ["q", "best"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best bounds of each query over all tasks, as they pass."""
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for i, best in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held[i] = -np.sort(-np.append(held.get(i, []), best))[: k + 1]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([x[k] for x in held.values()], pa.float64())], ["q", "kth"])

    bound = np.full(len(ids), -np.inf)
    for r in approximations.mapInArrow(best_lower, "q long, best array<double>").repartition("q").mapInArrow(merge, "q long, kth double").collect():
        bound[r["q"]] = r["kth"]

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for gid, score in middles(batches):
            upper = score + slack[:, None]
            at, of = np.nonzero(upper >= bound[:, None])
            yield pa.RecordBatch.from_arrays([pa.array(at), gid.take(pa.array(of)), pa.array(upper[at, of])], ["q", "gid", "upper"])

    near = staged(approximations.mapInArrow(within, "q long, gid long, upper double"), "candidates")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(0).to_numpy()
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in at], pa.int64()), b.column(0), b.column(1), pa.array(exact(q[at].astype(np.int64), matrix(b.column(2), "i8")))], ["query_id", "q", "ids", "score"])

    def read(part: DataFrame) -> DataFrame:
        return part.join(vectors, "gid").select("q", "ids", "v").mapInArrow(score, "query_id long, q long, ids array<long>, score long")

    order = Window.partitionBy("q").orderBy(F.desc("upper"), "gid")
    wave = staged(near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1), "first-wave")  # each task keeps its own k + 1
    first = staged(read(wave), "first-scores")
    certain = first.groupBy("q").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).select("q", F.try_element_at("s", F.lit(k + 1)).alias("kth"))
    last = wave.groupBy("q").agg(F.max(F.struct(-F.col("upper"), "gid")).alias("last"))
    rest = near.join(certain.join(last, "q"), "q").filter((F.struct(-F.col("upper"), "gid") > F.col("last")) & (F.col("kth").isNull() | (F.col("upper") >= F.col("kth")))).select("q", "gid")
    answers = first.union(read(rest)).select("query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id <> query_id")
    # A query of many near ties is first ranked in parts.
    part = Window.partitionBy("query_id", F.pmod(F.xxhash64("vec_id"), F.lit(PARTS))).orderBy(F.desc("score"), "vec_id")
    answers = answers.withColumn("place", F.row_number().over(part)).filter(F.col("place") <= k).drop("place")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return answers.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
