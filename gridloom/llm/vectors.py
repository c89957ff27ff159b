"""Shared by vector searches: usable vectors, with equal ones gathered under one key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and ``v`` (array<double>) of vectors that are not null or empty and hold finite components only."""
    ok = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return table.filter(F.col(id_col).isNotNull() & (F.size(vector_col) > 0) & ok).select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("v"))


def matrix(column: pa.Array, kind: str = "f8") -> np.ndarray:
    """Rows of equal binary length as a matrix."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1) if rows else np.zeros((0, 0), kind)


def packed(table: DataFrame, change: Callable[[np.ndarray], np.ndarray] = lambda x: x) -> DataFrame:
    """(id, v binary of ``change`` of the components) of usable vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(1)
            ends, flat = v.offsets.to_numpy(), change(v.values.to_numpy(zero_copy_only=False))
            raw = flat.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([raw[8 * s : 8 * e] for s, e in zip(ends.tolist(), ends[1:].tolist())], pa.binary())], ["id", "v"])

    return table.mapInArrow(run, "id long, v binary")


def common_width(vectors: DataFrame) -> int | None:
    """The byte length of most rows' ``v``, of equally frequent ones the longer; None without rows."""
    best = vectors.groupBy(F.length("v").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    return best["width"] if best else None


#: Distinct vectors that a task thins the ids of at a time.
THINNED = 50_000


def grouped(vectors: DataFrame, keep: int) -> DataFrame:
    """(gid, ids, v): each distinct vector with its ``keep`` smallest ids, gid being the smallest.

    A search for fewer than ``keep`` neighbours can't need more of them. Each task thins a vector's ids to ``keep``
    over THINNED distinct vectors at a time, so a vector that a third of all rows hold brings few ids from each task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held, pa.binary()), pa.array(held.values(), pa.list_(pa.int64()))], ["v", "ids"])
            held.clear()
            return out

        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = held.setdefault(v, [])
                if len(ids) < keep or i < ids[-1]:
                    if i not in ids:
                        ids.append(i)
                        ids.sort()
                        del ids[keep:]
            if len(held) >= THINNED:
                yield handed()
        if held:
            yield handed()

    few = vectors.mapInArrow(run, "v binary, ids array<long>")
    ids = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep)
    return few.groupBy("v").agg(ids.alias("ids")).select(F.col("ids")[0].alias("gid"), "ids", "v")
