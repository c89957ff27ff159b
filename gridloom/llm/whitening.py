"""Embedding whitening through MLlib's BlockMatrix.

Rows get consecutive indices, centred rows become distributed blocks, transpose times matrix gives the scatter, whose
eigenvectors one machine finds, and a product with the whitening matrix projects all rows. The driver holds matrices of
dimensions times dimensions, and the pair of indices of each block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.staging import release, staged

#: Rows and columns of a block.
ROWS, COLUMNS = 512, 256
#: Blocks that one task multiplies into one partial scatter.
BLOCKS_A_TASK = 16
#: Components whose eigenvalue isn't above this share of the largest have no variance to divide by.
LEAST_SHARE = 1e-12


@dataclass
class Whitening:
    """A fit: rows, exact sums, covariance, eigenvalues (falling) and unit eigenvectors (columns) of as many components."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @property
    def projection(self) -> np.ndarray:
        """Centred rows times this are whitened; columns of components without variance are zero."""
        known = self.known
        return self.vectors * np.where(known, 1 / np.sqrt(np.where(known, self.values, 1.0)), 0.0)

    @property
    def known(self) -> np.ndarray:
        return self.values > LEAST_SHARE * max(self.values.max(initial=0.0), 0.0)

    @property
    def explained(self) -> np.ndarray:
        trace = float(np.trace(self.covariance))
        return self.values / trace if trace > 0 else np.zeros_like(self.values)


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``key`` (the id) and ``x``, floor(64 * component) + 1000000, of vectors without null or non-finite entries."""
    ok = F.forall(vector_col, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform(vector_col, lambda c: F.floor(F.lit(64.0) * c.cast("double")).cast("long") + F.lit(1_000_000).cast("long"))
    return vectors.filter((F.size(vector_col) > 0) & ok).select(F.col(id_col).alias("key"), x.alias("x"))


def common_size(rows: DataFrame) -> int | None:
    best = rows.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    return best["size"] if best else None


def indexed(rows: DataFrame) -> DataFrame:
    """Rows of a written table with a consecutive ``index`` from 0; the counts that precede are one row a partition."""
    at = F.col("at")
    counts = rows.groupBy(F.shiftright(at, 33).alias("part")).agg(F.count("*").alias("n"))
    before = counts.select("part", F.expr("sum(n) over (order by part) - n").alias("before"))
    return rows.join(F.broadcast(before), F.shiftright(at, 33) == F.col("part")).withColumn("index", F.col("before") + at.bitwiseAND((1 << 33) - 1)).drop("at", "part", "before")


def column_sums(rows: DataFrame, x: str) -> list:
    return [r["s"] for r in rows.select(F.posexplode(x).alias("i", "v")).groupBy("i").agg(F.sum("v").alias("s")).orderBy("i").collect()]


def minus(x: str, means: list[float]) -> Column:
    return F.zip_with(F.col(x).cast("array<double>"), F.lit([float(m) for m in means]), lambda a, b: a - b)


def blocks(rows: DataFrame, vector: Column, n: int, size: int) -> BlockMatrix:
    """The vectors as blocks, by their index."""
    table = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector(vector).alias("vector")), "vector")
    return IndexedRowMatrix(table, n, size).toBlockMatrix(ROWS, COLUMNS)


def scatter(matrix: BlockMatrix, n: int) -> np.ndarray:
    """Transpose times matrix; the blocks of rows are dealt to tasks whose partial products are added up."""
    java = matrix._java_matrix_wrapper._java_model
    product = java.transpose().multiply(java, max(1, -(-n // (ROWS * BLOCKS_A_TASK))))
    out = BlockMatrix(product, COLUMNS, COLUMNS).toLocalMatrix().toArray()
    return (out + out.T) / 2


def covariance(rows: DataFrame, x: str, means: list[float], n: int) -> np.ndarray:
    return scatter(blocks(rows, minus(x, means), n, len(means)), n) / n


def eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, the largest entry of each positive."""
    values, vectors = np.linalg.eigh(matrix)
    vectors = vectors[:, ::-1]
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    return np.maximum(values[::-1], 0.0), vectors * np.where(signs == 0, 1.0, signs)


def fit(rows: DataFrame, components: int) -> Whitening:
    """Of indexed rows with ``x``, all of one size."""
    sums = column_sums(rows, "x")
    n = rows.count()
    means = [s / n for s in sums]
    v = covariance(rows, "x", means, n)
    values, vectors = eigen(v)
    return Whitening(n, sums, v, values[:components], vectors[:, :components])


def project(spark: SparkSession, rows: DataFrame, model: Whitening) -> DataFrame:
    """(index, whitened array) of indexed rows."""
    size = len(model.sums)
    w = model.projection
    a = blocks(rows, minus("x", [s / model.n for s in model.sums]), model.n, size)
    parts = [((i // COLUMNS, 0), DenseMatrix(min(COLUMNS, size - i), w.shape[1], w[i : i + COLUMNS].ravel(order="F"))) for i in range(0, size, COLUMNS)]
    b = BlockMatrix(spark.sparkContext.parallelize(parts, 1), COLUMNS, w.shape[1], size, w.shape[1])
    out = callMLlibFunc("getIndexedRows", a.multiply(b).toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return out.select("index", vector_to_array("vector").alias("whitened"))


def deviation(model: Whitening) -> Column:
    """Sum of (n * x - S)^2, exact; null where it is beyond a long."""
    n = F.lit(model.n).cast("long")
    away = F.zip_with("x", F.lit(model.sums), lambda a, s: (n * a - s.cast("long")).cast("decimal(19,0)"))
    total = F.aggregate(away, F.lit(0).cast("decimal(38,0)"), lambda acc, d: (acc + (d * d).cast("decimal(38,0)")).cast("decimal(38,0)"))
    return total.try_cast("long")


SCHEMA = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32) -> DataFrame:
    """id, component, n, deviation, whitened, explained and identity_error of each usable row and component.

    Null vectors, empty ones and those that hold null or non-finite entries are dropped; so are those that are not as
    long as most (of equally frequent lengths the longer stays). Null ids stay null ids, repeated rows and ids stay and
    weigh in the fit each time; other columns are not read, whatever their names. Equal eigenvalues leave the choice of
    their axes open. A component without variance (equal vectors, or fewer vectors than dimensions) has a null whitened
    value and takes no part in the identity error, which is null if no component has variance. An empty table gives no
    rows.
    """
    spark, kind = vectors.sparkSession, vectors.schema[id_col].dataType.simpleString()
    # the place in its partition is written with the row: it stays when tasks run again
    raw = staged(whole_numbers(vectors, id_col, vector_col).withColumn("at", F.monotonically_increasing_id()), "vectors")
    size = common_size(raw)
    if size is None:
        return spark.createDataFrame([], f"{id_col} {kind}, {SCHEMA}")
    if raw.filter(F.size("x") != size).limit(1).count():
        usual = staged(raw.filter(F.size("x") == size).withColumn("at", F.monotonically_increasing_id()), "vectors")
        release(raw)
        raw = usual
    rows = staged(indexed(raw), "indexed")
    release(raw)
    model = fit(rows, components)
    whitened = staged(project(spark, rows, model), "whitened")
    known, k = model.known, len(model.values)
    away = covariance(whitened, "whitened", [s / model.n for s in column_sums(whitened, "whitened")], model.n) - np.eye(k)
    error = float(np.abs(away[np.ix_(known, known)]).max()) if known.any() else None
    parts = F.arrays_zip(F.lit([bool(x) for x in known]).alias("known"), F.col("whitened"), F.lit([float(x) for x in model.explained]).alias("explained"))
    joined = rows.select("index", "key", deviation(model).alias("deviation")).join(whitened, "index")
    return joined.select("key", "deviation", F.posexplode(parts).alias("i", "c")).select(
        F.col("key").alias(id_col),
        (F.col("i") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        F.when(F.col("c.known"), F.col("c.whitened")).alias("whitened"),
        F.col("c.explained").alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
