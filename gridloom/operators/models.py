"""Model operators: imputation, scaling, components, self-organising map, clusters and their profiles."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, MinMaxScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.ranking import fill_medians, medians, quantiles


def log_features(df: DataFrame, columns: list[str]) -> DataFrame:
    """log1p of the columns that hold no negative value anywhere, told by one pass."""
    least = df.agg(*(F.min(c).alias(c) for c in columns)).first()
    return df.withColumns({f"log_{c}": F.log1p(F.coalesce(c, F.lit(0))) for c in columns if least[c] is None or least[c] >= 0})


def weather_features(df: DataFrame, low: str, high: str) -> DataFrame:
    return df.withColumns({"mean_temperature": (F.col(low) + F.col(high)) / 2, "amplitude": F.col(high) - F.col(low)})


def impute(df: DataFrame, families: dict[str, str], state: str, month: str) -> DataFrame:
    """Detections become 0; weather takes the median of state and month, then of the state, then of all; context of the state, then of all."""
    by = lambda k: [c for c, f in families.items() if f == k]
    out = df.fillna(0, subset=by("detection")) if by("detection") else df
    out = fill_medians(out, by("weather"), [[state, month], [state]], df) if by("weather") else out
    out = fill_medians(out, by("context"), [[state]], df) if by("context") else out
    return fill_medians(out, by("other"), [], df) if by("other") else out


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """Zero mean and unit population deviation; a constant column becomes 0."""
    stats = df.agg(*(f(c).alias(f"{n}_{c}") for c in columns for f, n in ((F.avg, "m"), (F.stddev_pop, "s")))).first()
    return df.withColumns({c: (F.col(c) - (stats[f"m_{c}"] or 0.0)) / (stats[f"s_{c}"] or 1.0) for c in columns})


def assemble(df: DataFrame, columns: list[str], name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=name, handleInvalid="error").transform(df)


def components(df: DataFrame, columns: list[str], k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scores PC1..PCk added to the table, variance (component, variance, ratio) and loadings (component, feature, loading).

    Signs are fixed: the largest loading of each component is positive.
    """
    spark = df.sparkSession
    vectors = assemble(df, columns)
    model = PCA(k=k, inputCol="features", outputCol="scores").fit(vectors)
    pc = model.pc.toArray()
    sign = np.where(pc[np.abs(pc).argmax(0), np.arange(k)] < 0, -1.0, 1.0)
    total = vectors.agg(sum((F.var_samp(c) for c in columns), F.lit(0.0))).first()[0]
    ratio = model.explainedVariance.toArray()
    variance = spark.createDataFrame([(i + 1, float(r * total), float(r)) for i, r in enumerate(ratio)], "component int, variance double, ratio double")
    loadings = spark.createDataFrame([(j + 1, c, float(pc[i, j] * sign[j])) for i, c in enumerate(columns) for j in range(k)], "component int, feature string, loading double")
    # centred, as scores of standard analysis are
    means = df.agg(*(F.avg(c).alias(c) for c in columns)).first()
    shift = [float(sum(means[c] * pc[i, j] for i, c in enumerate(columns))) for j in range(k)]
    scored = model.transform(vectors).withColumn("_s", vector_to_array("scores"))
    scored = scored.withColumns({f"PC{j + 1}": (F.col("_s")[j] - shift[j]) * float(sign[j]) for j in range(k)})
    return scored.drop("_s", "scores", "features"), variance, loadings


def min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    scaled = MinMaxScaler(inputCol="_v", outputCol="_m").fit(v := assemble(df, columns, "_v")).transform(v)
    return scaled.withColumn("_a", vector_to_array("_m")).withColumns({c: F.col("_a")[i] for i, c in enumerate(columns)}).drop("_v", "_m", "_a")


class SelfOrganisingMap:
    """A batch map: in each epoch every row gives its vector to its best node, and nodes take means smoothed over the grid.

    The start spans the plane of the first two columns (components in order of variance); the neighbourhood shrinks from
    ``sigma`` to ``last_sigma``. Nodes that no neighbourhood reaches keep their weights. The map (nodes x columns) is what
    each task gets; rows stay where they are.
    """

    def __init__(self, width: int, height: int, columns: list[str], sigma: float = 2.0, last_sigma: float = 0.5, epochs: int = 10):
        self.width, self.height, self.columns, self.sigma, self.last_sigma, self.epochs = width, height, columns, sigma, last_sigma, epochs
        self.grid = np.array([(i, j) for i in range(width) for j in range(height)], float)
        self.weights = np.zeros((width * height, len(columns)))
        self.errors: list[float] = []

    def start(self, df: DataFrame) -> None:
        s = df.agg(*(f(c).alias(f"{n}_{c}") for c in self.columns for f, n in ((F.avg, "m"), (F.stddev_pop, "s")))).first()
        self.weights[:] = [s[f"m_{c}"] for c in self.columns]
        for axis, size in ((0, self.width), (1, self.height)):
            if axis < len(self.columns) and size > 1:
                self.weights[:, axis] += (self.grid[:, axis] / (size - 1) * 2 - 1) * (s[f"s_{self.columns[axis]}"] or 0.0) * 1.5

    def _matrix(self, batch: pa.RecordBatch) -> np.ndarray:
        return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in self.columns])

    def _nearest(self, x: np.ndarray, n: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """The n nearest nodes of each row, ties to the smaller, and the distances of the nearest."""
        d = (x**2).sum(1)[:, None] - 2 * x @ self.weights.T + (self.weights**2).sum(1)[None, :]
        d, order = d.round(12), np.empty((len(x), n), np.int64)
        rest = d.copy() if n > 1 else d
        for i in range(n):  # argmin takes the smaller node of equals; a sort of all nodes isn't needed
            order[:, i] = rest.argmin(1)
            if i + 1 < n:
                rest[np.arange(len(x)), order[:, i]] = np.inf
        return order, np.sqrt(np.maximum(d[np.arange(len(x)), order[:, 0]], 0))

    def fit(self, df: DataFrame) -> SelfOrganisingMap:
        self.start(df)
        rows = df.select(*self.columns).dropna()
        for epoch in range(self.epochs):

            def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                n, total, error = np.zeros(len(self.weights)), np.zeros_like(self.weights), np.zeros(len(self.weights))
                for b in batches:
                    if b.num_rows:
                        x = self._matrix(b)
                        node, d = self._nearest(x)
                        np.add.at(n, node[:, 0], 1)
                        np.add.at(total, node[:, 0], x)
                        np.add.at(error, node[:, 0], d)
                hit = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(n[hit]), pa.array(error[hit]), *(pa.array(total[hit, i]) for i in range(total.shape[1]))], ["node", "n", "error", *self.columns])

            schema = ", ".join(["node long, n double, error double", *(f"`{c}` double" for c in self.columns)])
            sums = rows.mapInArrow(partial, schema).groupBy("node").agg(F.sum("n").alias("n"), F.sum("error").alias("error"), *(F.sum(c).alias(c) for c in self.columns)).collect()  # one row for each node
            n, total = np.zeros(len(self.weights)), np.zeros_like(self.weights)
            for r in sums:
                n[r["node"]], total[r["node"]] = r["n"], [r[c] for c in self.columns]
            self.errors.append(sum(r["error"] for r in sums) / max(n.sum(), 1))
            sigma = self.sigma * (self.last_sigma / self.sigma) ** (epoch / max(1, self.epochs - 1))
            away = ((self.grid[:, None] - self.grid[None]) ** 2).sum(-1)
            pull = np.exp(-away / (2 * sigma**2))
            weight = pull @ n
            reached = weight > 1e-12
            self.weights[reached] = (pull @ total)[reached] / weight[reached, None]
        return self

    def assign(self, df: DataFrame) -> DataFrame:
        """Adds node, som_x, som_y, the distance to the node, and whether the second best node isn't its neighbour."""
        from pyspark.sql import types as T

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                order, d = self._nearest(self._matrix(b), 2)
                two = order[:, -1]
                broken = np.abs(self.grid[order[:, 0]] - self.grid[two]).max(1) > 1
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(order[:, 0]), pa.array(self.grid[order[:, 0], 0].astype(np.int32)), pa.array(self.grid[order[:, 0], 1].astype(np.int32)), pa.array(d), pa.array(broken)], [*b.schema.names, "node", "som_x", "som_y", "node_distance", "broken"])

        extra = [T.StructField("node", T.LongType()), T.StructField("som_x", T.IntegerType()), T.StructField("som_y", T.IntegerType()), T.StructField("node_distance", T.DoubleType()), T.StructField("broken", T.BooleanType())]
        return df.mapInArrow(run, T.StructType([*df.schema.fields, *extra]))

    def nodes(self, assigned: DataFrame) -> DataFrame:
        """Every node with its weights, activation (0 for empty ones) and mean distance to its grid neighbours."""
        spark = assigned.sparkSession
        rows = [(i, int(x), int(y), *map(float, w)) for i, ((x, y), w) in enumerate(zip(self.grid, self.weights))]
        grid = spark.createDataFrame(rows, ", ".join(["node long, som_x int, som_y int", *(f"`{c}` double" for c in self.columns)]))
        counts = assigned.groupBy("node").agg(F.count("*").alias("activation"))
        other = grid.select(F.col("som_x").alias("_x"), F.col("som_y").alias("_y"), F.array(*self.columns).alias("_w"))
        step = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b)))
        near = grid.select("node", (F.col("som_x")).alias("x"), (F.col("som_y")).alias("y"), F.array(*self.columns).alias("w")).withColumn("s", step)
        near = near.select("node", "w", (F.col("x") + F.col("s.a")).alias("_x"), (F.col("y") + F.col("s.b")).alias("_y")).join(other, ["_x", "_y"])
        distance = F.sqrt(F.aggregate(F.zip_with("w", "_w", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda a, v: a + v))
        u = near.groupBy("node").agg(F.avg(distance).alias("u_distance"))
        return grid.join(counts, "node", "left").join(u, "node", "left").withColumn("activation", F.coalesce("activation", F.lit(0))).withColumn("occupied", F.col("activation") > 0)


def map_errors(assigned: DataFrame) -> DataFrame:
    return assigned.agg(F.avg("node_distance").alias("quantization_error"), F.avg(F.col("broken").cast("double")).alias("topographic_error"))


def cluster_scores(labelled: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Davies-Bouldin and Calinski-Harabasz of labelled rows, from centres, scatters and counts of the labels."""
    centres = labelled.groupBy(label).agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in columns))
    far = labelled.select(label, *columns).join(F.broadcast(centres.select(label, *(F.col(c).alias(f"_{c}") for c in columns))), label)
    square = sum(((F.col(c) - F.col(f"_{c}")) ** 2 for c in columns), F.lit(0.0))
    scatter = far.groupBy(label).agg(F.avg(F.sqrt(square)).alias("scatter"), F.sum(square).alias("within"))
    rows = centres.join(scatter, label).orderBy(label).collect()  # one row for each cluster
    k, n = len(rows), sum(r["n"] for r in rows)
    c = np.array([[r[x] for x in columns] for r in rows])
    s, size = np.array([r["scatter"] for r in rows]), np.array([r["n"] for r in rows], float)
    if k < 2:
        return labelled.sparkSession.createDataFrame([(k, None, None)], "k int, davies_bouldin double, calinski_harabasz double")
    d = np.sqrt(((c[:, None] - c[None]) ** 2).sum(-1))
    with np.errstate(divide="ignore", invalid="ignore"):
        r = (s[:, None] + s[None]) / d
    np.fill_diagonal(r, -np.inf)
    between = (size * ((c - (size @ c) / n) ** 2).sum(1)).sum()
    within = sum(x["within"] for x in rows)
    ch = float(between / (k - 1) / (within / (n - k))) if within > 0 and n > k else None
    return labelled.sparkSession.createDataFrame([(k, float(r.max(1).mean()), ch)], "k int, davies_bouldin double, calinski_harabasz double")


def kmeans_sweep(nodes: DataFrame, columns: list[str], weight: str, ks: list[int], seed: int = 42) -> tuple[dict[int, DataFrame], DataFrame]:
    """Labels of occupied nodes for each k, and a table of k, silhouette, both indices and smallest and largest share."""
    spark = nodes.sparkSession
    data = assemble(nodes.filter(F.col(weight) > 0), columns).cache()
    labels, rows = {}, []
    for k in ks:
        out = KMeans(k=k, seed=seed, weightCol=weight, featuresCol="features", predictionCol="label").fit(data).transform(data)
        silhouette = ClusteringEvaluator(predictionCol="label", featuresCol="features").evaluate(out)
        other = cluster_scores(out, columns, "label").first()
        sizes = out.groupBy("label").agg(F.sum(weight).alias("w")).agg(F.min("w"), F.max("w"), F.sum("w")).first()
        labels[k] = out.drop("features")
        rows.append((k, silhouette, other[1], other[2], sizes[0] / sizes[2], sizes[1] / sizes[2]))
    data.unpersist()
    return labels, spark.createDataFrame(rows, "k int, silhouette double, davies_bouldin double, calinski_harabasz double, smallest_share double, largest_share double")


def choose_k(table: DataFrame, least_share: float = 0.01, most_share: float = 1.0) -> int:
    """The k of best silhouette whose clusters' shares are within bounds; of all, if none is."""
    fits = F.col("smallest_share").between(least_share, most_share) & (F.col("largest_share") <= most_share)
    return table.orderBy(F.desc(fits), F.desc("silhouette"), "davies_bouldin", F.desc("calinski_harabasz"), "k").first()["k"]


def cluster_profile(df: DataFrame, cluster: str, columns: list[str], flags: list[str], day: str, state: str) -> DataFrame:
    """Size, share, states, period, flag rates, and mean and median of columns for each cluster."""
    out = df.groupBy(cluster).agg(F.count("*").alias("n"), F.countDistinct(state).alias("n_states"), F.min(day).alias("first"), F.max(day).alias("last"), *(F.avg(f).alias(f"{f}_rate") for f in flags), *(F.avg(c).alias(f"{c}_mean") for c in columns))
    middle = medians(df, columns, [cluster]).select(F.col(cluster).alias("_cluster"), *(F.col(f"_m_{c}").alias(f"{c}_median") for c in columns))
    out = out.join(middle, F.col(cluster).eqNullSafe(F.col("_cluster")), "left").drop("_cluster")
    return out.withColumn("share", F.try_divide("n", F.sum("n").over(Window.partitionBy(F.lit(1)))))  # one row for each cluster


def feature_profile(df: DataFrame, cluster: str, columns: list[str], with_medians: bool = True) -> DataFrame:
    """Cluster against all rows for each feature, from mergeable sums: mean, difference, ratio, z and rank of |z|; and both
    medians, if asked for."""
    long = df.select(cluster, *(F.col(c).cast("double").alias(c) for c in columns)).unpivot([cluster], columns, "feature", "value").filter("value is not null")
    per = long.groupBy(cluster, "feature").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.var_pop("value").alias("spread"), F.min("value").alias("least"), F.max("value").alias("largest"))
    w = Window.partitionBy("feature")  # clusters x features rows
    n, s = (F.sum(c).over(w) for c in ("n", "total"))
    mean = F.col("total") / F.col("n")
    per = per.withColumn("_off", mean - s / n)  # squares about the means: no difference of large sums
    deviation = F.sqrt(F.sum(F.col("n") * (F.col("spread") + F.col("_off") * F.col("_off"))).over(w) / F.nullif(n - 1, F.lit(0)))
    out = per.withColumns({"mean": mean, "global_mean": s / n, "difference": mean - s / n, "ratio": F.try_divide(mean, s / n), "z": F.try_divide(mean - s / n, deviation)})
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc(F.abs("z")), "feature"))).drop("spread", "_off")
    if not with_medians:
        return out
    middle = quantiles(df, columns, [[cluster], []], [0.5])  # a row for each cluster and feature
    own = middle.filter("_level = 0").select(F.col(f"_g.`{cluster}`").alias("_own"), F.col("_c").alias("_f"), F.col("_q")[0].alias("median"))
    whole = middle.filter("_level = 1").select(F.col("_c").alias("_w"), F.col("_q")[0].alias("global_median"))
    out = out.join(own, F.col(cluster).eqNullSafe(F.col("_own")) & (F.col("feature") == F.col("_f")), "left").join(whole, F.col("feature") == F.col("_w"), "left")
    return out.drop("_own", "_f", "_w")


def distinguishing(profile: DataFrame, cluster: str, most: int = 8) -> DataFrame:
    """The features that set a cluster apart most, as text."""
    text = F.format_string("%s (z=%.2f)", F.col("feature"), F.col("z"))
    top = profile.filter(F.col("rank") <= most).groupBy(cluster).agg(F.array_sort(F.collect_list(F.struct("rank", text.alias("t")))).alias("l"))
    return top.select(cluster, F.array_join(F.transform("l", lambda x: x["t"]), "; ").alias("features"))


def distribution(df: DataFrame, cluster: str, by: str) -> DataFrame:
    counted = df.groupBy(cluster, by).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.try_divide("n", F.sum("n").over(Window.partitionBy(cluster))))


def profile_matrix(profile: DataFrame, cluster: str, features: list[str]) -> DataFrame:
    return profile.groupBy(cluster).pivot("feature", features).agg(F.first("mean"))


def propagate(rows: DataFrame, nodes: DataFrame, node: str, label: str) -> DataFrame:
    """Each row with its node's label; an error if a row's node has none. Nodes are a codebook of fixed size."""
    out = rows.join(F.broadcast(nodes.select(node, label)), node, "left")
    if out.filter(F.col(label).isNull()).limit(1).count():
        raise ValueError("rows without a label")
    return out


def pick_components(variance: DataFrame, least: float = 0.9) -> int:
    """The number of leading components that reach a share of the variance."""
    total = 0.0
    for r in variance.orderBy("component").collect():  # one row for each component
        total += r["ratio"]
        if total >= least or math.isclose(total, least):
            return r["component"]
    return r["component"]
