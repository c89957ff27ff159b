"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Every pair of features interacts through the inner product of two low-rank factors. The sum over all pairs equals half
of (the square of the sum less the sum of squares) for each factor, so a score takes time linear in the features.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from gridloom.llm.runs import slices
from gridloom.staging import small_batches, staged

BUCKETS = 1_024
#: Labelled rows that a fit takes at most, chosen by hash: the bound of what reaches the driver.
SAMPLE = 4_000
FACTORS, EPOCHS, RATE, DECAY, SEED = 6, 150, 0.03, 2e-4, 7
CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "high": range(128, 256), "space": (32, 9, 13), "line": (10,), "stop": (46, 44), "bar": (124,), "loud": (33, 63), "symbol": (*range(35, 44), 60, 61, 62, 64, 92, 94, 95, 96, 123, 125, 126), "low": (*range(0, 9), *range(11, 13), *range(14, 32))}
STRUCTURE = (*CLASSES, "log_chars", "log_words", "word_length", "distinct", "most_frequent", "neighbour_same", "longest", "lines", "line_repeats", "ends_with_stop")
#: Numeric columns of a document that count as its metadata, where they are there. Never its id, language, source or labels.
METADATA = ("n_chars",)


def structure(raw: bytes, words: list[bytes], counts: dict[bytes, int]) -> list[float]:
    """Shares of character classes and shape of the whole text; zeros for an empty one. Order as STRUCTURE."""
    n = max(1, len(raw))
    by_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    w = max(1, len(words))
    return [
        *(float(by_byte[list(c)].sum()) / n for c in CLASSES.values()),
        math.log1p(len(raw)) / 10,
        math.log1p(len(words)) / 10,
        min(len(raw) / w, 50) / 10,
        len(counts) / w,
        max(counts.values(), default=0) / w,
        sum(map(bytes.__eq__, words, words[1:])) / w,
        min(max(map(len, words), default=0), 200) / 50,
        math.log1p(len(lines)) / 5,
        1 - len(set(lines)) / max(1, len(lines)),
        sum(x.rstrip().endswith((b".", b"!", b"?")) for x in lines) / max(1, len(lines)),
    ]


def features(raw: bytes, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Buckets of hashed words with their weights (log counts, length 1), and the structure statistics."""
    words = raw.split()
    counts: dict[bytes, int] = {}
    for x in words:
        counts[x] = counts.get(x, 0) + 1
    if not counts:
        return np.zeros(0, np.int64), np.zeros(0), structure(raw, words, counts)
    at = np.fromiter(map(zlib.crc32, counts), np.int64, len(counts)) % buckets
    summed = np.bincount(at, weights=np.log1p(np.fromiter(counts.values(), float, len(counts))), minlength=buckets)
    used = np.flatnonzero(summed)
    return used, summed[used] / np.linalg.norm(summed[used]), structure(raw, words, counts)


def metadata(values: list[float | None]) -> list[float]:
    """Two numbers for each: whether it is known (finite), and its signed logarithm."""
    known = [v is not None and math.isfinite(v) for v in values]
    return [x for k, v in zip(known, values) for x in (float(k), math.copysign(math.log1p(abs(v)), v) / 10 if k else 0.0)]


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    buckets: int
    columns: tuple[str, ...] = ()

    def score(self, raw: bytes, values: list[float | None] | None = None) -> float:
        used, weight, shape = features(raw, self.buckets)
        shape = np.array(shape + metadata([None] * len(self.columns) if values is None else values))
        at = np.concatenate([used, np.arange(self.buckets, self.buckets + len(shape))])
        x = np.concatenate([weight, np.clip((shape - self.mean) / self.spread, -5, 5)])
        v = self.factors[at] * x[:, None]
        z = self.bias + self.weights[at] @ x + 0.5 * float((v.sum(0) ** 2 - (v**2).sum(0)).sum())
        return 1 / (1 + math.exp(-min(max(z, -30.0), 30.0)))

    def scores(self, batch: pa.RecordBatch, text_col: str, at: list[int]) -> list[float]:
        """Of the rows of a batch, whose metadata stands in the columns ``at``."""
        texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.binary()).to_pylist()
        rows = zip(*(batch.column(i).cast(pa.float64()).to_pylist() for i in at)) if at else [()] * len(texts)
        return [self.score(t or b"", list(v)) for t, v in zip(texts, rows)]


def train(rows: list[tuple[list[int], list[float], list[float], int]], buckets: int = BUCKETS, factors: int = FACTORS, epochs: int = EPOCHS, rate: float = RATE, decay: float = DECAY, columns: tuple[str, ...] = ()) -> Machine:
    """Full-batch Adam on the log loss over rows of word buckets, their weights, dense features and label.

    Without both labels the machine scores every text by the share of label 1.
    """
    y = np.array([r[3] for r in rows], np.float32)
    k = len(STRUCTURE) + 2 * len(columns)
    x = np.zeros((len(rows), buckets + k), np.float32)
    for i, (used, weight, shape, _) in enumerate(rows):
        x[i, used] = weight
        x[i, buckets:] = shape
    mean, spread = (x[:, buckets:].mean(0), x[:, buckets:].std(0) + 1e-3) if len(rows) else (np.zeros(k), np.ones(k))
    share = (float(y.sum()) + 1) / (len(y) + 2)
    machine = Machine(math.log(share / (1 - share)), np.zeros(buckets + k), np.zeros((buckets + k, factors)), mean, spread, buckets, columns)
    if len(set(y.tolist())) < 2:
        return machine
    x[:, buckets:] = np.clip((x[:, buckets:] - mean) / spread, -5, 5)
    rng = np.random.default_rng(SEED)
    parts = [np.array([machine.bias], np.float32), np.zeros(buckets + k, np.float32), rng.normal(0, 0.02, (buckets + k, factors)).astype(np.float32)]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    squared = x * x
    for t in range(1, epochs + 1):
        bias, w, v = parts
        sums = x @ v
        z = bias + x @ w + 0.5 * ((sums**2).sum(1) - squared @ (v**2).sum(1))
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        grads = [g.sum(keepdims=True), x.T @ g + decay * w, x.T @ (g[:, None] * sums) - v * (squared.T @ g)[:, None] + decay * v]
        for i, d in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * d
            second[i] = 0.999 * second[i] + 0.001 * d * d
            parts[i] = (parts[i] - rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return Machine(float(parts[0][0]), parts[1].astype(float), parts[2].astype(float), mean, spread, buckets, columns)


def fold(id_col: str, folds: int = 5):
    """crc32 of the id as text, modulo ``folds``; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def known_metadata(docs: DataFrame, wanted: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(c for c in wanted if c in docs.columns and isinstance(docs.schema[c].dataType, NumericType))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, held_out: int = 0, metadata_cols: tuple[str, ...] = METADATA) -> Machine:
    """Fits on at most ``sample`` labelled documents outside fold ``held_out``, smallest hashes of the id first.

    Tasks turn texts into features, at most BUCKETS numbers a row, and only those reach the driver. Labels other than 0
    and 1 are left out. An id with several labels counts once for each different one, and repeated rows of an id each;
    null and empty texts have structure features alone. Without labelled rows every text scores one half.
    """
    columns = known_metadata(docs, metadata_cols)
    marked = labels.filter(F.col(label_col).isin(0, 1)).filter(fold(id_col) != held_out).select(F.col(id_col).alias("_key"), F.col(label_col).cast("int").alias("_label")).distinct()
    chosen = marked.orderBy(F.xxhash64(F.col("_key").cast("string")), "_key", "_label").limit(sample)
    values = [F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(columns)]
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *values).join(F.broadcast(chosen), F.col("_id") == F.col("_key")).drop("_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            texts, known = b.column("_text").cast(pa.binary()).to_pylist(), zip(*(b.column(f"_v{i}").to_pylist() for i in range(len(columns)))) if columns else iter([()] * b.num_rows)
            found = [features(t or b"") for t in texts]
            dense = [f[2] + metadata(list(v)) for f, v in zip(found, known)]
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_label"), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float64())), pa.array(dense, pa.list_(pa.float64()))], ["_id", "_label", "used", "weight", "dense"])

    made = rows.mapInArrow(run, f"_id {docs.schema[id_col].dataType.simpleString()}, _label int, used array<int>, weight array<double>, dense array<double>")
    with small_batches(docs.sparkSession):
        taken = made.orderBy(F.xxhash64(F.col("_id").cast("string")), "_id", "_label", "dense").limit(sample).collect()
    return train([(r["used"], r["weight"], r["dense"], r["_label"]) for r in taken], columns=columns)


def score_documents(docs: DataFrame, machine: Machine, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score and predicted (1 from ``threshold`` on) of each document.

    Null texts score as empty ones, from structure and metadata alone; null metadata counts as unknown; very long texts
    score whole; repeated rows stay repeated; only id, text and the machine's metadata columns are read; an empty table
    gives no rows.
    """
    values = [F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(machine.columns)]
    at = list(range(3, 3 + len(values)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            s = machine.scores(b, "_text", at)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())], [id_col, "held_out", "score", "predicted"])

    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, held_out boolean, score double, predicted int"
    return staged(docs.select(F.col(id_col), (fold(id_col) == 0).alias("held_out"), F.col(text_col).alias("_text"), *values).mapInArrow(run, schema), "scores")


def keep_good(docs: DataFrame, machine: Machine, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The documents that score_documents predicts as 1, all columns and repeated rows kept, whatever their names; null,
    empty and very long texts are scored as there; an empty table gives no rows."""
    at = [docs.columns.index(c) for c in machine.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col):
            yield b.filter(pa.array([s >= threshold for s in machine.scores(b, text_col, at)], pa.bool_()))

    return staged(docs.mapInArrow(run, docs.schema), "good")
