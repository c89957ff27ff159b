"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text is the set of its hashed features: words, their first letters (inflected words share them), runs of two and three
words, and pairs of words with one or two between them. A pass over the labelled rows counts each feature by label;
those that lean clearly to one label are kept. FTRL-proximal then learns them with a rate for each coordinate, and its
L1 term leaves few weights other than zero: those are the model, small enough to reach every task.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.quality import fold
from gridloom.llm.runs import slices
from gridloom.staging import release, small_batches, staged

#: Labelled rows that a fit takes at most, chosen by hash.
SAMPLE = 10_000
#: Features that a model may have at most: the most telling ones. A row of them is at most KEPT / 8 bytes on the driver.
KEPT = 1 << 15
#: Rows that have to hold a feature, and the standard errors by which its share of label 1 has to differ.
LEAST_ROWS, LEAST_ERRORS = 3, 4.0
PREFIXES = (4, 5, 6, 7)
#: Distances between the words of pairs: neighbours, and skip-grams.
STEPS = (1, 2, 3)
ALPHA, BETA, L1, L2, EPOCHS, SEED = 0.3, 1.0, 1.0, 0.1, 10, 11
WORD = re.compile(r"[^\W\d_]+")
CACHED = 400_000
FIRST, SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Hashes(dict):
    """Word -> (hash, hashes of its first letters), cached."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHED:
            self.clear()
        found = tuple(xxhash.xxh64_intdigest(x) for x in (word, *("^" + word[:k] for k in PREFIXES if len(word) >= k)))
        self[word] = found
        return found


def mixed(a: np.ndarray, b: np.ndarray, kind: int) -> np.ndarray:
    """Keys of pairs of hashes, wrapped to 64 bits."""
    x = a * FIRST + (b ^ (b >> np.uint64(29))) * SECOND + np.uint64(kind * 0x1000193)
    return x ^ (x >> np.uint64(32))


def grams(text: str, hashes: Hashes) -> list[np.ndarray]:
    """Feature keys of a whole text, in one array for each kind; keys repeat."""
    words = WORD.findall(text.lower())
    if not words:
        return []
    single = {w: hashes[w] for w in set(words)}
    h = np.fromiter((single[w][0] for w in words), np.uint64, len(words))
    out = [np.fromiter((k for x in single.values() for k in x), np.uint64)]
    out += [mixed(h[:-s], h[s:], s) for s in STEPS if len(h) > s]
    if len(h) > 2:
        out.append(mixed(mixed(h[:-2], h[1:-1], 1), h[2:], 9))
    return out


class Keys:
    """A sorted set of feature keys, with a table of bits that lets few other keys pass."""

    BITS = 20

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys.astype(np.uint64))
        self.table = np.zeros(1 << self.BITS, bool)
        self.table[self.slot(self.keys)] = True

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.BITS)).astype(np.int64)

    def found(self, groups: list[np.ndarray]) -> np.ndarray:
        """Places of the set's keys that occur, each once, rising."""
        near = np.concatenate([g[self.table[self.slot(g)]] for g in groups]) if groups and len(self.keys) else np.zeros(0, np.uint64)
        at = np.searchsorted(self.keys, near)
        at[at == len(self.keys)] = 0
        return np.unique(at[self.keys[at] == near]) if len(near) else np.zeros(0, np.int64)


@dataclass
class Weights:
    """The model: a bias, and the keys whose weights are not zero."""

    bias: float
    keys: np.ndarray
    values: np.ndarray

    def scores(self, texts: list[str], hashes: Hashes, keys: Keys) -> list[float]:
        """1 for toxic, 0 for clean; a text without known features scores by the bias alone."""
        z = [self.bias + float(self.values[keys.found(grams(t, hashes))].sum()) for t in texts]
        return [1 / (1 + math.exp(-min(max(x, -30.0), 30.0))) for x in z]


def ftrl(rows: list[np.ndarray], labels: np.ndarray, n: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2, epochs: int = EPOCHS) -> tuple[float, np.ndarray]:
    """Bias and weights of n features, row by row in an order drawn anew for each epoch.

    Every coordinate keeps the sum z of its shifted gradients and the sum of their squares, which sets its rate. Its
    weight is zero while |z| <= l1. The bias, the last coordinate, has no l1 term.
    """
    z, squares, share = np.zeros(n + 1), np.zeros(n + 1), (float(labels.sum()) + 1) / (len(labels) + 2)
    limit = np.full(n + 1, l1)
    limit[n] = 0.0
    start = math.log(share / (1 - share))  # the bias moves from the share of label 1

    def weights(at: np.ndarray | slice) -> np.ndarray:
        over = np.maximum(np.abs(z[at]) - limit[at], 0)
        return -np.sign(z[at]) * over / ((beta + np.sqrt(squares[at])) / alpha + l2)

    if len(set(labels.tolist())) == 2:
        rng = np.random.default_rng(SEED)
        ends = [np.append(r, n) for r in rows]
        for _ in range(epochs):
            for i in rng.permutation(len(rows)).tolist():
                at = ends[i]
                w = weights(at)
                g = 1 / (1 + math.exp(-min(max(start + w.sum(), -30.0), 30.0))) - labels[i]
                z[at] += g - (np.sqrt(squares[at] + g * g) - np.sqrt(squares[at])) / alpha * w
                squares[at] += g * g
    w = weights(slice(None))
    return start + float(w[n]), w[:n]


def as_bytes(at: np.ndarray, n: int) -> bytes:
    """Places below n as two-byte numbers, or as one bit for each of n where that is shorter."""
    if 2 * len(at) < n // 8:
        return b"\0" + at.astype("<u2").tobytes()
    bits = np.zeros(n, bool)
    bits[at] = True
    return b"\1" + np.packbits(bits).tobytes()


def from_bytes(raw: bytes, n: int) -> np.ndarray:
    body = raw[1:]
    return np.frombuffer(body, "<u2").astype(np.int64) if raw[0] == 0 else np.flatnonzero(np.unpackbits(np.frombuffer(body, np.uint8), count=n))


def texts_of(b: pa.RecordBatch, name: str) -> list[str]:
    return [t or "" for t in b.column(name).to_pylist()]


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ones, zeros): in how many rows of a slice each feature occurs, by label."""
    hashes = Hashes()
    for b in slices(batches, "_text"):
        ones: list[np.ndarray] = [np.zeros(0, np.uint64)]
        zeros: list[np.ndarray] = [np.zeros(0, np.uint64)]
        for t, y in zip(texts_of(b, "_text"), b.column("_label").to_pylist()):
            (ones if y else zeros).extend([np.unique(np.concatenate(g))] if (g := grams(t, hashes)) else [])
        keys, at = np.unique(np.concatenate([*ones, *zeros]), return_inverse=True)
        first = sum(map(len, ones))
        by = [np.bincount(x, minlength=len(keys)) for x in (at[:first], at[first:])]
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *(pa.array(x, pa.int64()) for x in by)], ["key", "ones", "zeros"])


def telling(rows: DataFrame, kept: int, least_rows: int, least_errors: float) -> np.ndarray:
    """Keys of the features whose share of label 1 differs most from that of all rows, at most ``kept``."""
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("_label"), F.lit(0))).first()
    if not 0 < ones < n:
        return np.zeros(0, np.uint64)
    share, held = ones / n, F.col("ones") + F.col("zeros")
    errors = F.abs(F.col("ones") - held * share) / F.sqrt(held * share * (1 - share))
    by_key = rows.mapInArrow(counted, "key long, ones long, zeros long").groupBy("key").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    best = by_key.filter(held >= least_rows).select("key", errors.alias("errors")).filter(F.col("errors") >= least_errors).orderBy(F.desc("errors"), "key").limit(kept)
    return np.array([r["key"] for r in best.select("key").collect()], np.int64).view(np.uint64)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, kept: int = KEPT, held_out: int = 1, folds: int = 3, least_rows: int = LEAST_ROWS, least_errors: float = LEAST_ERRORS) -> Weights:
    """Fits on at most ``sample`` labelled documents outside fold ``held_out`` of ``folds``, smallest hashes of the id first.

    Tasks count features and turn texts into places of the kept ones; the driver gets at most ``kept`` keys and kept / 8
    bytes a row. Labels other than 0 and 1 are left out. An id with several labels counts once for each different one,
    and repeated rows of an id each, up to the bound; null texts are empty ones and have no features. Without labelled
    rows, or with one label alone, the model is a bias.
    """
    marked = labels.filter(F.col(label_col).isin(0, 1)).filter(fold(id_col, folds) != held_out).select(F.col(id_col).alias("_key"), F.col(label_col).cast("int").alias("_label")).distinct()
    chosen = marked.orderBy(F.xxhash64(F.col("_key").cast("string")), "_key", "_label").limit(sample)
    rows = staged(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), F.col("_id") == F.col("_key")).drop("_key"), "labelled")
    with small_batches(docs.sparkSession):
        keys = Keys(telling(rows, kept, least_rows, least_errors))
        n = len(keys.keys)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = Hashes()
            for b in slices(batches, "_text"):
                at = [as_bytes(keys.found(grams(t, hashes)), n) for t in texts_of(b, "_text")]
                yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_label"), pa.array(at, pa.binary())], ["_id", "_label", "places"])

        made = rows.mapInArrow(run, f"_id {docs.schema[id_col].dataType.simpleString()}, _label int, places binary")
        taken = made.orderBy(F.xxhash64(F.col("_id").cast("string")), "_id", "_label", "places").limit(sample).collect()
    release(rows)
    bias, w = ftrl([from_bytes(bytes(r["places"]), n) for r in taken], np.array([r["_label"] for r in taken], float), n)
    used = np.flatnonzero(w)
    return Weights(bias, keys.keys[used], w[used])


def score_documents(docs: DataFrame, model: Weights, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", held_out: int = 1, folds: int = 3) -> DataFrame:
    """id, held_out, score and predicted (1 from ``threshold`` on) of each document.

    Null and empty texts, and texts without letters, score by the bias alone; very long texts are read whole; repeated
    rows stay repeated and score alike; null ids stay, as the empty text for the fold; other columns are not read,
    whatever their names; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, keys = Hashes(), Keys(model.keys)
        for b in slices(batches, "_text"):
            s = model.scores(texts_of(b, "_text"), hashes, keys)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())], [id_col, "held_out", "score", "predicted"])

    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, held_out boolean, score double, predicted int"
    return staged(docs.select(F.col(id_col), (fold(id_col, folds) == held_out).alias("held_out"), F.col(text_col).alias("_text")).mapInArrow(run, schema), "toxicity")
