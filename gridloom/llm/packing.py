"""Best-fit packing by minimum bin slack.

A sequence is filled by the combination of available lengths that leaves the least slack, found by subset-sum dynamic
programming over bitsets, and that combination is removed. Only lengths decide a combination, so it is drawn from the
histogram of lengths (one count for each length up to the sequence size) and removed as often as its counts allow; the
pieces then take their places by rank within their length, without gathering any of them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gridloom.llm.bpe import rank_encoding
from gridloom.llm.runs import fresh, slices
from gridloom.staging import staged

#: Pieces of one length that a task ranks; a length has as many buckets as its pieces need.
RANKED = 50_000


def cut_lengths(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole sequences behind a first piece that may be shorter."""
    first = n - size * (-(-n // size) - 1)
    return [(0, first), *((s, size) for s in range(first, n, size))]


def tokenize_pieces(docs: DataFrame, vocabulary: str, size: int, end_id: int | None, id_col: str, text_col: str) -> DataFrame:
    """(id, piece, start, length, ids_crc32): the pieces of every text's ids and its end id.

    A null or empty text has its end id alone, and no piece without one; very long texts are cut into as many pieces as
    they need; repeated rows stay repeated; other columns are not read; an empty table gives no rows.
    """
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = rank_encoding(vocabulary)
        tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        for part in slices(batches, "_text"):
            rows: list[tuple] = []
            for k, text in enumerate(part.column("_text").to_pylist()):
                raw = enc.encode_to_numpy(text or "", allowed_special="all").astype("<u4").tobytes() + tail
                rows += [(k, j, s, n, zlib.crc32(raw[4 * s : 4 * (s + n)])) for j, (s, n) in enumerate(cut_lengths(len(raw) // 4, size)) if n]
            if rows:
                k, piece, start, length, crc = map(list, zip(*rows))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(k)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], [id_col, "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col), F.col(text_col).alias("_text")).mapInArrow(run, schema)


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> list[tuple[int, int]]:
    """The fullest combination of at most ``room`` that holds the longest length, as (length, copies).

    lengths: those with counts, longest first. Bit t of the set says that t can be reached; each added copy is kept
    with the set before it, to walk back.
    """
    longest = lengths[0]
    free, mask = room - longest, (1 << (room - longest + 1)) - 1
    reach, steps = 1, []
    for n in lengths:
        if n > free:
            continue
        for _ in range(min(counts[n] - (n == longest), free // n)):
            more = (reach | reach << n) & mask
            if more == reach:
                break
            steps.append((n, reach))
            reach = more
        if reach >> free & 1:
            break
    t, used = reach.bit_length() - 1, {longest: 1}
    for n, was in reversed(steps):
        if not was >> t & 1:
            used[n] = used.get(n, 0) + 1
            t -= n
    return sorted(used.items(), reverse=True)


def plan_bins(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, end rank, copies in a bin, first bin, offset of the first copy).

    Every step uses up all but a remainder of one length, so the rows depend on the number of lengths, not of pieces.
    """
    counts = {n: c for n, c in counts.items() if c}
    taken, out, bins = dict.fromkeys(counts, 0), [], 0
    lengths = sorted(counts, reverse=True)
    while lengths:
        combo = fullest(counts, lengths, size)
        times, offset = min(counts[n] // m for n, m in combo), 0
        for n, m in combo:
            out.append((n, taken[n], taken[n] + m * times, m, bins, offset))
            taken[n] += m * times
            counts[n] -= m * times
            offset += n * m
        bins += times
        lengths = [n for n in lengths if counts[n]]
    return out


def pack_pieces(pieces: DataFrame, size: int = 2048, length_col: str = "length", order_cols: tuple[str, ...] = ("doc_id", "piece"), ranked: int = RANKED) -> DataFrame:
    """Adds sequence_id and offset to rows that have a length from 1 to ``size``; sequences hold no gaps.

    Rows are ranked within their length by hash buckets of about ``ranked`` rows: counts of (length, bucket) give each
    bucket its first rank, so no window holds all rows of one length. Equal rows take any order of their own; an empty
    table gives no rows; other columns stay, whatever their names. ``pieces`` has to read the same rows each time it is
    read (a staged table).
    """
    spark, columns = pieces.sparkSession, pieces.columns
    of, bucket, n, first, rank = (fresh(c, columns) for c in ("_length", "_bucket", "_n", "_first", "_rank"))
    histogram = {r[0]: r[1] for r in pieces.groupBy(length_col).agg(F.count("*")).collect()}  # one row for each length up to size
    many = spark.createDataFrame([(k, -(-c // ranked)) for k, c in histogram.items()], f"{of} long, {n} long")
    bucketed = pieces.join(F.broadcast(many), pieces[length_col] == F.col(of)).withColumn(bucket, F.pmod(F.xxhash64(*order_cols), F.col(n))).drop(of, n)
    per = staged(bucketed.groupBy(F.col(length_col).alias(of), bucket).agg(F.count("*").alias(n)), "length-counts")
    before = Window.partitionBy(of).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    firsts = per.select(of, F.col(bucket).alias(n), F.coalesce(F.sum(n).over(before), F.lit(0)).alias(first))
    placed = bucketed.withColumn(rank, F.row_number().over(Window.partitionBy(length_col, bucket).orderBy(*order_cols)) - 1)
    placed = placed.join(firsts, (F.col(length_col) == F.col(of)) & (F.col(bucket) == F.col(n))).select(*columns, (F.col(first) + F.col(rank)).alias(rank))
    plan = np.array(plan_bins(histogram, size), np.int64).reshape(-1, 6)  # a few rows for each length
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    begin = plan[:, 0] * (int(plan[:, 2].max(initial=0)) + 1) + plan[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, at = (b.column(c).to_numpy().astype(np.int64) for c in (length_col, rank))
            row = np.searchsorted(begin, length * (int(plan[:, 2].max(initial=0)) + 1) + at, "right") - 1
            _, start, _, copies, bins, offset = plan[row].T
            sequence, within = np.divmod(at - start, np.maximum(copies, 1))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(bins + sequence), pa.array(offset + within * length)], [*columns, "sequence_id", "offset"])

    return placed.mapInArrow(place, StructType([*pieces.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())]))


def pack_documents(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", size: int = 2048, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text counts as empty and still holds its end id (without one it has no piece); very long texts are cut into
    pieces; repeated rows are packed each for itself; other columns are not read. An empty table gives no rows.
    """
    pieces = staged(tokenize_pieces(docs, vocabulary, size, end_id, id_col, text_col), "pieces")
    return pack_pieces(pieces, size, "length", (id_col, "piece", "start"))
