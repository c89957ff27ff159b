"""Spelling variants: words one edit apart, found by PartEnum signatures of their letters.

A word's letters with their repetitions are a binary vector: one dimension for the k-th of each letter. One inserted,
deleted or replaced letter changes one or two dimensions, so of four parts of the dimensions at least two agree: every
pair of parts is an exact signature. One edit also leaves the first or the last half of the shorter word in place,
which goes into the key with its length. Equal keys meet in a join, and only verified pairs leave it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.runs import slices
from gridloom.staging import release, small_batches, staged

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Parts of the dimensions; with two changed dimensions PARTS - 2 of them agree at least.
PARTS = 4
CHOSEN = list(combinations(range(PARTS), PARTS - 2))
#: One in so many runs of a document loses a letter, by its hash.
SLIP = 97
#: Distinct words that a task counts before it hands its counts on.
HELD = 300_000
#: Longest word, in bytes, whose hash comes from the document's part by the table.
SHORT = 64


def crc_table() -> np.ndarray:
    """What a byte leaves behind in a crc32 register."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = (t >> 1) ^ np.where(t & 1, np.uint32(0xEDB88320), np.uint32(0))
    return t


def moved_on(registers: np.ndarray, most: int) -> np.ndarray:
    """Registers after 0 to ``most`` zero bytes, one column for each.

    crc32 is linear: crc32(head + word) = crc32(word) ^ crc32(head) moved on by the length of the word.
    """
    table, out = crc_table(), np.zeros((len(registers), most + 1), np.uint32)
    out[:, 0] = registers
    for i in range(1, most + 1):
        out[:, i] = table[out[:, i - 1] & 255] ^ (out[:, i - 1] >> 8)
    return out


def without(word: str, h: int) -> str:
    at = h % len(word)
    return word[:at] + word[at + 1 :]


class Counts(dict):
    """Word -> place in the lists of its crc32, byte length and count."""

    def __init__(self) -> None:
        self.crc: list[int] = []
        self.size: list[int] = []
        self.n = np.zeros(0, np.int64)

    def __missing__(self, word: str) -> int:
        raw = word.encode()
        self.crc.append(zlib.crc32(raw))
        self.size.append(len(raw))
        self[word] = len(self.crc) - 1
        return len(self.crc) - 1

    def add(self, ids: list, texts: list[str]) -> None:
        """Counts the runs of whole texts, after the slips that their hashes ask for."""
        heads = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
        runs = [RUN.findall(t.encode().lower().decode()) for t in texts]  # bytes lower only A-Z
        words = [w for r in runs for w in r]
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        doc = np.repeat(np.arange(len(runs)), [len(r) for r in runs])
        crc, size = np.array(self.crc, np.uint32), np.array(self.size, np.int64)
        near = size[at] <= SHORT
        h = np.zeros(len(at), np.uint32)
        h[near] = crc[at[near]] ^ moved_on(heads, SHORT)[doc[near], size[at[near]]]
        for i in np.flatnonzero(~near).tolist():
            h[i] = zlib.crc32(words[i].encode(), int(heads[doc[i]]))
        slipped = np.flatnonzero(h % SLIP == 0)
        changed = np.array([self[without(words[i], int(h[i]))] for i in slipped.tolist()], np.int64)
        at[slipped] = changed
        counted = np.bincount(at, minlength=len(self.crc))
        counted[: len(self.n)] += self.n
        self.n = counted

    def handed_on(self, least: int) -> pa.RecordBatch:
        """(word, n) of words of ``least`` letters or more, and starts anew."""
        long = [(w, n) for w, n in zip(self, self.n.tolist()) if n and len(w) >= least]
        self.clear()
        self.__init__()
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in long], pa.string()), pa.array([n for _, n in long], pa.int64())], ["word", "n"])


def vocabulary(docs: DataFrame, id_col: str, text_col: str, least_letters: int, least_count: int) -> DataFrame:
    """(word, n): words of whole texts with their occurrences; tasks add up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counts()
        for b in slices(batches, "_text"):
            held.add(b.column("_id").to_pylist(), [t or "" for t in b.column("_text").to_pylist()])
            if len(held) >= HELD:
                yield held.handed_on(least_letters)
        yield held.handed_on(least_letters)

    words = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def part_codes(words: list[str]) -> np.ndarray:
    """For each word 16 bits for the dimensions that it holds in each part, whatever their order."""
    sizes = [len(w) for w in words]
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    word = np.repeat(np.arange(len(words)), sizes)
    order = np.lexsort((letters, word))
    letters, word = letters[order], word[order]
    first = np.append(True, (letters[1:] != letters[:-1]) | (word[1:] != word[:-1]))
    place = np.arange(len(letters))
    kth = place - np.maximum.accumulate(np.where(first, place, 0))
    sums = np.zeros(len(words) * PARTS, np.uint64)
    np.add.at(sums, word * PARTS + (letters + kth) % PARTS, mixed((letters << 32 | kth).astype(np.uint64)))
    return (mixed(sums) >> np.uint64(48)).reshape(-1, PARTS)


def half(shorter: int) -> int:
    return shorter // 2


def anchor(word: str, shorter: int, last: int) -> str:
    """The half that an edit leaves in place, where the shorter word of a pair has so many letters: first, or last."""
    return word[len(word) - (shorter - half(shorter)) :] if last else word[: half(shorter)]


def signature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, which, last, shorter, codes, word, n): the signatures of each word.

    A word meets others as the shorter one (or of equal length), and as the longer one.
    """
    for batch in batches:
        for start in range(0, batch.num_rows, 2_000):
            b = batch.slice(start, 2_000)
            words = b.column(0).to_pylist()
            codes = part_codes(words)
            packed = sum(codes[:, i] << np.uint64(16 * i) for i in range(PARTS)).view(np.int64)
            out: list[list[np.ndarray]] = [[] for _ in range(4)]
            for less in (0, 1):
                shorter = np.array([len(w) - less for w in words])
                for last in (0, 1):
                    at = np.array([xxhash.xxh64_intdigest(anchor(w, s, last)) for w, s in zip(words, shorter.tolist())], np.uint64)
                    base = mixed(at + mixed((shorter * 2 + last).astype(np.uint64)))
                    for which, chosen in enumerate(CHOSEN):
                        key = mixed(base + np.uint64(which + 1))
                        for c in chosen:
                            key = mixed(key + codes[:, c])
                        for held, x in zip(out, (key.view(np.int64), np.full(len(words), which), np.full(len(words), last), shorter)):
                            held.append(x)
            times = len(out[0])
            rows = np.tile(np.arange(len(words)), times)
            columns = [np.concatenate(x) for x in out]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0]), *(pa.array(x, pa.int32()) for x in columns[1:]), pa.array(packed[rows]), b.column(0).take(pa.array(rows)), b.column(1).take(pa.array(rows))], ["key", "which", "last", "shorter", "codes", "word", "n"])


SIGNATURES = "key long, which int, last int, shorter int, codes long, word string, n long"


def agree(part: int) -> Column:
    mask = 0xFFFF << (16 * part)
    return (F.col("l.codes").bitwiseXOR(F.col("r.codes"))).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)) == 0


def first_signature() -> Column:
    """Whether a signature is the first of those that a pair shares: no earlier choice of parts agrees."""
    earlier = F.lit(False)
    for i in range(1, len(CHOSEN)):
        taken = F.lit(False)
        for chosen in CHOSEN[:i]:
            same = agree(chosen[0])
            for c in chosen[1:]:
                same = same & agree(c)
            taken = taken | same
        earlier = F.when(F.col("l.which") == i, taken).otherwise(earlier)
    return ~earlier


def near_pairs(words: DataFrame, parallel: int) -> DataFrame:
    """(word, n, near, near_n): each pair of words one edit apart once, by (word, n) distinct.

    Spark takes the size of the signatures for little more than that of the words, though each word has 24 of them, so
    without the hint it would broadcast them all.
    """
    signs = words.repartition(parallel, "word").mapInArrow(signature_rows, SIGNATURES)
    same = (F.col("l.key") == F.col("r.key")) & (F.col("l.which") == F.col("r.which")) & (F.col("l.last") == F.col("r.last")) & (F.col("l.shorter") == F.col("r.shorter"))
    start = F.expr("left(l.word, l.shorter div 2) = left(r.word, l.shorter div 2)")
    verified = (F.col("l.word") < F.col("r.word")) & first_signature() & ((F.col("l.last") == 0) | ~start) & (F.least(F.length("l.word"), F.length("r.word")) == F.col("l.shorter")) & (F.levenshtein(F.col("l.word"), F.col("r.word"), 1) == 1)
    return signs.alias("l").join(signs.alias("r").hint("merge"), same & verified).select("l.word", "l.n", F.col("r.word").alias("near"), F.col("r.n").alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form) by doubling steps: each round joins a word's goal to the goal of that goal."""
    at = staged(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while at.filter("moved").limit(1).count():
        further = at.select(F.col("word").alias("_from"), F.col("root").alias("_to"))
        stepped = staged(at.join(further.hint("merge"), F.col("root") == F.col("_from"), "left").select("word", F.coalesce("_to", "root").alias("root"), F.col("_to").isNotNull().alias("moved")), "roots")
        release(at)
        at = stepped
    return at.select("word", "root")


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = 5, least_count: int = 3) -> DataFrame:
    """word, form, root, n, n_near and form_n of each word of ``least_letters`` letters and ``least_count`` occurrences.

    A form is the near word of largest n, of equal ones the smallest in code-point order, if it is twice as frequent.
    Null and empty texts hold no words; null ids count as the empty text in the hash; repeated rows count each time;
    texts are read whole and words may have any length; other columns are not read, whatever their names; an empty
    table gives no rows. n at least doubles from word to form, so there are no cycles and chains are short.
    """
    spark = docs.sparkSession
    parallel = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    words = staged(vocabulary(docs, id_col, text_col, least_letters, least_count), "words")
    with small_batches(spark):
        pairs = staged(near_pairs(words, parallel), "pairs")
    both = pairs.select("word", "n", "near", "near_n").union(pairs.select("near", "near_n", "word", "n"))
    best = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    more = -F.col("best.less") >= 2 * F.col("n")
    linked = staged(best.select("word", "n_near", F.when(more, F.col("best.near")).alias("form"), F.when(more, -F.col("best.less")).alias("form_n")), "forms")
    ends = roots(linked.filter(F.col("form").isNotNull()))
    release(pairs)
    out = words.join(linked.hint("merge"), "word", "left").join(ends.hint("merge"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
