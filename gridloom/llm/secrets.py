"""Secret scans with corpus-wide ownership frequency.

A scan finds spans by pattern and also weaker candidates (long mixed tokens). Hashes of all their values are aggregated
over the corpus by distinct repositories (documents) and owners: a value that several owners hold, or very many
repositories of one owner, is a copied example; one that few repositories of a single owner hold looks live. Weak
candidates count as secrets only where they look live.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.runs import fresh, slices
from gridloom.staging import staged

KINDS = ("assign", "access", "hex", "token")
# The patterns of the base kinds and their least lengths.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGNED = 6
# Parameters of the method's own kind.
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}(?![A-Za-z0-9_-])", re.ASCII)
LEAST_DIGITS, LEAST_LETTERS, LEAST_BITS = 3, 3, 3.0
MOST_OWNERS, MOST_REPOS = 1, 8

#: Documents with secrets up to which their spans are broadcast; beyond it the tables are shuffled.
BROADCAST_ROWS = 200_000

SPAN = "struct<start:long,kind:int,end:long,value:long>"


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the base kinds, leftmost non-overlapping within each."""
    low = text.lower()
    found = []
    if any(k in low for k in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def bits(token: str) -> float:
    return -sum(c / len(token) * math.log2(c / len(token)) for c in Counter(token).values())


def weak_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    out = []
    for m in TOKEN.finditer(text):
        digits = sum(c.isdigit() for c in m[0])
        if digits >= LEAST_DIGITS and sum(c.isalpha() for c in m[0]) >= LEAST_LETTERS and bits(m[0]) >= LEAST_BITS and not any(s < m.end() and m.start() < e for s, _, e, _ in base):
            out.append((m.start(), 3, m.end(), m[0]))
    return out


def value_hash(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "big", signed=True)


def scan(docs: DataFrame, id_col: str, text_col: str, owner_col: str) -> DataFrame:
    """_row, id, owner, _hash (of the text) and the arrays ``base`` and ``weak`` of (start, kind, end, value hash) for each document."""
    schema = f"_row long, {id_col} {docs.schema[id_col].dataType.simpleString()}, _owner string, _hash long, base array<{SPAN}>, weak array<{SPAN}>"
    span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("value", pa.int64())]))
    rows = lambda found: [{"start": s, "kind": k, "end": e, "value": value_hash(v)} for s, k, e, v in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            base, weak = [], []
            for t in b.column("_text").to_pylist():
                found = base_spans(t or "")
                base.append(rows(found))
                weak.append(rows(weak_spans(t or "", found)))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(base, span), pa.array(weak, span)], ["_row", id_col, "_owner", "_hash", "base", "weak"])

    return docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col), F.col(owner_col).cast("string").alias("_owner"), F.xxhash64(text_col).alias("_hash"), F.col(text_col).alias("_text")).mapInArrow(run, schema)


def ownership(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """For each candidate hash the distinct repositories (documents) and owners; a null owner counts as one owner."""
    held = scanned.select(F.col(id_col).alias("_repo"), F.coalesce("_owner", F.lit("")).alias("_owner"), F.explode(F.array_distinct(F.transform(F.concat("base", "weak"), lambda s: s["value"]))).alias("value"))
    return held.groupBy("value").agg(F.countDistinct("_repo").alias("n_repos"), F.countDistinct("_owner").alias("n_owners"))


def joined(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def told(held: Column) -> Column:
    """kind:start:repositories:owners of spans, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(held, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), *(s[f].cast("string") for f in ("start", "n_repos", "n_owners")))), ",")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", most_owners: int = MOST_OWNERS, most_repos: int = MOST_REPOS) -> DataFrame:
    """One row for each document: id, found (spans by start, then kind), base, n_live, n_copied, held, _hash (of the text).

    found holds the base spans and those weak candidates that at most ``most_owners`` owners and ``most_repos``
    repositories hold; each span has start, kind (place in KINDS), end and the hash of its value. held tells of every
    base and weak span by start the numbers of repositories and owners; n_live and n_copied count them by ownership.
    Null and empty texts have no spans; very long texts are scanned whole; repeated rows stay repeated and count as one
    repository, as do all rows of a null id; only the three named columns are read. An empty table gives no rows.
    """
    scanned = staged(scan(docs, id_col, text_col, owner_col), "secret-scan")
    owned = staged(ownership(scanned, id_col), "secret-owners")
    spans = scanned.filter((F.size("base") > 0) | (F.size("weak") > 0)).select("_row", F.explode(F.concat("base", "weak")).alias("span")).withColumn("value", F.col("span.value"))
    told = spans.join(owned, "value").withColumn("live", (F.col("n_owners") <= most_owners) & (F.col("n_repos") <= most_repos))
    by_row = told.groupBy("_row").agg(
        F.array_sort(F.collect_list(F.when(F.col("live") & (F.col("span.kind") == 3), F.col("span")))).alias("added"),
        F.count_if("live").alias("n_live"),
        F.count_if(~F.col("live")).alias("n_copied"),
        F.array_sort(F.collect_list(F.struct("span.start", "span.kind", "n_repos", "n_owners"))).alias("held"),
    )
    empty = lambda kind: F.array().cast(kind)
    return scanned.join(by_row, "_row", "left").select(
        id_col,
        F.array_sort(F.concat("base", F.coalesce("added", empty(f"array<{SPAN}>")))).alias("found"),
        "base",
        F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
        F.coalesce("held", empty("array<struct<start:long,kind:int,n_repos:long,n_owners:long>>")).alias("held"),
        "_hash",
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", mask: str = "[SECRET]", length_col: str | None = "n_chars") -> DataFrame:
    """The documents with every span of find_secrets replaced by ``mask``; overlapping spans merge first.

    Rows and columns stay as they are, whatever the names of others; texts without spans stay the same, null and empty
    ones included; very long texts are masked whole. Repeated rows are redacted each by its own text. ``length_col`` (if
    there) becomes the new length in code points. An empty table gives no rows. ``docs`` is read again for the texts
    without spans, which no Python sees.
    """
    spans, key, digest = (fresh(n, docs.columns) for n in ("_found", "_id", "_hash"))
    found = find_secrets(docs, id_col, text_col, owner_col).filter(F.size("found") > 0).select(F.col(id_col).alias(key), F.col("_hash").alias(digest), F.col("found").alias(spans))
    found = staged(found.dropDuplicates([key, digest]), "secrets")
    side = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col):
            found = b.column(spans).to_pylist()
            texts = [cut(t, [(s["start"], s["end"]) for s in f], mask) if f and t else t for t, f in zip(b.column(text_col).to_pylist(), found)]
            yield with_texts(b, text_col, texts, [bool(f) for f in found], length_col).drop_columns([spans])

    same = docs[id_col].eqNullSafe(side[key]) & (F.xxhash64(docs[text_col]) == side[digest])
    return docs.join(side, same, "left_anti").union(staged(docs.join(side, same).select(*docs.columns, spans).mapInArrow(run, docs.schema), "redacted"))


def with_texts(batch: pa.RecordBatch, text_col: str, texts: list[str | None], changed: list[bool], length_col: str | None) -> pa.RecordBatch:
    """The batch with other texts and, where they changed, other lengths."""
    batch = batch.set_column(batch.schema.get_field_index(text_col), text_col, pa.array(texts, pa.string()))
    i = batch.schema.get_field_index(length_col) if length_col else -1
    if i >= 0:
        lengths = [len(t) if c and t is not None else n for t, c, n in zip(texts, changed, batch.column(i).to_pylist())]
        batch = batch.set_column(i, length_col, pa.array(lengths, batch.schema.field(i).type))
    return batch


def cut(text: str, spans: list[tuple[int, int]], mask: str = "") -> str:
    """The text with each run of overlapping spans replaced by ``mask``."""
    out, at = [], 0
    for s, e in sorted(spans):
        if s >= at:
            out += [text[at:s], mask]
        at = max(at, e)
    return "".join([*out, text[at:]])
