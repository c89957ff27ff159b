"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint of 64 bits is split into blocks so that two of them at no more than d differing bits share n - d of n
blocks. Fingerprints join on each choice of n - d blocks and are then verified by Hamming distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.runs import slices
from gridloom.llm.tiles import TILE_BYTES, TILE_ROWS, Hamming, Overlap, links
from gridloom.operators.graph import connected_components
from gridloom.staging import release, staged

SEED = 42
#: Ids up to which the list of later copies is broadcast; beyond it the tables are shuffled.
BROADCAST_ROWS = 500_000
#: Near copies: five-word shingles of which at least this share of all is common to both texts.
WORDS, LEAST = 5, 0.8
#: Candidates for them: fingerprints of the different words of a text, by three seeds. An edit changes few words but
#: many shingles, so these stay closer than fingerprints of shingles do.
SEEDS, DISTANCE, BLOCKS = (42, 43, 44), 5, 7


def fingerprint(raw: bytes, shingle: int = 3, seed: int = SEED, distinct: bool = False) -> int:
    """Majority of the XXH64 bits of word shingles, A-Z lower-cased, repeats included unless distinct; 0 without words."""
    words = raw.lower().split()  # of bytes: ASCII white space and letters only
    if not words:
        return 0
    parts = words if shingle == 1 else map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(p, seed) for p in (set(parts) if distinct else parts)), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[at : at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, seeds: tuple[int, ...] = (SEED,), distinct: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, digest (of the lower-cased words) and fp0, fp1, ... (64 bits as signed longs, one for each seed); null and empty
    texts have fingerprint 0."""
    names = [f"fp{i}" for i in range(len(seeds))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            texts = [t or b"" for t in b.column("_text").cast(pa.binary()).to_pylist()]
            fps = [np.array([fingerprint(t, shingle, seed, distinct) for t in texts], np.uint64).view(np.int64) for seed in seeds]
            digests = [hashlib.blake2b(b" ".join(t.lower().split()), digest_size=16).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.binary()), *map(pa.array, fps)], [id_col, "digest", *names])

    schema = ", ".join([f"{id_col} long, digest binary", *(f"{n} long" for n in names)])
    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("_text")).mapInArrow(run, schema)


def block_keys(fp, distance: int, blocks: int, seed: int = 0):
    """One key for each choice of ``blocks - distance`` blocks: a hash of their bits and the numbers of choice and seed."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for n, choice in enumerate(combinations(range(blocks), blocks - distance)):
        mask = sum(((1 << edges[b + 1]) - (1 << edges[b])) for b in choice)
        keys.append(F.xxhash64(fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")), F.lit(n), F.lit(seed)))
    return F.array(*keys)


def linked_fingerprints(nodes: DataFrame, distance: int = 3, blocks: int = 5, seeds: int = 1, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(src, dst): links among rows (node, fp0, ...) whose components are those of all pairs that differ in at most
    ``distance`` bits of the fingerprint of any seed.

    Rows meet those that share a choice of blocks with them. No block is dropped or cut: large ones are compared in
    tiles (see tiles.links), so links grow with the rows and not with their pairs.
    """
    keyed = [nodes.select(F.explode(block_keys(F.col(f"fp{i}"), distance, blocks, i)).alias("group"), "node", F.col(f"fp{i}").alias("data")) for i in range(seeds)]
    rows = keyed[0]
    for more in keyed[1:]:
        rows = rows.union(more)
    rows = staged(rows, "blocks")
    found = links(rows, Hamming(distance), tile_rows)
    release(rows)
    return found


def near_duplicates(docs: DataFrame, distance: int = 3, blocks: int = 5, shingle: int = 3, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", tile_rows: int = TILE_ROWS) -> DataFrame:
    """One row for each document: id, fingerprint (16 hex digits), component_id (smallest id reachable).

    Two documents are linked if their fingerprints differ in at most ``distance`` bits. Documents of one fingerprint
    hang on their smallest id, so copies never form pairs. Ids are integers. Null, empty and blank texts have
    fingerprint zero and are linked like any other; very long texts count whole; repeated rows stay repeated; rows with
    a null id have a fingerprint, no component, and link nothing; other columns are not read. An empty table gives no
    rows.
    """
    fps = staged(fingerprints(docs, shingle, (seed,), False, id_col, text_col), "fingerprints")
    own = fps.filter(F.col(id_col).isNotNull())
    nodes = staged(own.groupBy("fp0").agg(F.min(id_col).alias("node")), "nodes")
    copies = own.join(nodes, "fp0").filter(F.col(id_col) != F.col("node")).select(F.col(id_col).alias("src"), F.col("node").alias("dst"))
    members = connected_components(linked_fingerprints(nodes, distance, blocks, 1, tile_rows).union(copies))
    return fps.join(members, fps[id_col] == members["node"], "left").select(id_col, F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), F.coalesce("component", id_col).alias("component_id"))


def shingle_hashes(raw: bytes, words: int = WORDS) -> np.ndarray:
    """The different XXH64 hashes of a text's shingles, sorted; of a shorter text that of all its words."""
    own = raw.lower().split()
    parts = map(b" ".join, zip(*(own[i:] for i in range(words)))) if len(own) >= words else [b" ".join(own)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64))


def near_copies(docs: DataFrame, words: int = WORDS, least: float = LEAST, seeds: tuple[int, ...] = SEEDS, distance: int = DISTANCE, blocks: int = BLOCKS, id_col: str = "doc_id", text_col: str = "text", tile_rows: int = TILE_ROWS) -> DataFrame:
    """(id, component_id) of each document that has a copy or near copy: the smallest id that links of near copies reach.

    Fingerprints of the different words of a text, within ``distance`` bits for any seed, give components of candidates.
    Within those, texts are linked whose shingles of ``words`` words have a Jaccard similarity of ``least`` or more, all
    pairs considered; so a link is exact, and one is missed only where no fingerprints connect its ends. Equal texts
    (but for case and white space) are one text. Ids are integers; rows with a null id take no part; rows of one id are
    one document; null and empty texts are copies of each other; an empty table gives no rows.
    """
    fps = staged(fingerprints(docs, 1, seeds, True, id_col, text_col).filter(F.col(id_col).isNotNull()), "fingerprints")
    names = [f"fp{i}" for i in range(len(seeds))]
    nodes = staged(fps.groupBy("digest").agg(F.min(id_col).alias("node"), *(F.min(n).alias(n) for n in names)), "nodes")
    candidates = staged(connected_components(linked_fingerprints(nodes, distance, blocks, len(seeds), tile_rows)), "candidates")
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("_text")).join(candidates, "node").select("component", "node", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([shingle_hashes(t or b"", words).astype("<u8").tobytes() for t in b.column(2).cast(pa.binary()).to_pylist()], pa.binary())], ["group", "node", "data"])

    shingles = staged(texts.mapInArrow(run, "group long, node long, data binary"), "shingles")
    verified = links(shingles, Overlap(least), tile_rows, TILE_BYTES)
    release(shingles)
    copies = fps.join(nodes.select("digest", "node"), "digest").filter(F.col(id_col) != F.col("node")).select(F.col(id_col).alias("src"), F.col("node").alias("dst"))
    return connected_components(verified.union(copies)).select(F.col("node").alias(id_col), F.col("component").alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents without those that near_copies links to a smaller id; of repeated rows of one id one stays.

    That is the row of the least text (null first), then of the least hash of its other columns. Rows with a null id
    stay. All columns are kept; their names can't clash with any used here.
    """
    gone, again = f"{id_col}_gone", f"{id_col}_again"
    later = near_copies(docs, id_col=id_col, text_col=text_col, **how).filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(gone))
    later = staged(later, "later-copies")
    kept = docs.join(F.broadcast(later) if later.count() <= BROADCAST_ROWS else later, docs[id_col] == later[gone], "left_anti")
    repeated = staged(docs.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias(again)).agg(F.count("*").alias("n")).filter("n > 1").select(again), "repeated-ids")
    if repeated.isEmpty():
        return kept
    same = kept[id_col] == repeated[again]
    row = F.struct(*(kept[c] for c in docs.columns))
    hashed = F.xxhash64(*(kept[f.name] for f in docs.schema if "map<" not in f.dataType.simpleString()))
    first = kept.join(repeated, same, "left_semi").groupBy(F.col(id_col)).agg(F.min_by(row, F.struct(F.col(text_col), hashed)).alias("row")).select("row.*")
    return kept.join(repeated, same, "left_anti").union(first)
