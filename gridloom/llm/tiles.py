"""Links whose components are those of all pairs in groups of any size, compared in tiles of bounded size.

Rows (group, node, data) of one group may be linked by a measure. Groups are cut into tiles by hash; each tile gives a
spanning forest, and each task joins what its tiles found, so links grow with the rows and not with their pairs.
Groups of several tiles are then compared with their best linked row, dealt anew a few times, and at last compared
exactly between tiles, but only rows that no links join yet: a link can only be missing between those.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.runs import sorted_runs, starts
from gridloom.operators.graph import connected_components
from gridloom.staging import staged

TILE_ROWS, TILE_BYTES = 2_000, 16 << 20
#: Nodes whose links a task joins before it hands them on.
HELD_NODES = 200_000
#: Times that groups of several tiles are dealt anew, each time in one tile a row, before all tiles meet.
DEALT_ANEW = 3
PAIRS = "src long, dst long"


class Hamming:
    """Rows of 64 bits (data long) that differ in at most ``most``."""

    def __init__(self, most: int):
        self.most = most

    def size(self) -> Column:
        return F.lit(8)

    def read(self, column: pa.ChunkedArray) -> np.ndarray:
        return column.to_numpy().view(np.uint64)

    def pairs(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.bitwise_count(x ^ y) <= self.most

    def near(self, data: np.ndarray) -> Callable[[int, np.ndarray], np.ndarray]:
        return lambda x, others: np.bitwise_count(data[others] ^ data[x]) <= self.most


class Overlap:
    """Rows of sorted different 64-bit hashes (data binary) whose Jaccard similarity is at least ``least``."""

    def __init__(self, least: float):
        self.least = least

    def size(self) -> Column:
        return F.octet_length("data")

    def read(self, column: pa.ChunkedArray) -> np.ndarray:
        rows = column.to_pylist()
        out = np.empty(len(rows), object)
        for i, raw in enumerate(rows):
            out[i] = np.frombuffer(raw, "<u8")
        return out

    def enough(self, common, x, y):
        return common >= self.least * (x + y - common) - 1e-9

    def pairs(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.array([self.enough(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b)) for a, b in zip(x, y)], bool)

    def near(self, data: np.ndarray) -> Callable[[int, np.ndarray], np.ndarray]:
        """By the lists of the rows that hold each hash."""
        n = np.array([len(x) for x in data])
        begin = np.append(0, np.cumsum(n))
        number = np.unique(np.concatenate(data), return_inverse=True)[1]
        holders = np.repeat(np.arange(len(n)), n)[np.argsort(number, kind="stable")]
        first = np.append(0, np.cumsum(np.bincount(number)))

        def near(x: int, others: np.ndarray) -> np.ndarray:
            own = number[begin[x] : begin[x + 1]]
            many = first[own + 1] - first[own]
            at = np.repeat(first[own] - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(many.sum())
            return self.enough(np.bincount(holders[at], minlength=len(n))[others], n[x], n[others])

        return near


class Unions:
    """Nodes that links join, under the smallest of each component."""

    def __init__(self):
        self.above: dict[int, int] = {}

    def find(self, x: int) -> int:
        at = x
        while (up := self.above.get(at, at)) != at:
            at = up
        while x != at:
            self.above[x], x = at, self.above[x]
        return at

    def join(self, x: int, y: int) -> None:
        for node in (x, y):
            self.above.setdefault(node, node)
        x, y = self.find(x), self.find(y)
        self.above[max(x, y)] = min(x, y)

    def batch(self) -> pa.RecordBatch:
        rows = [(x, self.find(x)) for x in self.above]
        rows = [r for r in rows if r[0] != r[1]]
        self.above = {}
        return pairs_batch([r[0] for r in rows], [r[1] for r in rows])


def pairs_batch(src: list[int], dst: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])


def forest(near: Callable[[int, np.ndarray], np.ndarray], n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each row with those that it links and that no earlier row reached: a spanning forest of all links."""
    left = np.arange(n)
    while len(left) > 1:
        turn, left = [int(left[0])], left[1:]
        while turn and len(left):
            x = turn.pop()
            hit = near(x, left)
            if hit.any():
                yield x, left[hit]
                turn += left[hit].tolist()
                left = left[~hit]


def within_tiles(tiled: DataFrame, measure) -> DataFrame:
    """(src, dst, group, degree) of rows (group, tile, node, data, tiles) sorted by group and tile: the links found, and
    for each tile of a group of several the row that linked most others, with their number."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    names = ["src", "dst", "group", "degree"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined, hubs = Unions(), []

        def handed() -> pa.RecordBatch:
            b, n = joined.batch(), len(hubs)
            src, dst = [*b.column(0).to_pylist(), *(h[0] for h in hubs)], [*b.column(1).to_pylist(), *(h[0] for h in hubs)]
            group, degree = [*[None] * b.num_rows, *(h[1] for h in hubs)], [*[0] * b.num_rows, *(h[2] for h in hubs)]
            del hubs[:n]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((src, dst, group, degree), kinds)], names)

        for t in sorted_runs(batches, "group", "tile"):
            group, tile, node, several = (t.column(c).to_numpy() for c in ("group", "tile", "node", "tiles"))
            data, at = measure.read(t.column("data")), starts(group, tile)
            two = at[:-1][np.diff(at) == 2]
            two = two[measure.pairs(data[two], data[two + 1])]
            for x, y in zip(node[two].tolist(), node[two + 1].tolist()):
                joined.join(x, y)
            most = dict.fromkeys(two[several[two] > 1].tolist(), 1)
            for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
                if j - i > 2:
                    for x, ys in forest(measure.near(data[i:j]), j - i):
                        for y in node[i:j][ys].tolist():
                            joined.join(int(node[i + x]), y)
                        if several[i] > 1:
                            most[i + x] = len(ys)
            best: dict[int, tuple[int, int]] = {}
            for x, n in most.items():
                best[int(group[x])] = max(best.get(int(group[x]), (0, 0)), (n, int(node[x])))
            hubs += [(x, g, n) for g, (n, x) in best.items()]
            if len(joined.above) > HELD_NODES:
                yield handed()
        yield handed()

    return tiled.repartition("group", "tile").sortWithinPartitions("group", "tile", "node").mapInArrow(run, f"{PAIRS}, group long, degree long")


def with_hubs(rows: DataFrame, hubs: DataFrame, measure) -> DataFrame:
    """Links of each row with the best linked row of its group."""
    hub = rows.join(hubs, (rows["group"] == hubs["of"]) & (rows["node"] == hubs["hub"])).select("of", "hub", F.col("data").alias("hub_data"))
    both = rows.join(hub, rows["group"] == hub["of"]).filter("node <> hub").select("node", "hub", "data", "hub_data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = measure.pairs(*(measure.read(pa.chunked_array([b.column(c)])) for c in ("data", "hub_data")))
            yield pairs_batch(b.column("node").to_numpy()[hit].tolist(), b.column("hub").to_numpy()[hit].tolist())

    return both.mapInArrow(run, PAIRS)


def split_groups(rows: DataFrame, labels: DataFrame, large: DataFrame, measure, tile_rows: int, tile_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Rows (group, node, data, label) of large groups, and the groups that still have several labels: group, main (the
    commonest label), and the tiles of its rows (mains), of the other ones (rests) and of all (tiles)."""
    named = rows.join(large.select("group"), "group").join(labels, rows["node"] == labels["labelled"], "left").select("group", "node", "data", F.coalesce("label", "node").alias("label"))
    tiles = lambda n, size: F.ceil(F.greatest(n / tile_rows, size / tile_bytes, F.lit(1.0))).cast("int")
    per = named.groupBy("group", "label").agg(F.count("*").alias("n"), F.sum(measure.size()).alias("size"))
    of = per.groupBy("group").agg(F.max_by("label", "n").alias("main"), F.max("n").alias("n_main"), F.max_by("size", "n").alias("size_main"), F.sum("n").alias("n"), F.sum("size").alias("size"))
    of = of.filter("n > n_main").select("group", "main", tiles(F.col("n_main"), F.col("size_main")).alias("mains"), tiles(F.col("n") - F.col("n_main"), F.col("size") - F.col("size_main")).alias("rests"), tiles(F.col("n"), F.col("size")).alias("tiles"))
    return named, staged(of, "split-groups")


def dealt_anew(named: DataFrame, of: DataFrame, turn: int) -> DataFrame:
    """Every row in one tile of its group, by a new hash."""
    tile = F.pmod(F.xxhash64("node", "group", F.lit(turn)), F.col("tiles")).cast("int")
    return named.join(of.select("group", "tiles"), "group").select("group", F.lit(1).alias("kind"), tile.alias("i"), tile.alias("j"), "node", "data", "label", F.lit(False).alias("main"))


def all_meetings(named: DataFrame, of: DataFrame) -> DataFrame:
    """The rows of the commonest label with the others, and the others with each other, for each pair of their tiles."""
    placed = named.join(of, "group")
    is_main, at = F.col("label") == F.col("main"), F.xxhash64("node", "group")
    own = F.pmod(at, F.when(is_main, F.col("mains")).otherwise(F.col("rests"))).cast("int").alias("own")
    key = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    with_main = F.when(is_main, F.transform(to("rests"), lambda i: key(0, i, F.col("own")))).otherwise(F.transform(to("mains"), lambda j: key(0, F.col("own"), j)))
    with_rest = F.when(is_main, F.array().cast("array<struct<kind:int,i:int,j:int>>")).otherwise(F.transform(to("rests"), lambda i: key(1, F.least(i, F.col("own")), F.greatest(i, F.col("own")))))
    return placed.withColumn("own", own).select("group", "node", "data", "label", is_main.alias("main"), F.explode(F.concat(with_main, with_rest)).alias("k")).select("group", "k.kind", "k.i", "k.j", "node", "data", "label", "main")


def joined_labels(meeting: DataFrame, measure) -> DataFrame:
    """(src, dst): labels that rows which meet join; each task joins what its groups found, so it hands on fewer links
    than it has labels."""
    keys = ("group", "kind", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = Unions()
        for t in sorted_runs(batches, *keys):
            label, main = t.column("label").to_numpy(), t.column("main").to_numpy()
            data, at = measure.read(t.column("data")), starts(*(t.column(c).to_numpy() for c in keys))
            for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
                near = measure.near(data[i:j])
                now = np.fromiter(map(joined.find, label[i:j].tolist()), np.int64, j - i)
                for x in np.flatnonzero(~main[i:j]).tolist():
                    others = np.flatnonzero(now != now[x])
                    hit = others[near(x, others)] if len(others) else others
                    for other in np.unique(now[hit]).tolist():
                        joined.join(int(now[x]), other)
                        now[np.isin(now, (int(now[x]), other))] = min(int(now[x]), other)
            if len(joined.above) > HELD_NODES:
                yield joined.batch()
        yield joined.batch()

    return meeting.repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(run, PAIRS)


def links(rows: DataFrame, measure, tile_rows: int = TILE_ROWS, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """(src, dst): links with the components of all pairs of rows of one group that ``measure`` links.

    ``rows`` has to read the same rows each time it is read (a staged table).
    """
    count = F.ceil(F.greatest(F.count("*") / tile_rows, F.sum(measure.size()) / tile_bytes)).cast("int")
    sizes = staged(rows.groupBy("group").agg(F.count("*").alias("n"), count.alias("tiles")).filter("n > 1").select("group", "tiles"), "group-sizes")
    tiled = rows.join(sizes, "group").withColumn("tile", F.pmod(F.xxhash64("node", "group"), F.col("tiles")).cast("int"))
    found = staged(within_tiles(tiled, measure), "tile-links")
    plain = found.filter("degree = 0").select("src", "dst")
    large = sizes.filter("tiles > 1")
    if large.isEmpty():
        return plain
    own = rows.join(large.select("group"), "group")
    hubs = found.filter("degree > 0").groupBy(F.col("group").alias("of")).agg(F.max_by("src", "degree").alias("hub"))
    stars = plain.union(staged(with_hubs(own, hubs, measure), "hub-links"))
    for turn in range(DEALT_ANEW + 1):
        labels = staged(connected_components(stars).select(F.col("node").alias("labelled"), F.col("component").alias("label")), "labels")
        stars = labels.filter("labelled <> label").select(F.col("labelled").alias("src"), F.col("label").alias("dst"))
        named, of = split_groups(own, labels, large, measure, tile_rows, tile_bytes)
        if of.isEmpty():
            return stars
        meeting = dealt_anew(named, of, turn) if turn < DEALT_ANEW else all_meetings(named, of)
        stars = stars.union(staged(joined_labels(meeting, measure), "joined-labels"))
    return stars
