"""Approximate nearest neighbours: an NN-descent graph and greedy search over it, in rounds of Spark joins.

The graph starts from the leaves of random projection trees: vectors sorted by the signs of random projections, cut into
runs of LEAF rows. Each round then joins every node's neighbours, forward and reverse, with their vectors, compares the
neighbours of a node with each other where one of them is new, and merges what is nearer into their lists, until few
lists change. Reverse edges of a node that many list are cut to a few within each task, before they meet and before
vectors join them. A query starts at its own node; each round expands the best unexpanded nodes of its list by a join
with the graph, over forward and reverse edges, until PATIENCE expanded nodes, or half as many as were expanded before,
brought nothing to its k best: hard queries search longer, so recall doesn't hang on a fixed number of rounds.

Largest inner product becomes least distance by one more component, sqrt(limit^2 - norm^2), less the limit, which
changes no distance and keeps small numbers exact. The HEADS vectors of largest norm don't count for the limit, which is
the largest norm below them: every query starts from them too, so a few large vectors neither hide the others'
differences nor get lost. Graph and search use float32 components, computed with in double precision; the best of each
list are scored anew on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.runs import sorted_runs, starts
from gridloom.llm.vectors import common_width, grouped, matrix, packed, usable
from gridloom.staging import release, staged

DEGREE = 32
#: Trees of the start, rows of a leaf, and projections that order the leaves.
TREES, LEAF, PROJECTIONS, SEED = 6, 64, 48, 5
SAMPLED = 64  # neighbours of a node that a round compares
#: Rounds end when less than this share of all list entries is new, or after MOST_ROUNDS.
FEW, MOST_ROUNDS = 0.1, 12
#: A query keeps LIST found nodes, expands BEAM of them in a round, and ends once PATIENCE expanded ones, or half as many
#: as it took to the last gain if that is more, brought nothing to its k best; RESCORED of the list are scored anew on
#: the original vectors.
LIST, BEAM, PATIENCE, RESCORED = 1_024, 128, 192, 256
#: Queries are searched together while their vectors, which every task gets, take no more than this.
QUERY_BYTES = 32 << 20
HEADS = 64
EDGES = "a long, b long, s double, fresh boolean"
SEARCHED = "q long, gids array<long>, scores array<double>, done array<boolean>, met array<long>, spent long"


def best_edges(edges: DataFrame, degree: int) -> DataFrame:
    """The ``degree`` best different b of each a, ties to the smaller b; an edge seen before isn't fresh."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_runs(batches, "a"):
            a, b, s, fresh = (t.column(i).to_numpy() for i in range(4))
            o = np.lexsort((fresh, b, a))
            keep = np.append(True, (a[o][1:] != a[o][:-1]) | (b[o][1:] != b[o][:-1]))
            o = o[keep]
            o = o[np.lexsort((b[o], -s[o], a[o]))]
            at = starts(a[o])
            o = o[np.arange(len(o)) - np.repeat(at[:-1], np.diff(at)) < degree]
            yield pa.RecordBatch.from_arrays([pa.array(x[o]) for x in (a, b, s, fresh)], ["a", "b", "s", "fresh"])

    return edges.repartition("a").sortWithinPartitions("a").mapInArrow(run, EDGES)


def first_of_each(rows: DataFrame, key: str, order: list, most: int) -> DataFrame:
    """The first ``most`` rows of each key, by ``order``, sorted so; each task cuts its own before they meet.

    A key of any number of rows brings ``most`` from each task, and passes as a stream that holds only a count.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for b in batches:
            if b.num_rows:
                keys = b.column(key).to_numpy()
                at = starts(keys)
                rank = np.arange(len(keys)) - np.repeat(at[:-1], np.diff(at))
                if keys[0] == last:
                    rank[: at[1]] += seen
                last, seen = keys[-1], int(rank[-1]) + 1
                yield b.filter(pa.array(rank < most))

    some = rows.sortWithinPartitions(key, *order).mapInArrow(cut, rows.schema)
    return some.repartition(key).sortWithinPartitions(key, *order).mapInArrow(cut, rows.schema)


def coded(vectors: DataFrame, limit: float, scale: float) -> DataFrame:
    """(gid, code): the extended vector times ``scale``, in float32; ``limit`` is the largest squared norm below the heads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1)) * scale
            if len(x):
                norm = (x * x).sum(1)
                within = np.minimum(norm, limit)
                more = -within / (np.sqrt(limit) + np.sqrt(limit - within))
                c = np.column_stack([x, more]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in c], pa.binary())], ["gid", "code"])

    return vectors.select("gid", "v").mapInArrow(run, "gid long, code binary")


def nearness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Half the squared distances of rows, negative."""
    return x @ y.T - ((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :]) / 2


def start_graph(codes: DataFrame, width: int, degree: int, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """Edges to the best neighbours within a leaf of each tree; a leaf has ``leaf`` to 2 * ``leaf`` rows, whatever the data.

    The signs of PROJECTIONS random projections, read as a number, are the path to a leaf; rows sorted by it stand in
    the order of the leaves, so leaves are runs of rows and no leaf grows with rows that lie close together.
    """
    rng = np.random.default_rng(SEED)
    found = None
    for _ in range(trees):
        planes = rng.normal(size=(width, PROJECTIONS))
        middle = codes.orderBy(F.xxhash64("gid"), "gid").limit(1_000).collect() if found is None else middle
        centre = np.mean([np.frombuffer(r["code"], "f4") for r in middle], axis=0)

        def path(batches: Iterator[pa.RecordBatch], planes: np.ndarray = planes) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    sign = (matrix(b.column(1), "f4") - centre) @ planes > 0
                    yield pa.RecordBatch.from_arrays([pa.array(sign @ (1 << np.arange(PROJECTIONS)[::-1])), *b.columns], ["path", "gid", "code"])

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []

            def leaves(rows: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
                gid, x = rows.column("gid").to_numpy(), matrix(rows.column("code").combine_chunks(), "f4").astype(float)
                at, out = 0, []
                while at < len(gid) and (last or len(gid) - at >= 2 * leaf):
                    end = at + leaf if len(gid) - at >= 2 * leaf else len(gid)
                    k = min(degree, end - at - 1)
                    if k:
                        s = nearness(x[at:end], x[at:end])
                        np.fill_diagonal(s, -np.inf)
                        b = np.argpartition(-s, k - 1, axis=1)[:, :k]
                        out.append((np.repeat(gid[at:end], k), gid[at:end][b].ravel(), np.take_along_axis(s, b, 1).ravel()))
                    at = end
                held[:] = rows.slice(at).to_batches()
                if out:
                    a, b, s = map(np.concatenate, zip(*out))
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s), pa.array(np.ones(len(a), bool))], ["a", "b", "s", "fresh"])

            for b in batches:
                held.append(b)
                yield from leaves(pa.Table.from_batches(held), False)
            if held:
                yield from leaves(pa.Table.from_batches(held), True)

        placed = staged(codes.mapInArrow(path, "path long, gid long, code binary"), "paths")
        edges = placed.repartitionByRange("path", "gid").sortWithinPartitions("path", "gid").mapInArrow(compare, EDGES)
        found = edges if found is None else found.union(edges)
    return best_edges(found, degree)


def descend(edges: DataFrame, codes: DataFrame, degree: int, sampled: int, turn: int = 0) -> DataFrame:
    """One round: neighbours of a node, forward before reverse, are compared with each other.

    A node takes part with all its own neighbours and, up to ``sampled`` in all, reverse ones, drawn anew in each round;
    the sampling is the method's.
    """
    own = edges.select(F.col("a").alias("v"), F.col("b").alias("nbr"), "fresh", F.lit(0).alias("reverse"))
    listing = edges.select(F.col("b").alias("v"), F.col("a").alias("nbr"), "fresh", F.lit(1).alias("reverse"))
    reverse = first_of_each(listing, "v", [F.xxhash64("nbr", F.lit(turn)), "nbr"], sampled)
    worst = edges.groupBy("a").agg(F.when(F.count("*") >= degree, F.min("s")).alias("worst"))
    nodes = codes.join(worst, codes["gid"] == worst["a"], "left").select(F.col("gid").alias("nbr"), "code", F.coalesce("worst", F.lit(float("-inf"))).alias("worst"))
    around = own.union(reverse).join(nodes, "nbr").select("v", "nbr", "fresh", "reverse", "code", "worst")
    salt = np.uint64(turn)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_runs(batches, "v"):
            v, nbr, fresh, reverse, worst = (t.column(c).to_numpy() for c in ("v", "nbr", "fresh", "reverse", "worst"))
            mix = ((nbr.astype(np.uint64) + salt) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
            o = np.lexsort((mix, reverse, v))
            code = matrix(t.column("code").combine_chunks(), "f4")
            out: list[list[np.ndarray]] = [[], [], []]
            at = starts(v[o])
            for i, j in zip(at.tolist(), at[1:].tolist()):
                _, first = np.unique(nbr[o[i:j]], return_index=True)
                g = o[i:j][np.sort(first)[:sampled]]
                if not fresh[g].any():
                    continue
                x = code[g].astype(float)
                s = nearness(x, x)
                p, q = np.nonzero((s > worst[g][:, None]) & (fresh[g][:, None] | fresh[g][None, :]))
                p, q = p[p != q], q[p != q]
                for c, y in zip(out, (nbr[g[p]], nbr[g[q]], s[p, q])):
                    c.append(y)
            if out[0]:
                a, b, s = map(np.concatenate, out)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s), pa.array(np.ones(len(a), bool))], ["a", "b", "s", "fresh"])

    found = around.repartition("v").sortWithinPartitions("v").mapInArrow(compare, EDGES)
    return best_edges(edges.withColumn("fresh", F.lit(False)).union(found), degree)


def search_block(asked: DataFrame, graph: DataFrame, codes: DataFrame, vectors: DataFrame, k: int, heads: list[int], scale: float, size: int, beam: int, patience: int) -> DataFrame:
    """Greedy search for the queries of one block, whose vectors every task gets.

    A query is one row with its list in arrays. Nodes meet the queries that ask for them in one shuffle, and a node that
    can't enter a full list goes no further.
    """
    spark = asked.sparkSession
    rows = asked.collect()
    ids = np.array([r["query_id"] for r in rows], np.int64)
    exact = spark.sparkContext.broadcast(np.array([np.frombuffer(r["v"], "f8") for r in rows]))

    def score(least: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(q, gid, s) of pairs that can enter the list; rows of a gid are its code and the queries that ask for it."""
        for t in sorted_runs(batches, "gid"):
            code = t.filter(pc.is_valid(t.column("code")))
            pairs = t.filter(pc.is_valid(t.column("q")))
            if not pairs.num_rows:
                continue
            x, of = matrix(code.column("code").combine_chunks(), "f4")[:, :-1], code.column("gid").to_numpy()
            row, q = np.searchsorted(of, pairs.column("gid").to_numpy()), pairs.column("q").to_numpy()
            row, q = np.divmod(np.unique(row * len(ids) + q), len(ids))
            for at in range(0, len(q), 65_536):
                i, j = q[at : at + 65_536], row[at : at + 65_536]
                s = np.einsum("ij,ij->i", exact.value[i], x[j].astype(float)) * scale
                enters = s >= least[i]
                if enters.any():
                    yield pa.RecordBatch.from_arrays([pa.array(x[enters]) for x in (i, of[j], s)], ["q", "gid", "s"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The list of each query; of the unexpanded nodes in it the best ``beam`` come next, if the query goes on.

        ``spent`` counts the nodes that a query expanded, and ``met`` is that count when it met a node.
        """
        for t in sorted_runs(batches, "q"):
            held, new = (t.filter(x).combine_chunks() for x in (pc.is_valid(t.column("spent")), pc.is_null(t.column("spent"))))
            every = np.unique(t.column("q").to_numpy())
            total = np.zeros(len(every), np.int64)
            total[np.searchsorted(every, held.column("q").to_numpy())] = held.column("spent").to_numpy()
            unseen = np.searchsorted(every, new.column("q").to_numpy())
            of = np.append(np.repeat(np.searchsorted(every, held.column("q").to_numpy()), pc.list_value_length(held.column("gids")).to_numpy()), unseen)
            gid, s = (np.append(pc.list_flatten(held.column(c)).to_numpy(), new.column(one).to_numpy()) for c, one in (("gids", "gid"), ("scores", "s")))
            done, met = (pc.list_flatten(held.column(c)).to_numpy(zero_copy_only=False) for c in ("done", "met"))
            done, met = np.append(done, np.zeros(len(unseen), bool)), np.append(met, total[unseen])
            o = np.lexsort((np.arange(len(of)), gid, of))
            o = o[np.append(True, (of[o][1:] != of[o][:-1]) | (gid[o][1:] != gid[o][:-1]))]
            o = o[np.lexsort((gid[o], -s[o], of[o]))]
            at = starts(of[o])
            rank = np.arange(len(o)) - np.repeat(at[:-1], np.diff(at))
            o, rank = o[rank < size], rank[rank < size]
            at = starts(of[o])
            lengths = np.diff(at)
            better = np.maximum.reduceat(np.where(rank <= k, met[o], 0), at[:-1])
            goes = total - better < np.maximum(patience, better // 2)
            waiting = np.cumsum(~done[o])
            before = waiting[at[:-1]] - ~done[o][at[:-1]]
            turn = ~done[o] & (waiting - np.repeat(before, lengths) <= beam) & np.repeat(goes, lengths)
            turns = np.add.reduceat(turn.astype(np.int64), at[:-1])
            least = np.where(lengths >= size, s[o][at[1:] - 1], -np.inf)
            lists = [pa.ListArray.from_arrays(at.astype(np.int32), pa.array(x)) for x in (gid[o], s[o], done[o] | turn, met[o])]
            following = pa.ListArray.from_arrays(np.append(0, np.cumsum(turns)).astype(np.int32), pa.array(gid[o][turn]))
            yield pa.RecordBatch.from_arrays([pa.array(every), *lists, pa.array(total + turns), following, pa.array(least)], ["q", "gids", "scores", "done", "met", "spent", "turn", "least"])

    def ranked(found: DataFrame) -> DataFrame:
        return staged(found.repartition("q").sortWithinPartitions("q").mapInArrow(best, f"{SEARCHED}, turn array<long>, least double"), "search")

    def scored(met: DataFrame, least: np.ndarray) -> DataFrame:
        pairs = met.select(F.explode("near").alias("gid"), "q", F.lit(None).cast("binary").alias("code"))
        both = pairs.union(codes.select("gid", F.lit(None).cast("long"), "code"))
        return both.repartition("gid").sortWithinPartitions("gid").mapInArrow(partial(score, least), "q long, gid long, s double")

    number = spark.createDataFrame(pd.DataFrame({"q": np.arange(len(ids)), "gid": [r["gid"] for r in rows]}), "q long, gid long")
    first = F.array_distinct(F.array("gid", *map(F.lit, heads))).alias("near")
    none = spark.createDataFrame([], SEARCHED)
    state = ranked(none.unionByName(scored(number.select("q", first), np.full(len(ids), -np.inf)), allowMissingColumns=True))
    while not (turn := state.filter(F.size("turn") > 0)).isEmpty():
        least = np.full(len(ids), np.inf)
        going = turn.select("q", "least").toPandas()
        least[going["q"]] = going["least"]
        met = turn.select("q", F.explode("turn").alias("a")).join(graph, "a")
        before, state = state, ranked(state.drop("turn", "least").unionByName(scored(met, least), allowMissingColumns=True))
        release(before)

    def anew(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_runs(batches, "q"):
            t = t.combine_chunks()
            at = t.column("q").to_numpy()
            x = matrix(t.column("v").combine_chunks())
            s = np.array([float(np.dot(exact.value[i], y)) for i, y in zip(at, x)])
            held = t.column("ids").to_pylist()
            out: list[tuple[int, int, int, float]] = []
            cuts = starts(at)
            for i, j in zip(cuts.tolist(), cuts[1:].tolist()):
                own = int(ids[at[i]])
                those = sorted({(-s[r], v) for r in range(i, j) for v in held[r] if v != own})[:k]
                out += [(own, n + 1, v, -negative) for n, (negative, v) in enumerate(those)]
            columns = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.float64()))], ["query_id", "rank", "vec_id", "score"])

    last = state.select("q", F.explode(F.slice("gids", 1, max(RESCORED, 2 * k))).alias("gid"))
    return last.join(vectors, "gid").select("q", "ids", "v").repartition("q").sortWithinPartitions("q").mapInArrow(anew, "query_id long, rank int, vec_id long, score double")


def build_graph(codes: DataFrame, n: int, width: int, degree: int = DEGREE, most_rounds: int = MOST_ROUNDS, few: float = FEW, sampled: int = SAMPLED, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """(a, b, s, fresh): the neighbour lists when fewer than ``few`` of their entries change in a round."""
    edges = staged(start_graph(codes, width, degree, trees, leaf), "graph")
    for turn in range(most_rounds):
        better = staged(descend(edges, codes, degree, sampled, turn), "graph")
        release(edges)
        edges = better
        if edges.filter("fresh").count() < few * n * degree:
            break
    return edges


def adjacency(edges: DataFrame, degree: int = DEGREE) -> DataFrame:
    """(a, near): the neighbours of each node, and the nearest of those that list it, at most ``degree`` of each."""
    reverse = first_of_each(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "s", "fresh"), "a", [F.desc("s"), "b"], degree)
    return edges.union(reverse).groupBy("a").agg(F.collect_set("b").alias("near"))


def nearest(table: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", size: int = LIST, beam: int = BEAM, patience: int = PATIENCE, block: int | None = None, **graph_options) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries``, itself a row of ``table``, the k nearest found.

    Nearness is the inner product in double precision; ties go to the smaller id; the query's own id is no candidate;
    with fewer candidates all that the graph reaches are returned. Vectors that are null, empty, all zero or hold null
    or non-finite components, and those of another length than most (the longer one if equally many), take no part. Equal vectors are one
    node that brings its k + 1 smallest ids. Other columns are not read; empty tables give no rows.
    """
    spark = table.sparkSession
    valid = lambda t: usable(t, id_col, vector_col).filter(F.exists("v", lambda x: x != 0))
    vectors = staged(grouped(packed(valid(table)), k + 1), "vectors")
    width = common_width(vectors)
    if width is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    vectors = vectors.filter(F.length("v") == width)

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(0))
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array([float(np.abs(x).max())]), pa.array([len(x)])], ["top", "n"])

    top, n = vectors.select("v").mapInArrow(norms, "top double, n long").agg(F.max("top"), F.sum("n")).first()
    scale = 1 / top
    squares = vectors.select("gid", "v").mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([b.column(0), pa.array(((matrix(b.column(1)) * scale) ** 2).sum(1))], ["gid", "norm"]) for b in bs if b.num_rows), "gid long, norm double")
    top = squares.orderBy(F.desc("norm"), "gid").limit(HEADS + 1).collect()
    heads, limit = [r["gid"] for r in top[:HEADS]], top[-1]["norm"] if n > HEADS else top[0]["norm"]
    codes = staged(coded(vectors, limit, scale), "codes")
    edges = build_graph(codes, n, width // 8 + 1, **graph_options)
    graph = staged(adjacency(edges, graph_options.get("degree", DEGREE)), "adjacency")
    asked = packed(valid(queries)).filter(F.length("v") == width).withColumnRenamed("id", "query_id").dropDuplicates(["query_id", "v"]).join(vectors.select("gid", "v"), "v")
    asked = staged(asked, "queries")
    blocks = -(-asked.count() // (block or max(1, QUERY_BYTES // width)))
    found = [search_block(asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i), graph, codes, vectors, k, heads, scale, size, beam, patience) for i in range(blocks)]
    out = found[0] if found else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for f in found[1:]:
        out = out.union(f)
    return out
