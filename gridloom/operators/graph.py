"""Graph operators over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.staging import release, staged


def _oriented(edges: DataFrame) -> DataFrame:
    """Each edge once, from its greater to its smaller end; loops and null ends are dropped."""
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _representatives(edges: DataFrame, turn: int) -> DataFrame:
    """(x, rep): what each node is contracted into, where that is another node.

    The first turn takes the smallest smaller neighbour, which contracts stars around their smallest node at once.
    Later ones take the neighbour that comes first in an order drawn anew, which no shape of graph can be slow for.
    """
    if turn == 0:
        return edges.groupBy(F.col("a").alias("x")).agg(F.min("b").alias("rep"))
    drawn = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("node"))
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    best = both.groupBy("a").agg(F.min(drawn("b")).alias("first"))
    return best.filter(F.col("first") < drawn("a")).select(F.col("a").alias("x"), F.col("first.node").alias("rep"))


def _renamed(edges: DataFrame, reps: DataFrame, end: str) -> DataFrame:
    other = "b" if end == "a" else "a"
    return edges.join(reps, edges[end] == reps["x"], "left").select(F.coalesce("rep", end).alias(end), other)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100) -> DataFrame:
    """(node, component): each node that has an edge with the smallest node reachable from it.

    Every round contracts nodes into neighbours, renames the ends of the edges and drops those that became loops, so
    edges and nodes shrink by a share in each round and all rounds together cost a few times the first. Rounds are
    written tables: lineage stays short, and a node of very many edges is one key of a join that adaptive execution
    splits. Null ends and loops are dropped.
    """
    e = start = staged(_oriented(edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))), "edges")
    maps: list[DataFrame] = []
    while not e.isEmpty():
        if len(maps) == max_rounds:
            raise RuntimeError(f"edges remain after {max_rounds} rounds")
        maps.append(staged(_representatives(e, len(maps)), "representatives"))
        shrunk = staged(_oriented(_renamed(_renamed(e, maps[-1], "a"), maps[-1], "b").select("a", "b")), "edges")
        if e is not start:
            release(e)
        e = shrunk
    nodes = start.select(F.col("a").alias("node")).union(start.select("b")).distinct()
    if not maps:
        return nodes.withColumn("component", F.col("node"))
    while len(maps) > 1:  # the last and smallest maps first
        last = maps.pop()
        then = last.select(F.col("x").alias("rep"), F.col("rep").alias("further"))
        both = maps[-1].join(then, "rep", "left").select("x", F.coalesce("further", "rep").alias("rep"))
        maps[-1] = staged(both.union(last.join(maps[-1], "x", "left_anti")), "representatives")
    named = nodes.join(maps[0], nodes["node"] == maps[0]["x"], "left").select("node", F.coalesce("rep", "node").alias("label"))
    named = staged(named, "labels")
    least = named.groupBy("label").agg(F.min("node").alias("component"))
    return named.join(least, "label").select("node", "component")
