"""Connected components: of one task's links in memory, and of all links by random contraction on Spark."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyshelf.sources.scratch import discard, stored


def merge_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after linking ``i[k]`` with ``j[k]``; a label is the smallest index of its component."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        label = label.copy()
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = label[label]
            if np.array_equal(further, label):
                break
            label = further


def component_roots(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges (a, b)``; equal roots mean linked, directly or through others.

    Every round each node moves to the neighbour (or itself) of the smallest rank; the rounds' moves are put together at the
    end. In every other round, the first included, the node with most links ranks first, which contracts a star at once; in the
    rounds between ranks are random, which leaves a constant fraction of the nodes of any graph. Each step is a grouping or an
    equi-join, so a node with very many links is combined map-side or split by adaptive execution. Loops are ignored, repeated
    links count once, nulls must not occur, an empty table gives an empty table.
    """
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = stored(edges.where("a <> b").distinct(), "links")
    moves = []
    while not edges.isEmpty():
        seed = F.lit(len(moves) + 1)
        both = edges.union(edges.select("b", "a"))
        if len(moves) % 2 == 0:
            links = both.groupBy("a").agg(F.count("*").alias("n"))
            both = both.join(links.select(F.col("a").alias("b"), F.col("n").alias("b_links")), "b")
            own = F.count("*")
        else:
            both = both.withColumn("b_links", F.lit(0).cast("long"))
            own = F.lit(0).cast("long")
        rank = lambda n, c: F.struct((-n).alias("l"), F.xxhash64(seed, c).alias("r"), F.col(c).alias("n"))
        near = both.groupBy("a").agg(F.min(rank(F.col("b_links"), "b")).alias("near"), own.alias("links"))
        moved = stored(near.select("a", F.least("near", rank(F.col("links"), "a"))["n"].alias("to")), "moves")
        moves.append(moved)
        first = moved.select("a", F.col("to").alias("p"))
        second = moved.select(F.col("a").alias("b"), F.col("to").alias("q"))
        apart = edges.join(first, "a").join(second, "b").where("p <> q")
        left = stored(apart.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct(), "links")
        discard(edges)
        edges = left
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = moves[-1].select(F.col("a").alias("node"), F.col("to").alias("root"))
    for moved in reversed(moves[:-1]):
        later = roots.select(F.col("node").alias("to"), F.col("root").alias("later"))
        roots = moved.join(later, "to", "left").select(F.col("a").alias("node"), F.coalesce("later", "to").alias("root"))
    return roots
