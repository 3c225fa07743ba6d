"""Exact top-k by integer inner product: a KD-tree per shard, searched best box first.

Vectors are dealt to shards of bounded size, queries to blocks of bounded size, and every block meets every shard. In a first wave each
block searches one shard; the k-th score found there is handed on, so that in the second wave boxes of the other shards that cannot
reach it are not opened.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyshelf.sources.scratch import stored

SCALE = 64
SHARD_ROWS, BLOCK_ROWS, LEAF_ROWS = 2048, 1024, 256
LOWEST = 1 - (1 << 63)


def integer_vectors(table: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, v``: floor(scale * x) of every component as long; rows without an id or with a bad component are left out."""
    x = F.col("embedding").cast("array<double>")
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return table.where(good).select("vec_id", F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))


class KdTree:
    """Median splits of the widest dimension down to leaves, with tight boxes around the rows below each node."""

    def __init__(self, rows: np.ndarray, leaf_rows: int = LEAF_ROWS) -> None:
        self.order = np.arange(len(rows))
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.below: list[tuple[int, int] | None] = []  # two children, or None for a leaf
        self.span: list[tuple[int, int]] = []
        self._split(rows, 0, len(rows), leaf_rows)

    def _split(self, rows: np.ndarray, lo: int, hi: int, leaf_rows: int) -> int:
        mine = rows[self.order[lo:hi]]
        node = len(self.span)
        self.span.append((lo, hi))
        self.low.append(mine.min(axis=0))
        self.high.append(mine.max(axis=0))
        self.below.append(None)
        width = self.high[node] - self.low[node]
        if hi - lo > leaf_rows and width.max() > 0:
            mid = (hi - lo) // 2
            part = np.argpartition(mine[:, int(width.argmax())], mid)
            self.order[lo:hi] = self.order[lo:hi][part]
            self.below[node] = self._split(rows, lo, lo + mid, leaf_rows), self._split(rows, lo + mid, hi, leaf_rows)
        return node


def search(rows: np.ndarray, queries: np.ndarray, own: np.ndarray, least: np.ndarray, k: int):
    """Per query the k best ``(score, place)`` among rows whose score is at least ``least``, without its ``own`` place; ties to the lower place.

    All queries go through the tree together: nodes are opened by the best bound that any query gives them, and each opened
    leaf is scored for those queries whose k-th score its box can still reach. Sums that may pass 2**53 are done in whole numbers,
    without bounds.
    """
    tree = KdTree(rows)
    data, q = rows.astype(float), queries.astype(float)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    if np.abs(data).max() * np.abs(q).max() * max(1, data.shape[1]) < 2**53:
        bound = lambda node: up @ tree.high[node].astype(float) + down @ tree.low[node].astype(float)
    else:
        data, q = rows.astype(object), queries.astype(object)
        bound = lambda node: np.full(len(q), np.inf)
    scores = np.full((len(q), k), LOWEST, np.int64)
    found = np.full((len(q), k), np.iinfo(np.int64).max, np.int64)
    least = least.copy()
    heap = [(-np.inf, 0, bound(0))]
    while heap:
        _, node, bounds = heapq.heappop(heap)
        open_for = np.flatnonzero(bounds >= least)
        if not len(open_for):
            continue
        if tree.below[node]:
            for child in tree.below[node]:
                reach = bound(child)
                gain = (reach - least).max()
                if gain >= 0:
                    heapq.heappush(heap, (-gain, child, reach))
            continue
        lo, hi = tree.span[node]
        at = tree.order[lo:hi]
        new = (q[open_for] @ data[at].T).astype(np.int64)
        good = (new >= least[open_for][:, None]) & (at[None, :] != own[open_for][:, None])
        row, column = np.nonzero(good)
        if not len(row):
            continue
        mine = open_for[np.unique(row)]
        who = np.concatenate([np.repeat(mine, k), open_for[row]])
        score = np.concatenate([scores[mine].ravel(), new[row, column]])
        which = np.concatenate([found[mine].ravel(), at[column]])
        order = np.lexsort((which, -score, who))
        first = np.searchsorted(who[order], mine)
        best = order[first[:, None] + np.arange(k)]
        scores[mine], found[mine] = score[best], which[best]
        least[mine] = np.maximum(least[mine], scores[mine, -1])
    return scores, found


def top_k(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows of ``vectors (vec_id, v)`` whose id is divisible by ``every``.

    Ties go to the smaller vec_id. A query meets every row but its own; rows that repeat an id are queries each, and candidates of each
    other. Vectors of another length than the query's do not take part with it; a score beyond 64 bits is an error. An empty table gives an empty one.
    """
    vectors = stored(vectors.select("vec_id", "v", F.size("v").alias("width"), F.monotonically_increasing_id().alias("row")), "vectors")
    widths = vectors.groupBy("width").agg(F.count("*").alias("n"))
    sizes = stored(widths.withColumn("shards", F.ceil(F.col("n") / SHARD_ROWS).cast("int")), "sizes")
    rows = vectors.join(sizes, "width").withColumn("shard", F.pmod(F.xxhash64("row"), F.col("shards")).cast("int"))
    picked = vectors.where(F.col("vec_id") % every == 0).join(sizes, "width")
    blocks = F.ceil(F.col("n") / (BLOCK_ROWS * every)).cast("int")
    picked = picked.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "row"), blocks).cast("int"))
    picked = stored(picked.withColumn("home", F.pmod(F.col("block"), F.col("shards")).cast("int")), "queries")
    grid = stored(picked.select("width", "block", "home", "shards").distinct(), "grid")

    def wave(asked: DataFrame, cells: DataFrame) -> DataFrame:
        """Searches the cells (width, block, shard) for the queries ``row, vec_id, v, width, block, least``."""
        members = rows.join(cells, ["width", "shard"]).select("width", "block", "shard", "row", "vec_id", "v")
        queries = asked.join(cells, ["width", "block"]).select("width", "block", "shard", "row", "vec_id", "v", "least")

        def meet(queries: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
            if not len(queries) or not len(members):
                return pd.DataFrame({"query_row": [], "query_id": [], "vec_id": [], "score": []})
            members = members.sort_values(["vec_id", "row"], ignore_index=True)
            own = queries["row"].map(pd.Series(members.index, members["row"])).fillna(-1).to_numpy(np.int64)
            least = queries["least"].to_numpy()
            scores, found = search(np.stack(members["v"]), np.stack(queries["v"]), own, least, k)
            good = (scores >= least[:, None]) & (scores > LOWEST)
            at = np.nonzero(good)[0]
            return pd.DataFrame({
                "query_row": queries["row"].to_numpy()[at], "query_id": queries["vec_id"].to_numpy()[at],
                "vec_id": members["vec_id"].to_numpy()[found[good]], "score": scores[good]})

        key = ["width", "block", "shard"]
        fields = "query_row long, query_id long, vec_id long, score long"
        return queries.groupBy(key).cogroup(members.groupBy(key)).applyInPandas(meet, fields)

    home = grid.select("width", "block", F.col("home").alias("shard"))
    first = stored(wave(picked.withColumn("least", F.lit(LOWEST)), home), "first")
    kth = first.groupBy("query_row").agg(F.count("*").alias("m"), F.min("score").alias("least"))
    kth = kth.select(F.col("query_row").alias("row"), F.when(F.col("m") >= k, F.col("least")).otherwise(LOWEST).alias("least"))
    away = grid.select("width", "block", "home", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    away = away.where("shard <> home").select("width", "block", "shard")
    asked = picked.join(kth, "row", "left").withColumn("least", F.coalesce("least", F.lit(LOWEST)))
    every_hit = first.union(wave(asked, away))
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    ranked = every_hit.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
