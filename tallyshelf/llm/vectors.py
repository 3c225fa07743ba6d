"""Near-duplicate embeddings by a robust-pruned flat graph.

Within a label, vectors go to the shards of their nearest centroids (a hash sample of about one in ``SHARD_ROWS``), overlapping ones. Each
shard builds a pruned neighbour graph; a vector's lists from all its shards are united. Queries then walk the united graph of every shard
whose cell can hold a near vector, unless a few directions tell that no row of it is near: greedily from the medoid and a row of every
other connected part, and on through everything in range. Each task audits its recall against brute force on a sample of its queries, searches wider where it is short, and compares all rows where
the widest search is still short. Only verified pairs count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyshelf.llm.components import component_roots, merge_labels
from tallyshelf.sources.scratch import stored

COSINE = 0.98
# Vectors per centroid, vectors per assignment task, and the size from which a shard is split (its queries visit all parts).
SHARD_ROWS, BLOCK_ROWS, PART_ROWS = 400, 8192, 3000
OVERLAP = 2
# A vector within 0.2 (the chord of the threshold) of another lies across a cell border only if this margin reaches it.
MARGIN = 0.2 + 1e-9
DEGREE, CANDIDATES, FAR_CANDIDATES, ALPHA = 16, 48, 16, 1.2
BEAM, SLACK, QUERIES_AT_ONCE = 24, 0.03, 256
AUDITED, RECALL = 32, 0.99
# Directions in which a query is first compared with a shard's rows.
DIRECTIONS = 16


def unit_vectors(table: DataFrame) -> DataFrame:
    """``vec_id, label, node, v``: vectors of length one in double precision; ``node`` is a hash of label and vector.

    Vectors that are null, zero, or hold null or non-finite components, and those without label, are left out.
    """
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = table.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, c: s + c * c))
    rows = rows.select("vec_id", "label", x.alias("x")).withColumn("norm", norm).where("norm > 0")
    unit = F.transform("x", lambda c: c / F.col("norm"))
    label = F.struct("label", F.size("x").alias("width"))  # vectors of different lengths are not compared
    return rows.select("vec_id", F.xxhash64(label).alias("label"), F.xxhash64("label", "x").alias("node"), unit.alias("v"))


def assign(nodes: DataFrame) -> DataFrame:
    """``label, node, v, copies, shard, search``: the shards whose graphs hold a node (primary first), and those it searches."""
    spread = F.pmod(F.xxhash64(F.lit("centroid"), "node"), F.lit(1 << 30))
    first = nodes.groupBy("label").agg(F.min_by("node", spread).alias("node"), F.count("*").alias("n"))
    blocks = first.select("label", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks"))
    picked = nodes.where(spread < (1 << 30) // SHARD_ROWS).select("label", "node").union(first.select("label", "node")).distinct()
    centers = nodes.join(picked, ["label", "node"], "left_semi").join(blocks, "label")
    centers = centers.select(
        F.col("label").alias("label"), F.col("node").alias("center"), F.col("v").alias("at"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    rows = nodes.join(blocks, "label").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).drop("blocks")

    def nearest(rows: pd.DataFrame, centers: pd.DataFrame) -> pd.DataFrame:
        ids, c = centers["center"].to_numpy(), np.stack(centers["at"])
        apart = np.sqrt(np.maximum(0, 2 - 2 * c @ c.T))
        shards, search = [], []
        for lo in range(0, len(rows), 1024):
            near = np.stack(rows["v"][lo : lo + 1024]) @ c.T
            order = np.argsort(-near, axis=1, kind="stable")[:, :OVERLAP]
            best = order[:, 0]
            reach = near[np.arange(len(near)), best][:, None] - near <= MARGIN * apart[best]
            shards += [ids[o].tolist() for o in order]
            search += [ids[r].tolist() for r in reach]
        return pd.DataFrame({
            "label": rows["label"], "node": rows["node"], "v": rows["v"], "copies": rows["copies"], "shards": shards, "search": search})

    schema = "label long, node long, v array<double>, copies long, shards array<long>, search array<long>"
    key = ["label", "block"]
    return rows.groupBy(key).cogroup(centers.groupBy(key)).applyInPandas(nearest, schema)


def robust_prune(v: np.ndarray, seed: int = 0) -> list[np.ndarray]:
    """Neighbours of each row: near and some far candidates, less those that a chosen neighbour is nearer to by ``ALPHA``; both ways."""
    n = len(v)
    rng = np.random.default_rng(seed)
    near = min(CANDIDATES, n - 1)
    links: list[set[int]] = [set() for _ in range(n)]
    for lo in range(0, n, 256):
        rows = np.arange(lo, min(n, lo + 256))
        sims = v[rows] @ v.T
        sims[np.arange(len(rows)), rows] = -np.inf
        close = np.argpartition(-sims, near - 1, axis=1)[:, :near] if near else np.zeros((len(rows), 0), int)
        far = rng.integers(0, n, (len(rows), FAR_CANDIDATES))
        candidates = np.concatenate([close, far], axis=1)
        own = np.take_along_axis(sims, candidates, axis=1)
        order = np.argsort(-own, axis=1)
        candidates, own = np.take_along_axis(candidates, order, axis=1), np.take_along_axis(own, order, axis=1)
        distance = np.sqrt(np.maximum(0, 2 - 2 * own))
        alive = own > -np.inf
        points = v[candidates]
        for _ in range(DEGREE):
            some = np.flatnonzero(alive.any(axis=1))
            if not len(some):
                break
            at = alive[some].argmax(axis=1)
            chosen = candidates[some, at]
            for row, other in zip(rows[some], chosen, strict=True):
                links[row].add(int(other))
                links[other].add(int(row))
            between = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("rcd,rd->rc", points[some], v[chosen])))
            alive[some] &= ALPHA * between > distance[some]
            alive[some, at] = False
    return [np.fromiter(s, np.int64, len(s)) for s in links]


def range_search(v: np.ndarray, table: np.ndarray, queries: np.ndarray, starts: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) with a cosine of ``COSINE`` or more that a walk over the neighbour ``table`` (filled with -1) meets.

    A walk expands its best unexpanded row while that is among the ``beam`` best or within ``SLACK`` of the range.
    """
    width, n = len(queries), len(v)
    score = np.full((width, n), -np.inf)
    score[:, starts] = queries @ v[starts].T
    waiting = np.zeros((width, n), bool)
    waiting[:, starts] = True
    active = np.arange(width)
    while len(active):
        open_score = np.where(waiting[active], score[active], -np.inf)
        step = min(4, n)
        best = np.argpartition(-open_score, step - 1, axis=1)[:, :step]
        value = np.take_along_axis(open_score, best, axis=1)
        bar = np.partition(score[active], n - beam, axis=1)[:, n - beam] if n > beam else np.full(len(active), -np.inf)
        go = (value > -np.inf) & (value >= np.minimum(bar, COSINE - SLACK)[:, None])
        row, column = np.nonzero(go)
        active_rows = active[row]
        expanded = best[row, column]
        waiting[active_rows, expanded] = False
        around = table[expanded]
        who = np.repeat(active_rows, around.shape[1])
        to = around.ravel()
        real = to >= 0
        flat = np.unique(who[real] * n + to[real])
        who, to = flat // n, flat % n
        new = score[who, to] == -np.inf
        who, to = who[new], to[new]
        score[who, to] = np.einsum("ij,ij->i", queries[who], v[to])
        waiting[who, to] = True
        active = active[go.any(axis=1)]
    return np.nonzero(score >= COSINE)


def may_link(v: np.ndarray, ids: np.ndarray, queries: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The places of the queries that can have a cosine of ``COSINE`` or more with a row of ``v`` other than their own.

    Vectors so near are as near in any ``DIRECTIONS`` orthonormal directions, so no query with such a row goes missing; most others do,
    as their walks would end without a pair.
    """
    axes, _ = np.linalg.qr(v[:: -(-len(v) // DIRECTIONS)].T)
    rows = v @ axes
    size = (rows * rows).sum(axis=1)
    there = []
    for lo in range(0, len(queries), QUERIES_AT_ONCE):
        own = queries[lo : lo + QUERIES_AT_ONCE] @ axes
        # Half the squared distance, less half the query's squared length.
        apart = size / 2 - own @ rows.T
        near = apart <= ((MARGIN * MARGIN - (own * own).sum(axis=1)) / 2)[:, None]
        i, j = np.nonzero(near)
        there.append(lo + np.unique(i[ids[j] != asked[lo + i]]))
    return np.concatenate([*there, np.zeros(0, np.int64)]).astype(np.int64)


def _starts(lists: list[np.ndarray], medoid: int) -> np.ndarray:
    """The medoid, and the first row of every part of the graph that no link joins to the medoid's."""
    part = merge_labels(
        np.arange(len(lists)), np.repeat(np.arange(len(lists)), [len(own) for own in lists]), np.concatenate([*lists, np.zeros(0, np.int64)]).astype(np.int64))
    _, first = np.unique(part, return_index=True)
    return np.append(medoid, first[part[first] != part[medoid]])


def _walk(
    v: np.ndarray, lists: list[np.ndarray], queries: np.ndarray, ids: np.ndarray, asked: np.ndarray,
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Found pairs (query, row), a block of queries at a time, with a beam wide enough for the audited recall; ``ids`` are the rows'
    nodes, ``asked`` the queries'. A query's own row does not count in the audit.
    """
    degree = max(1, max(map(len, lists)))
    table = np.full((len(v), degree), -1)
    for row, own in enumerate(lists):
        table[row, : len(own)] = own
    medoid = int((v @ v.mean(axis=0)).argmax())
    starts = _starts(lists, medoid)
    some = np.arange(0, len(queries), max(1, len(queries) // AUDITED))[:AUDITED]
    checked = queries[some]
    real = (checked @ v.T >= COSINE) & (asked[some][:, None] != ids)
    beam, short = BEAM, True
    while short:
        i, j = range_search(v, table, checked, starts, beam)
        short = real[i, j].sum() < RECALL * real.sum()
        if not short or beam >= len(v):
            break
        beam *= 2
    for lo in range(0, len(queries), QUERIES_AT_ONCE):
        block = queries[lo : lo + QUERIES_AT_ONCE]
        i, j = np.nonzero(block @ v.T >= COSINE) if short else range_search(v, table, block, starts, beam)
        yield i + lo, j


def near_duplicates(table: DataFrame) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``table (vec_id, embedding, label)``.

    Rows of equal, non-null label link at a cosine of ``COSINE`` or more in double precision. ``n_links`` counts the other rows linked
    directly, ``component_id`` is the smallest vec_id reachable (its own included), ``kept`` tells whether that is the row's own.
    Vectors that are null, zero, or hold null or non-finite components link with nothing. Equal vectors of a label are one node
    of the graph, however many rows have them; a repeated vec_id gives a row each time; an empty table an empty one.
    """
    rows = stored(unit_vectors(table), "units")
    nodes = rows.groupBy("label", "node").agg(F.first("v").alias("v"), F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    nodes = stored(nodes, "nodes")
    placed = stored(assign(nodes), "placed")
    held = placed.select("label", "node", "v", "copies", F.posexplode("shards").alias("rank", "shard"))
    parts = held.groupBy("label", "shard").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"))
    parts = stored(parts, "parts")
    held = held.join(parts, ["label", "shard"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    key = ["label", "shard", "part"]

    def build(members: pd.DataFrame) -> pd.DataFrame:
        ids = members["node"].to_numpy()
        lists = robust_prune(np.stack(members["v"]))
        return pd.DataFrame({"node": ids, "near": [ids[own].tolist() for own in lists]})

    built = held.select(*key, "node", "v").groupBy(key).applyInPandas(build, "node long, near array<long>")
    united = built.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # OVERLAP lists
    held = stored(held.select(*key, "node", "v", "copies", "rank").join(united, "node"), "graph")
    asked = placed.select("label", "node", "v", F.explode("search").alias("shard")).join(parts, ["label", "shard"])
    asked = asked.select(
        F.col("label").alias("label"), F.col("shard").alias("shard"), F.col("node").alias("query"), F.col("v").alias("at"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    def search(queries: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(members):
            return pd.DataFrame({"node": [], "root": [], "links": []})
        ids, v = members["node"].to_numpy(), np.stack(members["v"])
        own, copies = members["rank"].to_numpy() == 0, members["copies"].to_numpy()
        asked_ids, at = queries["query"].to_numpy(), np.stack(queries["at"])
        # A row counts in its primary shard only.
        some = may_link(v[own], ids[own], at, asked_ids) if own.any() else np.zeros(0, np.int64)
        if not len(some):
            return pd.DataFrame({"node": [], "root": [], "links": []})
        asked_ids = asked_ids[some]
        order = np.argsort(ids)
        lists = []
        for near in members["near"]:
            place = np.minimum(np.searchsorted(ids[order], near), len(ids) - 1)
            lists.append(order[place[ids[order][place] == near]])
        every = np.concatenate([ids, asked_ids])
        names, place = np.unique(every, return_inverse=True)
        label = np.arange(len(names))
        links = np.zeros(len(asked_ids), np.int64)
        for i, j in _walk(v, lists, at[some], ids, asked_ids):
            good = own[j] & (ids[j] != asked_ids[i])
            i, j = i[good], j[good]
            np.add.at(links, i, copies[j])
            label = merge_labels(label, place[len(ids) + i], place[j])
        linked = np.flatnonzero(label != np.arange(len(label)))
        return pd.DataFrame({
            "node": np.concatenate([asked_ids, names[linked]]),
            "root": np.concatenate([asked_ids, names[label[linked]]]),
            "links": np.concatenate([links, np.zeros(len(linked), np.int64)]),
        })

    hits = asked.groupBy(key).cogroup(held.groupBy(key)).applyInPandas(search, "node long, root long, links long")
    hits = stored(hits, "hits")
    roots = component_roots(hits.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = hits.groupBy("node").agg(F.sum("links").alias("links"))
    marked = nodes.select("node", "copies", "least").join(counts, "node", "left").join(roots, "node", "left")
    marked = marked.withColumn("root", F.coalesce("root", "node"))
    least = marked.groupBy("root").agg(F.min("least").alias("component_id"))
    marked = marked.join(least, "root").select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    found = rows.select("vec_id", "node").join(marked, "node").select("vec_id", "n_links", "component_id")
    # Rows that could not take part: as many of each vec_id as the valid ones leave over.
    rest = table.groupBy("vec_id").agg(F.count("*").alias("n")).join(
        rows.groupBy(F.col("vec_id").alias("id")).agg(F.count("*").alias("m")), F.col("vec_id").eqNullSafe(F.col("id")), "left")
    rest = rest.select("vec_id", (F.col("n") - F.coalesce("m", F.lit(0))).cast("int").alias("over")).where("over > 0")
    rest = rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.explode(F.array_repeat("vec_id", F.col("over"))).alias("component_id"))
    return found.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
