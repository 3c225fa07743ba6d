"""Near-duplicate vectors against all pairs."""

from __future__ import annotations

import numpy as np

from tallyshelf.llm import vectors
from tests.llm import brute


def expected(rows):
    good = [(i, np.array(v, float), k) for i, v, k in rows if v is not None and k is not None and None not in v]
    good = [(i, v / np.sqrt((v * v).sum()), k) for i, v, k in good if np.isfinite(v).all() and (v * v).sum() > 0]
    m = np.stack([v for _, v, _ in good])
    label = np.array([k for _, _, k in good])
    near = (m @ m.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    ids = [i for i, _, _ in good]
    counts = {i: 0 for i, _, _ in rows} | dict(zip(ids, near.sum(axis=1).tolist(), strict=True))
    links = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near), strict=True)]
    return counts, brute.components([i for i, _, _ in rows], links)


def test_given_table(spark, folder):
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    counts, roots = expected([(r.vec_id, np.float32(r.embedding), r.label) for r in table.collect()])
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(table).collect()}
    assert found == {i: (counts[i], roots[i], roots[i] == i) for i in counts}


def test_small_shards_hot_groups_and_odd_rows(spark, monkeypatch):
    for name, value in (("SHARD_ROWS", 60), ("BLOCK_ROWS", 200), ("PART_ROWS", 150)):
        monkeypatch.setattr(vectors, name, value)
    rng = np.random.default_rng(1)
    one = rng.normal(size=16)
    rows = [(k, (one + 0.02 * rng.normal(size=16)).tolist(), 1) for k in range(300)]
    rows += [(300 + k, rng.normal(size=16).tolist(), int(k % 2)) for k in range(500)]
    rows += [(800 + k, rows[310][1], rows[310][2]) for k in range(40)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, rows[0][1], None), (904, [None] * 16, 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    counts, roots = expected(rows)
    found = {r.vec_id: r for r in vectors.near_duplicates(table).collect()}
    assert set(found) == set(counts)
    assert sum(r.n_links for r in found.values()) >= 0.97 * sum(counts.values())
    assert all(r.n_links <= counts[i] for i, r in found.items())
    assert sum(r.component_id == roots[i] for i, r in found.items()) >= 0.99 * len(rows)
    assert vectors.near_duplicates(table.limit(0)).count() == 0


def groups_of_near_copies(count, size):
    rng = np.random.default_rng(2)
    v = np.concatenate([c + 0.02 * rng.normal(size=(size, 64)) for c in rng.normal(size=(count, 64))])
    return v / np.linalg.norm(v, axis=1)[:, None]


def walked(v, lists):
    ids = np.arange(len(v))
    found = np.zeros((len(v), len(v)), bool)
    for i, j in vectors._walk(v, lists, v, ids, ids):
        found[i, j] = True
    return found


def test_groups_without_links_between_them():
    v = groups_of_near_copies(8, 60)
    lists = [np.array([k // 60 * 60 + (k + 1) % 60, k // 60 * 60 + (k - 1) % 60]) for k in range(len(v))]
    assert (walked(v, lists) == (v @ v.T >= vectors.COSINE)).all()


def test_short_audit_compares_all_rows(monkeypatch):
    v = groups_of_near_copies(1, 200)
    own = lambda v, table, queries, *rest: tuple(np.nonzero(queries @ v.T > 1 - 1e-9))
    monkeypatch.setattr(vectors, "range_search", own)
    assert (walked(v, [np.zeros(0, np.int64)] * len(v)) == (v @ v.T >= vectors.COSINE)).all()
    assert vectors.MARGIN >= np.sqrt(2 - 2 * vectors.COSINE)


def test_only_queries_that_can_link_walk():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(600, 64))
    v = np.concatenate([v, v[:40] + 0.02 * rng.normal(size=(40, 64)), np.repeat(v[:1], 5, axis=0)])
    v /= np.linalg.norm(v, axis=1)[:, None]
    ids = np.arange(len(v))
    near = v @ v.T >= vectors.COSINE
    np.fill_diagonal(near, False)
    left = vectors.may_link(v, ids, v, ids)
    assert set(np.flatnonzero(near.any(axis=1))) <= set(left) and len(left) < 100
    few = vectors.may_link(v[:3, :4] / np.linalg.norm(v[:3, :4], axis=1)[:, None], ids[:3], np.eye(4), ids[10:14])
    assert set(few) <= set(range(4))
