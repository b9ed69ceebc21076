"""Vector searches over metric blocks: hot copies, repeated ids, large values, and how much of the work is avoided."""

import collections

import numpy as np
import pytest

from viewscope.llm import collision_hash, mtree, vector_blocks

SCHEMA = "vec_id long, embedding array<double>"


def clustered(n, clusters=40, spread=0.05, seed=1):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((clusters, 64))[rng.integers(0, clusters, n)] + spread * rng.standard_normal((n, 64))


def scattered(n, seed=2):
    x = np.random.default_rng(seed).standard_normal((n, 64))
    return x / np.sqrt((x ** 2).sum(axis=1))[:, None]


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(vector_blocks, "BLOCK_ROWS", 150)
    monkeypatch.setattr(vector_blocks, "CELL_ROWS", 100)
    monkeypatch.setattr(vector_blocks, "BATCH", 7)


def grouped(frame):
    got = collections.defaultdict(list)
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.vec_id, r.score))
    return got


def brute_products(rows, every=20, k=20):
    """Of rows that share an id the least vector asks, and none of them is found."""
    z = [(i, [int(np.floor(64 * c)) for c in v]) for i, v in rows]
    asks = {}
    for (i, v), (_, q) in zip(rows, z):
        if i % every == 0 and (i not in asks or v < asks[i][0]):
            asks[i] = (v, q)
    return {i: [(j, -s) for s, j in sorted((-sum(a * b for a, b in zip(q, y)), j) for j, y in z if j != i)[:k]]
            for i, (_, q) in asks.items()}


def test_products_with_a_third_copies_and_repeated_ids(spark, small_blocks):
    v = clustered(900).tolist()
    rows = [(i, v[0] if i % 3 == 0 else v[i]) for i in range(900)] + [(20, v[5]), (20, v[6]), (41, v[7])]
    assert grouped(mtree.top_inner_products(spark.createDataFrame(rows, SCHEMA))) == brute_products(rows)


def test_products_beyond_the_doubles(spark):
    big = [(0, [float(2 ** 28 + 1) / 64] * 64), (1, [float(2 ** 28 + 3) / 64] * 64), (2, [float(2 ** 28) / 64] * 64)]
    big += [(i, [float(2 ** 28 + 3) / 64] * 63 + [float(2 ** 28 + 3 - i) / 64]) for i in range(3, 30)]
    got = grouped(mtree.top_inner_products(spark.createDataFrame(big, SCHEMA)))
    assert got == brute_products(big) and got[0][0] == (1, 64 * (2 ** 28 + 1) * (2 ** 28 + 3))


def test_products_that_no_long_holds(spark):
    rows = [(0, [1e200, 1.0]), (1, [1e200, 2.0]), (2, [-1e200, 1.0]), (3, [1e308, 1.0]), (4, [1.0, 1.0])]
    got = grouped(mtree.top_inner_products(spark.createDataFrame(rows, SCHEMA)))
    assert [i for i, _ in got[0]] == [1, 4, 2] and got[0][0][1] == -got[0][2][1] == 2 ** 63 - 2


def brute_neighbours(rows, every=100, k=10):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    out = {}
    for q in ids[ids % every == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        out[q] = [(int(ids[j]), float(d[j])) for j in np.lexsort((ids, d))[:k]]
    return out


@pytest.mark.parametrize("make", [clustered, scattered])
def test_neighbours_recall_over_many_blocks(spark, small_blocks, make):
    rows = list(enumerate(make(1500).tolist()))
    got = grouped(collision_hash.nearest_vectors(spark.createDataFrame(rows, SCHEMA)))
    want = brute_neighbours(rows)
    assert set(got) == set(want) and all(len(g) == 10 for g in got.values())
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * 10 * len(want)


def test_neighbours_among_a_third_copies(spark, small_blocks):
    v = clustered(900).tolist()
    rows = [(i, v[0] if i % 3 == 0 else v[i]) for i in range(900)]
    got = grouped(collision_hash.nearest_vectors(spark.createDataFrame(rows, SCHEMA)))
    for q in (0, 300, 600):   # copies, by id
        assert got[q] == [(i, 0.0) for i in range(0, 36, 3) if i != q][:10]


@pytest.mark.parametrize("make,verified", [(clustered, 0.05), (scattered, 0.08)])
def test_share_of_distances_computed(make, verified):
    v = make(6000)
    ids, q = np.arange(len(v)), np.arange(0, len(v), 100)
    index = collision_hash.CollisionIndex(ids, v)
    best = vector_blocks.Best(q, 10, np.full(len(q), np.inf))
    index.search(v[q], best)
    want = brute_neighbours(list(zip(ids.tolist(), v)))
    hits = sum(len(set(best.ids[n].tolist()) & {i for i, _ in want[i]}) for n, i in enumerate(q))
    assert hits >= 0.9 * 10 * len(q) and index.verified <= verified * len(q) * len(v)


def test_share_of_products_computed():
    """The stored bounds rule out most of a clustered block; nothing can rule out scattered unit vectors."""
    v = clustered(4000)
    ids, q = np.arange(len(v)), np.arange(0, len(v), 20)
    space = mtree.InnerProductSpace(float((np.floor(64 * v) ** 2).sum(axis=1).max()))
    index = mtree.InnerProductTree(ids, v, space)
    best = vector_blocks.Best(q, 20, np.full(len(q), np.iinfo(np.int64).max))
    index.search(v[q], best)
    z = np.floor(64 * v).astype(np.int64)
    for n, i in enumerate(q):
        keys = -(z @ z[i])
        keys[i] = np.iinfo(np.int64).max
        assert best.ids[n].tolist() == np.lexsort((ids, keys))[:20].tolist()
    assert index.products <= 0.1 * len(q) * len(v)
