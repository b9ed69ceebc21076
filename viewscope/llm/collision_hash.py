"""Approximate nearest neighbours by collision counting.

Vectors lie in the metric cells of ``vector_blocks``, so a query visits only
blocks that can hold a vector nearer than the k-th found at its home. Every
block keeps one sorted array per random projection. A query opens a window
around its own projection in each array; widening all windows by a factor is
the virtual rehashing of the buckets to a larger radius. A vector that lies in
at least ``threshold`` windows is verified by its true distance, those with
most collisions first.

The search of a block ends when the k-th verified distance is within the
radius that the windows stand for, or when the share BETA of its vectors (and
k more) is verified: beyond that, a collision says little. For a vector within
the radius the chance of a window is p1, beyond RATIO times the radius p2; the
number of projections and the threshold between them keep the chance of
missing a near vector at MISS and the share of far ones verified at BETA.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewscope.llm.vector_blocks import Best, search, usable

RATIO = 1.5          # between the radii that p1 and p2 belong to
MISS = 0.0005        # chance that a vector within the radius stays under the threshold
BETA = 0.05          # share of a block's vectors that may be verified for a query
GROWTH = 1.3         # of the radius from round to round
START = 0.5          # first radius, as a share of the least distance among the probes
PROBES = 16          # vectors of a block that are verified first
STEP = 128           # queries searched together
ROUNDING = 1e-12     # of a projection's scale: equal vectors can differ by this much, as products round differently
SEED = 7


def parameters() -> tuple[float, int, int]:
    """(window width at radius 1, projections, collision threshold)."""
    width = math.sqrt(8 * RATIO ** 2 * math.log(RATIO) / (RATIO ** 2 - 1))
    inside = lambda x: math.erf(width / 2 / x / math.sqrt(2))
    p1, p2 = inside(1.0), inside(RATIO)
    a, b = math.sqrt(math.log(2 / BETA)), math.sqrt(math.log(1 / MISS))
    m = math.ceil((a + b) ** 2 / (2 * (p1 - p2) ** 2))
    share = (a / b * p1 + p2) / (1 + a / b)
    return width, m, math.ceil(share * m)


class EuclideanSpace:
    """Vectors and queries as they are; keys are distances."""

    key_type = "double"

    def points(self, vectors: np.ndarray) -> np.ndarray:
        return vectors

    query_points = points

    def reach(self, queries: np.ndarray, worst: np.ndarray) -> np.ndarray:
        return worst


class CollisionIndex:
    """Sorted projection arrays of a block of vectors. ``verified`` counts the distances computed."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.width, self.m, self.threshold = parameters()
        rng = np.random.default_rng(SEED)
        self.directions = rng.standard_normal((vectors.shape[1], self.m))
        by_id = np.argsort(ids, kind="stable")   # of equal collisions the smaller id is verified first
        self.ids, self.vectors, self.verified = ids[by_id], vectors[by_id], 0
        vectors = self.vectors
        self.longest = np.sqrt((vectors ** 2).sum(axis=1).max(initial=0.0))
        projected = (vectors @ self.directions).T
        self.order = np.argsort(projected, axis=1, kind="stable")
        self.sorted = np.take_along_axis(projected, self.order, axis=1)

    def search(self, queries: np.ndarray, best: Best) -> None:
        """Add to ``best`` the vectors that collide often enough with each query."""
        for i in range(0, len(queries), STEP):
            self._search(queries[i:i + STEP], best.part(slice(i, i + STEP)))

    def _search(self, queries: np.ndarray, best: Best) -> None:
        n = len(self.ids)
        room = np.full(len(queries), math.ceil(BETA * n) + best.keys.shape[1])
        at = queries @ self.directions
        # a few verified vectors tell the scale that the windows start from
        probe = np.arange(0, n, max(1, n // PROBES))[:PROBES]
        self.verified += len(probe) * len(queries)
        away = np.sqrt(np.maximum(((queries[:, None, :] - self.vectors[probe][None, :, :]) ** 2).sum(axis=2), 0.0))
        best.add(np.arange(len(queries)), away, self.ids[probe])
        positive = np.where(away > 0, away, np.inf).min(axis=1)
        radius = np.minimum(START * np.where(np.isfinite(positive), positive, 1.0), best.worst)
        radius = np.maximum(radius, 1e-300)
        hits = np.zeros((len(queries), n), np.int16)
        seen = np.zeros((len(queries), n), bool)
        seen[:, probe] = True
        lo = np.array([np.searchsorted(s, at[:, i]) for i, s in enumerate(self.sorted)]).T
        hi = lo.copy()
        longest = np.maximum(np.sqrt((queries ** 2).sum(axis=1)), self.longest)
        slack = ROUNDING * longest[:, None] * np.sqrt((self.directions ** 2).sum(axis=0))
        active = np.arange(len(queries))
        while len(active):
            half = self.width * radius[active, None] / 2 + slack[active]
            low = np.array([np.searchsorted(s, at[active, i] - half[:, i]) for i, s in enumerate(self.sorted)]).T
            high = np.array([np.searchsorted(s, at[active, i] + half[:, i], side="right")
                             for i, s in enumerate(self.sorted)]).T
            low, high = np.minimum(low, lo[active]), np.maximum(high, hi[active])
            for row, q in enumerate(active.tolist()):
                new = [self.order[i, a:b] for i, (a, b) in enumerate(zip(low[row].tolist(), lo[q].tolist())) if a < b]
                new += [self.order[i, a:b] for i, (a, b) in enumerate(zip(hi[q].tolist(), high[row].tolist())) if a < b]
                if new:
                    hits[q] += np.bincount(np.concatenate(new), minlength=n).astype(np.int16)
                    rows = np.flatnonzero((hits[q] >= self.threshold) & ~seen[q])
                    if len(rows) > room[q]:
                        rows = rows[np.argsort(-hits[q, rows], kind="stable")[:room[q]]]
                    if len(rows):
                        seen[q, rows] = True
                        room[q] -= len(rows)
                        self.verified += len(rows)
                        d = np.sqrt(((self.vectors[rows] - queries[q]) ** 2).sum(axis=1))
                        best.add(np.array([q]), d[None, :], self.ids[rows])
            lo[active], hi[active] = low, high
            whole = ((low == 0) & (high == n)).all(axis=1)
            going = (best.worst[active] > radius[active]) & (room[active] > 0) & ~whole
            active = active[going]
            # no further than to the k-th distance found: windows of that radius end the search
            radius[active] = np.minimum(radius[active] * GROWTH, best.worst[active])


def nearest_vectors(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """query_id, rank, vec_id, score: about the k rows of least Euclidean distance to each query.

    Queries are the rows whose vec_id is divisible by ``every``. Ties go to the
    smaller vec_id; with fewer candidates all are returned; an empty table
    gives none. What takes no part: see ``vector_blocks.usable``; zero vectors take none.
    """
    found = search(usable(vectors, zero=False), F.col("id") % every == 0, k, EuclideanSpace(), CollisionIndex)
    return found.select("query_id", "rank", "vec_id", F.col("key").alias("score"))
