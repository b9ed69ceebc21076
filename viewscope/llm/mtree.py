"""Exact top-k inner-product search with M-trees.

A vector x gets one more coordinate sqrt(M^2 - |x|^2), a query a zero; the
nearest vectors in this metric space are those of largest inner product. The
cells of ``vector_blocks`` are the entries of the topmost page, spread over the
cluster; each block below is an M-tree of its own: pages whose entries keep a
covering radius and the distance to their parent. Each query takes the page of
best bound first; the stored parent distance and the triangle inequality rule
out entries and vectors, query by query, before their distance or product is
computed, and a query ends when no page can hold a better score than its k
found. The queries of a batch take their pages in step.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewscope.llm.vector_blocks import Best, search, usable

PAGE = 64        # vectors of a leaf page, and entries of a page above it, at most
SCALE = 64.0
DENSE = 0.25     # from this share of wanted products on, a page's are computed as one matrix
_LONG = (1 << 63) - 1
_SLACK = 1e-9    # relative rounding allowance of bounds; scores themselves are exact


class Node:
    """A page: routing object, its children's distances to it, and covering radii (leaf: the vectors' own rows)."""

    __slots__ = ("rows", "children", "center", "radius", "parent_distance", "child_radius", "child_centers")


def build(points: np.ndarray, rows: np.ndarray, center: np.ndarray) -> Node:
    node = Node()
    node.center = center
    d = np.sqrt(((points[rows] - center) ** 2).sum(axis=1))
    node.radius = float(d.max()) if len(rows) else 0.0
    if len(rows) <= PAGE:
        node.rows, node.children, node.parent_distance = rows, None, d
        return node
    fan = min(PAGE, -(-len(rows) // PAGE) + 1)
    pivots = [int(np.argmin(d))]   # farthest-first pivots spread over the set
    near = ((points[rows] - points[rows[pivots[0]]]) ** 2).sum(axis=1)
    while len(pivots) < fan and near.max() > 0:
        pivots.append(int(np.argmax(near)))
        near = np.minimum(near, ((points[rows] - points[rows[pivots[-1]]]) ** 2).sum(axis=1))
    p = points[rows[pivots]]
    owner = np.argmin((p ** 2).sum(axis=1)[None, :] - 2 * points[rows] @ p.T, axis=1)
    parts = [(p[i], rows[owner == i]) for i in range(len(p))]
    parts = [x for x in parts if len(x[1])]
    if max(len(x[1]) for x in parts) > 0.9 * len(rows):   # copies or near copies: cut by number instead
        size = max(PAGE, -(-len(rows) // PAGE))
        parts = [(points[rows[i]], rows[i:i + size]) for i in range(0, len(rows), size)]
    node.children = [build(points, r, c) for c, r in parts]
    node.child_centers = np.array([c for c, _ in parts])
    node.child_radius = np.array([c.radius for c in node.children])
    node.parent_distance = np.sqrt(((node.child_centers - center) ** 2).sum(axis=1))
    node.rows = None
    return node


class InnerProductSpace:
    """Where vectors and queries lie, given the largest squared norm ``top`` of all vectors. Keys are negated scores.

    Norms whose squares a double can't hold give no bounds: everything lies in one place and nothing is ruled out.
    """

    key_type = "long"

    def __init__(self, top: float):
        self.top, self.bounded = top, top < 1e300

    def points(self, vectors: np.ndarray) -> np.ndarray:
        x = whole(vectors)
        if not self.bounded:
            return np.zeros((len(x), x.shape[1] + 1))
        return np.column_stack([x, np.sqrt(np.maximum(self.top - (x ** 2).sum(axis=1), 0.0))])

    def query_points(self, vectors: np.ndarray) -> np.ndarray:
        x = whole(vectors)
        return np.column_stack([x, np.zeros(len(x))]) if self.bounded else np.zeros((len(x), x.shape[1] + 1))

    def base(self, queries: np.ndarray) -> np.ndarray:
        """|q|^2 + top: the squared distance is this less twice the score."""
        with np.errstate(over="ignore"):
            return (whole(queries) ** 2).sum(axis=1) + self.top if self.bounded else np.full(len(queries), np.inf)

    def reach(self, queries: np.ndarray, worst: np.ndarray) -> np.ndarray:
        base = self.base(queries)
        return np.sqrt(np.maximum(2 * worst + base + _SLACK * (base + 1.0), 0.0))


def whole(vectors: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * vectors)


class InnerProductTree:
    """The M-tree of a block. ``products`` counts the products computed."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, space: InnerProductSpace):
        self.space, self.ids, self.vectors = space, ids, whole(vectors)
        self.points = space.points(vectors)
        self.products = 0
        self.root = build(self.points, np.arange(len(ids)), self.points.mean(axis=0))

    def products_of(self, queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        """Integer products of each query with each vector, as longs; exact, and clamped to the ends of long."""
        bound = np.sqrt(self.space.top) * np.sqrt((queries ** 2).sum(axis=1).max())
        if bound < 2.0 ** 52:
            return (queries @ vectors.T).astype(np.int64)
        if bound < 2.0 ** 62 and np.abs(queries).max() < 2.0 ** 62 and np.abs(vectors).max() < 2.0 ** 62:
            return queries.astype(np.int64) @ vectors.astype(np.int64).T
        x, y = [[int(c) for c in v] for v in vectors], [[int(c) for c in q] for q in queries]
        return np.array([[max(-_LONG + 1, min(_LONG - 1, sum(a * b for a, b in zip(q, v)))) for v in x] for q in y], np.int64)

    def offer(self, best: Best, q: np.ndarray, rows: np.ndarray, wanted: np.ndarray) -> None:
        """Add the products of the queries ``q`` and ``rows`` that are ``wanted``."""
        some = wanted.any(axis=0)
        rows, wanted = rows[some], wanted[:, some]
        if not wanted.any():
            return
        if wanted.mean() >= DENSE:
            keys = -self.products_of(self.queries[q], self.vectors[rows])
            self.products += keys.size
        else:
            keys = np.full(wanted.shape, best.none, np.int64)
            for i in np.flatnonzero(wanted.any(axis=1)):
                keys[i, wanted[i]] = -self.products_of(self.queries[q[i]][None, :], self.vectors[rows[wanted[i]]])[0]
            self.products += int(wanted.sum())
        best.add(q, keys, self.ids[rows])

    def search(self, queries: np.ndarray, best: Best) -> None:
        """Add to ``best`` (keys are negated scores) every vector that can be among a query's k."""
        points, base = self.space.query_points(queries), self.space.base(queries)
        self.queries = whole(queries)
        slack = _SLACK * (base + 1.0)

        def key(q, distance):   # least key (negated product) at that distance or beyond
            low = np.maximum(distance, 0.0)
            extra = (slice(None),) + (None,) * (low.ndim - 1)
            return low * low / 2 - (base[q] / 2 + slack[q])[extra]

        # down to the leaf pages: least key of each query in each page, infinite where an entry above rules it out
        pages, limits, distances = [], [], []
        every = np.arange(len(queries))
        stack = [(self.root, every, np.sqrt(((points - self.root.center) ** 2).sum(axis=1)))]
        while stack:
            node, q, d = stack.pop()
            if node.children is None:
                least, away = np.full(len(queries), np.inf), np.zeros(len(queries))
                least[q], away[q] = key(q, d - node.radius), d
                pages.append(node)
                limits.append(least)
                distances.append(away)
                continue
            # |d(query, parent) - d(entry, parent)| bounds d(query, entry) before that is computed
            gap = np.abs(d[:, None] - node.parent_distance[None, :]) - node.child_radius[None, :]
            may = key(q, gap) <= best.worst[q][:, None]
            for i, child in enumerate(node.children):
                to = q[may[:, i]]
                if len(to):
                    real = np.sqrt(((points[to] - child.center) ** 2).sum(axis=1))
                    near = key(to, real - child.radius) <= best.worst[to]
                    if near.any():
                        stack.append((child, to[near], real[near]))
        if not pages:
            return
        limits, distances = np.column_stack(limits), np.column_stack(distances)
        order = np.argsort(limits, axis=1, kind="stable")
        for step in range(len(pages)):
            page = order[:, step]
            limit = limits[every, page]
            active = np.flatnonzero((limit < np.inf) & (limit <= best.worst))
            if not len(active):
                return   # bounds only get worse along the order
            for p in np.unique(page[active]):
                q = active[page[active] == p]
                gap = np.abs(distances[q, p][:, None] - pages[p].parent_distance[None, :])
                self.offer(best, q, pages[p].rows, key(q, gap) <= best.worst[q][:, None])


def top_inner_products(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer products of each query with all other rows.

    Components become floor(64 * x). Queries are the rows whose vec_id is
    divisible by ``every``. Ties go to the smaller vec_id; with fewer rows all
    are returned; an empty table gives none. What takes no part: see ``vector_blocks.usable``,
    and components too large for 64 * x to be finite. Scores beyond a long are clamped to its ends.
    """
    rows = usable(vectors).where(F.forall("v", lambda x: F.abs(x) < F.lit(2.0 ** 1017)))
    # doubles from 2**56 on are whole, and floor's longs would not hold them all
    floor = lambda x: F.when(F.abs(x) < 2.0 ** 50, F.floor(SCALE * x).cast("double")).otherwise(SCALE * x)
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + floor(x) * floor(x))
    space = InnerProductSpace(rows.agg(F.max(norm).alias("top")).first()["top"] or 0.0)
    found = search(rows, F.col("id") % every == 0, k, space, lambda ids, block: InnerProductTree(ids, block, space))
    return found.select("query_id", "rank", "vec_id", (-F.col("key")).alias("score"))
