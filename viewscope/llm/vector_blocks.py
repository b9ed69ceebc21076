"""A stated set of query vectors against all vectors, in metric blocks.

1. Routing objects come from a bounded sample (k-means over it); every vector belongs to the cell of its
   nearest one, and a cell keeps its covering radius. A cell of more than BLOCK_ROWS rows (copies, a dense region) is
   dealt by hash into several blocks.
2. Each query first searches one block of its home cell. Its k-th key found there bounds what can still matter.
3. It then visits the blocks of those cells only whose radius reaches within that bound; the rest can't hold a better
   row. Vectors move once; a block's index is built once, and its queries stream past it in batches.

Which cells exist affects the work, not what an exact index returns. Partitions are a fixed number, given by the
cluster's cores; a task holds one block and one batch of queries at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viewscope.llm.common import trimmed
from viewscope.session import materialize, ship_package

BLOCK_ROWS = 4096    # vectors of a block, about, at most
CELL_ROWS = 2048     # vectors a cell, about, while there are fewer than MAX_CELLS
MAX_CELLS = 1024
SAMPLE = 16          # rows a cell that routing objects are chosen from
ROUNDS = 6           # of k-means over that sample
BATCH = 1024         # queries searched together
_ALLOWANCE = 1e-9    # relative rounding allowance of distances to routing objects


class Space(Protocol):
    """The metric space of a search: where rows and queries lie, and how far a key reaches."""

    key_type: str

    def points(self, vectors: np.ndarray) -> np.ndarray: ...

    def query_points(self, vectors: np.ndarray) -> np.ndarray: ...

    def reach(self, queries: np.ndarray, worst: np.ndarray) -> np.ndarray:
        """Distance beyond which no row has a key of ``worst`` or less."""
        ...


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", zero: bool = True) -> DataFrame:
    """(id, v) of the rows that take part.

    A row without id, and a vector that is null, empty, of another length than most, or holds a null or non-finite
    component (or only zeros, unless ``zero``) takes no part.
    """
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & fine)
    if not zero:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    rows = materialize(rows, "vectors")
    size = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.desc("n"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("v") == size[0]["d"]) if size else rows


class Best:
    """The k best (key, id) pairs of each query of a batch; smaller keys and ids are better.

    Keys are doubles or, with an integer ``limit``, longs. Keys above a query's ``limit`` aren't wanted.
    """

    def __init__(self, query_ids: np.ndarray, k: int, limit: np.ndarray):
        self.query_ids, self.limit = query_ids, limit
        self.none = np.inf if limit.dtype.kind == "f" else np.iinfo(np.int64).max
        self.keys = np.full((len(query_ids), k), self.none, limit.dtype)
        self.ids = np.full((len(query_ids), k), np.iinfo(np.int64).max)

    def part(self, at: slice) -> Best:
        """Some of the queries; what is added to them is added here."""
        out = Best.__new__(Best)
        out.query_ids, out.limit, out.none = self.query_ids[at], self.limit[at], self.none
        out.keys, out.ids = self.keys[at], self.ids[at]
        return out

    @property
    def worst(self) -> np.ndarray:
        """The key that a row must not exceed, as a double; infinite while fewer than k are found without limit."""
        w = np.minimum(self.keys[:, -1], self.limit)
        return np.where(w == self.none, np.inf, w.astype(np.float64))

    def add(self, q: np.ndarray, keys: np.ndarray, ids: np.ndarray) -> None:
        """Offer the vectors ``ids`` to the queries ``q``; ``keys`` has a row for each query."""
        keys = np.where(ids[None, :] == self.query_ids[q][:, None], self.none, keys)
        worst = np.minimum(self.keys[q, -1], self.limit[q])[:, None]
        keys = np.where(keys <= worst, keys, self.none)
        useful = (keys != self.none).any(axis=1)
        if useful.any():
            q, keys = q[useful], keys[useful]
            k = np.concatenate([self.keys[q], keys], axis=1)
            i = np.concatenate([self.ids[q], np.broadcast_to(ids, keys.shape)], axis=1)
            i[k == self.none] = np.iinfo(np.int64).max
            order = np.lexsort((i, k), axis=1)[:, :self.keys.shape[1]]
            self.keys[q], self.ids[q] = np.take_along_axis(k, order, 1), np.take_along_axis(i, order, 1)

    def frame(self) -> pd.DataFrame:
        q, j = np.nonzero(self.keys != self.none)
        return pd.DataFrame({"query_id": self.query_ids[q], "key": self.keys[q, j], "vec_id": self.ids[q, j]})


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x ** 2).sum(axis=1)[:, None] + (y ** 2).sum(axis=1)[None, :] - 2 * x @ y.T, 0.0))


def _routing_objects(points: np.ndarray, cells: int) -> np.ndarray:
    """Centres of k-means from evenly taken starts; copies and empty clusters go."""
    c = np.unique(points[np.linspace(0, len(points) - 1, min(cells, len(points))).astype(int)], axis=0)
    for _ in range(ROUNDS):
        owner = np.argmin(_distances(points, c), axis=1)
        used = np.unique(owner)
        c = np.array([points[owner == j].mean(axis=0) for j in used])
    return c


def _stream(build: Callable, k: int, key_type: str):
    """Rows sorted by block, vectors before queries: an index for each block, its queries searched in batches."""
    dtype = np.float64 if key_type == "double" else np.int64

    def run(batches):
        block, held, index = None, [], None
        for batch in batches:
            for number, rows in batch.groupby("block", sort=False):
                if number != block:
                    block, held, index = number, [], None
                asks = rows["asks"].to_numpy() == 1
                if not asks.all():
                    held.append(rows.loc[~asks, ["id", "v"]])
                if not asks.any() or not held and index is None:
                    continue
                if index is None:   # the block's vectors are all here
                    rows_in = pd.concat(held)
                    index, held = build(rows_in["id"].to_numpy(), _matrix(rows_in["v"])), []
                asking = rows.loc[asks]
                for i in range(0, len(asking), BATCH):
                    some = asking.iloc[i:i + BATCH]
                    best = Best(some["id"].to_numpy(), k, some["tau"].to_numpy().astype(dtype))
                    index.search(_matrix(some["v"]), best)
                    yield best.frame()

    return trimmed(run)


def search(vectors: DataFrame, is_query: Column, k: int, space: Space,
           build: Callable[[np.ndarray, np.ndarray], object]) -> DataFrame:
    """(query_id, rank, vec_id, key) of the k best of each query.

    ``build(ids, vectors)`` indexes a block; the index's ``search(queries, best)`` adds what it finds. Of rows that
    share an id, the one with the least vector asks; none of them is found by it.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    n = vectors.count()
    cells = max(1, min(MAX_CELLS, -(-n // CELL_ROWS)))
    # a sample bounded by its count, whatever ids and copies there are
    draw = F.xxhash64(F.lit("routing"), "id", "v")
    unit = F.pmod(draw, F.lit(1 << 30)) / float(1 << 30)
    drawn = vectors.where(unit < min(1.0, 4 * SAMPLE * cells / max(n, 1))).orderBy(draw, "id").limit(SAMPLE * cells)
    sample = drawn.select("v").toPandas()
    if sample.empty:   # too few rows to draw from
        sample = vectors.orderBy("id").limit(1).select("v").toPandas()
    if sample.empty:
        return spark.createDataFrame([], f"query_id long, rank int, vec_id long, key {space.key_type}")
    shared = spark.sparkContext.broadcast((space, _routing_objects(space.points(_matrix(sample["v"])), cells)))

    def nearest(batches):
        space, objects = shared.value
        for batch in batches:
            if len(batch):
                d = _distances(space.points(_matrix(batch["v"])), objects)
                cell = np.argmin(d, axis=1)
                # rows that repeat an id are told apart, so that they too are dealt over blocks
                yield batch.assign(cell=cell.astype("int32"), d=d[np.arange(len(d)), cell],
                                   nth=batch.groupby("id").cumcount().astype("int32"))

    rows = materialize(vectors.mapInPandas(trimmed(nearest), "id long, v array<double>, cell int, d double, nth int"),
                       "cells")
    stats = {r["cell"]: r for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("r")).collect()}
    # blocks of a cell are numbered from its first; at most MAX_CELLS cells
    first, subs, radius = {}, {}, {}
    blocks = 0
    for cell in sorted(stats):
        first[cell], subs[cell], radius[cell] = blocks, -(-stats[cell]["n"] // BLOCK_ROWS), stats[cell]["r"]
        blocks += subs[cell]
    parts = min(blocks, max(4 * spark.sparkContext.defaultParallelism, 16))
    by_cell = lambda d: F.array(*[F.lit(d.get(c, 0)) for c in range(max(stats) + 1)])[F.col("cell")]
    block = (by_cell(first) + F.pmod(F.xxhash64(F.lit("block"), "id", "nth"), by_cell(subs))).cast("int")
    none = F.lit(float("inf")) if space.key_type == "double" else F.lit(int(np.iinfo(np.int64).max))
    placed = rows.select(block.alias("block"), F.lit(0).alias("asks"), "id", "v", none.alias("tau"))

    def found_in(asking: DataFrame) -> DataFrame:
        asking = asking.select("block", F.lit(1).alias("asks"), "id", "v", "tau")
        return (placed.unionByName(asking).repartitionByRange(parts, "block")
                .sortWithinPartitions("block", "asks", "id")
                .mapInPandas(_stream(build, k, space.key_type), f"query_id long, key {space.key_type}, vec_id long"))

    # a query's home: the nearest cell that holds rows
    kept = np.array(sorted(stats))
    bounds = spark.sparkContext.broadcast((kept, np.array([first[c] for c in sorted(stats)]),
                                           np.array([subs[c] for c in sorted(stats)]),
                                           np.array([radius[c] for c in sorted(stats)])))

    def home(batches):
        space, objects = shared.value
        cells = bounds.value[0]
        for batch in batches:
            if len(batch):
                d = _distances(space.query_points(_matrix(batch["v"])), objects[cells])
                yield batch.assign(cell=cells[np.argmin(d, axis=1)].astype("int32"))

    queries = vectors.where(is_query).groupBy("id").agg(F.min("v").alias("v"))
    at_home = materialize(queries.mapInPandas(trimmed(home), "id long, v array<double>, cell int")
                          .withColumn("nth", F.lit(0)).select("id", "v", block.alias("block")), "queries")
    near = materialize(found_in(at_home.withColumn("tau", none)), "near")
    worst = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("key").alias("key"))
    asking = at_home.join(worst.where(F.col("n") >= k).select(F.col("query_id").alias("id"), "key"), "id", "left").select(
        "id", "v", "block", F.coalesce("key", none).alias("tau"))

    def visits(batches):
        space, objects = shared.value
        cells, first, subs, radius = bounds.value
        for batch in batches:
            if len(batch):
                v = _matrix(batch["v"])
                tau = batch["tau"].to_numpy()
                tau = tau if tau.dtype.kind == "f" else np.where(tau == np.iinfo(np.int64).max, np.inf, tau.astype(float))
                d = _distances(space.query_points(v), objects[cells])
                scale = _ALLOWANCE * (d + radius[None, :] + 1.0) + 1e-7 * np.sqrt((objects[cells] ** 2).sum(axis=1))
                go = ~(d - radius[None, :] - scale > space.reach(v, tau)[:, None])
                lists = [np.concatenate([np.arange(first[c], first[c] + subs[c]) for c in np.flatnonzero(g)] or
                                        [np.zeros(0, int)]) for g in go]
                lists = [x[x != own].astype("int32") for x, own in zip(lists, batch["block"])]
                yield batch[["id", "v", "tau"]].assign(blocks=lists)

    onward = asking.mapInPandas(trimmed(visits), f"id long, v array<double>, tau {space.key_type}, blocks array<int>")
    far = found_in(onward.select("id", "v", "tau", F.explode("blocks").alias("block")))
    order = Window.partitionBy("query_id").orderBy("key", "vec_id")
    found = near.unionByName(far).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "key")
