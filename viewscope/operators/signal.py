"""Metadata signal (M11, M12, T5): how much of the views the metadata columns explain.

Ridge regression of ln(1 + views) on the one-hot values of category, thumbnail
style and month, with an unpenalised intercept and cross-validation by hashed folds.

Rows are first reduced to cells: one row per (fold, category, style, month)
with count, sum and sum of squares of the target, which is all that least
squares needs. The model of a fold and the model of all rows are then solved
together by preconditioned conjugate gradients: an iteration is one job over the cells
that multiplies the sparse normal matrix with the current directions. The
matrix itself never exists, so the number of distinct values has no cap;
the driver holds a few numbers per value and model, no values and no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewscope.functions.distribute import numbered
from viewscope.schema import SEED
from viewscope.session import materialize

META_COLUMNS = ["category", "thumbnail_style", "publish_month"]
MAX_ITERATIONS = 500
TOLERANCE = 1e-10      # of the residual, relative to the right-hand side


def signal_cells(df: DataFrame, columns: list[str], folds: int, id_col: str = "video_id",
                 target: str = "views") -> tuple[DataFrame, DataFrame]:
    """(cells, vocabulary). Cells: _fold, _f0.. (feature numbers), n, sy, syy; vocabulary: feature, column, value."""
    y = F.log1p(target)
    fold = F.pmod(F.xxhash64(id_col, F.lit(SEED)), F.lit(folds)).cast("int")
    cells = materialize(
        df.select(fold.alias("_fold"), *columns, y.alias("_y")).groupBy("_fold", *columns).agg(
            F.count(F.lit(1)).alias("n"), F.sum("_y").alias("sy"), F.sum(F.col("_y") * F.col("_y")).alias("syy")),
        "signal-cells")
    values = cells.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("column"), F.col(c).cast("string").alias("value")) for i, c in enumerate(columns)
    ])).alias("v")).select("v.*").distinct()
    vocabulary = materialize(numbered(values, "feature"), "signal-vocabulary")
    out = cells
    for i, c in enumerate(columns):
        of_column = vocabulary.where(F.col("column") == i).select(F.col("feature").alias(f"_f{i}"), F.col("value").alias("_v"))
        out = out.join(of_column, F.col(c).cast("string").eqNullSafe(F.col("_v"))).drop("_v")
    out = out.select("_fold", *[f"_f{i}" for i in range(len(columns))], "n", "sy", "syy")
    return materialize(out, "signal-cells-numbered"), vocabulary


def _blocks(cells: DataFrame, features: list[str]):
    """The cells as arrays (features, n, fold), a few thousand cells a block, written once.

    An iteration is a small job over these blocks; as an RDD it skips the planning that would outweigh the work.
    """
    def pack(batches):
        for batch in batches:
            yield pd.DataFrame({"f": [batch[features].to_numpy("<i8").tobytes()], "n": [batch["n"].to_numpy("<f8").tobytes()],
                                "fold": [batch["_fold"].to_numpy("<i4").tobytes()]})

    packed = materialize(cells.mapInPandas(pack, "f binary, n binary, fold binary"), "signal-blocks")
    width = len(features)
    return packed.rdd.map(lambda r: (np.frombuffer(r.f, "<i8").reshape(-1, width), np.frombuffer(r.n, "<f8"),
                                     np.frombuffer(r.fold, "<i4")))


class _Normal:
    """Products with the normal matrices of all models, over the cells.

    Model m < folds leaves fold m out; the last model has every row. Centring by the
    intercept needs no pass of its own: the mean prediction follows from the value counts.
    """

    def __init__(self, cells: DataFrame, n_columns: int, n_features: int, folds: int, alpha: float):
        self.alpha, self.folds = alpha, folds
        self.features = [f"_f{i}" for i in range(n_columns)]
        by_fold = (cells.select("_fold", F.explode(F.array(*self.features)).alias("f"), "n", "sy")
                   .groupBy("f", "_fold").agg(F.sum("n").alias("n"), F.sum("sy").alias("sy")).toPandas())
        shape = (n_features, folds)
        n, sy = np.zeros(shape), np.zeros(shape)
        n[by_fold["f"], by_fold["_fold"]], sy[by_fold["f"], by_fold["_fold"]] = by_fold["n"], by_fold["sy"]
        self.count = self._models(n)
        # every row has one value of the first column, so its features add up to all rows
        total_n, total_sy = self.count.sum(axis=0) / n_columns, self._models(sy).sum(axis=0) / n_columns
        self.rows = np.maximum(total_n, 1.0)
        self.trained = total_n > 0
        self.mean = total_sy / self.rows
        self.right = self._models(sy) - self.count * self.mean
        self.diagonal = self.count - self.count ** 2 / self.rows + alpha
        self.blocks = _blocks(cells, self.features)

    def _models(self, by_fold: np.ndarray) -> np.ndarray:
        every = by_fold.sum(axis=1, keepdims=True)
        return np.hstack([every - by_fold, every])

    def times(self, p: np.ndarray) -> np.ndarray:
        sc, (n_features, models) = self.blocks.context, p.shape
        held = sc.broadcast(p)

        def multiply(blocks):
            out = np.zeros((n_features, models))
            for f, n, fold in blocks:
                product = n[:, None] * (fold[:, None] != np.arange(models)) * held.value[f].sum(axis=1)
                for column in f.T:
                    for m in range(models):
                        out[:, m] += np.bincount(column, product[:, m], n_features)
            yield out

        # partial products meet in a tree, as in a gradient step of any linear model
        out = self.blocks.mapPartitions(multiply).treeReduce(np.add)
        held.unpersist()
        return out - self.count * ((self.count * p).sum(axis=0) / self.rows) + self.alpha * p

    def solve(self) -> np.ndarray:
        """Coefficients by feature and model."""
        w = np.zeros_like(self.right)
        r = self.right.copy()
        z = r / self.diagonal
        p, rz = z.copy(), (r * z).sum(axis=0)
        goal = TOLERANCE * np.sqrt((r * r).sum(axis=0))
        for _ in range(MAX_ITERATIONS):
            open_ = np.sqrt((r * r).sum(axis=0)) > goal
            if not open_.any():
                return w
            q = self.times(p)
            pq = (p * q).sum(axis=0)
            step = np.where(open_ & (pq > 0), rz / np.where(pq > 0, pq, 1.0), 0.0)
            w, r = w + step * p, r - step * q
            z = r / self.diagonal
            rz, before = (r * z).sum(axis=0), rz
            p = z + np.where(open_ & (before > 0), rz / np.where(before > 0, before, 1.0), 0.0) * p
        raise RuntimeError(f"ridge did not converge in {MAX_ITERATIONS} iterations")


def _squared_error(cells: DataFrame, features: list[str], w: np.ndarray, intercept: np.ndarray,
                   trained: np.ndarray) -> tuple[float, float, float, int]:
    """(SSE, sum of y, sum of y squared, rows) over the cells whose fold has a model."""
    held = cells.sparkSession.sparkContext.broadcast((w, intercept, trained))

    def errors(batches):
        w, intercept, trained = held.value
        for batch in batches:
            fold = batch["_fold"].to_numpy()
            batch = batch[trained[fold]]
            fold = batch["_fold"].to_numpy()
            n, sy, syy = (batch[c].to_numpy("float64") for c in ("n", "sy", "syy"))
            guess = intercept[fold] + w[batch[features].to_numpy(), fold[:, None]].sum(axis=1)
            yield pd.DataFrame({"sse": [float((syy - 2 * guess * sy + n * guess * guess).sum())], "sy": [sy.sum()],
                                "syy": [syy.sum()], "n": [n.sum()]})

    one = cells.mapInPandas(errors, "sse double, sy double, syy double, n double").agg(
        *[F.sum(c).alias(c) for c in ("sse", "sy", "syy", "n")]).first()
    held.unpersist()
    return tuple(x or 0.0 for x in one)


def metadata_signal(df: DataFrame, alpha: float = 1.0, folds: int = 5, columns: list[str] | None = None,
                    top: int = 10) -> tuple[DataFrame, DataFrame]:
    """One row with the cross-validated R^2, and the ``top`` coefficients of the model of all rows.

    Folds are ``pmod(xxhash64(video_id, 42), folds)``; R^2 pools the predictions of all folds. It is null with fewer rows
    than folds or a constant target. A value absent from a training fold has weight 0 there. A null value is a value of
    its own, named ``<column>_null``. An empty table gives a null R^2 and no coefficients.
    """
    if alpha <= 0:
        raise ValueError("alpha must be positive")
    columns = columns or META_COLUMNS
    spark = df.sparkSession
    cells, vocabulary = signal_cells(df, columns, folds)
    n_features = vocabulary.count()
    r2, best = None, []
    if n_features:
        normal = _Normal(cells, len(columns), n_features, folds, alpha)
        w = normal.solve()
        intercept = normal.mean - (normal.count * w).sum(axis=0) / normal.rows
        sse, sy, syy, n = _squared_error(cells, normal.features, w, intercept, normal.trained)
        sst = syy - sy * sy / n if n else 0.0
        if normal.rows[-1] >= folds and sst > 1e-12 * max(syy, 1.0):
            r2 = round(1.0 - sse / sst, 4)
        size = np.abs(w[:, -1])
        least = np.sort(size)[-min(top, len(size))]
        best = [(int(f), float(w[f, -1])) for f in np.flatnonzero(size >= least - 1e-9)]   # ties are settled by name
    score = spark.createDataFrame([(r2,)], "cross_validated_r2 double")
    name = F.concat(F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("column") + 1), F.lit("_"),
                    F.coalesce("value", F.lit("null")))
    chosen = spark.createDataFrame(best, "feature long, _w double")
    named = vocabulary.join(chosen, "feature").select(name.alias("feature"), F.round("_w", 4).alias("coefficient"))
    return score, named.orderBy(F.abs("coefficient").desc(), "feature").limit(top)
