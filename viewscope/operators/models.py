"""Segments and anomalies.

* M1 standardisation: one aggregate pass (mean, population sd), then column
  arithmetic; a constant column becomes 0.
* M2/M5/M7 k-means over all rows: every pass over the written features serves the
  five starts of all k; centres are seeded, moved and measured by all rows.
* M3 silhouette: the all-pairs Euclidean silhouette needs every pair of rows,
  which does not scale; the default is the squared-Euclidean silhouette whose mean
  distances have a closed form from per-cluster sums (the definition Spark's
  ClusteringEvaluator uses). Cluster statistics are k rows. The Euclidean form is an
  option: a bounded sample of rows, each measured against all rows.
* M4 inertia: within-cluster sum of squares from the same per-cluster sums.
* M6 labels: comparisons against medians over the <= 6 cluster rows.
* M8-M10 isolation forest: 100 trees of <= 256 sampled rows each, built by
  ``groupBy(tree).applyInPandas``; the flat node table (<= 100 x 511 rows) is
  broadcast to a vectorised pandas UDF that scores every row.
* M12 R^2 with the group mean as predictor; M11 is in ``signal``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewscope import schema as C
from viewscope.functions.numeric import fixed
from viewscope.functions.quantile import exact_quantiles
from viewscope.session import materialize
from viewscope.schema import CLUSTER_K_RANGE, CONTAMINATION_SWEEP, DEFAULT_CONTAMINATION, FEATURE_COLUMNS, SEED

# ---------------------------------------------------------------- M1


def standardize(df: DataFrame, cols: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """M1: z_<col> = (col - mean) / population sd, 0 for a constant column."""
    cols = cols or FEATURE_COLUMNS
    keep = keep if keep is not None else ["video_id"]
    stats = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols],
                   *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols]).withColumn("_k", F.lit(0))
    joined = df.withColumn("_k", F.lit(0)).join(F.broadcast(stats), "_k")   # one-row side
    z = [F.coalesce(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")), F.lit(0.0)).alias(f"z_{c}")
         for c in cols]
    return joined.select(*keep, *z)


def _cluster_stats(zdf: DataFrame, label: str, zcols: list[str]) -> DataFrame:
    return zdf.groupBy(label).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(c).alias(f"_S_{c}") for c in zcols],
        F.sum(sum(F.col(c) * F.col(c) for c in zcols)).alias("_Q"))


def _label_stats(zdf: DataFrame, labels: list[str], zcols: list[str]) -> DataFrame:
    """(label, c, _n, _S_.., _Q) of the clusters of every label column, in one pass."""
    pairs = F.array(*[F.struct(F.lit(x).alias("label"), F.col(x).alias("c")) for x in labels])
    rows = zdf.select(F.explode(pairs).alias("_p"), *zcols).select("_p.*", *zcols)
    return rows.groupBy("label", "c").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_S_{c}") for c in zcols],
        F.sum(sum(F.col(c) * F.col(c) for c in zcols)).alias("_Q"))


def _silhouettes(zdf: DataFrame, stats: DataFrame, labels: list[str], zcols: list[str]) -> DataFrame:
    """One row with the mean silhouette of every label column; ``stats`` has one row per label and cluster."""
    packed = stats.agg(F.collect_list(F.struct(
        "label", "c", "_n", "_Q", F.array(*[F.col(f"_S_{c}") for c in zcols]).alias("_S"))).alias("_cl"))
    sq = sum(F.col(c) * F.col(c) for c in zcols)
    x = F.array(*[F.col(c) for c in zcols])

    def dot(s):
        return F.aggregate(F.zip_with(s, x, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)

    rows = (zdf.select(*labels, *zcols, sq.alias("_sq"), F.lit(0).alias("_k"))
            .join(F.broadcast(packed.withColumn("_k", F.lit(0))), "_k"))
    per_row = rows
    for label in labels:
        own_label = F.col(label)
        per_row = per_row.withColumn(f"_d{label}", F.transform(
            F.filter("_cl", lambda cl: cl["label"] == label), lambda cl: F.struct(
                (cl["c"] == own_label).alias("own"), cl["_n"].alias("n"),
                (F.col("_sq") * cl["_n"] - 2 * dot(cl["_S"]) + cl["_Q"]).alias("tot"))))
    scores = []
    for label in labels:
        own = F.filter(F.col(f"_d{label}"), lambda s: s["own"])[0]
        others = F.filter(F.col(f"_d{label}"), lambda s: ~s["own"])
        a = F.try_divide(own["tot"], own["n"] - 1)
        b = F.array_min(F.transform(others, lambda s: s["tot"] / s["n"]))
        scores.append(F.avg(F.when((own["n"] <= 1) | b.isNull(), F.lit(0.0)).otherwise(
            F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0)))).alias(label))   # coinciding points score 0
    return per_row.agg(*scores)


def silhouette(zdf: DataFrame, label: str, zcols: list[str]) -> DataFrame:
    """M3 (squared Euclidean): mean over rows of (b - a) / max(a, b); 0 for single-row clusters.

    For row x and cluster C: mean ||x - y||^2 over y in C =
    ||x||^2 - 2 x.S_C / n_C + Q_C / n_C, with the own cluster taken over the
    other n_C - 1 rows. Returns one row with column ``silhouette``.
    """
    stats = _label_stats(zdf, [label], zcols)
    return _silhouettes(zdf, stats, [label], zcols).withColumnRenamed(label, "silhouette")


SILHOUETTE_SAMPLE = 2000


def euclidean_silhouettes(zdf: DataFrame, labels: list[str], zcols: list[str], sample: int = SILHOUETTE_SAMPLE,
                          id_col: str = "video_id") -> dict[str, float]:
    """M3 (Euclidean): mean silhouette of every label column over ``sample`` rows, each measured against all rows.

    Plain distances have no closed form, and all pairs don't scale, so the ``sample`` rows of least hash stand for the mean;
    with no more rows than that it is exact. One pass adds up, per task, the distances of its rows to the
    sample by cluster, so ``sample`` x clusters numbers leave a task and reach the driver. Labels must not be null.
    """
    drawn = (zdf.select(id_col, *labels, *zcols).orderBy(F.xxhash64(id_col, F.lit(SEED)), id_col).limit(sample).toPandas())
    points = drawn[zcols].to_numpy("float64")
    if not len(points):
        return dict.fromkeys(labels)

    def measure(batches):
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for part in range(0, len(batch), 512):
                rows = batch.iloc[part:part + 512]
                x = rows[zcols].to_numpy("float64")
                gap = np.sqrt(((x[:, None, :] - points[None]) ** 2).sum(axis=2))
                for i, label in enumerate(labels):
                    own = rows[label].to_numpy()
                    for c in np.unique(own):
                        found = gap[own == c]
                        key = (i, int(c))
                        total[key] = total.get(key, 0.0) + np.append(found.sum(axis=0), len(found))
        if total:
            yield pd.DataFrame({"label": [i for i, _ in total], "c": [c for _, c in total],
                                "sums": [v.tolist() for v in total.values()]})

    parts = zdf.select(*labels, *zcols).mapInPandas(measure, "label int, c int, sums array<double>")
    summed = (parts.select("label", "c", F.posexplode("sums").alias("at", "v")).groupBy("label", "c", "at")
              .agg(F.sum("v").alias("v")).toPandas())
    out = {}
    for i, label in enumerate(labels):
        table = summed[summed["label"] == i].pivot(index="c", columns="at", values="v").sort_index()
        size, sums = table[len(points)].to_numpy(), table.drop(columns=len(points)).to_numpy()
        own = np.searchsorted(table.index.to_numpy(), drawn[label].to_numpy())
        rows = np.arange(len(points))
        mine = sums[own, rows] / np.maximum(size[own] - 1, 1)
        others = sums / size[:, None]
        others[own, rows] = np.inf
        near = others.min(axis=0)
        top = np.maximum(mine, near)
        usable = (size[own] > 1) & np.isfinite(near) & (top > 0)
        scores = np.zeros(len(points))
        scores[usable] = (near - mine)[usable] / top[usable]
        out[label] = float(scores.mean())
    return out


def inertia(zdf: DataFrame, label: str, zcols: list[str]) -> DataFrame:
    """M4: within-cluster sum of squared distances to the cluster mean."""
    stats = _cluster_stats(zdf, label, zcols)
    per = F.col("_Q") - sum(F.col(f"_S_{c}") * F.col(f"_S_{c}") for c in zcols) / F.col("_n")
    return stats.agg(F.sum(per).alias("inertia"))


def segment_summary(df: DataFrame, label: str) -> DataFrame:
    """Per segment count and means."""
    return df.groupBy(label).agg(
        F.count(F.lit(1)).alias("videos"), F.avg("views").alias("avg_views"),
        F.avg("engagement_rate_pct").alias("avg_engagement_rate_pct"),
        F.avg("avg_watch_time_seconds").alias("avg_watch_time_seconds"),
        F.avg("share_rate").alias("avg_share_rate"))


def segment_labels(summary: DataFrame) -> DataFrame:
    """M6: narrative label per segment, by comparison with the medians over segments (>=)."""
    w = Window.partitionBy(F.lit(0))  # the summary has one row per segment (<= a handful)
    med = lambda c: F.percentile(F.col(c), 0.5).over(w)
    hv = F.col("avg_views") >= med("avg_views")
    he = F.col("avg_engagement_rate_pct") >= med("avg_engagement_rate_pct")
    hs = F.col("avg_share_rate") >= med("avg_share_rate")
    label = (F.when(hv & he, C.SEGMENT_HIGH_REACH_HIGH_ENGAGEMENT).when(~hv & he, C.SEGMENT_NICHE)
             .when(hv & ~he, C.SEGMENT_BROAD_REACH).when(hs, C.SEGMENT_SHARED).otherwise(C.SEGMENT_BALANCED))
    return summary.withColumn("label", label)


# ---------------------------------------------------------------- M2, M5, M7


STARTS = 5
MAX_PASSES = 100
TOLERANCE = 1e-4    # centres have settled when their squared moves add up to no more, in standard deviations
_ROWS_AT_ONCE = 4096
_SEGMENT_COLUMNS = ["video_id", "title", "category", "views", "engagement_rate_pct", "avg_watch_time_seconds",
                    "share_rate"]


def _features(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Standardised features beside the columns that summaries show, written once for all models."""
    keep = [c for c in _SEGMENT_COLUMNS if c in df.columns]
    return (materialize(standardize(df, FEATURE_COLUMNS, keep=keep), "features"),
            [f"z_{c}" for c in FEATURE_COLUMNS])


def _uniform(hashes: np.ndarray, start: int, step: int) -> np.ndarray:
    """A number in (0, 1) per row hash, another one for every start and step (splitmix64)."""
    z = hashes.view("uint64") + np.uint64((start * 1024 + step + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype("float64") / (1 << 53) + 2.0 ** -54


def _matrix(batch: pa.RecordBatch, cols: list[str]) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in cols])


def _seeds(features: DataFrame, zcols: list[str], k: int, starts: int, seed: int) -> list[np.ndarray]:
    """k-means++ over all rows, ``starts`` times: each further centre is a row drawn with a chance in proportion to
    its squared distance to the nearest one.

    The least -ln(u) / distance belongs to every row with just that chance, so one pass draws a centre of every
    start. u is a hash of the id: the draw doesn't depend on partitioning. The first k centres serve a smaller k.
    """
    rows = features.select(F.xxhash64("video_id", F.lit(seed)).alias("_h"), *zcols)
    centres: list[list[list[float]]] = [[] for _ in range(starts)]
    for step in range(k):
        def draw(batches):
            best: list[tuple | None] = [None] * starts
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, hashes = _matrix(batch, zcols), batch.column("_h").to_numpy()
                for s in range(starts):
                    gap = _nearest(x, np.array(centres[s]))[1] if step else np.ones(len(x))
                    with np.errstate(divide="ignore"):
                        key = -np.log(_uniform(hashes, s, step)) / gap
                    least = key.min()
                    if np.isfinite(least):
                        like = x[key == least]      # rows of one id
                        found = (float(least), like[np.lexsort(like.T[::-1])[0]].tolist())
                        best[s] = found if best[s] is None else min(best[s], found)
            yield pa.RecordBatch.from_pylist([{"start": s, "key": b[0], "at": b[1]} for s, b in enumerate(best) if b], pa.schema(
                [("start", pa.int32()), ("key", pa.float64()), ("at", pa.list_(pa.float64()))]))

        found = {r["start"]: list(r["best"]["at"]) for r in rows.mapInArrow(draw, "start int, key double, at array<double>")
                 .groupBy("start").agg(F.min(F.struct("key", "at")).alias("best")).collect()}       # ``starts`` rows
        for s in range(starts):
            centres[s].append(found.get(s) or centres[s][-1])       # all rows coincide with a centre
    return [np.array(c) for c in centres]


def _cluster_pass(features: DataFrame, zcols: list[str], models: list[np.ndarray]) -> list[tuple[np.ndarray, float]]:
    """One pass over all rows: (means of the rows nearest to each centre, inertia) of every model."""
    table, ends = np.concatenate(models), np.cumsum([len(m) for m in models])
    half, d = (table * table).sum(axis=1, keepdims=True) / 2, len(zcols)
    bounds = list(zip([0, *ends[:-1]], ends))

    def measure(batches):
        total = np.zeros((len(table), d + 2))
        for batch in batches:
            whole = _matrix(batch, zcols)
            for i in range(0, len(whole), _ROWS_AT_ONCE):
                x = whole[i:i + _ROWS_AT_ONCE]
                far, own = half - table @ x.T, np.empty((len(table), len(x)))       # half the squares, less the rows' own
                square = (x * x).sum()
                for a, b in bounds:
                    near = far[a:b].min(axis=0)
                    hit = far[a:b] == near
                    if np.count_nonzero(hit) != len(x):         # as near to two centres: the first has it
                        hit = far[a:b].argmin(axis=0) == np.arange(b - a)[:, None]
                    own[a:b] = hit
                    total[a, d + 1] += square + 2 * near.sum()
                total[:, :d + 1] += own @ np.column_stack([x, np.ones(len(x))])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(table)), pa.int32()), *map(pa.array, total.T)],
                                         names=["centre", *(f"s{c}" for c in range(d + 2))])

    sums = [f"s{c}" for c in range(d + 2)]
    found = (features.select(*zcols).mapInArrow(measure, ", ".join(["centre int", *(f"{c} double" for c in sums)]))
             .groupBy("centre").agg(*[F.sum(c).alias(c) for c in sums]).toPandas())         # a row per centre
    total = found.sort_values("centre")[sums].to_numpy()
    n = total[:, d:d + 1]
    means = np.where(n > 0, total[:, :d] / np.maximum(n, 1.0), table)       # a centre without rows stays
    return [(means[a:b], max(float(total[a, d + 1]), 0.0)) for a, b in bounds]


def fit_kmeans(features: DataFrame, zcols: list[str], ks: list[int], seed: int = SEED, starts: int = STARTS) -> dict:
    """M2: k-means over all rows for every k, the best of ``starts`` by inertia.

    Each pass assigns all rows and moves every centre to the mean of its rows, until the centres settle or after
    ``MAX_PASSES``; it serves all k and starts that haven't settled, and returns a row per centre. Returns {k: (centres, inertia)}.
    """
    seeds = _seeds(features, zcols, max(ks), starts, seed)
    models = {(k, s): seeds[s][:k] for k in ks for s in range(starts)}
    inertias: dict[tuple[int, int], float] = {}
    moving = list(models)
    for left in range(MAX_PASSES - 1, -1, -1):
        moved = dict(zip(moving, _cluster_pass(features, zcols, [models[key] for key in moving])))
        inertias |= {key: inertia for key, (_, inertia) in moved.items()}
        moving = [key for key, (means, _) in moved.items() if ((means - models[key]) ** 2).sum() > TOLERANCE]
        if not (moving and left):
            break
        models |= {key: moved[key][0] for key in moving}
    return {k: (models[best], inertias[best]) for k in ks for best in [min(
        ((k, s) for s in range(starts)), key=lambda key: (inertias[key], key))]}


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centre, squared distance to it) of each row."""
    gap = np.stack([((x - c) ** 2).sum(axis=1) for c in centres], axis=1)
    own = gap.argmin(axis=1)
    return own, gap[np.arange(len(x)), own]


def cluster_sweep_runs(df: DataFrame, k_range: list[int] | None = None, metric: str = "squared",
                       sample: int = SILHOUETTE_SAMPLE) -> tuple[list[dict], dict, DataFrame]:
    """Fit k-means for every k (rows > k), measure silhouette and inertia.

    ``metric`` is "squared" (closed form over all rows) or "euclidean" (``sample`` rows against all rows).

    Returns (runs, assignments by k, features). Only per-k scalars and centroids reach the driver. Callers that need several
    results of one sweep pass the returned value on; nothing is kept between calls. All passes over the features serve
    all k: seeds, moves of the centres, assignment (written), cluster sums and silhouettes.
    """
    if metric not in ("squared", "euclidean"):
        raise ValueError("metric must be squared or euclidean")
    feats, zcols = _features(df)
    n = feats.count()
    ks = [k for k in (k_range or CLUSTER_K_RANGE) if n > k]
    if not ks:
        return [], {}, feats
    fitted = fit_kmeans(feats, zcols, ks)

    @F.pandas_udf("array<int>")
    def assign(*series: pd.Series) -> pd.Series:
        x = np.column_stack([s.to_numpy("float64") for s in series])
        return pd.Series(list(np.stack([_nearest(x, fitted[k][0])[0] for k in ks], axis=1).astype("int32")))

    labels = [f"_k{k}" for k in ks]
    assigned = feats.withColumn("_own", assign(*zcols)).withColumns(
        {label: F.col("_own")[i] for i, label in enumerate(labels)}).drop("_own")
    assigned = materialize(assigned, "clusters")
    stats = materialize(_label_stats(assigned, labels, zcols), "cluster-stats")
    score = (_silhouettes(assigned, stats, labels, zcols).first() if metric == "squared"
             else euclidean_silhouettes(assigned, labels, zcols, sample))
    sizes = {(r["label"], r["c"]): r["_n"] for r in stats.select("label", "c", "_n").collect()}   # sum(ks) rows
    runs, assignments = [], {}
    for k, label in zip(ks, labels):
        runs.append({"k": k, "silhouette_score": score[label], "inertia": fitted[k][1],
                     "cluster_sizes": [sizes.get((label, c), 0) for c in range(k)]})
        assignments[k] = assigned.withColumn("cluster_id", F.col(label)).drop(*labels, *zcols)
    return runs, assignments, feats


def cluster_sweep(df: DataFrame) -> DataFrame:
    """M7: one row per k with silhouette, inertia and cluster sizes."""
    runs, _, _ = cluster_sweep_runs(df)
    spark = df.sparkSession
    rows = [(r["k"], None if r["silhouette_score"] is None else round(r["silhouette_score"], 4),
             round(r["inertia"], 2), r["cluster_sizes"]) for r in runs]
    return spark.createDataFrame(rows, "k int, silhouette_score double, inertia double, cluster_sizes array<long>")


def best_clustering(df: DataFrame, sweep: tuple | None = None) -> tuple[int, float, DataFrame]:
    """M5: k with the strictly best silhouette (first wins); too few rows -> one cluster 0.

    The frame has the summary columns beside cluster_id. ``sweep`` is a result
    of ``cluster_sweep_runs`` to share.
    """
    runs, assignments, feats = sweep or cluster_sweep_runs(df)
    best_k, best_score, best = 2, -1.0, None
    for r in runs:
        if r["silhouette_score"] is not None and r["silhouette_score"] > best_score:
            best_k, best_score, best = r["k"], r["silhouette_score"], assignments[r["k"]]
    labelled = best
    if labelled is None:
        labelled = feats.select(*[c for c in _SEGMENT_COLUMNS if c in feats.columns], F.lit(0).alias("cluster_id"))
    # canonical ids: cluster 0 has the highest mean views
    order = (labelled.groupBy("cluster_id").agg(F.avg("views").alias("_mv"))
             .withColumn("_new", (F.row_number().over(Window.orderBy(F.col("_mv").desc(), "cluster_id")) - 1)
                         .cast("int")))
    labelled = (labelled.join(F.broadcast(order.select("cluster_id", "_new")), "cluster_id")
                .drop("cluster_id").withColumnRenamed("_new", "cluster_id"))
    return best_k, best_score, labelled


def clusters(df: DataFrame) -> DataFrame:
    """Summary of the selected clustering with labels, largest first."""
    k, score, labelled = best_clustering(df.drop("title", "category"))     # texts that the summary doesn't show
    summary = segment_labels(segment_summary(labelled, "cluster_id"))
    return summary.select(
        F.lit(k).alias("best_k"), F.lit(round(score, 4)).alias("silhouette_score"), "cluster_id", "videos",
        fixed("avg_views", 4).alias("avg_views"), fixed("avg_engagement_rate_pct", 4).alias("avg_engagement_rate_pct"),
        fixed("avg_watch_time_seconds", 4).alias("avg_watch_time_seconds"),
        fixed("avg_share_rate", 4).alias("avg_share_rate"), "label").orderBy(F.col("videos").desc(), "cluster_id")


def cluster_points(df: DataFrame, n: int = 250) -> DataFrame:
    """The ``n`` most viewed rows with their cluster."""
    _, _, labelled = best_clustering(df)
    return (labelled.orderBy(F.col("views").desc(), "video_id").limit(n)
            .select("video_id", "title", "category", "views", fixed("engagement_rate_pct", 4)
                    .alias("engagement_rate_pct"), "cluster_id"))


# ---------------------------------------------------------------- M8-M10

N_TREES = 100
MAX_SAMPLES = 256
_DRAWN = 400   # rows drawn for a tree, about, of which MAX_SAMPLES are kept


def _c(n: float) -> float:
    """Average path length of an unsuccessful search in a binary search tree of n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def _tree_sample(df: DataFrame, cols: list[str], seed: int) -> DataFrame:
    """Up to 256 rows per tree, chosen by hash so the sample does not depend on partitioning."""
    n = df.count()
    # independent draws per tree: a row survives a tree with a chance that leaves about 400 rows for it
    rate = min(1.0, _DRAWN / max(n, 1))
    unit = lambda t: F.pmod(F.xxhash64("video_id", t, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    trees = F.filter(F.sequence(F.lit(0), F.lit(N_TREES - 1)), lambda t: unit(t) < rate)
    drawn = df.select("video_id", *cols, trees.alias("_trees")).select(
        "video_id", *cols, F.explode("_trees").alias("tree"))
    w = Window.partitionBy("tree").orderBy(F.xxhash64("video_id", F.col("tree"), F.lit(seed)), "video_id")
    return materialize(drawn.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= MAX_SAMPLES).drop("_r"),
                       "forest-sample")


NODE_SCHEMA = T.StructType([
    T.StructField("tree", T.IntegerType()), T.StructField("node", T.IntegerType()),
    T.StructField("feature", T.IntegerType()), T.StructField("split", T.DoubleType()),
    T.StructField("left", T.IntegerType()), T.StructField("right", T.IntegerType()),
    T.StructField("size", T.IntegerType())])


def _build_tree_fn(cols: list[str], seed: int):
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("video_id")
        tree = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng(seed + tree)
        x = pdf[cols].to_numpy(dtype=np.float64)
        limit = int(math.ceil(math.log2(max(len(x), 2))))
        nodes = []

        def grow(idx, depth):
            me = len(nodes)
            nodes.append([tree, me, -1, 0.0, -1, -1, len(idx)])
            if depth >= limit or len(idx) <= 1:
                return me
            sub = x[idx]
            spans = sub.max(axis=0) - sub.min(axis=0)
            usable = np.flatnonzero(spans > 0)
            if len(usable) == 0:
                return me
            f = int(rng.choice(usable))
            lo, hi = sub[:, f].min(), sub[:, f].max()
            split = float(rng.uniform(lo, hi))
            left = idx[sub[:, f] < split]
            right = idx[sub[:, f] >= split]
            nodes[me][2], nodes[me][3] = f, split
            nodes[me][4] = grow(left, depth + 1)
            nodes[me][5] = grow(right, depth + 1)
            return me

        grow(np.arange(len(x)), 0)
        return pd.DataFrame(nodes, columns=[f.name for f in NODE_SCHEMA.fields])

    return build


def anomaly_scores(df: DataFrame, cols: list[str] | None = None, seed: int = SEED) -> DataFrame:
    """M8: isolation-forest score in (0, 1] per row (higher = stranger), column ``anomaly_score``."""
    cols = cols or FEATURE_COLUMNS
    sample = _tree_sample(df, cols, seed)
    psi = min(MAX_SAMPLES, max(1, sample.groupBy("tree").count().agg(F.max("count")).first()[0] or 1))
    nodes = sample.groupBy("tree").applyInPandas(_build_tree_fn(cols, seed), NODE_SCHEMA).toPandas()
    # bounded: <= 100 trees x 511 nodes, independent of the data size
    trees = []
    for _, t in nodes.sort_values(["tree", "node"]).groupby("tree"):
        arr = t[["feature", "split", "left", "right", "size"]].to_numpy(dtype=np.float64)
        # column 5: expected remaining path length at each node, c(size), precomputed once
        trees.append(np.column_stack([arr, [_c(v) for v in arr[:, 4]]]))
    bc = df.sparkSession.sparkContext.broadcast(trees)
    c_psi = _c(psi)

    @F.pandas_udf(T.DoubleType())
    def score(*series: pd.Series) -> pd.Series:
        x = np.column_stack([s.to_numpy(dtype=np.float64) for s in series])
        total = np.zeros(len(x))
        for arr in bc.value:
            node = np.zeros(len(x), dtype=np.int64)
            depth = np.zeros(len(x))
            active = arr[node, 0] >= 0
            while active.any():
                f = arr[node, 0].astype(np.int64)
                go_left = x[np.arange(len(x)), np.maximum(f, 0)] < arr[node, 1]
                nxt = np.where(go_left, arr[node, 2], arr[node, 3]).astype(np.int64)
                node = np.where(active, nxt, node)
                depth = depth + active
                active = arr[node, 0] >= 0
            total += depth + arr[node, 5]
        mean_h = total / len(bc.value)
        return pd.Series(np.power(2.0, -mean_h / c_psi) if c_psi > 0 else np.full(len(x), 0.5))

    return df.withColumn("anomaly_score", score(*[F.col(c).cast("double") for c in cols]))


def anomalies(df: DataFrame, contamination: float = DEFAULT_CONTAMINATION, top: int = 30) -> DataFrame:
    """M9/T4: rows whose score is above the (1 - contamination) percentile, highest first."""
    if not 0.0 < contamination < 0.5:
        raise ValueError("contamination must be in (0, 0.5)")
    shown = ["video_id", "title", "category", "thumbnail_style", "publish_date", "views", "engagement_rate_pct",
             "avg_watch_time_seconds", "anomaly_score"]
    scored = materialize(anomaly_scores(df).select(*shown), "anomaly-scores")
    thr = exact_quantiles(scored, "anomaly_score", [1.0 - contamination], prefix="thr").withColumn("_k", F.lit(0))
    flagged = (scored.withColumn("_k", F.lit(0)).join(F.broadcast(thr), "_k")
               .where(F.col("anomaly_score") > F.col("thr0")))
    found = flagged.agg(F.count(F.lit(1)).alias("anomalies_found")).withColumn("_k", F.lit(0))   # one row
    best = flagged.orderBy(F.col("anomaly_score").desc(), "video_id").limit(top)
    return (best.join(F.broadcast(found), "_k").orderBy(F.col("anomaly_score").desc(), "video_id")
            .select("video_id", "title", "category", "thumbnail_style", "publish_date", "views",
                    fixed("engagement_rate_pct", 4).alias("engagement_rate_pct"),
                    fixed("avg_watch_time_seconds", 4).alias("avg_watch_time_seconds"),
                    fixed("anomaly_score", 4).alias("anomaly_score"), "anomalies_found"))


def anomaly_sweep(df: DataFrame, rates: list[float] | None = None) -> DataFrame:
    """One forest, every contamination rate's threshold, counts and mean scores in one pass."""
    rates = rates or CONTAMINATION_SWEEP
    scored = materialize(anomaly_scores(df).select("anomaly_score"), "anomaly-scores")
    thr = exact_quantiles(scored, "anomaly_score", [1.0 - r for r in rates], prefix="t").withColumn("_k", F.lit(0))
    j = scored.withColumn("_k", F.lit(0)).join(F.broadcast(thr), "_k")
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, _ in enumerate(rates):
        hit = F.col("anomaly_score") > F.col(f"t{i}")
        aggs += [F.count_if(hit).alias(f"_c{i}"),
                 F.avg(F.when(hit, F.col("anomaly_score"))).alias(f"_a{i}"),
                 F.avg(F.when(~hit, F.col("anomaly_score"))).alias(f"_o{i}")]
    one = j.agg(*aggs)
    return one.select(F.explode(F.array(*[F.struct(
        F.lit(r).alias("contamination"), F.col(f"_c{i}").alias("anomalies_found"),
        fixed(F.col(f"_c{i}") / F.col("_n") * 100, 2).alias("pct_flagged"),
        F.coalesce(fixed(F.col(f"_a{i}"), 4), F.lit(0.0)).alias("mean_anomaly_score"),
        fixed(F.col(f"_o{i}"), 4).alias("mean_normal_score")) for i, r in enumerate(rates)])).alias("r")
    ).select("r.*")


def percentile_flag(df: DataFrame, col: str = "views", contamination: float = 0.04) -> DataFrame:
    """M9 rule on a plain column: rows strictly above the (1 - c) percentile."""
    thr = exact_quantiles(df, col, [1.0 - contamination], prefix="thr").withColumn("_k", F.lit(0))
    j = df.withColumn("_k", F.lit(0)).join(F.broadcast(thr), "_k")
    return j.agg(F.count_if(F.col(col) > F.col("thr0")).alias("flagged"), F.count(F.lit(1)).alias("rows"),
                 fixed(F.first("thr0"), 4).alias("threshold"))


# ---------------------------------------------------------------- M12

def r2_group_mean(df: DataFrame, key: str = "category") -> DataFrame:
    """M12 with the group mean as predictor: in-sample R^2 of log1p(views); null for a constant target.

    One aggregate: a group's squared error is its sum of squares less n times its squared mean, so no group table is
    joined back to the rows. The target is shifted by a constant near its mean against cancellation.
    """
    shifted = df.select(key, (F.log1p("views") - F.lit(4.0)).alias("y"))
    groups = shifted.groupBy(key).agg(F.count("y").alias("_n"), F.sum("y").alias("_s"),
                                      F.sum(F.col("y") * F.col("y")).alias("_q"))
    total_q, total_s, total_n = F.sum("_q"), F.sum("_s"), F.sum("_n")
    within = total_q - F.sum(F.col("_s") * F.col("_s") / F.col("_n"))
    spread = total_q - total_s * total_s / total_n
    # what rounding leaves of a constant target is no spread
    return groups.where(F.col("_n") > 0).agg(
        F.when(spread > 1e-12 * total_q, 1 - F.try_divide(within, spread)).alias("_r2")).select(fixed("_r2", 6).alias("r2"))
