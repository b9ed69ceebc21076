"""Metadata signal against NumPy, k-means, forest sweep, report with models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from viewscope.operators import models as M
from viewscope.operators import signal as SG
from viewscope.schema import FEATURE_COLUMNS, SEED

META = "video_id long, category string, thumbnail_style string, publish_month string, views long"


def meta_rows(n, n_categories, seed=0):
    rng = np.random.default_rng(seed)
    cat = np.where(rng.random(n) < 0.3, 0, rng.integers(0, n_categories, n))        # a hot category
    style, month = rng.integers(0, 4, n), rng.integers(1, 13, n)
    views = np.exp(rng.normal(3 + 0.5 * (cat % 5) - 0.3 * style, 1.0)).astype(int) + 1
    return [(i, f"c{c}", f"s{s}", f"2024-{m:02d}", int(v)) for i, (c, s, m, v) in enumerate(zip(cat, style, month, views))]


def folds_of(df, folds):
    rows = df.select("video_id", F.pmod(F.xxhash64("video_id", F.lit(SEED)), F.lit(folds)).alias("f")).collect()
    return np.array([r.f for r in sorted(rows)])


def numpy_ridge(x, y, alpha):
    xm, ym = x.mean(axis=0), y.mean()
    w = np.linalg.solve((x - xm).T @ (x - xm) + alpha * np.eye(x.shape[1]), (x - xm).T @ (y - ym))
    return w, ym - xm @ w


@pytest.mark.parametrize("alpha", [1.0, 25.0])
def test_signal_equals_numpy_ridge(spark, alpha):
    rows = meta_rows(700, 12)
    df = spark.createDataFrame(rows, META).repartition(5)
    names = [sorted({r[i] for r in rows}) for i in (1, 2, 3)]
    x = np.hstack([np.array([[r[i] == v for v in names[i - 1]] for r in rows], float) for i in (1, 2, 3)])
    y, fold = np.log1p([r[4] for r in rows]), folds_of(df, 5)
    guess = np.empty(len(y))
    for k in range(5):
        w, b = numpy_ridge(x[fold != k], y[fold != k], alpha)
        guess[fold == k] = x[fold == k] @ w + b
    r2 = 1 - ((y - guess) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    score, top = SG.metadata_signal(df, alpha)
    assert score.first().cross_validated_r2 == pytest.approx(r2, abs=6e-5)
    w, _ = numpy_ridge(x, y, alpha)
    labels = [f"{c}_{v}" for c, vs in zip(SG.META_COLUMNS, names) for v in vs]
    want = sorted(zip(labels, w), key=lambda t: -abs(t[1]))[:10]
    got = [(r.feature, r.coefficient) for r in top.collect()]
    assert [f for f, _ in got] == [f for f, _ in want]
    assert np.allclose([c for _, c in got], [c for _, c in want], atol=6e-5)


def test_signal_of_ten_thousand_values_is_optimal(spark):
    """No dense matrix: the gradient of the ridge loss vanishes at the found coefficients."""
    rows = meta_rows(30_000, 10_500, seed=1)
    df = spark.createDataFrame(rows, META)
    cells, vocabulary = SG.signal_cells(df, SG.META_COLUMNS, 5)
    n = vocabulary.count()
    assert n > 9_000
    normal = SG._Normal(cells, 3, n, 5, 1.0)
    w = normal.solve()
    number = {(r.column, r.value): r.feature for r in vocabulary.collect()}
    ids = np.array([[number[i, r[i + 1]] for i in range(3)] for r in rows])
    y, fold = np.log1p([r[4] for r in rows]), folds_of(df, 5)
    assert sorted(number.values()) == list(range(n))
    for m in (0, 5):
        use = fold != m
        fit = w[ids, m].sum(axis=1)
        b = (y - fit)[use].mean()
        rest = np.where(use, y - fit - b, 0.0)
        gradient = sum(np.bincount(ids[:, c], rest, n) for c in range(3)) - w[:, m]
        assert np.abs(gradient).max() < 1e-6
    score, top = SG.metadata_signal(df)
    assert score.first().cross_validated_r2 < 1 and top.count() == 10


def test_signal_of_few_null_constant_and_no_rows(spark):
    few = spark.createDataFrame([(1, "a", None, "2024-01", 5), (2, "a", "s", "2024-01", 9)], META)
    score, top = SG.metadata_signal(few)
    assert score.first().cross_validated_r2 is None
    assert {r.feature for r in top.collect()} == {"category_a", "thumbnail_style_null", "thumbnail_style_s", "publish_month_2024-01"}
    constant = spark.createDataFrame([(i, f"c{i % 3}", "s", "m", 7) for i in range(40)], META)
    score, top = SG.metadata_signal(constant)
    assert score.first().cross_validated_r2 is None and all(r.coefficient == 0 for r in top.collect())
    score, top = SG.metadata_signal(few.limit(0))
    assert score.first().cross_validated_r2 is None and top.count() == 0
    with pytest.raises(ValueError):
        SG.metadata_signal(few, alpha=0)


def blob_frame(spark, per=60, seed=3):
    rng = np.random.default_rng(seed)
    centres = np.array([[0, 0, 0, 0, 0, 0], [8, 0, 4, 0, 3, 0], [0, 9, 0, 5, 0, 6]], float)
    rows, i = [], 0
    for c in centres:
        for p in rng.normal(c, 0.5, size=(per, 6)):
            rows.append((i, f"t{i}", "c", *[float(v) for v in p], float(p[1] * 100)))
            i += 1
    cols = ", ".join(f"{c} double" for c in FEATURE_COLUMNS)
    return spark.createDataFrame(rows, f"video_id long, title string, category string, {cols}, engagement_rate_pct double")


def test_blobs_give_three_clusters(spark):
    df = blob_frame(spark)
    k, score, labelled = M.best_clustering(df)
    assert k == 3 and score > 0.8
    of = {r.video_id: r.cluster_id for r in labelled.collect()}
    assert all(len({of[i] for i in range(60 * b, 60 * b + 60)}) == 1 for b in range(3)) and len(set(of.values())) == 3
    summary = M.clusters(df).collect()
    assert [r.videos for r in summary] == [60, 60, 60] and all(r.best_k == 3 for r in summary)


def test_best_of_five_starts_by_inertia_of_all_rows(spark):
    df = blob_frame(spark, per=300, seed=9)
    feats, zcols = M._features(df)
    x = feats.select(*zcols).toPandas().to_numpy()
    five, one = M.fit_kmeans(feats, zcols, [3, 5]), M.fit_kmeans(feats, zcols, [3, 5], starts=1)
    for k in (3, 5):
        centres, inertia = five[k]
        assert inertia == pytest.approx(((x[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1).sum())
        assert inertia <= one[k][1] * (1 + 1e-12)       # start 0 is among the five
    again = M.fit_kmeans(feats.repartition(7), zcols, [3])
    assert np.allclose(again[3][0], five[3][0])


def test_centres_are_means_of_all_rows(spark):
    """Every row moves its centre, and a single row far from 3,000 others, some of one id, gets one."""
    feats, zcols = M._features(blob_frame(spark, per=300, seed=9))
    x = feats.select(*zcols).toPandas().to_numpy()
    centres, _ = M.fit_kmeans(feats, zcols, [3])[3]
    own = M._nearest(x, centres)[0]
    assert np.allclose(centres, [x[own == c].mean(axis=0) for c in range(3)], atol=1e-9)
    far = spark.range(3001).select(F.when(F.col("id") % 7 > 0, F.col("id")).alias("video_id"), *[
        F.when(F.col("id") == 1234, 1e4).otherwise(F.sin(F.col("id") * (i + 1))).alias(c) for i, c in enumerate(zcols)])
    for rows in (far, far.repartition(5)):
        centres, inertia = M.fit_kmeans(rows, zcols, [2, 3])[2]
        assert sorted(centres[:, 0].round()) == [0, 10_000] and inertia < 3000 * 6


def test_sweep_sizes_and_too_few_rows(spark):
    sweep = {r.k: r for r in M.cluster_sweep(blob_frame(spark)).collect()}
    assert sorted(sweep) == [2, 3, 4, 5, 6] and sorted(sweep[3].cluster_sizes) == [60, 60, 60]
    assert all(sum(r.cluster_sizes) == 180 and len(r.cluster_sizes) == k for k, r in sweep.items())
    two = blob_frame(spark, per=1).limit(2)
    assert M.cluster_sweep(two).count() == 0
    k, score, labelled = M.best_clustering(two)
    assert (k, score) == (2, -1.0) and [r.cluster_id for r in labelled.collect()] == [0, 0]
    same = spark.createDataFrame([(i, "t", "c", *[1.0] * 6, 1.0) for i in range(20)], blob_frame(spark, per=1).schema)
    assert M.best_clustering(same)[0] == 2


def test_silhouette_of_label_columns_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    x, a, b = rng.normal(size=(60, 2)), rng.integers(0, 3, 60), np.r_[0, rng.integers(1, 4, 59)]
    df = spark.createDataFrame([(float(p), float(q), int(i), int(j)) for (p, q), i, j in zip(x, a, b)],
                               "p double, q double, a int, b int")
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)

    def brute(label):
        out = []
        for i in range(60):
            own = label == label[i]
            if own.sum() == 1:
                out.append(0.0)
                continue
            near = min(d[i, label == c].mean() for c in set(label) if c != label[i])
            mine = d[i, own].sum() / (own.sum() - 1)
            out.append((near - mine) / max(near, mine))
        return np.mean(out)

    stats = M._label_stats(df, ["a", "b"], ["p", "q"])
    got = M._silhouettes(df, stats, ["a", "b"], ["p", "q"]).first()
    assert np.allclose([got.a, got.b], [brute(a), brute(b)])
    assert M.silhouette(df, "a", ["p", "q"]).first().silhouette == pytest.approx(brute(a))


def test_euclidean_silhouette_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    x, a, b = rng.normal(size=(90, 2)), rng.integers(0, 3, 90), np.r_[5, rng.integers(1, 4, 89)]
    x[40:45] = x[40]
    df = spark.createDataFrame([(k, float(p), float(q), int(i), int(j)) for k, ((p, q), i, j) in enumerate(zip(x, a, b))],
                               "video_id long, p double, q double, a int, b int").repartition(4)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))

    def brute(label, rows):
        out = []
        for i in rows:
            own = label == label[i]
            near = min(d[i, label == c].mean() for c in set(label) if c != label[i])
            mine = d[i, own].sum() / max(own.sum() - 1, 1)
            out.append(0.0 if own.sum() == 1 else (near - mine) / max(near, mine))
        return np.mean(out)

    got = M.euclidean_silhouettes(df, ["a", "b"], ["p", "q"])
    assert got["a"] == pytest.approx(brute(a, range(90))) and got["b"] == pytest.approx(brute(b, range(90)))
    drawn = [r.video_id for r in df.orderBy(F.xxhash64("video_id", F.lit(SEED))).limit(20).collect()]
    assert M.euclidean_silhouettes(df, ["a"], ["p", "q"], sample=20)["a"] == pytest.approx(brute(a, drawn))
    assert M.euclidean_silhouettes(df.limit(0), ["a"], ["p", "q"]) == {"a": None}
    blobs = M.cluster_sweep_runs(blob_frame(spark), [2, 3, 4], metric="euclidean")[0]
    assert max(blobs, key=lambda r: r["silhouette_score"])["k"] == 3
    with pytest.raises(ValueError):
        M.cluster_sweep_runs(df, metric="cosine")


def test_anomalies_and_sweep(content_small):
    n = content_small.count()
    flagged = M.anomalies(content_small, 0.04, top=30).collect()
    assert len(flagged) == 30 and abs(flagged[0].anomalies_found - 0.04 * n) <= 0.01 * n + 1
    scores = [r.anomaly_score for r in flagged]
    assert scores == sorted(scores, reverse=True) and 0 < scores[-1] <= scores[0] <= 1
    sweep = M.anomaly_sweep(content_small).collect()
    assert [r.contamination for r in sweep] == [0.02, 0.04, 0.06, 0.08, 0.1]
    found = [r.anomalies_found for r in sweep]
    assert found == sorted(found) and sweep[1].anomalies_found == flagged[0].anomalies_found
    assert all(r.mean_anomaly_score > r.mean_normal_score for r in sweep)
    with pytest.raises(ValueError):
        M.anomalies(content_small, 0.5)


def test_r2_group_mean_equals_numpy(spark):
    rows = meta_rows(300, 5)
    y, c = np.log1p([r[4] for r in rows]), np.array([r[1] for r in rows])
    means = {v: y[c == v].mean() for v in set(c)}
    r2 = 1 - ((y - [means[v] for v in c]) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    df = spark.createDataFrame(rows, META)
    assert M.r2_group_mean(df).first().r2 == pytest.approx(r2, abs=1e-6)
    assert M.r2_group_mean(df.withColumn("views", F.lit(3))).first().r2 is None


def test_report_with_models(spark, tmp_path, content_small):
    from viewscope.plans.report import write_report
    from viewscope.schema import Filters

    pages = write_report(content_small, str(tmp_path / "report"), Filters(category="1-URGENT"))
    assert len(pages) == 12
    read = {p: spark.read.parquet(str(tmp_path / "report" / p)) for p in pages}
    n = content_small.where("category = '1-URGENT'").count()
    assert read["title"].first().videos == n
    assert sum(r.videos for r in read["clusters"].collect()) == n
    assert 0 < read["anomalies"].count() <= 15 and read["top_videos"].count() == 10
