import numpy as np
import pytest
from pyspark.sql import functions as F

from viewscope.operators import abtest as AB
from viewscope.operators import filters as FL
from viewscope.operators import models as M
from viewscope.operators import summary as S
from viewscope.operators import text as X
from viewscope.schema import Filters


def test_category_all_and_empty_slice(content_small):
    n = content_small.count()
    assert FL.filter_content(content_small, Filters(category="ALL")).count() == n
    empty = FL.filter_content(content_small, Filters(category="no-such"))
    assert empty.count() == 0
    assert S.by_category(empty).count() == 0


def test_end_date_is_midnight_inclusive(content_small):
    day = content_small.agg(F.min("publish_date")).first()[0]
    got = FL.filter_content(content_small, Filters(start_date=str(day), end_date=str(day)))
    assert got.count() == content_small.where(F.col("publish_date") == day).count()


def test_top_videos_limit_and_order(content_small):
    rows = S.top_videos(content_small, 5).collect()
    assert len(rows) == 5
    assert [r.views for r in rows] == sorted([r.views for r in rows], reverse=True)
    with pytest.raises(ValueError):
        S.top_videos(content_small, 0)


def test_recommendations_title_case(spark):
    df = spark.createDataFrame([("sci-fi",)], "c string")
    assert df.select(S._title_case_expr(F.col("c"))).first()[0] == "Sci-Fi"


def test_tokens_fixture(spark):
    from viewscope.functions.textfn import with_terms
    df = spark.createDataFrame([("Top10 Café The BIG-game a II don't 3x über",)], "t string")
    assert with_terms(df, "t", "x").first().x == ["big", "game", "ii", "big game", "game ii"]


def test_tfidf_unit_norm_and_similar_titles(spark):
    rows = [(1, "red gear hot gear", "c", "s", 10, 1.0), (2, "red gear", "c", "s", 5, 1.0),
            (3, "blue bolt", "c", "s", 7, 1.0), (4, "hot gear", "c", "s", 3, 1.0)]
    df = spark.createDataFrame(rows, "video_id long, title string, category string, thumbnail_style string, "
                                     "views long, engagement_rate_pct double")
    post = X.tfidf(df).toPandas()
    norms = post.assign(w2=post.weight ** 2).groupby("video_id").w2.sum()
    assert np.allclose(norms.values, 1.0)
    sim = X.similar_titles(df, 1, 3).collect()
    assert [r.video_id for r in sim][:2] in ([2, 4], [4, 2]) and sim[2].video_id == 3
    assert sim[2].similarity == 0.0
    with pytest.raises(KeyError):
        X.similar_titles(df, 999999, 3)


def test_ab_small_group_error_and_bad_params(content_small):
    one = content_small.limit(3)
    r = AB.ab_test_title(one, "zzzz-none", "qqqq-none", "views", with_p=False).first()
    assert r.error == "Each keyword group needs at least 2 matching videos."
    with pytest.raises(ValueError):
        AB.ab_test_attribute(content_small, "bogus", "a", "b", "views")
    with pytest.raises(ValueError):
        AB.ab_test_attribute(content_small, "category", "a", "b", "bogus")


def test_ab_full_has_p_and_ci(content_small):
    r = AB.ab_test_attribute(content_small, "category", "1-URGENT", "5-LOW", "views").first()
    assert 0 <= r.p_value <= 1 and r.ci_95_lower <= r.ci_95_upper
    assert r.method.startswith("Welch")


def test_constant_feature_standardises_to_zero(spark):
    df = spark.createDataFrame([(i, float(i), 5.0) for i in range(10)], "video_id long, a double, b double")
    z = M.standardize(df, ["a", "b"]).collect()
    assert all(r.z_b == 0.0 for r in z)


def test_planted_outlier_ranks_first(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 2))
    x[123] = [40.0, -40.0]
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)],
                               "video_id long, a double, b double")
    scored = M.anomaly_scores(df, ["a", "b"]).orderBy(F.col("anomaly_score").desc()).collect()
    assert scored[0].video_id == 123
    again = M.anomaly_scores(df.repartition(7), ["a", "b"]).where("video_id = 123").first().anomaly_score
    assert again == pytest.approx(scored[0].anomaly_score)


def test_token_lift_of_whole_documents_equals_brute_force(spark):
    """Whole documents, Unicode words, a term in every text (a hot key of the weight join)."""
    import math
    import re
    from collections import Counter

    from viewscope.functions.textfn import english_stop_words
    from viewscope.sources.tables import documents_as_content

    docs = documents_as_content(spark, "/root/testdata/sf0.001").withColumn("title", F.concat(F.lit("common "), "title"))
    rows = docs.select("video_id", "title", "views").collect()
    stops, tf = set(english_stop_words()), {}
    for r in rows:
        words = [w for w in re.findall(r"\b[a-zA-Z][a-zA-Z]+\b", r.title.lower()) if w not in stops]
        tf[r.video_id] = Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])])
    df = Counter(t for c in tf.values() for t in c)
    weight = {}
    for i, c in tf.items():
        w = {t: n * (math.log((1 + len(rows)) / (1 + df[t])) + 1) for t, n in c.items()}
        norm = math.sqrt(sum(x * x for x in w.values())) or 1.0
        weight[i] = {t: x / norm for t, x in w.items()}
    cut = np.quantile([r.views for r in rows], 0.75)
    high = {r.video_id for r in rows if r.views >= cut}
    lift = Counter()
    for i, w in weight.items():
        for t, x in w.items():
            lift[t] += x / len(high) if i in high else -x / (len(rows) - len(high))
    got = {r.term: r.lift for r in X.token_lift(docs, "views", 12).collect()}
    want = sorted(lift.items(), key=lambda p: (-round(p[1], 10), p[0]))[:12]
    assert len(got) == len([v for _, v in want if v > 0])
    assert all(abs(got[t] - v) < 6e-5 for t, v in want if v > 0)


def test_report_of_similar_titles_has_its_anchor(content_small):
    r = X.similar_report(content_small, 1, 3).orderBy("rank").collect()
    assert [x.rank for x in r] == [0, 1, 2, 3] and r[0].video_id == 1 and r[0].similarity is None
    assert all(x.video_id != 1 and x.similarity is not None for x in r[1:])


def test_csv_export_is_written_and_read_back(spark, tmp_path, content_small):
    from viewscope.plans.report import csv_export, read_csv_export, write_csv_export
    from viewscope.schema import EXPORT_COLUMNS

    slice_ = Filters(category="1-URGENT")
    write_csv_export(content_small, str(tmp_path / "out"), slice_)
    back = read_csv_export(spark, str(tmp_path / "out"))
    assert back.columns == EXPORT_COLUMNS
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, csv_export(content_small, slice_).collect()))
    write_csv_export(content_small, str(tmp_path / "none"), Filters(category="no-such"))
    assert read_csv_export(spark, str(tmp_path / "none")).count() == 0


def test_empty_slice_is_reported_first(content_small):
    none = FL.filter_content(content_small, Filters(category="no-such"))
    r = AB.ab_test_attribute(none, "category", "a", "b", "views").first()
    assert r.error == AB.NO_ROWS and r.n_a == 0
    assert S.kpi_totals(none).first().videos == 0
    assert X.token_lift(none, "views", 5).count() == 0
