import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from viewscope.operators import enrich as E


def frame(spark, dates, views, ids=None):
    ids = ids or list(range(1, len(dates) + 1))
    pdf = pd.DataFrame({"video_id": ids, "publish_date": [dt.date.fromisoformat(d) for d in dates],
                        "views": views, "engagement_rate_pct": [float(v) for v in views]})
    return spark.createDataFrame(pdf).withColumn("publish_date", F.to_date("publish_date"))


def test_rolling_sums_ties_counted_up_to_current_row(spark):
    dates = ["2024-01-01", "2024-01-01", "2024-01-02", "2024-01-08", "2024-01-08", "2024-01-09"]
    views = [1, 2, 4, 8, 16, 32]
    out = E.rolling_means(frame(spark, dates, views), {"r": ("views", 7)}, partitions=3).orderBy("video_id")
    means = [r.r for r in out.collect()]
    counts = [1, 2, 3, 2, 3, 3]
    sums = [m * c for m, c in zip(means, counts)]
    assert np.allclose(sums, [1, 3, 7, 12, 28, 56])


def test_rolling_matches_brute_force_across_partitions(spark):
    rng = np.random.default_rng(0)
    n = 600
    days = rng.integers(0, 40, n)
    days[:250] = 7                       # one hot day spanning several partitions
    dates = [str(dt.date(2024, 1, 1) + dt.timedelta(days=int(d))) for d in days]
    views = rng.integers(1, 100, n).tolist()
    ids = rng.permutation(n).tolist()
    df = frame(spark, dates, views, ids)
    out = E.rolling_means(df, {"r": ("views", 7)}, partitions=8).toPandas().set_index("video_id")
    d = np.array([np.datetime64(x) for x in dates]).astype("datetime64[D]").astype(int)
    ids_a, v = np.array(ids), np.array(views, float)
    for i in range(0, n, 7):
        m = ((d >= d[i] - 6) & (d < d[i])) | ((d == d[i]) & (ids_a <= ids_a[i]))
        assert abs(out.loc[ids[i], "r"] - v[m].mean()) < 1e-9


def test_same_day_divides_by_one(spark):
    df = frame(spark, ["2024-03-01"] * 3, [3, 6, 9])
    out = E.add_recency(df, dt.date(2024, 3, 1)).collect()
    assert {r.days_since_publish for r in out} == {0}
    assert sorted(r.views_per_day for r in out) == [3.0, 6.0, 9.0]


def test_word_count(spark):
    df = spark.createDataFrame([("  a  b ",), ("",), (None,), ("one",)], "title string")
    assert [r[0] for r in df.select(E.word_count("title")).collect()] == [2, 0, 0, 1]


def test_calendar(spark):
    df = frame(spark, ["2024-01-01"], [1])
    r = E.add_calendar(df.withColumn("title", F.lit("x"))).first()
    assert (r.publish_month, r.publish_weekday) == ("2024-01", "Monday")


def test_rolling_with_time_of_day_matches_pandas(spark):
    rng = np.random.default_rng(7)
    n = 400
    base = np.datetime64("2024-01-01T00:00:00")
    secs = rng.integers(0, 40 * 86400, n)
    secs[:60] = secs[0]                     # a block of identical timestamps
    ts = base + secs.astype("timedelta64[s]")
    ids = rng.permutation(n) + 1
    views = rng.integers(1, 100, n)
    pdf = pd.DataFrame({"video_id": ids, "publish_date": ts, "views": views,
                        "engagement_rate_pct": views * 0.5})
    df = spark.createDataFrame(pdf).withColumn("publish_date", F.col("publish_date").cast("timestamp_ntz"))
    out = E.rolling_means(df, {"r7": ("views", 7), "r30": ("engagement_rate_pct", 30)}, partitions=6)
    got = out.toPandas().set_index("video_id")
    ref = pdf.sort_values(["publish_date", "video_id"]).set_index("publish_date")
    r7 = ref["views"].rolling("7D", min_periods=1).mean().to_numpy()
    r30 = ref["engagement_rate_pct"].rolling("30D", min_periods=1).mean().to_numpy()
    order = ref["video_id"].to_numpy()
    assert np.allclose(got.loc[order, "r7"].to_numpy(), r7, rtol=0, atol=1e-9)
    assert np.allclose(got.loc[order, "r30"].to_numpy(), r30, rtol=0, atol=1e-9)


def test_days_since_publish_with_times(spark):
    pdf = pd.DataFrame({"video_id": [1, 2], "views": [5, 5],
                        "publish_date": pd.to_datetime(["2024-01-01 23:00", "2024-01-03 01:00"])})
    df = spark.createDataFrame(pdf).withColumn("publish_date", F.col("publish_date").cast("timestamp_ntz"))
    out = E.add_recency(df, dt.datetime(2024, 1, 3, 1, 0)).orderBy("video_id").collect()
    assert [r.days_since_publish for r in out] == [1, 0]


def _peer_means(t, v, days):
    """Mean over all rows with time in (t - days, t], by brute force."""
    span = np.timedelta64(days, "D")
    return np.array([v[(t > x - span) & (t <= x)].mean() for x in t])


def test_peers_share_the_mean_of_their_date(spark):
    rng = np.random.default_rng(6)
    days = np.where(rng.random(400) < 0.4, 9, rng.integers(0, 30, 400))      # a hot day
    dates = np.array([np.datetime64("2024-01-01") + int(d) for d in days])
    views = rng.integers(1, 100, 400)
    df = frame(spark, [str(d) for d in dates], views.tolist())
    out = E.rolling_means(df, {"r": ("views", 7)}, partitions=6, ties="peers").toPandas().set_index("video_id").sort_index()
    assert np.allclose(out["r"], _peer_means(dates, views.astype(float), 7))


@pytest.mark.parametrize("ties", ["peers", "position"])
def test_timed_rows_with_a_hot_instant(spark, ties):
    rng = np.random.default_rng(7)
    n = 900
    hours = np.where(rng.random(n) < 0.4, 100, rng.integers(0, 24 * 12, n))
    times = np.array([np.datetime64("2024-01-01T00:00:00") + np.timedelta64(int(h), "h") for h in hours])
    views, ids = rng.integers(1, 100, n).astype(float), rng.permutation(n)
    pdf = pd.DataFrame({"video_id": ids, "publish_date": times, "views": views})
    df = spark.createDataFrame(pdf).withColumn("publish_date", F.col("publish_date").cast("timestamp_ntz"))
    keep = []
    out = E.rolling_means(df, {"r": ("views", 3)}, partitions=7, ties=ties, keep=keep).toPandas().set_index("video_id")
    got = out.loc[ids, "r"].to_numpy()
    if ties == "peers":
        want = _peer_means(times, views, 3)
    else:
        span = np.timedelta64(3, "D")
        want = [views[(times > t - span) & ((times < t) | (times == t) & (ids <= i))].mean() for t, i in zip(times, ids)]
    assert np.allclose(got, want)
    # the written intermediates can be released once the result is read
    from viewscope.session import release
    import os
    folders = [k.removeprefix("file:") for k in keep]
    assert folders and all(os.path.isdir(f) for f in folders)
    release(spark, keep)
    assert not any(os.path.exists(f) for f in folders)


def test_ties_option_is_checked_and_empty_tables_stay_empty(spark):
    df = frame(spark, ["2024-01-01"], [1])
    with pytest.raises(ValueError):
        E.rolling_means(df, {"r": ("views", 7)}, ties="none")
    for ties in ("peers", "position"):
        assert E.rolling_means(df.limit(0), {"r": ("views", 7)}, ties=ties).count() == 0
        timed = df.withColumn("publish_date", F.col("publish_date").cast("timestamp_ntz"))
        assert E.rolling_means(timed.limit(0), {"r": ("views", 7)}, ties=ties).count() == 0


def test_join_counted_and_numbers(spark):
    from viewscope.functions.distribute import join_counted, numbered

    rows = [(i, "hot" if i % 3 == 0 else None if i % 7 == 0 else f"k{i % 500}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, k string").repartition(5)
    per_key = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    out = join_counted(df, per_key, ["k"], "n", 3000)
    first = {}
    for i, k in sorted(rows):
        first.setdefault(k, i)
    assert sorted(map(tuple, out.select("id", "first").collect())) == [(i, first[k]) for i, k in sorted(rows)]
    n = numbered(df, "number").collect()
    assert sorted(r.number for r in n) == list(range(3000)) and len({r.id for r in n}) == 3000
    assert numbered(df.limit(0), "number").count() == 0
