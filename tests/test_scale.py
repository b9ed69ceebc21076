"""What a step moves and how much of it one task holds, on a few rows."""

from __future__ import annotations

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from viewscope import session
from viewscope.operators import enrich as E
from viewscope.operators import models as M
from viewscope.operators import quality as Q
from viewscope.operators import text as X
from viewscope.plans import catalog
from viewscope.schema import ROLLING_WINDOWS
from viewscope.sources import tables

ORDERS = 40


@pytest.fixture
def star(spark, tmp_path):
    """Small star-schema tables: each order has two line items."""
    day = dt.datetime(2020, 1, 1)
    rows = {
        "lineitem": ([(i // 2, i % 3, i, i % 2 + 1, 6.0 + i % 4, 10.0, 0.05, "ARN"[i % 3], "O", day) for i in range(2 * ORDERS)],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                     "l_extendedprice double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"),
        "part": ([(0, "red gear"), (1, "blue gear"), (2, "tin bolt")], "p_partkey long, p_name string"),
        "orders": ([(i, i % 5, "1-URGENT", day + dt.timedelta(days=i % 9)) for i in range(ORDERS)],
                   "o_orderkey long, o_custkey long, o_orderpriority string, o_orderdate timestamp"),
        "customer": ([(i, "BUILDING") for i in range(5)], "c_custkey long, c_mktsegment string"),
    }
    for name, (values, schema) in rows.items():
        spark.createDataFrame(values, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_items_of_a_task_are_bounded(spark, star, monkeypatch):
    monkeypatch.setattr(tables, "ITEMS_PER_TASK", 2)
    assert "hashpartitioning(l_orderkey#" in _plan(tables.content_from_tables(spark, star))
    assert f", {ORDERS}), REPARTITION_BY_NUM" in _plan(tables.content_from_tables(spark, star))
    got = {r.video_id: (r.title, r.views) for r in tables.content_from_tables(spark, star).collect()}
    assert len(got) == ORDERS
    assert got[0] == ("blue gear red gear", 13)


@pytest.mark.parametrize("bound", [2, 0])
def test_few_repeated_ids_move_no_rows(spark, monkeypatch, bound):
    monkeypatch.setattr(Q, "MAX_BROADCAST_KEYS", bound, raising=False)
    rows = [(1, 5, "a"), (2, 1, "b"), (1, 3, "c"), (None, 7, "d"), (None, 6, "e"), (4, 8, "f")]
    df = spark.createDataFrame(rows, "k long, s long, t string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = Q.dedup_keep_first(df, ["k"], ["s"], count_col="n", unique_order=True)
        assert ("Exchange hashpartitioning" in _plan(out)) == (bound == 0)
        assert {(r.k, r.t, r.n) for r in out.collect()} == {(1, "c", 2), (2, "b", 1), (None, "e", 2), (4, "f", 1)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_rolling_means_carry_no_derived_columns(spark):
    df = spark.createDataFrame([(i, "t x", "c", dt.date(2020, 1, 1 + i % 3), 10 + i, 5.0, 1, 2, 3, "s") for i in range(9)],
                               "video_id long, title string, category string, publish_date date, views long, "
                               "watch_time_seconds double, likes long, comments long, shares long, thumbnail_style string")
    keep: list[str] = []
    out = E.enrich(df, dt.date(2020, 1, 3), n_days_bound=3, partitions=2, keep=keep)
    moved = spark.read.parquet(keep[0]).columns
    assert "publish_month" not in moved and "like_rate" not in moved
    assert out.columns[:10] == df.columns and out.columns[-len(ROLLING_WINDOWS):] == list(ROLLING_WINDOWS)
    assert all(r.engagement_rate_pct == 6 / r.views * 100 for r in out.collect())


@pytest.mark.parametrize("share", [100_000, 3])
def test_tfidf_moves_texts_not_postings(spark, monkeypatch, share):
    docs = [(1, "red gear blue gear"), (2, "blue gear"), (1, "red hat"), (None, "green hat"), (3, None)]
    df = spark.createDataFrame(docs, "video_id long, title string")
    expected = {(r.video_id, r.term): (r.tf, round(r.weight, 9)) for r in X.tfidf(df).collect()}
    assert expected[1, "red"][0] == 2 and (3, "red") not in expected
    for i in (1, 2, None):
        assert sum(w * w for (d, _), (_, w) in expected.items() if d == i) == pytest.approx(1.0)
    monkeypatch.setattr(X, "TERM_SHARE", share, raising=False)
    monkeypatch.setattr(X, "TEXT_CHARS_PER_TASK", 4, raising=False)
    out = X.tfidf(df)
    plan = _plan(out)
    # 44 characters, four a task; the weights need no further exchange by id
    assert re.search(r"hashpartitioning\(video_id#\d+L, 11\), REPARTITION_BY_NUM", plan)
    assert not re.search(r"hashpartitioning\(video_id#[^)]*\), ENSURE_REQUIREMENTS", plan)
    assert {(r.video_id, r.term): (r.tf, round(r.weight, 9)) for r in out.collect()} == expected


def long_texts(spark, n=40):
    """Texts of about 1,500 letters whose terms are mostly rare, some ids repeated or null, one text empty."""
    word = lambda i: "".join(chr(97 + i // 26 ** p % 26) for p in range(4))
    rows = [(None if i % 13 == 0 else i % 30, " ".join(["red gear the", *("hat" for _ in range(i % 7)),
             *(word(i * i * 97 + j * 31) for j in range(300))]), i) for i in range(n)]
    return spark.createDataFrame([*rows, (77, "", 5), (78, None, 6)], "video_id long, title string, views long").repartition(3)


def test_long_texts_move_no_postings(spark, monkeypatch):
    df = long_texts(spark).withColumn("odd", F.col("views") % 2 == 1)
    monkeypatch.setattr(X, "TERM_SHARE", 3)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = X.tfidf(df, carry=("odd",))
        assert "hashpartitioning(term#" not in _plan(out)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)

    def rows(found):
        return {(r.video_id, r.odd, r.term): (r.tf, round(r.idf, 9), round(r.weight, 9)) for r in found.collect()}

    got, few = rows(out), rows(X.tfidf(df, carry=("odd",), least_df=2))
    monkeypatch.setattr(X, "LONG_TEXT", 10**9)
    assert got == rows(X.tfidf(df, carry=("odd",))) and few == rows(X.tfidf(df, carry=("odd",), least_df=2))
    assert 0 < len(few) < len(got) / 2 and all(found == got[k] for k, found in few.items())


def test_lift_of_long_texts_misses_no_rare_term(spark, monkeypatch):
    """A bound that hides terms of the best is lowered: one that no term reaches, and one that common terms do."""
    df = long_texts(spark)
    got = []
    for floor in (1, 3):
        monkeypatch.setattr(X, "LIFT_FLOOR", floor, raising=False)
        got.append(X.token_lift(df, "views", 30).collect())
    monkeypatch.setattr(X, "LONG_TEXT", 10**9, raising=False)
    want = X.token_lift(df, "views", 30).collect()
    assert got == [want, want] and len(want) == 30


def test_clusters_write_no_titles(spark):
    cols = ["views", "engagement_rate_pct", "avg_watch_time_seconds", "share_rate"]
    extra = [c for c in M.FEATURE_COLUMNS if c not in cols]
    df = spark.range(60).select(F.col("id").alias("video_id"), F.lit("t").alias("title"), F.lit("c").alias("category"),
                                *[(F.col("id") % 7 + F.lit(float(i))).alias(c) for i, c in enumerate(cols + extra)])
    paths: list[str] = []
    with session.recorded(paths):
        got = M.clusters(df).collect()
    assert sum(r.videos for r in got) == 60
    assert not any({"title", "category"} & set(spark.read.parquet(p).columns) for p in paths)


def test_dirty_files_hold_a_bounded_number_of_rows(spark, star, monkeypatch, tmp_path):
    monkeypatch.setattr(catalog, "DIRTY_ROWS_PER_FILE", 10, raising=False)
    catalog.write_dirty_csv(spark, star, str(tmp_path / "dirty"))
    assert len(list((tmp_path / "dirty").glob("*.csv"))) == 2 * ORDERS // 10


def test_uploads_stay_under_their_limit(spark, star, monkeypatch):
    monkeypatch.setattr(catalog, "UPLOAD_MAX_BYTES", 1000, raising=False)
    run, seen = catalog.RF.run_refresh, {}

    def limited(*args):
        seen["files"] = [r.length for r in spark.read.format("binaryFile").option("recursiveFileLookup", True)
                         .option("pathGlobFilter", "*.csv").load(args[1]).select("length").collect()]
        return run(*args)

    monkeypatch.setattr(catalog.RF, "run_refresh", limited)
    log = catalog.q_upload_refresh(spark, star).collect()
    assert len(log) == len(seen["files"]) > 4 and max(seen["files"]) <= 1000
    assert sum(r.rows_loaded for r in log if r.status == "ok") == ORDERS
