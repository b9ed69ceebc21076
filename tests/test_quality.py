import pytest
from pyspark.sql import functions as F

from viewscope.operators import quality as Q
from viewscope.schema import RAW_COLUMNS

GOOD = ["1", "a", "Music", "2024-01-01", "10", "100", "1", "1", "1", "A"]


def raw(spark, rows, cols=None):
    cols = cols or RAW_COLUMNS
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols)).withColumn(
        "ingest_seq", F.monotonically_increasing_id())


def row(**over):
    r = dict(zip(RAW_COLUMNS, GOOD))
    r.update(over)
    return tuple(r[c] for c in RAW_COLUMNS)


def test_schema_missing_and_extra(spark):
    with pytest.raises(Q.DataValidationError, match=r"Missing=\['shares'\]"):
        Q.check_schema(raw(spark, [tuple(GOOD[:8] + GOOD[9:])], [c for c in RAW_COLUMNS if c != "shares"]))
    with pytest.raises(Q.DataValidationError, match=r"Extra=\['x'\]"):
        Q.check_schema(raw(spark, [tuple(GOOD + ["1"])], RAW_COLUMNS + ["x"]))


def test_dedup_raw_values_keep_first(spark):
    ids = [None, None, "1", "1", "01"]
    rows = [row(video_id=i, title=f"t{n}") for n, i in enumerate(ids)]
    out = Q.dedup_keep_first(raw(spark, rows), ["video_id"], ["ingest_seq"], count_col="_copies")
    got = {r.video_id: (r.title, r._copies) for r in out.collect()}
    assert got == {None: ("t0", 2), "1": ("t2", 2), "01": ("t4", 1)}


@pytest.mark.parametrize("bad, message", [
    (dict(video_id="abc"), "invalid video_id"),
    (dict(publish_date="not a date"), "invalid publish_date"),
    (dict(likes="many"), "invalid numeric"),
    (dict(shares="-1"), "negative metrics"),
    (dict(views="0"), "strictly positive"),
])
def test_each_failure_raises_in_order(spark, bad, message):
    rows = [row(video_id="1"), row(video_id="2", **{k: v for k, v in bad.items() if k != "video_id"})]
    if "video_id" in bad:
        rows[1] = row(video_id=bad["video_id"])
    with pytest.raises(Q.DataValidationError, match=message):
        Q.validate(raw(spark, rows), "t", mode="fail")


def test_precedence_id_before_date(spark):
    rows = [row(video_id="x", publish_date="bad")]
    with pytest.raises(Q.DataValidationError, match="video_id"):
        Q.validate(raw(spark, rows), "t")


def test_quarantine_split_and_report(spark):
    rows = [row(video_id="1"), row(video_id="2", views="0"), row(video_id="3", likes="-2"), row(video_id="3")]
    v = Q.validate(raw(spark, rows), "t", mode="quarantine")
    good, bad = Q.split_quarantine(v.rows)
    assert sorted(r.video_id for r in good.collect()) == [1]
    assert sorted(r.reject_reason for r in bad.collect()) == ["negative_metric", "zero_views"]
    assert v.report["rows_read"] == 4 and v.report["duplicate_video_ids_removed"] == 1
    assert v.report["rows_loaded"] == 1


def test_strip_keeps_null_and_unicode_space(spark):
    df = spark.createDataFrame([("  a b\t",), (None,)], "t string")
    got = [r[0] for r in df.select(Q.strip_text("t")).collect()]
    assert got == ["a b", None]
    assert [r[0] for r in df.select(Q.strip_text("t", null_text="nan")).collect()] == ["a b", "nan"]


def test_csv_source_round_trip(spark, tmp_path):
    from viewscope.plans.content import load_content
    from viewscope.sources.files import read_raw_csv

    p = tmp_path / "in.csv"
    p.write_text(",".join(RAW_COLUMNS) + "\n" + "\n".join(
        ",".join(row(video_id=str(i), publish_date=f"2024-01-0{i}")) for i in range(1, 4)) + "\n")
    table, _ = load_content(read_raw_csv(spark, str(p)), "in.csv", str(tmp_path / "out"))
    assert table.report["rows_loaded"] == 3
    assert table.frame.count() == 3


def test_dedup_hot_key_third_of_rows(spark):
    # one id holds a third of all rows; the aggregate keeps the first by ingest order
    rows = [(("7" if i % 3 == 0 else str(1000 + i)), f"t{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "video_id string, title string").withColumn(
        "ingest_seq", F.monotonically_increasing_id()).repartition(8)
    out = Q.dedup_keep_first(df, ["video_id"], ["ingest_seq"], count_col="_copies")
    hot = out.where("video_id = '7'").first()
    assert out.count() == 2001 and hot._copies == 1000
    first_seq = df.where("video_id = '7'").agg(F.min("ingest_seq")).first()[0]
    assert hot.title == df.where(F.col("ingest_seq") == first_seq).first().title


def test_dedup_plans_hash_only_and_order_of_several_columns(spark):
    rows = [(k, a, d, f"{k}{a}{d}") for k in ("x", "y", None) for a in (3, 1, None) for d in ("2024-02-01", "2024-01-01")]
    df = spark.createDataFrame(rows * 2, "k string, a long, d string, t string").withColumn("d", F.to_date("d"))
    out = Q.dedup_keep_first(df.repartition(4), ["k"], ["a", "d"], count_col="n")
    assert sorted((str(r.k), r.a, str(r.d), r.n) for r in out.collect()) == [
        (k, None, "2024-01-01", 12) for k in ("None", "x", "y")]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
    # an order that fits no number is reduced as a struct
    text = Q.dedup_keep_first(df, ["k"], ["t"], count_col="n").collect()
    assert sorted((str(r.k), r.n) for r in text) == [("None", 12), ("x", 12), ("y", 12)]


def test_dedup_null_order_sorts_first_and_wide_ranges(spark):
    big = (1 << 62)
    rows = [("a", big, "x"), ("a", -big, "y"), ("b", None, "z"), ("b", 1, "w"), ("c", None, "v")]
    df = spark.createDataFrame(rows, "k string, s long, t string")
    got = {r.k: r.t for r in Q.dedup_keep_first(df, ["k"], ["s"], unique_order=True).collect()}
    assert got == {"a": "y", "b": "z", "c": "v"}


def _write(path, lines):
    path.write_text("\n".join([",".join(RAW_COLUMNS), *lines]) + "\n")


def test_malformed_rows_are_counted_and_set_aside(spark, tmp_path):
    from viewscope.sources.files import read_raw_csv

    folder = tmp_path / "some dir"
    folder.mkdir()
    good = ",".join(GOOD)
    _write(folder / "b é.csv", [good.replace("1,a", "2,later", 1), "3,short,Music,2024-01-01,10", good + ",surplus"])
    _write(folder / "a.csv", [good, good.replace("1,a", "2,first", 1), '4,"quoted, comma",M,2024-01-05,9,9,1,1,1,A'])
    raw = read_raw_csv(spark, str(folder))
    assert Q.COUNT_COLUMNS and raw.schema["ingest_seq"].dataType.simpleString() == "decimal(38,0)"
    v = Q.validate(raw, "dirty", mode="quarantine")
    good_rows, bad = Q.split_quarantine(v.rows)
    assert {r.video_id: r.title for r in good_rows.collect()} == {1: "a", 2: "first", 4: "quoted, comma"}
    assert [r.reject_reason for r in bad.collect()] == ["malformed_row"] * 2
    assert (v.report["rows_read"], v.report["malformed_rows"], v.report["duplicate_video_ids_removed"]) == (6, 2, 1)
    assert v.report["invalid_numeric_rows"] == 0
    with pytest.raises(Q.DataValidationError, match="wrong number of fields"):
        Q.validate(raw, "dirty", mode="fail")


def test_date_formats(spark):
    texts = ["2024-01-02", "2024/1/2", "01/02/2024", "2 Jan 2024", "January 2, 2024", "20240102", " 1/2/2024 ", "2024-13-01", "x", ""]
    df = raw(spark, [row(video_id=str(i), publish_date=t) for i, t in enumerate(texts)])
    got = {r.video_id: r.publish_date for r in Q.coerce(df).collect()}
    assert all(str(got[i])[:10] == "2024-01-02" for i in range(7)) and [got[i] for i in (7, 8, 9)] == [None] * 3
    iso_only = {r.video_id: r.publish_date for r in Q.coerce(df, date_formats=()).collect()}
    assert [i for i, d in iso_only.items() if d is not None] == [0]


def test_rows_without_order_and_rounding_half_even(spark):
    from viewscope.functions.numeric import round_records

    plain = raw(spark, [row(video_id=i) for i in ("1", "1", "2")]).drop("ingest_seq")
    assert Q.validate(plain, "t").report["duplicate_video_ids_removed"] == 1
    df = spark.createDataFrame([(0.00005, 1, "a"), (0.00015, 2, "b"), (-2.71825, 3, None), (None, 4, "c")], "x double, n int, t string")
    assert [r.x for r in round_records(df).collect()] == [0.0, 0.0002, -2.7182, None]


def test_changed_input_is_built_anew(spark, tmp_path):
    from viewscope.session import path_version

    df = spark.range(5)
    df.write.parquet(str(tmp_path / "t"))
    before = path_version(spark, [str(tmp_path / "t")])
    assert path_version(spark, [str(tmp_path / "t")]) == before
    spark.range(6).write.mode("append").parquet(str(tmp_path / "t"))
    assert path_version(spark, [str(tmp_path / "t")]) != before
