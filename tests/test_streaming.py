from viewscope.schema import RAW_COLUMNS
from viewscope.streaming import refresh as RF


def _csv(path, cols, rows):
    path.write_text(",".join(cols) + "\n" + "\n".join(",".join(r) for r in rows) + "\n")


def test_refresh_accepts_good_rejects_bad_and_keeps_last_good(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    good = [[str(i), f"title {i}", "Music", f"2024-01-0{i}", "10", "100", "1", "2", "3", "A"] for i in range(1, 4)]
    _csv(landing / "a_good.csv", RAW_COLUMNS, good)
    q = RF.run_refresh(spark, str(landing), str(tmp_path / "snaps"), str(tmp_path / "log"), str(tmp_path / "ckpt"))
    q.awaitTermination()
    # a second upload with a negative metric must be rejected, leaving the first snapshot current
    bad = [r[:] for r in good]
    bad[0][6] = "-5"
    _csv(landing / "b_bad.csv", RAW_COLUMNS, bad)
    q = RF.run_refresh(spark, str(landing), str(tmp_path / "snaps"), str(tmp_path / "log"), str(tmp_path / "ckpt"))
    q.awaitTermination()
    log = RF.refresh_log(spark, str(tmp_path / "log")).orderBy("batch_id").collect()
    assert [(r.status, r.rows_loaded) for r in log] == [("ok", 3), ("rejected", 0)]
    assert "negative" in log[1].error
    latest = RF.latest_snapshot(spark, str(tmp_path / "log"))
    assert latest.count() == 3 and "rolling_views_7d" in latest.columns


def _land(tmp_path, name, rows, cols=RAW_COLUMNS):
    _csv(tmp_path / "landing" / name, cols, rows)


def _run(spark, tmp_path, **kw):
    (tmp_path / "landing").mkdir(exist_ok=True)
    q = RF.run_refresh(spark, str(tmp_path / "landing"), str(tmp_path / "snaps"), str(tmp_path / "log"), str(tmp_path / "ckpt"), **kw)
    q.awaitTermination()


GOOD = [[str(i), f"title {i}", "Music", f"2024-01-0{i}", "10", "100", "1", "2", "3", "A"] for i in range(1, 4)]


def test_uploads_are_refused_by_name_and_length_before_reading(spark, tmp_path):
    (tmp_path / "landing").mkdir()
    _land(tmp_path, "a.csv", GOOD)
    _run(spark, tmp_path)
    _land(tmp_path, "notes.txt", GOOD)
    _run(spark, tmp_path)
    _land(tmp_path, "b.csv", GOOD * 50)
    _run(spark, tmp_path, max_bytes=1000)
    _land(tmp_path, "c.csv", [])                       # a header alone has no rows
    _run(spark, tmp_path)
    log = [(r.status, r.rows_loaded, r.error) for r in RF.refresh_log(spark, str(tmp_path / "log")).orderBy("batch_id").collect()]
    assert [x[:2] for x in log] == [("ok", 3), ("rejected", 0), ("rejected", 0), ("rejected", 0)]
    assert "CSV" in log[1][2] and "exceeds" in log[2][2] and log[3][2]
    assert RF.current_state(spark, str(tmp_path / "log"))["batch_id"] == 0
    assert RF.latest_snapshot(spark, str(tmp_path / "log")).count() == 3


def test_replayed_batch_manifest_and_compaction(spark, tmp_path):
    log = str(tmp_path / "log")
    (tmp_path / "landing").mkdir()
    assert RF.latest_snapshot(spark, log) is None and RF.refresh_log(spark, log).count() == 0
    for i in range(3):
        _land(tmp_path, f"f{i}.csv", GOOD[:i + 1])
        _run(spark, tmp_path)
    path = [r.file for r in RF.refresh_log(spark, log).collect() if r.file.endswith("f1.csv")][0]
    replay = spark.createDataFrame([(path, 200)], "file_path string, length long")
    RF._handle_batch(spark, str(tmp_path / "snaps"), log, 10_000)(replay, 1)
    rows = RF.refresh_log(spark, log).orderBy("batch_id").collect()
    assert [(r.batch_id, r.status, r.rows_loaded) for r in rows] == [(0, "ok", 1), (1, "ok", 2), (2, "ok", 3)]
    # a replay of an older batch does not move the pointer back
    assert RF.current_state(spark, log)["batch_id"] == 2 and RF.latest_snapshot(spark, log).count() == 3
    assert len(RF._states(spark, str(tmp_path / "log" / "_manifest"))) == 2
    assert RF.compact_log(spark, log) == 3
    assert RF.refresh_log(spark, log).count() == 3
    _land(tmp_path, "f3.csv", GOOD)
    _run(spark, tmp_path)
    assert RF.refresh_log(spark, log).count() == 4 and RF.current_state(spark, log)["batch_id"] == 3
    assert RF.compact_log(spark, log) == 2 and RF.refresh_log(spark, log).count() == 4
