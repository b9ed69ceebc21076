"""Landing-folder refresh (ST1): every newly landed CSV becomes a validated snapshot.

A file-source stream discovers new files (one file per micro-batch, so one
upload stays one dataset). ``foreachBatch`` first rejects a file by its name or
length (S2), before anything of it is read; it then reads the file with the
batch reader (header checked against the contract), validates and enriches
it, writes a fresh snapshot folder, points the manifest at it and appends a row to the
refresh log. A file that fails leaves the previous snapshot current and logs the reason.

The manifest is a folder of small numbered files. A new state is written aside and renamed to the next number, so
readers see the old state or the new one; reading it costs one listing of a few
names, however long the log is. Progress is kept in the stream's checkpoint, and a
replayed batch replaces its own snapshot and log rows.
"""

from __future__ import annotations

import json
import os

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewscope.operators.quality import DataValidationError
from viewscope.plans.content import load_content
from viewscope.schema import UPLOAD_MAX_BYTES, UPLOAD_SUFFIX
from viewscope.session import file_system
from viewscope.sources.files import read_raw_csv

LOG_SCHEMA = ("batch_id long, file string, status string, rows_loaded long, error string, "
              "snapshot string, logged_at timestamp")
_KEPT_STATES = 2            # older manifest files are removed, the newest and the one before it stay
_MANIFEST = "_manifest"
_COMPACTED = "upto="


def _states(spark: SparkSession, folder: str) -> list[tuple[int, str]]:
    """(number, path) of the manifest files, oldest first."""
    fs, place = file_system(spark, folder)
    if not fs.exists(place):
        return []
    found = [s.getPath() for s in fs.listStatus(place)]
    return sorted((int(p.getName()[:-5]), p.toString()) for p in found if p.getName()[:-5].isdigit()
                  and p.getName().endswith(".json"))


def publish(spark: SparkSession, log_dir: str, state: dict) -> None:
    """Make ``state`` the current one by a single rename; a state of the same or a later batch stays."""
    folder = os.path.join(log_dir, _MANIFEST)
    states = _states(spark, folder)
    number = int(state["batch_id"])
    if states and states[-1][0] >= number:
        return
    fs, place = file_system(spark, folder)
    fs.mkdirs(place)
    aside = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, f".{number}.tmp")
    out = fs.create(aside, True)
    out.write(bytearray(json.dumps(state), "utf-8"))
    out.close()
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, f"{number}.json")
    if not fs.rename(aside, target):
        raise OSError(f"could not publish {target}")
    for _, old in [*states, (number, "")][:-_KEPT_STATES]:
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(old), False)


def current_state(spark: SparkSession, log_dir: str) -> dict | None:
    """The newest published state: batch_id, snapshot, rows_loaded."""
    states = _states(spark, os.path.join(log_dir, _MANIFEST))
    if not states:
        return None
    text = spark.read.option("wholetext", True).text(states[-1][1]).first()[0]
    return json.loads(text)


def refuse_upload(name: str, length: int, max_bytes: int = UPLOAD_MAX_BYTES) -> str | None:
    """Why a file is refused before it is read, or None."""
    if not name.lower().endswith(UPLOAD_SUFFIX):
        return "Only CSV files are supported"
    if length > max_bytes:
        return f"File of {length} bytes exceeds the limit of {max_bytes}"
    return None


def _handle_batch(spark: SparkSession, snapshots_dir: str, log_dir: str, max_bytes: int):
    def handle(batch: DataFrame, batch_id: int) -> None:
        # bounded by maxFilesPerTrigger: one landed file per batch
        files = [tuple(r) for r in batch.select("file_path", "length").distinct().collect()]
        rows = []
        for path, length in sorted(files):
            snap = os.path.join(snapshots_dir, f"batch={batch_id}")
            refused = refuse_upload(os.path.basename(path), length, max_bytes)
            if refused:
                rows.append((batch_id, path, "rejected", 0, refused, None))
                continue
            try:
                raw = read_raw_csv(spark, path)
                table, _ = load_content(raw, os.path.basename(path), snap)
                loaded = int(table.report["rows_loaded"])
                if not loaded:
                    raise DataValidationError("Dataset has no rows")
                rows.append((batch_id, path, "ok", loaded, None, snap))
            except (DataValidationError, PySparkException) as exc:   # a bad or unreadable file must not stop the stream
                rows.append((batch_id, path, "rejected", 0, str(exc)[:2000], None))
        if rows:
            log = spark.createDataFrame(rows, "batch_id long, file string, status string, rows_loaded long, "
                                              "error string, snapshot string")
            # one folder a batch: a replayed batch replaces its own rows
            log.withColumn("logged_at", F.current_timestamp()).coalesce(1).write.mode("overwrite").parquet(
                os.path.join(log_dir, f"batch={batch_id}"))
        for _, path, status, loaded, _, snap in rows:
            if status == "ok":
                publish(spark, log_dir, {"batch_id": batch_id, "file": path, "snapshot": snap, "rows_loaded": loaded})

    return handle


def run_refresh(spark: SparkSession, landing_dir: str, snapshots_dir: str, log_dir: str,
                checkpoint_location: str, available_now: bool = True, processing_time: str | None = None,
                max_bytes: int = UPLOAD_MAX_BYTES):
    """Start the refresh stream; with ``available_now`` it processes what has landed and stops."""
    # one row a file, whatever it holds; its content is not read here
    files = (spark.readStream.format("binaryFile")
             .schema("path string, modificationTime timestamp, length long, content binary")
             .option("maxFilesPerTrigger", 1)
             .load(landing_dir).select(F.col("path").alias("file_path"), "length"))
    writer = (files.writeStream.foreachBatch(_handle_batch(spark, snapshots_dir, log_dir, max_bytes))
              .option("checkpointLocation", checkpoint_location))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(
        processingTime=processing_time or "30 seconds")
    return writer.start()


def _log_folders(spark: SparkSession, log_dir: str) -> list[str]:
    fs, place = file_system(spark, log_dir)
    return sorted(s.getPath().getName() for s in fs.listStatus(place) if s.isDirectory()) if fs.exists(place) else []


def refresh_log(spark: SparkSession, log_dir: str) -> DataFrame:
    """All log rows: the newest compacted folder and the batches after it."""
    folders = _log_folders(spark, log_dir)
    upto = max((int(f[len(_COMPACTED):]) for f in folders if f.startswith(_COMPACTED)), default=-1)
    wanted = [f for f in folders if f == f"{_COMPACTED}{upto}"
              or f.startswith("batch=") and int(f[len("batch="):]) > upto]
    if not wanted:
        return spark.createDataFrame([], LOG_SCHEMA)
    return spark.read.schema(LOG_SCHEMA).parquet(*[os.path.join(log_dir, f) for f in wanted])


def compact_log(spark: SparkSession, log_dir: str) -> int:
    """Fold the log of many small batch folders into one; returns the number of folders removed.

    The new folder holds every row up to its batch number and counts from the moment its write commits; readers skip the
    older folders from then on, so removing them afterwards loses nothing.
    """
    folders = _log_folders(spark, log_dir)
    batches = [int(f[len("batch="):]) for f in folders if f.startswith("batch=")]
    if not batches:
        return 0
    last = max(batches)
    name = f"{_COMPACTED}{last}"
    aside = os.path.join(log_dir, f".{name}")
    refresh_log(spark, log_dir).write.mode("overwrite").parquet(aside)
    fs, place = file_system(spark, aside)
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path   # noqa: N806 - a Java class
    if not fs.rename(place, Path(os.path.join(log_dir, name))):
        raise OSError(f"could not commit {name}")
    old = [f for f in folders if f.startswith(("batch=", _COMPACTED)) and f != name]
    for f in old:
        fs.delete(Path(os.path.join(log_dir, f)), True)
    return len(old)


def latest_snapshot(spark: SparkSession, log_dir: str) -> DataFrame | None:
    """The newest accepted snapshot (latest good upload wins)."""
    state = current_state(spark, log_dir)
    return spark.read.parquet(state["snapshot"]) if state else None
