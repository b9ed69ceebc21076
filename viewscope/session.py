"""Session construction and the shared folder used to cut lineage."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

_DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "viewscope",
                  extra: dict[str, str] | None = None) -> SparkSession:
    """A local session for tests and benchmarks. Clusters bring their own session."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", os.environ.get("VIEWSCOPE_DRIVER_MEMORY", "16g")))
    for key, value in {**_DEFAULT_CONF, **(extra or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package, once per application.

    UDFs that live in modules are pickled by reference, so every worker must be
    able to import the package; ``addPyFile`` sends a zip of it through Spark.
    """
    sc = spark.sparkContext
    root = os.path.dirname(os.path.abspath(__file__))
    if sc.applicationId in _SHIPPED or not os.path.isdir(root):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="viewscope-code-"), "viewscope.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


_RECORDS: list[list[str]] = []


@contextmanager
def recorded(paths: list[str]):
    """Adds to ``paths`` the folder of every table that ``materialize`` writes meanwhile."""
    _RECORDS.append(paths)
    try:
        yield
    finally:
        _RECORDS.remove(paths)


def materialize(df, name: str, keep: list[str] | None = None, compression: str | None = None):
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    The folder is added to ``keep``, for a caller that releases it once its last reader is done. Wide tables
    can be written with a denser ``compression`` than the session's.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    for paths in [*_RECORDS, *([keep] if keep is not None else [])]:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, path object) of a path, so that any store Spark reads can be listed."""
    sc = spark.sparkContext
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(sc._jsc.hadoopConfiguration()), place


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete intermediate tables that ``materialize`` wrote."""
    for path in paths:
        fs, place = file_system(spark, path)
        fs.delete(place, True)
    paths.clear()


def path_version(spark: SparkSession, paths: list[str]) -> str:
    """A digest of names, lengths and times of the files under ``paths``: it changes when the input does."""
    seen = hashlib.sha1()
    for path in paths:
        fs, place = file_system(spark, path)
        files = fs.listFiles(place, True)
        rows = []
        while files.hasNext():
            f = files.next()
            rows.append(f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}")
        seen.update("\n".join(sorted(rows)).encode())
    return seen.hexdigest()[:16]


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediate tables.

    Taken from ``spark.checkpoint.dir`` when the cluster sets it. Only a local
    master may fall back to a fresh temporary folder; on a cluster a
    machine-local folder would not survive the loss of that machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not current:
        try:
            current = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key
            current = None
    if not current:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        current = tempfile.mkdtemp(prefix="viewscope-ckpt-")
        sc.setCheckpointDir(current)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return sc.getCheckpointDir() or current
