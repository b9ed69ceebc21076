"""File sources for raw content rows.

Raw columns are read as text; typing happens in the quality step so that every
bad value is counted. ``ingest_seq`` records the read order, which decides
which of several rows with the same id is kept: a number, so that the first
row of an id is a hashed minimum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CORRUPT = "_corrupt_record"
_FILE_DIGITS, _BLOCK_DIGITS, _ROW_DIGITS = 7, 12, 19      # 38 digits: ten million files of up to a terabyte
_MAX_BROADCAST_FILES = 1_000_000


def _path(col: Column) -> Column:
    """A file's path in one spelling: the listing and the scan write the slashes of a local path differently."""
    return F.regexp_replace(col, "^([A-Za-z0-9+.-]+):/+", "$1:/")


def _with_ingest_order(df: DataFrame) -> DataFrame:
    """Adds ``_source_file`` and ``ingest_seq``.

    File path, start of the block and row number within it order rows as the files do; row numbers alone follow the order
    of partitions, which Spark packs by size. Files are numbered from Spark's own listing, so no pass is needed.
    """
    spark, files = df.sparkSession, sorted(df.inputFiles())
    if len(files) >= 10 ** _FILE_DIGITS:
        raise ValueError(f"{len(files)} files are more than an ingest number can tell apart")
    listed = spark.createDataFrame([(f, i) for i, f in enumerate(files)], "_listed string, _file_no long").select(
        _path(F.col("_listed")).alias("_listed"), "_file_no")
    listed = F.broadcast(listed) if len(files) <= _MAX_BROADCAST_FILES else listed
    placed = (df.withColumn("_source_file", F.col("_metadata.file_path"))
              .withColumn("_block", F.col("_metadata.file_block_start"))
              .withColumn("_row", F.monotonically_increasing_id())
              .join(listed, _path(F.col("_source_file")) == F.col("_listed"), "left"))
    digits = [F.lpad(F.coalesce(F.col(c), F.lit(0)).cast("string"), n, "0") for c, n in
              (("_file_no", _FILE_DIGITS), ("_block", _BLOCK_DIGITS), ("_row", _ROW_DIGITS))]
    return placed.withColumn("ingest_seq", F.concat(*digits).cast("decimal(38,0)")).drop("_block", "_row", "_listed", "_file_no")


def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV scan with every column as a string.

    The header decides the column set; a file with missing or extra columns is still read so that the schema check can
    name the differences. A row with more or fewer fields than the header comes out with its text in
    ``_corrupt_record``; validation counts such rows and sets them aside.
    """
    header = spark.read.option("header", True).option("inferSchema", False).option("escape", '"').csv(path)
    string_schema = ", ".join(f"`{c}` string" for c in [*header.columns, CORRUPT])
    df = (spark.read.schema(string_schema).option("header", True).option("enforceSchema", False)
          .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).option("escape", '"')
          # a parser that skips unread columns would not notice a wrong number of fields
          .option("columnPruning", False).csv(path))
    return _with_ingest_order(df)


def read_raw_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet scan of a raw content table; types are coerced later."""
    return _with_ingest_order(spark.read.parquet(path))
