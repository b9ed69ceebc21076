"""Small helpers of the llm operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NULL_ID = -(1 << 63)   # stands for a null id inside tasks, where pandas would turn the column into floats


def with_id(df: DataFrame, id_col: str, *others: str | Column) -> DataFrame:
    """The id (nulls as NULL_ID) and the other columns only, so extra columns can't clash."""
    return df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias(id_col), *others)


def null_ids(df: DataFrame, *id_cols: str) -> DataFrame:
    """Turn NULL_ID back into nulls."""
    cols = id_cols or ("doc_id",)
    return df.withColumns({c: F.nullif(F.col(c), F.lit(NULL_ID)) for c in cols})


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have: ``name``, lengthened if need be."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def release_memory() -> None:
    """Return freed memory of this Python worker to the system.

    Spark reuses workers, and their allocators keep the peak of every task they have run. Giving it back is
    optional: where the C library has no such call the worker only stays larger.
    """
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):   # another C library has no such call
        pass


def trimmed(run):
    """A map over batches that releases memory once its last batch is done."""
    def wrapped(batches):
        yield from run(batches)
        release_memory()
    return wrapped
