"""Building blocks that keep single tasks small: task counts, row numbers and joins with hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from viewscope.session import materialize

HOT_SHARE = 1_000   # a key is hot when it has more than this fraction of all rows, so fewer keys than this are hot
_ROW_BITS = 33      # row number within a partition, in monotonically_increasing_id


def tasks_for(spark: SparkSession, size: int, per_task: int) -> int:
    """Tasks that hold about ``per_task`` of ``size`` each, never fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // per_task))


def numbered(df: DataFrame, column: str) -> DataFrame:
    """``df`` with row numbers 0..n-1 in ``column``, without a global sort.

    The rows are written once, so a rerun task can't number them anew; a partition's first number comes from a table
    of one row per partition.
    """
    placed = materialize(df.withColumn(column, F.monotonically_increasing_id()), "numbered")
    part = F.shiftright(column, _ROW_BITS)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)   # one row per partition
    firsts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = F.col(column).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (placed.withColumn("_part", part).join(F.broadcast(firsts), "_part")
            .withColumn(column, F.col("_first") + within).drop("_part", "_first"))


def join_counted(rows: DataFrame, per_key: DataFrame, keys: list[str], count_col: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with one row per key, of which ``count_col`` says how many ``rows`` share it.

    Keys with more than a thousandth of ``total`` rows number fewer than a thousand, whatever the data, so their side is
    broadcast and their rows stay where they are; the others are shuffled, with at most a thousandth of the rows to a
    key. Null keys match null keys. ``per_key`` is read three times and should be a written table. ``count_col`` is dropped.
    """
    on = [f"_on{i}" for i in range(len(keys))]
    right = per_key.withColumnsRenamed(dict(zip(keys, on)))
    hot = F.broadcast(right.where(F.col(count_col) > total // HOT_SHARE))
    cold = right.where(F.col(count_col) <= total // HOT_SHARE)

    def same(side):
        cond = F.lit(True)
        for k, o in zip(keys, on):
            cond = cond & rows[k].eqNullSafe(side[o])
        return cond

    found = rows.join(hot, same(hot)).drop(*on, count_col)
    rest = rows.join(hot.select(*on), same(hot), "left_anti").join(cold, same(cold)).drop(*on, count_col)
    return found.unionByName(rest)
