"""Slicing the content table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewscope.schema import Filters


def filter_content(df: DataFrame, filters: Filters | None = None) -> DataFrame:
    """Category equality (``all``/empty disables) and inclusive date bounds.

    The end bound is midnight of the given day, as a timestamp comparison;
    for date-typed content that is the whole end day. Predicates are plain
    column comparisons so they reach the Parquet scan.
    """
    f = filters or Filters()
    out = df
    if f.category and f.category.lower() != "all":
        out = out.where(F.col("category") == F.lit(f.category))
    if f.start_date:
        out = out.where(F.col("publish_date") >= F.to_date(F.lit(f.start_date)))
    if f.end_date:
        out = out.where(F.col("publish_date").cast("timestamp_ntz")
                        <= F.to_timestamp_ntz(F.lit(f.end_date)))
    return out


def filter_options(df: DataFrame) -> DataFrame:
    """option rows (kind, value): ``all`` then the sorted categories, the sorted
    thumbnail styles, then the first and last publish dates.

    Distinct values come from partial aggregates; the order is a global sort
    (range-partitioned), so no task has to number all values.
    """
    cats = df.select(F.lit("category").alias("kind"), F.col("category").alias("value")).distinct()
    thumbs = df.select(F.lit("thumbnail_style").alias("kind"), F.col("thumbnail_style").alias("value")).distinct()
    all_row = df.limit(1).select(F.lit("category").alias("kind"), F.lit("all").alias("value"))
    dates = df.agg(F.min("publish_date").alias("mn"), F.max("publish_date").alias("mx"))
    date_rows = dates.select(F.explode(F.array(
        F.struct(F.lit("date_min").alias("kind"), F.date_format("mn", "yyyy-MM-dd").alias("value")),
        F.struct(F.lit("date_max").alias("kind"), F.date_format("mx", "yyyy-MM-dd").alias("value")))).alias("r")
    ).select("r.*")
    rows = all_row.unionByName(cats).unionByName(thumbs).unionByName(date_rows)
    kind_rank = (F.when(F.col("kind") == "category", 0).when(F.col("kind") == "thumbnail_style", 1)
                 .when(F.col("kind") == "date_min", 2).otherwise(3))
    is_all = F.when((F.col("kind") == "category") & (F.col("value") == "all"), 0).otherwise(1)
    return rows.orderBy(kind_rank, is_all, "value")


def keyword_mask(keyword: str) -> F.Column:
    """case-insensitive literal substring test on the title ('' matches all)."""
    return F.lower(F.col("title")).contains(keyword.lower())


def title_keyword_filter(df: DataFrame, keyword: str) -> DataFrame:
    return df.where(keyword_mask(keyword))
