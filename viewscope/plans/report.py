"""CSV export (K1) and the report datasets (K2).

The report is one dataset per page, each computed from the written content
table by the operator it shows; a slice's filters reach that table's scan.
Drawing the pages is left to the consumer.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewscope.operators import models as M
from viewscope.operators import summary as S
from viewscope.operators import text as X
from viewscope.operators import trends as TR
from viewscope.operators.filters import filter_content
from viewscope.schema import EXPORT_COLUMNS, Filters


def csv_export(df: DataFrame, filters: Filters | None = None) -> DataFrame:
    """K1: the 19 export columns in order, date without time, in load order."""
    out = filter_content(df, filters).orderBy("publish_date", "video_id")
    return out.select(*[F.date_format("publish_date", "yyyy-MM-dd").alias(c) if c == "publish_date" else c
                        for c in EXPORT_COLUMNS])


def write_csv_export(df: DataFrame, out_dir: str, filters: Filters | None = None) -> None:
    """Write the export as CSV part files in load order, each with the header; an empty slice has no rows."""
    csv_export(df, filters).write.mode("overwrite").option("header", True).option("escape", '"').csv(out_dir)


def read_csv_export(spark, path: str) -> DataFrame:
    """The rows of a written export, typed."""
    types = {c: "bigint" for c in ("video_id", "views", "likes", "comments", "shares")} | {
        c: "int" for c in ("title_word_count", "days_since_publish")} | {
        c: "string" for c in ("title", "category", "publish_date", "thumbnail_style", "publish_weekday")}
    schema = ", ".join(f"{c} {types.get(c, 'double')}" for c in EXPORT_COLUMNS)
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


def _title(frame: DataFrame) -> DataFrame:
    return frame.agg(F.count(F.lit(1)).alias("videos"), F.min("publish_date").alias("date_min"),
                     F.max("publish_date").alias("date_max"))


PAGES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "title": _title,
    "overview": S.kpi_totals,
    "category_views": S.by_category,
    "thumbnail_engagement": S.by_thumbnail_style,
    "monthly": S.monthly,
    "weekday": TR.weekday_calendar,
    "correlations": TR.correlations_to_views,
    "token_lift": lambda frame: X.token_lift(frame, "views", 10),
    "top_videos": S.report_top10,
    "recommendations": S.recommendations,
}
MODEL_PAGES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "clusters": M.clusters,
    "anomalies": lambda frame: M.anomalies(frame, 0.04, top=15),
}


def report_page(df: DataFrame, page: str, filters: Filters | None = None) -> DataFrame:
    """K2: the numbers behind one page of the report."""
    return (PAGES | MODEL_PAGES)[page](filter_content(df, filters))


def report_datasets(df: DataFrame, filters: Filters | None = None, with_models: bool = True) -> dict[str, DataFrame]:
    """K2: the numbers behind every page of the report."""
    return {page: report_page(df, page, filters) for page in (PAGES | MODEL_PAGES if with_models else PAGES)}


def write_report(df: DataFrame, out_dir: str, filters: Filters | None = None, with_models: bool = True) -> list[str]:
    """Write each page as Parquet under ``out_dir``; returns the page names."""
    pages = list(PAGES | MODEL_PAGES if with_models else PAGES)
    for page in pages:
        report_page(df, page, filters).write.mode("overwrite").parquet(os.path.join(out_dir, page))
    return pages
