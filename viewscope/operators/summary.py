"""KPI totals, breakdowns, top-N and recommendations.

Group-bys run as partial (map-side) aggregates, so only one small row per
group and task is shuffled. Top-N uses ``orderBy(...).limit(n)``, which plans
as TakeOrderedAndProject: each task keeps its own n best rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewscope import schema as C
from viewscope.functions.numeric import fixed
from viewscope.functions.quantile import exact_quantiles


def kpi_totals(df: DataFrame) -> DataFrame:
    """A1: count, sums, means and the median of views (truncated to an integer)."""
    agg = df.agg(
        F.count(F.lit(1)).alias("videos"),
        F.sum("views").alias("total_views"),
        fixed(F.sum("watch_time_hours"), 2).alias("total_watch_time_hours"),
        fixed(F.avg("views"), 2).alias("avg_views"),
        fixed(F.avg("engagement_rate_pct"), 3).alias("avg_engagement_rate_pct"),
        fixed(F.avg("avg_watch_time_seconds"), 2).alias("avg_watch_time_seconds"),
    ).withColumn("_g", F.lit(0))
    med = exact_quantiles(df, "views", [0.5]).select(F.lit(0).alias("_g"),
                                                     F.floor("q0").cast("bigint").alias("median_views"))
    return agg.join(med, "_g").drop("_g")


def card(df: DataFrame) -> DataFrame:
    """The fixed card projection with the reference's rounding."""
    return df.select(
        "video_id", "title", "category", "thumbnail_style", "publish_date", "views",
        fixed("engagement_rate_pct", 3).alias("engagement_rate_pct"),
        fixed("avg_watch_time_seconds", 2).alias("avg_watch_time_seconds"))


def top_by(df: DataFrame, col: str, n: int = 1) -> DataFrame:
    """Argmax rows by ``col``; ties broken by the primary key."""
    return df.orderBy(F.col(col).desc(), F.col("video_id").asc()).limit(n)


def top_video_by_views(df: DataFrame) -> DataFrame:
    """A2."""
    return card(top_by(df, "views"))


def top_video_by_engagement(df: DataFrame) -> DataFrame:
    """A3."""
    return card(top_by(df, "engagement_rate"))


def top_watch_time(df: DataFrame) -> DataFrame:
    """A14."""
    return card(top_by(df, "avg_watch_time_seconds"))


def _breakdown(df: DataFrame, key: str, with_watch: bool = True) -> DataFrame:
    aggs = [F.count("video_id").alias("videos"),
            fixed(F.avg("views"), 4).alias("avg_views"),
            fixed(F.avg("engagement_rate_pct"), 4).alias("avg_engagement_rate_pct")]
    if with_watch:
        aggs.append(fixed(F.avg("avg_watch_time_seconds"), 4).alias("avg_watch_time_seconds"))
    return df.groupBy(key).agg(*aggs)


def by_category(df: DataFrame) -> DataFrame:
    """A4: per category, ordered by mean views (descending)."""
    return _breakdown(df, "category").orderBy(F.col("avg_views").desc(), "category")


def by_thumbnail_style(df: DataFrame) -> DataFrame:
    """A5: per thumbnail style, ordered by mean engagement (descending)."""
    return _breakdown(df, "thumbnail_style").orderBy(F.col("avg_engagement_rate_pct").desc(), "thumbnail_style")


def monthly(df: DataFrame) -> DataFrame:
    """Per publish month, months ascending."""
    return _breakdown(df, "publish_month", with_watch=False).orderBy("publish_month")


def top_videos(df: DataFrame, limit: int = 100) -> DataFrame:
    """The ``limit`` most viewed items (1..1000) as cards."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be between 1 and 1000")
    top = df.orderBy(F.col("views").desc(), F.col("video_id").asc()).limit(limit)
    return top.select(
        "video_id", "title", "category", "publish_date", "thumbnail_style", "views",
        fixed("engagement_rate_pct", 4).alias("engagement_rate_pct"),
        fixed("avg_watch_time_seconds", 4).alias("avg_watch_time_seconds"))


def report_top10(df: DataFrame) -> DataFrame:
    """The 10 most viewed items for the report."""
    return top_videos(df, 10)


def best_segments(df: DataFrame) -> DataFrame:
    """The category and the thumbnail style with the highest mean engagement."""
    cat = (df.groupBy("category").agg(F.avg("engagement_rate_pct").alias("m"))
           .orderBy(F.col("m").desc(), "category").limit(1)
           .select(F.lit("category").alias("dimension"), F.col("category").alias("value"),
                   fixed("m", 4).alias("avg_engagement_rate_pct")))
    thumb = (df.groupBy("thumbnail_style").agg(F.avg("engagement_rate_pct").alias("m"))
             .orderBy(F.col("m").desc(), "thumbnail_style").limit(1)
             .select(F.lit("thumbnail_style").alias("dimension"), F.col("thumbnail_style").alias("value"),
                     fixed("m", 4).alias("avg_engagement_rate_pct")))
    return cat.unionByName(thumb)


def _title_case_expr(lowered: F.Column) -> F.Column:
    """Python ``str.title()`` on lower-cased text: every letter run starts upper-case.

    Unlike ``initcap`` a letter after any non-letter starts a word (``sci-fi`` -> ``Sci-Fi``).
    """
    runs = F.regexp_extract_all(lowered, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    cap = F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.substring(r, 2, 1 << 30)))
    return F.array_join(cap, "")


def recommendations(df: DataFrame) -> DataFrame:
    """Four recommendation lines built from A13 and A14 (line_no, text)."""
    seg = best_segments(df)
    thumb = seg.where(F.col("dimension") == "thumbnail_style").select(
        F.lit(1).alias("line_no"), F.format_string(C.RECOMMEND_THUMBNAIL, F.col("value")).alias("text"))
    cat = seg.where(F.col("dimension") == "category").select(
        F.lit(2).alias("line_no"),
        F.format_string(C.RECOMMEND_CATEGORY, _title_case_expr(F.lower(F.col("value")))).alias("text"))
    # one read serves both lines: the last names no value, but an empty slice has neither
    rest = top_by(df, "avg_watch_time_seconds").select(F.explode(F.array(
        F.struct(F.lit(3).alias("line_no"), F.format_string(C.RECOMMEND_WATCH_TIME, F.col("title")).alias("text")),
        F.struct(F.lit(4).alias("line_no"), F.lit(C.RECOMMEND_FEATURES).alias("text")))).alias("r")).select("r.*")
    return thumb.unionByName(cat).unionByName(rest)
