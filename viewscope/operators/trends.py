"""Group lifts, correlations, quartiles and the rolling tail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewscope.functions.numeric import fixed, pearson
from viewscope.functions.quantile import exact_quantiles
from viewscope.schema import CORRELATION_COLUMNS

LIFT_METRICS = ["views", "engagement_rate_pct", "avg_watch_time_seconds"]


def lift(df: DataFrame, key: str) -> DataFrame:
    """Mean of views, engagement and watch time per ``key``, by engagement (descending)."""
    return (df.groupBy(key).agg(*[fixed(F.avg(m), 4).alias(m) for m in LIFT_METRICS])
            .orderBy(F.col("engagement_rate_pct").desc(), key))


def category_lift(df: DataFrame) -> DataFrame:
    """A7."""
    return lift(df, "category")


def thumbnail_lift(df: DataFrame) -> DataFrame:
    """A8."""
    return lift(df, "thumbnail_style")


def weekday_lift(df: DataFrame) -> DataFrame:
    """A9."""
    return lift(df, "publish_weekday")


def weekday_calendar(df: DataFrame) -> DataFrame:
    """A10: weekday means in calendar order (Monday first), only days present."""
    # ISO day of week of any row of the group fixes its calendar position
    out = df.groupBy("publish_weekday").agg(
        F.min(((F.dayofweek("publish_date") + 5) % 7) + 1).cast("int").alias("weekday_index"),
        *[fixed(F.avg(m), 4).alias(m) for m in LIFT_METRICS])
    return out.orderBy("weekday_index")


def correlations_to_views(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson correlation of views with each column, undefined ones dropped, descending."""
    cols = [c for c in (columns or CORRELATION_COLUMNS) if c != "views"]
    one = df.agg(*[pearson("views", c).alias(c) for c in cols])
    stacked = one.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("correlation")) for c in cols
    ])).alias("r")).select("r.*")
    return (stacked.where(F.col("correlation").isNotNull() & ~F.isnan("correlation"))
            .select("metric", fixed("correlation", 4).alias("correlation"))
            .orderBy(F.col("correlation").desc(), "metric"))


def normal_range(df: DataFrame) -> DataFrame:
    """Quartiles of views (truncated to integers) and of engagement (3 decimals)."""
    v = exact_quantiles(df, "views", [0.25, 0.75], prefix="v").withColumn("_g", F.lit(0))
    e = exact_quantiles(df, "engagement_rate_pct", [0.25, 0.75], prefix="e").withColumn("_g", F.lit(0))
    return v.join(e, "_g").select(
        F.floor("v0").cast("bigint").alias("views_q1"), F.floor("v1").cast("bigint").alias("views_q3"),
        fixed("e0", 3).alias("engagement_q1"), fixed("e1", 3).alias("engagement_q3"))


def rolling_tail(df: DataFrame, n: int = 60) -> DataFrame:
    """The last ``n`` rows in load order (date, then id) with the rolling columns."""
    tail = df.orderBy(F.col("publish_date").desc(), F.col("video_id").desc()).limit(n)
    return tail.select(
        "video_id", F.date_format("publish_date", "yyyy-MM-dd").alias("publish_date"),
        fixed("rolling_views_7d", 4).alias("rolling_views_7d"),
        fixed("rolling_views_30d", 4).alias("rolling_views_30d"),
        fixed("rolling_engagement_30d", 4).alias("rolling_engagement_30d"),
    ).orderBy("publish_date", "video_id")

