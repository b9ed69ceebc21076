"""Column sets, fixed parameters and the filter value object."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values from here to SEED define the data contract and the output texts (must not change).
RAW_COLUMNS = [
    "video_id",
    "title",
    "category",
    "publish_date",
    "views",
    "watch_time_seconds",
    "likes",
    "comments",
    "shares",
    "thumbnail_style",
]
NUMERIC_COLUMNS = ["views", "watch_time_seconds", "likes", "comments", "shares"]
TEXT_COLUMNS = ["title", "category", "thumbnail_style"]

# Feature vector used by clustering and anomaly scoring.
FEATURE_COLUMNS = [
    "views",
    "engagement_rate",
    "avg_watch_time_seconds",
    "share_rate",
    "comment_rate",
    "like_rate",
]
# Metrics allowed in A/B comparisons.
AB_METRICS = ["views", "engagement_rate_pct", "avg_watch_time_seconds", "like_rate", "comment_rate", "share_rate"]
AB_DIMENSIONS = ["thumbnail_style", "category"]
# Columns correlated against views (views itself is dropped from the output).
CORRELATION_COLUMNS = [
    "views",
    "engagement_rate_pct",
    "avg_watch_time_seconds",
    "likes",
    "comments",
    "shares",
    "title_word_count",
    "days_since_publish",
    "views_per_day",
]
# Columns of the CSV export, in order.
EXPORT_COLUMNS = [
    "video_id", "title", "category", "publish_date", "thumbnail_style",
    "views", "likes", "comments", "shares", "watch_time_seconds",
    "engagement_rate_pct", "avg_watch_time_seconds", "like_rate",
    "comment_rate", "share_rate", "title_word_count", "days_since_publish",
    "views_per_day", "publish_weekday",
]

# Date spellings read besides ISO text, in order; month before day.
DATE_FORMATS = ("yyyy/M/d", "M/d/yyyy", "M/d/yyyy H:mm", "M/d/yyyy H:mm:ss", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy",
                "MMMM d, yyyy", "yyyyMMdd")
# Largest upload accepted, in bytes, and its file name ending.
UPLOAD_MAX_BYTES = 50 * 1024 * 1024
UPLOAD_SUFFIX = ".csv"

DEFAULT_CONTAMINATION = 0.04
CLUSTER_K_RANGE = [2, 3, 4, 5, 6]
CONTAMINATION_SWEEP = [0.02, 0.04, 0.06, 0.08, 0.10]
SEED = 42
# Output texts; %s and {} stand for values.
RECOMMEND_THUMBNAIL = "Use %s thumbnails as a test priority because they currently lead engagement in this slice."
RECOMMEND_CATEGORY = "%s videos are the strongest engagement segment right now, so they are a good place to double down."
RECOMMEND_WATCH_TIME = ("Investigate videos similar to '%s' because exceptionally high watch time often signals "
                        "repeatable content pacing.")
RECOMMEND_FEATURES = ("Track more features next, especially video duration, upload time, and audience source, because "
                      "current metadata explains only a small share of view variance.")
SEGMENT_HIGH_REACH_HIGH_ENGAGEMENT = "High reach, high engagement"
SEGMENT_NICHE = "Niche but sticky"
SEGMENT_BROAD_REACH = "Broad reach, lighter interaction"
SEGMENT_SHARED = "Share friendly"
SEGMENT_BALANCED = "Balanced performers"
INVALID_SCHEMA = "Dataset schema mismatch. Missing={}, Extra={}"
INVALID_IDS = "Found {} invalid video_id values"
INVALID_DATES = "Found {} invalid publish_date values"
INVALID_NUMBERS = "Found {} rows with invalid numeric values"
INVALID_NEGATIVE = "Found {} rows with negative metrics"
INVALID_VIEWS = "views must be strictly positive for all rows"
NO_ROWS = "No videos match the selected filters."
FEW_OBSERVATIONS = "Each variant needs at least 2 observations for a test."
FEW_VIDEOS = "Each keyword group needs at least 2 matching videos."
VERDICT_SIGNIFICANT = "The result is statistically significant — consider scaling the winner."
VERDICT_NOT_SIGNIFICANT = "The result is not statistically significant — gather more data before acting."
METHOD = "Welch's t-test (unequal variance)"
ROLLING_WINDOWS = {"rolling_views_7d": ("views", 7), "rolling_views_30d": ("views", 30),
                   "rolling_engagement_30d": ("engagement_rate_pct", 30)}

@dataclass(frozen=True)
class Filters:
    """Optional slice of the content table: category and inclusive date bounds."""

    category: str | None = None
    start_date: str | None = None
    end_date: str | None = None
