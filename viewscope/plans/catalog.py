"""Registered queries: Spark callable + DuckDB oracle per operator of the inventory.

Each Spark callable takes (spark, sf_dir) and returns a lazy DataFrame. The
oracle is an independent DuckDB statement over the same Parquet tables; a key
without an oracle is checked by row count only (model fits, streaming).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewscope.functions.numeric import fixed
from viewscope.operators import filters as FL
from viewscope.operators import quality as Q
from viewscope.operators import summary as S
from viewscope.operators import trends as TR
from viewscope.oracle import R, with_content
from viewscope.plans import report as RP
from viewscope.plans.content import content, content_table
from viewscope.schema import EXPORT_COLUMNS, Filters
from viewscope.session import scratch_path
from viewscope.sources.tables import table


@dataclass
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn):
        REGISTRY[name] = Query(fn, sql)
        return fn
    return wrap


# Fixed parameters of the registered queries.
SLICE = Filters(category="1-URGENT", start_date="1996-01-01", end_date="1996-12-31")
KEYWORD = "gear"

# ---------------------------------------------------------------- validation


@register("validation_report", with_content("""
SELECT count(*) AS rows_read, count(*) AS rows_loaded, count(*) - count(DISTINCT video_id)
       AS duplicate_video_ids_removed, 0::BIGINT AS invalid_video_ids, 0::BIGINT AS invalid_dates,
       0::BIGINT AS invalid_numeric_rows, 0::BIGINT AS negative_metric_rows, 0::BIGINT AS zero_view_rows,
       min(publish_date) AS date_min, max(publish_date) AS date_max
FROM content"""))
def q_validation_report(spark, d):
    return content_table(spark, d).report_df.drop("source_path", "malformed_rows")


@register("dedup_keep_first", """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                               ORDER BY l_partkey, l_suppkey, l_shipdate) AS rn
  FROM lineitem) WHERE rn = 1""")
def q_dedup_keep_first(spark, d):
    li = table(spark, d, "lineitem")
    return Q.dedup_keep_first(li, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_shipdate"])


@register("text_strip", r"""
SELECT conv_id, turn,
       regexp_replace(text, '^[\pZ\t-\r\x{85}]+|[\pZ\t-\r\x{85}]+$', '', 'g') AS text_stripped
FROM conversations""")
def q_text_strip(spark, d):
    conv = table(spark, d, "conversations")
    return conv.select("conv_id", "turn", Q.strip_text("text").alias("text_stripped"))


def _raw_from_lineitem(spark, d) -> DataFrame:
    """Raw text rows derived from lineitem with some values made invalid by rule."""
    li = table(spark, d, "lineitem")
    return li.select(
        F.when(F.col("l_linenumber") == 7, F.concat(F.lit("id-"), F.col("l_orderkey").cast("string")))
         .otherwise((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string")).alias("video_id"),
        F.col("l_returnflag").alias("title"),
        F.col("l_linestatus").alias("category"),
        F.when(F.col("l_linenumber") == 6, F.lit("not a date"))
         .otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("publish_date"),
        (F.col("l_quantity") - 5).cast("bigint").cast("string").alias("views"),
        F.when(F.col("l_linenumber") == 5, F.lit("n/a"))
         .otherwise(F.col("l_extendedprice").cast("string")).alias("watch_time_seconds"),
        F.col("l_linenumber").cast("string").alias("likes"),
        F.floor(F.col("l_tax") * 100 - 4).cast("string").alias("comments"),
        F.lit("0").alias("shares"),
        F.col("l_shipdate").cast("string").alias("thumbnail_style"),
        F.col("l_partkey").alias("ingest_seq"),
    )


@register("quarantine_split", """
WITH raw AS (
  SELECT CASE WHEN l_linenumber = 7 THEN NULL ELSE l_orderkey * 10 + l_linenumber END AS vid,
         CASE WHEN l_linenumber = 6 THEN NULL ELSE l_shipdate END AS pd,
         CAST(CAST(l_quantity - 5 AS BIGINT) AS DOUBLE) AS views,
         CASE WHEN l_linenumber = 5 THEN NULL ELSE l_extendedprice END AS wt,
         l_linenumber AS likes, CAST(floor(l_tax * 100 - 4) AS DOUBLE) AS comments
  FROM lineitem),
r AS (SELECT CASE WHEN vid IS NULL THEN 'invalid_video_id' WHEN pd IS NULL THEN 'invalid_date'
                  WHEN wt IS NULL THEN 'invalid_numeric'
                  WHEN views < 0 OR comments < 0 OR wt < 0 THEN 'negative_metric'
                  WHEN views <= 0 THEN 'zero_views' ELSE 'ok' END AS reject_reason
      FROM raw)
SELECT reject_reason, count(*) AS n_rows FROM r GROUP BY 1""")
def q_quarantine_split(spark, d):
    raw = _raw_from_lineitem(spark, d)
    typed = Q.coerce(raw)
    return (typed.select(F.coalesce("reject_reason", F.lit("ok")).alias("reject_reason"))
            .groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n_rows")))


# ---------------------------------------------------------------- derived columns


@register("enrich_rates", with_content("""
SELECT video_id, engagement_total, engagement_rate, engagement_rate_pct, avg_watch_time_seconds,
       like_rate, comment_rate, share_rate, watch_time_hours FROM enriched"""))
def q_enrich_rates(spark, d):
    return content(spark, d).select(
        "video_id", "engagement_total", "engagement_rate", "engagement_rate_pct", "avg_watch_time_seconds",
        "like_rate", "comment_rate", "share_rate", "watch_time_hours")


@register("enrich_calendar", with_content("SELECT video_id, publish_month, publish_weekday FROM enriched"))
def q_enrich_calendar(spark, d):
    return content(spark, d).select("video_id", "publish_month", "publish_weekday")


@register("title_word_count", with_content("SELECT video_id, title_word_count FROM enriched"))
def q_title_word_count(spark, d):
    return content(spark, d).select("video_id", "title_word_count")


@register("recency_metrics", with_content("SELECT video_id, days_since_publish, views_per_day FROM enriched"))
def q_recency_metrics(spark, d):
    return content(spark, d).select("video_id", "days_since_publish", "views_per_day")


def _rolling_query(col: str):
    def run(spark, d):
        return content(spark, d).select("video_id", "publish_date", fixed(col, 6).alias(col))
    return run


for _col in ("rolling_views_7d", "rolling_views_30d", "rolling_engagement_30d"):
    register(_col, with_content(f"SELECT video_id, publish_date, {R(_col, 6)} AS {_col} FROM enriched"))(
        _rolling_query(_col))


# ---------------------------------------------------------------- filters


@register("filter_content", with_content("""
SELECT video_id, category, publish_date, views FROM enriched
WHERE category = '1-URGENT' AND publish_date >= DATE '1996-01-01'
  AND CAST(publish_date AS TIMESTAMP) <= TIMESTAMP '1996-12-31 00:00:00'"""))
def q_filter_content(spark, d):
    return FL.filter_content(content(spark, d), SLICE).select("video_id", "category", "publish_date", "views")


@register("filter_options", with_content("""
SELECT 'category' AS kind, 'all' AS value FROM (SELECT 1 FROM enriched LIMIT 1)
UNION ALL SELECT DISTINCT 'category', category FROM enriched
UNION ALL SELECT DISTINCT 'thumbnail_style', thumbnail_style FROM enriched
UNION ALL SELECT 'date_min', strftime(min(publish_date), '%Y-%m-%d') FROM enriched
UNION ALL SELECT 'date_max', strftime(max(publish_date), '%Y-%m-%d') FROM enriched"""))
def q_filter_options(spark, d):
    return FL.filter_options(content(spark, d))


@register("title_keyword_filter", with_content(f"""
SELECT video_id, title FROM enriched WHERE contains(lower(title), lower('{KEYWORD}'))"""))
def q_title_keyword_filter(spark, d):
    return FL.title_keyword_filter(content(spark, d), KEYWORD).select("video_id", "title")


# ---------------------------------------------------------------- aggregations

_CARD_SQL = f"""video_id, title, category, thumbnail_style, publish_date, views,
       {R('engagement_rate_pct', 3)} AS engagement_rate_pct,
       {R('avg_watch_time_seconds', 2)} AS avg_watch_time_seconds"""


@register("kpi_totals", with_content(f"""
SELECT count(*) AS videos, sum(views)::BIGINT AS total_views,
       {R('sum(watch_time_hours)', 2)} AS total_watch_time_hours,
       {R('avg(views)', 2)} AS avg_views,
       {R('avg(engagement_rate_pct)', 3)} AS avg_engagement_rate_pct,
       {R('avg(avg_watch_time_seconds)', 2)} AS avg_watch_time_seconds,
       CAST(floor(quantile_cont(views, 0.5)) AS BIGINT) AS median_views
FROM enriched"""))
def q_kpi_totals(spark, d):
    return S.kpi_totals(content(spark, d))


@register("top_video_by_views", with_content(f"""
SELECT {_CARD_SQL} FROM enriched ORDER BY views DESC, video_id LIMIT 1"""))
def q_top_video_by_views(spark, d):
    return S.top_video_by_views(content(spark, d))


@register("top_video_by_engagement", with_content(f"""
SELECT {_CARD_SQL} FROM enriched ORDER BY engagement_rate DESC, video_id LIMIT 1"""))
def q_top_video_by_engagement(spark, d):
    return S.top_video_by_engagement(content(spark, d))


@register("top_watch_time", with_content(f"""
SELECT {_CARD_SQL} FROM enriched ORDER BY avg_watch_time_seconds DESC, video_id LIMIT 1"""))
def q_top_watch_time(spark, d):
    return S.top_watch_time(content(spark, d))


def _breakdown_sql(key: str, with_watch: bool = True) -> str:
    watch = f", {R('avg(avg_watch_time_seconds)', 4)} AS avg_watch_time_seconds" if with_watch else ""
    return with_content(f"""
SELECT {key}, count(video_id) AS videos, {R('avg(views)', 4)} AS avg_views,
       {R('avg(engagement_rate_pct)', 4)} AS avg_engagement_rate_pct{watch}
FROM enriched GROUP BY {key}""")


@register("by_category", _breakdown_sql("category"))
def q_by_category(spark, d):
    return S.by_category(content(spark, d))


@register("by_thumbnail_style", _breakdown_sql("thumbnail_style"))
def q_by_thumbnail_style(spark, d):
    return S.by_thumbnail_style(content(spark, d))


@register("monthly", _breakdown_sql("publish_month", with_watch=False))
def q_monthly(spark, d):
    return S.monthly(content(spark, d))


def _lift_sql(key: str) -> str:
    return with_content(f"""
SELECT {key}, {R('avg(views)', 4)} AS views, {R('avg(engagement_rate_pct)', 4)} AS engagement_rate_pct,
       {R('avg(avg_watch_time_seconds)', 4)} AS avg_watch_time_seconds
FROM enriched GROUP BY {key}""")


@register("category_lift", _lift_sql("category"))
def q_category_lift(spark, d):
    return TR.category_lift(content(spark, d))


@register("thumbnail_lift", _lift_sql("thumbnail_style"))
def q_thumbnail_lift(spark, d):
    return TR.thumbnail_lift(content(spark, d))


@register("weekday_lift", _lift_sql("publish_weekday"))
def q_weekday_lift(spark, d):
    return TR.weekday_lift(content(spark, d))


@register("weekday_calendar", with_content(f"""
SELECT publish_weekday, CAST(min(isodow(publish_date)) AS INTEGER) AS weekday_index,
       {R('avg(views)', 4)} AS views, {R('avg(engagement_rate_pct)', 4)} AS engagement_rate_pct,
       {R('avg(avg_watch_time_seconds)', 4)} AS avg_watch_time_seconds
FROM enriched GROUP BY publish_weekday"""))
def q_weekday_calendar(spark, d):
    return TR.weekday_calendar(content(spark, d))


def _corr_sql() -> str:
    cols = ["engagement_rate_pct", "avg_watch_time_seconds", "likes", "comments", "shares",
            "title_word_count", "days_since_publish", "views_per_day"]
    parts = []
    for c in cols:
        parts.append(f"SELECT '{c}' AS metric, CASE WHEN stddev_pop(views) * stddev_pop({c}) = 0 THEN NULL "
                     f"ELSE covar_pop(views, {c}) / (stddev_pop(views) * stddev_pop({c})) END AS correlation "
                     f"FROM enriched")
    return with_content(f"""
SELECT metric, {R('correlation', 4)} AS correlation FROM ({' UNION ALL '.join(parts)}) t
WHERE correlation IS NOT NULL AND NOT isnan(correlation)""")


@register("correlations_to_views", _corr_sql())
def q_correlations_to_views(spark, d):
    return TR.correlations_to_views(content(spark, d))


@register("normal_range", with_content(f"""
SELECT CAST(floor(quantile_cont(views, 0.25)) AS BIGINT) AS views_q1,
       CAST(floor(quantile_cont(views, 0.75)) AS BIGINT) AS views_q3,
       {R('quantile_cont(engagement_rate_pct, 0.25)', 3)} AS engagement_q1,
       {R('quantile_cont(engagement_rate_pct, 0.75)', 3)} AS engagement_q3
FROM enriched"""))
def q_normal_range(spark, d):
    return TR.normal_range(content(spark, d))


@register("best_segments", with_content(f"""
(SELECT 'category' AS dimension, category AS value, {R('avg(engagement_rate_pct)', 4)} AS avg_engagement_rate_pct
 FROM enriched GROUP BY category ORDER BY avg(engagement_rate_pct) DESC, category LIMIT 1)
UNION ALL
(SELECT 'thumbnail_style', thumbnail_style, {R('avg(engagement_rate_pct)', 4)}
 FROM enriched GROUP BY thumbnail_style ORDER BY avg(engagement_rate_pct) DESC, thumbnail_style LIMIT 1)"""))
def q_best_segments(spark, d):
    return S.best_segments(content(spark, d))


@register("recommendations", with_content("""
SELECT 1 AS line_no, 'Use ' || (SELECT thumbnail_style FROM enriched GROUP BY 1
        ORDER BY avg(engagement_rate_pct) DESC, 1 LIMIT 1)
    || ' thumbnails as a test priority because they currently lead engagement in this slice.' AS text
UNION ALL
SELECT 2, (SELECT list_aggr(list_transform(regexp_extract_all(lower(category), '(\\pL+|[^\\pL]+)'),
                  lambda x: upper(x[1]) || x[2:]), 'string_agg', '')
           FROM (SELECT category FROM enriched GROUP BY 1 ORDER BY avg(engagement_rate_pct) DESC, 1 LIMIT 1))
    || ' videos are the strongest engagement segment right now, so they are a good place to double down.'
UNION ALL
SELECT 3, 'Investigate videos similar to ''' || (SELECT title FROM enriched
        ORDER BY avg_watch_time_seconds DESC, video_id LIMIT 1)
    || ''' because exceptionally high watch time often signals repeatable content pacing.'
UNION ALL
SELECT 4, 'Track more features next, especially video duration, upload time, and audience source, because '
    || 'current metadata explains only a small share of view variance.'"""))
def q_recommendations(spark, d):
    return S.recommendations(content(spark, d))


# ---------------------------------------------------------------- windows, top-k, reports


@register("rolling_tail", with_content(f"""
SELECT video_id, strftime(publish_date, '%Y-%m-%d') AS publish_date,
       {R('rolling_views_7d', 4)} AS rolling_views_7d, {R('rolling_views_30d', 4)} AS rolling_views_30d,
       {R('rolling_engagement_30d', 4)} AS rolling_engagement_30d
FROM enriched ORDER BY enriched.publish_date DESC, video_id DESC LIMIT 60"""))
def q_rolling_tail(spark, d):
    return TR.rolling_tail(content(spark, d))


def _top_sql(n: int) -> str:
    return with_content(f"""
SELECT video_id, title, category, publish_date, thumbnail_style, views,
       {R('engagement_rate_pct', 4)} AS engagement_rate_pct,
       {R('avg_watch_time_seconds', 4)} AS avg_watch_time_seconds
FROM enriched ORDER BY views DESC, video_id LIMIT {n}""")


@register("top_videos", _top_sql(100))
def q_top_videos(spark, d):
    return S.top_videos(content(spark, d), 100)


@register("report_top10", _top_sql(10))
def q_report_top10(spark, d):
    return S.report_top10(content(spark, d))


@register("csv_export", with_content(f"SELECT {', '.join(EXPORT_COLUMNS)} FROM enriched"))
def q_csv_export(spark, d):
    return content(spark, d).select(*EXPORT_COLUMNS)


@register("csv_export_written", with_content(f"""
SELECT {', '.join("strftime(publish_date, '%Y-%m-%d') AS publish_date" if c == 'publish_date' else c for c in EXPORT_COLUMNS)}
FROM enriched WHERE category = '1-URGENT' AND publish_date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'"""))
def q_csv_export_written(spark, d):
    """K1: the export of a slice as CSV files, read back."""
    path = scratch_path(spark, "csv-export")
    RP.write_csv_export(content(spark, d), path, SLICE)
    return RP.read_csv_export(spark, path)


@register("report_overview", with_content("""
SELECT count(*) AS videos, min(publish_date) AS date_min, max(publish_date) AS date_max FROM enriched"""))
def q_report_overview(spark, d):
    return content(spark, d).agg(F.count(F.lit(1)).alias("videos"), F.min("publish_date").alias("date_min"),
                                 F.max("publish_date").alias("date_max"))


# ---------------------------------------------------------------- text

from viewscope.functions.textfn import english_stop_words  # noqa: E402
from viewscope.operators import text as X  # noqa: E402
from viewscope.operators import abtest as AB  # noqa: E402
from viewscope.sources.tables import documents_as_content  # noqa: E402

ANCHOR_ID = 1
TOP_N = 5


def _terms_sql_cte(src: str = "enriched") -> str:
    stops = ", ".join("'" + w.replace("'", "''") + "'" for w in english_stop_words())
    return f"""
tok AS (SELECT video_id, list_filter(regexp_extract_all(lower(title), '\\b[a-zA-Z][a-zA-Z]+\\b'),
                                     lambda w: NOT list_contains([{stops}], w)) AS u
        FROM {src}),
trm AS (SELECT video_id, list_concat(u, list_transform(range(1, len(u)), lambda i: u[i] || ' ' || u[i + 1])) AS t
        FROM tok),
tf AS (SELECT video_id, term, count(*) AS tf FROM (SELECT video_id, unnest(t) AS term FROM trm) GROUP BY 1, 2),
dfq AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM {src})) / (1 + df)) + 1 AS idf FROM dfq),
raw AS (SELECT video_id, term, tf, idf, tf * idf AS w FROM tf JOIN idf USING (term)),
nrm AS (SELECT video_id, sqrt(sum(w * w)) AS norm FROM raw GROUP BY 1),
post AS (SELECT video_id, term, tf, idf, w / norm AS weight FROM raw JOIN nrm USING (video_id))"""


@register("title_tokens", with_content("""
SELECT video_id, CAST(unnest(generate_series(0, len(t) - 1)) AS INTEGER) AS position, unnest(t) AS term FROM trm""",
                                        _terms_sql_cte()))
def q_title_tokens(spark, d):
    return X.title_terms(content(spark, d))


@register("title_tfidf", with_content(f"""
SELECT video_id, term, tf, {R('idf', 8)} AS idf, {R('weight', 8)} AS weight FROM post""", _terms_sql_cte()))
def q_title_tfidf(spark, d):
    return X.tfidf(content(spark, d)).select(
        "video_id", "term", "tf", fixed("idf", 8).alias("idf"), fixed("weight", 8).alias("weight"))


@register("similar_titles", with_content(f"""
SELECT video_id, title, category, thumbnail_style, views,
       {R('engagement_rate_pct', 4)} AS engagement_rate_pct, {R('sim', 4)} AS similarity
FROM (SELECT e.video_id, e.title, e.category, e.thumbnail_style, e.views, e.engagement_rate_pct,
             coalesce(s.sim, 0.0) AS sim
      FROM enriched e LEFT JOIN (
          SELECT p.video_id, sum(p.weight * a.weight) AS sim
          FROM post p JOIN (SELECT term, weight FROM post WHERE video_id = {ANCHOR_ID}) a USING (term)
          GROUP BY 1) s USING (video_id)
      WHERE e.video_id <> {ANCHOR_ID})
ORDER BY {R('sim', 10)} DESC, video_id LIMIT {TOP_N}""", _terms_sql_cte()))
def q_similar_titles(spark, d):
    from viewscope.plans.content import title_index
    return X.similar_titles(content(spark, d), ANCHOR_ID, TOP_N, postings=title_index(spark, d))


@register("similar_titles_report", with_content(f"""
SELECT 0 AS rank, video_id, title, category, thumbnail_style, views, {R('engagement_rate_pct', 4)} AS engagement_rate_pct,
       CAST(NULL AS DOUBLE) AS similarity FROM enriched WHERE video_id = {ANCHOR_ID}
UNION ALL
(SELECT CAST(row_number() OVER (ORDER BY {R('sim', 4)} DESC, video_id) AS INTEGER), video_id, title, category,
        thumbnail_style, views, {R('engagement_rate_pct', 4)}, {R('sim', 4)}
 FROM (SELECT e.*, coalesce(s.sim, 0.0) AS sim
       FROM enriched e LEFT JOIN (
           SELECT p.video_id, sum(p.weight * a.weight) AS sim
           FROM post p JOIN (SELECT term, weight FROM post WHERE video_id = {ANCHOR_ID}) a USING (term)
           GROUP BY 1) s USING (video_id)
       WHERE e.video_id <> {ANCHOR_ID} ORDER BY {R('coalesce(s.sim, 0.0)', 10)} DESC, video_id LIMIT {TOP_N}))""",
                                                _terms_sql_cte()))
def q_similar_titles_report(spark, d):
    from viewscope.plans.content import title_index
    return X.similar_report(content(spark, d), ANCHOR_ID, TOP_N, postings=title_index(spark, d))


@register("title_token_lift", with_content(f"""
SELECT term, {R('lift', 4)} AS lift FROM (
  SELECT term, sum(CASE WHEN high THEN weight ELSE 0 END) / any_value(sz.nh)
             - sum(CASE WHEN NOT high THEN weight ELSE 0 END) / any_value(sz.nr) AS lift
  FROM post JOIN fl USING (video_id) CROSS JOIN sz GROUP BY term
  ORDER BY {R('lift', 10)} DESC, term LIMIT 12)
WHERE lift > 0""", _terms_sql_cte() + """,
fl AS (SELECT video_id, views >= (SELECT quantile_cont(views, 0.75) FROM enriched) AS high FROM enriched),
sz AS (SELECT count(*) FILTER (WHERE high) AS nh, count(*) FILTER (WHERE NOT high) AS nr FROM fl)"""))
def q_title_token_lift(spark, d):
    return X.token_lift(content(spark, d), "views", 12)


@register("document_token_lift")
def q_document_token_lift(spark, d):
    """X4 over whole documents (length as the target); rows-only: Unicode word boundaries differ in DuckDB."""
    return X.token_lift(documents_as_content(spark, d), "views", 12)


# ---------------------------------------------------------------- A/B tests

AB_ATTR = ("thumbnail_style", "AUTOMOBILE", "BUILDING", "views")
AB_CAT = ("category", "1-URGENT", "5-LOW", "engagement_rate_pct")
AB_TITLE = ("gear", "widget", "views")


def _ab_sql(variant_rows: str, label_a: str, label_b: str, metric: str, cols: str) -> str:
    return with_content(f"""
SELECT {cols} FROM (
  SELECT '{metric}' AS metric, '{label_a}' AS label_a, a.n AS n_a, a.mean AS mean_a, a.std AS std_a,
         a.median AS median_a, '{label_b}' AS label_b, b.n AS n_b, b.mean AS mean_b, b.std AS std_b,
         b.median AS median_b, a.std * a.std / a.n AS va, b.std * b.std / b.n AS vb,
         sqrt(((a.n - 1) * a.std * a.std + (b.n - 1) * b.std * b.std) / (a.n + b.n - 2)) AS pooled
  FROM (SELECT * FROM st WHERE variant = 'A') a, (SELECT * FROM st WHERE variant = 'B') b) w""", f"""
vr AS ({variant_rows}),
st AS (SELECT variant, count(*) AS n, avg(x) AS mean, stddev_samp(x) AS std, quantile_cont(x, 0.5) AS median
       FROM vr GROUP BY 1)""")


_AB_ALL_COLS = f"""metric, label_a, n_a, {R('mean_a', 4)} AS mean_a, {R('std_a', 4)} AS std_a,
  {R('median_a', 4)} AS median_a, label_b, n_b, {R('mean_b', 4)} AS mean_b, {R('std_b', 4)} AS std_b,
  {R('median_b', 4)} AS median_b, {R('(mean_a - mean_b) / sqrt(va + vb)', 4)} AS t_statistic,
  {R('(va + vb) * (va + vb) / (va * va / (n_a - 1) + vb * vb / (n_b - 1))', 2)} AS degrees_of_freedom,
  {R('CASE WHEN pooled > 0 THEN (mean_a - mean_b) / pooled ELSE 0 END', 4)} AS cohens_d,
  CASE WHEN abs(CASE WHEN pooled > 0 THEN (mean_a - mean_b) / pooled ELSE 0 END) >= 0.8 THEN 'large'
       WHEN abs(CASE WHEN pooled > 0 THEN (mean_a - mean_b) / pooled ELSE 0 END) >= 0.5 THEN 'medium'
       WHEN abs(CASE WHEN pooled > 0 THEN (mean_a - mean_b) / pooled ELSE 0 END) >= 0.2 THEN 'small'
       ELSE 'negligible' END AS effect_size,
  {R('abs(mean_a - mean_b) / greatest(least(abs(mean_a), abs(mean_b)), 1e-9) * 100', 2)} AS difference_pct,
  CASE WHEN mean_a > mean_b THEN label_a ELSE label_b END AS winner, CAST(NULL AS VARCHAR) AS error"""


def _attr_rows(dim, a, b, metric):
    return (f"SELECT CASE WHEN {dim} = '{a}' THEN 'A' ELSE 'B' END AS variant, CAST({metric} AS DOUBLE) AS x "
            f"FROM enriched WHERE {dim} IN ('{a}', '{b}')")


def _title_rows(ka, kb, metric):
    return (f"SELECT 'A' AS variant, CAST({metric} AS DOUBLE) AS x FROM enriched "
            f"WHERE contains(lower(title), '{ka.lower()}') UNION ALL "
            f"SELECT 'B', CAST({metric} AS DOUBLE) FROM enriched WHERE contains(lower(title), '{kb.lower()}')")


@register("ab_group_stats", with_content(f"""
SELECT variant, count(*) AS n, {R('avg(x)', 4)} AS mean, {R('stddev_samp(x)', 4)} AS std,
       {R('quantile_cont(x, 0.5)', 4)} AS median FROM vr GROUP BY 1""", f"vr AS ({_attr_rows(*AB_ATTR)})"))
def q_ab_group_stats(spark, d):
    v = AB.attribute_variants(content(spark, d), *AB_ATTR)
    return AB.group_stats(v).select("variant", "n", fixed("mean", 4).alias("mean"), fixed("std", 4).alias("std"),
                                    fixed("median", 4).alias("median"))


@register("ab_test_attribute", _ab_sql(_attr_rows(*AB_ATTR), AB_ATTR[1], AB_ATTR[2], AB_ATTR[3], _AB_ALL_COLS))
def q_ab_test_attribute(spark, d):
    return AB.ab_test_attribute(content(spark, d), *AB_ATTR, with_p=False)


@register("ab_test_title", _ab_sql(_title_rows(*AB_TITLE), f'"{AB_TITLE[0]}"', f'"{AB_TITLE[1]}"', AB_TITLE[2],
                                   _AB_ALL_COLS))
def q_ab_test_title(spark, d):
    return AB.ab_test_title(content(spark, d), *AB_TITLE, with_p=False)


@register("ab_welch", _ab_sql(_attr_rows(*AB_CAT), AB_CAT[1], AB_CAT[2], AB_CAT[3], f"""metric,
  {R('(mean_a - mean_b) / sqrt(va + vb)', 4)} AS t_statistic,
  {R('(va + vb) * (va + vb) / (va * va / (n_a - 1) + vb * vb / (n_b - 1))', 2)} AS degrees_of_freedom"""))
def q_ab_welch(spark, d):
    return AB.ab_test_attribute(content(spark, d), *AB_CAT, with_p=False).select(
        "metric", "t_statistic", "degrees_of_freedom")


@register("ab_effect", _ab_sql(_attr_rows(*AB_CAT), AB_CAT[1], AB_CAT[2], AB_CAT[3], f"""
  {R('CASE WHEN pooled > 0 THEN (mean_a - mean_b) / pooled ELSE 0 END', 4)} AS cohens_d,
  CASE WHEN abs(CASE WHEN pooled > 0 THEN (mean_a - mean_b) / pooled ELSE 0 END) >= 0.8 THEN 'large'
       WHEN abs(CASE WHEN pooled > 0 THEN (mean_a - mean_b) / pooled ELSE 0 END) >= 0.5 THEN 'medium'
       WHEN abs(CASE WHEN pooled > 0 THEN (mean_a - mean_b) / pooled ELSE 0 END) >= 0.2 THEN 'small'
       ELSE 'negligible' END AS effect_size,
  {R('abs(mean_a - mean_b) / greatest(least(abs(mean_a), abs(mean_b)), 1e-9) * 100', 2)} AS difference_pct,
  CASE WHEN mean_a > mean_b THEN label_a ELSE label_b END AS winner"""))
def q_ab_effect(spark, d):
    return AB.ab_test_attribute(content(spark, d), *AB_CAT, with_p=False).select(
        "cohens_d", "effect_size", "difference_pct", "winner")


@register("ab_test_full")
def q_ab_test_full(spark, d):
    """P-value, confidence interval, tier and verdict (Student t has no SQL oracle)."""
    return AB.ab_test_attribute(content(spark, d), *AB_ATTR, with_p=True)


@register("ab_test_title_full")
def q_ab_test_title_full(spark, d):
    return AB.ab_test_title(content(spark, d), *AB_TITLE, with_p=True)


# ---------------------------------------------------------------- models

from viewscope.operators import models as M  # noqa: E402
from viewscope.operators import signal as SG  # noqa: E402
from viewscope.schema import FEATURE_COLUMNS  # noqa: E402

_Z = [f"z_{c}" for c in FEATURE_COLUMNS]
_Z_SQL = ",\n".join(
    f"coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0), 0) AS z_{c}" for c in FEATURE_COLUMNS)
_ZCTE = f"""zf AS (SELECT video_id, category, {_Z_SQL} FROM enriched),
cs AS (SELECT category AS c, count(*) AS n, {', '.join(f'sum(z_{c}) AS s_{c}' for c in FEATURE_COLUMNS)},
              sum({' + '.join(f'z_{c} * z_{c}' for c in FEATURE_COLUMNS)}) AS q
       FROM zf GROUP BY 1)"""


@register("standardized_features", with_content(
    f"SELECT video_id, {', '.join(R(f'z_{c}', 6) + f' AS z_{c}' for c in FEATURE_COLUMNS)} FROM zf", _ZCTE))
def q_standardized_features(spark, d):
    z = M.standardize(content(spark, d))
    return z.select("video_id", *[fixed(c, 6).alias(c) for c in _Z])


_SQ = " + ".join(f"z_{c} * z_{c}" for c in FEATURE_COLUMNS)
_DOT = " + ".join(f"z_{c} * s_{c}" for c in FEATURE_COLUMNS)


@register("silhouette_by_group", with_content(f"""
SELECT {R('avg(CASE WHEN own_n <= 1 OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END)', 6)} AS silhouette
FROM (SELECT video_id,
             max(CASE WHEN own THEN n END) AS own_n,
             max(CASE WHEN own THEN tot / (n - 1) END) AS a,
             min(CASE WHEN NOT own THEN tot / n END) AS b
      FROM (SELECT video_id, zf.category = cs.c AS own, cs.n,
                   ({_SQ}) * cs.n - 2 * ({_DOT}) + cs.q AS tot
            FROM zf JOIN cs ON TRUE) GROUP BY video_id)""", _ZCTE))
def q_silhouette_by_group(spark, d):
    z = M.standardize(content(spark, d), keep=["video_id", "category"])
    return M.silhouette(z, "category", _Z).select(fixed("silhouette", 6).alias("silhouette"))


@register("inertia_by_group", with_content(f"""
SELECT {R('sum(q - (' + ' + '.join(f's_{c} * s_{c}' for c in FEATURE_COLUMNS) + ') / n)', 4)} AS inertia
FROM cs""", _ZCTE))
def q_inertia_by_group(spark, d):
    z = M.standardize(content(spark, d), keep=["video_id", "category"])
    return M.inertia(z, "category", _Z).select(fixed("inertia", 4).alias("inertia"))


@register("segment_labels", with_content(f"""
SELECT category, videos, {R('avg_views', 4)} AS avg_views, {R('avg_engagement_rate_pct', 4)} AS avg_engagement_rate_pct,
       {R('avg_watch_time_seconds', 4)} AS avg_watch_time_seconds, {R('avg_share_rate', 6)} AS avg_share_rate,
       CASE WHEN hv AND he THEN 'High reach, high engagement' WHEN NOT hv AND he THEN 'Niche but sticky'
            WHEN hv AND NOT he THEN 'Broad reach, lighter interaction' WHEN hs THEN 'Share friendly'
            ELSE 'Balanced performers' END AS label
FROM (SELECT *, avg_views >= median(avg_views) OVER () AS hv,
                avg_engagement_rate_pct >= median(avg_engagement_rate_pct) OVER () AS he,
                avg_share_rate >= median(avg_share_rate) OVER () AS hs
      FROM (SELECT category, count(*) AS videos, avg(views) AS avg_views,
                   avg(engagement_rate_pct) AS avg_engagement_rate_pct,
                   avg(avg_watch_time_seconds) AS avg_watch_time_seconds, avg(share_rate) AS avg_share_rate
            FROM enriched GROUP BY 1))"""))
def q_segment_labels(spark, d):
    s = M.segment_labels(M.segment_summary(content(spark, d), "category"))
    return s.select("category", "videos", fixed("avg_views", 4).alias("avg_views"),
                    fixed("avg_engagement_rate_pct", 4).alias("avg_engagement_rate_pct"),
                    fixed("avg_watch_time_seconds", 4).alias("avg_watch_time_seconds"),
                    fixed("avg_share_rate", 6).alias("avg_share_rate"), "label")


@register("percentile_flag", with_content(f"""
SELECT count(*) FILTER (WHERE views > (SELECT quantile_cont(views, 0.96) FROM enriched)) AS flagged,
       count(*) AS rows, {R('(SELECT quantile_cont(views, 0.96) FROM enriched)', 4)} AS threshold
FROM enriched"""))
def q_percentile_flag(spark, d):
    return M.percentile_flag(content(spark, d), "views", 0.04)


@register("r2_group_mean", with_content(f"""
SELECT {R('1 - sum((y - gm) * (y - gm)) / sum((y - mu) * (y - mu))', 6)} AS r2
FROM (SELECT ln(1 + views) AS y, avg(ln(1 + views)) OVER (PARTITION BY category) AS gm,
             avg(ln(1 + views)) OVER () AS mu FROM enriched)"""))
def q_r2_group_mean(spark, d):
    return M.r2_group_mean(content(spark, d), "category")


@register("clusters")
def q_clusters(spark, d):
    return M.clusters(content(spark, d))


@register("cluster_points")
def q_cluster_points(spark, d):
    return M.cluster_points(content(spark, d))


@register("cluster_sweep")
def q_cluster_sweep(spark, d):
    return M.cluster_sweep(content(spark, d))


@register("anomaly_scores")
def q_anomaly_scores(spark, d):
    return M.anomaly_scores(content(spark, d)).select("video_id", fixed("anomaly_score", 6).alias("anomaly_score"))


@register("anomalies")
def q_anomalies(spark, d):
    return M.anomalies(content(spark, d), 0.04)


@register("anomaly_sweep")
def q_anomaly_sweep(spark, d):
    return M.anomaly_sweep(content(spark, d))


@register("metadata_signal")
def q_metadata_signal(spark, d):
    return SG.metadata_signal(content(spark, d))[0]


@register("metadata_top_features")
def q_metadata_top_features(spark, d):
    return SG.metadata_signal(content(spark, d))[1]


# ---------------------------------------------------------------- streaming refresh

import os as _os  # noqa: E402
import uuid as _uuid  # noqa: E402

from viewscope.schema import UPLOAD_MAX_BYTES  # noqa: E402
from viewscope.session import checkpoint_dir, materialize, release  # noqa: E402
from viewscope.sources.tables import content_from_tables  # noqa: E402
from viewscope.streaming import refresh as RF  # noqa: E402


@register("upload_refresh")
def q_upload_refresh(spark, d):
    """ST1: land valid uploads and uploads with an extra column; return the refresh log.

    There are two uploads of each kind, and more once two would be longer than an upload may be.
    """
    root = _os.path.join(checkpoint_dir(spark), f"refresh-{_uuid.uuid4().hex[:12]}")
    landing = _os.path.join(root, "landing")
    written: list[str] = []
    raw = materialize(content_from_tables(spark, d).withColumn("publish_date", F.date_format("publish_date", "yyyy-MM-dd")),
                      "uploads", written)
    line = F.concat_ws(",", *[F.col(c).cast("string") for c in raw.columns], F.lit("x"))
    length = raw.agg(F.sum(F.octet_length(line) + 1)).first()[0] or 0
    uploads = max(2, -(-int(length * 1.25) // UPLOAD_MAX_BYTES))       # with room for quotes and uneven shares
    raw.repartition(uploads).write.option("header", True).csv(_os.path.join(landing, "a_valid"))
    raw.withColumn("extra", F.lit("x")).repartition(uploads).write.option("header", True).csv(
        _os.path.join(landing, "b_extra_column"))
    release(spark, written)
    q = RF.run_refresh(spark, _os.path.join(landing, "*"), _os.path.join(root, "snapshots"),
                       _os.path.join(root, "log"), _os.path.join(root, "stream-checkpoint"))
    q.awaitTermination()
    return RF.refresh_log(spark, _os.path.join(root, "log")).select(
        "batch_id", "status", "rows_loaded", "error").orderBy("batch_id")


# ---------------------------------------------------------------- windows with peers, dirty uploads, rounding, pages

from viewscope.functions.numeric import round_records  # noqa: E402
from viewscope.operators import enrich as EN  # noqa: E402
from viewscope.oracle import RE, on_slice  # noqa: E402
from viewscope.schema import RAW_COLUMNS, ROLLING_WINDOWS  # noqa: E402
from viewscope.sources.files import read_raw_csv  # noqa: E402


def _range_frame(col: str, days: int, order: str, back: str) -> str:
    return f"{R(f'avg({col}) OVER (ORDER BY {order} RANGE BETWEEN INTERVAL {back} PRECEDING AND CURRENT ROW)', 6)}"


@register("rolling_peers", with_content("SELECT video_id, " + ", ".join(
    f"{_range_frame(src, n, 'publish_date', f'{n - 1} DAYS')} AS {out}" for out, (src, n) in ROLLING_WINDOWS.items())
    + " FROM enriched"))
def q_rolling_peers(spark, d):
    """W1-W3 with ``ties='peers'``: rows of one date share their means, as in a RANGE frame."""
    rows = content(spark, d).drop(*ROLLING_WINDOWS)
    return EN.rolling_means(rows, ties="peers").select(
        "video_id", *[fixed(c, 6).alias(c) for c in ROLLING_WINDOWS])


def _hourly_events(spark, d) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("video_id"), F.col("value").alias("views"),
                                            F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("publish_date"))


_HOURLY = "(SELECT event_id, value, date_trunc('hour', ts) AS h FROM events)"
_BACK_7D = "'6 days 23:59:59.999999'"      # the frame is (t - 7 days, t]


@register("event_rolling_peers", f"""
SELECT event_id AS video_id, {_range_frame('value', 7, 'h', _BACK_7D)} AS rolling_7d FROM {_HOURLY}""")
def q_event_rolling_peers(spark, d):
    """Rolling means over times of day: all rows of an hour are peers."""
    return EN.rolling_means(_hourly_events(spark, d), {"rolling_7d": ("views", 7)}, ties="peers").select(
        "video_id", fixed("rolling_7d", 6).alias("rolling_7d"))


@register("event_rolling_7d", f"""
WITH e AS {_HOURLY},
p AS (SELECT event_id, h, count(*) OVER (PARTITION BY h ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS n,
             sum(value) OVER (PARTITION BY h ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS s FROM e),
g AS (SELECT h, count(*) AS n, sum(value) AS s FROM e GROUP BY h),
b AS (SELECT h, coalesce(sum(n) OVER w, 0) AS n, coalesce(sum(s) OVER w, 0) AS s FROM g
      WINDOW w AS (ORDER BY h RANGE BETWEEN INTERVAL {_BACK_7D} PRECEDING AND INTERVAL 1 HOUR PRECEDING))
SELECT event_id AS video_id, {R('(b.s + p.s) / (b.n + p.n)', 6)} AS rolling_7d FROM p JOIN b USING (h)""")
def q_event_rolling_7d(spark, d):
    """Rolling means over times of day: rows of an hour count up to themselves in id order."""
    return EN.rolling_means(_hourly_events(spark, d), {"rolling_7d": ("views", 7)}).select(
        "video_id", fixed("rolling_7d", 6).alias("rolling_7d"))


_ORDERED = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_tax"]


DIRTY_ROWS_PER_FILE = 500_000


def write_dirty_csv(spark, d, path: str) -> None:
    """CSV files of lineitem rows, some made unreadable or invalid by rule, in the order of ``_ORDERED``."""
    line, order = F.col("l_linenumber"), F.col("l_orderkey")
    day = F.col("l_shipdate").cast("date")
    fields = [
        F.when(line == 7, F.concat(F.lit("id-"), order.cast("string"))).otherwise((order * 10 + line).cast("string")),
        F.col("l_returnflag"), F.col("l_linestatus"),
        F.when((line == 6) & (order % 2 == 0), F.lit("not a date")).when(line == 5, F.date_format(day, "M/d/yyyy"))
         .when(line == 4, F.date_format(day, "d MMM yyyy")).otherwise(F.date_format(day, "yyyy-MM-dd")),
        (F.col("l_quantity") - 5).cast("bigint").cast("string"),
        F.when((line == 3) & (order % 3 == 0), F.lit("n/a")).otherwise(F.col("l_extendedprice").cast("string")),
        line.cast("string"), F.floor(F.col("l_tax") * 100 - 4).cast("string"), F.lit("0"),
        # surplus and missing fields
        F.when(F.col("l_partkey") % 11 == 0, F.lit("A,surplus")).when(F.col("l_partkey") % 13 != 0, F.lit("A")),
    ]
    rows = table(spark, d, "lineitem")
    files = max(4, -(-rows.count() // DIRTY_ROWS_PER_FILE))      # each is sorted by one task
    rows = rows.repartitionByRange(files, *_ORDERED).sortWithinPartitions(*_ORDERED)
    # one column named like the header line: the writer adds it to every file and leaves the lines as they are
    rows.select(F.concat_ws(",", *fields).alias(",".join(RAW_COLUMNS))).write.option("header", True).option(
        "sep", "\t").csv(path)


_MEASURES = ["rows_read", "rows_loaded", "duplicate_video_ids_removed", "malformed_rows", "invalid_video_ids",
             "invalid_dates", "invalid_numeric_rows", "negative_metric_rows", "zero_view_rows"]


@register("dirty_upload", f"""
WITH l AS (SELECT *, row_number() OVER (ORDER BY {', '.join(_ORDERED)}) AS seq FROM lineitem),
raw AS (SELECT seq, l_partkey % 11 = 0 OR l_partkey % 13 = 0 AS malformed,
               CASE WHEN l_linenumber = 7 THEN 'id-' || l_orderkey ELSE CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) END AS raw_id,
               l_linenumber = 7 AS bad_id, l_linenumber = 6 AND l_orderkey % 2 = 0 AS bad_date,
               l_linenumber = 3 AND l_orderkey % 3 = 0 AS bad_number, CAST(l_shipdate AS DATE) AS day,
               CAST(l_quantity - 5 AS BIGINT) AS views, l_extendedprice AS watch,
               CAST(floor(l_tax * 100 - 4) AS BIGINT) AS comments FROM l),
kept AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY raw_id ORDER BY seq) AS rn FROM raw
                                      WHERE NOT malformed) WHERE rn = 1),
judged AS (SELECT *, views < 0 OR comments < 0 OR (NOT bad_number AND watch < 0) AS negative FROM kept),
reasons AS (SELECT *, CASE WHEN bad_id THEN 'invalid_video_id' WHEN bad_date THEN 'invalid_date'
                           WHEN bad_number THEN 'invalid_numeric' WHEN negative THEN 'negative_metric'
                           WHEN views <= 0 THEN 'zero_views' END AS reason FROM judged),
n AS (SELECT (SELECT count(*) FROM raw) AS rows_read, count(*) FILTER (reason IS NULL) AS rows_loaded,
             (SELECT count(*) FROM raw WHERE NOT malformed) - count(*) AS duplicate_video_ids_removed,
             (SELECT count(*) FROM raw WHERE malformed) AS malformed_rows, count(*) FILTER (bad_id) AS invalid_video_ids,
             count(*) FILTER (bad_date) AS invalid_dates, count(*) FILTER (bad_number) AS invalid_numeric_rows,
             count(*) FILTER (negative) AS negative_metric_rows, count(*) FILTER (views <= 0) AS zero_view_rows FROM reasons)
SELECT * FROM (UNPIVOT n ON COLUMNS(*) INTO NAME measure VALUE n)
UNION ALL SELECT 'reason:' || reason, count(*) FROM reasons WHERE reason IS NOT NULL GROUP BY 1
UNION ALL SELECT 'reason:malformed_row', count(*) FROM raw WHERE malformed HAVING count(*) > 0
UNION ALL SELECT 'loaded_views', coalesce(sum(views), 0)::BIGINT FROM reasons WHERE reason IS NULL
UNION ALL SELECT 'loaded_days', coalesce(sum(datediff('day', DATE '1970-01-01', day)), 0)::BIGINT FROM reasons WHERE reason IS NULL""")
def q_dirty_upload(spark, d):
    """S1, V1-V10 over unreadable and invalid rows: the audit report, the rows set aside by reason, sums of the loaded ones."""
    path = scratch_path(spark, "dirty-upload")
    write_dirty_csv(spark, d, path)
    v = Q.validate(read_raw_csv(spark, path), "dirty-upload", mode="quarantine")
    good, bad = Q.split_quarantine(v.rows)
    report = v.report_df.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("measure"), F.col(m).alias("n")) for m in _MEASURES])).alias("r")).select("r.*")
    reasons = bad.groupBy(F.concat(F.lit("reason:"), "reject_reason").alias("measure")).agg(F.count(F.lit(1)).alias("n"))
    sums = good.agg(F.coalesce(F.sum("views"), F.lit(0)).cast("bigint").alias("loaded_views"),
                    F.coalesce(F.sum(F.unix_date(F.to_date("publish_date"))), F.lit(0)).cast("bigint").alias("loaded_days"))
    sums = sums.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("measure"), F.col(c).alias("n")) for c in sums.columns])).alias("r")).select("r.*")
    return report.unionByName(reasons).unionByName(sums)


_ROUNDED = ["engagement_rate_pct", "avg_watch_time_seconds", "like_rate", "views_per_day"]


@register("record_rounding", with_content(
    "SELECT video_id, views, " + ", ".join(f"{RE(c, 4)} AS {c}" for c in _ROUNDED) + " FROM enriched"))
def q_record_rounding(spark, d):
    """Records with their floats rounded half-even to four digits."""
    return round_records(content(spark, d).select("video_id", "views", *_ROUNDED))


def _page(name: str):
    def run(spark, d):
        return RP.report_page(content(spark, d), name, SLICE)
    run.__doc__ = f"K2: the {name} page of the slice's report."
    return run


_PAGE_OF = {"title": "report_overview", "overview": "kpi_totals", "category_views": "by_category",
            "thumbnail_engagement": "by_thumbnail_style", "monthly": "monthly", "weekday": "weekday_calendar",
            "correlations": "correlations_to_views", "top_videos": "report_top10", "recommendations": "recommendations"}
for _name, _key in _PAGE_OF.items():
    register(f"report_page_{_name}", on_slice(REGISTRY[_key].sql, SLICE))(_page(_name))
register("report_page_token_lift", on_slice(REGISTRY["title_token_lift"].sql.replace("LIMIT 12", "LIMIT 10"), SLICE))(
    _page("token_lift"))
register("report_page_clusters")(_page("clusters"))
register("report_page_anomalies")(_page("anomalies"))
