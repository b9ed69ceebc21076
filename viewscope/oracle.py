"""DuckDB SQL that states, independently of Spark, what each query must return.

Every statement starts from the same CTE chain: the content adaptor over the
star-schema tables, then the derived columns. ``R(x, d)`` is the rounding
used on the Spark side (snap to 10 decimals, then round half away from zero).
"""

from __future__ import annotations


def R(expr: str, digits: int) -> str:  # noqa: N802 - reads like SQL
    return f"CAST(round(CAST(({expr}) AS DECIMAL(38,10)), {digits}) AS DOUBLE)"


CONTENT_CTE = """
names AS (SELECT l_orderkey, string_agg(p_name, ' ' ORDER BY p_name) AS title
          FROM (SELECT DISTINCT l_orderkey, p_name FROM lineitem JOIN part ON l_partkey = p_partkey) z
          GROUP BY 1),
m AS (SELECT l_orderkey, CAST(sum(l_quantity) AS BIGINT) AS views,
             CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS watch_time_seconds,
             count(*) FILTER (WHERE l_returnflag = 'A') AS likes,
             count(*) FILTER (WHERE l_returnflag = 'R') AS comments,
             count(*) FILTER (WHERE l_returnflag = 'N') AS shares
      FROM lineitem GROUP BY 1),
content AS (SELECT o_orderkey AS video_id, title, o_orderpriority AS category,
                   CAST(o_orderdate AS DATE) AS publish_date, views, watch_time_seconds,
                   likes, comments, shares, c_mktsegment AS thumbnail_style
            FROM orders JOIN m ON o_orderkey = m.l_orderkey JOIN names n ON o_orderkey = n.l_orderkey
                        JOIN customer ON o_custkey = c_custkey),
derived AS (SELECT *,
                   likes + comments + shares AS engagement_total,
                   (likes + comments + shares) / views AS engagement_rate,
                   ((likes + comments + shares) / views) * 100.0 AS engagement_rate_pct,
                   watch_time_seconds / views AS avg_watch_time_seconds,
                   likes / views AS like_rate,
                   comments / views AS comment_rate,
                   shares / views AS share_rate,
                   watch_time_seconds / 3600.0 AS watch_time_hours,
                   strftime(publish_date, '%Y-%m') AS publish_month,
                   dayname(publish_date) AS publish_weekday,
                   CAST(len(list_filter(regexp_split_to_array(title, '\\s+'), lambda x: x <> '')) AS INTEGER)
                       AS title_word_count,
                   CAST(date_diff('day', publish_date, (SELECT max(publish_date) FROM content)) AS INTEGER)
                       AS days_since_publish
            FROM content),
daily AS (SELECT publish_date, count(*) AS n, sum(views) AS sv, sum(engagement_rate_pct) AS se
          FROM derived GROUP BY 1),
prev AS (SELECT publish_date,
                coalesce(sum(sv) OVER w7, 0) AS p7v, coalesce(sum(n) OVER w7, 0) AS p7n,
                coalesce(sum(sv) OVER w30, 0) AS p30v, coalesce(sum(se) OVER w30, 0) AS p30e,
                coalesce(sum(n) OVER w30, 0) AS p30n
         FROM daily
         WINDOW w7 AS (ORDER BY publish_date RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING),
                w30 AS (ORDER BY publish_date RANGE BETWEEN INTERVAL 29 DAYS PRECEDING
                        AND INTERVAL 1 DAYS PRECEDING)),
sameday AS (SELECT video_id,
                   sum(views) OVER wd AS cv, sum(engagement_rate_pct) OVER wd AS ce, count(*) OVER wd AS cn
            FROM derived
            WINDOW wd AS (PARTITION BY publish_date ORDER BY video_id
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
enriched AS (SELECT d.*,
                    d.views / greatest(d.days_since_publish, 1) AS views_per_day,
                    (p.p7v + s.cv) / (p.p7n + s.cn) AS rolling_views_7d,
                    (p.p30v + s.cv) / (p.p30n + s.cn) AS rolling_views_30d,
                    (p.p30e + s.ce) / (p.p30n + s.cn) AS rolling_engagement_30d
             FROM derived d JOIN prev p USING (publish_date) JOIN sameday s USING (video_id))
"""


def with_content(body: str, extra_ctes: str = "") -> str:
    """A full statement: the shared CTE chain, optional extra CTEs, then ``body``."""
    ctes = CONTENT_CTE.strip()
    if extra_ctes.strip():
        ctes += ",\n" + extra_ctes.strip()
    return f"WITH {ctes}\n{body.strip()}"


def on_slice(sql: str, filters) -> str:
    """A ``with_content`` statement over the rows of ``filters`` instead of all enriched rows."""
    head = f"WITH {CONTENT_CTE.strip()}"
    if not sql.startswith(head):
        raise ValueError("not a statement over the content tables")
    sliced = (f"sliced AS (SELECT * FROM enriched WHERE category = '{filters.category}' "
              f"AND publish_date >= DATE '{filters.start_date}' AND publish_date <= DATE '{filters.end_date}')")
    return f"{head},\n{sliced}" + sql[len(head):].replace("FROM enriched", "FROM sliced")


def RE(expr: str, digits: int) -> str:  # noqa: N802 - reads like SQL
    """Half-even rounding, spelled out on a decimal: up past the half, or at it from an odd digit."""
    x = f"(CAST(({expr}) AS DECIMAL(28,10)) * {10 ** digits})"
    up = f"({x} - floor({x}) > 0.5 OR ({x} - floor({x}) = 0.5 AND floor({x}) % 2 <> 0))"
    return f"CAST(floor({x}) + CASE WHEN {up} THEN 1 ELSE 0 END AS DOUBLE) / {10 ** digits}"
