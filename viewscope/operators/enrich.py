"""Derived columns (P1-P10) and time-range rolling means.

All derived columns are computed once over the whole validated table, before
any user filter, so recency and rolling values do not change with a slice.

Rolling means follow a time-range frame of N days ending at the current row:
every row of the N-1 previous calendar days, plus the rows of the same day up
to and including the current one in (publish_date, video_id) order. With
``ties='peers'`` the frame ends with the last row of the current instant instead, as
SQL's RANGE frame does.

Plan (no un-partitioned window over the fact table, no task per day):

1. ``daily``: one row per calendar day (sum, count) from a partial aggregate;
   windows over the previous N-1 days run on this small table.
2. Same-day prefix sums: the table is range-partitioned on
   (day, video_id); each task computes running sums over its sorted rows with
   Arrow/NumPy (``mapInArrow``), restarting at every new day. A day that is
   cut by a partition boundary (a hot day may span many partitions) gets the
   totals of its earlier pieces added from a small offsets table. That table
   has at most ``partitions - 1`` rows, so broadcasting it is always safe.
   The scanned rows are written, so a lost executor costs its own tasks only.
3. With times of day, rows are first reduced to instants (one row per distinct
   time); frame edges and peer groups are running sums over instants, and go
   back to the rows by a join that treats instants holding many rows apart.
"""

from __future__ import annotations

import datetime as dt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewscope.functions.distribute import join_counted
from viewscope.schema import ROLLING_WINDOWS
from viewscope.session import materialize

# A broadcast side is allowed only when its row count is bounded by this.
MAX_BROADCAST_ROWS = 2_000_000


def add_rates(df: DataFrame) -> DataFrame:
    """Engagement totals, per-view rates and watch hours."""
    views = F.col("views")
    total = F.col("likes") + F.col("comments") + F.col("shares")
    return (df.withColumn("engagement_total", total)
              .withColumn("engagement_rate", total / views)
              .withColumn("engagement_rate_pct", F.col("engagement_rate") * 100.0)
              .withColumn("avg_watch_time_seconds", F.col("watch_time_seconds") / views)
              .withColumn("like_rate", F.col("likes") / views)
              .withColumn("comment_rate", F.col("comments") / views)
              .withColumn("share_rate", F.col("shares") / views)
              .withColumn("watch_time_hours", F.col("watch_time_seconds") / 3600.0))


def word_count(col: str) -> F.Column:
    """Number of whitespace-separated words ('' -> 0)."""
    parts = F.split(F.coalesce(F.col(col), F.lit("")), r"(?U)\s+")
    return F.size(F.filter(parts, lambda w: w != "")).cast("int")


def add_calendar(df: DataFrame) -> DataFrame:
    """Publish month 'yyyy-MM', English weekday name, title word count."""
    return (df.withColumn("publish_month", F.date_format("publish_date", "yyyy-MM"))
              .withColumn("publish_weekday", F.date_format("publish_date", "EEEE"))
              .withColumn("title_word_count", word_count("title")))


def add_recency(df: DataFrame, latest) -> DataFrame:
    """Whole days before the newest item of the whole table, views per day.

    ``latest`` is the table's maximum publish timestamp, already known from the
    audit report, so no extra pass or join is needed.
    """
    if isinstance(latest, dt.datetime):
        lit_latest = F.lit(latest.isoformat(sep=" ")).cast("timestamp_ntz")
        micros = F.timestamp_diff("MICROSECOND", F.col("publish_date").cast("timestamp_ntz"), lit_latest)
        days = F.floor(micros / 86_400_000_000).cast("int")
    else:
        days = F.datediff(F.lit(latest), F.col("publish_date"))
    return (df.withColumn("days_since_publish", days)
              .withColumn("views_per_day", F.col("views") / F.greatest(F.col("days_since_publish"), F.lit(1))))


def _running_sums_fn(value_cols: list[str]):
    """Per-partition running sums over rows sorted by (_day, video_id), reset per day."""

    def run(batches):
        carry_day = None
        carry = {c: 0.0 for c in value_cols}
        carry_n = 0
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                yield batch
                continue
            day = batch.column("_day").to_numpy(zero_copy_only=False)
            starts = np.empty(n, dtype=bool)
            starts[0] = True
            starts[1:] = day[1:] != day[:-1]
            seg = np.cumsum(starts) - 1
            first_start = np.flatnonzero(starts)
            cont = (carry_day is not None) and day[0] == carry_day
            cols = {}
            pos = np.arange(n, dtype=np.int64)
            cnt = pos - first_start[seg] + 1
            if cont:
                cnt = cnt + np.where(seg == 0, carry_n, 0)
            cols["_cum_n"] = cnt
            for c in value_cols:
                v = batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64)
                cs = np.cumsum(v)
                base = np.concatenate(([0.0], cs))[first_start]
                run_v = cs - base[seg]
                if cont:
                    run_v = run_v + np.where(seg == 0, carry[c], 0.0)
                cols[f"_cum_{c}"] = run_v
            carry_day = day[-1]
            carry_n = int(cnt[-1])
            for c in value_cols:
                carry[c] = float(cols[f"_cum_{c}"][-1])
            out = batch
            for name, arr in cols.items():
                out = out.append_column(name, pa.array(arr))
            yield out

    return run


def segmented_running_sums(frame: DataFrame, order_cols: list[str], value_cols: list[str], parts: int,
                           keep: list[str] | None = None) -> DataFrame:
    """Running sums of ``value_cols`` within each ``_day`` segment, ordered by ``order_cols`` (inclusive).

    Adds ``_run_n`` (rows so far) and ``_run_<c>``. Skew-safe: rows are
    range-partitioned on (_day, *order_cols), so one segment may span many
    tasks; each task scans its sorted rows with Arrow/NumPy and a segment cut
    by partition boundaries gets its earlier pieces' totals from an offsets
    table of at most ``parts - 1`` rows (safe to broadcast).

    The scan is written once: offsets and running sums must come from one range partitioning (a second
    evaluation could sample other boundaries), and lost executors don't undo it. Its folder is added to ``keep``.
    """
    ranged = (frame.repartitionByRange(parts, "_day", *order_cols)
                   .withColumn("_pid", F.spark_partition_id()))
    schema = T.StructType(ranged.schema.fields
                          + [T.StructField("_cum_n", T.LongType())]
                          + [T.StructField(f"_cum_{c}", T.DoubleType()) for c in value_cols])
    scanned = materialize(ranged.sortWithinPartitions("_day", *order_cols)
                          .mapInArrow(_running_sums_fn(value_cols), schema), "running-sums", keep, "zstd")
    # last row of each (partition, day) piece holds the piece totals
    pieces = scanned.groupBy("_pid", "_day").agg(
        F.max("_cum_n").alias("_t_n"),
        *[F.max_by(f"_cum_{c}", "_cum_n").alias(f"_t_{c}") for c in value_cols])
    earlier = Window.partitionBy("_day").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # only days cut by a partition boundary get a row: at most parts - 1 rows
    offsets = (pieces.select(
        "_pid", "_day", F.coalesce(F.sum("_t_n").over(earlier), F.lit(0)).alias("_o_n"),
        *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0.0)).alias(f"_o_{c}") for c in value_cols])
        .where(F.col("_o_n") > 0))
    out = scanned.join(F.broadcast(offsets), ["_pid", "_day"], "left")
    out = out.withColumn("_run_n", F.col("_cum_n") + F.coalesce(F.col("_o_n"), F.lit(0)))
    for c in value_cols:
        out = out.withColumn(f"_run_{c}", F.col(f"_cum_{c}") + F.coalesce(F.col(f"_o_{c}"), F.lit(0.0)))
    return out.drop("_pid", "_cum_n", "_o_n", *[f"_cum_{c}" for c in value_cols], *[f"_o_{c}" for c in value_cols])


def rolling_means(df: DataFrame, windows: dict[str, tuple[str, int]] | None = None,
                  partitions: int | None = None, n_days_bound: int | None = None,
                  keep: list[str] | None = None, ties: str = "position") -> DataFrame:
    """W1-W3; ``publish_date`` a DATE or a TIMESTAMP. Rows that share a ``video_id`` stay separate rows.

    ``windows`` maps output column -> (source column, N days). The frame of a
    row at time t is (t - N days, t]: every row of the N-1 previous calendar
    days, the rows of its own day up to itself in (time, id) order and, when
    times of day exist, the rows of day d-N later in the day than t.
    With ``ties='peers'`` all rows of time t are in the frame, so rows of one
    time share their means: SQL's RANGE frame.
    ``n_days_bound`` is an upper bound on distinct days (from the audit
    report); the per-day table is broadcast only when it is under the limit.
    Folders of written intermediates are appended to ``keep`` for the caller to release.
    """
    if ties not in ("position", "peers"):
        raise ValueError("ties must be 'position' or 'peers'")
    windows = windows or ROLLING_WINDOWS
    spark = df.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    value_cols = sorted({src for src, _ in windows.values()})
    timed = dict(df.dtypes)["publish_date"] != "date"
    base = df.withColumn("_day", F.unix_date(F.to_date(F.col("publish_date"))))
    order = ["video_id"]
    if timed:
        base = base.withColumn("_tod", F.expr(
            "timestampdiff(MICROSECOND, CAST(to_date(publish_date) AS TIMESTAMP_NTZ), "
            "CAST(publish_date AS TIMESTAMP_NTZ))"))
        order = ["_tod", "video_id"]

    # 1. per-day totals and the previous-days windows on the small table (one
    #    row per calendar day; the window runs over that table only)
    daily = base.groupBy("_day").agg(
        F.count(F.lit(1)).alias("_d_n"), *[F.sum(c).cast("double").alias(f"_d_{c}") for c in value_cols])
    small = n_days_bound is not None and n_days_bound <= MAX_BROADCAST_ROWS
    prev_exprs = []
    for out_col, (src, n) in windows.items():
        w = Window.orderBy("_day").rangeBetween(-(n - 1), -1)
        prev_exprs.append(F.coalesce(F.sum(f"_d_{src}").over(w), F.lit(0.0)).alias(f"_p_{out_col}"))
        prev_exprs.append(F.coalesce(F.sum("_d_n").over(w), F.lit(0)).alias(f"_pn_{out_col}"))
    # without times of day the peers of a row are its day
    own_day = [F.col("_d_n").alias("_run_n"), *[F.col(f"_d_{c}").alias(f"_run_{c}") for c in value_cols]]
    prev = daily.select("_day", *prev_exprs, *(own_day if ties == "peers" and not timed else []))
    prev = F.broadcast(prev) if small else prev

    # 2. own-day running sums, by row or by instant
    out = segmented_running_sums(base, order, value_cols, parts, keep) if ties == "position" else base
    if timed:
        out = _with_instants(out, base, {n for _, n in windows.values()}, value_cols, parts, ties == "peers", keep)
    out = out.join(prev, ["_day"], "left")
    for out_col, (src, n) in windows.items():
        num, den = F.col(f"_p_{out_col}") + F.col(f"_run_{src}"), F.col(f"_pn_{out_col}") + F.col("_run_n")
        if timed:
            num, den = num + F.col(f"_e{n}_{src}"), den + F.col(f"_e{n}__one")
        out = out.withColumn(out_col, num / den)
    return out.select(*df.columns, *windows.keys())


def _with_instants(rows: DataFrame, base: DataFrame, days: set[int], value_cols: list[str], parts: int,
                   peers: bool, keep: list[str] | None) -> DataFrame:
    """Adds what depends on the time of a row alone: for each N in ``days`` the totals ``_e<N>__one`` (rows) and ``_e<N>_<col>`` of
    the rows of day d-N later in the day, and with ``peers`` the running totals ``_run_*`` up to the last row of that time.
    """
    instants = materialize(base.groupBy("_day", "_tod").agg(
        F.count(F.lit(1)).alias("_at"), F.count(F.lit(1)).cast("double").alias("_one"),
        *[F.sum(c).cast("double").alias(c) for c in value_cols]), "instants", keep)
    cols = ["_one", *value_cols]
    found = instants.select("_day", "_tod", "_at")
    if peers:
        run = segmented_running_sums(instants.select("_day", "_tod", *cols), ["_tod"], cols, parts, keep)
        found = found.join(run.select("_day", "_tod", F.col("_run__one").alias("_run_n"),
                                      *[F.col(f"_run_{c}") for c in value_cols]), ["_day", "_tod"])
    for n in sorted(days):
        # instants of day d-N and queries of day d in one scan: the totals up to a time, taken from the day's total
        edge = instants.select((F.col("_day") + n).alias("_day"), "_tod", F.lit(0).alias("_kind"), *cols)
        query = instants.select("_day", "_tod", F.lit(1).alias("_kind"), *[F.lit(0.0).alias(c) for c in cols])
        scan = segmented_running_sums(edge.unionByName(query), ["_tod", "_kind"], cols, parts, keep)
        upto = scan.where("_kind = 1").select("_day", "_tod", *[F.col(f"_run_{c}").alias(f"_u_{c}") for c in cols])
        total = instants.groupBy((F.col("_day") + n).alias("_day")).agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
        found = found.join(upto, ["_day", "_tod"], "left").join(total, "_day", "left")
        for c in cols:
            later = F.coalesce(F.col(f"_t_{c}"), F.lit(0.0)) - F.coalesce(F.col(f"_u_{c}"), F.lit(0.0))
            found = found.withColumn(f"_e{n}_{c}", later)
        found = found.drop(*[f"_u_{c}" for c in cols], *[f"_t_{c}" for c in cols])
    total_rows = instants.agg(F.sum("_at")).first()[0] or 0
    return join_counted(rows, materialize(found, "instants", keep), ["_day", "_tod"], "_at", total_rows)


def enrich(df: DataFrame, latest, n_days_bound: int | None = None, partitions: int | None = None,
           keep: list[str] | None = None) -> DataFrame:
    """P1-P10 and W1-W3 over the whole validated table.

    The rolling means come first, so that only the columns of ``df`` and what they average are shuffled and written for them.
    """
    averaged = [c for c in sorted({src for src, _ in ROLLING_WINDOWS.values()}) if c not in df.columns]
    rolled = rolling_means(add_rates(df).select(*df.columns, *averaged), partitions=partitions,
                           n_days_bound=n_days_bound, keep=keep)
    out = add_recency(add_calendar(add_rates(rolled.drop(*averaged))), latest)
    return out.select(*[c for c in out.columns if c not in ROLLING_WINDOWS], *ROLLING_WINDOWS)
