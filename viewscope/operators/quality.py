"""Validation and cleaning of raw content rows.

Order of the fail-fast checks is part of the contract: schema, ids, dates,
numbers, negatives, non-positive views. All counts come from one aggregate
pass over the de-duplicated rows; only that one-row report reaches the driver.
Rows of a CSV file that don't have the header's number of fields come first:
their values can't be told apart, so they take no part in de-duplication and are
counted and set aside under a reason of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewscope import schema as C
from viewscope.schema import DATE_FORMATS, NUMERIC_COLUMNS, RAW_COLUMNS, TEXT_COLUMNS
from viewscope.session import materialize

INTERNAL_COLUMNS = {"ingest_seq", "_source_file", "_corrupt_record"}

REPORT_COLUMNS = [
    "source_path", "rows_read", "rows_loaded", "duplicate_video_ids_removed", "invalid_video_ids",
    "invalid_dates", "invalid_numeric_rows", "negative_metric_rows", "zero_view_rows", "date_min", "date_max",
    "malformed_rows",
]


class DataValidationError(ValueError):
    """The input does not satisfy the content contract."""


def check_schema(df: DataFrame) -> None:
    """V1: the raw column set must be exactly the 10 expected columns."""
    present = [c for c in df.columns if c not in INTERNAL_COLUMNS]
    missing = [c for c in RAW_COLUMNS if c not in present]
    extra = [c for c in present if c not in RAW_COLUMNS]
    if missing or extra:
        raise DataValidationError(C.INVALID_SCHEMA.format(missing or "[]", extra or "[]"))


MAX_BROADCAST_KEYS = 100_000

_FIXED_WIDTH = (T.IntegralType, T.FloatType, T.DoubleType, T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType)


def _is_fixed_width(df: DataFrame, col: str) -> bool:
    """Whether a minimum of the column is kept in place by a hash aggregate."""
    return isinstance(df.schema[col].dataType, _FIXED_WIDTH)


def _packed_order(df: DataFrame, order: list[str]) -> Column | None:
    """Several integral or date columns as one decimal that sorts like them, null first; None if they don't fit."""
    kinds = [df.schema[c].dataType for c in order]
    if not all(isinstance(k, (T.IntegralType, T.DateType)) for k in kinds):
        return None
    as_long = [F.unix_date(c) if isinstance(k, T.DateType) else F.col(c).cast("long") for c, k in zip(order, kinds)]
    ends = df.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(as_long) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    digits = []
    for i, c in enumerate(as_long):
        lo, hi = ends[f"lo{i}"] or 0, ends[f"hi{i}"] or 0
        width = len(str(hi - lo + 1))
        shifted = F.coalesce(c.cast("decimal(38,0)") - F.lit(lo) + F.lit(1), F.lit(0))
        digits.append((F.lpad(shifted.cast("string"), width, "0"), width))
    if sum(width for _, width in digits) > 38:
        return None
    return F.concat(*[text for text, _ in digits]).cast("decimal(38,0)")


def dedup_keep_first(df: DataFrame, keys: list[str], order: list[str], count_col: str | None = None,
                     unique_order: bool = False, keep: list[str] | None = None) -> DataFrame:
    """V2: one row per key, the first by ``order`` (nulls first); nulls in keys compare equal.

    Two phases: a hash aggregate over keys and order alone finds the least order value of each key, reduced in
    every task before its shuffle, and an equi-join on keys *and* order value then picks the rows. Rows of a
    hot key differ in that value, so they spread over all tasks; no task holds a whole key group.
    Several integral or date columns are packed into one number by their measured ranges. Orders that
    don't fit are reduced as structs by a sort aggregate instead. Of rows that tie in all of ``order`` any one stays;
    ``unique_order`` promises that there are none, which saves a pass. Then repeated keys are looked up first: up to
    ``MAX_BROADCAST_KEYS`` of them are broadcast and no row moves. ``df`` is read twice, a third time with more such keys, and
    must give the same rows.
    """
    if len(order) == 1 and _is_fixed_width(df, order[0]):
        seq = F.col(order[0])
    else:
        seq = _packed_order(df, order)
    if seq is None:
        return _dedup_by_struct(df, keys, order, count_col)
    rows = df.withColumn("_seq", seq)
    # min() skips nulls, so a key with a null order value is marked: null sorts first
    firsts = rows.groupBy(*[F.col(k).alias(f"_on_{k}") for k in keys]).agg(
        F.min("_seq").alias("_first"), F.max(F.col("_seq").isNull()).alias("_has_null"),
        F.count(F.lit(1)).alias("_n"))
    firsts = firsts.select(*[f"_on_{k}" for k in keys], "_n",
                           F.when(~F.col("_has_null"), F.col("_first")).alias("_first"))
    same = same_seq = F.col("_seq").eqNullSafe(F.col("_first"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_on_{k}"))
    if unique_order:
        repeated = materialize(firsts.where(F.col("_n") > 1).limit(MAX_BROADCAST_KEYS + 1), "repeated-keys", keep)
        if repeated.count() <= MAX_BROADCAST_KEYS:
            same_key = F.lit(True)
            for k in keys:
                same_key = same_key & F.col(k).eqNullSafe(F.col(f"_on_{k}"))
            out = rows.join(F.broadcast(repeated), same_key, "left").where(F.col("_n").isNull() | same_seq)
            return out.select(*df.columns, *([F.coalesce("_n", F.lit(1)).alias(count_col)] if count_col else []))
    out = rows.join(firsts, same)
    if not unique_order:
        w = Window.partitionBy(*keys).orderBy("_seq")     # rows tied for first place only
        out = out.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return out.select(*df.columns, *([F.col("_n").alias(count_col)] if count_col else []))


def _dedup_by_struct(df: DataFrame, keys: list[str], order: list[str], count_col: str | None) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    order_key = F.struct(*[F.col(c) for c in order]) if len(order) > 1 else F.col(order[0])
    aggs = [F.min_by(F.struct(*[F.col(c) for c in rest]), order_key).alias("_first")]
    if count_col:
        aggs.append(F.count(F.lit(1)).alias(count_col))
    out = df.groupBy(*keys).agg(*aggs).select(*keys, "_first.*", *([count_col] if count_col else []))
    return out.select(*[c for c in df.columns], *([count_col] if count_col else []))


def strip_text(col: str, null_text: str | None = None) -> Column:
    """V4: strip leading/trailing Unicode whitespace; NULL stays NULL unless ``null_text`` is given."""
    stripped = F.regexp_replace(F.col(col).cast("string"), r"(?U)^\s+|\s+$", "")
    return F.coalesce(stripped, F.lit(null_text)) if null_text is not None else stripped


def _to_number(col: str) -> Column:
    """Number of a text; NaN and infinities count as invalid."""
    x = F.expr(f"try_cast(trim(cast(`{col}` AS string)) AS double)")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def _to_id(col: str) -> Column:
    # Integral text keeps full 64-bit precision; fractional ids truncate like int().
    exact = F.expr(f"try_cast(trim(cast(`{col}` AS string)) AS bigint)")
    approx = F.expr(f"try_cast(try_cast(trim(cast(`{col}` AS string)) AS double) AS bigint)")
    return F.coalesce(exact, approx)


def _to_timestamp(col: str, dtype: str, formats: tuple[str, ...] | list[str] = ()) -> Column:
    """V5: ISO text first, then each of ``formats`` in order; null if none fits."""
    if dtype in ("date", "timestamp", "timestamp_ntz"):
        return F.col(col).cast("timestamp_ntz")
    text = F.trim(F.col(col))
    tried = [F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in formats]
    return F.coalesce(F.expr(f"try_cast(trim(`{col}`) AS timestamp_ntz)"), *tried)


def coerce(df: DataFrame, null_text: str | None = None,
           date_formats: tuple[str, ...] | list[str] = DATE_FORMATS) -> DataFrame:
    """V3-V6: typed columns plus a ``reject_reason`` in fail-fast precedence, malformed rows first."""
    types = dict(df.dtypes)
    typed = df.select(
        *[F.col(c) for c in df.columns if c in INTERNAL_COLUMNS or c == "_copies"],
        _to_id("video_id").alias("video_id"),
        *[strip_text(c, null_text).alias(c) for c in TEXT_COLUMNS],
        _to_timestamp("publish_date", types.get("publish_date", "string"), date_formats).alias("publish_date"),
        *[_to_number(c).alias(c) for c in NUMERIC_COLUMNS],
    )
    any_null_num = F.lit(False)
    any_neg = F.lit(False)
    for c in NUMERIC_COLUMNS:
        any_null_num = any_null_num | F.col(c).isNull()
        any_neg = any_neg | (F.col(c) < 0)
    malformed = F.col("_corrupt_record").isNotNull() if "_corrupt_record" in typed.columns else F.lit(False)
    reason = (F.when(malformed, "malformed_row").when(F.col("video_id").isNull(), "invalid_video_id")
              .when(F.col("publish_date").isNull(), "invalid_date")
              .when(any_null_num, "invalid_numeric")
              .when(any_neg, "negative_metric")
              .when(F.col("views") <= 0, "zero_views"))
    return typed.withColumn("reject_reason", reason)


COUNT_COLUMNS = ("views", "likes", "comments", "shares")


def finalize_types(df: DataFrame, date_only: bool, fractional: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """Count columns become bigint unless listed as ``fractional``; publish_date a date without times of day."""
    out = df
    for c in COUNT_COLUMNS:
        if c not in fractional:
            out = out.withColumn(c, F.col(c).cast("bigint"))
    out = out.withColumn("publish_date", F.to_date("publish_date") if date_only else F.col("publish_date"))
    return out


def report_aggregate(typed: DataFrame, source_name: str) -> DataFrame:
    """V9: the audit report as a one-row DataFrame, computed in one pass."""
    any_null_num = F.lit(False)
    any_neg = F.lit(False)
    for c in NUMERIC_COLUMNS:
        any_null_num = any_null_num | F.col(c).isNull()
        any_neg = any_neg | (F.col(c) < 0)
    copies = F.col("_copies") if "_copies" in typed.columns else F.lit(1)
    malformed = F.col("reject_reason").eqNullSafe("malformed_row")
    whole = ~malformed      # values of a malformed row are not counted again under other reasons
    return typed.agg(
        F.lit(source_name).alias("source_path"),
        F.sum(copies).cast("bigint").alias("rows_read"),
        F.count_if(F.col("reject_reason").isNull()).alias("rows_loaded"),
        F.sum(copies - 1).cast("bigint").alias("duplicate_video_ids_removed"),
        F.count_if(whole & F.col("video_id").isNull()).alias("invalid_video_ids"),
        F.count_if(whole & F.col("publish_date").isNull()).alias("invalid_dates"),
        F.count_if(whole & any_null_num).alias("invalid_numeric_rows"),
        F.count_if(whole & any_neg).alias("negative_metric_rows"),
        F.count_if(whole & (F.col("views") <= 0)).alias("zero_view_rows"),
        F.to_date(F.min(F.when(whole, F.col("publish_date")))).alias("date_min"),
        F.to_date(F.max(F.when(whole, F.col("publish_date")))).alias("date_max"),
        F.count_if(malformed).alias("malformed_rows"),
        F.max(F.when(whole, F.col("publish_date"))).alias("_latest"),
        F.count_if(whole & (F.col("publish_date") != F.date_trunc("day", F.col("publish_date")))).alias("_timed_rows"),
        *[F.count_if(F.col("reject_reason").isNull() & (F.col(c) != F.floor(c))).alias(f"_fractional_{c}")
          for c in COUNT_COLUMNS],
    ).fillna(0, subset=["rows_read", "duplicate_video_ids_removed"])


def raise_first_failure(report: dict) -> None:
    """V10 (fail mode): raise for the first failed check, in contract order."""
    if report["malformed_rows"]:
        raise DataValidationError(f"Found {report['malformed_rows']} rows with a wrong number of fields")
    if report["invalid_video_ids"]:
        raise DataValidationError(C.INVALID_IDS.format(report["invalid_video_ids"]))
    if report["invalid_dates"]:
        raise DataValidationError(C.INVALID_DATES.format(report["invalid_dates"]))
    if report["invalid_numeric_rows"]:
        raise DataValidationError(C.INVALID_NUMBERS.format(report["invalid_numeric_rows"]))
    if report["negative_metric_rows"]:
        raise DataValidationError(C.INVALID_NEGATIVE.format(report["negative_metric_rows"]))
    if report["zero_view_rows"]:
        raise DataValidationError(C.INVALID_VIEWS)


@dataclass
class Validated:
    """Typed, de-duplicated rows and their audit report."""

    rows: DataFrame          # all typed rows, with reject_reason; written
    report: dict             # collected one-row report
    report_df: DataFrame     # same report as a DataFrame (public columns only)
    date_only: bool
    fractional: list[str]    # count columns that hold fractions
    written: list[str]       # folders of ``rows``, for a caller that releases them


def validate(raw: DataFrame, source_name: str, mode: str = "fail", null_text: str | None = None,
             date_formats: tuple[str, ...] | list[str] = DATE_FORMATS) -> Validated:
    """V1-V10. ``mode='fail'`` raises on the first failed check; ``'quarantine'`` keeps going.

    ``ingest_seq`` must be unique where the raw rows have it; other rows are written once to be numbered.
    """
    if mode not in ("fail", "quarantine"):
        raise ValueError("mode must be 'fail' or 'quarantine'")
    check_schema(raw)
    written: list[str] = []
    keep = [c for c in raw.columns if c in RAW_COLUMNS or c in ("ingest_seq", "_corrupt_record")]
    src = raw.select(*keep)
    if "ingest_seq" not in src.columns:
        src = materialize(src.withColumn("ingest_seq", F.monotonically_increasing_id()), "raw", written, "zstd")
    if "_corrupt_record" in keep:
        malformed = src.where(F.col("_corrupt_record").isNotNull()).withColumn("_copies", F.lit(1).cast("long"))
        src = src.where(F.col("_corrupt_record").isNull())
    deduped = dedup_keep_first(src, ["video_id"], ["ingest_seq"], count_col="_copies", unique_order=True, keep=written)
    if "_corrupt_record" in keep:
        deduped = deduped.unionByName(malformed)
    typed = materialize(coerce(deduped, null_text, date_formats), "typed", written, "zstd")
    report_row = report_aggregate(typed, source_name).collect()[0].asDict()
    if mode == "fail":
        raise_first_failure(report_row)
    report_df = typed.sparkSession.createDataFrame(
        [tuple(report_row[c] for c in REPORT_COLUMNS)],
        "source_path string, rows_read long, rows_loaded long, duplicate_video_ids_removed long, "
        "invalid_video_ids long, invalid_dates long, invalid_numeric_rows long, negative_metric_rows long, "
        "zero_view_rows long, date_min date, date_max date, malformed_rows long")
    return Validated(rows=typed, report=report_row, report_df=report_df,
                     date_only=(report_row["_timed_rows"] or 0) == 0,
                     fractional=[c for c in COUNT_COLUMNS if report_row[f"_fractional_{c}"]], written=written)


def split_quarantine(typed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """V10 (quarantine mode): good rows and rejected rows with their reason."""
    good = typed.where(F.col("reject_reason").isNull()).drop("reject_reason")
    bad = typed.where(F.col("reject_reason").isNotNull())
    return good, bad
