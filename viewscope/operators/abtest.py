"""Welch A/B comparisons.

Both groups are summarised in one aggregation pass (count, mean, sample sd)
plus the exact medians; the test statistics, the Student-t p-value and
quantile included, are column arithmetic on the resulting single row.

Keyword groups may overlap, so each row is exploded into the variants it
belongs to (zero, one or two) instead of grouping by a single key.
Problems the reference reports as messages (too few rows, empty slice) come
back as an ``error`` column so that the result stays a lazy DataFrame;
invalid parameters raise immediately.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewscope.functions.numeric import fixed
from viewscope.functions.quantile import exact_quantiles
from viewscope.functions.tdist import t_quantile, t_two_sided_p
from viewscope.operators.filters import keyword_mask
from viewscope.schema import (
    AB_DIMENSIONS, AB_METRICS, FEW_OBSERVATIONS, FEW_VIDEOS, METHOD, NO_ROWS, VERDICT_NOT_SIGNIFICANT, VERDICT_SIGNIFICANT,
)

def _check_metric(metric: str) -> None:
    if metric not in AB_METRICS:
        raise ValueError(f"metric must be one of {AB_METRICS}")


def attribute_variants(df: DataFrame, dimension: str, variant_a: str, variant_b: str, metric: str) -> DataFrame:
    """Rows (variant 'A'/'B', label, x) for an attribute comparison."""
    if dimension not in AB_DIMENSIONS:
        raise ValueError("dimension must be thumbnail_style or category")
    _check_metric(metric)
    tags = F.array(F.when(F.col(dimension) == F.lit(variant_a), F.lit("A")),
                   F.when(F.col(dimension) == F.lit(variant_b), F.lit("B")))   # equal variants: a row is in both
    return (df.where(F.col(dimension).isin(variant_a, variant_b) & F.col(metric).isNotNull())
            .select(F.explode(F.filter(tags, lambda t: t.isNotNull())).alias("variant"),
                    F.col(metric).cast("double").alias("x")))


def keyword_variants(df: DataFrame, keyword_a: str, keyword_b: str, metric: str) -> DataFrame:
    """Rows (variant, x) for a title-keyword comparison; a title may be in both groups."""
    _check_metric(metric)
    tags = F.array(F.when(keyword_mask(keyword_a), F.lit("A")), F.when(keyword_mask(keyword_b), F.lit("B")))
    return (df.where(F.col(metric).isNotNull())
            .select(F.explode(F.filter(tags, lambda t: t.isNotNull())).alias("variant"),
                    F.col(metric).cast("double").alias("x")))


def group_stats(variants: DataFrame) -> DataFrame:
    """B1: per variant n, mean, sample sd (ddof 1) and exact median."""
    moments = variants.groupBy("variant").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"))
    medians = exact_quantiles(variants, "x", [0.5], keys=["variant"], prefix="median")
    return moments.join(medians.withColumnRenamed("median0", "median"), "variant")


def compare(variants: DataFrame, label_a: str, label_b: str, metric: str, with_p: bool = True,
            too_few: str = FEW_OBSERVATIONS, rows: DataFrame | None = None) -> DataFrame:
    """B4-B10 on the two summarised groups: one row. ``rows`` is the slice, whose emptiness is reported first."""
    stats = group_stats(variants)
    # a global aggregate turns both groups into one row, also when a group is empty
    row = stats.agg(*[F.max(F.when(F.col("variant") == v, F.col(c))).alias(f"{c}_{v.lower()}")
                      for v in ("A", "B") for c in ("n", "mean", "std", "median")])
    empty = F.lit(False)
    if rows is not None:
        total = rows.agg(F.count(F.lit(1)).alias("_rows")).withColumn("_k", F.lit(0))   # one row
        row = row.withColumn("_k", F.lit(0)).join(F.broadcast(total), "_k")
        empty = F.col("_rows") == 0
    na, nb = F.coalesce(F.col("n_a"), F.lit(0)), F.coalesce(F.col("n_b"), F.lit(0))
    ma, mb, sa, sb = F.col("mean_a"), F.col("mean_b"), F.col("std_a"), F.col("std_b")
    va, vb = sa * sa / na, sb * sb / nb
    diff = ma - mb
    se = F.sqrt(va + vb)
    t = F.try_divide(diff, se)
    dof = F.try_divide((va + vb) * (va + vb), va * va / (na - 1) + vb * vb / (nb - 1))
    pooled = F.when(na + nb > 2, F.sqrt(((na - 1) * sa * sa + (nb - 1) * sb * sb) / (na + nb - 2))).otherwise(1.0)
    d = F.when(pooled > 0, diff / pooled).otherwise(0.0)
    abs_d = F.abs(F.col("cohens_d"))
    effect = (F.when(abs_d >= 0.8, "large").when(abs_d >= 0.5, "medium").when(abs_d >= 0.2, "small")
              .otherwise("negligible"))
    diff_pct = F.abs(diff) / F.greatest(F.least(F.abs(ma), F.abs(mb)), F.lit(1e-9)) * 100
    error = F.when(empty, F.lit(NO_ROWS)).when((na < 2) | (nb < 2), F.lit(too_few))
    out = row.select(
        F.lit(metric).alias("metric"),
        F.lit(label_a).alias("label_a"), na.alias("n_a"), ma.alias("mean_a"), sa.alias("std_a"),
        F.col("median_a"),
        F.lit(label_b).alias("label_b"), nb.alias("n_b"), mb.alias("mean_b"), sb.alias("std_b"),
        F.col("median_b"),
        t.alias("t_statistic"), dof.alias("degrees_of_freedom"), d.alias("cohens_d"),
        diff_pct.alias("difference_pct"), se.alias("_se"), diff.alias("_diff"), error.alias("error"),
        F.when(ma > mb, F.lit(label_a)).otherwise(F.lit(label_b)).alias("winner"),
    ).withColumn("effect_size", effect)
    if with_p:
        t_crit = F.when(F.col("degrees_of_freedom") > 0,
                        t_quantile(0.975, F.col("degrees_of_freedom"))).otherwise(1.96)
        p = F.col("p_value")
        out = (out.withColumn("p_value", t_two_sided_p(F.col("t_statistic"), F.col("degrees_of_freedom")))
               .withColumn("_tcrit", t_crit)
               .withColumn("ci_95_lower", F.col("_diff") - F.col("_tcrit") * F.col("_se"))
               .withColumn("ci_95_upper", F.col("_diff") + F.col("_tcrit") * F.col("_se"))
               .withColumn("significance", F.when(p < 0.01, "highly significant").when(p < 0.05, "significant")
                           .when(p < 0.10, "marginally significant").otherwise("not significant")))
    return out


def _rounded(out: DataFrame, with_p: bool) -> DataFrame:
    cols = [
        "metric", "label_a", "n_a", fixed("mean_a", 4).alias("mean_a"), fixed("std_a", 4).alias("std_a"),
        fixed("median_a", 4).alias("median_a"),
        "label_b", "n_b", fixed("mean_b", 4).alias("mean_b"), fixed("std_b", 4).alias("std_b"),
        fixed("median_b", 4).alias("median_b"),
        fixed("t_statistic", 4).alias("t_statistic"), fixed("degrees_of_freedom", 2).alias("degrees_of_freedom"),
        fixed("cohens_d", 4).alias("cohens_d"), "effect_size", fixed("difference_pct", 2).alias("difference_pct"),
        "winner", "error",
    ]
    if with_p:
        cols += [F.lit(METHOD).alias("method"), fixed("p_value", 6).alias("p_value"), "significance",
                 fixed("ci_95_lower", 4).alias("ci_95_lower"), fixed("ci_95_upper", 4).alias("ci_95_upper"),
                 _recommendation().alias("recommendation")]
    return out.select(*cols)


def _recommendation() -> Column:
    p = F.col("p_value")
    tail = F.when(p < 0.05, F.lit(VERDICT_SIGNIFICANT)) \
        .otherwise(F.lit(VERDICT_NOT_SIGNIFICANT))
    return F.concat(
        F.col("winner"), F.lit(" outperforms on "), F.col("metric"), F.lit(" ("), F.col("effect_size"),
        F.lit(" effect, p="), fixed(p, 4).cast("string"), F.lit(", difference "),
        fixed("difference_pct", 1).cast("string"), F.lit("%). "), tail)


def ab_test_attribute(df: DataFrame, dimension: str, variant_a: str, variant_b: str, metric: str,
                      with_p: bool = True) -> DataFrame:
    """B2: compare two values of ``dimension`` on ``metric``."""
    v = attribute_variants(df, dimension, variant_a, variant_b, metric)
    return _rounded(compare(v, variant_a, variant_b, metric, with_p, rows=df), with_p)


def ab_test_title(df: DataFrame, keyword_a: str, keyword_b: str, metric: str, with_p: bool = True) -> DataFrame:
    """Compare titles containing ``keyword_a`` with titles containing ``keyword_b``."""
    v = keyword_variants(df, keyword_a, keyword_b, metric)
    return _rounded(compare(v, f'"{keyword_a}"', f'"{keyword_b}"', metric, with_p, FEW_VIDEOS, df), with_p)
