"""Small column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fixed(col: Column | str, digits: int) -> Column:
    """Round a double to ``digits`` decimals, half away from zero, as a double.

    The value is first snapped to 10 decimals so that a double such as 1.005
    (stored as 1.00499...) rounds like the decimal it prints as. This makes
    the result independent of summation order noise and identical to the
    same expression written in SQL.
    """
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c.cast("decimal(38,10)"), digits).cast("double")


def half_even(col: Column | str, digits: int) -> Column:
    """Round a double to ``digits`` decimals, ties to the even digit, as a double (snapped like ``fixed``)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.bround(c.cast("decimal(38,10)"), digits).cast("double")


def round_records(df: DataFrame, digits: int = 4) -> DataFrame:
    """Every float column of a result rounded half-even; other columns as they are."""
    return df.select(*[half_even(f"`{c}`", digits).alias(c) if t in ("double", "float") else F.col(f"`{c}`")
                       for c, t in df.dtypes])


def pearson(x: str, y: str) -> Column:
    """Pearson correlation that is NULL (not an error) for a constant column."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
