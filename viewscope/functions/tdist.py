"""Student t distribution as column expressions, for the aggregated rows of an A/B test.

Spark has no t distribution. The CDF is a regularised incomplete beta
function: a continued fraction of a fixed number of terms, folded by
``aggregate`` over a sequence, so no Python worker is involved. The quantile is a
bisection on it, folded the same way. Both cost a fraction of a second a row and are meant
for one row a comparison, never for the fact table.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TERMS = 500             # of the continued fraction, two steps each
_LARGE = 2.0e5           # degrees of freedom from which the upper tail is the complement of the lower series
_BISECTIONS = 50           # of a range of 1,100 binary orders: the quantile is right to 1e-12
# fixed values: Lanczos coefficients of the gamma function for g = 7
_G = 7.0
_LANCZOS = [
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
]
_LN_ROOT_TWO_PI = 0.9189385332046727
_LN_ROOT_PI = 0.5723649429247001


def _ln_gamma(x: Column) -> Column:
    """ln of the gamma function for x > 0."""
    series = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:]):
        series = series + F.lit(c) / (x + F.lit(float(i)))
    t = x + F.lit(_G - 0.5)
    return F.lit(_LN_ROOT_TWO_PI) + (x - 0.5) * F.log(t) - t + F.log(series)


def _ln_half_step(a: Column) -> Column:
    """ln of gamma(a + 1/2) / gamma(a); for large a by its asymptotic series, as the two terms would cancel."""
    return F.when(a < 500, _ln_gamma(a + 0.5) - _ln_gamma(a)).otherwise(
        0.5 * F.log(a) - 1 / (8 * a) + 1 / (192 * a * a * a))


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of the incomplete beta function, by the modified Lentz method."""
    tiny = 1e-300

    def away(v: Column) -> Column:
        return F.when(F.abs(v) < tiny, F.lit(tiny)).otherwise(v)

    def step(s: Column, j: Column) -> Column:
        m = F.ceil(j / 2).cast("double")
        term = F.when(j % 2 == 1, m * (b - m) * x / ((a - 1 + 2 * m) * (a + 2 * m))).otherwise(
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 1 + 2 * m)))
        d = 1 / away(1 + term * s["d"])
        c = away(1 + term / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

    first = 1 / away(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(2 * _TERMS)), start, step)["h"]


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _two_sided(t: Column, df: Column) -> Column:
    """P(|T| >= |t|) for df > 0 and a finite t: I_x(df / 2, 1 / 2) at x = df / (df + t^2)."""
    def tail(s: Column) -> Column:
        df, tt = s["df"], s["tt"]
        x, y = df / (df + tt), tt / (df + tt)
        a, b = df / 2, F.lit(0.5)
        # the series that converges fast: from the tail, or of the complement
        direct = (x < (a + 1) / (a + b + 2)) & (df < _LARGE)
        p, q, z = F.when(direct, a).otherwise(b), F.when(direct, b).otherwise(a), F.when(direct, x).otherwise(y)
        front = F.exp(_ln_half_step(a) - F.lit(_LN_ROOT_PI) - a * F.log1p(tt / df)
                      + b * (F.log(tt) - F.log(df + tt)))
        part = front * _bound(F.struct(p.alias("p"), q.alias("q"), z.alias("z")),
                              lambda r: _fraction(r["p"], r["q"], r["z"]) / r["p"])
        return F.least(F.greatest(F.when(direct, part).otherwise(1 - part), F.lit(0.0)), F.lit(1.0))

    # the complement resolves 1e-16, which the tail of so many degrees of freedom passes before |t| = 8.5
    certain = F.when(t == 0, F.lit(1.0)).when((F.abs(t) > 8.5) & (df >= _LARGE), F.lit(0.0))
    return F.coalesce(certain, _bound(F.struct(df.alias("df"), (t * t).alias("tt")), tail))


def t_two_sided_p(t: Column, df: Column) -> Column:
    """Two-sided p-value; null for a null or NaN argument or df <= 0, 0 for an infinite t."""
    t, df = t.cast("double"), df.cast("double")
    usable = t.isNotNull() & ~F.isnan(t) & ~F.isnan(df) & (df > 0)
    return F.when(usable & (F.abs(t) == float("inf")), F.lit(0.0)).when(usable, _two_sided(t, df))


def t_quantile(q: float, df: Column) -> Column:
    """The value that T stays below with probability ``q`` (0 < q < 1); null for a null or NaN df or df <= 0."""
    if not 0.0 < q < 1.0:
        raise ValueError("q must be between 0 and 1")
    df = df.cast("double")
    usable = ~F.isnan(df) & (df > 0)
    if q == 0.5:
        return F.when(usable, F.lit(0.0))
    target = 2.0 * min(q, 1.0 - q)        # two-sided tail of the wanted |t|

    def search(df: Column) -> Column:
        # |t| = 2^u: the greatest u in steps of halves whose tail is still larger than wanted
        def step(u: Column, i: Column) -> Column:
            further = u + F.lit(1100.0) * F.pow(F.lit(0.5), i)
            return F.when(_two_sided(F.pow(F.lit(2.0), further), df) > target, further).otherwise(u)
        return F.pow(F.lit(2.0), F.aggregate(F.sequence(F.lit(1), F.lit(_BISECTIONS)), F.lit(-60.0), step))

    found = _bound(df, search)
    return F.when(usable, found if q > 0.5 else -found)
