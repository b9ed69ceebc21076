import numpy as np
import pytest

from viewscope.functions.quantile import exact_quantiles
from viewscope.functions.tdist import t_quantile, t_two_sided_p


def test_quartile_fixture(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 3, 4, 10]], "x double")
    r = exact_quantiles(df, "x", [0.25, 0.5, 0.75]).first()
    assert (r.q0, r.q1, r.q2) == (2.0, 3.0, 4.0)


def test_quantiles_match_numpy_with_ties_and_groups(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=3000), np.full(2000, 0.25)])
    g = rng.integers(0, 3, len(x))
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(g, x)], "g int, x double")
    qs = [0.1, 0.5, 0.75, 0.96]
    out = {r.g: r for r in exact_quantiles(df, "x", qs, keys=["g"], bound=50).collect()}
    for k in range(3):
        want = np.quantile(x[g == k], qs)
        got = [getattr(out[k], f"q{i}") for i in range(len(qs))]
        assert np.allclose(got, want, rtol=0, atol=1e-12)


def test_empty_input_gives_null_row(spark):
    df = spark.createDataFrame([], "x double")
    assert exact_quantiles(df, "x", [0.5]).first().q0 is None


@pytest.mark.parametrize("name", ["lognormal", "tied", "two_values", "constant", "integers"])
def test_quantiles_narrow_to_the_bound_on_skewed_and_tied_data(spark, name):
    """Heavy tails, values that hold a third of all rows, ranks at both ends; brackets end at the bound."""
    from viewscope.functions.quantile import quantile_brackets

    rng = np.random.default_rng(2)
    n = 20_000
    x = {"lognormal": rng.lognormal(0, 8, n), "tied": np.where(rng.random(n) < 0.34, 3.0, rng.normal(size=n)),
         "two_values": np.where(rng.random(n) < 0.5, 1.0, 2.0), "constant": np.full(n, 7.0),
         "integers": rng.integers(0, 100, n).astype(float)}[name]
    df = spark.createDataFrame([(0, float(v)) for v in x], "_g int, _x double").repartition(6)
    qs = [0.0, 0.001, 0.25, 0.5, 0.75, 0.96, 1.0]
    r = exact_quantiles(df, "_x", qs, bound=40).first()
    assert np.allclose([r[i] for i in range(len(qs))], np.quantile(x, qs), rtol=1e-15, atol=0)
    state, groups = quantile_brackets(df, ["_g"], qs, 40)
    inside = df.join(state, "_g").where("_x > lo AND _x < hi").groupBy("qi").count().collect()
    assert groups == 1 and all(c["count"] <= 40 or name == "integers" for c in inside)


def test_quantiles_of_many_groups_by_salted_brackets(spark, monkeypatch):
    from viewscope.functions import quantile as Q

    monkeypatch.setattr(Q, "MAX_BROADCAST_GROUPS", 10)
    rng = np.random.default_rng(4)
    g = np.where(rng.random(6000) < 0.4, 0, rng.integers(0, 50, 6000))
    x = rng.normal(size=6000)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(g, x)], "g int, x double")
    out = {r.g: r.q0 for r in exact_quantiles(df, "x", [0.3], keys=["g"], bound=100).collect()}
    assert len(out) == 50 and all(abs(out[k] - np.quantile(x[g == k], 0.3)) < 1e-12 for k in out)


def _numeric_p(t, df):
    """Two-sided p by integrating the density, with t = sqrt(df) tan(theta)."""
    import math

    theta = np.linspace(math.atan(abs(t) / math.sqrt(df)), math.pi / 2, 200_001)
    y = np.cos(theta) ** (df - 1)
    area = (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum()) * (theta[1] - theta[0]) / 3
    return 2 * area * math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)


def test_student_t_columns(spark):
    cases = [(t, df) for t in (0.001, 0.5, -2.0, 3.7, 12.0, -40.0) for df in (1.0, 2.0, 10.5, 97.0, 1500.0)]
    df = spark.createDataFrame(cases, "t double, df double")
    for r in df.select("t", "df", t_two_sided_p(df["t"], df["df"]).alias("p")).collect():
        assert r.p == pytest.approx(_numeric_p(r.t, r.df), rel=1e-8, abs=1e-15), (r.t, r.df)
    q = spark.createDataFrame([(x,) for x in (1.0, 2.0, 10.5, 30.0, 147_000.0, 1e9, 1e13)], "df double")
    got = {r.df: r.q for r in q.select("df", t_quantile(0.975, q["df"]).alias("q")).collect()}
    pins = {1.0: 12.706204736, 2.0: 4.302652730, 10.5: 2.21384029, 30.0: 2.042272456, 147_000.0: 1.959980124,
            1e9: 1.959963987, 1e13: 1.959963985}
    assert all(got[k] == pytest.approx(v, abs=1e-8) for k, v in pins.items()), got
    assert q.where("df = 10.5").select(t_quantile(0.025, q["df"])).first()[0] == pytest.approx(-2.21384029, abs=1e-8)


def test_student_t_of_large_samples_and_odd_arguments(spark):
    """Beyond any number of rows the p-value is the normal one; impossible arguments give null."""
    import math

    cases = [(t, n) for t in (0.01, 1.0, 1.96, 3.0, 5.0, 7.5) for n in (1.9e5, 2.1e5, 1e8, 1e12)]
    df = spark.createDataFrame(cases, "t double, df double")
    for r in df.select("t", "df", t_two_sided_p(df["t"], df["df"]).alias("p")).collect():
        z = r.t * (1 - 1 / (4 * r.df)) / math.sqrt(1 + r.t * r.t / (2 * r.df))
        assert r.p == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-4, abs=1e-10), (r.t, r.df)
    odd = spark.createDataFrame([(None, 3.0), (1.0, None), (float("nan"), 3.0), (1.0, -1.0), (float("inf"), 3.0),
                                 (0.0, 3.0), (50.0, 1e9)], "t double, df double")
    got = [r.p for r in odd.select(t_two_sided_p(odd["t"], odd["df"]).alias("p")).collect()]
    assert got == [None, None, None, None, 0.0, 1.0, 0.0]
    with pytest.raises(ValueError):
        t_quantile(1.0, odd["df"])
