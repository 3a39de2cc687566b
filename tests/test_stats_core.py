import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyspark.operators import aggregate as A
from surveyspark.operators import stats_core as S


@pytest.mark.parametrize("bins,finish", [(1024, 50_000), (16, 10), (64, 0)])
def test_quantiles_match_numpy(spark, bins, finish):
    """Refining the bins to the end, or ranking the last rows whole, gives the same values."""
    rng = np.random.default_rng(1)
    vals = np.concatenate([rng.normal(size=1500).round(3), np.full(700, 0.25), 10.0 ** rng.uniform(-3, 9, 200)])
    df = spark.createDataFrame([(float(v),) for v in vals] + [(None,)], "x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = S.quantiles(S.long_form(df, ["x"], drop_null=False), probs, bins=bins, finish=finish).first()
    for p, e in zip(probs, np.percentile(vals, [p * 100 for p in probs])):
        assert got[f"q{int(round(p * 1000)):04d}"] == pytest.approx(e, rel=1e-12)


def test_quantiles_of_extreme_values(spark):
    vals = [float("-inf"), -1.7976931348623157e308, -5e-324, 0.0, 5e-324, 1.0, float("inf"), float("inf")]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    for finish in (0, 100):
        got = S.quantiles(S.long_form(df, ["x"]), [0.0, 2 / 7, 3 / 7, 1.0], names=list("abcd"), bins=4, finish=finish).first()
        assert (got["a"], got["d"]) == (float("-inf"), float("inf")) and abs(got["b"]) < 1e-300 and abs(got["c"]) < 1e-300


def test_moments_and_mode(spark):
    vals = [1.0, 2.0, 2.0, 3.0, 3.0, 10.0]
    long = S.long_form(spark.createDataFrame([(v,) for v in vals], "x double"), ["x"])
    m, z = S.moments(long).first(), (np.array(vals) - np.mean(vals)) / np.std(vals)
    assert abs(m["mean"] - np.mean(vals)) < 1e-12 and abs(m["sd"] - np.std(vals, ddof=1)) < 1e-12
    assert abs(m["g1"] - (z ** 3).mean()) < 1e-12 and abs(m["g2"] - ((z ** 4).mean() - 3)) < 1e-12
    assert S.mode(long).first()["mode"] == 2.0     # tie 2 vs 3 -> lowest
    one = S.moments(S.long_form(spark.createDataFrame([(5.0,)], "x double"), ["x"])).first()
    assert one["n_obs"] == 1 and one["sd"] is None and one["g1"] is None


def test_keyed_quantiles_and_medians(spark):
    rng = np.random.default_rng(7)
    rows = [(int(g) if g else None, float(v)) for g, v in zip(rng.integers(0, 4, 2000), rng.normal(size=2000).round(2))]
    df = spark.createDataFrame(rows, "g int, x double")
    got = {r.g: r.median for r in S.quantiles(S.long_form(df, ["x"], ["g"]), [0.5], ["g"], names=["median"], bins=8, finish=5).collect()}
    med = {r.g: r.x for r in S.medians(df, ["x"], ["g"]).collect()}
    for g in (None, 1, 2, 3):
        exp = float(np.median([v for k, v in rows if k == g]))
        assert abs(got[g] - exp) < 1e-12 and abs(med[g] - exp) < 1e-12


def test_quantiles_property_random_inputs(spark):
    from hypothesis import given, settings, strategies as st

    @settings(max_examples=5, deadline=None)
    @given(st.lists(st.integers(-50, 50), min_size=1, max_size=200), st.sampled_from([0, 10**9]))
    def check(vals, finish):
        df = spark.createDataFrame([(float(v),) for v in vals], "x double")
        r = S.quantiles(S.long_form(df, ["x"]), [0.1, 0.5, 0.9], bins=16, finish=finish).first()
        exp = np.percentile(np.array(vals, dtype=float), [10, 50, 90])
        assert np.allclose([r["q0100"], r["q0500"], r["q0900"]], exp, atol=1e-9)

    check()


def test_ties_in_one_session_are_cut(spark):
    """20,000 rows with one (session, time): no bucket holds more than a few thousand, and the numbers are 1..n."""
    df = spark.range(20_000).select(F.lit(1).alias("s"), F.lit(5).alias("t"), "id")
    cut = S.ordered_buckets(df, ["s"], ["t"], rows_per_bucket=1000).groupBy("_bk").count().collect()
    assert len(cut) >= 15 and max(r["count"] for r in cut) < 4000
    seq = A.sequence(df, "s", ["t"], hot_rows=1000)
    assert sorted(r.seq for r in seq.collect()) == list(range(1, 20_001))


def test_density_equals_the_plain_sum(spark):
    from surveyspark.operators import profile as P
    rng = np.random.default_rng(3)
    x = rng.normal(size=500)
    df = spark.createDataFrame([(float(v), 1.0) for v in x] + [(None, 1.0)], "x double, constant double")
    got = sorted((r.grid_index, r.x, r.density) for r in P.kde(df, ["x", "constant"], grid=20).collect())
    h = x.std(ddof=1) * len(x) ** -0.2
    for i, at, density in got:
        assert density == pytest.approx(np.exp(-0.5 * ((at - x) / h) ** 2).sum() / (len(x) * h * np.sqrt(2 * np.pi)))
    assert len(got) == 20
