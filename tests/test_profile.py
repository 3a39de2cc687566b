import pytest
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from surveyspark.operators import profile as P


def _df(spark, n=1200, seed=11):
    rng = np.random.default_rng(seed)
    a = rng.gamma(2.0, 3.0, n).round(2)
    b = rng.integers(0, 6, n).astype(float)
    return spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double"), a, b


def test_profile_discrete_matches_pandas(spark):
    df, a, b = _df(spark)
    got = {r.Variable: r for r in P.profile_discrete(df, ["a", "b"], digits=None).collect()}
    for name, v in (("a", a), ("b", b)):
        s = pd.Series(v)
        r = got[name]
        assert r.Effectif_Valide == len(v)
        assert math.isclose(r.Moyenne, s.mean(), rel_tol=1e-12)
        assert math.isclose(r.Ecart_Type, s.std(), rel_tol=1e-10)
        assert math.isclose(r.Q25, s.quantile(0.25), rel_tol=1e-12) and math.isclose(r.Q75, s.quantile(0.75), rel_tol=1e-12)
        assert math.isclose(r.Skewness, s.skew(), rel_tol=1e-9) and math.isclose(r.Kurtosis, s.kurtosis(), rel_tol=1e-9)
        assert r.Mode == s.mode().iloc[0]


def test_frequency_percent_base_includes_unmapped(spark):
    df = spark.createDataFrame([("1",), ("1",), ("2",), ("9",), ("NA",)], "c string")
    lk = spark.createDataFrame([("c", "1", "one"), ("c", "2", "two")], "variable string, code string, label string")
    out = {r.code: r for r in P.frequency(df, ["c"], lookup=lk).collect()}
    assert set(out) == {"1", "2"} and out["1"].n == 2 and abs(out["1"].pct - 50.0) < 1e-12


def test_histogram_matches_numpy(spark):
    df, a, _ = _df(spark)
    h = {r.bin: r.n for r in P.histogram(df, ["a"], bins=30).collect()}
    cnt, _ = np.histogram(a, bins=30, range=(a.min(), a.max()))
    assert [h.get(i, 0) for i in range(30)] == list(cnt)


def test_kde_matches_direct_sum(spark):
    df, a, _ = _df(spark, n=400)
    k = {r.grid_index: r.density for r in P.kde(df, ["a"], grid=50).collect()}
    h = a.std(ddof=1) * len(a) ** (-0.2)
    xs = np.linspace(a.min(), a.max(), 50)
    exp = np.exp(-0.5 * ((xs[:, None] - a[None, :]) / h) ** 2).sum(1) / (len(a) * h * math.sqrt(2 * math.pi))
    for i in range(50):
        assert abs(k.get(i, 0.0) - exp[i]) < 1e-10


def test_box_stats_whiskers(spark):
    df, a, _ = _df(spark)
    r = P.box_stats(df, ["a"]).first()
    q1, q3 = np.percentile(a, [25, 75])
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    inside = a[(a >= lo) & (a <= hi)]
    assert r.whisker_lo == inside.min() and r.whisker_hi == inside.max()
    assert r.n_outliers == int(((a < lo) | (a > hi)).sum())


def test_normality_test_is_named_not_chosen_by_size(spark):
    """A skewed sample of the survey's own size is not normal, and no verdict stands without a p-value."""
    import numpy as np
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(float(v),) for v in rng.exponential(size=4423).round(3)], "a double")
    r = P.profile_discrete(df, ["a"]).first()
    assert r.Distribution == "Non normale" and r.Nom_Test_Normalite == "D'Agostino-Pearson"
    sw = spark.createDataFrame([("a", 0.9, 1e-9)], "variable string, W double, p double")
    r = P.profile_discrete(df, ["a"], test="shapiro", shapiro=sw).first()
    assert (r.Nom_Test_Normalite, r.Stat_Test_Normalite, r.Distribution) == ("Shapiro-Wilk", 0.9, "Non normale")
    none = P.profile_discrete(spark.createDataFrame([(1.0,), (1.0,)], "a double"), ["a"]).first()
    assert none.p_value_Normalite is None and none.Distribution is None
    with pytest.raises(ValueError):
        P.profile_discrete(df, ["a"], test="shapiro")


def test_report_lines(spark):
    rows = [(1.0,)] * 5 + [(2.0,)] * 3 + [(4.0,)] * 2 + [(9.0,)]
    text = P.render_report(P.profile_discrete(spark.createDataFrame(rows, "rang double"), ["rang"], digits=None)).first().report
    lines = text.split("\n")
    assert len(lines) == 7 and lines[0] == "ANALYSE DE LA VARIABLE : RANG"
    assert lines[2] == "Tendance centrale : Moyenne = 2.55 | Médiane = 2.00 | Mode = 1"
    assert lines[3] == "Dispersion : Écart-type = 2.42 | Variance = 5.87 | IQR = 2.00 [Min: 1, Max: 9]"
    assert lines[5].startswith("Test de normalité (D'Agostino-Pearson) : Statistique = ")
