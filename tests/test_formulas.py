"""Formula tests against the published numbers (n = 4423)."""
import math

from surveyspark.functions.normal import shapiro_p_from_w, swilk
import numpy as np


def _dag_p(n, G1, G2):
    # invert the bias corrections to population g1, g2, then the omnibus formula
    g1 = G1 * (n - 2) / math.sqrt(n * (n - 1))
    g2 = (G2 * (n - 2) * (n - 3) / (n - 1) - 6) / (n + 1)
    y = g1 * math.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + math.sqrt(2 * (b - 1))
    z1 = math.asinh(y / math.sqrt(2 / (w2 - 1))) / math.sqrt(0.5 * math.log(w2))
    x = (g2 + 3 - 3 * (n - 1) / (n + 1)) / math.sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5)))
    s = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / s * (2 / s + math.sqrt(1 + 4 / s ** 2))
    d = 1 + x * math.sqrt(2 / (a - 4))
    z2 = (1 - 2 / (9 * a) - math.copysign(1, d) * ((1 - 2 / a) / abs(d)) ** (1 / 3)) / math.sqrt(2 / (9 * a))
    return math.exp(-(z1 * z1 + z2 * z2) / 2)


def test_dagostino_matches_published_p(spark):
    # published rounded moments .358 / -.469 give an interval containing the published 1.7746e-35
    lo = min(_dag_p(4423, g1, g2) for g1 in (0.3575, 0.3585) for g2 in (-0.4695, -0.4685))
    hi = max(_dag_p(4423, g1, g2) for g1 in (0.3575, 0.3585) for g2 in (-0.4695, -0.4685))
    assert lo <= 1.7746e-35 <= hi


def test_dagostino_spark_matches_python(spark):
    from pyspark.sql import functions as F
    from surveyspark.operators.profile import bias_corrected, dagostino_p
    n, G1, G2 = 4423, 0.358, -0.469
    g1 = G1 * (n - 2) / math.sqrt(n * (n - 1))
    g2 = (G2 * (n - 2) * (n - 3) / (n - 1) - 6) / (n + 1)
    df = spark.createDataFrame([(n, g1, g2)], "n long, g1 double, g2 double")
    r = df.select(dagostino_p(F.col("n"), F.col("g1"), F.col("g2")).alias("p"),
                  *[c.alias(k) for c, k in zip(bias_corrected(F.col("n"), F.col("g1"), F.col("g2")), "ab")]).first()
    assert math.isclose(r["p"], _dag_p(n, G1, G2), rel_tol=1e-9)
    assert math.isclose(r["a"], G1, rel_tol=1e-9) and math.isclose(r["b"], G2, rel_tol=1e-9)


def test_shapiro_tail_matches_published():
    for w, pub in ((0.9808, 4.651e-24), (0.9510, 4.199e-36), (0.8880, 6.546e-49)):
        p = shapiro_p_from_w(w, 4423)
        assert 0.85 * pub < p < 1.15 * pub


def test_swilk_normal_and_skewed():
    rng = np.random.default_rng(0)
    w, p = swilk(rng.normal(size=500))
    assert w > 0.99 and p > 0.01
    w2, p2 = swilk(rng.exponential(size=500))
    assert w2 < 0.95 and p2 < 1e-6
