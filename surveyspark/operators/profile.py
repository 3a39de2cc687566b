"""Univariate profiling (AGG-2/3/4/14/15/16, STA-1, STA-3, SNK-3).

The chosen columns are stacked to (variable, value) and every statistic is an
aggregate over that form: moments in one pass, quantiles by refining bin
counts, histograms and densities as per-task sums. Only the mode counts
distinct values. No per-variable scan.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyspark.functions import fixed_values as FV
from surveyspark.operators import stats_core as S
from surveyspark.operators.clean import text_na_mask
from surveyspark.operators.joins import null_safe_join

VAR, VAL = S.VAR, S.VAL


def bias_corrected(n: Column, g1: Column, g2: Column):
    """STA-3: sample skewness G1 and excess kurtosis G2 from population g1, g2; null for fewer than 4 values."""
    n = F.when(n > 3, n.cast("double"))
    G1 = g1 * F.sqrt(n * (n - 1.0)) / (n - 2.0)
    G2 = ((n + 1.0) * g2 + 6.0) * (n - 1.0) / ((n - 2.0) * (n - 3.0))
    return G1, G2


def dagostino_p(n: Column, g1: Column, g2: Column) -> Column:
    """STA-1: D'Agostino-Pearson omnibus p-value; K2 is chi-square with 2 df, so p = exp(-K2 / 2)."""
    return F.exp(-dagostino_k2(n, g1, g2) / 2.0)


def dagostino_k2(n: Column, g1: Column, g2: Column) -> Column:
    """STA-1: omnibus statistic K2 = Z1^2 + Z2^2 from n and population g1, g2; null for fewer than 4 values."""
    n = F.when(n > 3, n.cast("double"))
    y = g1 * F.sqrt((n + 1.0) * (n + 3.0) / (6.0 * (n - 2.0)))
    beta2 = 3.0 * (n * n + 27.0 * n - 70.0) * (n + 1.0) * (n + 3.0) / (
        (n - 2.0) * (n + 5.0) * (n + 7.0) * (n + 9.0))
    w2 = -1.0 + F.sqrt(2.0 * (beta2 - 1.0))
    z1 = F.asinh(y / F.sqrt(2.0 / (w2 - 1.0))) / F.sqrt(0.5 * F.ln(w2))
    b2 = g2 + 3.0
    e = 3.0 * (n - 1.0) / (n + 1.0)
    varb2 = 24.0 * n * (n - 2.0) * (n - 3.0) / ((n + 1.0) * (n + 1.0) * (n + 3.0) * (n + 5.0))
    x = (b2 - e) / F.sqrt(varb2)
    sb1 = 6.0 * (n * n - 5.0 * n + 2.0) / ((n + 7.0) * (n + 9.0)) * F.sqrt(
        6.0 * (n + 3.0) * (n + 5.0) / (n * (n - 2.0) * (n - 3.0)))
    a = 6.0 + 8.0 / sb1 * (2.0 / sb1 + F.sqrt(1.0 + 4.0 / (sb1 * sb1)))
    d = 1.0 + x * F.sqrt(2.0 / (a - 4.0))
    term2 = F.signum(d) * F.cbrt((1.0 - 2.0 / a) / F.abs(d))
    z2 = (1.0 - 2.0 / (9.0 * a) - term2) / F.sqrt(2.0 / (9.0 * a))
    return z1 * z1 + z2 * z2


def describe(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (),
             probs: Sequence[float] = (0.25, 0.5, 0.75), with_mode: bool = False) -> DataFrame:
    """Moments and exact quantiles (and the mode, which alone needs value counts) per (keys, variable)."""
    long = S.long_form(df, cols, keys)
    gk = [*keys, VAR]
    out = null_safe_join(S.moments(long, keys), S.quantiles(long, probs, keys, names=[f"q{int(p * 100)}" for p in probs]), gk)
    return null_safe_join(out, S.mode(long, keys), gk) if with_mode else out


def profile_continuous(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """AGG-2: Variable, Effectif, Moyenne, EcartType, Min, Q1, Mediane, Q3, Max."""
    d = describe(df, cols)
    return d.select(F.col(VAR).alias("Variable"), F.col("n_obs").alias("Effectif"),
                    F.col("mean").alias("Moyenne"), F.col("sd").alias("EcartType"),
                    F.col("min").alias("Min"), F.col("q25").alias("Q1"), F.col("q50").alias("Mediane"),
                    F.col("q75").alias("Q3"), F.col("max").alias("Max"))


def profile_discrete(df: DataFrame, cols: Sequence[str], test: str = "dagostino",
                     shapiro: DataFrame | None = None, digits: int | None = 3) -> DataFrame:
    """AGG-3: full profile with normality test.

    ``test`` names the test of the report, whatever the number of rows:
    ``"dagostino"`` (D'Agostino-Pearson omnibus, from the moments) or
    ``"shapiro"``, whose statistic comes from ``inference.shapiro`` in
    ``shapiro`` (variable, W, p). A test without a p-value has no verdict.
    """
    if test not in ("dagostino", "shapiro") or (test == "shapiro" and shapiro is None):
        raise ValueError("test is 'dagostino', or 'shapiro' with its statistics")
    d = describe(df, cols, with_mode=True)
    G1, G2 = bias_corrected(F.col("n_obs"), F.col("g1"), F.col("g2"))
    n = F.col("n_obs")
    # column names are case-insensitive: the corrected moments get distinct names
    out = d.withColumns({"skew_c": G1, "kurt_c": G2})
    if test == "shapiro":
        out = out.join(shapiro.select(VAR, F.col("W").alias("_stat"), F.col("p").alias("_p")), VAR, "left")
        test_name = "Shapiro-Wilk"
    else:
        out = out.withColumns({"_stat": dagostino_k2(n, F.col("g1"), F.col("g2")),
                               "_p": dagostino_p(n, F.col("g1"), F.col("g2"))})
        test_name = "D'Agostino-Pearson"
    stat, pval = F.col("_stat"), F.col("_p")

    def rd(c, d):
        c = F.col(c) if isinstance(c, str) else c
        return c if digits is None else F.round(c, d)

    return out.select(
        F.col(VAR).alias("Variable"), F.col("n_obs").alias("Effectif_Valide"),
        rd("mean", digits).alias("Moyenne"), rd("q50", digits).alias("Mediane"),
        rd("mode", digits).alias("Mode"), rd("sd", digits).alias("Ecart_Type"),
        rd("variance", digits).alias("Variance"), F.col("min").alias("Min"), F.col("max").alias("Max"),
        rd("q25", digits).alias("Q25"), rd("q75", digits).alias("Q75"),
        rd(F.col("q75") - F.col("q25"), digits).alias("IQR"),
        rd("skew_c", digits).alias("Skewness"), rd("kurt_c", digits).alias("Kurtosis"),
        F.lit(test_name).alias("Nom_Test_Normalite"), rd(stat, 4).alias("Stat_Test_Normalite"),
        pval.alias("p_value_Normalite"),
        F.when(pval < 0.05, "Non normale").when(pval >= 0.05, "Normale").alias("Distribution"))


def dagostino(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """STA-1: (variable, n, K2, p) per column."""
    mom = S.moments(S.long_form(df, cols))
    k2 = dagostino_k2(F.col("n_obs"), F.col("g1"), F.col("g2"))
    return mom.select(VAR, "n_obs", k2.alias("k2"), F.exp(-k2 / 2.0).alias("p_value"))


def shape_moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """STA-3: (variable, skewness G1, kurtosis G2), bias-corrected."""
    mom = S.moments(S.long_form(df, cols))
    G1, G2 = bias_corrected(F.col("n_obs"), F.col("g1"), F.col("g2"))
    return mom.select(VAR, G1.alias("skewness"), G2.alias("kurtosis"))


def frequency(df: DataFrame, cols: Sequence[str], lookup: DataFrame | None = None,
              text_nulls: Sequence[str] = tuple(FV.TEXT_NULLS), keep_unmapped: bool = False) -> DataFrame:
    """AGG-4: (variable, code, n, pct[, label]) per categorical column.

    Text nulls are dropped first (FLT-5); the percent base is every remaining
    row. Codes that the lookup doesn't map are dropped after the percentages (FLT-6); with
    ``keep_unmapped`` they stay with a null label, so that none is lost unseen.
    """
    arr = F.array(*[F.struct(F.lit(x).alias(VAR), F.col(x).cast("string").alias("code")) for x in cols])
    long = df.select(F.explode(arr).alias("_s")).select("_s.*")
    long = long.where(text_na_mask("code", text_nulls)).withColumn("code", F.trim("code"))
    cnt = long.groupBy(VAR, "code").agg(F.count(F.lit(1)).alias("n"))
    tot = cnt.groupBy(VAR).agg(F.sum("n").alias("_tot"))
    out = cnt.join(F.broadcast(tot), VAR).withColumn("pct", F.col("n") * 100.0 / F.col("_tot")).drop("_tot")
    if lookup is not None:
        lk = lookup.select(VAR, F.col("code").cast("string").alias("code"), "label")
        from surveyspark.functions.exprs import bounded_broadcast
        out = out.join(bounded_broadcast(lk, 1_000_000), [VAR, "code"], "left" if keep_unmapped else "inner")
    return out


def histogram(df: DataFrame, cols: Sequence[str], bins: int = 30, density: bool = True) -> DataFrame:
    """AGG-14: fixed-count equal-width bins from min to max: (variable, bin, lo, hi, n[, density]).

    One pass for the ends and one for the counts; a task shuffles at most ``bins`` rows per variable.
    """
    long = S.long_form(df, cols)
    rng = long.groupBy(VAR).agg(F.min(VAL).alias("_mn"), F.max(VAL).alias("_mx"), F.count(VAL).alias("_N"))
    width = (F.col("_mx") - F.col("_mn")) / float(bins)
    j = long.join(F.broadcast(rng), VAR).withColumn("_w", width)
    b = F.when(F.col("_w") > 0, F.least(F.floor((F.col(VAL) - F.col("_mn")) / F.col("_w")),
                                        F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    h = j.withColumn("bin", b).groupBy(VAR, "bin", "_mn", "_w", "_N").agg(F.count(F.lit(1)).alias("n"))
    out = h.select(VAR, "bin", (F.col("_mn") + F.col("bin") * F.col("_w")).alias("lo"),
                   (F.col("_mn") + (F.col("bin") + 1) * F.col("_w")).alias("hi"),
                   F.col("n").cast("long").alias("n"),
                   F.try_divide(F.col("n"), F.col("_N") * F.col("_w")).alias("density"))
    return out if density else out.drop("density")


def kde(df: DataFrame, cols: Sequence[str], grid: int = 100) -> DataFrame:
    """AGG-15: Gaussian kernel density on an even grid from min to max.

    Bandwidth = sample sd * n^(-1/5) (Scott). Each task keeps one array of
    ``grid`` sums per variable and adds its Arrow batches to it, so a task
    shuffles ``grid`` rows per variable, whatever the number of rows.
    """
    import numpy as np
    import pyarrow as pa

    long = S.long_form(df, cols)
    # one row per variable
    facts = {r[VAR]: r for r in S.moments(long).collect()}
    plan = {c: (r["n_obs"], r["min"], (r["max"] - r["min"]) / (grid - 1), r["sd"] * r["n_obs"] ** -0.2)
            for c, r in facts.items() if r["sd"] and r["max"] > r["min"]}
    names = [c for c in cols if c in plan]

    def added(batches):
        sums = np.zeros((len(names), grid))
        for batch in batches:
            for i, c in enumerate(names):
                _, lo, step, h = plan[c]
                v = batch.column(i).drop_null().to_numpy(zero_copy_only=False)
                at = lo + np.arange(grid) * step
                for start in range(0, len(v), 4096):
                    u = (at[:, None] - v[None, start:start + 4096]) / h
                    sums[i] += np.exp(-0.5 * u * u).sum(axis=1)
        yield pa.RecordBatch.from_pydict({VAR: pa.array(np.repeat(names, grid).tolist(), pa.string()),
                                          "g": pa.array(np.tile(np.arange(grid, dtype=np.int32), len(names))), "s": sums.ravel()})

    schema = f"{VAR} string, g int, s double"
    if not names:
        parts = df.sparkSession.createDataFrame([], schema)
    else:
        parts = df.select(*[F.col(c).cast("double").alias(c) for c in names]).mapInArrow(added, schema)
    known = df.sparkSession.createDataFrame([(c, float(n), float(lo), float(st), float(h)) for c, (n, lo, st, h) in plan.items()],
                                            f"{VAR} string, _N double, _mn double, _st double, _h double")
    agg = parts.groupBy(VAR, "g").agg(F.sum("s").alias("_s")).join(F.broadcast(known), VAR)
    return agg.select(VAR, F.col("g").alias("grid_index"), (F.col("_mn") + F.col("g") * F.col("_st")).alias("x"),
                      (F.col("_s") / (F.col("_N") * F.col("_h") * math.sqrt(2 * math.pi))).alias("density"))


def box_stats(df: DataFrame, cols: Sequence[str], k: float = 1.5) -> DataFrame:
    """AGG-16: quartiles, whiskers (most extreme values within k IQR), outlier count, mean."""
    long = S.long_form(df, cols)
    # one row per variable
    q = F.broadcast(S.quantiles(long, [0.25, 0.5, 0.75], names=["q1", "median", "q3"]))
    iqr = F.col("q3") - F.col("q1")
    lo_f, hi_f = F.col("q1") - k * iqr, F.col("q3") + k * iqr
    inside = (F.col(VAL) >= lo_f) & (F.col(VAL) <= hi_f)
    return long.join(q, VAR).groupBy(VAR, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col(VAL))).alias("whisker_lo"),
        F.max(F.when(inside, F.col(VAL))).alias("whisker_hi"),
        F.count_if(~inside).alias("n_outliers"), F.avg(VAL).alias("mean"))


def _plain(col: str) -> Column:
    """A number as the report prints it: whole numbers without decimals."""
    whole = F.col(col) == F.floor(col)
    return F.when(whole, F.col(col).cast("long").cast("string")).otherwise(F.col(col).cast("string"))


def render_report(profile: DataFrame) -> DataFrame:
    """SNK-3: one 7-line text block per variable from a ``profile_discrete(digits=None)`` frame."""
    p = profile
    lines = (
        F.concat(F.lit("ANALYSE DE LA VARIABLE : "), F.upper("Variable")),
        F.lit("-" * 40),
        F.format_string("Tendance centrale : Moyenne = %.2f | Médiane = %.2f | Mode = %s",
                        F.col("Moyenne"), F.col("Mediane"), _plain("Mode")),
        F.format_string("Dispersion : Écart-type = %.2f | Variance = %.2f | IQR = %.2f [Min: %s, Max: %s]",
                        F.col("Ecart_Type"), F.col("Variance"), F.col("IQR"), _plain("Min"), _plain("Max")),
        F.format_string("Forme de la distribution : Skewness = %.2f | Kurtosis = %.2f",
                        F.col("Skewness"), F.col("Kurtosis")),
        F.format_string("Test de normalité (%s) : Statistique = %.4f, p-value = %.4e",
                        F.col("Nom_Test_Normalite"), F.col("Stat_Test_Normalite"), F.col("p_value_Normalite")),
        F.concat(F.lit("Conclusion : La distribution est "), F.coalesce("Distribution", F.lit("indéterminée")), F.lit(".")))
    return p.select("Variable", F.concat_ws("\n", *lines).alias("report"))
