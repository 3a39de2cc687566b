"""Models, tuning, inference and model sinks bound to the test tables.

Model queries are rows-only checks (different algorithms than the reference's
libraries); the closed-form inference tables carry DuckDB oracles.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyspark.functions import fixed_values as FV
from surveyspark.operators import aggregate as A
from surveyspark.operators import clean as C
from surveyspark.operators import derive as D
from surveyspark.operators import evaluate as EV
from surveyspark.operators import features as FE
from surveyspark.operators import inference as INF
from surveyspark.operators import models as M
from surveyspark.operators import split as SP
from surveyspark.operators.encoder import fit_encoder
from surveyspark.operators.joins import attach_split, null_safe_join, with_scalars
from surveyspark.plans.q_eval import SCORED_SQL, scored, split_table
from surveyspark.plans.registry import query
from surveyspark.plans.sqlgen import values_sql
from surveyspark.plans.tables import OBS_SQL, ROW_KEY, SURVEY_FIELDS, SURVEY_SQL, observations, read, survey_records
from surveyspark.session import staged
from surveyspark.sources import sinks

SV, O = SURVEY_SQL, OBS_SQL
#: the 39 model features: 34 record fields and the five derived ones (ageenfant_carre belongs to the formulas)
CONT = ["rangdenaissance", "hemoglobinemere", "intervalleintergenesique", "dureeallaitement", "agemere", "nombreenfantsnesvivants",
        "nombrevisitesprenatales", "nombremembresmenage", "ageenfant", "imcmere", "ratio_charge_menage"]
CATS = ["sexeenfant", "milieuderesidence", "niveauinstructionmere", "indicederichesse", "region", "vaccine_status", "vaccinbcg",
        "diarrhee", "prisededecisionmere", "statutmatrimonialmere", "tailleanaissance", "sourceeaupotable",
        "typeinstallationssanitaires", "typecombustiblecuisine", "lieuderesidence", "regionecologique", "vaccinpolio0",
        "vaccinpolio1", "vaccinpolio2", "vaccinpolio3", "vaccindtp1", "vaccindtp2", "vaccindtp3", "vaccinrougeole1",
        "eau_amelioree", "toilettes_ameliorees", "index_wash_synergie", "pauvrete_rurale"]
FEATURES = CONT + CATS


def _r(c, d=6):
    return F.round(c, d)


def split_records(spark, sf):
    """Survey records with derived features, split, encoding fold (SPL-4) and tuning fold (SPL-3), staged.

    The rate of the balanced weights and the cluster folds come from passes over a few columns; whole
    records are shuffled once, for SPL-4, without the columns that can be derived afterwards: their hash, the
    split, the cluster folds, the weights and the derived features.
    """
    from surveyspark.functions.exprs import materialize_small
    st = materialize_small(split_table(spark, sf), 5_000_000)
    base = survey_records(spark, sf).select(*ROW_KEY, "y", "y1", "y2", "y3", "w", *SURVEY_FIELDS)
    gf = materialize_small(SP.group_kfold(base, "cluster", 3, seed=1).withColumnRenamed("fold", "gfold"), 5_000_000)
    df = SP.stratified_kfold(base, "y", ROW_KEY, 5, seed=5)
    df = null_safe_join(attach_split(df, st, "cluster"), gf, ["cluster"])
    df = FE.balance_weights(df, "y", "w", "w_bal", split="split", rate_of=attach_split(base, st, "cluster"))
    df = D.derive_features(df).withColumn("label", F.col("y").cast("double"))
    return staged(df.select(*ROW_KEY, "split", "y", "y1", "y2", "y3", "w", *FEATURES, "fold", "gfold", "label", "w_bal"), "records")


def fitted_encoder(df):
    return fit_encoder(df.where(F.col("split") == "train"), CONT, CATS, "label", "fold")


def encoded(spark, sf):
    """FEA-3 + FEA-4 on the split survey records: features vector, label, balanced weight.

    The records and the encoded columns are staged as columnar files in the cluster's shared folder:
    iterative learners then read a short lineage, a lost executor reads again, and a reader of the vector
    alone reads no record fields. The vector is assembled from its columns as they are read.
    """
    df = split_records(spark, sf)
    enc = fitted_encoder(df)
    names = enc.feature_names()
    out = enc.encode(df, F.col("split") == "train").select(
        *ROW_KEY, "split", "y", "y1", "y2", "y3", "w", "gfold", "label", "w_bal", *names)
    return enc.assembled(staged(out, "encoded")), names


def _fit_and_table(spark, sf, est):
    df, _ = encoded(spark, sf)
    m = est.fit(df.where(F.col("split") == "train"))
    s = M.positive_probability(m.transform(df))
    t = EV.partition_table(s, "y", "prob", "w")
    return t.select("split", *[_r(F.col(c), 4).alias(c) for c in ("auc", "log_loss", "f1_macro", "gap_vs_train")])


TUNING_DRAWS = 6
SVM_FEATURES = 64


@query("mdl01_ridge_logistic")
def mdl01(spark, sf):
    return _fit_and_table(spark, sf, M.ridge_logistic(C=1.0, weight="w_bal"))


@query("mdl02_random_forest")
def mdl02(spark, sf):
    return _fit_and_table(spark, sf, M.six_models("w_bal")["random_forest"])


@query("mdl03_boosted_trees")
def mdl03(spark, sf):
    return _fit_and_table(spark, sf, M.six_models("w_bal")["boosted_a"])


@query("mdl04_perceptron")
def mdl04(spark, sf):
    return _fit_and_table(spark, sf, M.six_models("w_bal", len(FEATURES))["perceptron"])


@query("mdl05_rbf_svm")
def mdl05(spark, sf):
    return _fit_and_table(spark, sf, M.RbfSvm(C=1.0, gamma=0.02, nFeatures=SVM_FEATURES, weightCol="w_bal", maxIter=30, foldCol="gfold"))


@query("mdl08_compete")
def mdl08(spark, sf):
    """The six models on 39 features, scored on every partition."""
    df, names = encoded(spark, sf)
    _, table = M.compete(df.where(F.col("split") == "train"), df, M.six_models("w_bal", len(names)), "label", "w", "split")
    return table.select("model", "split", *[_r(F.col(c), 4).alias(c) for c in ("auc", "log_loss", "f1_macro")])


@query("mdl08b_best_model")
def mdl08b(spark, sf):
    """MDL-8 carried on to EVL-8 and TOP-1: the gap table of the six models and the winner on the test partition."""
    df, names = encoded(spark, sf)
    models = M.six_models("w_bal", len(names))
    scored_all = M.scored_by_all(M.fit_all(df.where(F.col("split") == "train"), models), df, ["split", "label", "w"])
    gaps = EV.gap_table(scored_all, "label", "prob", "w")
    order = spark.createDataFrame([(m, i) for i, m in enumerate(models)], "model string, ordinal int")
    best = A.best_model(gaps.join(F.broadcast(order), "model"), "auc_test").select(F.col("model").alias("best"))
    return with_scalars(gaps, best).select("model", *[_r(F.col(c), 4).alias(c) for c in ("auc_train", "auc_test", "delta_auc")], "diagnostic",
                                           (F.col("model") == F.col("best")).alias("is_best"))


def _searched(spark, sf, estimator, space):
    df, _ = encoded(spark, sf)
    found, res = M.random_search(estimator, space, df.where(F.col("split") == "train"), "gfold", n_draws=TUNING_DRAWS, seed=2018)
    chosen = ", ".join(f"{k}={found['params'][k]}" for k in sorted(found["params"]))
    return res.select("draw", "params", _r(F.col("mean_auc"), 4).alias("mean_auc"), (F.col("params") == chosen).alias("chosen"))


@query("tun01_random_search")
def tun01(spark, sf):
    """TUN-1 on the boosted trees' space."""
    return _searched(spark, sf, M.boosted_trees(weight="w_bal"), M.BOOSTED_SPACE)


@query("tun01b_svm_search")
def tun01b(spark, sf):
    """TUN-1 on the kernel classifier's space."""
    return _searched(spark, sf, M.RbfSvm(nFeatures=SVM_FEATURES, weightCol="w_bal", maxIter=10, folds=2), M.SVM_SPACE)


@query("tun02_learning_curve")
def tun02(spark, sf):
    df, _ = encoded(spark, sf)
    tr = df.where(F.col("split") == "train")
    lc = M.learning_curve(lambda: M.ridge_logistic(C=1.0, weight="w_bal", max_iter=25), tr,
                          [0.2, 0.4, 0.6, 0.8, 1.0], "gfold", 11, ROW_KEY, y="label")
    return lc.select("size", _r(F.col("train"), 4).alias("train_auc"), _r(F.col("validation"), 4).alias("validation_auc"))


@query("evl11b_importance_of_fitted")
def evl11b(spark, sf):
    """EVL-11 on a fitted model: every one of the 39 features of the test partition, two repeats."""
    df, names = encoded(spark, sf)
    model = M.ridge_logistic(C=1.0, weight="w_bal").fit(df.where(F.col("split") == "train"))

    def score(frame):
        return M.positive_probability(model.transform(M.assemble(frame, names)))

    imp = EV.permutation_importance(df.where(F.col("split") == "test"), names, score, "label", ROW_KEY, repeats=2, seed=2018, at_once=13)
    return imp.select("feature", _r(F.col("importance_mean"), 5).alias("importance_mean"), _r(F.col("importance_sd"), 5).alias("importance_sd"))


@query("jn03_model_transform", f"""
SELECT split, COUNT(*) AS n, COUNT(*) AS n_scored FROM {SCORED_SQL} b GROUP BY split""")
def jn03(spark, sf):
    df, _ = encoded(spark, sf)
    m = M.ridge_logistic(weight="w_bal").fit(df.where(F.col("split") == "train"))
    s = M.positive_probability(m.transform(df))
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count("prob").alias("n_scored"))


@query("snk04_save_if")
def snk04(spark, sf):
    df, _ = encoded(spark, sf)
    m = M.ridge_logistic(weight="w_bal").fit(df.where(F.col("split") == "train"))
    s = M.positive_probability(m.transform(df.where(F.col("split") == "stress")))
    auc = EV.weighted_auc(s, "y", "prob", "w").collect()[0]["auc"]
    rates = df.where((F.col("split") == "train") & (F.col("y") == 1)).agg(
        *[F.avg(F.col(c).cast("double")).alias(c) for c in ("y1", "y2", "y3")])
    path = sinks.output_path(spark, "model_gate")
    saved = M.save_if(m, auc, FV.QUALITY_GATE_AUC, path, {"rates": rates})
    return spark.createDataFrame([(float(auc), FV.QUALITY_GATE_AUC, bool(saved))],
                                 "stress_auc DOUBLE, gate DOUBLE, saved BOOLEAN")


@query("snk05_export_matrix")
def snk05(spark, sf):
    df, names = encoded(spark, sf)
    path = sinks.output_path(spark, "encoded_matrix")
    sinks.export_matrix(df.where(F.col("split") == "train"), "features", names, "y", path)
    back = spark.read.parquet(path)
    return back.agg(F.count(F.lit(1)).alias("n"), *[_r(F.avg(c), 4).alias(c) for c in names])


# ---------------------------------------------------------------- inference

#: the two formulas of the weighted regression (fixed values)
FIRST_FORMULA = ("y ~ ageenfant + C(sexeenfant) + C(milieuderesidence) + C(niveauinstructionmere) + C(indicederichesse) + C(region) + "
                 "C(sourceeaupotable) + C(typeinstallationssanitaires)")
FINAL_FORMULA = ("y ~ ageenfant + ageenfant_carre + C(sexeenfant) + C(milieuderesidence) + C(indicederichesse) + C(education_mere_opt) + "
                 "C(eau_amelioree) + C(toilettes_ameliorees)")


def glm_frame(spark, sf):
    """Survey records with the derived and regrouped columns of the formulas."""
    return C.recode(D.derive_features(survey_records(spark, sf)), "niveauinstructionmere", {3: 2}, "education_mere_opt")


def _coefficients(t):
    return t.select("term", _r(F.col("Coefficient_Beta"), 5).alias("beta"), _r(F.col("Erreur_Type_Robuste"), 5).alias("se"),
                    _r(F.col("p_value"), 6).alias("p_value"))


@query("mdl06_weighted_glm")
def mdl06(spark, sf):
    """MDL-6: the first formula, model-based errors."""
    return _coefficients(INF.formula_glm(glm_frame(spark, sf), FIRST_FORMULA, "w"))


@query("sta05_cluster_cov")
def sta05(spark, sf):
    """STA-5: the final formula with cluster-robust errors."""
    return _coefficients(INF.formula_glm(glm_frame(spark, sf), FINAL_FORMULA, "w", "cluster"))


_CELLS = f"""x AS (SELECT CAST(milieuderesidence = 2 AS INTEGER) AS c, y, w, cluster FROM {SV} s),
m AS (SELECT SUM(w * y) FILTER (c = 0) / SUM(w) FILTER (c = 0) AS m0, SUM(w * y) FILTER (c = 1) / SUM(w) FILTER (c = 1) AS m1,
  SUM(w) FILTER (c = 0) AS w0, SUM(w) FILTER (c = 1) AS w1, COUNT(*) AS n, COUNT(DISTINCT cluster) AS g FROM x),
b AS (SELECT *, w0 * m0 * (1 - m0) AS b0, w1 * m1 * (1 - m1) AS b1, ln(m0 / (1 - m0)) AS beta0, ln(m1 / (1 - m1)) - ln(m0 / (1 - m0)) AS beta1 FROM m)"""


@query("mdl06b_glm_closed_form", f"""
WITH {_CELLS} SELECT 'Intercept' AS term, ROUND(beta0, 4) AS beta, ROUND(sqrt(1 / b0), 5) AS se FROM b
UNION ALL SELECT 'C(milieuderesidence)[T.2]', ROUND(beta1, 4), ROUND(sqrt(1 / b0 + 1 / b1), 5) FROM b""")
def mdl06b(spark, sf):
    """MDL-6 where the fit has a closed form: one factor of two levels."""
    t = INF.formula_glm(glm_frame(spark, sf), "y ~ C(milieuderesidence)", "w")
    return t.select("term", _r(F.col("Coefficient_Beta"), 4).alias("beta"), _r(F.col("Erreur_Type_Robuste"), 5).alias("se"))


@query("sta05b_cluster_closed_form", f"""
WITH {_CELLS}, s AS (SELECT cluster, SUM(CASE WHEN c = 0 THEN w * (y - m0) ELSE 0 END) AS s0, SUM(CASE WHEN c = 1 THEN w * (y - m1) ELSE 0 END) AS s1
  FROM x, m GROUP BY cluster),
v AS (SELECT SUM(s0 * s0) AS a00, SUM(s0 * s1) AS a01, SUM(s1 * s1) AS a11 FROM s),
f AS (SELECT *, CAST(g AS DOUBLE) / (g - 1) * (n - 1) / (n - 2) AS fac FROM b, v)
SELECT 'Intercept' AS term, ROUND(sqrt(fac * a00 / (b0 * b0)), 5) AS robust_se FROM f
UNION ALL SELECT 'C(milieuderesidence)[T.2]', ROUND(sqrt(fac * (a11 / (b1 * b1) + a00 / (b0 * b0) - 2 * a01 / (b0 * b1))), 5) FROM f""")
def sta05b(spark, sf):
    """STA-5 where the sandwich has a closed form."""
    t = INF.formula_glm(glm_frame(spark, sf), "y ~ C(milieuderesidence)", "w", "cluster")
    return t.select("term", _r(F.col("Erreur_Type_Robuste"), 5).alias("robust_se"))


@query("sta06b_odds_from_fit")
def sta06b(spark, sf):
    """STA-6 and STA-10 from the robust fit of the final formula, with display labels."""
    odds = INF.odds_ratios(INF.formula_glm(glm_frame(spark, sf), FINAL_FORMULA, "w", "cluster"))
    lk = spark.createDataFrame(list(FV.TERM_LABELS.items()), "term STRING, label STRING")
    f = INF.forest_table(odds, lk).join(odds.select("term", "Significatif"), "term")
    return f.select("term", "label", *[_r(F.col(c), 5).alias(c) for c in ("AOR", "err_low", "err_high")], "Significatif")


@query("mdl07_null_model", f"""
SELECT ROUND(SUM(w * y) / SUM(w), 8) AS p0,
  ROUND(SUM(w * y) * ln(SUM(w * y) / SUM(w)) + (SUM(w) - SUM(w * y)) * ln(1 - SUM(w * y) / SUM(w)), 4) AS ll0
FROM {O} o""")
def mdl07(spark, sf):
    n = INF.null_model(observations(spark, sf), "y", "w")
    return n.select(_r(F.col("p0"), 8).alias("p0"), _r(F.col("ll0"), 4).alias("ll0"))


@query("sta07_mcfadden", f"""
WITH l AS (SELECT SUM(w * (y * ln(GREATEST(LEAST(p, 1 - 1e-15), 1e-15)) + (1 - y) * ln(1 - GREATEST(LEAST(p, 1 - 1e-15), 1e-15)))) AS ll,
  SUM(w * y) AS s1, SUM(w) AS sw FROM {O} o),
n AS (SELECT ll, s1 * ln(s1 / sw) + (sw - s1) * ln(1 - s1 / sw) AS ll0 FROM l)
SELECT ROUND(ll, 4) AS ll, ROUND(ll0, 4) AS ll0, ROUND(1 - ll / ll0, 6) AS r2_mcfadden FROM n""")
def sta07(spark, sf):
    m = INF.mcfadden(observations(spark, sf), "y", "p", "w")
    return m.select(_r(F.col("ll"), 4).alias("ll"), _r(F.col("ll0"), 4).alias("ll0"),
                    _r(F.col("r2_mcfadden")).alias("r2_mcfadden"))


@query("sta08_link_test")
def sta08(spark, sf):
    t = INF.link_test(observations(spark, sf).withColumn("p", F.greatest(F.least("p", F.lit(0.99)), F.lit(0.01))),
                      "y", "p", "w", "cluster")
    return t.select("term", _r(F.col("Coefficient_Beta"), 5).alias("beta"), _r(F.col("p_value"), 6).alias("p_value"))


@query("sta09_diagnostics")
def sta09(spark, sf):
    obs = observations(spark, sf).withColumn("p", F.greatest(F.least("p", F.lit(0.99)), F.lit(0.01)))
    m = INF.mcfadden(obs, "y", "p", "w").collect()[0]
    lt = {r["term"]: r["p_value"] for r in INF.link_test(obs, "y", "p", "w", "cluster").collect()}
    return INF.diagnostics(spark, m["r2_mcfadden"], lt["hat_z"], lt["hat_z_sq"], m["ll"]).select(
        "Indicateur_Diagnostic", _r(F.col("Valeur"), 6).alias("Valeur"), "Statut_Validation")


@query("sta02_shapiro")
def sta02(spark, sf):
    s = INF.shapiro(read(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"],
                    ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], cap=5000, seed=42)
    return s.select("variable", "n", _r(F.col("W"), 6).alias("W"), "p")


@query("win03_order_stats", """
WITH l AS (SELECT 'l_quantity' AS variable, CAST(l_quantity AS DOUBLE) AS value, * FROM lineitem
  UNION ALL SELECT 'l_extendedprice', CAST(l_extendedprice AS DOUBLE), * FROM lineitem),
h AS (SELECT variable, value, row_number() OVER (PARTITION BY variable ORDER BY md5('42:' || concat_ws('|', CAST(l_orderkey AS VARCHAR),
  CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), variable))) AS r FROM l WHERE value IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY value) AS i FROM h WHERE r <= 5000)
SELECT variable, COUNT(*) AS n, MIN(i) AS first_rank, MAX(i) AS last_rank, ROUND(SUM(value), 2) AS value_sum,
  ROUND(SUM(value * i) / SUM(i), 4) AS rank_mean FROM o GROUP BY variable""")
def win03(spark, sf):
    o = INF.order_stats(read(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"],
                        ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], cap=5000, seed=42)
    return o.groupBy("variable").agg(F.count(F.lit(1)).alias("n"), F.min("i").cast("long").alias("first_rank"),
                                     F.max("i").cast("long").alias("last_rank"), _r(F.sum("value"), 2).alias("value_sum"),
                                     _r(F.sum(F.col("value") * F.col("i")) / F.sum("i"), 4).alias("rank_mean"))


_IND = ["y1", "y2", "y3"]


@query("sta04_burt_matrix", f"""
WITH w AS (SELECT {', '.join(f"CAST({x} = {v} AS DOUBLE) AS {x}_{v}" for x in _IND for v in (0, 1))} FROM {O} o)
{' UNION ALL '.join(f"SELECT '{a}' AS row, '{b}' AS col, ROUND(SUM({a} * {b}), 4) AS value FROM w"
                    for a in [f"{x}_{v}" for x in _IND for v in (0, 1)] for b in [f"{x}_{v}" for x in _IND for v in (0, 1)])}""")
def sta04(spark, sf):
    b = INF.burt_matrix(observations(spark, sf), _IND)
    return b.select("row", "col", _r(F.col("value"), 4).alias("value"))


@query("sta04b_mca_weights")
def sta04b(spark, sf):
    r = INF.mca_weights(observations(spark, sf), _IND)
    rows = [(k, float(v), float(r["inertia"]), float(r["adjusted_inertia"])) for k, v in r["weights"].items()]
    return spark.createDataFrame(rows, "indicator STRING, weight DOUBLE, inertia DOUBLE, adjusted_inertia DOUBLE")


_XBIN = "CAST(milieuderesidence = 2 AS INTEGER)"
_TT = f"""(SELECT SUM(CASE WHEN x = 0 AND y = 0 THEN w ELSE 0 END) AS n00, SUM(CASE WHEN x = 0 AND y = 1 THEN w ELSE 0 END) AS n01,
  SUM(CASE WHEN x = 1 AND y = 0 THEN w ELSE 0 END) AS n10, SUM(CASE WHEN x = 1 AND y = 1 THEN w ELSE 0 END) AS n11
  FROM (SELECT {_XBIN} AS x, y, w FROM {SV} s))"""
_COEF = f"""(SELECT 'Intercept' AS term, ln(n01 / n00) AS b, sqrt(1 / n01 + 1 / n00) AS se FROM {_TT} t
  UNION ALL SELECT 'C(rural)[T.1]', ln(n11 / n10) - ln(n01 / n00), sqrt(1 / n00 + 1 / n01 + 1 / n10 + 1 / n11) FROM {_TT} t)"""


def _tt(spark, sf):
    sv = survey_records(spark, sf).withColumn("rural", (F.col("milieuderesidence") == 2).cast("int"))
    return INF.two_by_two_logit(sv, "y", "rural", "w", term="C(rural)[T.1]")


@query("sta06_odds_ratios", f"""
SELECT term, ROUND(exp(b), 6) AS AOR, ROUND(exp(b - 1.959963984540054 * se), 6) AS IC_95_Bas,
  ROUND(exp(b + 1.959963984540054 * se), 6) AS IC_95_Haut,
  CASE WHEN abs(b / se) > 2.5758293035489004 THEN '*** (p<0.01)' WHEN abs(b / se) > 1.959963984540054 THEN '** (p<0.05)'
       ELSE 'NS' END AS Significatif FROM {_COEF} c""")
def sta06(spark, sf):
    o = INF.odds_ratios(_tt(spark, sf))
    return o.select("term", *[_r(F.col(c)).alias(c) for c in ("AOR", "IC_95_Bas", "IC_95_Haut")], "Significatif")


_FLABELS = [("C(rural)[T.1]", "Milieu de residence : Rural (Ref: Urbain)")]


@query("sta10_forest_table", f"""
SELECT c.term, COALESCE(k.label, c.term) AS label, ROUND(exp(b), 6) AS AOR,
  ROUND(exp(b) - exp(b - 1.959963984540054 * se), 6) AS err_low, ROUND(exp(b + 1.959963984540054 * se) - exp(b), 6) AS err_high
FROM {_COEF} c LEFT JOIN {values_sql(_FLABELS, ['term', 'label'], 'k')} ON c.term = k.term WHERE c.term <> 'Intercept'""")
def sta10(spark, sf):
    lk = spark.createDataFrame(_FLABELS, "term STRING, label STRING")
    f = INF.forest_table(INF.odds_ratios(_tt(spark, sf)), lk)
    return f.select("term", "label", *[_r(F.col(c)).alias(c) for c in ("AOR", "err_low", "err_high")])
