"""Explanation rules, scoring pipeline and decision tables bound to the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyspark.functions import fixed_values as FV
from surveyspark.operators import aggregate as A
from surveyspark.operators import derive as D
from surveyspark.operators import features as FE
from surveyspark.operators import profile as P
from surveyspark.operators import score as SC
from surveyspark.plans.registry import query
from surveyspark.plans.sqlgen import dagostino_sql, long_sql, moments_cte, values_sql
from surveyspark.plans.tables import SURVEY_FIELDS, SURVEY_SQL, read, survey_records

SV = SURVEY_SQL


def _r(c, d=6):
    return F.round(c, d)


# ---------------------------------------------------------------- rule engine (DRV-17)

_RULES_SQL = [  # (kind, SQL condition, label) - same rules as derive.factor_rules
    ("R", "ageenfant >= 6 AND ageenfant <= 23", "Âge critique"),
    ("P", "ageenfant > 36", "Âge favorable"),
    ("P", "niveauinstructionmere >= 2", "Éducation maternelle"),
    ("R", "niveauinstructionmere = 0", "Absence de scolarisation"),
    ("R", "imcmere < 18.5", "Maigreur maternelle"),
    ("P", "imcmere >= 18.5 AND imcmere <= 25", "IMC maternel optimal"),
    ("R", "indicederichesse <= 2", "Pauvreté ménage"),
    ("P", "indicederichesse >= 4", "Aisance financière"),
    ("R", "milieuderesidence = 2", "Milieu rural"),
    ("P", "milieuderesidence <> 2", "Milieu urbain"),
    ("R", "hemoglobinemere < 11.0", "Anémie maternelle"),
    ("P", "hemoglobinemere >= 12.5", "Bonne hémoglobine"),
    ("R", "diarrhee = 1", "Diarrhée récente"),
    ("R", "intervalleintergenesique > 0 AND intervalleintergenesique < 24", "Espacement naissance court"),
    ("P", "intervalleintergenesique >= 36", "Bon espacement"),
    ("R", "rangdenaissance >= 5", "Rang de naissance élevé"),
    ("P", "nombrevisitesprenatales >= 4", "Suivi prénatal correct"),
    ("R", "nombrevisitesprenatales < 2", "Suivi prénatal insuffisant"),
    ("P", "sourceeaupotable IN (11, 12, 13, 21)", "Eau potable améliorée"),
    ("R", "sourceeaupotable IN (43, 61, 41)", "Eau non améliorée"),
    ("P", "typeinstallationssanitaires IN (11, 12, 21)", "Assainissement amélioré"),
    ("R", "typeinstallationssanitaires IN (22, 31)", "Assainissement précaire"),
    ("R", "typecombustiblecuisine IN (7, 8)", "Combustible polluant"),
    ("P", "typecombustiblecuisine IN (1, 2)", "Combustible propre"),
    ("R", "region IN (5, 7, 1, 4)", "Région à forte prévalence"),
    ("P", "dureeallaitement >= 18", "Allaitement prolongé"),
    ("R", "dureeallaitement < 6 AND ageenfant > 6", "Allaitement insuffisant"),
]


def _labels_sql(kind):
    return "concat_ws('|', " + ", ".join(f"CASE WHEN {c} THEN '{lab}' END" for k, c, lab in _RULES_SQL
                                          if k == kind) + ")"


@query("drv17_influence_factors", f"""
SELECT {_labels_sql('R')} AS risk_labels, {_labels_sql('P')} AS protective_labels, COUNT(*) AS n
FROM {SV} s GROUP BY 1, 2""")
def drv17(spark, sf):
    d = D.influence_factors(survey_records(spark, sf))
    lab = lambda c: F.array_join(F.transform(c, lambda x: x["label"]), "|")
    return d.groupBy(lab(F.col("risk_factors")).alias("risk_labels"),
                     lab(F.col("protective_factors")).alias("protective_labels")).agg(F.count(F.lit(1)).alias("n"))


_CONTRIB_SQL = {
    "Age enfant": "LEAST(ageenfant / 59.0 * 100.0, 100.0)",
    "IMC mere": "CASE WHEN imcmere < 22 THEN GREATEST(0.0, (22.0 - imcmere) / 22.0 * 100.0) ELSE 0.0 END",
    "Hemoglobine": "GREATEST(0.0, (12.5 - hemoglobinemere) / 12.5 * 100.0)",
    "Intervalle intergenesique": "CASE WHEN intervalleintergenesique > 0 THEN GREATEST(0.0, (24.0 - intervalleintergenesique) / 24.0 * 100.0) ELSE 50.0 END",
    "Niveau d'instruction": "GREATEST(0.0, (3.0 - niveauinstructionmere) / 3.0 * 100.0)",
    "Richesse menage": "GREATEST(0.0, (3.0 - indicederichesse) / 3.0 * 100.0)",
    "Milieu residence": "CASE WHEN milieuderesidence = 2 THEN 60.0 ELSE 15.0 END",
    "Source d'eau": "CASE WHEN sourceeaupotable IN (43, 61, 41) THEN 70.0 ELSE 15.0 END",
}
_CNAMES = list(_CONTRIB_SQL)
_CALIAS = {n: "c_" + n.lower().replace(" ", "_").replace("'", "") for n in _CNAMES}


@query("drv18_contributions", f"""
SELECT region, {', '.join(f'ROUND(SUM({e}), 4) AS {_CALIAS[n]}' for n, e in _CONTRIB_SQL.items())}
FROM {SV} s GROUP BY region""")
def drv18(spark, sf):
    d, names = D.contributions(survey_records(spark, sf))
    return d.groupBy("region").agg(*[_r(F.sum(F.col("contributions")[n]), 4).alias(_CALIAS[n]) for n in names])


def _q(n):
    return n.replace("'", "''")


@query("top03_top_contributions", f"""
SELECT array_to_string(list_transform(list_slice(list_sort([{', '.join(
    "{{'v': -(" + e + "), 'o': " + str(i) + ", 'n': '" + _q(n) + "'}}" for i, (n, e) in enumerate(_CONTRIB_SQL.items()))}]),
  1, 7), lambda x: x.n), ',') AS top_contributions, COUNT(*) AS n FROM {SV} s GROUP BY 1""".replace("{{", "{").replace("}}", "}"))
def top03(spark, sf):
    d, names = D.contributions(survey_records(spark, sf))
    top = A.top_in_row(names, [F.col("contributions")[n] for n in names], 7)
    return d.groupBy(F.array_join(F.transform(top, lambda x: x["name"]), ",").alias("top_contributions")).agg(
        F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- scoring (SCR)

SCORER = SC.LinearScorer(
    coefficients={"ageenfant": -0.01, "imcmere": -0.05, "hemoglobinemere": -0.1, "indicederichesse": -0.2,
                  "milieuderesidence": 0.3, "eau_amelioree": -0.4, "pauvrete_rurale": 0.5,
                  "ratio_charge_menage": 0.2},
    intercept=1.5)
FEATURES = ["ageenfant", "imcmere", "hemoglobinemere", "indicederichesse", "milieuderesidence",
            "eau_amelioree", "pauvrete_rurale", "ratio_charge_menage"]

_DERIVED_SQL = f"""(SELECT *, CAST(sourceeaupotable IN (11, 12, 13, 21) AS INTEGER) AS eau_amelioree,
  CAST(milieuderesidence = 2 AND indicederichesse IN (1, 2) AS INTEGER) AS pauvrete_rurale,
  COALESCE(CAST(nombreenfantsnesvivants AS DOUBLE) / NULLIF(CAST(nombremembresmenage AS DOUBLE), 0.0), 3.0)
    AS ratio_charge_menage FROM {SV} s)"""
_Z = "1.5 + " + " + ".join(f"({b}) * CAST({k} AS DOUBLE)" for k, b in SCORER.coefficients.items())
_RATES_SQL = f"""(SELECT AVG(CAST(y1 AS DOUBLE)) AS r1, AVG(CAST(y2 AS DOUBLE)) AS r2, AVG(CAST(y3 AS DOUBLE)) AS r3
  FROM {SV} s WHERE y = 1)"""
_SCORED_SQL = f"""(SELECT d.*, 1.0 / (1.0 + exp(-({_Z}))) AS pp FROM {_DERIVED_SQL} d)"""
_BATCH_SQL = f"""(SELECT household, cluster, region, ageenfant, ROUND(pp, 4) AS {SC.PROB},
  CAST(pp >= 0.5 AS INTEGER) AS {SC.CLASS}, ROUND(pp * r1, 4) AS prob_retard_croissance_stunting,
  ROUND(pp * r2, 4) AS prob_amaigrissement_wasting, ROUND(pp * r3, 4) AS prob_insuffisance_ponderale_underweight
  FROM {_SCORED_SQL} x, {_RATES_SQL} r)"""


def scored_batch(spark, sf):
    sv = survey_records(spark, sf)
    rates = SC.rates_frame(sv, "y", ["y1", "y2", "y3"])
    return SC.score_batch(sv, SCORER, rates, FEATURES, keep=["household", "cluster", "region"])


@query("scr01_derive_features", f"""
SELECT region, CAST(SUM(eau_amelioree) AS BIGINT) AS eau, CAST(SUM(pauvrete_rurale) AS BIGINT) AS rural_poor,
  ROUND(SUM(ratio_charge_menage), 4) AS ratio_sum, ROUND(SUM(CAST(ageenfant * ageenfant AS DOUBLE)), 1) AS age_sq
FROM {_DERIVED_SQL} d GROUP BY region""")
def scr01(spark, sf):
    d = D.derive_features(survey_records(spark, sf))
    return d.groupBy("region").agg(F.sum("eau_amelioree").cast("long").alias("eau"),
                                   F.sum("pauvrete_rurale").cast("long").alias("rural_poor"),
                                   _r(F.sum("ratio_charge_menage"), 4).alias("ratio_sum"),
                                   _r(F.sum(F.col("ageenfant_carre").cast("double")), 1).alias("age_sq"))


@query("scr02_score_batch", f"""
SELECT region, COUNT(*) AS n, ROUND(SUM({SC.PROB}), 4) AS prob_sum, CAST(SUM({SC.CLASS}) AS BIGINT) AS alerts,
  ROUND(SUM(prob_retard_croissance_stunting), 4) AS stunting_sum, ROUND(SUM(prob_amaigrissement_wasting), 4) AS wasting_sum,
  ROUND(SUM(prob_insuffisance_ponderale_underweight), 4) AS underweight_sum FROM {_BATCH_SQL} b GROUP BY region""")
def scr02(spark, sf):
    b = scored_batch(spark, sf)
    return b.groupBy("region").agg(F.count(F.lit(1)).alias("n"), _r(F.sum(SC.PROB), 4).alias("prob_sum"),
                                   F.sum(SC.CLASS).cast("long").alias("alerts"),
                                   _r(F.sum("prob_retard_croissance_stunting"), 4).alias("stunting_sum"),
                                   _r(F.sum("prob_amaigrissement_wasting"), 4).alias("wasting_sum"),
                                   _r(F.sum("prob_insuffisance_ponderale_underweight"), 4).alias("underweight_sum"))


@query("snk06_decision_table", f"""
SELECT household, cluster, ageenfant, {SC.PROB}, prob_retard_croissance_stunting, prob_amaigrissement_wasting,
  prob_insuffisance_ponderale_underweight FROM {_BATCH_SQL} b""")
def snk06(spark, sf):
    """SNK-6: per-record decision table (ids + 4 probabilities)."""
    b = scored_batch(spark, sf)
    return b.select("household", "cluster", "ageenfant", SC.PROB, *SC.SUBS)


@query("scr03_batch_summary", f"""
WITH b AS (SELECT * FROM {_BATCH_SQL} x)
SELECT 'kpi' AS part, 'all' AS key, COUNT(*) AS n, CAST(SUM({SC.CLASS}) AS BIGINT) AS alerts,
  ROUND(AVG({SC.PROB}), 6) AS mean_value FROM b
UNION ALL SELECT 'region', CAST(region AS VARCHAR), COUNT(*), CAST(SUM({SC.CLASS}) AS BIGINT), ROUND(AVG({SC.PROB}), 6)
  FROM b GROUP BY region
UNION ALL SELECT 'subclass', 'stunting', COUNT(*), CAST(COUNT(*) FILTER (WHERE prob_retard_croissance_stunting >= 0.30) AS BIGINT),
  ROUND(AVG(prob_retard_croissance_stunting), 6) FROM b
UNION ALL SELECT 'subclass', 'wasting', COUNT(*), CAST(COUNT(*) FILTER (WHERE prob_amaigrissement_wasting >= 0.15) AS BIGINT),
  ROUND(AVG(prob_amaigrissement_wasting), 6) FROM b
UNION ALL SELECT 'subclass', 'underweight', COUNT(*), CAST(COUNT(*) FILTER (WHERE prob_insuffisance_ponderale_underweight >= 0.20) AS BIGINT),
  ROUND(AVG(prob_insuffisance_ponderale_underweight), 6) FROM b
UNION ALL SELECT 'histogram', CAST(CAST(bin AS INTEGER) AS VARCHAR), COUNT(*), NULL, ROUND(ANY_VALUE(lo), 6) FROM (
  SELECT LEAST(floor((v - mn) / w), 29) AS bin, mn + LEAST(floor((v - mn) / w), 29) * w AS lo
  FROM (SELECT {SC.PROB} AS v, MIN({SC.PROB}) OVER () AS mn, (MAX({SC.PROB}) OVER () - MIN({SC.PROB}) OVER ()) / 30.0 AS w FROM b) x) h GROUP BY bin""")
def scr03(spark, sf):
    b = scored_batch(spark, sf)
    s = SC.batch_summary(b)
    k = s["kpis"].select(F.lit("kpi").alias("part"), F.lit("all").alias("key"), F.col("total").alias("n"), "alerts",
                         _r(F.col("mean_score")).alias("mean_value"))
    r = s["by_region"].select(F.lit("region").alias("part"), F.col("region").cast("string").alias("key"),
                              F.col("total").alias("n"), "alerts", _r(F.col("mean_score")).alias("mean_value"))
    tot = s["kpis"].select(F.col("total").alias("n"))   # sub-class rows carry the batch size
    from surveyspark.operators.joins import with_scalars
    sub = with_scalars(s["subclasses"], tot).select(F.lit("subclass").alias("part"), F.col("subclass").alias("key"), "n",
                                        F.col("n_above").alias("alerts"), _r(F.col("mean_prob")).alias("mean_value"))
    hist = s["histogram"].select(F.lit("histogram").alias("part"), F.col("bin").cast("string").alias("key"), "n",
                                 F.lit(None).cast("long").alias("alerts"), _r(F.col("lo")).alias("mean_value"))
    return k.unionByName(r).unionByName(sub).unionByName(hist)


@query("scr04_explain", f"""
WITH b AS (SELECT d.*, 1.0 / (1.0 + exp(-({_Z}))) AS pp FROM {_DERIVED_SQL} d),
e AS (SELECT {_labels_sql('R')} AS rl, {_labels_sql('P')} AS pl,
  concat_ws('|', CASE WHEN pp >= 0.5 AND pp * r1 >= 0.30 THEN 'stunting' END,
                 CASE WHEN pp >= 0.5 AND pp * r2 >= 0.15 THEN 'wasting' END,
                 CASE WHEN pp >= 0.5 AND pp * r3 >= 0.20 THEN 'underweight' END) AS actions FROM b, {_RATES_SQL} r)
SELECT CAST(CASE WHEN rl = '' THEN 0 ELSE length(rl) - length(replace(rl, '|', '')) + 1 END AS INTEGER) AS n_risk,
  CAST(CASE WHEN pl = '' THEN 0 ELSE length(pl) - length(replace(pl, '|', '')) + 1 END AS INTEGER) AS n_protective,
  actions, COUNT(*) AS n FROM e GROUP BY 1, 2, 3""")
def scr04(spark, sf):
    sv = survey_records(spark, sf)
    rates = SC.rates_frame(sv, "y", ["y1", "y2", "y3"])
    b = SC.score_batch(sv, SCORER, rates, FEATURES, keep=[c for c in SURVEY_FIELDS if c not in FEATURES],
                       digits=None)
    e = SC.explain(b)
    return e.groupBy(F.size("risk_factors").cast("int").alias("n_risk"),
                     F.size("protective_factors").cast("int").alias("n_protective"),
                     F.array_join("actions", "|").alias("actions")).agg(F.count(F.lit(1)).alias("n"))


@query("drv19_recommend", f"""
WITH b AS (SELECT d.*, 1.0 / (1.0 + exp(-({_Z}))) AS pp FROM {_DERIVED_SQL} d)
SELECT concat_ws('|', CASE WHEN pp >= 0.5 AND pp * r1 >= 0.30 THEN 'stunting' END,
  CASE WHEN pp >= 0.5 AND pp * r2 >= 0.15 THEN 'wasting' END,
  CASE WHEN pp >= 0.5 AND pp * r3 >= 0.20 THEN 'underweight' END) AS actions, COUNT(*) AS n
FROM b, {_RATES_SQL} r GROUP BY 1""")
def drv19(spark, sf):
    sv = survey_records(spark, sf)
    rates = SC.rates_frame(sv, "y", ["y1", "y2", "y3"])
    b = SC.score_batch(sv, SCORER, rates, FEATURES, digits=None)
    r = D.recommend(b, SC.PROB, {"stunting": "prob_retard_croissance_stunting",
                                 "wasting": "prob_amaigrissement_wasting",
                                 "underweight": "prob_insuffisance_ponderale_underweight"})
    return r.groupBy(F.array_join("actions", "|").alias("actions")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- verdicts, captions, terms

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_LONG = long_sql("lineitem", MEASURES)


@query("drv20_normality_verdict", f"""
WITH {moments_cte(_LONG)}
SELECT variable, CASE WHEN {dagostino_sql()} < 0.05 THEN 'Non normale' ELSE 'Normale' END AS verdict FROM gg""")
def drv20(spark, sf):
    d = P.dagostino(read(spark, sf, "lineitem"), MEASURES)
    return d.select("variable", D.normality_verdict("p_value").alias("verdict"))


@query("drv21_centre_caption", f"""
WITH s AS (SELECT variable, AVG(value) AS mean, quantile_cont(value, 0.5) AS med FROM {_LONG} l GROUP BY 1)
SELECT variable, CASE WHEN abs(mean - med) < 1.0 THEN printf('%s (Moyenne ~ Mediane ~ %.1f)', variable, med)
  ELSE printf('%s (Mediane: %.1f | Moyenne: %.1f)', variable, med, mean) END AS caption FROM s""")
def drv21(spark, sf):
    d = P.describe(read(spark, sf, "lineitem"), MEASURES, probs=(0.5,))
    return d.select("variable", D.centre_caption(F.col("variable"), F.col("mean"), F.col("q50")).alias("caption"))


_TERMS = list(FV.TERM_LABELS.items())


@query("drv22_pretty_terms", f"""
WITH t AS (SELECT 'Intercept' AS term UNION ALL SELECT 'ageenfant' UNION ALL SELECT 'C(sexeenfant)[T.2]'
  UNION ALL SELECT 'C(indicederichesse)[T.2]' UNION ALL SELECT 'C(indicederichesse)[T.3]'
  UNION ALL SELECT 'C(indicederichesse)[T.4]' UNION ALL SELECT 'C(indicederichesse)[T.5]')
SELECT t.term, COALESCE(k.label, t.term) AS label FROM t LEFT JOIN {values_sql(_TERMS, ['term', 'label'], 'k')}
  ON t.term = k.term""")
def drv22(spark, sf):
    _, terms = FE.design_matrix(survey_records(spark, sf), ["ageenfant"], ["sexeenfant", "indicederichesse"])
    tt = spark.createDataFrame([(t,) for t in terms], "term STRING")
    lk = spark.createDataFrame(_TERMS, "term STRING, label STRING")
    return D.pretty_terms(tt, lk)
