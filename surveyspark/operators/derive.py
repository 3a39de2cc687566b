"""Derived columns (DRV-*): indicators, composites, scores, bands and the
explanation rules, all as column expressions (no per-row Python)."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyspark.functions import exprs as X
from surveyspark.functions import fixed_values as FV
from surveyspark.operators import stats_core as S
from surveyspark.operators.joins import null_safe_join, with_scalars


def flag_below(df: DataFrame, spec: Mapping[str, tuple]) -> DataFrame:
    """DRV-1: ``{out: (col, cutoff)}`` -> (col < cutoff) indicators."""
    return df.withColumns({o: X.flag_below(c, t) for o, (c, t) in spec.items()})


def any_of(df: DataFrame, cols: Sequence[str], out: str) -> DataFrame:
    """DRV-2: composite OR index."""
    return df.withColumn(out, X.any_of(cols))


def scale_weight(df: DataFrame, col: str, divisor: float = 1e6, out: str = "weight") -> DataFrame:
    """DRV-3: analytic weight."""
    return df.withColumn(out, F.col(col) / F.lit(float(divisor)))


def latent_score(df: DataFrame, weights: Mapping[str, float], out: str = "latent") -> DataFrame:
    """DRV-9: weighted linear combination of indicators."""
    return df.withColumn(out, X.weighted_sum(weights))


def split_at_median(df: DataFrame, col: str, out: str, strict: bool = False,
                    keys: Sequence[str] = ()) -> DataFrame:
    """DRV-10: dichotomise at the column's own exact median (``>=``; ``>`` if strict)."""
    med = S.medians(df, [col], keys).select(*keys, F.col(col).alias("__median"))
    j = null_safe_join(df, med, keys, "left") if keys else with_scalars(df, med)   # keyed: planner / AQE
    cond = (F.col(col) > F.col("__median")) if strict else (F.col(col) >= F.col("__median"))
    return j.withColumn(out, cond.cast("int")).drop("__median")


def marginalise(df: DataFrame, p: str, rates: DataFrame, pairs: Mapping[str, str], digits: int | None = 4) -> DataFrame:
    """DRV-13 / DRV-14: sub-class probability ``p * P(sub | composite)`` from a one-row rates frame."""
    j = with_scalars(df, rates)
    cols = {}
    for out, rate in pairs.items():
        e = F.col(p) * F.col(rate)
        cols[out] = F.round(e, digits) if digits is not None else e
    return j.withColumns(cols).drop(*rates.columns)


def gap_verdict(gap, rule: str = "four_band") -> Column:
    """DRV-15: train-test AUC gap band.

    FIXED VALUES: two rule sets. ``four_band``: > .10 severe, (.05, .10]
    moderate, [0, .05] stable, negative -> underfitting. ``three_band``:
    <= .05 stable, (.05, .10] controlled, else residual overfitting.
    """
    g = X.c(gap)
    if rule == "three_band":
        return (F.when(g <= 0.05, "Modele Stable").when(g <= 0.10, "Overfitting Controle")
                .otherwise("Overfitting Residuel"))
    return (F.when(g > 0.10, "Overfitting Severe (A regulariser)")
            .when(g > 0.05, "Overfitting Modere")
            .when(g >= 0.0, "Modele Stable (Excellente Generalisation)")
            .otherwise("Underfitting ou Instabilite matricielle"))


def significance(p) -> Column:
    """DRV-15: p-value band (< .01, < .05, else NS)."""
    x = X.c(p)
    return F.when(x < 0.01, "*** (p<0.01)").when(x < 0.05, "** (p<0.05)").otherwise("NS")


def bmi_tag(bmi) -> Column:
    """DRV-15: body-mass tag (18.5 / 25 / 30, lower bound inclusive)."""
    return X.band(bmi, [18.5, 25.0, 30.0], ["Maigreur", "Normal", "Surpoids", "Obesite"])


def risk_colour(p) -> Column:
    """DRV-15: risk colour of a probability (30 % / 50 %)."""
    lo, hi = FV.RISK_COLOUR_CUTS
    return X.band(p, [lo, hi], ["green", "amber", "red"])  # lower bound inclusive


def contribution_colour(v) -> Column:
    """DRV-15: contribution colour (> 40 red, > 20 amber)."""
    lo, hi = FV.CONTRIBUTION_COLOUR_CUTS
    return X.band(v, [lo, hi], ["green", "amber", "red"], right_closed=True)


def r2_band(r2) -> Column:
    """DRV-15: McFadden pseudo-R2 band ([0.2, 0.4] excellent)."""
    x = X.c(r2)
    return F.when((x >= 0.20) & (x <= 0.40), "Excellente adequation (0.2-0.4)").otherwise("Adequation acceptable")


def link_status(p, term: str = "hat_z_sq") -> Column:
    """DRV-15: link-test status: hat_z expected significant, its square not."""
    x = X.c(p)
    if term == "hat_z":
        return F.when(x < 0.05, "Significatif (Attendu < 0.05)").otherwise("Alerte non significatif")
    return F.when(x > 0.05, "Valide (Attendu > 0.05)").otherwise("Alerte mauvaise specification")


def normality_verdict(p_sw, p_dag=None) -> Column:
    """DRV-20: both p > 0.05 -> normal (two-test form) or p < 0.05 -> not normal (one-test form)."""
    if p_dag is None:
        return F.when(X.c(p_sw) < 0.05, "Non normale").otherwise("Normale")
    return F.when((X.c(p_sw) > 0.05) & (X.c(p_dag) > 0.05), "Normale (Symetrique)") \
        .otherwise("Non Normale (Asymetrique)")


def centre_caption(var, mean, median, tol: float = 1.0) -> Column:
    """DRV-21: caption; mean and median called equal when closer than ``tol``."""
    m, md = X.c(mean), X.c(median)
    return F.when(F.abs(m - md) < tol,
                  F.format_string("%s (Moyenne ~ Mediane ~ %.1f)", X.c(var), md)) \
        .otherwise(F.format_string("%s (Mediane: %.1f | Moyenne: %.1f)", X.c(var), md, m))


def pretty_terms(df: DataFrame, lookup: DataFrame, col: str = "term", out: str = "label") -> DataFrame:
    """DRV-22: model-term label by exact lookup (avoids substring-order traps)."""
    lk = X.bounded_broadcast(lookup.select(F.col("term").alias("__t"), F.col("label").alias("__l")), 1_000_000)
    return df.join(lk, F.col(col) == F.col("__t"), "left") \
        .withColumn(out, F.coalesce("__l", F.col(col))).drop("__t", "__l")


# --- SCR-1 feature engineering, shared by training and serving ---------------

def derive_features(df: DataFrame, ratio_fill=3.0, roles: Mapping[str, str] | None = None) -> DataFrame:
    """SCR-1: the six derived scoring features (DRV-4..8).

    ``roles`` maps the role names (age, water, toilet, residence, wealth,
    children, household_size) to columns, so the same transformer runs on the
    survey schema and on other tables. ``ratio_fill`` may be a number or a Column
    (e.g. a fitted median saved with the model, rule Q6).
    """
    r = {"age": "ageenfant", "water": "sourceeaupotable", "toilet": "typeinstallationssanitaires",
         "residence": "milieuderesidence", "wealth": "indicederichesse",
         "children": "nombreenfantsnesvivants", "household_size": "nombremembresmenage"}
    r.update(roles or {})
    water = X.flag_in(r["water"], FV.IMPROVED_WATER)
    toilet = X.flag_in(r["toilet"], FV.IMPROVED_TOILET)
    return df.withColumns({
        "ageenfant_carre": X.square(r["age"]),
        "eau_amelioree": water,
        "toilettes_ameliorees": toilet,
        "index_wash_synergie": (water * toilet).cast("int"),
        "pauvrete_rurale": X.all_of([F.col(r["residence"]) == FV.RURAL,
                                     F.col(r["wealth"]).isin(FV.POOREST_QUINTILES)]),
        "ratio_charge_menage": X.safe_ratio(r["children"], r["household_size"], ratio_fill),
    })


# --- DRV-17 rule engine --------------------------------------------------------

def _fmt1(x) -> Column:
    return F.format_number(X.c(x).cast("double"), 1)


def factor_rules(roles: Mapping[str, str] | None = None):
    """Rule table: (kind, condition, label, detail) with columns bound by role.

    FIXED VALUES: thresholds and labels of the explanation rules.
    """
    r = {"age": "ageenfant", "edu": "niveauinstructionmere", "wealth": "indicederichesse",
         "residence": "milieuderesidence", "bmi": "imcmere", "interval": "intervalleintergenesique",
         "hgb": "hemoglobinemere", "diarrhoea": "diarrhee", "rank": "rangdenaissance",
         "visits": "nombrevisitesprenatales", "water": "sourceeaupotable",
         "toilet": "typeinstallationssanitaires", "fuel": "typecombustiblecuisine", "region": "region",
         "breastfeeding": "dureeallaitement"}
    r.update(roles or {})
    col = {k: F.col(v) for k, v in r.items()}
    age = col["age"]
    R, P = "risk", "protective"
    return [
        (R, (age >= 6) & (age <= 23), "Âge critique",
         F.concat(F.lit("Enfant de "), X.age_text(age), F.lit(" - fenetre de diversification la plus vulnerable."))),
        (P, age > 36, "Âge favorable",
         F.concat(F.lit("Enfant de "), X.age_text(age), F.lit(" - periode post-sevrage moins exposee."))),
        (P, col["edu"] >= 2, "Éducation maternelle", F.lit("Niveau secondaire ou plus.")),
        (R, col["edu"] == 0, "Absence de scolarisation", F.lit("Aucune instruction maternelle.")),
        (R, col["bmi"] < 18.5, "Maigreur maternelle", F.concat(F.lit("IMC = "), _fmt1(col["bmi"]))),
        (P, (col["bmi"] >= 18.5) & (col["bmi"] <= 25), "IMC maternel optimal",
         F.concat(F.lit("IMC = "), _fmt1(col["bmi"]))),
        (R, col["wealth"] <= 2, "Pauvreté ménage", F.lit("Quintile pauvre.")),
        (P, col["wealth"] >= 4, "Aisance financière", F.lit("Quintile riche.")),
        (R, col["residence"] == 2, "Milieu rural", F.lit("Acces reduit aux services de sante.")),
        (P, col["residence"] != 2, "Milieu urbain", F.lit("Meilleur acces aux soins.")),
        (R, col["hgb"] < 11.0, "Anémie maternelle",
         F.concat(F.lit("Hemoglobine = "), _fmt1(col["hgb"]), F.lit(" g/dl"))),
        (P, col["hgb"] >= 12.5, "Bonne hémoglobine",
         F.concat(F.lit("Hemoglobine = "), _fmt1(col["hgb"]), F.lit(" g/dl"))),
        (R, col["diarrhoea"] == 1, "Diarrhée récente", F.lit("Episode recent.")),
        (R, (col["interval"] > 0) & (col["interval"] < 24), "Espacement naissance court",
         F.concat(F.lit("Intervalle de "), col["interval"].cast("string"), F.lit(" mois"))),
        (P, col["interval"] >= 36, "Bon espacement",
         F.concat(F.lit("Intervalle de "), col["interval"].cast("string"), F.lit(" mois"))),
        (R, col["rank"] >= 5, "Rang de naissance élevé", F.concat(F.lit("Rang "), col["rank"].cast("string"))),
        (P, col["visits"] >= 4, "Suivi prénatal correct",
         F.concat(col["visits"].cast("string"), F.lit(" consultations prenatales"))),
        (R, col["visits"] < 2, "Suivi prénatal insuffisant",
         F.concat(col["visits"].cast("string"), F.lit(" visite(s) prenatale(s)"))),
        (P, col["water"].isin(FV.IMPROVED_WATER), "Eau potable améliorée", F.lit("Source d'eau securisee.")),
        (R, col["water"].isin(FV.UNIMPROVED_WATER), "Eau non améliorée", F.lit("Eau de surface ou puits non protege.")),
        (P, col["toilet"].isin(FV.IMPROVED_TOILET), "Assainissement amélioré", F.lit("Toilettes conformes.")),
        (R, col["toilet"].isin(FV.UNIMPROVED_TOILET), "Assainissement précaire", F.lit("Latrines non couvertes.")),
        (R, col["fuel"].isin(FV.POLLUTING_FUEL), "Combustible polluant", F.lit("Bois/charbon.")),
        (P, col["fuel"].isin(FV.CLEAN_FUEL), "Combustible propre", F.lit("Electricite/gaz.")),
        (R, col["region"].isin(FV.HIGH_PREVALENCE_REGIONS), "Région à forte prévalence",
         F.lit("Zone parmi les plus touchees.")),
        (P, col["breastfeeding"] >= 18, "Allaitement prolongé",
         F.concat(col["breastfeeding"].cast("string"), F.lit(" mois d'allaitement"))),
        (R, (col["breastfeeding"] < 6) & (age > 6), "Allaitement insuffisant",
         F.concat(F.lit("Seulement "), col["breastfeeding"].cast("string"), F.lit(" mois"))),
    ]


def influence_factors(df: DataFrame, roles: Mapping[str, str] | None = None,
                      risk: str = "risk_factors", protective: str = "protective_factors") -> DataFrame:
    """DRV-17: arrays of risk / protective factor structs (label, detail, icon) per row.

    Rules of one group are mutually exclusive (else-if), which the conditions
    above already encode; within a group only the first true branch counts.
    """
    rules = factor_rules(roles)

    def arr(kind, icon):
        items = [F.when(F.coalesce(cond, F.lit(False)),
                        F.struct(F.lit(lab).alias("label"), det.alias("detail"), F.lit(icon).alias("icon")))
                 for k, cond, lab, det in rules if k == kind]
        return F.filter(F.array(*items), lambda x: x.isNotNull())

    return df.withColumns({risk: arr("risk", "red"), protective: arr("protective", "green")})


def contributions(df: DataFrame, roles: Mapping[str, str] | None = None, out: str = "contributions") -> DataFrame:
    """DRV-18: heuristic contribution scores in [0, 100] as a map name -> score."""
    r = {"age": "ageenfant", "bmi": "imcmere", "hgb": "hemoglobinemere", "interval": "intervalleintergenesique",
         "edu": "niveauinstructionmere", "wealth": "indicederichesse", "residence": "milieuderesidence",
         "water": "sourceeaupotable"}
    r.update(roles or {})
    col = {k: F.col(v).cast("double") for k, v in r.items()}
    z = F.lit(0.0)
    items = {
        "Age enfant": F.least(col["age"] / 59.0 * 100.0, F.lit(100.0)),
        "IMC mere": F.when(col["bmi"] < 22, F.greatest(z, (22.0 - col["bmi"]) / 22.0 * 100.0)).otherwise(z),
        "Hemoglobine": F.greatest(z, (12.5 - col["hgb"]) / 12.5 * 100.0),
        "Intervalle intergenesique": F.when(col["interval"] > 0,
                                            F.greatest(z, (24.0 - col["interval"]) / 24.0 * 100.0))
        .otherwise(F.lit(50.0)),
        "Niveau d'instruction": F.greatest(z, (3.0 - col["edu"]) / 3.0 * 100.0),
        "Richesse menage": F.greatest(z, (3.0 - col["wealth"]) / 3.0 * 100.0),
        "Milieu residence": F.when(col["residence"] == 2, F.lit(60.0)).otherwise(F.lit(15.0)),
        "Source d'eau": F.when(col["water"].isin(FV.UNIMPROVED_WATER), F.lit(70.0)).otherwise(F.lit(15.0)),
    }
    return df.withColumn(out, F.struct(*[v.alias(k) for k, v in items.items()])), list(items)


def recommend(df: DataFrame, p: str, p_sub: Mapping[str, str], cut: float = FV.CLASS_CUTOFF,
              out: str = "actions") -> DataFrame:
    """DRV-19: recommended actions when the score and sub-scores cross their cut-offs."""
    acts = []
    for name, colname in p_sub.items():
        t = FV.ALERT_CUTOFFS[name]
        acts.append(F.when((F.col(p) >= cut) & (F.col(colname) >= t), F.lit(name)))
    return df.withColumn(out, F.filter(F.array(*acts), lambda x: x.isNotNull()))
