"""Profiling, aggregation, window and top-k operators bound to the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from surveyspark.functions import fixed_values as FV
from surveyspark.functions.lookups import label_lookup
from surveyspark.operators import aggregate as A
from surveyspark.operators import clean as C
from surveyspark.operators import derive as D
from surveyspark.operators import profile as P
from surveyspark.plans.registry import query
from surveyspark.plans.sqlgen import bias_sql, dagostino_k2_sql, dagostino_sql, long_sql, moments_cte, values_sql
from surveyspark.plans.tables import (OBS_SQL, RAW_SURVEY, RAW_SURVEY_SQL, SURVEY_SQL, observations, raw_survey, read, supplier_region,
                                     survey_records)
from surveyspark.sources import sinks

O, SV = OBS_SQL, SURVEY_SQL
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LONG = long_sql("lineitem", MEASURES)


def _r(c, d=6):
    return F.round(c, d)


# ---------------------------------------------------------------- profiles (AGG-2/3, STA-1/3)

@query("agg02_profile_continuous", f"""
SELECT variable AS Variable, COUNT(*) AS Effectif, ROUND(AVG(value), 4) AS Moyenne,
  ROUND(STDDEV_SAMP(value), 4) AS EcartType, MIN(value) AS Min, ROUND(quantile_cont(value, 0.25), 4) AS Q1,
  ROUND(quantile_cont(value, 0.5), 4) AS Mediane, ROUND(quantile_cont(value, 0.75), 4) AS Q3, MAX(value) AS Max
FROM {LONG} l GROUP BY variable""")
def agg02(spark, sf):
    p = P.profile_continuous(read(spark, sf, "lineitem"), MEASURES)
    return p.select("Variable", "Effectif", *[_r(F.col(c), 4).alias(c) if c not in ("Min", "Max") else c
                                             for c in ["Moyenne", "EcartType", "Min", "Q1", "Mediane", "Q3", "Max"]])


_G1, _G2 = bias_sql()
_DAG = dagostino_sql()
_K2 = dagostino_k2_sql()


@query("agg03_profile_discrete", f"""
WITH {moments_cte(LONG)},
cnt AS (SELECT variable, value, COUNT(*) AS c FROM lg GROUP BY 1, 2),
md AS (SELECT variable, first(value ORDER BY c DESC, value ASC) AS mode FROM cnt GROUP BY 1),
qq AS (SELECT variable, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50,
         quantile_cont(value, 0.75) AS q75 FROM lg GROUP BY 1)
SELECT gg.variable AS Variable, n AS Effectif_Valide, ROUND(mean, 3) AS Moyenne, ROUND(q50, 3) AS Mediane,
  ROUND(mode, 3) AS Mode, ROUND(sd, 3) AS Ecart_Type, ROUND(var_s, 3) AS Variance, mn AS Min, mx AS Max,
  ROUND(q25, 3) AS Q25, ROUND(q75, 3) AS Q75, ROUND(q75 - q25, 3) AS IQR,
  ROUND({_G1}, 3) AS Skewness, ROUND({_G2}, 3) AS Kurtosis,
  'D''Agostino-Pearson' AS Nom_Test_Normalite,
  ROUND({_K2}, 4) AS Stat_Test_Normalite, ROUND({_DAG}, 6) AS p_value_Normalite,
  CASE WHEN {_DAG} < 0.05 THEN 'Non normale' ELSE 'Normale' END AS Distribution
FROM gg JOIN md USING (variable) JOIN qq USING (variable)""")
def agg03(spark, sf):
    p = P.profile_discrete(read(spark, sf, "lineitem"), MEASURES)
    return p.withColumn("p_value_Normalite", _r(F.col("p_value_Normalite")))


@query("sta01_dagostino", f"""
WITH {moments_cte(LONG)}
SELECT variable, n AS n_obs, ROUND({_K2}, 4) AS k2, ROUND({_DAG}, 8) AS p_value FROM gg""")
def sta01(spark, sf):
    d = P.dagostino(read(spark, sf, "lineitem"), MEASURES)
    return d.select("variable", "n_obs", _r(F.col("k2"), 4).alias("k2"), _r(F.col("p_value"), 8).alias("p_value"))


@query("sta03_shape_moments", f"""
SELECT variable, ROUND(skewness(value), 6) AS skewness, ROUND(kurtosis(value), 6) AS kurtosis
FROM {LONG} l GROUP BY variable""")
def sta03(spark, sf):
    d = P.shape_moments(read(spark, sf, "lineitem"), MEASURES)
    return d.select("variable", _r(F.col("skewness")).alias("skewness"), _r(F.col("kurtosis")).alias("kurtosis"))


_REPORT_SQL = f"""
WITH {moments_cte(LONG)},
cnt AS (SELECT variable, value, COUNT(*) AS c FROM lg GROUP BY 1, 2),
md AS (SELECT variable, first(value ORDER BY c DESC, value ASC) AS mode FROM cnt GROUP BY 1),
qq AS (SELECT variable, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50,
         quantile_cont(value, 0.75) AS q75 FROM lg GROUP BY 1),
pr AS (SELECT gg.variable, ROUND(mean, 2) AS mean2, ROUND(q50, 2) AS med2, ROUND(mode, 3) AS mode3,
         ROUND(sd, 2) AS sd2, ROUND(var_s, 2) AS var2, ROUND(q75 - q25, 2) AS iqr2, mn, mx,
         ROUND({_G1}, 2) AS sk2, ROUND({_G2}, 2) AS ku2, ROUND({_K2}, 2) AS st2,
         CASE WHEN {_DAG} < 0.05 THEN 'Non normale' ELSE 'Normale' END AS dist
       FROM gg JOIN md USING (variable) JOIN qq USING (variable))
SELECT variable AS Variable, mean2 AS mean_2dp, med2 AS median_2dp, sd2 AS sd_2dp, iqr2 AS iqr_2dp,
  sk2 AS skew_2dp, ku2 AS kurt_2dp, st2 AS stat_2dp,
  'ANALYSE DE LA VARIABLE : ' || upper(variable) AS title, dist AS conclusion FROM pr"""


@query("snk03_render_report", _REPORT_SQL)
def snk03(spark, sf):
    """SNK-3: the report fields (numbers at 2 decimals) and title/conclusion lines.

    ``render_report`` joins them into the 7-line text; the oracle compares the
    parts, which do not depend on each engine's float-to-text rounding.
    """
    p = P.profile_discrete(read(spark, sf, "lineitem"), MEASURES, digits=None)
    rep = P.render_report(p)
    j = p.join(rep, "Variable")
    lines = F.split(F.col("report"), "\n")
    return j.select(
        "Variable", _r(F.col("Moyenne"), 2).alias("mean_2dp"), _r(F.col("Mediane"), 2).alias("median_2dp"),
        _r(F.col("Ecart_Type"), 2).alias("sd_2dp"), _r(F.col("IQR"), 2).alias("iqr_2dp"),
        _r(F.col("Skewness"), 2).alias("skew_2dp"), _r(F.col("Kurtosis"), 2).alias("kurt_2dp"),
        _r(F.col("Stat_Test_Normalite"), 2).alias("stat_2dp"),
        lines[0].alias("title"),
        F.regexp_extract(lines[6], r"est (.*)\.$", 1).alias("conclusion"))


# ---------------------------------------------------------------- frequency, histogram, kde, box

#: every labelled variable; the health card is not among the scoring fields, so it has an expression of its own
FREQ_COLS = list(FV.FREQUENCY_LABELS)
_CARD = "household % 5"
_LK_ROWS = [(v, str(k), lab) for v, m in FV.FREQUENCY_LABELS.items() for k, lab in m.items()]


@query("agg04_frequency", f"""
WITH s AS (SELECT *, {_CARD} AS cartesante FROM {SV} x),
l AS ({' UNION ALL '.join(f"SELECT '{c}' AS variable, trim(CAST({c} AS VARCHAR)) AS code FROM s" for c in FREQ_COLS)}),
c AS (SELECT variable, code, COUNT(*) AS n FROM l GROUP BY 1, 2),
t AS (SELECT variable, SUM(n) AS tot FROM c GROUP BY 1)
SELECT c.variable, c.code, c.n, ROUND(c.n * 100.0 / t.tot, 6) AS pct, k.label
FROM c JOIN t USING (variable) LEFT JOIN {values_sql(_LK_ROWS, ['variable', 'code', 'label'], 'k')}
  ON c.variable = k.variable AND c.code = k.code""")
def agg04(spark, sf):
    """All labelled variables and all their codes; codes without a label are reported with a null one."""
    lk = label_lookup(spark, FV.FREQUENCY_LABELS).select("variable", F.col("code").cast("string").alias("code"), "label")
    f = P.frequency(survey_records(spark, sf).withColumn("cartesante", F.expr(_CARD)), FREQ_COLS, lookup=lk, keep_unmapped=True)
    return f.select("variable", "code", "n", _r(F.col("pct")).alias("pct"), "label")


HIST_COLS = ["l_extendedprice", "l_quantity"]
_HLONG = long_sql("lineitem", HIST_COLS)


@query("agg14_histogram", f"""
WITH l AS (SELECT * FROM {_HLONG}),
r AS (SELECT variable, MIN(value) AS mn, MAX(value) AS mx, COUNT(*) AS nn FROM l GROUP BY 1),
b AS (SELECT l.variable, CAST(CASE WHEN (mx - mn) / 30.0 > 0 THEN LEAST(floor((value - mn) / ((mx - mn) / 30.0)), 29)
        ELSE 0 END AS INTEGER) AS bin, mn, (mx - mn) / 30.0 AS w, nn FROM l JOIN r USING (variable))
SELECT variable, bin, ROUND(mn + bin * w, 6) AS lo, ROUND(mn + (bin + 1) * w, 6) AS hi, COUNT(*) AS n,
  ROUND(COUNT(*) / (nn * w) * (30.0 * w), 8) AS density_scaled FROM b GROUP BY variable, bin, mn, w, nn""")
def agg14(spark, sf):
    h = P.histogram(read(spark, sf, "lineitem"), HIST_COLS, bins=30)
    return h.select("variable", "bin", _r(F.col("lo")).alias("lo"), _r(F.col("hi")).alias("hi"), "n",
                    _r(F.col("density") * (F.col("hi") - F.col("lo")) * 30.0, 8).alias("density_scaled"))


@query("agg15_kde", f"""
WITH l AS (SELECT * FROM {_HLONG}),
c AS (SELECT variable, value, COUNT(*) AS n FROM l GROUP BY 1, 2),
m AS (SELECT variable, COUNT(*) AS nn, MIN(value) AS mn, MAX(value) AS mx,
        STDDEV_SAMP(value) * pow(CAST(COUNT(*) AS DOUBLE), -0.2) AS h FROM l GROUP BY 1),
j AS (SELECT c.variable, c.value, c.n, m.nn, m.mn, m.h, (m.mx - m.mn) / 99.0 AS st FROM c JOIN m USING (variable)),
e AS (SELECT j.*, g.g FROM j CROSS JOIN range(0, 100) g(g))
SELECT variable, CAST(g AS INTEGER) AS grid_index, ROUND(mn + g * st, 6) AS x,
  ROUND(SUM(n * exp(-0.5 * ((mn + g * st - value) / h) * ((mn + g * st - value) / h))) / (nn * h * sqrt(2 * pi()))
        * (99.0 * st), 8) AS density_scaled
FROM e GROUP BY variable, g, mn, st, nn, h""")
def agg15(spark, sf):
    k = P.kde(read(spark, sf, "lineitem"), HIST_COLS, grid=100)
    rng = read(spark, sf, "lineitem").agg(
        *[(F.max(c) - F.min(c)).alias(c) for c in HIST_COLS]).unpivot([], HIST_COLS, "variable", "_rng")
    return k.join(F.broadcast(rng), "variable").select(
        "variable", "grid_index", _r(F.col("x")).alias("x"),
        _r(F.col("density") * F.col("_rng"), 8).alias("density_scaled"))


@query("agg16_box_stats", f"""
WITH l AS (SELECT * FROM {LONG}),
q AS (SELECT variable, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
        quantile_cont(value, 0.75) AS q3, AVG(value) AS mean FROM l GROUP BY 1)
SELECT variable, ROUND(q1, 6) AS q1, ROUND(median, 6) AS median, ROUND(q3, 6) AS q3,
  MIN(CASE WHEN value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1) THEN value END) AS whisker_lo,
  MAX(CASE WHEN value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1) THEN value END) AS whisker_hi,
  CAST(COUNT(*) FILTER (WHERE NOT (value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1))) AS BIGINT)
    AS n_outliers, ROUND(mean, 4) AS mean
FROM l JOIN q USING (variable) GROUP BY variable, q1, median, q3, mean""")
def agg16(spark, sf):
    b = P.box_stats(read(spark, sf, "lineitem"), MEASURES)
    return b.select("variable", _r(F.col("q1")).alias("q1"), _r(F.col("median")).alias("median"),
                    _r(F.col("q3")).alias("q3"), "whisker_lo", "whisker_hi", "n_outliers",
                    _r(F.col("mean"), 4).alias("mean"))


# ---------------------------------------------------------------- other aggregates

@query("agg01_shape_log", """
SELECT 'raw' AS stage, COUNT(*) AS n_rows, 11 AS n_cols FROM lineitem
UNION ALL SELECT 'valid', COUNT(*), 11 FROM lineitem WHERE l_linestatus = 'F'
UNION ALL SELECT 'in_range', COUNT(*), 11 FROM lineitem WHERE l_linestatus = 'F'
  AND l_extendedprice BETWEEN 1000.0 AND 100000.0""")
def agg01(spark, sf):
    """Counted while the plan runs once, into a table."""
    watch = A.StageCounts(spark)
    li = watch("raw", read(watch.spark, sf, "lineitem"))
    s1 = watch("valid", C.keep_valid(li, "l_linestatus", "F"))
    s2 = watch("in_range", C.keep_range(s1, ["l_extendedprice"], 1000.0, 100000.0))
    sinks.write_table(s2, sinks.output_path(spark, f"in_range_{uuid.uuid4().hex[:12]}"), "parquet")
    return watch.table(spark)


# ---------------------------------------------------------------- the preparation plan

_CONT = FV.CONTINUOUS_FIELDS
_CATS = [c for c in C.merged(FV.CATEGORICAL_FIELDS, FV.MISSING_RULES) if c not in _CONT]
_SENT = ", ".join(map(str, FV.GENERIC_SENTINELS))
_HGB = ", ".join(map(str, FV.HAEMOGLOBIN_SENTINELS + [9996, 9997, 9998, 9999]))
_BMI = ", ".join(map(str, FV.BMI_SENTINELS))
_VALID_SQL = f"(SELECT * FROM {RAW_SURVEY_SQL} r WHERE hw13 = 0)"
_ANTHRO_SQL = f"""(SELECT * FROM {_VALID_SQL} r WHERE hw5 NOT IN (9998, 9999) AND hw8 NOT IN (9998, 9999) AND hw11 NOT IN (9998, 9999)
  AND hw5 BETWEEN -600 AND 600 AND hw8 BETWEEN -600 AND 600 AND hw11 BETWEEN -600 AND 600)"""
_MEASURED_SQL = f"""(SELECT * REPLACE (v445 / 100.0 AS v445, v438 / 10.0 AS v438) FROM {_ANTHRO_SQL} r
  WHERE COALESCE(v445 NOT IN ({_BMI}), true) AND COALESCE(v438 NOT IN ({_HGB}), true))"""


def _rule_sql(c: str) -> str:
    codes, target = FV.MISSING_RULES[c]
    return f"CAST(COALESCE(CASE WHEN {c} IN ({', '.join(map(str, codes))}) THEN {target} ELSE {c} END, {target}) AS BIGINT)"


def _null_sql(c: str) -> str:
    return c if c in ("v445", "v438") else f"CASE WHEN {c} IN ({_SENT}) THEN NULL ELSE {c} END"


_CLEAN_SQL = f"""(WITH n AS (SELECT * REPLACE ({', '.join(f'CAST({_null_sql(c)} AS DOUBLE) AS {c}' for c in _CONT)}) FROM {_MEASURED_SQL} r),
  m AS (SELECT {', '.join(f'quantile_cont({c}, 0.5) AS m_{c}' for c in _CONT)} FROM n)
  SELECT hw5, hw8, hw11, v005 / 1e6 AS poids_analytique, {', '.join(f'COALESCE({c}, m_{c}) AS {c}' for c in _CONT)}, {', '.join(f'{_rule_sql(c)} AS {c}' for c in _CATS)},
  CAST(hw5 < -200 OR hw8 < -200 OR hw11 < -200 AS INTEGER) AS Y_ICEA FROM n, m)"""


@query("cln09_clean_survey", f"""
SELECT v024, COUNT(*) AS n, CAST(SUM(Y_ICEA) AS BIGINT) AS positives, ROUND(SUM(poids_analytique), 4) AS weight,
  {', '.join(f'ROUND(SUM({c}), 3) AS {c}_sum' for c in _CONT)}, {', '.join(f'CAST(SUM({c}) AS BIGINT) AS {c}_codes' for c in _CATS if c != 'v024')}
FROM {_CLEAN_SQL} c GROUP BY v024""")
def cln09(spark, sf):
    """The whole preparation plan (validity, sentinels, implied decimals, medians, missing codes, indicators) per region."""
    df = C.clean_survey(raw_survey(spark, sf))
    return df.groupBy("v024").agg(
        F.count(F.lit(1)).alias("n"), F.sum("Y_ICEA").cast("long").alias("positives"), _r(F.sum("poids_analytique"), 4).alias("weight"),
        *[_r(F.sum(c), 3).alias(f"{c}_sum") for c in _CONT], *[F.sum(c).cast("long").alias(f"{c}_codes") for c in _CATS if c != "v024"])


@query("agg01b_preparation_counts", f"""
SELECT 'raw' AS stage, COUNT(*) AS n_rows, {len(RAW_SURVEY)} AS n_cols FROM lineitem
UNION ALL SELECT 'valid', COUNT(*), {len(RAW_SURVEY)} FROM {_VALID_SQL} v
UNION ALL SELECT 'anthropometry', COUNT(*), {len(RAW_SURVEY)} FROM {_ANTHRO_SQL} a
UNION ALL SELECT 'continuous', COUNT(*), {len(RAW_SURVEY)} FROM {_MEASURED_SQL} m
UNION ALL SELECT 'clean', COUNT(*), {len(RAW_SURVEY) + 5} FROM {_MEASURED_SQL} m""")
def agg01b(spark, sf):
    """AGG-1 of the preparation plan, counted while it writes its table."""
    watch = A.StageCounts(spark)
    sinks.write_table(C.clean_survey(raw_survey(watch.spark, sf), watch), sinks.output_path(spark, f"clean_{uuid.uuid4().hex[:12]}"), "parquet")
    return watch.table(spark)


@query("agg05_cardinality", """
SELECT 'l_suppkey' AS variable, CAST(COUNT(DISTINCT l_suppkey) AS BIGINT) AS n_distinct FROM lineitem
UNION ALL SELECT 'l_partkey', CAST(COUNT(DISTINCT l_partkey) AS BIGINT) FROM lineitem
UNION ALL SELECT 'l_orderkey', CAST(COUNT(DISTINCT l_orderkey) AS BIGINT) FROM lineitem
UNION ALL SELECT 'l_quantity', CAST(COUNT(DISTINCT l_quantity) AS BIGINT) FROM lineitem""")
def agg05(spark, sf):
    return A.cardinality(read(spark, sf, "lineitem"), ["l_suppkey", "l_partkey", "l_orderkey", "l_quantity"])


@query("agg07_weighted_mean", f"""
SELECT l_returnflag, ROUND(SUM(w * y) / SUM(w), 6) AS weighted_rate, ROUND(SUM(w * p) / SUM(w), 6) AS weighted_score
FROM {O} o GROUP BY 1""")
def agg07(spark, sf):
    o = observations(spark, sf)
    return o.groupBy("l_returnflag").agg(_r(A.weighted_mean("y", "w")).alias("weighted_rate"),
                                         _r(A.weighted_mean("p", "w")).alias("weighted_score"))


@query("agg08_prevalence", f"""
SELECT ROUND(AVG(CAST(y AS DOUBLE)), 6) AS prevalence, ROUND(AVG(CAST(y1 AS DOUBLE)), 6) AS prev_y1,
  ROUND(AVG(CAST(y2 AS DOUBLE)), 6) AS prev_y2, ROUND(AVG(CAST(y3 AS DOUBLE)), 6) AS prev_y3 FROM {O} o""")
def agg08(spark, sf):
    return observations(spark, sf).agg(*[_r(A.prevalence(c)).alias(n) for c, n in
                                         [("y", "prevalence"), ("y1", "prev_y1"), ("y2", "prev_y2"), ("y3", "prev_y3")]])


@query("agg09_conditional_rates", f"""
SELECT ROUND(AVG(CAST(y1 AS DOUBLE)), 6) AS p_y1_given_y, ROUND(AVG(CAST(y2 AS DOUBLE)), 6) AS p_y2_given_y,
  ROUND(AVG(CAST(y3 AS DOUBLE)), 6) AS p_y3_given_y FROM {O} o WHERE y = 1""")
def agg09(spark, sf):
    r = A.conditional_rates(observations(spark, sf), "y", ["y1", "y2", "y3"])
    return r.select(*[_r(F.col(c)).alias(c) for c in r.columns])


@query("agg11_batch_kpis", f"""
SELECT COUNT(*) AS total, CAST(SUM(y) AS BIGINT) AS alerts, CAST(SUM(1 - y) AS BIGINT) AS normal,
  ROUND(AVG(CAST(y AS DOUBLE)), 6) AS alert_rate, ROUND(AVG(p), 6) AS mean_score FROM {O} o""")
def agg11(spark, sf):
    k = A.batch_kpis(observations(spark, sf), "y", "p")
    return k.select("total", "alerts", "normal", _r(F.col("alert_rate")).alias("alert_rate"),
                    _r(F.col("mean_score")).alias("mean_score"))


@query("agg12_session_kpis", """
SELECT user_id, COUNT(*) AS total, CAST(SUM(CAST(event_type = 'error' AS INTEGER)) AS BIGINT) AS alerts,
  ROUND(AVG(CAST(event_type = 'error' AS DOUBLE)), 6) AS alert_rate, ROUND(AVG(value / 500.0), 6) AS mean_score
FROM events GROUP BY user_id""")
def agg12(spark, sf):
    ev = read(spark, sf, "events").select("user_id", (F.col("event_type") == "error").cast("int").alias("y"),
                                          (F.col("value") / 500.0).alias("s"))
    k = A.session_kpis(ev, "user_id", "y", "s")
    return k.select("user_id", "total", "alerts", _r(F.col("alert_rate")).alias("alert_rate"),
                    _r(F.col("mean_score")).alias("mean_score"))


@query("agg13_subclass_summary", f"""
WITH r AS (SELECT AVG(CAST(y1 AS DOUBLE)) AS r1, AVG(CAST(y2 AS DOUBLE)) AS r2, AVG(CAST(y3 AS DOUBLE)) AS r3
           FROM {O} o WHERE y = 1),
m AS (SELECT p * r1 AS p1, p * r2 AS p2, p * r3 AS p3 FROM {O} o, r)
SELECT 'stunting' AS subclass, ROUND(AVG(p1), 6) AS mean_prob, CAST(COUNT(*) FILTER (WHERE p1 >= 0.30) AS BIGINT) AS n_above FROM m
UNION ALL SELECT 'wasting', ROUND(AVG(p2), 6), CAST(COUNT(*) FILTER (WHERE p2 >= 0.15) AS BIGINT) FROM m
UNION ALL SELECT 'underweight', ROUND(AVG(p3), 6), CAST(COUNT(*) FILTER (WHERE p3 >= 0.20) AS BIGINT) FROM m""")
def agg13(spark, sf):
    o = observations(spark, sf)
    rates = A.conditional_rates(o, "y", ["y1", "y2", "y3"], ["r1", "r2", "r3"])
    m = D.marginalise(o, "p", rates, {"p1": "r1", "p2": "r2", "p3": "r3"}, digits=None)
    s = A.subclass_summary(m, {"stunting": ("p1", 0.30), "wasting": ("p2", 0.15), "underweight": ("p3", 0.20)})
    return s.select("subclass", _r(F.col("mean_prob")).alias("mean_prob"), "n_above")


@query("agg17_column_widths", """
SELECT 'o_orderkey' AS variable, LEAST(GREATEST(MAX(length(CAST(o_orderkey AS VARCHAR))), 10) + 3, 65) AS width FROM orders
UNION ALL SELECT 'o_orderpriority', LEAST(GREATEST(MAX(length(o_orderpriority)), 15) + 3, 65) FROM orders
UNION ALL SELECT 'o_orderstatus', LEAST(GREATEST(MAX(length(o_orderstatus)), 13) + 3, 65) FROM orders""")
def agg17(spark, sf):
    df = read(spark, sf, "orders")
    w = A.column_widths(df, ["o_orderkey", "o_orderpriority", "o_orderstatus"])
    return w.select("variable", F.col("width").cast("int").alias("width"))


@query("agg18_share", f"""
WITH c AS (SELECT CASE WHEN y = 1 THEN 'risk' ELSE 'normal' END AS part, COUNT(*) AS n FROM {O} o GROUP BY 1)
SELECT part, n, ROUND(n * 1.0 / SUM(n) OVER (), 6) AS share FROM c""")
def agg18(spark, sf):
    s = A.share(observations(spark, sf), "y")
    return s.select("part", "n", _r(F.col("share")).alias("share"))


@query("agg10b_rate_by_group_weighted", f"""
SELECT region, COUNT(*) AS total, CAST(SUM(y) AS BIGINT) AS alerts, ROUND(AVG(p), 6) AS mean_score,
  ROUND(AVG(CAST(y AS DOUBLE)), 6) AS alert_rate, ROUND(SUM(w * y) / SUM(w), 6) AS weighted_rate FROM {SV} s GROUP BY 1""")
def agg10b(spark, sf):
    g = A.by_group(survey_records(spark, sf), "region", "y", "p", "w")
    return g.select("region", "total", "alerts", *[_r(F.col(c)).alias(c) for c in
                                                  ("mean_score", "alert_rate", "weighted_rate")])


# ---------------------------------------------------------------- windows

@query("win01_sequence", """
SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS seq
FROM events""")
def win01(spark, sf):
    ev = read(spark, sf, "events").select("event_id", "user_id", "ts")
    return A.sequence(ev, "user_id", ["ts", "event_id"]).select("event_id", "user_id", "seq")


@query("win04_share_of_total", f"""
WITH c AS (SELECT region, milieuderesidence, COUNT(*) AS n FROM {SV} s GROUP BY 1, 2)
SELECT region, milieuderesidence, n, ROUND(n * 100.0 / SUM(n) OVER (PARTITION BY region), 6) AS pct FROM c""")
def win04(spark, sf):
    c = survey_records(spark, sf).groupBy("region", "milieuderesidence").agg(F.count(F.lit(1)).alias("n"))
    s = A.share_of_total(c, "n", ["region"])
    return s.select("region", "milieuderesidence", "n", _r(F.col("pct")).alias("pct"))


# ---------------------------------------------------------------- top-k

_TOP_FEATS = ["ageenfant", "indicederichesse", "niveauinstructionmere", "rangdenaissance", "hemoglobinemere",
              "intervalleintergenesique", "dureeallaitement", "nombreenfantsnesvivants", "nombrevisitesprenatales",
              "nombremembresmenage", "imcmere", "region", "agemere", "tailleanaissance", "regionecologique",
              "prisededecisionmere", "statutmatrimonialmere", "sexeenfant", "milieuderesidence"]


def separation(df, feats, y):
    """Per-feature class separation |mean1 - mean0| / sd (a model-free importance)."""
    from surveyspark.operators import stats_core as S
    lg = S.long_form(df, feats, [y])
    return lg.groupBy("variable").agg(
        (F.abs(F.avg(F.when(F.col(y) == 1, F.col("value"))) - F.avg(F.when(F.col(y) == 0, F.col("value"))))
         / F.stddev_samp("value")).alias("importance"))


@query("top02_top_features", f"""
WITH l AS ({' UNION ALL '.join(f"SELECT '{c}' AS variable, CAST({c} AS DOUBLE) AS value, y FROM {SV} s" for c in _TOP_FEATS)}),
i AS (SELECT variable, abs(AVG(CASE WHEN y = 1 THEN value END) - AVG(CASE WHEN y = 0 THEN value END))
        / STDDEV_SAMP(value) AS importance FROM l GROUP BY 1)
SELECT variable, ROUND(importance, 6) AS importance FROM i ORDER BY importance DESC, variable ASC LIMIT 15""")
def top02(spark, sf):
    imp = separation(survey_records(spark, sf), _TOP_FEATS, "y")
    t = A.top_k(imp, "importance", 15, "variable")
    return t.select("variable", _r(F.col("importance")).alias("importance"))


@query("top04_preview", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey ASC LIMIT 50""")
def top04(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return A.preview(o, [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()], 50)


@query("top05_ordered", f"""
SELECT region, COUNT(*) AS total, ROUND(AVG(CAST(y AS DOUBLE)), 6) AS rate FROM {SV} s GROUP BY 1
ORDER BY rate ASC, region ASC""")
def top05(spark, sf):
    g = survey_records(spark, sf).groupBy("region").agg(F.count(F.lit(1)).alias("total"),
                                                        _r(F.avg(F.col("y").cast("double"))).alias("rate"))
    return A.ordered(g, [F.col("rate").asc(), F.col("region").asc()])
