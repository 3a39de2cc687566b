"""Cleaning, filters, projections and derived columns bound to the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyspark.functions import exprs as X
from surveyspark.functions.lookups import lookup_from_pairs
from surveyspark.operators import aggregate as A
from surveyspark.operators import clean as C
from surveyspark.operators import derive as D
from surveyspark.operators import profile as P
from surveyspark.operators import schema_ops as PRJ
from surveyspark.plans.registry import query
from surveyspark.plans.tables import (OBS_SQL, SURVEY_SQL, observations, read, supplier_region,
                                      survey_records)

O = OBS_SQL
SV = SURVEY_SQL


def _r(c, d=6):
    return F.round(c, d)


# ---------------------------------------------------------------- filters (FLT)

@query("flt01_keep_valid", """
SELECT l_linestatus, COUNT(*) AS n, ROUND(SUM(l_extendedprice), 2) AS revenue
FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_linestatus""")
def flt01(spark, sf):
    df = C.keep_valid(read(spark, sf, "lineitem"), "l_linestatus", "F")
    return df.groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("n"),
                                          F.round(F.sum("l_extendedprice"), 2).alias("revenue"))


def _line_code(spark, sf):
    # l_linenumber with 7 made a null: a sentinel-and-null fixture derived from the table
    return read(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.nullif(F.col("l_linenumber"), F.lit(7)).alias("code"))


@query("flt02_drop_codes_and_nulls", """
SELECT code, COUNT(*) AS n FROM (SELECT NULLIF(l_linenumber, 7) AS code FROM lineitem)
WHERE code IS NOT NULL AND code NOT IN (5, 6) GROUP BY code""")
def flt02(spark, sf):
    df = C.drop_codes(_line_code(spark, sf), "code", [5, 6], drop_null=True)
    return df.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("flt03_drop_codes_keep_nulls", """
SELECT code, COUNT(*) AS n FROM (SELECT NULLIF(l_linenumber, 7) AS code FROM lineitem)
WHERE code IS NULL OR code NOT IN (5, 6) GROUP BY code""")
def flt03(spark, sf):
    df = C.drop_codes(_line_code(spark, sf), "code", [5, 6], drop_null=False)
    return df.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("flt04_keep_range", """
SELECT l_linenumber, COUNT(*) AS n, ROUND(SUM(l_extendedprice), 2) AS revenue FROM lineitem
WHERE l_extendedprice BETWEEN 1000.0 AND 50000.0 AND l_quantity BETWEEN 1.0 AND 40.0
GROUP BY l_linenumber""")
def flt04(spark, sf):
    df = C.keep_range(read(spark, sf, "lineitem"), ["l_extendedprice"], 1000.0, 50000.0)
    df = C.keep_range(df, ["l_quantity"], 1.0, 40.0)
    return df.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"),
                                          F.round(F.sum("l_extendedprice"), 2).alias("revenue"))


_TEXT_SQL = "CASE WHEN l_linenumber = 7 THEN ' NA ' WHEN l_linenumber = 6 THEN 'nan' " \
            "WHEN l_linenumber = 5 THEN '' ELSE l_returnflag END"


@query("flt05_drop_text_na", f"""
SELECT trim(t) AS code, COUNT(*) AS n FROM (SELECT {_TEXT_SQL} AS t FROM lineitem)
WHERE t IS NOT NULL AND trim(t) NOT IN ('NA', 'na', '', 'nan', 'NaN') GROUP BY trim(t)""")
def flt05(spark, sf):
    df = read(spark, sf, "lineitem").select(F.expr(_TEXT_SQL).alias("t"))
    df = C.drop_text_na(df, "t")
    return df.groupBy(F.trim("t").alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query("flt06_drop_unmapped", """
WITH c AS (SELECT l_returnflag AS code, COUNT(*) AS n FROM lineitem GROUP BY 1),
t AS (SELECT SUM(n) AS tot FROM c)
SELECT 'l_returnflag' AS variable, c.code, c.n, ROUND(c.n * 100.0 / t.tot, 6) AS pct, l.label
FROM c, t JOIN (VALUES ('A', 'Accepted'), ('R', 'Returned')) l(code, label) ON TRUE
WHERE c.code = l.code""")
def flt06(spark, sf):
    lk = spark.createDataFrame([("l_returnflag", "A", "Accepted"), ("l_returnflag", "R", "Returned")],
                               "variable STRING, code STRING, label STRING")
    f = P.frequency(read(spark, sf, "lineitem"), ["l_returnflag"], lookup=lk)
    return f.select("variable", "code", "n", _r(F.col("pct")).alias("pct"), "label")


@query("flt07_where_composite", f"""
SELECT l_returnflag, COUNT(*) AS n FROM {O} o WHERE y = 1 GROUP BY l_returnflag""")
def flt07(spark, sf):
    df = observations(spark, sf).where(F.col("y") == 1)
    return df.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("flt08_count_at_least", f"""
SELECT CAST(COUNT(*) FILTER (WHERE p >= 0.5) AS BIGINT) AS n_at_least FROM {O} o""")
def flt08(spark, sf):
    return C.count_at_least(observations(spark, sf), "p", 0.5)


@query("flt09_drop_terms", f"""
SELECT term, value FROM (
  SELECT 'Intercept' AS term, CAST(COUNT(*) AS BIGINT) AS value FROM {O} o
  UNION ALL SELECT 'y1', CAST(SUM(y1) AS BIGINT) FROM {O} o
  UNION ALL SELECT 'y2', CAST(SUM(y2) AS BIGINT) FROM {O} o
  UNION ALL SELECT 'y3', CAST(SUM(y3) AS BIGINT) FROM {O} o) WHERE term <> 'Intercept'""")
def flt09(spark, sf):
    o = observations(spark, sf)
    wide = o.agg(F.count(F.lit(1)).alias("Intercept"), F.sum("y1").cast("long").alias("y1"),
                 F.sum("y2").cast("long").alias("y2"), F.sum("y3").cast("long").alias("y3"))
    terms = wide.unpivot([], ["Intercept", "y1", "y2", "y3"], "term", "value")
    return C.drop_terms(terms, ["Intercept", "absent_term"])


# ---------------------------------------------------------------- cleaning (CLN)

@query("cln01_rescale", """
SELECT l_linenumber, ROUND(SUM(l_extendedprice / 100.0), 4) AS price_hundreds,
  ROUND(SUM(l_quantity / 10.0), 4) AS qty_tens FROM lineitem GROUP BY l_linenumber""")
def cln01(spark, sf):
    df = C.rescale(read(spark, sf, "lineitem"), {"l_extendedprice": 100.0, "l_quantity": 10.0})
    return df.groupBy("l_linenumber").agg(F.round(F.sum("l_extendedprice"), 4).alias("price_hundreds"),
                                          F.round(F.sum("l_quantity"), 4).alias("qty_tens"))


@query("cln02_codes_to_null", """
SELECT CASE WHEN l_linenumber IN (6, 7) THEN NULL ELSE l_linenumber END AS code, COUNT(*) AS n
FROM lineitem GROUP BY 1""")
def cln02(spark, sf):
    df = read(spark, sf, "lineitem").select(F.col("l_linenumber").alias("code"))
    return C.codes_to_null(df, ["code"], [6, 7]).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


_X_NULL = "CASE WHEN l_linenumber >= 6 THEN NULL ELSE l_quantity END"


@query("cln03_impute_median", f"""
WITH b AS (SELECT l_linenumber, {_X_NULL} AS x, {_X_NULL.replace('l_quantity', 'l_extendedprice')} AS z
           FROM lineitem),
m AS (SELECT median(x) AS mx, median(z) AS mz FROM b)
SELECT l_linenumber, COUNT(*) AS n, ROUND(SUM(COALESCE(x, mx)), 4) AS x_sum,
  ROUND(SUM(COALESCE(z, mz)), 2) AS z_sum FROM b, m GROUP BY l_linenumber""")
def cln03(spark, sf):
    df = read(spark, sf, "lineitem").select(
        "l_linenumber", F.expr(_X_NULL).alias("x"),
        F.expr(_X_NULL.replace("l_quantity", "l_extendedprice")).alias("z"))
    out = C.impute_median(df, ["x", "z"])
    return out.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"), _r(F.sum("x"), 4).alias("x_sum"),
                                           _r(F.sum("z"), 2).alias("z_sum"))


@query("cln04_impute_const", f"""
SELECT l_linenumber, ROUND(SUM(COALESCE({_X_NULL}, 3.0)), 4) AS x_sum FROM lineitem GROUP BY l_linenumber""")
def cln04(spark, sf):
    df = read(spark, sf, "lineitem").select("l_linenumber", F.expr(_X_NULL).alias("x"))
    return C.impute_const(df, "x", 3.0).groupBy("l_linenumber").agg(_r(F.sum("x"), 4).alias("x_sum"))


@query("cln05_collapse_missing", """
SELECT CAST(COALESCE(CASE WHEN p_size IN (48, 49, 50) THEN 99 ELSE p_size END, 99) AS INTEGER) AS p_size,
  CAST(COALESCE(CASE WHEN NULLIF(CAST(p_partkey % 10 AS INTEGER), 0) IN (8, 9) THEN 9
                ELSE NULLIF(CAST(p_partkey % 10 AS INTEGER), 0) END, 9) AS INTEGER) AS digit,
  COUNT(*) AS n FROM part GROUP BY 1, 2""")
def cln05(spark, sf):
    df = read(spark, sf, "part").select(
        "p_size", F.nullif((F.col("p_partkey") % 10).cast("int"), F.lit(0)).alias("digit"))
    rules = {"p_size": ([48, 49, 50], 99), "digit": ([8, 9], 9)}
    out = C.collapse_missing(df, ["p_size", "digit"], rules)
    return out.groupBy("p_size", "digit").agg(F.count(F.lit(1)).alias("n"))


@query("cln06_recode", """
SELECT CASE CAST(split_part(o_orderpriority, '-', 1) AS INTEGER) WHEN 2 THEN 1 WHEN 4 THEN 5
  ELSE CAST(split_part(o_orderpriority, '-', 1) AS INTEGER) END AS priority, COUNT(*) AS n
FROM orders GROUP BY 1""")
def cln06(spark, sf):
    df = read(spark, sf, "orders").select(X.prefix_code("o_orderpriority", "-").alias("priority"))
    return C.recode(df, "priority", {2: 1, 4: 5}).groupBy("priority").agg(F.count(F.lit(1)).alias("n"))


@query("cln07_clip", f"""
SELECT l_returnflag, ROUND(SUM(GREATEST(LEAST(p, 0.9), 0.1)), 6) AS clipped_sum,
  ROUND(MIN(GREATEST(LEAST(p, 0.9), 0.1)), 6) AS clipped_min,
  ROUND(MAX(GREATEST(LEAST(p, 0.9), 0.1)), 6) AS clipped_max FROM {O} o GROUP BY l_returnflag""")
def cln07(spark, sf):
    df = observations(spark, sf).withColumn("c", X.clip("p", 0.1, 0.9))
    return df.groupBy("l_returnflag").agg(_r(F.sum("c")).alias("clipped_sum"), _r(F.min("c")).alias("clipped_min"),
                                          _r(F.max("c")).alias("clipped_max"))


@query("cln08_nullif_zero", """
SELECT l_linenumber, CAST(COUNT(*) FILTER (WHERE l_tax = 0) AS BIGINT) AS n_null,
  ROUND(SUM(l_discount / NULLIF(l_tax, 0)), 4) AS ratio_sum FROM lineitem GROUP BY l_linenumber""")
def cln08(spark, sf):
    df = read(spark, sf, "lineitem").withColumn("r", X.safe_ratio("l_discount", "l_tax"))
    return df.groupBy("l_linenumber").agg(F.count_if(F.col("r").isNull()).alias("n_null"),
                                          _r(F.sum("r"), 4).alias("ratio_sum"))


# ---------------------------------------------------------------- projections (PRJ)

@query("prj01_select_available", f"""
SELECT household, cluster, w FROM {O} o""")
def prj01(spark, sf):
    return PRJ.select_available(observations(spark, sf), ["household", "cluster", "absent_column", "w"])


_ORDER_NAMES = {"o_orderkey": "order_id", "o_custkey": "customer_id", "o_totalprice": "total_price",
                "o_orderpriority": "priority"}


@query("prj02_rename_by", """
SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_totalprice AS total_price,
  o_orderpriority AS priority FROM orders""")
def prj02(spark, sf):
    df = read(spark, sf, "orders").select(*_ORDER_NAMES)
    return PRJ.rename_by(df, {**_ORDER_NAMES, "absent": "x"})


@query("prj03_merge_columns", f"""
SELECT household, cluster, y1, y2, y3, w FROM {O} o""")
def prj03(spark, sf):
    cols = PRJ.merge_columns(["household", "cluster", "y1"], ["y1", "y2", "y3"], ["cluster", "w"])
    return observations(spark, sf).select(*cols)


@query("prj04_require_columns", f"""
SELECT cluster, COUNT(*) AS n, CAST(SUM(y) AS BIGINT) AS alerts FROM {O} o GROUP BY cluster""")
def prj04(spark, sf):
    df = PRJ.require_columns(observations(spark, sf), ["cluster", "y"])
    return df.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("alerts"))


PROPS_SCHEMA = T.StructType([T.StructField("event_id", T.LongType(), False),
                             T.StructField("event_type", T.StringType(), False),
                             T.StructField("k", T.IntegerType(), False)])


def parsed_events(spark, sf):
    ev = read(spark, sf, "events")
    return ev.select("event_id", "event_type",
                     F.get_json_object("props", "$.k").alias("k"))


@query("prj05_validate_records", """
WITH e AS (SELECT event_id, event_type, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
SELECT CASE WHEN k IS NULL THEN 'rejected' ELSE 'valid' END AS status, event_type, COUNT(*) AS n,
  CAST(COALESCE(SUM(k), 0) AS BIGINT) AS k_sum FROM e GROUP BY 1, 2""")
def prj05(spark, sf):
    valid, rejected = PRJ.validate_records(parsed_events(spark, sf), PROPS_SCHEMA)
    v = valid.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"),
                                        F.coalesce(F.sum("k"), F.lit(0)).cast("long").alias("k_sum"))
    r = rejected.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("k_sum"))
    return v.withColumn("status", F.lit("valid")).unionByName(r.withColumn("status", F.lit("rejected")))


@query("prj06_align_features", f"""
SELECT w, y3, y2, y1, household FROM {O} o""")
def prj06(spark, sf):
    return PRJ.align_features(observations(spark, sf), ["w", "y3", "y2", "y1", "household"])


@query("prj07_with_default", """
SELECT l_orderkey, l_linenumber, l_discount * l_tax AS dt, 0 AS absent_product FROM lineitem""")
def prj07(spark, sf):
    df = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    df = PRJ.with_default(df, "dt", F.col("l_discount") * F.col("l_tax"), ["l_discount", "l_tax"])
    df = PRJ.with_default(df, "absent_product", F.col("l_discount"), ["no_such_column"], default=0)
    return df.select("l_orderkey", "l_linenumber", "dt", "absent_product")


@query("prj08_encode_labels", """
SELECT CASE l_returnflag WHEN 'A' THEN '1' WHEN 'N' THEN '2' ELSE l_returnflag END AS value,
  CASE WHEN l_returnflag IN ('A', 'N') THEN 'valid' ELSE 'rejected' END AS status, COUNT(*) AS n
FROM lineitem GROUP BY 1, 2""")
def prj08(spark, sf):
    df = read(spark, sf, "lineitem").select("l_returnflag")
    valid, rej = PRJ.encode_labels(df, {"l_returnflag": {"A": 1, "N": 2}})
    v = valid.groupBy(F.col("l_returnflag").cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")) \
        .withColumn("status", F.lit("valid"))
    r = rej.groupBy(F.col("l_returnflag").alias("value")).agg(F.count(F.lit(1)).alias("n")) \
        .withColumn("status", F.lit("rejected"))
    return v.unionByName(r)


@query("prj09_prefix_code", """
SELECT TRY_CAST(trim(split_part(o_orderpriority, '-', 1)) AS INTEGER) AS code, COUNT(*) AS n
FROM orders GROUP BY 1""")
def prj09(spark, sf):
    df = read(spark, sf, "orders").select(X.prefix_code("o_orderpriority", "-").alias("code"))
    return df.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("prj10_decode_labels", """
WITH o AS (SELECT CAST(split_part(o_orderpriority, '-', 1) AS INTEGER) AS code FROM orders)
SELECT code, COALESCE(l.label, CAST(code AS VARCHAR)) AS code_label, COUNT(*) AS n
FROM o LEFT JOIN (VALUES (1, 'Urgent'), (2, 'High'), (3, 'Medium')) l(k, label) ON o.code = l.k
GROUP BY 1, 2""")
def prj10(spark, sf):
    df = read(spark, sf, "orders").select(X.prefix_code("o_orderpriority", "-").alias("code"))
    lk = lookup_from_pairs(spark, [(1, "Urgent"), (2, "High"), (3, "Medium")])
    out = PRJ.decode_labels(df, "code", lk, out="code_label")
    return out.groupBy("code", "code_label").agg(F.count(F.lit(1)).alias("n"))


@query("prj11_with_alias", f"""
SELECT milieuderesidence, milieuderesidence AS lieuderesidence, COUNT(*) AS n FROM {SV} s GROUP BY 1""")
def prj11(spark, sf):
    df = PRJ.with_alias(survey_records(spark, sf), "milieuderesidence", "lieuderesidence")
    return df.groupBy("milieuderesidence", "lieuderesidence").agg(F.count(F.lit(1)).alias("n"))


@query("prj12_format_percent", f"""
SELECT l_returnflag, printf('%.1f', ROUND(AVG(CAST(y AS DOUBLE)) * 100.0, 1)) || '%' AS alert_rate_text
FROM {O} o GROUP BY l_returnflag""")
def prj12(spark, sf):
    g = observations(spark, sf).groupBy("l_returnflag").agg(F.avg(F.col("y").cast("double")).alias("r"))
    return g.select("l_returnflag", X.format_percent("r", 1).alias("alert_rate_text"))


@query("prj13_status_label", f"""
SELECT CASE y WHEN 1 THEN 'A risque' WHEN 0 THEN 'Normal' END AS status, COUNT(*) AS n FROM {O} o GROUP BY 1""")
def prj13(spark, sf):
    df = observations(spark, sf).withColumn("status", X.status_label("y", {1: "A risque", 0: "Normal"}))
    return df.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("prj14_enrich_region", """
SELECT s.s_suppkey AS cluster, s.s_nationkey AS region_code, n.n_name AS region_name, r.r_name
FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey""")
def prj14(spark, sf):
    return supplier_region(spark, sf)


@query("prj15_assemble_record", """
SELECT o_orderkey, o_totalprice, strftime(o_orderdate, '%d/%m/%Y %H:%M') AS scored_at FROM orders""")
def prj15(spark, sf):
    df = read(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    return PRJ.assemble_record(df, F.col("o_orderdate")).drop("o_orderdate")


@query("prj16_build_dictionary")
def prj16(spark, sf):
    from surveyspark.functions.fixed_values import LABELS
    df = survey_records(spark, sf)
    cats = {k: ", ".join(f"{c}={lab}" for c, lab in v.items()) for k, v in LABELS.items()}
    return PRJ.build_dictionary(spark, df, {"household": "numeromenage", "cluster": "numerogruppe"},
                                continuous=["ageenfant", "imcmere", "hemoglobinemere", "w"],
                                ids=["household", "cluster"], categories=cats)


_ROLE_COLS = ["l_linenumber", "l_discount", "l_tax", "l_returnflag", "l_quantity"]


@query("prj17_infer_roles", """
SELECT variable, n_distinct, CASE WHEN is_num AND n_distinct > 5 THEN 'continuous' ELSE 'categorical' END AS role
FROM (SELECT 'l_linenumber' AS variable, CAST(COUNT(DISTINCT l_linenumber) AS BIGINT) AS n_distinct, TRUE AS is_num FROM lineitem
 UNION ALL SELECT 'l_discount', CAST(COUNT(DISTINCT l_discount) AS BIGINT), TRUE FROM lineitem
 UNION ALL SELECT 'l_tax', CAST(COUNT(DISTINCT l_tax) AS BIGINT), TRUE FROM lineitem
 UNION ALL SELECT 'l_returnflag', CAST(COUNT(DISTINCT l_returnflag) AS BIGINT), FALSE FROM lineitem
 UNION ALL SELECT 'l_quantity', CAST(COUNT(DISTINCT l_quantity) AS BIGINT), TRUE FROM lineitem)""")
def prj17(spark, sf):
    return PRJ.infer_roles(read(spark, sf, "lineitem"), _ROLE_COLS, k=5)


# ---------------------------------------------------------------- derived (DRV)

@query("drv01_flag_below", """
SELECT CAST(l_extendedprice < 20000.0 AS INTEGER) AS low_price, CAST(l_quantity < 10.0 AS INTEGER) AS low_qty,
  COUNT(*) AS n FROM lineitem GROUP BY 1, 2""")
def drv01(spark, sf):
    df = D.flag_below(read(spark, sf, "lineitem"), {"low_price": ("l_extendedprice", 20000.0),
                                                    "low_qty": ("l_quantity", 10.0)})
    return df.groupBy("low_price", "low_qty").agg(F.count(F.lit(1)).alias("n"))


@query("drv02_any_failure", f"""
SELECT y1, y2, y3, y, COUNT(*) AS n FROM {O} o GROUP BY 1, 2, 3, 4""")
def drv02(spark, sf):
    df = D.any_of(observations(spark, sf).drop("y"), ["y1", "y2", "y3"], "y")
    return df.groupBy("y1", "y2", "y3", "y").agg(F.count(F.lit(1)).alias("n"))


@query("drv03_scale_weight", """
SELECT l_suppkey AS cluster, ROUND(SUM(l_quantity * 1000000.0 / 1000000.0), 4) AS weight_sum
FROM lineitem GROUP BY 1""")
def drv03(spark, sf):
    df = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("cluster"),
                                            (F.col("l_quantity") * 1e6).alias("raw_weight"))
    df = D.scale_weight(df, "raw_weight", 1e6, "weight")
    return df.groupBy("cluster").agg(_r(F.sum("weight"), 4).alias("weight_sum"))


@query("drv04_square", """
SELECT l_linenumber, ROUND(SUM(l_quantity * l_quantity), 4) AS qty_sq_sum FROM lineitem GROUP BY 1""")
def drv04(spark, sf):
    df = read(spark, sf, "lineitem").withColumn("q2", X.square("l_quantity"))
    return df.groupBy("l_linenumber").agg(_r(F.sum("q2"), 4).alias("qty_sq_sum"))


@query("drv05_flag_in", f"""
SELECT CAST(sourceeaupotable IN (11, 12, 13, 21) AS INTEGER) AS eau_amelioree,
  CAST(typeinstallationssanitaires IN (11, 12, 21) AS INTEGER) AS toilettes_ameliorees, COUNT(*) AS n
FROM {SV} s GROUP BY 1, 2""")
def drv05(spark, sf):
    df = survey_records(spark, sf).select(
        X.flag_in("sourceeaupotable", [11, 12, 13, 21]).alias("eau_amelioree"),
        X.flag_in("typeinstallationssanitaires", [11, 12, 21]).alias("toilettes_ameliorees"))
    return df.groupBy("eau_amelioree", "toilettes_ameliorees").agg(F.count(F.lit(1)).alias("n"))


@query("drv06_interact", f"""
SELECT region, CAST(SUM(CAST(sourceeaupotable IN (11, 12, 13, 21) AS INTEGER)
  * CAST(typeinstallationssanitaires IN (11, 12, 21) AS INTEGER)) AS BIGINT) AS wash_sum
FROM {SV} s GROUP BY region""")
def drv06(spark, sf):
    df = D.derive_features(survey_records(spark, sf))
    return df.groupBy("region").agg(F.sum("index_wash_synergie").cast("long").alias("wash_sum"))


@query("drv07_all_of", f"""
SELECT region, CAST(SUM(CAST(milieuderesidence = 2 AND indicederichesse IN (1, 2) AS INTEGER)) AS BIGINT)
  AS rural_poor FROM {SV} s GROUP BY region""")
def drv07(spark, sf):
    df = D.derive_features(survey_records(spark, sf))
    return df.groupBy("region").agg(F.sum("pauvrete_rurale").cast("long").alias("rural_poor"))


@query("drv08_safe_ratio", f"""
SELECT nombremembresmenage, ROUND(SUM(COALESCE(CAST(nombreenfantsnesvivants AS DOUBLE)
  / NULLIF(CAST(nombremembresmenage AS DOUBLE), 0.0), 3.0)), 4) AS ratio_sum FROM {SV} s GROUP BY 1""")
def drv08(spark, sf):
    df = D.derive_features(survey_records(spark, sf))
    return df.groupBy("nombremembresmenage").agg(_r(F.sum("ratio_charge_menage"), 4).alias("ratio_sum"))


@query("drv09_latent_score", f"""
SELECT ROUND(0.5 * y1 + 0.3 * y2 + 0.2 * y3, 6) AS latent, COUNT(*) AS n FROM {O} o GROUP BY 1""")
def drv09(spark, sf):
    df = D.latent_score(observations(spark, sf), {"y1": 0.5, "y2": 0.3, "y3": 0.2})
    return df.groupBy(_r(F.col("latent")).alias("latent")).agg(F.count(F.lit(1)).alias("n"))


@query("drv10_split_at_median", """
WITH m AS (SELECT median(l_extendedprice) AS med FROM lineitem)
SELECT CAST(l_extendedprice >= med AS INTEGER) AS high, COUNT(*) AS n FROM lineitem, m GROUP BY 1""")
def drv10(spark, sf):
    df = D.split_at_median(read(spark, sf, "lineitem").select("l_extendedprice"), "l_extendedprice", "high")
    return df.groupBy("high").agg(F.count(F.lit(1)).alias("n"))


@query("drv11_logit", f"""
SELECT l_returnflag, ROUND(SUM(ln(GREATEST(LEAST(p, 0.99), 0.01) / (1.0 - GREATEST(LEAST(p, 0.99), 0.01)))), 4)
  AS logit_sum FROM {O} o GROUP BY 1""")
def drv11(spark, sf):
    df = observations(spark, sf).withColumn("z", X.logit("p", 0.01))
    return df.groupBy("l_returnflag").agg(_r(F.sum("z"), 4).alias("logit_sum"))


@query("drv12_classify", f"""
SELECT CAST(p >= 0.5 AS INTEGER) AS predicted, y, COUNT(*) AS n FROM {O} o GROUP BY 1, 2""")
def drv12(spark, sf):
    df = observations(spark, sf).withColumn("predicted", X.classify("p", 0.5))
    return df.groupBy("predicted", "y").agg(F.count(F.lit(1)).alias("n"))


_RATES_SQL = f"""(SELECT AVG(CAST(y1 AS DOUBLE)) AS r1, AVG(CAST(y2 AS DOUBLE)) AS r2,
  AVG(CAST(y3 AS DOUBLE)) AS r3 FROM {O} o WHERE y = 1)"""


@query("drv13_marginalise", f"""
SELECT l_returnflag, ROUND(SUM(ROUND(p * r1, 4)), 4) AS p1_sum, ROUND(SUM(ROUND(p * r2, 4)), 4) AS p2_sum,
  ROUND(SUM(ROUND(p * r3, 4)), 4) AS p3_sum FROM {O} o, {_RATES_SQL} r GROUP BY 1""")
def drv13(spark, sf):
    o = observations(spark, sf)
    rates = A.conditional_rates(o, "y", ["y1", "y2", "y3"], ["r1", "r2", "r3"])
    m = D.marginalise(o, "p", rates, {"p1": "r1", "p2": "r2", "p3": "r3"}, digits=4)
    return m.groupBy("l_returnflag").agg(*[_r(F.sum(c), 4).alias(f"{c}_sum") for c in ("p1", "p2", "p3")])


@query("drv14_round", f"""
SELECT ROUND(p * 0.37, 4) AS p_rounded, COUNT(*) AS n FROM {O} o GROUP BY 1""")
def drv14(spark, sf):
    df = observations(spark, sf).withColumn("p_rounded", F.round(F.col("p") * 0.37, 4))
    return df.groupBy("p_rounded").agg(F.count(F.lit(1)).alias("n"))


@query("drv15_band", f"""
SELECT CASE WHEN imcmere < 18.5 THEN 'Maigreur' WHEN imcmere < 25.0 THEN 'Normal'
            WHEN imcmere < 30.0 THEN 'Surpoids' ELSE 'Obesite' END AS bmi_tag,
  CASE WHEN p < 0.3 THEN 'green' WHEN p < 0.5 THEN 'amber' ELSE 'red' END AS risk_colour,
  CASE WHEN (p - 0.5) > 0.10 THEN 'Overfitting Severe (A regulariser)' WHEN (p - 0.5) > 0.05 THEN 'Overfitting Modere'
       WHEN (p - 0.5) >= 0.0 THEN 'Modele Stable (Excellente Generalisation)'
       ELSE 'Underfitting ou Instabilite matricielle' END AS gap_band,
  CASE WHEN l_discount < 0.01 THEN '*** (p<0.01)' WHEN l_discount < 0.05 THEN '** (p<0.05)' ELSE 'NS' END AS stars,
  COUNT(*) AS n FROM {SV} s GROUP BY 1, 2, 3, 4""")
def drv15(spark, sf):
    df = survey_records(spark, sf).select(
        D.bmi_tag("imcmere").alias("bmi_tag"), D.risk_colour("p").alias("risk_colour"),
        D.gap_verdict(F.col("p") - 0.5).alias("gap_band"), D.significance("l_discount").alias("stars"))
    return df.groupBy("bmi_tag", "risk_colour", "gap_band", "stars").agg(F.count(F.lit(1)).alias("n"))


@query("drv16_age_text", f"""
SELECT ageenfant, CASE WHEN ageenfant // 12 = 0 THEN CAST(ageenfant % 12 AS VARCHAR) || ' mois'
  WHEN ageenfant % 12 = 0 THEN CAST(ageenfant // 12 AS VARCHAR) || ' an' || CASE WHEN ageenfant // 12 > 1 THEN 's' ELSE '' END
  ELSE CAST(ageenfant // 12 AS VARCHAR) || ' an' || CASE WHEN ageenfant // 12 > 1 THEN 's' ELSE '' END
       || ' ' || CAST(ageenfant % 12 AS VARCHAR) || ' mois' END AS age_text, COUNT(*) AS n
FROM {SV} s GROUP BY 1, 2""")
def drv16(spark, sf):
    df = survey_records(spark, sf).withColumn("age_text", X.age_text("ageenfant"))
    return df.groupBy("ageenfant", "age_text").agg(F.count(F.lit(1)).alias("n"))
