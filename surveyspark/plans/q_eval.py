"""Splits, encoders, metrics and evaluation tables bound to the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyspark.functions.lookups import region_dim
from surveyspark.functions import fixed_values as FV
from surveyspark.operators import aggregate as A
from surveyspark.operators import derive as D
from surveyspark.operators import evaluate as EV
from surveyspark.operators import features as FE
from surveyspark.operators import joins as J
from surveyspark.operators import split as SP
from surveyspark.plans.registry import query
from surveyspark.plans.tables import OBS_SQL, ROW_KEY, ROW_KEY_SQL, SURVEY_SQL, observations, read, survey_records

O, SV = OBS_SQL, SURVEY_SQL


def _r(c, d=6):
    return F.round(c, d)


# ---------------------------------------------------------------- split tables (shared)

def split_table(spark, sf):
    """cluster -> stress / test / train (SPL-2 on l_suppkey)."""
    return SP.three_way_split(read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("cluster")), "cluster")


SPLIT_SQL = """(WITH cl AS (SELECT DISTINCT l_suppkey AS cluster FROM lineitem),
s1 AS (SELECT cluster, row_number() OVER (ORDER BY md5('2018:' || CAST(cluster AS VARCHAR))) AS r,
         COUNT(*) OVER () AS g FROM cl),
st AS (SELECT cluster, CASE WHEN r <= ceil(CAST(0.15 AS DOUBLE) * g) THEN 'stress' ELSE 'rest' END AS split FROM s1),
s2 AS (SELECT cluster, row_number() OVER (ORDER BY md5('42:' || CAST(cluster AS VARCHAR))) AS r,
         COUNT(*) OVER () AS g FROM st WHERE split = 'rest')
SELECT cluster, 'stress' AS split FROM st WHERE split = 'stress'
UNION ALL SELECT cluster, CASE WHEN r <= ceil(CAST(0.2 AS DOUBLE) * g) THEN 'test' ELSE 'train' END FROM s2)"""


def scored(spark, sf):
    """Survey records + split; ``p`` is the deterministic score.

    The split table has one row per cluster: it is checkpointed once and
    broadcast when its checked size is within bound (else a shuffle join).
    """
    from surveyspark.functions.exprs import materialize_small
    st = materialize_small(split_table(spark, sf), 5_000_000)
    return J.attach_split(survey_records(spark, sf), st, "cluster")


SCORED_SQL = f"(SELECT s.*, sp.split FROM {SV} s JOIN {SPLIT_SQL} sp USING (cluster))"
B = SCORED_SQL


@query("spl01_group_split", """
WITH cl AS (SELECT DISTINCT l_suppkey AS cluster FROM lineitem),
s AS (SELECT cluster, row_number() OVER (ORDER BY md5('2018:' || CAST(cluster AS VARCHAR))) AS r,
        COUNT(*) OVER () AS g FROM cl)
SELECT cluster, CASE WHEN r <= ceil(CAST(0.2 AS DOUBLE) * g) THEN 'test' ELSE 'train' END AS split FROM s""")
def spl01(spark, sf):
    df = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("cluster"))
    return SP.group_split(df, "cluster", 0.20, 2018)


@query("spl02_three_way_split", f"SELECT * FROM {SPLIT_SQL} x")
def spl02(spark, sf):
    return split_table(spark, sf)


@query("spl03_group_kfold", """
WITH sz AS (SELECT l_suppkey AS cluster, COUNT(*) AS n FROM lineitem GROUP BY 1),
r AS (SELECT cluster, row_number() OVER (ORDER BY n DESC, md5('0:' || CAST(cluster AS VARCHAR))) - 1 AS r0 FROM sz)
SELECT cluster, CAST(CASE WHEN (r0 // 3) % 2 = 0 THEN r0 % 3 ELSE 2 - r0 % 3 END AS INTEGER) AS fold FROM r""")
def spl03(spark, sf):
    df = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("cluster"))
    return SP.group_kfold(df, "cluster", 3, seed=0)


_ROWKEY_SQL = ROW_KEY_SQL


@query("spl04_stratified_kfold", f"""
WITH f AS (SELECT y, w, CAST((row_number() OVER (PARTITION BY y ORDER BY md5('7:' || {_ROWKEY_SQL})) - 1) % 3
  AS INTEGER) AS fold FROM {O} o)
SELECT y, fold, COUNT(*) AS n, ROUND(SUM(w), 4) AS w_sum FROM f GROUP BY 1, 2""")
def spl04(spark, sf):
    f = SP.stratified_kfold(observations(spark, sf), "y", ROW_KEY, 3, seed=7)
    return f.groupBy("y", "fold").agg(F.count(F.lit(1)).alias("n"), _r(F.sum("w"), 4).alias("w_sum"))


@query("spl05_sample_n", """
WITH s AS (SELECT l_returnflag, l_extendedprice, row_number() OVER (PARTITION BY l_returnflag ORDER BY
  md5('42:' || concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR),
    CAST(l_suppkey AS VARCHAR))))
  AS r FROM lineitem)
SELECT l_returnflag, COUNT(*) AS n, ROUND(SUM(l_extendedprice), 2) AS price_sum FROM s WHERE r <= 5000 GROUP BY 1""")
def spl05(spark, sf):
    li = read(spark, sf, "lineitem")
    s = SP.sample_n(li, 5000, 42, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], by=["l_returnflag"])
    return s.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), _r(F.sum("l_extendedprice"), 2).alias("price_sum"))


_LADDER = [0.2, 0.4, 0.6, 0.8, 1.0]


@query("spl06_fraction_ladder", f"""
WITH u AS (SELECT y, CAST(('0x' || substr(md5('3:' || {_ROWKEY_SQL}), 1, 8)) AS BIGINT) / 4294967296.0 AS u FROM {O} o),
s AS (SELECT * FROM (VALUES (0.2), (0.4), (0.6), (0.8), (1.0)) t(size))
SELECT CAST(s.size AS DOUBLE) AS size, COUNT(*) AS n, CAST(SUM(y) AS BIGINT) AS positives
FROM u JOIN s ON u.u < CAST(s.size AS DOUBLE) GROUP BY 1""")
def spl06(spark, sf):
    lad = SP.fraction_ladder(observations(spark, sf), _LADDER, 3, ROW_KEY)
    return lad.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("positives"))


@query("agg06_cluster_counts", f"""
SELECT split, COUNT(*) AS n_rows, COUNT(DISTINCT cluster) AS n_clusters FROM {B} b GROUP BY split""")
def agg06(spark, sf):
    return A.cluster_counts(scored(spark, sf), "split", "cluster")


@query("jn02_attach_split", f"""
SELECT 'in_test' AS part, COUNT(*) AS n FROM {B} b WHERE split = 'test'
UNION ALL SELECT 'not_stress', COUNT(*) FROM {B} b WHERE split <> 'stress'""")
def jn02(spark, sf):
    sv, st = survey_records(spark, sf), split_table(spark, sf)
    a = J.keep_split(sv, st, "cluster", "test").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit("in_test"))
    b = J.drop_split(sv, st, "cluster", "stress").agg(F.count(F.lit(1)).alias("n")).withColumn("part",
                                                                                              F.lit("not_stress"))
    return a.unionByName(b)


@query("jn01_lookup_join", f"""
SELECT COALESCE(r.name, CAST(s.region AS VARCHAR)) AS region_name, COUNT(*) AS n FROM {SV} s
LEFT JOIN (VALUES {', '.join(f"({c}, '{n}')" for c, n, _, _ in FV.REGIONS)}) r(code, name) ON s.region = r.code
GROUP BY 1""")
def jn01(spark, sf):
    dim = region_dim(spark).select(F.col("region_code").alias("region"), "region_name")
    j = J.lookup_join(survey_records(spark, sf), dim, "region", "left", max_rows=None)
    return j.groupBy(F.coalesce("region_name", F.col("region").cast("string")).alias("region_name")).agg(
        F.count(F.lit(1)).alias("n"))


@query("jn04_with_scalars", f"""
WITH m AS (SELECT AVG(p) AS mp FROM {O} o)
SELECT l_returnflag, ROUND(SUM(p - mp), 6) AS centred_sum FROM {O} o, m GROUP BY 1""")
def jn04(spark, sf):
    o = observations(spark, sf)
    j = J.with_scalars(o, o.agg(F.avg("p").alias("mp")))
    return j.groupBy("l_returnflag").agg(_r(F.sum(F.col("p") - F.col("mp"))).alias("centred_sum"))


# ---------------------------------------------------------------- features

_STD_COLS = ["imcmere", "hemoglobinemere"]


@query("fea01_standardise", f"""
WITH p AS (SELECT AVG(imcmere) AS m1, STDDEV_POP(imcmere) AS s1, AVG(hemoglobinemere) AS m2,
             STDDEV_POP(hemoglobinemere) AS s2 FROM {B} b WHERE split = 'train')
SELECT split, ROUND(AVG((imcmere - m1) / s1), 6) AS imcmere_mean, ROUND(STDDEV_POP((imcmere - m1) / s1), 6) AS imcmere_sd,
  ROUND(AVG((hemoglobinemere - m2) / s2), 6) AS hgb_mean FROM {B} b, p GROUP BY split""")
def fea01(spark, sf):
    df = scored(spark, sf)
    params = FE.fit_standardiser(df.where(F.col("split") == "train"), _STD_COLS)
    s = FE.apply_standardiser(df, params, _STD_COLS)
    return s.groupBy("split").agg(_r(F.avg("imcmere")).alias("imcmere_mean"),
                                  _r(F.stddev_pop("imcmere")).alias("imcmere_sd"),
                                  _r(F.avg("hemoglobinemere")).alias("hgb_mean"))


_TE_ROWKEY = ROW_KEY_SQL


@query("fea02_target_encode", f"""
WITH b AS (SELECT split, region, y, CAST((row_number() OVER (PARTITION BY y ORDER BY md5('5:' || {_TE_ROWKEY})) - 1) % 5
             AS INTEGER) AS fold FROM {B} x),
tr AS (SELECT * FROM b WHERE split = 'train'),
gf AS (SELECT fold, COUNT(*) AS gn, SUM(y) AS gs FROM tr GROUP BY 1),
gt AS (SELECT SUM(gn) AS tn, SUM(gs) AS ts FROM gf),
g AS (SELECT fold, (ts - gs) / (tn - gn) AS oym, (ts - gs) / (tn - gn) - ((ts - gs) / (tn - gn)) ^ 2 AS oyv FROM gf, gt),
fu AS (SELECT ts / tn AS fym, ts / tn - (ts / tn) ^ 2 AS fyv FROM gt),
cf AS (SELECT fold, region, COUNT(*) AS cn, SUM(y) AS cs FROM tr GROUP BY 1, 2),
ct AS (SELECT region, SUM(cn) AS tn, SUM(cs) AS ts FROM cf GROUP BY 1),
enc AS (SELECT b.split, CASE WHEN b.split = 'train' THEN b.fold ELSE -1 END AS fold_key, b.region,
  CASE WHEN b.split = 'train' THEN
    CASE WHEN ct.tn - COALESCE(cf.cn, 0) > 0 THEN
      ((ct.tn - COALESCE(cf.cn, 0)) * g.oyv / ((ct.tn - COALESCE(cf.cn, 0)) * g.oyv
        + ((ct.ts - COALESCE(cf.cs, 0)) / (ct.tn - COALESCE(cf.cn, 0)) - ((ct.ts - COALESCE(cf.cs, 0)) / (ct.tn - COALESCE(cf.cn, 0))) ^ 2)))
        * ((ct.ts - COALESCE(cf.cs, 0)) / (ct.tn - COALESCE(cf.cn, 0)))
      + (1 - ((ct.tn - COALESCE(cf.cn, 0)) * g.oyv / ((ct.tn - COALESCE(cf.cn, 0)) * g.oyv
        + ((ct.ts - COALESCE(cf.cs, 0)) / (ct.tn - COALESCE(cf.cn, 0)) - ((ct.ts - COALESCE(cf.cs, 0)) / (ct.tn - COALESCE(cf.cn, 0))) ^ 2)))) * g.oym
    ELSE g.oym END
  ELSE
    CASE WHEN ct.tn > 0 THEN
      (ct.tn * fu.fyv / (ct.tn * fu.fyv + (ct.ts / ct.tn - (ct.ts / ct.tn) ^ 2))) * (ct.ts / ct.tn)
      + (1 - ct.tn * fu.fyv / (ct.tn * fu.fyv + (ct.ts / ct.tn - (ct.ts / ct.tn) ^ 2))) * fu.fym
    ELSE fu.fym END
  END AS enc
  FROM b CROSS JOIN fu LEFT JOIN g ON b.fold = g.fold LEFT JOIN ct ON b.region = ct.region
  LEFT JOIN cf ON b.region = cf.region AND b.fold = cf.fold)
SELECT split, fold_key, region, COUNT(*) AS n, ROUND(MIN(enc), 6) AS enc_min, ROUND(MAX(enc), 6) AS enc_max
FROM enc GROUP BY 1, 2, 3""")
def fea02(spark, sf):
    df = SP.stratified_kfold(scored(spark, sf), "y", ROW_KEY, 5, seed=5)
    e = FE.target_encode(df, ["region"], "y")
    fk = F.when(F.col("split") == "train", F.col("fold")).otherwise(F.lit(-1))
    return e.groupBy("split", fk.alias("fold_key"), "region").agg(
        F.count(F.lit(1)).alias("n"), _r(F.min("region_te")).alias("enc_min"), _r(F.max("region_te")).alias("enc_max"))


_FEA3_CONT, _FEA3_CATS = ["imcmere", "hemoglobinemere", "ageenfant"], ["region", "indicederichesse"]


def _encoded_sql(col: str) -> str:
    """The target encoding of one column: out of fold on the training rows, else from all of them."""
    def blend(n, s, m, v):
        lam = f"({n}) * {v} / (({n}) * {v} + (({s}) / ({n}) - (({s}) / ({n})) ^ 2))"
        return f"{lam} * (({s}) / ({n})) + (1 - {lam}) * {m}"
    return f"""(WITH cf AS (SELECT fold, {col} AS v, COUNT(*) AS cn, SUM(y) AS cs FROM tr GROUP BY 1, 2),
      ct AS (SELECT v, SUM(cn) AS tn, SUM(cs) AS ts FROM cf GROUP BY 1)
      SELECT b.rid, CASE WHEN b.split = 'train' THEN CASE WHEN ct.tn > cf.cn THEN {blend('ct.tn - cf.cn', 'ct.ts - cf.cs', 'g.oym', 'g.oyv')} ELSE g.oym END
        ELSE CASE WHEN ct.tn > 0 THEN {blend('ct.tn', 'ct.ts', 'fu.fym', 'fu.fyv')} ELSE fu.fym END END AS enc
      FROM b CROSS JOIN fu LEFT JOIN g ON b.fold = g.fold LEFT JOIN ct ON b.{col} IS NOT DISTINCT FROM ct.v
      LEFT JOIN cf ON b.{col} IS NOT DISTINCT FROM cf.v AND b.fold = cf.fold)"""


_FEA3_STD = ", ".join(f"ROUND(AVG((b.{c} - m_{c}) / s_{c}), 6) AS {c}_std" for c in _FEA3_CONT)


@query("fea03_column_transformer", f"""
WITH b AS (SELECT *, row_number() OVER (ORDER BY household, l_linenumber, l_partkey, cluster) AS rid,
    CAST((row_number() OVER (PARTITION BY y ORDER BY md5('5:' || {_TE_ROWKEY})) - 1) % 5 AS INTEGER) AS fold FROM {B} x),
tr AS (SELECT * FROM b WHERE split = 'train'),
gf AS (SELECT fold, COUNT(*) AS gn, SUM(y) AS gs FROM tr GROUP BY 1),
gt AS (SELECT SUM(gn) AS tn, SUM(gs) AS ts FROM gf),
g AS (SELECT fold, (ts - gs) / (tn - gn) AS oym, (ts - gs) / (tn - gn) - ((ts - gs) / (tn - gn)) ^ 2 AS oyv FROM gf, gt),
fu AS (SELECT ts / tn AS fym, ts / tn - (ts / tn) ^ 2 AS fyv FROM gt),
p AS (SELECT {', '.join(f'AVG({c}) AS m_{c}, STDDEV_POP({c}) AS s_{c}' for c in _FEA3_CONT)} FROM tr)
SELECT b.split, {_FEA3_STD}, {', '.join(f'ROUND(AVG(e{i}.enc), 6) AS {c}_te' for i, c in enumerate(_FEA3_CATS))}
FROM b CROSS JOIN p {' '.join(f'JOIN {_encoded_sql(c)} e{i} ON b.rid = e{i}.rid' for i, c in enumerate(_FEA3_CATS))} GROUP BY b.split""")
def fea03(spark, sf):
    df = SP.stratified_kfold(scored(spark, sf), "y", ROW_KEY, 5, seed=5)
    out, names = FE.column_transformer(df, _FEA3_CONT, _FEA3_CATS, "y")
    return out.groupBy("split").agg(*[_r(F.avg(c)).alias(c) for c in names])


@query("fea04_balance_weights", f"""
WITH r AS (SELECT SUM(w * y) / SUM(w) AS rate FROM {B} b WHERE split = 'train')
SELECT split, y, ROUND(SUM(CASE WHEN y = 1 THEN w / rate ELSE w / (1.0 - rate) END), 4) AS w_balanced
FROM {B} b, r GROUP BY 1, 2""")
def fea04(spark, sf):
    b = FE.balance_weights(scored(spark, sf), "y", "w", split="split")
    return b.groupBy("split", "y").agg(_r(F.sum("w_balanced"), 4).alias("w_balanced"))


@query("fea05_one_hot", """
SELECT CAST(SUM(CAST(l_returnflag = 'A' AS INTEGER)) AS BIGINT) AS l_returnflag_A,
  CAST(SUM(CAST(l_returnflag = 'N' AS INTEGER)) AS BIGINT) AS l_returnflag_N,
  CAST(SUM(CAST(l_returnflag = 'R' AS INTEGER)) AS BIGINT) AS l_returnflag_R FROM lineitem""")
def fea05(spark, sf):
    li = read(spark, sf, "lineitem").select("l_returnflag")
    oh = FE.one_hot(li, "l_returnflag")
    return oh.agg(*[F.sum(c).cast("long").alias(c) for c in oh.columns if c != "l_returnflag"])


@query("fea06_design_matrix", f"""
SELECT 'Intercept' AS term, ROUND(SUM(1.0), 4) AS total FROM {SV} s
UNION ALL SELECT 'ageenfant', ROUND(SUM(CAST(ageenfant AS DOUBLE)), 4) FROM {SV} s
UNION ALL SELECT 'C(sexeenfant)[T.2]', ROUND(SUM(CAST(sexeenfant = 2 AS DOUBLE)), 4) FROM {SV} s
UNION ALL SELECT 'C(indicederichesse)[T.2]', ROUND(SUM(CAST(indicederichesse = 2 AS DOUBLE)), 4) FROM {SV} s
UNION ALL SELECT 'C(indicederichesse)[T.3]', ROUND(SUM(CAST(indicederichesse = 3 AS DOUBLE)), 4) FROM {SV} s
UNION ALL SELECT 'C(indicederichesse)[T.4]', ROUND(SUM(CAST(indicederichesse = 4 AS DOUBLE)), 4) FROM {SV} s
UNION ALL SELECT 'C(indicederichesse)[T.5]', ROUND(SUM(CAST(indicederichesse = 5 AS DOUBLE)), 4) FROM {SV} s""")
def fea06(spark, sf):
    dm, terms = FE.design_matrix(survey_records(spark, sf), ["ageenfant"], ["sexeenfant", "indicederichesse"])
    long = dm.select(F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"`{t}`").alias("v"))
                                         for t in terms])).alias("s")).select("s.*")
    return long.groupBy("term").agg(_r(F.sum("v"), 4).alias("total"))


# ---------------------------------------------------------------- metrics (EVL, WIN-2)

_SC = f"""(SELECT split, p AS s, SUM(CASE WHEN y = 1 THEN w ELSE 0 END) AS wp,
  SUM(CASE WHEN y = 1 THEN 0 ELSE w END) AS wn FROM {B} b GROUP BY 1, 2)"""

AUC_SQL = f"""WITH c AS (SELECT *, COALESCE(SUM(wn) OVER (PARTITION BY split ORDER BY s
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cwn FROM {_SC} x)
SELECT split, ROUND(SUM(wp * (cwn + wn / 2.0)) / (SUM(wp) * SUM(wn)), 6) AS auc FROM c GROUP BY split"""


@query("evl01_weighted_auc", AUC_SQL)
def evl01(spark, sf):
    a = EV.weighted_auc(scored(spark, sf), "y", "p", "w", ["split"])
    return a.select("split", _r(F.col("auc")).alias("auc"))


_LL = "-(y * ln(GREATEST(LEAST(p, 1 - 1e-15), 1e-15)) + (1 - y) * ln(1 - GREATEST(LEAST(p, 1 - 1e-15), 1e-15)))"


@query("evl02_weighted_log_loss", f"""
SELECT split, ROUND(SUM(w * {_LL}) / SUM(w), 6) AS log_loss FROM {B} b GROUP BY split""")
def evl02(spark, sf):
    ll = EV.weighted_log_loss(scored(spark, sf), "y", "p", "w", ["split"])
    return ll.select("split", _r(F.col("log_loss")).alias("log_loss"))


_CM = f"""(SELECT split, SUM(CASE WHEN y = 1 AND p >= 0.5 THEN w ELSE 0 END) AS tp,
  SUM(CASE WHEN y = 0 AND p >= 0.5 THEN w ELSE 0 END) AS fp, SUM(CASE WHEN y = 1 AND p < 0.5 THEN w ELSE 0 END) AS fn,
  SUM(CASE WHEN y = 0 AND p < 0.5 THEN w ELSE 0 END) AS tn FROM {B} b GROUP BY split)"""


@query("evl03_macro_f1", f"""
SELECT split, ROUND((CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END
  + CASE WHEN 2 * tn + fp + fn > 0 THEN 2 * tn / (2 * tn + fn + fp) ELSE 0 END) / 2.0, 6) AS f1_macro FROM {_CM} c""")
def evl03(spark, sf):
    d = scored(spark, sf).withColumn("yhat", (F.col("p") >= 0.5).cast("int"))
    f = EV.macro_f1(d, "y", "yhat", "w", ["split"])
    return f.select("split", _r(F.col("f1_macro")).alias("f1_macro"))


@query("evl04_accuracy_precision_recall", f"""
SELECT split, ROUND((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy,
  ROUND(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision,
  ROUND(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall FROM {_CM} c""")
def evl04(spark, sf):
    d = scored(spark, sf).withColumn("yhat", (F.col("p") >= 0.5).cast("int"))
    m = EV.accuracy_precision_recall(d, "y", "yhat", "w", ["split"])
    return m.select("split", *[_r(F.col(c)).alias(c) for c in ("accuracy", "precision", "recall")])


@query("evl05_classification_report", f"""
WITH c AS (SELECT * FROM {_CM} x WHERE split = 'test'),
m AS (SELECT tp / (tp + fp) AS p1, tp / (tp + fn) AS r1, tn / (tn + fn) AS p0, tn / (tn + fp) AS r0,
  2 * tp / (2 * tp + fp + fn) AS f1, 2 * tn / (2 * tn + fn + fp) AS f0, tp + fn AS s1, tn + fp AS s0,
  (tp + tn) / (tp + fp + fn + tn) AS acc FROM c),
a AS (SELECT auc FROM ({AUC_SQL}) z WHERE split = 'test'),
l AS (SELECT SUM(w * {_LL}) / SUM(w) AS log_loss FROM {B} b WHERE split = 'test'),
r AS (SELECT '0' AS label, p0 AS precision, r0 AS recall, f0 AS f1, s0 AS support FROM m
  UNION ALL SELECT '1', p1, r1, f1, s1 FROM m
  UNION ALL SELECT 'accuracy', acc, acc, acc, acc FROM m
  UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, s0 + s1 FROM m
  UNION ALL SELECT 'weighted avg', (p0 * s0 + p1 * s1) / (s0 + s1), (r0 * s0 + r1 * s1) / (s0 + s1),
    (f0 * s0 + f1 * s1) / (s0 + s1), s0 + s1 FROM m)
SELECT label, ROUND(precision, 6) AS precision, ROUND(recall, 6) AS recall, ROUND(f1, 6) AS f1,
  ROUND(support, 4) AS support, a.auc, ROUND(l.log_loss, 6) AS log_loss FROM r, a, l""")
def evl05(spark, sf):
    d = scored(spark, sf).where(F.col("split") == "test").withColumn("yhat", (F.col("p") >= 0.5).cast("int"))
    rep = EV.classification_report(d, "y", "yhat", "p", "w")
    return rep.select("label", *[_r(F.col(c)).alias(c) for c in ("precision", "recall", "f1")],
                      _r(F.col("support"), 4).alias("support"), _r(F.col("auc")).alias("auc"),
                      _r(F.col("log_loss")).alias("log_loss"))


@query("evl06_confusion", f"""
WITH c AS (SELECT split, y, CAST(p >= 0.5 AS INTEGER) AS yhat, SUM(w) AS weight FROM {B} b GROUP BY 1, 2, 3)
SELECT split, y, yhat, ROUND(weight, 4) AS weight, ROUND(weight / SUM(weight) OVER (PARTITION BY split, y), 6) AS share
FROM c""")
def evl06(spark, sf):
    d = scored(spark, sf).withColumn("yhat", (F.col("p") >= 0.5).cast("int"))
    c = EV.confusion(d, "y", "yhat", "w", True, ["split"])
    return c.select("split", "y", "yhat", _r(F.col("weight"), 4).alias("weight"), _r(F.col("share")).alias("share"))


_ROC_SQL = f"""WITH c AS (SELECT *, COALESCE(SUM(wn) OVER (PARTITION BY split ORDER BY s ROWS BETWEEN UNBOUNDED
  PRECEDING AND 1 PRECEDING), 0) AS cwn, COALESCE(SUM(wp) OVER (PARTITION BY split ORDER BY s ROWS BETWEEN UNBOUNDED
  PRECEDING AND 1 PRECEDING), 0) AS cwp, SUM(wp) OVER (PARTITION BY split) AS tp, SUM(wn) OVER (PARTITION BY split) AS tn
  FROM {_SC} x)
SELECT split, s AS threshold, ROUND((tn - cwn) / tn, 6) AS fpr, ROUND((tp - cwp) / tp, 6) AS tpr FROM c"""


@query("evl07_roc_points", _ROC_SQL)
def evl07(spark, sf):
    r = EV.roc_points(scored(spark, sf), "y", "p", "w", ["split"])
    return r.select("split", "threshold", _r(F.col("fpr")).alias("fpr"), _r(F.col("tpr")).alias("tpr"))


@query("win02_roc_running", f"""
WITH c AS (SELECT *, COALESCE(SUM(wn) OVER (PARTITION BY split ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  AS cwn, COALESCE(SUM(wp) OVER (PARTITION BY split ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cwp
  FROM {_SC} x)
SELECT split, s AS score, ROUND(cwp, 4) AS cum_wp, ROUND(cwn, 4) AS cum_wn FROM c""")
def win02(spark, sf):
    d = scored(spark, sf)
    st = EV.ordered_prefix(EV.score_table(d, "y", "p", "w", ["split"]), ["split"], "_s", ["wp", "wn"])
    return st.select("split", F.col("_s").alias("score"), _r(F.col("cum_wp"), 4).alias("cum_wp"),
                     _r(F.col("cum_wn"), 4).alias("cum_wn"))


# three "models": the score, and two single-feature scorers, stacked by name (SET-1)
_MODELS = {"linear": "p", "discount": "l_discount * 10.0", "tax": "l_tax * 12.5"}


def model_scores(spark, sf):
    d = scored(spark, sf)
    return A.stack_metrics([d.select("split", "y", "w", F.lit(name).alias("model"), F.expr(e).alias("prob"))
                            for name, e in _MODELS.items()])


_MS_SQL = "(" + " UNION ALL ".join(f"SELECT split, y, w, '{n}' AS model, {e} AS prob FROM {B} b"
                                   for n, e in _MODELS.items()) + ")"
_MSC = f"""(SELECT model, split, prob AS s, SUM(CASE WHEN y = 1 THEN w ELSE 0 END) AS wp,
  SUM(CASE WHEN y = 1 THEN 0 ELSE w END) AS wn FROM {_MS_SQL} m GROUP BY 1, 2, 3)"""
_MAUC = f"""(SELECT model, split, SUM(wp * (cwn + wn / 2.0)) / (SUM(wp) * SUM(wn)) AS auc FROM (SELECT *,
  COALESCE(SUM(wn) OVER (PARTITION BY model, split ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cwn
  FROM {_MSC} x) c GROUP BY 1, 2)"""
_MLL = "-(y * ln(GREATEST(LEAST(prob, 1 - 1e-15), 1e-15)) + (1 - y) * ln(1 - GREATEST(LEAST(prob, 1 - 1e-15), 1e-15)))"
_MCM = f"""(SELECT model, split, SUM(w * {_MLL}) / SUM(w) AS log_loss,
  SUM(CASE WHEN y = 1 AND prob >= 0.5 THEN w ELSE 0 END) AS tp, SUM(CASE WHEN y = 0 AND prob >= 0.5 THEN w ELSE 0 END) AS fp,
  SUM(CASE WHEN y = 1 AND prob < 0.5 THEN w ELSE 0 END) AS fn, SUM(CASE WHEN y = 0 AND prob < 0.5 THEN w ELSE 0 END) AS tn,
  MAX(CASE WHEN y = 1 THEN 1 ELSE 0 END) + MAX(CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END) AS has1,
  MAX(CASE WHEN y = 0 THEN 1 ELSE 0 END) + MAX(CASE WHEN prob < 0.5 THEN 1 ELSE 0 END) AS has0
  FROM {_MS_SQL} m GROUP BY 1, 2)"""
_MF1 = """((CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END) * CAST(has1 > 0 AS INTEGER)
  + (CASE WHEN 2 * tn + fp + fn > 0 THEN 2 * tn / (2 * tn + fn + fp) ELSE 0 END) * CAST(has0 > 0 AS INTEGER))
  / (CAST(has1 > 0 AS INTEGER) + CAST(has0 > 0 AS INTEGER))"""
_MET = f"""(SELECT a.model, a.split, a.auc, c.log_loss, {_MF1} AS f1_macro FROM {_MAUC} a
  JOIN {_MCM} c ON a.model = c.model AND a.split = c.split)"""


@query("set01_stack_metrics", f"""
SELECT model, split, ROUND(auc, 6) AS auc, ROUND(log_loss, 6) AS log_loss, ROUND(f1_macro, 6) AS f1_macro FROM {_MET} m""")
def set01(spark, sf):
    m = EV.metric_table(model_scores(spark, sf), "y", "prob", "w", ["model", "split"])
    return m.select("model", "split", *[_r(F.col(c)).alias(c) for c in ("auc", "log_loss", "f1_macro")])


@query("evl08_gap_table", f"""
WITH m AS (SELECT * FROM {_MET} x),
p AS (SELECT model, MAX(CASE WHEN split = 'train' THEN auc END) AS auc_train, MAX(CASE WHEN split = 'test' THEN auc END) AS auc_test,
  MAX(CASE WHEN split = 'train' THEN log_loss END) AS ll_train, MAX(CASE WHEN split = 'test' THEN log_loss END) AS ll_test,
  MAX(CASE WHEN split = 'train' THEN f1_macro END) AS f1_train, MAX(CASE WHEN split = 'test' THEN f1_macro END) AS f1_test
  FROM m GROUP BY model)
SELECT model, ROUND(auc_train, 6) AS auc_train, ROUND(auc_test, 6) AS auc_test, ROUND(auc_train - auc_test, 6) AS delta_auc,
  ROUND(ll_train, 6) AS log_loss_train, ROUND(ll_test, 6) AS log_loss_test, ROUND(f1_train, 6) AS f1_macro_train,
  ROUND(f1_test, 6) AS f1_macro_test,
  CASE WHEN auc_train - auc_test > 0.10 THEN 'Overfitting Severe (A regulariser)'
       WHEN auc_train - auc_test > 0.05 THEN 'Overfitting Modere'
       WHEN auc_train - auc_test >= 0.0 THEN 'Modele Stable (Excellente Generalisation)'
       ELSE 'Underfitting ou Instabilite matricielle' END AS diagnostic FROM p""")
def evl08(spark, sf):
    g = EV.gap_table(model_scores(spark, sf), "y", "prob", "w")
    return g.select("model", _r(F.col("auc_train")).alias("auc_train"), _r(F.col("auc_test")).alias("auc_test"),
                    _r(F.col("delta_auc")).alias("delta_auc"), _r(F.col("log_loss_train")).alias("log_loss_train"),
                    _r(F.col("log_loss_test")).alias("log_loss_test"),
                    _r(F.col("f1_macro_train")).alias("f1_macro_train"),
                    _r(F.col("f1_macro_test")).alias("f1_macro_test"), "diagnostic")


@query("evl09_partition_table", f"""
WITH m AS (SELECT * FROM {_MET} x WHERE model = 'linear')
SELECT split, ROUND(auc, 6) AS auc, ROUND(log_loss, 6) AS log_loss, ROUND(f1_macro, 6) AS f1_macro,
  ROUND((SELECT auc FROM m WHERE split = 'train') - auc, 6) AS gap_vs_train FROM m""")
def evl09(spark, sf):
    t = EV.partition_table(scored(spark, sf), "y", "p", "w")
    return t.select("split", *[_r(F.col(c)).alias(c) for c in ("auc", "log_loss", "f1_macro", "gap_vs_train")])


@query("top01_best_model", f"""
SELECT model, ROUND(auc, 6) AS auc FROM {_MAUC} a WHERE split = 'test' ORDER BY auc DESC, model ASC LIMIT 1""")
def top01(spark, sf):
    a = EV.weighted_auc(model_scores(spark, sf).where(F.col("split") == "test"), "y", "prob", "w", ["model"])
    return A.best_model(a, "auc", "model").select("model", _r(F.col("auc")).alias("auc"))


_RATES = f"""(SELECT AVG(CAST(y1 AS DOUBLE)) AS r1, AVG(CAST(y2 AS DOUBLE)) AS r2, AVG(CAST(y3 AS DOUBLE)) AS r3
  FROM {B} b WHERE y = 1 AND split = 'train')"""


def marginal_frame(spark, sf):
    d = scored(spark, sf)
    rates = A.conditional_rates(d.where(F.col("split") == "train"), "y", ["y1", "y2", "y3"], ["r1", "r2", "r3"])
    return D.marginalise(d, "p", rates, {"p_stunting": "r1", "p_wasting": "r2", "p_underweight": "r3"}, digits=None)


@query("evl10_subclass_accuracy", f"""
WITH m AS (SELECT y1, y2, y3, w, p * r1 AS p1, p * r2 AS p2, p * r3 AS p3 FROM {B} b, {_RATES} r),
l AS (SELECT 'stunting' AS subclass, p1 AS prob, y1 AS truth, w FROM m UNION ALL SELECT 'wasting', p2, y2, w FROM m
  UNION ALL SELECT 'underweight', p3, y3, w FROM m),
md AS (SELECT subclass, median(prob) AS med FROM l GROUP BY 1),
c AS (SELECT l.subclass, SUM(CASE WHEN truth = 1 AND prob >= med THEN w ELSE 0 END) AS tp,
  SUM(CASE WHEN truth = 0 AND prob >= med THEN w ELSE 0 END) AS fp, SUM(CASE WHEN truth = 1 AND prob < med THEN w ELSE 0 END) AS fn,
  SUM(CASE WHEN truth = 0 AND prob < med THEN w ELSE 0 END) AS tn FROM l JOIN md USING (subclass) GROUP BY 1)
SELECT subclass, ROUND((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy,
  ROUND(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision,
  ROUND(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall FROM c""")
def evl10(spark, sf):
    m = marginal_frame(spark, sf)
    acc = EV.subclass_accuracy(m, {"stunting": ("p_stunting", "y1"), "wasting": ("p_wasting", "y2"),
                                   "underweight": ("p_underweight", "y3")}, "w")
    return acc.select("subclass", *[_r(F.col(c)).alias(c) for c in ("accuracy", "precision", "recall")])


def _importance_sql(features=("l_discount", "l_tax"), repeats=10, seed=2018) -> str:
    """EVL-11: rows and donors paired by the ranks of two seeded hashes in each repeat."""
    rank = ("row_number() OVER (PARTITION BY repeat ORDER BY md5('{0}:{1}:' || concat_ws(':', CAST(repeat AS VARCHAR), {2})))")
    mixed = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, o.repeat, o.y, round(0.6 * {'d' if f == 'l_discount' else 'o'}.l_discount / 0.10 + "
        f"0.4 * {'d' if f == 'l_tax' else 'o'}.l_tax / 0.08, 6) AS s FROM own o JOIN donor d ON o.repeat = d.repeat AND o.r = d.r" for f in features)
    return f"""
WITH t AS (SELECT * FROM {B} b WHERE split = 'test'),
e AS (SELECT *, unnest(generate_series(0, {repeats - 1})) AS repeat FROM t),
own AS (SELECT *, {rank.format(seed, 'own', _TE_ROWKEY)} AS r FROM e),
donor AS (SELECT *, {rank.format(seed, 'donor', _TE_ROWKEY)} AS r FROM e),
m AS ({mixed} UNION ALL SELECT '', 0, y, p FROM t),
g AS (SELECT feature, repeat, s, SUM(y) AS wp, SUM(1 - y) AS wn FROM m GROUP BY 1, 2, 3),
c AS (SELECT *, COALESCE(SUM(wn) OVER (PARTITION BY feature, repeat ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cwn FROM g),
a AS (SELECT feature, repeat, SUM(wp * (cwn + wn / 2.0)) / (SUM(wp) * SUM(wn)) AS auc FROM c GROUP BY 1, 2),
z AS (SELECT auc AS base FROM a WHERE feature = '')
SELECT feature, ROUND(AVG(base - auc), 6) AS importance_mean, ROUND(STDDEV_POP(base - auc), 6) AS importance_sd
FROM a, z WHERE feature <> '' GROUP BY feature"""


@query("evl11_permutation_importance", _importance_sql())
def evl11(spark, sf):
    """Permutation importance of the linear scorer's two inputs on the test partition (10 repeats)."""
    test = scored(spark, sf).where(F.col("split") == "test").select(
        *ROW_KEY, "l_discount", "l_tax", "y")

    def score_fn(d):
        return F.round(F.lit(0.6) * d["l_discount"] / F.lit(0.10) + F.lit(0.4) * d["l_tax"] / F.lit(0.08), 6)

    imp = EV.permutation_importance(test, ["l_discount", "l_tax"], score_fn, "y",
                                    ROW_KEY, repeats=10, seed=2018)
    return imp.select("feature", _r(F.col("importance_mean")).alias("importance_mean"),
                      _r(F.col("importance_sd")).alias("importance_sd"))


@query("top06_top_subclasses", f"""
WITH m AS (SELECT p * r1 AS a, p * r2 AS b, p * r3 AS c FROM {B} b, {_RATES} r)
SELECT list_aggregate(list_transform(list_slice(list_sort([{{'v': -a, 'o': 0, 'n': 'stunting'}},
  {{'v': -b, 'o': 1, 'n': 'wasting'}}, {{'v': -c, 'o': 2, 'n': 'underweight'}}]), 1, 3), lambda x: x.n), 'string_agg', ',')
  AS top_subclasses, COUNT(*) AS n FROM m GROUP BY 1""")
def top06(spark, sf):
    m = marginal_frame(spark, sf)
    top = A.top_in_row(["stunting", "wasting", "underweight"], ["p_stunting", "p_wasting", "p_underweight"], 3)
    return m.groupBy(F.array_join(F.transform(top, lambda x: x["name"]), ",").alias("top_subclasses")).agg(
        F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- document-level target

def labelled_documents(spark, sf):
    """documents joined to their labels: quality is the target, text length the score."""
    docs = read(spark, sf, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("score"))
    labs = read(spark, sf, "labels").select("doc_id", F.col("quality").cast("int").alias("y"),
                                            F.col("toxic").cast("int").alias("toxic"))
    return docs.join(labs, "doc_id")


@query("evl01b_document_auc", """
WITH d AS (SELECT d.lang, CAST(d.n_chars AS DOUBLE) AS s, CAST(l.quality AS INTEGER) AS y
           FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
sc AS (SELECT lang, s, SUM(CASE WHEN y = 1 THEN 1.0 ELSE 0 END) AS wp, SUM(CASE WHEN y = 1 THEN 0 ELSE 1.0 END) AS wn
       FROM d GROUP BY 1, 2),
c AS (SELECT *, COALESCE(SUM(wn) OVER (PARTITION BY lang ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
        AS cwn FROM sc)
SELECT lang, ROUND(SUM(wp * (cwn + wn / 2.0)) / NULLIF(SUM(wp) * SUM(wn), 0), 6) AS auc FROM c GROUP BY lang""")
def evl01b(spark, sf):
    """EVL-1 on the document-level binding: AUC of text length for the quality label, per language."""
    a = EV.weighted_auc(labelled_documents(spark, sf), "y", "score", None, ["lang"])
    return a.select("lang", _r(F.col("auc")).alias("auc"))


@query("agg09b_document_conditional_rates", """
SELECT lang, COUNT(*) AS n, ROUND(AVG(CAST(l.toxic AS DOUBLE)), 6) AS p_toxic_given_quality
FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 1 GROUP BY lang""")
def agg09b(spark, sf):
    """AGG-9 on the document-level binding: P(toxic | quality) per language."""
    d = labelled_documents(spark, sf).where(F.col("y") == 1)
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"),
                                 _r(F.avg(F.col("toxic").cast("double"))).alias("p_toxic_given_quality"))
