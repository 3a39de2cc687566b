"""Sources, sinks and streams bound to the test tables.

Sinks write under the cluster's checkpoint folder and are read back, so each
check verifies the round trip against the source table.
"""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from surveyspark.operators import score as SC
from surveyspark.operators import schema_ops as PRJ
from surveyspark.plans.q_score import FEATURES, SCORER, _BATCH_SQL
from surveyspark.plans.registry import query
from surveyspark.plans.tables import SURVEY_COLUMNS, SURVEY_SQL, read, survey_from_lineitem, survey_records
from surveyspark.sources import readers as R
from surveyspark.sources import sinks as K
from surveyspark.streaming import scoring as ST
from surveyspark.streaming.evolution import score_evolution

SV = SURVEY_SQL


def _r(c, d=6):
    return F.round(c, d)


def _path(sf, name):
    return os.path.join(sf, f"{name}.parquet")


_LI_SCHEMA = ("l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
              "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING")


@query("src01_load_table", """
SELECT l_returnflag, COUNT(*) AS n, ROUND(SUM(l_extendedprice), 2) AS revenue FROM lineitem GROUP BY 1""")
def src01(spark, sf):
    df = R.load_table(spark, _path(sf, "lineitem"), _LI_SCHEMA, columns=["l_returnflag", "l_extendedprice"])
    return df.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), _r(F.sum("l_extendedprice"), 2).alias("revenue"))


@query("src02_load_raw", """
SELECT CAST(l_linenumber AS DOUBLE) AS l_linenumber, ROUND(SUM(CAST(l_quantity AS DOUBLE)), 2) AS qty,
  ROUND(SUM(CAST(l_tax AS DOUBLE)), 4) AS tax FROM lineitem GROUP BY 1""")
def src02(spark, sf):
    df = R.load_raw(spark, _path(sf, "lineitem"), ["l_linenumber", "l_quantity", "l_tax"])
    return df.groupBy("l_linenumber").agg(_r(F.sum("l_quantity"), 2).alias("qty"), _r(F.sum("l_tax"), 4).alias("tax"))


_CSV_COLS = ["household", "cluster", "region", "ageenfant", "imcmere", "hemoglobinemere", "milieuderesidence"]


@query("src03_read_batch", f"""
SELECT region, COUNT(*) AS n, CAST(SUM(ageenfant) AS BIGINT) AS age_sum, ROUND(SUM(imcmere), 2) AS bmi_sum
FROM {SV} s GROUP BY region""")
def src03(spark, sf):
    """SRC-3 (+ SNK-1 CSV): the records are written as a CSV batch, then read back with a typed schema."""
    path = K.output_path(spark, f"csv_batch_{os.path.basename(sf.rstrip('/'))}")
    K.write_table(survey_records(spark, sf).select(*_CSV_COLS), path, "csv")
    schema = ("household BIGINT, cluster BIGINT, region INT, ageenfant INT, imcmere DOUBLE, "
              "hemoglobinemere DOUBLE, milieuderesidence INT")
    df = R.read_batch(spark, path, schema)
    ok = df.where(F.col("_corrupt_record").isNull())
    return ok.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.sum("ageenfant").cast("long").alias("age_sum"),
                                    _r(F.sum("imcmere"), 2).alias("bmi_sum"))


@query("src04_read_json_records", """
SELECT event_type, COUNT(*) AS n, CAST(SUM(CAST(json_extract(props, '$.k') AS INTEGER)) AS BIGINT) AS k_sum
FROM events GROUP BY 1""")
def src04(spark, sf):
    ev = read(spark, sf, "events").select("event_type", "props")
    df = R.read_json_records(ev, "props", "k INT")
    return df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").cast("long").alias("k_sum"))


@query("snk01_write_table", """
SELECT o_orderpriority, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM orders GROUP BY 1""")
def snk01(spark, sf):
    path = K.output_path(spark, f"orders_table_{os.path.basename(sf.rstrip('/'))}")
    K.write_table(read(spark, sf, "orders").select("o_orderpriority", "o_totalprice"), path, "parquet",
                  partition_by=["o_orderpriority"])
    back = spark.read.parquet(path)
    return back.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), _r(F.sum("o_totalprice"), 2).alias("total"))


@query("snk02_write_dataset", f"""
SELECT COUNT(*) AS n_rows, CAST({len(SURVEY_COLUMNS)} AS BIGINT) AS n_variables FROM lineitem""")
def snk02(spark, sf):
    from surveyspark.functions.fixed_values import LABELS
    df = survey_records(spark, sf)
    cats = {k: ", ".join(f"{c}={lab}" for c, lab in v.items()) for k, v in LABELS.items()}
    meta = PRJ.build_dictionary(spark, df, {"household": "numeromenage", "cluster": "numerogruppe"},
                                ["ageenfant", "imcmere"], ["household", "cluster"], cats)
    paths = K.write_dataset(df, meta, K.output_path(spark, f"dataset_{os.path.basename(sf.rstrip('/'))}"))
    d, m = spark.read.parquet(paths["data"]), spark.read.parquet(paths["dictionary"])
    from surveyspark.operators.joins import with_scalars
    return with_scalars(d.agg(F.count(F.lit(1)).alias("n_rows")), m.agg(F.count(F.lit(1)).alias("n_variables")))


@query("snk07_write_scored", f"""
SELECT region, COUNT(*) AS n, ROUND(SUM({SC.PROB}), 4) AS prob_sum FROM {_BATCH_SQL} b GROUP BY region""")
def snk07(spark, sf):
    sv = survey_records(spark, sf)
    b = SC.score_batch(sv, SCORER, SC.rates_frame(sv, "y", ["y1", "y2", "y3"]), FEATURES, keep=["region"])
    path = K.write_scored(b, K.output_path(spark, f"scored_{os.path.basename(sf.rstrip('/'))}"))
    back = spark.read.parquet(path)
    return back.groupBy("region").agg(F.count(F.lit(1)).alias("n"), _r(F.sum(SC.PROB), 4).alias("prob_sum"))


@query("str01_score_stream", f"""
SELECT region, COUNT(*) AS n, ROUND(SUM({SC.PROB}), 4) AS prob_sum, CAST(SUM({SC.CLASS}) AS BIGINT) AS alerts
FROM {_BATCH_SQL} b GROUP BY region""")
def str01(spark, sf):
    """STR-1: lineitem arrives as a file stream; each micro-batch is scored by SCR-2 into a parquet sink."""
    sv_static = survey_records(spark, sf)
    rates = SC.rates_frame(sv_static, "y", ["y1", "y2", "y3"])
    li = read(spark, sf, "lineitem")
    stream = ST.read_stream(spark, _path(sf, "lineitem"), li.schema)
    scored = ST.score_stream(stream, lambda d: SC.score_batch(survey_from_lineitem(d), SCORER, rates, FEATURES,
                                                               keep=["region"]))
    sink, ck = ST.stream_paths(spark, "score")
    ST.run_to_sink(scored, sink, ck)
    back = spark.read.parquet(sink)
    return back.groupBy("region").agg(F.count(F.lit(1)).alias("n"), _r(F.sum(SC.PROB), 4).alias("prob_sum"),
                                      F.sum(SC.CLASS).cast("long").alias("alerts"))


@query("str02_history_kpis", """
WITH e AS (SELECT CAST(ts AS TIMESTAMP) AS t, user_id, CAST(event_type = 'error' AS INTEGER) AS y, value / 500.0 AS s
           FROM events),
g AS (SELECT date_trunc('day', t) AS ws, user_id, COUNT(*) AS total, CAST(SUM(y) AS BIGINT) AS alerts,
        AVG(CAST(y AS DOUBLE)) AS alert_rate, AVG(s) AS mean_score FROM e GROUP BY 1, 2)
SELECT strftime(ws, '%Y-%m-%d %H:%M') AS window_start, user_id, total, alerts, ROUND(alert_rate, 6) AS alert_rate,
  ROUND(mean_score, 6) AS mean_score FROM g""")
def str02(spark, sf):
    """STR-2: events as a stream, 1-day tumbling windows per user, 1-hour watermark; every event is in a window."""
    ev = read(spark, sf, "events")
    stream = ST.read_stream(spark, _path(sf, "events"), ev.schema)
    s = stream.withColumn("y", (F.col("event_type") == "error").cast("int")).withColumn("s", F.col("value") / 500.0)
    k = ST.history_kpis(s, "ts", "user_id", "y", "s", "1 day", "1 hour")
    sink, ck = ST.stream_paths(spark, "history")
    ST.run_updates_to_sink(k, sink, ck)
    back = ST.latest_updates(spark, sink, ["window_start", "user_id"])
    return back.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "user_id", "total",
                       "alerts", _r(F.col("alert_rate")).alias("alert_rate"), _r(F.col("mean_score")).alias("mean_score"))


@query("str02b_score_evolution", """
WITH e AS (SELECT event_id, CAST(ts AS TIMESTAMP) AS t, user_id, CAST(event_type = 'error' AS INTEGER) AS y, value / 500.0 AS s
           FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
r AS (SELECT *, row_number() OVER w AS n, SUM(y) OVER w AS alerts, AVG(s) OVER w AS mean_score FROM e
      WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT user_id, n, y AS alert, ROUND(s, 6) AS score, CAST(alerts AS BIGINT) AS alerts, ROUND(mean_score, 6) AS mean_score FROM r
WHERE epoch_ms(t) + 1 <= (SELECT MAX(epoch_ms(t)) FROM e) - 3600000""")
def str02b(spark, sf):
    """STR-2: the score series of each user over the event stream, up to the watermark (an hour before the last event)."""
    ev = read(spark, sf, "events")
    stream = ST.read_stream(spark, _path(sf, "events"), ev.schema)
    s = stream.withColumn("y", (F.col("event_type") == "error").cast("int")).withColumn("s", F.col("value") / 500.0)
    sink, ck = ST.stream_paths(spark, "evolution")
    ST.run_to_sink(score_evolution(s, "ts", "user_id", "y", "s", "event_id", "1 hour", "3650 days"), sink, ck)
    back = spark.read.parquet(sink)
    return back.select("user_id", "n", "alert", _r(F.col("score")).alias("score"), "alerts", _r(F.col("mean_score")).alias("mean_score"))
