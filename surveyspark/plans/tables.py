"""Binding of the survey roles to the driver's test tables.

observation = one ``lineitem`` row; cluster = ``l_suppkey``; household =
``l_orderkey``; weight = ``l_quantity``; three sub-class indicators and their
composite come from discount, tax and quantity; a deterministic score in
[0, 1] stands in for a model probability.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyspark.functions import exprs as X

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


# Deterministic score: no exp/log so that both engines agree to the last bit.
SCORE_SQL = "round(0.6 * l_discount / 0.10 + 0.4 * l_tax / 0.08, 6)"


def score_expr():
    return F.round(F.lit(0.6) * F.col("l_discount") / F.lit(0.10)
                   + F.lit(0.4) * F.col("l_tax") / F.lit(0.08), 6)


def observations(spark: SparkSession, sf_dir: str, extra=()) -> DataFrame:
    """Survey-shaped rows from lineitem (columns pruned at the scan)."""
    li = read(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("household"),
        F.col("l_suppkey").alias("cluster"),
        "l_linenumber", "l_partkey",
        F.col("l_quantity").alias("w"),
        "l_discount", "l_tax", "l_extendedprice", "l_returnflag", *extra,
        (F.col("l_discount") >= 0.08).cast("int").alias("y1"),
        (F.col("l_tax") >= 0.07).cast("int").alias("y2"),
        (F.col("l_quantity") <= 5).cast("int").alias("y3"),
        score_expr().alias("p"),
    ).withColumn("y", X.any_of(["y1", "y2", "y3"]))


# SQL twin of ``observations`` for the DuckDB oracle.
OBS_SQL = f"""(SELECT l_orderkey AS household, l_suppkey AS cluster, l_linenumber, l_partkey,
  l_quantity AS w, l_discount, l_tax, l_extendedprice, l_returnflag,
  CAST(l_discount >= 0.08 AS INTEGER) AS y1, CAST(l_tax >= 0.07 AS INTEGER) AS y2,
  CAST(l_quantity <= 5 AS INTEGER) AS y3, {SCORE_SQL} AS p,
  CAST((l_discount >= 0.08) OR (l_tax >= 0.07) OR (l_quantity <= 5) AS INTEGER) AS y
  FROM lineitem)"""


def supplier_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cluster -> region name via supplier -> nation -> region (dimension chain)."""
    sup = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cluster"), "s_nationkey")
    nat = X.bounded_broadcast(read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), 10_000)
    reg = X.bounded_broadcast(read(spark, sf_dir, "region").select("r_regionkey", "r_name"), 10_000)
    dims = (sup.join(nat, sup.s_nationkey == nat.n_nationkey)
            .join(reg, F.col("n_regionkey") == F.col("r_regionkey"))
            .select("cluster", F.col("s_nationkey").alias("region_code"),
                    F.col("n_name").alias("region_name"), "r_name"))
    # one row per supplier: broadcast to the fact side only within a checked bound
    return X.bounded_broadcast(dims, 2_000_000)


# --- survey-shaped scoring records derived from lineitem ----------------------
# Each survey field is a deterministic function of real lineitem columns, so the
# record set grows with the table. (element lists = the survey's code sets)
_WATER = [11, 12, 13, 21, 41, 43, 61]
_TOILET = [11, 12, 21, 22, 31]
_FUEL = [1, 2, 7, 8, 95]

SURVEY_FIELDS_SQL = {
    "ageenfant": "CAST(l_quantity AS INTEGER) + 9",
    "sexeenfant": "CAST(1 + l_linenumber % 2 AS INTEGER)",
    "milieuderesidence": "CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END",
    "indicederichesse": "CAST(1 + CAST(round(l_discount * 100) AS INTEGER) % 5 AS INTEGER)",
    "niveauinstructionmere": "CAST(CAST(round(l_tax * 100) AS INTEGER) % 4 AS INTEGER)",
    "rangdenaissance": "l_linenumber",
    "hemoglobinemere": "round(8.0 + l_extendedprice / 15000.0, 1)",
    "intervalleintergenesique": "CAST(l_partkey % 48 AS INTEGER)",
    "dureeallaitement": "CAST(l_orderkey % 30 AS INTEGER)",
    "nombreenfantsnesvivants": "CAST(1 + l_suppkey % 8 AS INTEGER)",
    "nombrevisitesprenatales": "CAST(l_partkey % 9 AS INTEGER)",
    "nombremembresmenage": "CAST(l_suppkey % 6 AS INTEGER)",
    "imcmere": "round(15.0 + l_extendedprice / 4000.0, 1)",
    "region": "CAST(1 + l_suppkey % 12 AS INTEGER)",
    "vaccine_status": "CAST(l_orderkey % 2 AS INTEGER)",
    "vaccinbcg": "CAST(l_partkey % 2 AS INTEGER)",
    "diarrhee": "CAST(l_linenumber % 3 AS INTEGER)",
    "prisededecisionmere": "CAST(1 + l_orderkey % 4 AS INTEGER)",
    "statutmatrimonialmere": "CAST(l_partkey % 6 AS INTEGER)",
    "tailleanaissance": "CAST(1 + l_suppkey % 5 AS INTEGER)",
    "sourceeaupotable": f"CAST(element_at(array({', '.join(map(str, _WATER))}), CAST(l_partkey % 7 AS INTEGER) + 1) AS INTEGER)",
    "typeinstallationssanitaires": f"CAST(element_at(array({', '.join(map(str, _TOILET))}), CAST(l_orderkey % 5 AS INTEGER) + 1) AS INTEGER)",
    "typecombustiblecuisine": f"CAST(element_at(array({', '.join(map(str, _FUEL))}), CAST(l_suppkey % 5 AS INTEGER) + 1) AS INTEGER)",
    "lieuderesidence": "CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END",
    "regionecologique": "CAST(1 + l_partkey % 4 AS INTEGER)",
    "vaccinpolio0": "CAST(l_orderkey % 3 AS INTEGER) % 2",
    "vaccinpolio1": "CAST(l_partkey % 3 AS INTEGER) % 2",
    "vaccinpolio2": "CAST(l_suppkey % 3 AS INTEGER) % 2",
    "vaccinpolio3": "CAST(l_orderkey % 5 AS INTEGER) % 2",
    "vaccindtp1": "CAST(l_partkey % 5 AS INTEGER) % 2",
    "vaccindtp2": "CAST(l_suppkey % 7 AS INTEGER) % 2",
    "vaccindtp3": "CAST(l_orderkey % 7 AS INTEGER) % 2",
    "vaccinrougeole1": "CAST(l_partkey % 11 AS INTEGER) % 2",
    "agemere": "CAST(15 + l_partkey % 35 AS INTEGER)",
}

SURVEY_FIELDS = list(SURVEY_FIELDS_SQL)
SURVEY_COLUMNS = ["household", "cluster", "l_linenumber", "l_partkey", "w", "l_discount", "l_tax", "y1", "y2", "y3", "y", "p", *SURVEY_FIELDS]


def _duck(expr: str) -> str:
    """Spark SQL -> DuckDB for the few functions that differ in name."""
    import re
    return re.sub(r"element_at\(array\(([^)]*)\), ([^)]*\)) \+ 1\)", r"[\1][\2 + 1]", expr)


ROW_KEY = ["household", "l_linenumber", "l_partkey", "cluster"]   # unique per lineitem row
ROW_KEY_SQL = "concat_ws('|', CAST(household AS VARCHAR), CAST(l_linenumber AS VARCHAR), " \
    "CAST(l_partkey AS VARCHAR), CAST(cluster AS VARCHAR))"


def survey_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survey-shaped records (34 scoring fields + roles) from lineitem."""
    return survey_from_lineitem(read(spark, sf_dir, "lineitem"))


def survey_from_lineitem(li: DataFrame) -> DataFrame:
    """The survey projection of a lineitem frame (batch or stream)."""
    return li.selectExpr(
        "l_orderkey AS household", "l_suppkey AS cluster", "l_linenumber", "l_partkey", "l_quantity AS w",
        "l_discount", "l_tax",
        "CAST(l_discount >= 0.08 AS INT) AS y1", "CAST(l_tax >= 0.07 AS INT) AS y2",
        "CAST(l_quantity <= 5 AS INT) AS y3",
        "CAST((l_discount >= 0.08) OR (l_tax >= 0.07) OR (l_quantity <= 5) AS INT) AS y",
        f"{SCORE_SQL} AS p",
        *[f"{e} AS {k}" for k, e in SURVEY_FIELDS_SQL.items()])


# --- the raw coded survey: the columns and non-response codes of the micro-data -----
RAW_SURVEY = {
    "v001": "l_suppkey", "v002": "l_orderkey", "v005": "l_quantity * 1000000.0",
    "hw13": "CASE WHEN l_linenumber = 6 THEN 1 ELSE 0 END",
    "hw5": "CASE WHEN l_partkey % 41 = 0 THEN 9998 WHEN l_partkey % 43 = 0 THEN NULL ELSE l_partkey % 1300 - 650 END",
    "hw8": "CASE WHEN l_suppkey % 31 = 0 THEN 9999 ELSE l_suppkey % 900 - 450 END", "hw11": "l_orderkey % 1000 - 500",
    "v445": "CASE WHEN l_partkey % 53 = 0 THEN 9998.0 WHEN l_partkey % 47 = 0 THEN NULL ELSE 1500.0 + l_partkey % 2000 END",
    "v438": "CASE WHEN l_orderkey % 59 = 0 THEN 999.0 ELSE 70.0 + l_partkey % 90 END",
    "hw1": "CASE WHEN l_orderkey % 61 = 0 THEN 98.0 ELSE l_quantity + 9 END",
    "v012": "CASE WHEN l_suppkey % 37 = 0 THEN 99 ELSE 15 + l_partkey % 35 END", "v136": "l_suppkey % 7",
    "b11": "CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_partkey % 60 END",
    "m14": "CASE WHEN l_partkey % 19 = 0 THEN 98 ELSE l_partkey % 9 END", "m34": "l_orderkey % 100", "bord": "l_linenumber",
    "v201": "1 + l_suppkey % 8", "v008": "1400 + l_partkey % 12",
    "b4": "CASE WHEN l_partkey % 71 = 0 THEN 9 ELSE 1 + l_linenumber % 2 END",
    "v025": "CASE WHEN l_returnflag = 'R' THEN 2 WHEN l_returnflag = 'A' THEN 1 ELSE NULL END",
    "v106": "CASE WHEN l_partkey % 23 = 0 THEN 8 ELSE l_partkey % 4 END", "v190": "1 + l_orderkey % 5",
    "v024": "CASE WHEN l_partkey % 67 = 0 THEN 99 ELSE 1 + l_suppkey % 12 END",
    "m18": "CASE WHEN l_partkey % 29 = 0 THEN 8 ELSE 1 + l_orderkey % 5 END", "m15": "l_partkey % 10",
    "h1": "l_orderkey % 4", "h2": "l_partkey % 10", "h3": "l_orderkey % 10", "h4": "l_suppkey % 10", "h5": "l_partkey % 4",
    "h6": "l_orderkey % 9", "h7": "l_suppkey % 4", "h8": "l_partkey % 9", "h9": "CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_partkey % 4 END",
    "h10": "l_orderkey % 2", "h11": "CASE WHEN l_partkey % 17 = 0 THEN 8 ELSE l_linenumber % 3 END",
    "v743a": "CASE WHEN l_suppkey % 13 = 0 THEN 9 ELSE 1 + l_orderkey % 5 END", "v501": "l_partkey % 7",
    "v113": "CASE WHEN l_partkey % 83 = 0 THEN 97 ELSE 11 + l_partkey % 3 END",
    "v116": "CASE WHEN l_partkey % 89 = 0 THEN 98 ELSE 11 + l_orderkey % 4 END",
    "v161": "CASE WHEN l_orderkey % 97 = 0 THEN 99 ELSE 1 + l_suppkey % 8 END",
    "v102": "CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END", "v101": "1 + l_suppkey % 10",
}
RAW_SURVEY_SQL = "(SELECT " + ", ".join(f"{e} AS {k}" for k, e in RAW_SURVEY.items()) + " FROM lineitem)"


def raw_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coded micro-data as it comes, from lineitem."""
    return read(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS {k}" for k, e in RAW_SURVEY.items()])


SURVEY_SQL = "(SELECT l_orderkey AS household, l_suppkey AS cluster, l_linenumber, l_partkey, l_quantity AS w, " \
    "l_discount, l_tax, " \
    "CAST(l_discount >= 0.08 AS INTEGER) AS y1, CAST(l_tax >= 0.07 AS INTEGER) AS y2, " \
    "CAST(l_quantity <= 5 AS INTEGER) AS y3, " \
    "CAST((l_discount >= 0.08) OR (l_tax >= 0.07) OR (l_quantity <= 5) AS INTEGER) AS y, " \
    f"{SCORE_SQL} AS p, " + ", ".join(f"{_duck(e)} AS {k}" for k, e in SURVEY_FIELDS_SQL.items()) + \
    " FROM lineitem)"
