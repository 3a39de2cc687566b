"""Small dimension frames built from the fixed values (size fixed by construction)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyspark.functions import fixed_values as FV

LOOKUP_SCHEMA = T.StructType([
    T.StructField("variable", T.StringType(), False),
    T.StructField("code", T.IntegerType(), False),
    T.StructField("label", T.StringType(), False),
])


def label_lookup(spark: SparkSession, labels: dict | None = None) -> DataFrame:
    """Long lookup table (variable, code, label); broadcast-safe (fixed size)."""
    labels = FV.LABELS if labels is None else labels
    rows = [(v, int(k), lab) for v, m in labels.items() for k, lab in m.items()]
    return F.broadcast(spark.createDataFrame(rows, LOOKUP_SCHEMA))


def region_dim(spark: SparkSession) -> DataFrame:
    """Region code -> name, latitude, longitude (12 rows)."""
    schema = "region_code INT, region_name STRING, lat DOUBLE, lon DOUBLE"
    return F.broadcast(spark.createDataFrame(FV.REGIONS, schema))


def lookup_from_pairs(spark: SparkSession, pairs, key_type: str = "INT", value_type: str = "STRING",
                      key: str = "code", value: str = "label") -> DataFrame:
    """A two-column lookup from literal pairs (fixed size, broadcast)."""
    return F.broadcast(spark.createDataFrame(list(pairs), f"{key} {key_type}, {value} {value_type}"))
