"""Sources (SRC-*): typed scans of survey tables, record batches and JSON payloads."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
               fmt: str = "parquet", columns: Sequence[str] | None = None) -> DataFrame:
    """SRC-1: scan a cleaned table with a declared schema; columns pruned at the scan.

    Columns bind by name in every format; a CSV column outside ``schema`` is left out and one that the
    files lack is null.
    """
    if fmt == "csv" and schema is not None:
        df = read_batch(spark, path, schema)
        df = df.drop("_corrupt_record")
    else:
        r = spark.read.format(fmt)
        if schema is not None:
            r = r.schema(schema)
        if fmt == "csv":
            r = r.option("header", True)
        df = r.load(path)
    return df.select(*columns) if columns else df


def load_raw(spark: SparkSession, path: str, codes: Sequence[str] | None = None, fmt: str = "parquet") -> DataFrame:
    """SRC-2: raw coded survey, codes kept numeric (every listed code column cast to double)."""
    df = spark.read.format(fmt).load(path)
    cols = [c for c in (codes or df.columns) if c in df.columns]
    return df.select(*[F.col(c).cast("double").alias(c) for c in cols])


def read_batch(spark: SparkSession, path: str, schema: T.StructType | str,
               corrupt: str = "_corrupt_record") -> DataFrame:
    """SRC-3: CSV batch of records to score; PERMISSIVE mode keeps malformed lines in ``corrupt``.

    Columns bind by their header name, in any order; columns outside ``schema``
    are left out and columns that the files lack are null. Files of one batch
    share a header: a file with another one raises.
    """
    st = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    header = spark.read.option("header", True).csv(path).columns
    known = {f.name: f.dataType for f in st.fields}
    in_file = T.StructType([T.StructField(c, known.get(c, T.StringType()), True) for c in header]
                           + [T.StructField(corrupt, T.StringType(), True)])
    df = (spark.read.option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", False)
          .option("columnNameOfCorruptRecord", corrupt).schema(in_file).csv(path))
    return df.select(*[F.col(f"`{f.name}`") if f.name in header else F.lit(None).cast(f.dataType).alias(f.name)
                       for f in st.fields], corrupt)


def read_json_records(df_or_spark, source, schema: T.StructType | str, col: str | None = None) -> DataFrame:
    """SRC-4: JSON records -> typed table.

    ``read_json_records(spark, path, schema)`` reads JSON lines files;
    ``read_json_records(df, "props", schema)`` parses a JSON string column.
    """
    if isinstance(df_or_spark, SparkSession):
        return df_or_spark.read.schema(schema).json(source)
    df = df_or_spark
    parsed = F.from_json(F.col(source), schema)
    return df.select("*", parsed.alias(col or "_json")).select("*", f"{col or '_json'}.*").drop(col or "_json")
