"""Projections and schema operators (PRJ-*)."""

from __future__ import annotations

from typing import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def select_available(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """PRJ-1: keep the listed columns that exist, in list order."""
    have = set(df.columns)
    return df.select(*[x for x in cols if x in have])


def rename_by(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """PRJ-2: rename from a dictionary (absent keys ignored)."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def merge_columns(*lists: Iterable[str]) -> list[str]:
    """PRJ-3: union of column lists, first-seen order, no duplicates."""
    seen: dict[str, None] = {}
    for lst in lists:
        for x in lst:
            seen.setdefault(x, None)
    return list(seen)


class MissingColumns(ValueError):
    pass


def missing_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    have = set(df.columns)
    return [x for x in cols if x not in have]


def require_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """PRJ-4: schema check before any job; raises listing every missing column."""
    miss = missing_columns(df, cols)
    if miss:
        raise MissingColumns("missing columns: " + ", ".join(miss))
    return df


def validate_records(df: DataFrame, schema: T.StructType, reason: str = "reject_reason"):
    """PRJ-5: typed, required record schema -> (valid, rejected).

    Each field is ``try_cast`` to its declared type; a required field that is
    null after the cast rejects the row, and the reason names the fields.
    """
    casts = []
    checks = []
    for f in schema.fields:
        src = F.col(f.name) if f.name in df.columns else F.lit(None)
        casted = F.expr(f"try_cast(`{f.name}` as {f.dataType.simpleString()})") if f.name in df.columns \
            else src.cast(f.dataType)
        casts.append(casted.alias(f.name))
        if not f.nullable:
            checks.append(F.when(casted.isNull(), F.lit(f.name)))
    typed = df.select(*casts, F.concat_ws(",", *checks).alias(reason) if checks else F.lit("").alias(reason))
    valid = typed.where(F.col(reason) == "").drop(reason)
    rejected = typed.where(F.col(reason) != "")
    return valid, rejected


def align_features(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """PRJ-6: project to the exact trained feature order."""
    require_columns(df, order)
    return df.select(*order)


def with_default(df: DataFrame, out: str, expr: Column, needs: Sequence[str], default=0) -> DataFrame:
    """PRJ-7: ``out = expr`` if every source column exists, else a constant."""
    ok = all(x in df.columns for x in needs)
    return df.withColumn(out, expr if ok else F.lit(default))


def encode_labels(df: DataFrame, maps: Mapping[str, Mapping[str, int]], reason: str = "unknown_labels"):
    """PRJ-8: label -> code for many columns. Unknown labels (and nulls) -> (valid, rejected).

    Valid rows hold the codes; rejected rows hold the labels as they came, and the reason names the columns.
    """
    codes, bad = {}, []
    for col, m in maps.items():
        mp = F.create_map(*[x for k, v in m.items() for x in (F.lit(k), F.lit(int(v)))])
        codes[col] = mp[F.col(col)]
        bad.append(F.when(codes[col].isNull(), F.lit(col)))
    out = df.withColumn(reason, F.concat_ws(",", *bad))
    return out.where(F.col(reason) == "").withColumns(codes).drop(reason), out.where(F.col(reason) != "")


def checked_records(df: DataFrame, schema: T.StructType, maps: Mapping[str, Mapping[str, int]] | None = None, keep: Sequence[str] = (),
                    reason: str = "reject_reason", record: str = "record") -> DataFrame:
    """PRJ-5 and PRJ-8 in one projection, for batches and streams alike.

    Returns ``keep``, the fields of ``schema`` (labels coded, values cast), ``reason`` - empty for a valid record, else
    the required fields that are missing or wrong and the labels that are not known, as ``field`` and
    ``field:label`` - and ``record``, the row of a rejected record as it came (JSON), null for a valid one.
    """
    maps, cols, why = dict(maps or {}), [], []
    for f in schema.fields:
        if f.name not in df.columns:
            value = F.lit(None).cast(f.dataType)
        elif f.name in maps:
            table = F.create_map(*[x for k, v in maps[f.name].items() for x in (F.lit(k), F.lit(int(v)))])
            text = F.col(f"`{f.name}`").cast("string")
            # a known label, or a code that came as such
            value = F.coalesce(table[text].cast(f.dataType), text.try_cast(f.dataType))
        else:
            value = F.col(f"`{f.name}`").try_cast(f.dataType)
        cols.append(value.alias(f.name))
        given = F.col(f"`{f.name}`").cast("string") if f.name in maps and f.name in df.columns else F.lit(None).cast("string")
        unknown = value.isNull() & given.isNotNull()
        why.append(F.when(unknown, F.concat(F.lit(f"{f.name}:"), given)).when(value.isNull() & F.lit(not f.nullable), F.lit(f.name)))
    # A filter on the reason must not be pushed below the casts: it holds them all, and the planner would derive
    # a constraint for every mixture of a cast and its name. An expression that isn't deterministic stays where it is.
    found = F.when(F.spark_partition_id() >= 0, F.concat_ws(",", *why))
    out = df.select(*[F.col(f"`{c}`") for c in keep if c not in schema.names], *cols, found.alias(reason),
                    F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias(record))
    return out.withColumn(record, F.when(F.col(reason) != "", F.col(record)))


def decode_labels(df: DataFrame, col: str, lookup: DataFrame, out: str | None = None,
                  variable: str | None = None) -> DataFrame:
    """PRJ-10: code -> label via a broadcast lookup; unmapped codes keep their raw value as text."""
    lk = lookup
    if variable is not None:
        lk = lk.where(F.col("variable") == variable)
    from surveyspark.functions.exprs import bounded_broadcast
    lk = bounded_broadcast(lk.select(F.col("code").alias("__code"), F.col("label").alias("__label")), 1_000_000)
    j = df.join(lk, F.col(col) == F.col("__code"), "left")
    return j.withColumn(out or f"{col}_label", F.coalesce(F.col("__label"), F.col(col).cast("string"))) \
        .drop("__code", "__label")


def with_alias(df: DataFrame, src: str, out: str) -> DataFrame:
    """PRJ-11: copy-derived column."""
    return df.withColumn(out, F.col(src))


def enrich_region(df: DataFrame, dim: DataFrame, key: str, dim_key: str = "region_code") -> DataFrame:
    """PRJ-14: add region name / coordinates (fixed-size dimension, broadcast)."""
    from surveyspark.functions.exprs import bounded_broadcast
    return df.join(bounded_broadcast(dim, 1_000_000), F.col(key) == F.col(dim_key), "left").drop(dim_key)


def assemble_record(df: DataFrame, ts: Column | None = None, fmt: str = "dd/MM/yyyy HH:mm") -> DataFrame:
    """PRJ-15: inputs + scores + decision + formatted date."""
    ts = F.current_timestamp() if ts is None else ts
    return df.select("*", F.date_format(ts, fmt).alias("scored_at"))


def stat_type(name: str, continuous: Sequence[str], ids: Sequence[str]) -> str:
    if name in continuous:
        return "Numerique Continue"
    if name in ids:
        return "Identifiant de Sondage"
    return "Qualitative / Categorielle"


def build_dictionary(spark: SparkSession, df: DataFrame, names: Mapping[str, str],
                     continuous: Sequence[str], ids: Sequence[str],
                     categories: Mapping[str, str], derived: str = "Variable Derivee (Algorithme)",
                     default_values: str = "Echelle continue / Identifiant unique") -> DataFrame:
    """PRJ-16: data dictionary (Variable, CodeDHS, Type, ValeursDHS) from a schema.

    Schema-sized (one row per column): built on the driver from ``df.schema``.
    """
    rows = []
    for f in df.schema.fields:
        raw = f.name
        rows.append((names.get(raw, raw.lower().replace("_", "")),
                     raw if raw in names else derived,
                     stat_type(raw, continuous, ids),
                     categories.get(raw, default_values)))
    return spark.createDataFrame(rows, "Variable STRING, CodeDHS STRING, Type STRING, ValeursDHS STRING")


def infer_roles(df: DataFrame, cols: Sequence[str], k: int = 5) -> DataFrame:
    """PRJ-17: numeric with more than k distinct values -> continuous, else categorical."""
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    wide = df.agg(*[F.count_distinct(F.col(x)).alias(x) for x in cols])
    long = wide.unpivot([], list(cols), "variable", "n_distinct")
    num = F.col("variable").isin(sorted(numeric)) if numeric else F.lit(False)
    return long.select("variable", F.col("n_distinct").cast("long").alias("n_distinct"),
                       F.when(num & (F.col("n_distinct") > k), "continuous").otherwise("categorical")
                       .alias("role"))
