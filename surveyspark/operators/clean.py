"""Filters, predicates and cleaning (FLT-*, CLN-*)."""

from __future__ import annotations

from typing import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyspark.functions import fixed_values as FV
from surveyspark.operators import stats_core as S
from surveyspark.operators.joins import null_safe_join, with_scalars


def keep_valid(df: DataFrame, col: str, value=0) -> DataFrame:
    """FLT-1: keep rows whose validity flag equals ``value`` (skipped if the column is absent)."""
    return df.where(F.col(col) == F.lit(value)) if col in df.columns else df


def drop_codes(df: DataFrame, col: str, codes: Iterable, drop_null: bool = True) -> DataFrame:
    """FLT-2 / FLT-3: drop sentinel codes; nulls dropped (FLT-2) or kept (FLT-3).

    A bare SQL ``NOT IN`` would drop nulls too, so the null branch is explicit.
    """
    if col not in df.columns:
        return df
    bad = F.col(col).isin(list(codes))
    if drop_null:
        return df.where(F.col(col).isNotNull() & ~bad)
    return df.where(F.col(col).isNull() | ~bad)


def keep_range(df: DataFrame, cols: Sequence[str], lo, hi) -> DataFrame:
    """FLT-4: closed range filter on each listed column (a null fails the test)."""
    cond = None
    for x in cols:
        if x in df.columns:
            e = F.col(x).between(F.lit(lo), F.lit(hi))
            cond = e if cond is None else cond & e
    return df if cond is None else df.where(cond)


def text_na_mask(col: str, nulls: Sequence[str] = tuple(FV.TEXT_NULLS)):
    return F.col(col).isNotNull() & ~F.trim(F.col(col).cast("string")).isin(list(nulls))


def drop_text_na(df: DataFrame, col: str, nulls: Sequence[str] = tuple(FV.TEXT_NULLS)) -> DataFrame:
    """FLT-5: drop nulls and text nulls ("NA", "na", "", "nan", "NaN") after trimming."""
    return df.where(text_na_mask(col, nulls))


def drop_unmapped(freq: DataFrame, lookup: DataFrame, on: Sequence[str]) -> DataFrame:
    """FLT-6: keep only codes present in the lookup (inner join, lookup broadcast)."""
    from surveyspark.functions.exprs import bounded_broadcast
    return freq.join(bounded_broadcast(lookup, 1_000_000), list(on), "inner")


def count_at_least(df: DataFrame, col: str, t: float, alias: str = "n_at_least") -> DataFrame:
    """FLT-8: number of rows with ``col >= t``."""
    return df.agg(F.count_if(F.col(col) >= F.lit(t)).alias(alias))


def drop_terms(df: DataFrame, terms: Sequence[str], col: str = "term") -> DataFrame:
    """FLT-9: drop named terms (tolerant if absent)."""
    return df.where(~F.col(col).isin(list(terms)))


def rescale(df: DataFrame, divisors: Mapping[str, float]) -> DataFrame:
    """CLN-1: restore implied decimals, ``col / divisor``."""
    return df.withColumns({k: F.col(k) / F.lit(float(v)) for k, v in divisors.items() if k in df.columns})


def codes_to_null(df: DataFrame, cols: Sequence[str], codes: Iterable) -> DataFrame:
    """CLN-2: sentinel codes -> null."""
    codes = list(codes)
    return df.withColumns({x: F.when(F.col(x).isin(codes), F.lit(None)).otherwise(F.col(x))
                           for x in cols if x in df.columns})


def impute_median(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """CLN-3: exact median imputation (one distributed aggregate, broadcast back).

    ``keys`` gives per-group medians (e.g. per stratum); without keys the
    medians are a one-row frame.
    """
    cols = [x for x in cols if x in df.columns]
    if not cols:
        return df
    med = S.medians(df, cols, keys).select(*keys, *[F.col(x).alias(f"__med_{x}") for x in cols])
    joined = null_safe_join(df, med, keys, "left") if keys else with_scalars(df, med)   # keyed: planner / AQE
    out = joined.withColumns({x: F.coalesce(F.col(x).cast("double"), F.col(f"__med_{x}")) for x in cols})
    return out.drop(*[f"__med_{x}" for x in cols])


def impute_const(df: DataFrame, col: str, value) -> DataFrame:
    """CLN-4: constant imputation."""
    return df.withColumn(col, F.coalesce(F.col(col), F.lit(value)))


def collapse_missing(df: DataFrame, cols: Sequence[str], rules: Mapping | None = None,
                     default: tuple | None = None, null_to_target: bool = True) -> DataFrame:
    """CLN-5: per-column missing-code collapse, then null -> code, cast int.

    Rules are explicit per column; columns without a rule use ``default`` only
    if one is given (decided rule Q1). A null becomes that column's target code
    (Q3); ``null_to_target=False`` keeps the reference's constant 9.
    """
    rules = FV.MISSING_RULES if rules is None else rules
    exprs = {}
    for x in cols:
        if x not in df.columns:
            continue
        rule = rules.get(x, default)
        if rule is None:
            continue
        bad, target = rule
        fill = target if null_to_target else 9
        e = F.when(F.col(x).isin(list(bad)), F.lit(target)).otherwise(F.col(x))
        exprs[x] = F.coalesce(e, F.lit(fill)).cast("int")
    return df.withColumns(exprs)


def recode(df: DataFrame, col: str, mapping: Mapping, out: str | None = None) -> DataFrame:
    """CLN-6: merge code levels (unmapped codes unchanged)."""
    e = None
    for k, v in mapping.items():
        e = F.when(F.col(col) == F.lit(k), F.lit(v)) if e is None else e.when(F.col(col) == F.lit(k), F.lit(v))
    return df.withColumn(out or col, e.otherwise(F.col(col)) if e is not None else F.col(col))


def clean_survey(df: DataFrame, watch=None) -> DataFrame:
    """The cleaning plan of the raw coded survey (3.1), with rules Q1-Q4 applied.

    validity flag -> z-score sentinels and range -> sentinels nulled before
    rescaling -> implied decimals -> generic sentinels -> median imputation ->
    categorical collapse -> indicators, composite and analytic weight.

    ``watch(stage, frame)`` returns the frame to go on with; ``aggregate.StageCounts``
    counts the rows of each stage while the plan itself runs (AGG-1).
    """
    from surveyspark.functions import exprs as X

    watch = watch or (lambda stage, frame: frame)
    df = watch("valid", keep_valid(watch("raw", df), "hw13", 0))
    for z in ("hw5", "hw8", "hw11"):
        df = drop_codes(df, z, FV.Z_SCORE_SENTINELS, drop_null=True)
    df = watch("anthropometry", keep_range(df, ["hw5", "hw8", "hw11"], *FV.Z_SCORE_RANGE))
    df = drop_codes(df, "v445", FV.BMI_SENTINELS, drop_null=False)
    df = drop_codes(df, "v438", FV.HAEMOGLOBIN_SENTINELS + [9996, 9997, 9998, 9999], drop_null=False)
    df = watch("continuous", rescale(df, {"v445": 100.0, "v438": 10.0}))
    cont = [x for x in FV.CONTINUOUS_FIELDS if x in df.columns]
    df = codes_to_null(df, [x for x in cont if x not in ("v445", "v438")], FV.GENERIC_SENTINELS)
    df = impute_median(df, cont)
    df = collapse_missing(df, [x for x in merged(FV.CATEGORICAL_FIELDS, FV.MISSING_RULES) if x not in cont], FV.MISSING_RULES)
    df = df.withColumns({
        "Y1_stunting": X.flag_below("hw5", FV.STUNTING_CUTOFF),
        "Y2_wasting": X.flag_below("hw8", FV.STUNTING_CUTOFF),
        "Y3_underweight": X.flag_below("hw11", FV.STUNTING_CUTOFF),
    })
    df = df.withColumn("Y_ICEA", X.any_of(["Y1_stunting", "Y2_wasting", "Y3_underweight"]))
    if "v005" in df.columns:
        df = df.withColumn("poids_analytique", F.col("v005") / F.lit(1e6))
    return watch("clean", df)


def merged(*lists) -> list[str]:
    return list(dict.fromkeys(x for names in lists for x in names))
