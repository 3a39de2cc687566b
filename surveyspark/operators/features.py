"""Feature transforms (FEA-*): fitted on the training partition, applied to all.

Fitted parameters are small DataFrames (one row, or one row per category and
fold) joined back; nothing is collected per row to the driver.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.ml.feature import RFormula
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyspark.operators.joins import with_scalars


# ---------------------------------------------------------------- FEA-1

def fit_standardiser(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """FEA-1: one-row (mean, population sd) per column, as the reference's scaler uses."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"__mu_{c}"), F.stddev_pop(c).alias(f"__sd_{c}")]
    return train.agg(*aggs)


def apply_standardiser(df: DataFrame, params: DataFrame, cols: Sequence[str], suffix: str = "") -> DataFrame:
    """FEA-1: (x - mean) / sd; a zero sd leaves (x - mean) (sd treated as 1)."""
    j = with_scalars(df, params)
    exprs = {}
    for c in cols:
        sd = F.col(f"__sd_{c}")
        exprs[f"{c}{suffix}"] = (F.col(c) - F.col(f"__mu_{c}")) / F.when(sd == 0, F.lit(1.0)).otherwise(sd)
    return j.withColumns(exprs).drop(*params.columns)


# ---------------------------------------------------------------- FEA-2

def target_encode(df: DataFrame, cols: Sequence[str], y: str, split: str = "split", train: str = "train",
                  fold: str = "fold", suffix: str = "_te") -> DataFrame:
    """FEA-2: smoothed target encoding with cross-fitting on the training rows.

    Training rows get the encoding fitted on the other folds (total minus own
    fold); other partitions get the encoding fitted on all training rows; an
    unseen category gets the training mean. A null is a category. The fitted
    object is ``encoder.SurveyEncoderModel``; this is its fit and use in one call.
    """
    from surveyspark.operators.encoder import SurveyEncoder
    is_train = F.col(split) == train
    model = SurveyEncoder(categoricalCols=list(cols), labelCol=y, foldCol=fold, outputCol="").fit(df.where(is_train))
    out = model.encode(df, F.coalesce(is_train, F.lit(False)))
    return out if suffix == "_te" else out.withColumnsRenamed({f"{c}_te": f"{c}{suffix}" for c in cols})


# ---------------------------------------------------------------- FEA-4

def balance_weights(df: DataFrame, y: str, w: str, out: str = "w_balanced", split: str | None = None,
                    train: str = "train", rate_of: DataFrame | None = None) -> DataFrame:
    """FEA-4: w / rate for positives, w / (1 - rate) for negatives; rate = weighted training prevalence.

    ``rate_of`` holds the same rows where ``df`` is dear to compute twice.
    """
    fit = df if rate_of is None else rate_of
    fit = fit if split is None else fit.where(F.col(split) == train)
    rate = fit.agg((F.sum(F.col(w) * F.col(y)) / F.sum(w)).alias("__rate"))
    j = with_scalars(df, rate)
    return j.withColumn(out, F.when(F.col(y) == 1, F.col(w) / F.col("__rate"))
                        .otherwise(F.col(w) / (1.0 - F.col("__rate")))).drop("__rate")


# ---------------------------------------------------------------- FEA-5 / FEA-6

def levels(df: DataFrame, col: str, max_levels: int = 10_000) -> list:
    """Sorted distinct levels of a categorical column (bounded driver fetch)."""
    vals = [r[0] for r in df.select(col).distinct().orderBy(col).limit(max_levels + 1).collect()]
    if len(vals) > max_levels:
        raise ValueError(f"{col} has more than {max_levels} levels; use target encoding")
    return vals


def one_hot(df: DataFrame, col: str, codes: Sequence | None = None, prefix: str | None = None) -> DataFrame:
    """FEA-5: full disjunctive table (one 0/1 column per code, no level dropped)."""
    codes = levels(df, col) if codes is None else list(codes)
    p = prefix or col
    return df.withColumns({f"{p}_{v}": (F.col(col) == F.lit(v)).cast("int") for v in codes})


def design_matrix(df: DataFrame, numeric: Sequence[str], factors: Sequence[str],
                  factor_levels: dict | None = None, intercept: bool = True) -> tuple[DataFrame, list[str]]:
    """FEA-6: formula design matrix with treatment coding (lowest level = reference).

    Returns the frame with ``Intercept``, the numeric terms and one indicator
    ``C(f)[T.level]`` per non-reference level, plus the ordered term list.
    """
    factor_levels = dict(factor_levels or {})
    terms, exprs = [], {}
    if intercept:
        terms.append("Intercept")
        exprs["Intercept"] = F.lit(1.0)
    for c in numeric:
        terms.append(c)
        exprs[c] = F.col(c).cast("double")
    for f in factors:
        lv = factor_levels.get(f) or levels(df, f)
        for v in sorted(lv)[1:]:
            name = f"C({f})[T.{v}]"
            terms.append(name)
            exprs[name] = (F.col(f) == F.lit(v)).cast("double")
    return df.withColumns(exprs), terms


def code_text(code: Column) -> Column:
    """A whole number as ``%019d`` writes it, without a formatter per row."""
    text = code.cast("string")
    below = F.substring(text, 2, 19)
    return (F.when(code >= 0, F.lpad(text, 19, "0"))
            .when(F.length(below) > 18, text).otherwise(F.concat(F.lit("-"), F.lpad(below, 18, "0"))))


class FormulaDesign:
    """FEA-6: a design fitted from a formula; levels are those of the training rows, the lowest is the reference.

    ``transform`` gives the vector of the fitted ``RFormulaModel``; a level that training hasn't seen raises.
    ``columns`` gives one named column per term, from a staged copy of the design. Rows that lack any column of the formula are left out.
    """

    def __init__(self, label: str, used: Sequence[str], factors: dict[str, bool], model, terms: Sequence[str]):
        self.label, self.used, self.factors, self.model, self.terms = label, list(used), factors, model, ["Intercept", *terms]

    @staticmethod
    def prepared(df: DataFrame, used: Sequence[str], factors: dict[str, bool]) -> DataFrame:
        """Complete rows with each factor as text that sorts as its codes do."""
        out = df.dropna(subset=[c for c in used if c in df.columns])
        return out.withColumns({f"{c}__f": code_text(F.col(c).cast("long")) if whole else F.col(c).cast("string")
                                for c, whole in factors.items()})

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(self.prepared(df, self.used, self.factors)).drop(*[f"{c}__f" for c in self.factors])

    def columns(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        from surveyspark.session import staged
        x = vector_to_array(F.col("design"))
        # made once: otherwise every term would repeat the whole design in its expression
        out = staged(self.transform(df).select(self.label, *[c for c in keep if c != self.label], x.alias("design")), "design")
        return out.select(self.label, *[c for c in keep if c != self.label], F.lit(1.0).alias("Intercept"),
                          *[F.col("design")[i].alias(t) for i, t in enumerate(self.terms[1:])])


def fit_design(train: DataFrame, formula: str) -> FormulaDesign:
    """FEA-6: ``y ~ a + C(b)`` - ``a`` as a number, ``b`` as a factor with treatment coding - fitted on ``train``."""
    label, right = (part.strip() for part in formula.split("~"))
    parts = [p.strip() for p in right.split("+")]
    factors = {p[2:-1].strip(): isinstance(train.schema[p[2:-1].strip()].dataType, T.IntegralType) for p in parts if p.startswith("C(")}
    used = [label, *[p[2:-1].strip() if p.startswith("C(") else p for p in parts]]
    inner = " + ".join(f"{p[2:-1].strip()}__f" if p.startswith("C(") else p for p in parts)
    rows = train.dropna(subset=used)
    if factors:
        # the levels, found in one pass: the model needs each combination of them once
        from surveyspark.session import staged
        rows = staged(rows.groupBy(*factors).agg(*[F.min(c).alias(c) for c in used if c not in factors]), "levels")
    rows = FormulaDesign.prepared(rows, used, factors)
    # the last level is dropped: descending order makes the lowest the reference
    model = RFormula(formula=f"{label} ~ {inner}", featuresCol="design", labelCol="design_label", stringIndexerOrderType="alphabetDesc",
                     handleInvalid="error").fit(rows)
    attrs = model.transform(rows.limit(0)).schema["design"].metadata["ml_attr"]["attrs"]
    named = sorted((a["idx"], a["name"]) for group in attrs.values() for a in group)

    def term(name: str) -> str:
        for c, whole in factors.items():
            if name.startswith(f"{c}__f_"):
                level = name[len(c) + 4:]
                return f"C({c})[T.{int(level) if whole else level}]"
        return name

    return FormulaDesign(label, used, factors, model, [term(name) for _, name in named])


# ---------------------------------------------------------------- FEA-3

def column_transformer(df: DataFrame, continuous: Sequence[str], categorical: Sequence[str], y: str,
                       split: str = "split", train: str = "train", fold: str = "fold") -> tuple[DataFrame, list[str]]:
    """FEA-3: route continuous columns to FEA-1 and categorical ones to FEA-2, fitted on the training partition.

    Output names keep the encoder order (continuous then categorical), and the
    list of names is returned with the frame so importances pair by name (Q8).
    """
    from surveyspark.operators.encoder import SurveyEncoder
    is_train = F.col(split) == train
    model = SurveyEncoder(continuousCols=list(continuous), categoricalCols=list(categorical), labelCol=y, foldCol=fold,
                          outputCol="").fit(df.where(is_train))
    return model.encode(df, F.coalesce(is_train, F.lit(False))), model.feature_names()
