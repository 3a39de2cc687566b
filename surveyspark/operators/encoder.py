"""FEA-2 and FEA-3 as a fitted, writable ``pyspark.ml`` stage.

``SurveyEncoder().fit(train)`` gives a ``SurveyEncoderModel`` that standardises the continuous columns and
target-encodes the categorical ones of any frame, batch or stream, whether or not its rows were in training.
A null is a category of its own. ``model.encode(df, training=...)`` gives the training rows the encoding that was fitted
without their own fold, so the learner that follows sees no leakage.

One pass over the training rows stacks the categorical columns and sums them per (variable, value, fold)
with map-side combining; that table, whose size follows the number of categories, is checkpointed and all
encodings come from it.
"""

from __future__ import annotations

import json
from typing import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable,
                             MLReader, MLWritable, MLWriter)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyspark.operators.joins import with_scalars

INLINE_LEVELS = 64              #: a variable with at most this many table rows is encoded by a literal map
BROADCAST_LEVELS = 2_000_000    #: one with at most this many by a broadcast join, beyond that by a shuffle join
ALL, NULL = "*", "\x00null"     #: fold key of the plain encoding; category key of a null


def blended(n, s, s2, ymean, yvar) -> Column:
    """Empirical-Bayes blend: lambda = n / (n + var_c / var_y), enc = lambda mean_c + (1 - lambda) mean_y."""
    mean_c = s / n
    var_c = s2 / n - mean_c * mean_c
    lam = F.when(yvar > 0, n * yvar / (n * yvar + var_c)).otherwise(F.lit(1.0))
    return lam * mean_c + (1.0 - lam) * ymean


def vector_of(cols: Sequence[str]) -> Column:
    """Numeric columns as one dense vector, null as NaN; unlike ``VectorAssembler`` it needs no row object for each row."""
    return array_to_vector(F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))) for c in cols]))


def category_key(col: str, kind: str) -> Column:
    """A category as text, first brought to the type that it had in training."""
    return F.coalesce(F.col(f"`{col}`").try_cast(kind).cast("string"), F.lit(NULL))


def fold_key(fold: str | None) -> Column:
    return F.concat(F.lit("f"), F.coalesce(F.col(f"`{fold}`").cast("string"), F.lit(NULL))) if fold else F.lit("f")


def category_cells(train: DataFrame, kinds: dict[str, str], y: str, fold: str | None) -> DataFrame:
    """variable, value, fold, n, s, s2 of the training rows with a target (checkpointed)."""
    from surveyspark.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(train.sparkSession)
    names = list(kinds)
    rows = train.where(F.col(y).isNotNull()).select(
        F.col(y).cast("double").alias("_y"), fold_key(fold).alias("_f"), *[category_key(c, k).alias(f"_c{i}") for i, (c, k) in enumerate(kinds.items())])
    stacked = rows.unpivot(["_y", "_f"], [f"_c{i}" for i in range(len(names))], "_v", "value")
    name_of = F.element_at(F.array(*[F.lit(c) for c in names]), F.substring("_v", 3, 9).cast("int") + 1)
    cells = stacked.groupBy("_v", "value", F.col("_f").alias("fold")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_y").alias("s"), F.sum(F.col("_y") * F.col("_y")).alias("s2"))
    return cells.select(name_of.alias("variable"), "value", "fold", "n", "s", "s2").checkpoint(eager=True)


def encodings(cells: DataFrame, a_variable: str) -> DataFrame:
    """variable, value, fold, enc: the plain encoding under fold '*', and each fold's from the other folds."""
    folds = cells.where(F.col("variable") == a_variable).groupBy("fold").agg(
        F.sum("n").alias("fold_n"), F.sum("s").alias("fold_s"), F.sum("s2").alias("fold_s2"))
    total = folds.agg(F.sum("fold_n").alias("all_n"), F.sum("fold_s").alias("all_s"), F.sum("fold_s2").alias("all_s2"))
    by_value = cells.groupBy("variable", "value").agg(F.sum("n").alias("val_n"), F.sum("s").alias("val_s"), F.sum("s2").alias("val_s2"))
    mean = F.col("all_s") / F.col("all_n")
    plain = with_scalars(by_value, total).select(
        "variable", "value", F.lit(ALL).alias("fold"),
        blended(F.col("val_n"), F.col("val_s"), F.col("val_s2"), mean, F.col("all_s2") / F.col("all_n") - mean * mean).alias("enc"))
    others = with_scalars(folds, total)
    on, os, os2 = (F.col(f"all_{x}") - F.col(f"fold_{x}") for x in ("n", "s", "s2"))
    mean = F.try_divide(os, on)
    others = others.select("fold", mean.alias("ym"), (F.try_divide(os2, on) - mean * mean).alias("yv"))
    # one row per fold
    held_out = (cells.join(by_value, ["variable", "value"]).join(F.broadcast(others), "fold")
                .select("variable", "value", "fold", "ym", "yv", (F.col("val_n") - F.col("n")).alias("rest_n"),
                        (F.col("val_s") - F.col("s")).alias("rest_s"), (F.col("val_s2") - F.col("s2")).alias("rest_s2")))
    rest_n = F.nullif(F.col("rest_n"), F.lit(0))
    held_out = held_out.select("variable", "value", "fold", F.coalesce(
        blended(rest_n, F.col("rest_s"), F.col("rest_s2"), F.col("ym"), F.col("yv")), F.col("ym")).alias("enc"))
    return plain.unionByName(held_out)


class _EncoderParams(Params):
    continuousCols = Param(Params._dummy(), "continuousCols", "columns to standardise", TypeConverters.toListString)
    categoricalCols = Param(Params._dummy(), "categoricalCols", "columns to target-encode", TypeConverters.toListString)
    labelCol = Param(Params._dummy(), "labelCol", "target", TypeConverters.toString)
    foldCol = Param(Params._dummy(), "foldCol", "fold of a training row, empty without cross-fitting", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "vector of all features, empty for none", TypeConverters.toString)

    def feature_names(self) -> list[str]:
        """Names of the vector's entries, in order."""
        return [f"{c}_std" for c in self.getOrDefault("continuousCols")] + [f"{c}_te" for c in self.getOrDefault("categoricalCols")]


class SurveyEncoder(Estimator, _EncoderParams, DefaultParamsReadable, DefaultParamsWritable):
    """FEA-3: standardises continuous columns (population sd) and target-encodes categorical ones."""

    @keyword_only
    def __init__(self, *, continuousCols=None, categoricalCols=None, labelCol="label", foldCol="", outputCol="features"):
        super().__init__()
        self._setDefault(continuousCols=[], categoricalCols=[], labelCol="label", foldCol="", outputCol="features")
        self._set(**self._input_kwargs)

    def _fit(self, train: DataFrame) -> "SurveyEncoderModel":
        cont, cats = self.getOrDefault("continuousCols"), self.getOrDefault("categoricalCols")
        y, fold = self.getOrDefault("labelCol"), self.getOrDefault("foldCol")
        found = train.agg(F.count(y).alias("n"), F.avg(F.col(y).cast("double")).alias("mean"),
                          *[F.avg(f"`{c}`").alias(f"m{i}") for i, c in enumerate(cont)],
                          *[F.stddev_pop(f"`{c}`").alias(f"s{i}") for i, c in enumerate(cont)]).first()
        if not found["n"]:
            raise ValueError("no training row has a target")
        kinds = {c: train.schema[c].dataType.simpleString() for c in cats}
        levels, sizes = None, {}
        if cats:
            levels = encodings(category_cells(train, kinds, y, fold or None), cats[0]).checkpoint(eager=True)
            sizes = {r["variable"]: r["n"] for r in levels.groupBy("variable").agg(F.count(F.lit(1)).alias("n")).collect()}
        model = SurveyEncoderModel(
            facts={"mean": found["mean"], "means": [found[f"m{i}"] for i in range(len(cont))],
                   "sds": [found[f"s{i}"] for i in range(len(cont))], "kinds": kinds, "sizes": sizes}, levels=levels)
        return self._copyValues(model)


class SurveyEncoderModel(Model, _EncoderParams, MLReadable, MLWritable):
    """Fitted parameters: means and deviations, and one table of encodings (variable, value, fold, enc)."""

    def __init__(self, facts: dict | None = None, levels: DataFrame | None = None):
        super().__init__()
        self._setDefault(continuousCols=[], categoricalCols=[], labelCol="label", foldCol="", outputCol="features")
        self.facts, self.levels, self._inline = facts or {}, levels, None
        self.inline_levels = INLINE_LEVELS

    def _small(self) -> dict[str, list]:
        """The rows of the variables that are encoded by a literal map; bounded by ``inline_levels`` each."""
        if self._inline is None:
            names = [c for c in self.getOrDefault("categoricalCols") if self.facts["sizes"].get(c, 0) <= self.inline_levels]
            self._inline = {c: [] for c in names}
            if names:
                for r in self.levels.where(F.col("variable").isin(names)).collect():
                    self._inline[r["variable"]].append((r["value"], r["fold"], r["enc"]))
        return self._inline

    def encode(self, df: DataFrame, training: Column | None = None) -> DataFrame:
        """The encoded columns; rows where ``training`` is true get the encoding without their own fold."""
        f = self.facts
        out = df.withColumns({
            f"{c}_std": (F.col(f"`{c}`") - F.lit(m)) / F.lit(s if s else 1.0)
            for c, m, s in zip(self.getOrDefault("continuousCols"), f["means"], f["sds"])})
        fold = self.getOrDefault("foldCol")
        which = F.lit(ALL) if training is None else F.when(training, fold_key(fold or None)).otherwise(F.lit(ALL))
        small, mapped = self._small(), {}
        # a map is searched entry by entry: one entry per category holds its encodings in the order of ``keys``
        keys = sorted({k for rows in small.values() for _, k, _ in rows if training is not None or k == ALL})
        place = F.lit(None).cast("int")
        for i, k in enumerate(keys):
            place = F.when(which == k, F.lit(i)).otherwise(place)
        if small:
            out = out.withColumn("_place", place)
        for c in self.getOrDefault("categoricalCols"):
            value, name = category_key(c, f["kinds"][c]), f"{c}_te"
            if c in small:
                found = {}
                for v, k, e in small[c]:
                    if k in keys:
                        found.setdefault(v, {})[k] = float(e)
                table = F.create_map(*[x for v, by in found.items() for x in (F.lit(v), F.array(*[F.lit(by.get(k)).cast("double") for k in keys]))])
                mapped[name] = F.coalesce(F.get(table[value], F.col("_place")), F.lit(f["mean"])) if found else F.lit(f["mean"])
                continue
            table = self.levels.where(F.col("variable") == c).select(F.col("value").alias("_lv"), F.col("fold").alias("_lf"), F.col("enc").alias(name))
            if f["sizes"].get(c, 0) <= BROADCAST_LEVELS:
                table = F.broadcast(table)
            out = (out.withColumn("_v", value).withColumn("_w", which)
                   .join(table, (F.col("_v") == F.col("_lv")) & (F.col("_w") == F.col("_lf")), "left")
                   .drop("_v", "_w", "_lv", "_lf").withColumn(name, F.coalesce(name, F.lit(f["mean"]))))
        return out.withColumns(mapped).drop("_place") if small else out

    def assembled(self, encoded: DataFrame) -> DataFrame:
        vec = self.getOrDefault("outputCol")
        if not vec:
            return encoded
        return encoded.withColumn(vec, vector_of(self.feature_names()))

    def transform_training(self, df: DataFrame) -> DataFrame:
        """The training rows, each encoded without its own fold."""
        return self.assembled(self.encode(df, F.lit(True)))

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.assembled(self.encode(df))

    def write(self) -> "MLWriter":
        return _EncoderWriter(self)

    @classmethod
    def read(cls) -> "MLReader":
        return _EncoderReader()


class _EncoderWriter(MLWriter):
    def __init__(self, instance: SurveyEncoderModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        m, spark = self.instance, SparkSession.active()
        DefaultParamsWriter.saveMetadata(m, path, spark, extraMetadata={"facts": json.dumps(m.facts)})
        if m.levels is not None:
            m.levels.write.mode("overwrite").parquet(f"{path}/levels")


class _EncoderReader(MLReader):
    def load(self, path: str) -> SurveyEncoderModel:
        spark = SparkSession.active()
        meta = DefaultParamsReader.loadMetadata(path, spark)
        m = SurveyEncoderModel(json.loads(meta["facts"]))
        m._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(m, meta)
        if m.facts["kinds"]:
            m.levels = spark.read.schema("variable string, value string, fold string, enc double").parquet(f"{path}/levels")
        return m


def fit_encoder(train: DataFrame, continuous: Sequence[str], categorical: Sequence[str], y: str, fold: str = "") -> SurveyEncoderModel:
    return SurveyEncoder(continuousCols=list(continuous), categoricalCols=list(categorical), labelCol=y, foldCol=fold).fit(train)


__all__ = ["SurveyEncoder", "SurveyEncoderModel", "fit_encoder"]
