"""What the heavy steps shuffle and keep: whole rows once, and columnar copies instead of row checkpoints."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyspark.operators import inference as INF
from surveyspark.operators import split as SP
from surveyspark.operators.features import code_text
from tests.conftest import SMOKE


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_global_rank_shuffles_whole_rows_once(spark):
    df = spark.range(3000).select("id", (F.col("id") % 2).cast("int").alias("y"), F.sha2(F.col("id").cast("string"), 256).alias("h"))
    ranked = SP.hash_rank(df, "h", ["y"], out="r")
    assert _plan(ranked).count("Exchange hashpartitioning") == 1
    got = ranked.toPandas()
    want = got.sort_values("h").groupby("y").cumcount() + 1
    assert (got["r"].sort_index() == want.sort_index()).all()


def test_folds_do_not_shuffle_the_hash(spark):
    """Whole rows travel without what can be computed where they arrive: 32 digits of hash a row hardly compress."""
    df = spark.range(3000).select("id", (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 7).alias("x"))
    folds = SP.stratified_kfold(df, "y", "id", 5, seed=5)
    plan = _plan(folds)
    assert plan.count("Exchange hashpartitioning") == 1
    below = plan[plan.index("Exchange hashpartitioning"):]
    assert below.count("md5(") == 1 and "substring(md5(" in below        # the bucket, not the hash
    got = folds.toPandas().sort_values("id")
    h = df.withColumn("h", SP.seeded_hash(5, F.concat_ws("|", F.col("id").cast("string")))).toPandas().sort_values("h")
    want = (h.groupby("y").cumcount() % 5).sort_index()
    assert (got["fold"].to_numpy() == want.to_numpy()).all()


def test_a_sample_ranks_only_the_rows_it_keeps(spark):
    df = spark.range(5000).select("id", (F.col("id") % 3).alias("g"))
    got = SP.sample_n(df, 20, 7, "id", by=["g"])
    assert got.inputFiles()                     # from a staged copy of the kept rows, not from the whole input
    want = df.withColumn("h", SP.seeded_hash(7, F.concat_ws("|", F.col("id").cast("string")))).toPandas()
    want = set(want.sort_values("h").groupby("g").head(20)["id"])
    assert {r["id"] for r in got.collect()} == want


def test_encoded_rows_are_read_by_column(spark):
    from surveyspark.plans import q_model as Q
    df, names = Q.encoded(spark, SMOKE)
    assert any("staged-encoded" in f for f in df.inputFiles())
    assert "region_te" in names and "ReadSchema: struct<w:double>" in df.select("w")._jdf.queryExecution().toString()
    row = df.select("features", *names).first()
    assert list(row["features"]) == [row[n] for n in names]


def test_rows_of_a_fit_are_columns(spark):
    rows = INF.model_rows(spark.createDataFrame([(1.0, 0, 2.0), (None, 1, 1.0), (3.0, 1, 1.0)], "a double, y int, w double"), ["a"], "y", "w")
    assert rows.inputFiles() and np.allclose(sorted(r["t0"] for r in rows.collect()), [1.0, 3.0])


@pytest.mark.parametrize("kind", ["int", "bigint"])
def test_codes_as_text_sort_as_before(spark, kind):
    values = [0, 7, -5, 2**31 - 1, -2**31] + ([10**18, -10**18, 2**63 - 1, -2**63] if kind == "bigint" else [])
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}").withColumn("v", F.col("v").cast("long"))
    bad = df.where(code_text(F.col("v")) != F.format_string("%019d", "v")).collect()
    assert not bad
