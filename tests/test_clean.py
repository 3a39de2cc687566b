from pyspark.sql import functions as F

from surveyspark.functions import exprs as X
from surveyspark.operators import clean as C

SENT = [(1, 97.0), (2, 98.0), (3, 99.0), (4, 997.0), (5, 9998.0), (6, None), (7, 12.0), (8, 30.0)]


def _sent(spark):
    return spark.createDataFrame(SENT, "id int, x double")


def test_drop_codes_null_handling(spark):
    df = _sent(spark)
    assert sorted(r.id for r in C.drop_codes(df, "x", [97, 98, 99]).collect()) == [4, 5, 7, 8]
    assert sorted(r.id for r in C.drop_codes(df, "x", [97, 98, 99], drop_null=False).collect()) == [4, 5, 6, 7, 8]


def test_codes_to_null_and_median(spark):
    df = C.codes_to_null(_sent(spark), ["x"], [97, 98, 99, 997, 998, 999, 9998])
    # remaining values 12, 30 -> median 21 (linear interpolation)
    out = {r.id: r.x for r in C.impute_median(df, ["x"]).collect()}
    assert out[1] == 21.0 and out[6] == 21.0 and out[7] == 12.0


def test_collapse_missing_rules(spark):
    df = spark.createDataFrame([(8,), (9,), (None,), (3,), (98,)], "h2 int")
    out = [r.h2 for r in C.collapse_missing(df, ["h2"], {"h2": ([8, 9], 9)}).collect()]
    assert out == [9, 9, 9, 3, 98]     # no implicit default for 98 (rule Q1)


def test_text_na(spark):
    df = spark.createDataFrame([("NA",), (" na ",), ("",), ("nan",), ("NaN",), ("1",), (None,)], "v string")
    assert [r.v for r in C.drop_text_na(df, "v").collect()] == ["1"]


def test_safe_ratio_zero_and_null(spark):
    df = spark.createDataFrame([(2, 4), (3, 0), (1, None)], "a int, b int")
    assert [r.r for r in df.select(X.safe_ratio("a", "b", 3.0).alias("r")).collect()] == [0.5, 3.0, 3.0]


def test_keep_range_and_valid(spark):
    df = spark.createDataFrame([(0, -601), (0, 600), (1, 0), (0, None)], "hw13 int, hw5 int")
    out = C.keep_range(C.keep_valid(df, "hw13", 0), ["hw5"], -600, 600)
    assert [r.hw5 for r in out.collect()] == [600]


def test_clean_survey_end_to_end(spark):
    rows = [(0, -250, 10, -300, 2300.0, 120.0, 1, 5000000.0, 8), (0, 100, 50, 20, 2100.0, 115.0, 2, 1000000.0, None),
            (1, 0, 0, 0, 2000.0, 110.0, 1, 1000000.0, 1), (0, 9999, 0, 0, 2000.0, 110.0, 1, 1000000.0, 2),
            (0, 5, 5, 5, 9998.0, 110.0, 1, 1000000.0, 2)]
    df = spark.createDataFrame(rows, "hw13 int, hw5 int, hw8 int, hw11 int, v445 double, v438 double, v025 int, "
                                     "v005 double, h2 int")
    out = C.clean_survey(df).orderBy("hw5").collect()
    assert len(out) == 2
    assert out[0]["Y_ICEA"] == 1 and out[0]["Y1_stunting"] == 1 and out[1]["Y_ICEA"] == 0
    assert out[0]["poids_analytique"] == 5.0 and out[0]["v445"] == 23.0
    assert out[1]["h2"] == 9           # null -> the rule's target code


def test_q4_sentinels_before_rescaling(spark):
    # a raw haemoglobin sentinel 9996 must not survive as 999.6 after the /10 (rule Q4)
    rows = [(0, 10, 10, 10, 2000.0, 9996.0, 1, 1e6, 1), (0, 10, 10, 10, 2000.0, 120.0, 1, 1e6, 1)]
    df = spark.createDataFrame(rows, "hw13 int, hw5 int, hw8 int, hw11 int, v445 double, v438 double, v025 int, "
                                     "v005 double, h2 int")
    out = [r.v438 for r in C.clean_survey(df).collect()]
    assert out == [12.0]


def test_stage_counts_come_from_the_plan_itself(spark, tmp_path):
    from surveyspark.operators import aggregate as A
    rows = [(0, -250, 10, -300, 2300.0, 120.0, 1, 5000000.0, 8), (1, 0, 0, 0, 2000.0, 110.0, 1, 1000000.0, 1),
            (0, 9999, 0, 0, 2000.0, 110.0, 1, 1000000.0, 2), (0, 5, 5, 5, 9998.0, 110.0, 1, 1000000.0, 2)]
    watch = A.StageCounts(spark)
    df = watch.spark.createDataFrame(rows, "hw13 int, hw5 int, hw8 int, hw11 int, v445 double, v438 double, v025 int, v005 double, h2 int")
    C.clean_survey(df, watch).write.parquet(f"file://{tmp_path}/out")
    assert [(r.stage, r.n_rows) for r in watch.table(spark).collect()] == [("raw", 4), ("valid", 3), ("anthropometry", 2), ("continuous", 1), ("clean", 1)]


def test_every_categorical_field_has_a_rule(spark):
    from surveyspark.functions import fixed_values as FV
    assert set(FV.CATEGORICAL_FIELDS) <= set(FV.MISSING_RULES)
    df = spark.createDataFrame([(8, 9, None), (12, 1, 8)], "v024 int, v025 int, m18 int")
    out = C.collapse_missing(df, ["v024", "v025", "m18"]).collect()
    assert [tuple(r) for r in out] == [(8, 9, 9), (12, 1, 9)]          # region 8 is a region
