import hashlib
import math

from pyspark.sql import functions as F

from surveyspark.operators import split as SP


def _clusters(spark):
    # 10 clusters of very different sizes, one holding half the rows
    rows = [(0, i) for i in range(500)] + [(c, i) for c in range(1, 10) for i in range(c * 10)]
    return spark.createDataFrame(rows, "cluster int, i int")


def _md5(s):
    return hashlib.md5(s.encode()).hexdigest()


def test_group_split_matches_brute_force(spark):
    st = {r.cluster: r.split for r in SP.group_split(_clusters(spark), "cluster", 0.2, 2018).collect()}
    order = sorted(range(10), key=lambda c: _md5(f"2018:{c}"))
    k = math.ceil(0.2 * 10)
    assert {c for c, s in st.items() if s == "test"} == set(order[:k])


def test_three_way_disjoint_and_complete(spark):
    df = _clusters(spark)
    st = SP.three_way_split(df, "cluster")
    rows = st.collect()
    assert len(rows) == 10 and len({r.cluster for r in rows}) == 10
    assert {r.split for r in rows} <= {"train", "test", "stress"}


def test_hash_rank_equals_row_number(spark):
    from pyspark.sql import Window
    df = _clusters(spark).withColumn("h", SP.seeded_hash(5, F.concat_ws("|", "cluster", "i")))
    a = SP.hash_rank(df, "h", ["cluster"], digits=1, out="r1")
    b = a.withColumn("r2", F.row_number().over(Window.partitionBy("cluster").orderBy("h")))
    assert b.where(F.col("r1") != F.col("r2")).count() == 0


def test_group_kfold_keeps_clusters_and_balances(spark):
    f = SP.group_kfold(_clusters(spark), "cluster", 3).collect()
    assert len(f) == 10 and {r.fold for r in f} == {0, 1, 2}


def test_sample_n_is_smallest_hash(spark):
    df = _clusters(spark)
    got = sorted((r.cluster, r.i) for r in SP.sample_n(df, 7, 42, ["cluster", "i"], digits=1).collect())
    allr = [(r.cluster, r.i) for r in df.collect()]
    exp = sorted(sorted(allr, key=lambda t: _md5(f"42:{t[0]}|{t[1]}"))[:7])
    assert got == exp


def test_fraction_ladder_nests(spark):
    lad = SP.fraction_ladder(_clusters(spark), [0.2, 0.5, 1.0], 3, ["cluster", "i"])
    sets = {s: {(r.cluster, r.i) for r in lad.where(F.col("size") == s).collect()} for s in (0.2, 0.5, 1.0)}
    assert sets[0.2] <= sets[0.5] <= sets[1.0] and len(sets[1.0]) == 950


def test_stratified_folds_balanced(spark):
    df = _clusters(spark).withColumn("y", (F.col("i") % 3 == 0).cast("int"))
    f = SP.stratified_kfold(df, "y", ["cluster", "i"], 3)
    c = {(r.y, r.fold): r["count"] for r in f.groupBy("y", "fold").count().collect()}
    for y in (0, 1):
        v = [c[(y, k)] for k in range(3)]
        assert max(v) - min(v) <= 1


def test_sequence_equals_row_number(spark):
    from pyspark.sql import Window
    from surveyspark.operators.aggregate import sequence
    rows = [(0 if i % 3 else 1, float(i % 17), i) for i in range(600)]   # one session holds two thirds
    df = spark.createDataFrame(rows, "s int, t double, id int")
    a = sequence(df, "s", ["t", "id"], hot_rows=50)      # session 0 is hot: sliced
    b = a.withColumn("rn", F.row_number().over(Window.partitionBy("s").orderBy("t", "id")))
    assert b.where(F.col("seq") != F.col("rn")).count() == 0


def test_null_keys_are_groups(spark):
    """Null strata, groups and sessions keep their rows; null order values come first at every slice size."""
    from pyspark.sql import Window
    from surveyspark.operators import aggregate as A
    from surveyspark.operators import evaluate as EV
    rows = [(None if i % 5 == 0 else i % 3, i, None if i % 7 == 0 else float(i % 11)) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, i int, t double")
    assert SP.stratified_kfold(df, "k", "i", 3).count() == 200
    assert SP.sample_n(df, 1000, 1, "i", ["k"]).count() == 200
    assert SP.sample_n(df, 2, 1, "i", ["k"]).count() == 8
    share = A.share_of_total(df.groupBy("k", "t").count(), "count", ["k"])
    assert abs(share.agg(F.sum("pct")).first()[0] - 400.0) < 1e-9
    want = {(r.k, r.i): r.rn for r in df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("t", "i"))).collect()}
    for hot in (20, 100_000):
        got = A.sequence(df, "k", ["t", "i"], hot_rows=hot).collect()
        assert {(r.k, r.i): r.seq for r in got} == want and len(got) == 200
    scored = df.selectExpr("k", "cast(i % 2 as int) as y", "i / 200.0 as p", "cast(i % 3 = 0 as int) as yhat")
    assert EV.weighted_auc(scored, "y", "p", by=["k"]).count() == 4
    assert EV.roc_points(scored, "y", "p", by=["k"]).count() == 200
    assert abs(EV.confusion(scored, "y", "yhat", by=["k"]).agg(F.sum("share")).first()[0] - 8.0) < 1e-9


def test_null_strata_get_their_median(spark):
    from surveyspark.operators import clean as C
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), (None, None), (1, 10.0), (1, None)], "k int, x double")
    got = sorted((r.k is None, r.x) for r in C.impute_median(df, ["x"], ["k"]).collect())
    assert got == [(False, 10.0), (False, 10.0), (True, 1.0), (True, 2.0), (True, 3.0)]
