import os

import duckdb
import pytest

import __spark_entry__ as E
from surveyspark.plans.tables import TABLES

SMOKE = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "weighted_rate" in df.columns


def test_every_sql_has_a_query():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q) and len(q) >= 140


@pytest.mark.parametrize("name", ["agg10_rate_by_region", "agg03_profile_discrete", "evl01_weighted_auc",
                                  "fea02_target_encode", "scr02_score_batch", "spl02_three_way_split",
                                  "drv17_influence_factors", "str02_history_kpis"])
def test_oracle_match_small(spark, name):
    if not os.path.isdir(SMOKE):
        pytest.skip("no test data")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    sdf = E.queries()[name](spark, SMOKE)
    rel = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in rel.description]
    assert sorted(sdf.columns) == sorted(dcols)

    def norm(rows, cols):
        order = sorted(range(len(cols)), key=lambda i: cols[i])
        return sorted(tuple(round(v, 6) if isinstance(v, float) else (str(v) if v is not None else None)
                            for v in (r[i] for i in order)) for r in rows)
    assert norm([tuple(r) for r in sdf.collect()], sdf.columns) == norm(rel.fetchall(), dcols)
