import duckdb
import pytest

import __spark_entry__ as E
import corpus_pipeline

SMOKE = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


def test_one_query_for_each_operator_and_the_pipeline():
    names = list(E.queries())
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and [s[0] for s in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "pii", "mixing", "sentencepiece"]


@pytest.mark.parametrize("name", ["op2_topk_search", "op10_chat_format"])
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    want = con.execute(E.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = E.queries()[name](spark, SMOKE)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(want.fetchall())


def test_pipeline_stages_take_what_the_one_before_kept(ready, odd_docs):
    docs = odd_docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(ready, docs, SMOKE)
        assert out.columns == odd_docs.columns, name
        docs = ready.createDataFrame(out.collect(), out.schema)
    kept = {r["doc_id"] for r in docs.collect()}
    assert 2 not in kept and not kept & {3, 4, 5, 8}
    assert corpus_pipeline.STAGES[-1][1](ready, docs, SMOKE).filter("not round_trip").count() == 0


def test_pipeline_runs(spark):
    assert corpus_pipeline.run(spark, SMOKE).count() > 100
