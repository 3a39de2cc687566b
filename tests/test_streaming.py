import os

import pytest
from pyspark.sql import functions as F

from surveyspark.streaming import scoring as ST

SMOKE = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark):
    p = os.path.join(SMOKE, "events.parquet")
    if not os.path.exists(p):
        pytest.skip("no test data")
    ev = spark.read.parquet(p)
    stream = ST.read_stream(spark, p, ev.schema)
    prep = lambda d: d.withColumn("y", (F.col("event_type") == "error").cast("int"))
    k = ST.history_kpis(prep(stream), "ts", "user_id", "y", "value", "1 day", "1 hour")
    sink, ck = ST.stream_paths(spark, "t")
    ST.run_to_sink(k, sink, ck)
    got = {(str(r.window_start), r.user_id, r.total) for r in spark.read.parquet(sink).collect()}
    wm = ev.agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    b = prep(ev).withColumn("_ts", F.col("ts").cast("timestamp")).groupBy(F.window("_ts", "1 day").alias("w"), "user_id") \
        .agg(F.count(F.lit(1)).alias("total"))
    import datetime
    exp = {(str(r.w.start), r.user_id, r.total) for r in b.collect() if r.w.end <= wm - datetime.timedelta(hours=1)}
    assert got == exp and len(got) > 0


def test_score_series_with_late_events(spark, tmp_path):
    """Late events within the delay take their place, in more than one batch; a silent session starts anew."""
    from surveyspark.streaming.evolution import score_evolution
    schema = "id long, t timestamp, s string, y int, p double"
    batches = [[(1, "2024-01-01 10:00:00", "a", 1, 0.5), (2, "2024-01-01 10:30:00", "a", 0, 0.1), (3, "2024-01-01 10:30:00", None, 0, 0.1)],
               [(4, "2024-01-01 10:10:00", "a", 1, 0.9), (5, "2024-01-01 10:20:00", "b", 0, 0.2), (6, None, "b", 0, 0.2)],
               [(7, "2024-01-03 10:00:00", "a", 1, 0.7), (8, "2024-01-05 10:00:00", "c", 1, 0.3)]]
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "id long, t string, s string, y int, p double").withColumn("t", F.col("t").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = ST.read_stream(spark, f"file://{tmp_path}/in", spark.createDataFrame([], schema).schema, max_files=1)
    sink, ck = ST.stream_paths(spark, "series")
    ST.run_to_sink(score_evolution(stream, "t", "s", "y", "p", "id", "1 hour", "1 day"), sink, ck)
    got = sorted((r.s, str(r.at), r.n, r.alerts, round(r.mean_score, 6)) for r in spark.read.parquet(sink).collect())
    assert got == [("a", "2024-01-01 10:00:00", 1, 1, 0.5), ("a", "2024-01-01 10:10:00", 2, 2, 0.7), ("a", "2024-01-01 10:30:00", 3, 2, 0.5),
                   ("a", "2024-01-03 10:00:00", 1, 1, 0.7), ("b", "2024-01-01 10:20:00", 1, 0, 0.2)]


def test_events_that_come_together_are_one_state_value():
    """A state value, a timer and a row of output for each event took most of the time; silence starts a new series."""
    import datetime
    from types import SimpleNamespace

    import pandas as pd
    import pyarrow as pa

    from surveyspark.streaming import evolution as E

    class Value:
        kept = None

        def get(self):
            return self.kept

        def update(self, v):
            self.kept = v

        def clear(self):
            self.kept = None

    class Listed(Value):
        def get(self):
            return iter(self.kept or [])

        def put(self, v):
            self.kept = v

        def appendList(self, v):
            self.kept = [*(self.kept or []), *v]

    timers, totals, waiting = [], Value(), Listed()
    proc = E.SessionEvolution("s", idle_ms=1000)
    proc.init(SimpleNamespace(getValueState=lambda *_: totals, getListState=lambda *_: waiting, registerTimer=timers.append))
    at = [5_000_000, 1_000_000, 1_500_000, 9_000_000, 1_500_000]
    batch = pa.RecordBatch.from_pydict({"s": ["a"] * 5, "_ts": [datetime.datetime(2024, 1, 1)] * 5, "at": pa.array(at, pa.int64()),
                                        "tie": pa.array([1, 2, 9, 4, 3], pa.int64()), "alert": pa.array([1, 1, 0, 1, 1], pa.int32()),
                                        "score": [0.5, 0.25, 0.75, 1.0, 0.5]})
    packed = pa.Table.from_batches(E._packed([batch])).to_pandas()
    assert not list(proc.handleInputRows(("a",), iter([packed]), None))
    assert len(waiting.kept) == 1 and timers == [1001]
    found = pd.concat(proc.handleExpiredTimer(("a",), SimpleNamespace(getCurrentWatermarkInMs=lambda: 6000), None))
    assert len(found) == 1 and timers[1:] == [9001, 6001]
    rows = pa.Table.from_batches(E._unpacked(pa.Table.from_pandas(found, preserve_index=False).to_batches())).to_pylist()
    assert [(r["n"], r["at"], r["alert"], r["alerts"], r["mean_score"]) for r in rows] == [
        (1, 1_000_000, 1, 1, 0.25), (2, 1_500_000, 1, 2, 0.375), (3, 1_500_000, 0, 2, 0.5), (1, 5_000_000, 1, 1, 0.5)]
    assert totals.kept == (1, 1, 0.5, 5_000_000) and len(waiting.kept) == 1
    with pytest.raises(ValueError):
        list(E._packed([batch.set_column(3, "tie", pa.array([None] * 5, pa.int64()))]))
