"""STR-2: the evolution of the score within each session, as arbitrary state with event-time timers.

Per session the state holds running totals and the events that may still be overtaken by earlier ones. A
timer at the time of the first of them releases the events that the watermark has passed, in event-time order, each with
its number in the session and the totals so far; so late events within the delay still get their place. A
session that stays silent for ``idle`` is forgotten: its next event starts a new series.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: events wait packed, one value for the events of a session that came together: a state value for each of them
#: took most of the time
EVENT = np.dtype([("at", "i8"), ("tie", "i8"), ("alert", "i4"), ("score", "f8")])
TOTALS = "n long, alerts long, sum double, last long"
#: the released events leave packed as well and are unpacked a batch of sessions at a time
SERIES = np.dtype([("n", "i8"), ("at", "i8"), ("alert", "i4"), ("score", "f8"), ("alerts", "i8"), ("mean_score", "f8")])
OUTPUT = ["n long", "at long", "alert int", "score double", "alerts long", "mean_score double"]
CHUNK = 65_536          #: events in one packed value at most


class SessionEvolution(StatefulProcessor):
    """Totals and not yet final events of one session; times are microseconds, timers milliseconds."""

    def __init__(self, key: str, idle_ms: int):
        self.key, self.idle_ms = key, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", TOTALS)
        self.waiting = handle.getListState("waiting", "events binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            events = np.frombuffer(b"".join(pdf["event"].tolist()), EVENT)
            self.waiting.appendList([(events[i:i + CHUNK].tobytes(),) for i in range(0, len(events), CHUNK)])
            at = int(events["at"].min())
            first = at if first is None else min(first, at)
        # the first of the events has the timer: it releases all that the watermark has passed and asks for the next one
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        kept = [bytes(blob) for blob, in self.waiting.get()]
        waiting = np.frombuffer(b"".join(kept), EVENT)
        waiting = waiting[np.lexsort([waiting[c] for c in reversed(EVENT.names)])]
        # event times are sorted: those whose timer is due come first
        ready, later = np.split(waiting, [np.searchsorted(waiting["at"] // 1000 + 1, mark, side="right")])
        n, alerts, total, last = self.totals.get() or (0, 0, 0.0, 0)
        out = np.empty(len(ready), SERIES)
        if len(ready):
            for c in ("at", "alert", "score"):
                out[c] = ready[c]
            silent = np.diff(ready["at"], prepend=last if n else ready["at"][0]) > self.idle_ms * 1000
            starts = np.flatnonzero(silent).tolist()
            for i, j in zip([0, *starts], [*starts, len(ready)]):
                if i in starts:
                    n, alerts, total = 0, 0, 0.0
                if i == j:              # the first event already starts a new series
                    continue
                part = out[i:j]
                part["n"] = n + np.arange(1, j - i + 1)
                part["alerts"] = alerts + np.cumsum(part["alert"], dtype=np.int64)
                sums = np.cumsum(np.concatenate([[total], part["score"]]))[1:]
                part["mean_score"] = sums / part["n"]
                n, alerts, total, last = int(part["n"][-1]), int(part["alerts"][-1]), float(sums[-1]), int(part["at"][-1])
        if len(later):
            if len(ready) or len(kept) > 1:
                self.waiting.put([(later[i:i + CHUNK].tobytes(),) for i in range(0, len(later), CHUNK)])
            self.handle.registerTimer(int(later["at"][0]) // 1000 + 1)
        elif kept:
            self.waiting.clear()
        if n and not len(later) and last // 1000 + self.idle_ms < mark:
            self.totals.clear()
        elif len(ready):
            self.totals.update((n, alerts, total, last))
            self.handle.registerTimer(last // 1000 + self.idle_ms + 1)
        series = [out[i:i + CHUNK].tobytes() for i in range(0, len(out), CHUNK)]
        return iter([pd.DataFrame({self.key: [key[0]] * len(series), "series": series})] if series else ())

    def close(self) -> None:
        pass


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """session, _ts and the event's columns -> session, _ts, event."""
    for batch in batches:
        events = np.empty(batch.num_rows, EVENT)
        for c in EVENT.names:
            col = batch.column(batch.schema.get_field_index(c))
            if col.null_count and c != "score":
                raise ValueError(f"an event without {c}")
            events[c] = col.to_numpy(zero_copy_only=False)
        offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * EVENT.itemsize
        packed = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(events.tobytes())])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], names=[*batch.schema.names[:2], "event"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """session, series -> one row per event."""
    for batch in batches:
        for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
            blobs = part.column(1).to_pylist()
            series = np.frombuffer(b"".join(blobs), SERIES)
            of = np.repeat(np.arange(len(blobs)), [len(b) // SERIES.itemsize for b in blobs])
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of)), *[pa.array(np.ascontiguousarray(series[c])) for c in SERIES.names]],
                                             names=[part.schema.names[0], *SERIES.names])


def score_evolution(stream: DataFrame, ts: str, session: str, alert: str, score: str, tie: str, delay: str = "1 hour",
                    idle: str = "30 days") -> DataFrame:
    """session, n, at, alert, score, alerts, mean_score: every final event with its place in the session and the totals so far.

    ``tie`` orders events of one instant. Null sessions and times are left out, since neither has a place in a series.
    """
    spark = stream.sparkSession
    spark.conf.set(PROVIDER, ROCKSDB)
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    t = F.col(ts).cast("timestamp")
    rows = stream.select(F.col(session).alias(session), t.alias("_ts"), F.unix_micros(t).alias("at"), F.col(tie).cast("long").alias("tie"),
                         F.col(alert).cast("int").alias("alert"), F.col(score).cast("double").alias("score"))
    kind = stream.schema[session].dataType.simpleString()
    rows = rows.where(F.col(session).isNotNull() & F.col("_ts").isNotNull()).mapInArrow(_packed, f"{session} {kind}, _ts timestamp, event binary")
    packed = rows.withWatermark("_ts", delay).groupBy(session).transformWithStateInPandas(
        SessionEvolution(session, idle_ms), f"{session} {kind}, series binary", outputMode="Append", timeMode="EventTime")
    out = packed.mapInArrow(_unpacked, f"{session} {kind}, " + ", ".join(OUTPUT))
    return out.withColumn("at", F.timestamp_micros("at"))


__all__ = ["SessionEvolution", "score_evolution"]
