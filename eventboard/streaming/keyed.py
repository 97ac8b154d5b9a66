"""Freshness of a stream by keyed state: one last good record per source, rows in event-time order.

A source's state is its last good record, the rows that the watermark has not passed yet, and one event-time timer. Rows
wait until the watermark passes them, so rows that come late, by no more than the delay, are resolved in their own place
and the result is that of the batch operator. A batch touches the state of the sources it has rows of and of those whose
timer fires, nothing else. Rows behind the watermark are handed on at once, marked ``late``: with the last good record if
that is older than the row, else without one, and they never move it.

A source's waiting rows are sorted in one task when their timer fires: what one source sends within the delay has to fit
there. For a source beyond that, ``resolve_history`` over the stored observations has no such limit.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from eventboard.operators import resolve as rs
from eventboard.schemas import KEY

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Records travel through the state as text; instants keep their microseconds.
_JSON = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
OUT = "source_id string, event_type string, event_time timestamp, late boolean, row string, lkg string"


class KeyedFreshness(StatefulProcessor):
    """Hands every row on with the record that was last good at its time, once the watermark has passed it.

    Every look at the state is a round trip to the JVM, so a value is asked for once, and written only if it changed.
    """

    def __init__(self, tie: str):
        self.tie = tie

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.good = handle.getValueState("good", "at long, record string")
        self.waiting = handle.getListState("waiting", f"at long, tie {self.tie}, record string, row string")
        self.wake = handle.getValueState("wake", "at long")

    def _wake_at(self, micros: int) -> None:
        """The key's only timer, at the first instant that waits."""
        millis = -(-micros // 1_000)
        set_to = self.wake.get()
        if set_to is not None:
            if set_to[0] <= millis:
                return
            self.handle.deleteTimer(set_to[0])
        self.handle.registerTimer(millis)
        self.wake.update((millis,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [
            (int(at), tie, None if pd.isna(record) else record, row)
            for part in rows
            for at, tie, record, row in zip(part["at"], part["tie"].tolist(), part["record"], part["row"], strict=True)
            if row is not None
        ]
        passed = timerValues.getCurrentWatermarkInMs() * 1_000
        due = [r for r in new if r[0] > passed]
        if due:
            self.waiting.appendList(due)
            self._wake_at(min(r[0] for r in due))
        late = [r for r in new if r[0] <= passed]
        if late:
            good = self.good.get()
            known = [good[1] if good is not None and good[0] <= r[0] else None for r in late]
            # A good row is its own last good record.
            yield self._frame([(*key, r[0], True, r[3], r[2] if r[2] is not None else k) for r, k in zip(late, known, strict=True)])

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["source_id", "event_type", "event_time", "late", "row", "lkg"])
        return out.assign(event_time=pd.to_datetime(out["event_time"], unit="us"))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1_000
        ready, rest = [], []
        for r in self.waiting.get():
            (ready if r[0] <= passed else rest).append(tuple(r))
        ready.sort(key=lambda r: (r[0], r[1] is not None, r[1]))
        known_before = good = self.good.get()
        out = []
        for at, _, record, row in ready:
            if record is not None and (good is None or good[0] <= at):
                good = (at, record)
            known = good[1] if good is not None and good[0] <= at else record
            out.append((*key, at, False, row, known))
        if good is not known_before:
            self.good.update((good[0], good[1]))
        self.wake.clear()
        if rest:
            self.waiting.put(rest)
            self._wake_at(min(r[0] for r in rest))
        else:
            self.waiting.clear()
        if out:
            yield self._frame(out)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        newest = initialState.loc[initialState["at"].idxmax()]
        self.good.update((int(newest["at"]), newest["record"]))

    def close(self) -> None:
        pass


def _order(tie: T.DataType) -> str:
    return "long" if isinstance(tie, T.IntegralType) else "double" if isinstance(tie, T.NumericType) else "string"


def resolved(
    obs: DataFrame, delay: str, tie: str = "run_id", keep: list[str] | None = None, seed: DataFrame | None = None
) -> DataFrame:
    """A stream of observations as a stream of live rows, each once the watermark has passed it.

    ``delay`` is how late a row may come. An observation without ``ok`` is a heartbeat: it moves the watermark and is
    not handed on. ``seed`` is the last-known-good table to start from. ``event_time`` carries the watermark on, ``late``
    marks rows that came behind it.
    """
    obs.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package installed
    micros = F.unix_micros(F.col("fetched_at").cast("timestamp")).alias("at")
    order = _order(obs.schema[tie].dataType)
    record = F.to_json(rs.good_record(), _JSON)
    marked = obs.withColumn("event_time", F.col("fetched_at").cast("timestamp")).withWatermark("event_time", delay)
    # A heartbeat is told apart inside the processor: a filter here would move below the watermark.
    rows = marked.select(
        *KEY, "event_time", micros, F.col(tie).cast(order).alias("tie"), F.when(F.col("ok"), record).alias("record"),
        F.when(F.col("ok").isNotNull(), F.to_json(F.struct(*obs.columns), _JSON)).alias("row"),
    )
    start = None
    if seed is not None:
        fresh = seed.filter(F.col("status") == "fresh")
        start = fresh.select(*KEY, micros, record.alias("record")).groupBy(*KEY)
    out = rows.groupBy(*KEY).transformWithStateInPandas(
        KeyedFreshness(order), OUT, "Append", "EventTime", initialState=start, eventTimeColumnName="event_time"
    )
    lkg = f"struct<{','.join(f'{f.name}:{f.dataType.simpleString()}' for f in obs.select(rs.good_record().alias('g')).schema['g'].dataType.fields)}>"
    read = out.select("event_time", "late", F.from_json("row", obs.schema, _JSON).alias("r"), F.from_json("lkg", lkg, _JSON).alias("lkg"))
    return rs.settle(read.select("event_time", "late", "r.*", "lkg"), ["event_time", "late", *(keep or [])])


def health_stream(live: DataFrame, span: str, limit: float = 0.5) -> DataFrame:
    """Summary, failure ratio and verdict of every run, once the watermark has passed the run's ``span`` of time.

    ``live`` is what ``resolved`` returns. A run's rows must lie in one span (a day, if runs are daily). A closed run
    stays as it is: rows marked ``late`` are left out, ``run_summary`` over the stored ones counts them apart.
    """
    windowed = live.filter("NOT late").groupBy(F.window("event_time", span).alias("span"), "run_id")
    return rs.with_verdict(windowed.agg(*rs.status_counts()).drop("span"), limit)


def write_stream(live: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Live rows of a stream appended to ``path``, each exactly once."""
    writer = live.writeStream.format("parquet").outputMode("append")
    return writer.option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
