"""Streams whose rows count in an order: a stateful operator that puts a group's rows in order before it folds over them.

A group's rows of a micro-batch come in several Arrow frames in the order of the shuffle, so sorting a frame orders nothing. Here the rows wait in
a list state. Without event time they are put in order and folded once all frames of the batch are there; with it they wait
until the watermark has passed them, so rows that come batches late still count in their place, and timers release them. What stays between
batches is the fold's state and the rows not yet due. Needs the RocksDB state store, which in_order() turns on for its session."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _InOrder(StatefulProcessor):
    """step(state, row) -> (state, output) over a group's rows in their order; state is None at first."""

    def __init__(self, row: T.StructType, order: list[str], state: T.StructType, output: T.StructType, step: Callable, due: str | None):
        self._row, self._order, self._state, self._output, self._step, self._due = row, [row.names.index(c) for c in order], state, output, step, due

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._waiting = handle.getListState("waiting", self._row)
        self._folded = handle.getValueState("folded", self._state)
        self._timer = handle.getValueState("timer", "at long")

    def _fold(self, key: tuple, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            # Nulls first; rows alike in the order keep that of their other columns, so that nothing depends on how they arrived.
            said = lambda r, places: tuple((r[k] is not None, r[k] if r[k] is not None else 0) for k in places)
            rows.sort(key=lambda r: (said(r, self._order), tuple((v is not None, str(v)) for v in r)))
            state, out = self._folded.get() if self._folded.exists() else None, []
            for r in rows:
                state, made = self._step(state, dict(zip(self._row.names, r, strict=True)))
                out.append((*key, *made))
            self._folded.update(tuple(state))
            yield pd.DataFrame(out, columns=self._output.names, dtype=object)

    def _wait(self, rows: list[tuple], due: int) -> None:
        """Keeps rows for later: one timer a group, at the earliest of them."""
        if rows:
            self._waiting.put(rows)
        else:
            self._waiting.clear()
        at = min((max(_millis(r[due]), 0) for r in rows), default=None)
        was = self._timer.get()[0] if self._timer.exists() else None
        if at != was:
            if was is not None:
                self._handle.deleteTimer(was)
            if at is None:
                self._timer.clear()
            else:
                self._handle.registerTimer(at)
                self._timer.update((at,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        here = [r for t in rows for r in _values(t[self._row.names])]
        if self._due is None:
            yield from self._fold(key, here)
            return
        due, watermark = self._row.names.index(self._due), timerValues.getCurrentWatermarkInMs()
        # Without a time a row can't wait; one that the watermark has passed is dropped by Spark before it comes here.
        now = [r for r in here if r[due] is None]
        yield from self._fold(key, now)
        waiting = [tuple(r) for r in self._waiting.get()] + [r for r in here if r[due] is not None]
        yield from self._release(key, waiting, due, watermark)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._timer.clear()
        due = self._row.names.index(self._due)
        yield from self._release(key, [tuple(r) for r in self._waiting.get()], due, timerValues.getCurrentWatermarkInMs())

    def _release(self, key: tuple, rows: list[tuple], due: int, watermark: int) -> Iterator[pd.DataFrame]:
        yield from self._fold(key, [r for r in rows if _millis(r[due]) <= watermark])
        self._wait([r for r in rows if _millis(r[due]) > watermark], due)

    def close(self) -> None:
        pass


def _millis(t) -> int:
    return int(pd.Timestamp(t).value // 1_000_000)


def _values(t: pd.DataFrame) -> list[tuple]:
    """Rows of plain Python values, None for what is missing."""
    plain = lambda v: None if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v) else v.to_pydatetime() if isinstance(v, pd.Timestamp) else v.item() if hasattr(v, "item") else v
    return [tuple(map(plain, r)) for r in zip(*(t[c].tolist() for c in t.columns), strict=True)]


def in_order(stream: DataFrame, group: str, columns: list[str], order: list[str], state: str, output: str, step: Callable, time: str | None = None, late: str = "0 seconds") -> DataFrame:
    """output's columns, the group's first, of step() over each group's rows in their order.

    time: a column of timestamps by which rows may be up to `late` late; rows wait until the watermark has passed them. Without it
    the order holds within each micro-batch, over all its frames."""
    columns = [*columns, *({time} - {*columns, None})]
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    row = T.StructType([T.StructField(f.name, f.dataType, True) for f in stream.select(*columns).schema.fields])
    schema = [T.StructType.fromDDL(x) for x in (state, output)]
    rows = stream.withWatermark(time, late) if time else stream
    made = _InOrder(row, order, *schema, step, time)
    return rows.select(group, *columns).groupBy(group).transformWithStateInPandas(made, schema[1], "Append", "EventTime" if time else "None")
