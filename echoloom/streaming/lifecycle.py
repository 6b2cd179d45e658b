"""Lifecycle alerts as streams with timers: an alert is due by itself, and no state outlives its timer.

State and timers are Spark's ``transformWithState``, which keeps them in RocksDB: the session needs
``spark.sql.streaming.stateStore.providerClass`` set to ``PROVIDER``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY = 86_400_000
#: Kinds of rows that ``revivals`` reads; rows of other kinds count as no evidence.
EVIDENCE, DISMISSED, REFUSED, REVIVED = "evidence", "dismissed", "refused", "revived"


class _Staleness(StatefulProcessor):
    """State of a key: its newest status and when it came; one timer, ``span`` milliseconds later."""

    def __init__(self, watched: tuple[str, ...], span: int):
        self.watched, self.span = watched, span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "at long, status string")

    def _stale(self, key: tuple, at: int, status: str) -> Iterator[Row]:
        if status in self.watched:
            yield Row(key=key[0], status=status, at=at, due=at + self.span)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        at, status = self.newest.get() if self.newest.exists() else (None, None)
        for row in sorted((r["_at"], r["_status"]) for r in rows):
            if at is not None and row < (at, status):
                continue
            if at is not None and row[0] > at + self.span:  # due before this row came
                yield from self._stale(key, at, status)
            at, status = row
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.newest.update((at, status))
        self.handle.registerTimer(at + self.span)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at, status = self.newest.get()
        self.newest.clear()
        yield from self._stale(key, at, status)

    def close(self) -> None:
        pass


class _Revival(StatefulProcessor):
    """State of a key: evidence so far, baseline, whether it is dismissed, whether an alert waits for an answer, newest time."""

    def __init__(self, factor: int, keep: int):
        self.factor, self.keep = factor, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "total long, base long, dismissed boolean, waiting boolean, newest long")

    def _store(self, state: tuple) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.state.update(state)
        self.handle.registerTimer(state[-1] + self.keep)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._store((initialState["total"], initialState["base"], initialState["dismissed"], False, initialState["_at"]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        total, base, dismissed, waiting, newest = self.state.get() if self.state.exists() else (0, 0, False, False, 0)
        for at, kind, n in sorted((r["_at"], r["_kind"], r["_n"]) for r in rows):
            newest = max(newest, at)
            if kind == EVIDENCE:
                total += n
            elif kind == DISMISSED:
                base, dismissed, waiting = total, True, False
            elif kind == REFUSED:
                base, waiting = max(base, total), False
            elif kind == REVIVED:
                dismissed = waiting = False
            if dismissed and not waiting and base > 0 and total >= self.factor * base:
                waiting = True
                yield Row(key=key[0], event="revive", total=total, base=base, at=at)
        self._store((total, base, dismissed, waiting, newest))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        total, base, dismissed, _, newest = self.state.get()
        self.state.clear()
        if dismissed:
            yield Row(key=key[0], event="archived", total=total, base=base, at=newest)

    def close(self) -> None:
        pass


def _timed(stream: DataFrame, time_col: str, late: str) -> DataFrame:
    held = stream.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass", "")
    if not held.endswith("RocksDBStateStoreProvider"):
        raise RuntimeError(f"timers need spark.sql.streaming.stateStore.providerClass = {PROVIDER}")
    return stream.withColumn(time_col, F.col(time_col).cast("timestamp")).where(F.col(time_col).isNotNull()).withWatermark(time_col, late)


def stale_items(stream: DataFrame, key: str, time_col: str, status: str, watched: tuple[str, ...], days: int = 56, late: str = "1 day", clock: str = "eventtime") -> DataFrame:
    """(key, status, updated, due): items in a watched status that had no update for ``days``, once for each such pause.

    By the clock of the events an item is due as the watermark (newest time of any key, less ``late``) passes; with ``clock``
    "processingtime" by that of the wall, without any further row. A pause that ends inside one batch is told like one between
    batches, so the cut of the batches does not matter. An update of another status starts the pause anew; a null status is none
    of the watched; of updates at one time the largest status counts. Rows without time are left out, and so are, by the clock of
    the events, rows behind the watermark. A key's state is gone with its timer.
    """
    kind = dict(stream.dtypes)[key]
    rows = _timed(stream, time_col, late).select(F.col(key).alias("key"), time_col, F.unix_millis(time_col).alias("_at"), F.coalesce(status, F.lit("")).alias("_status"))
    found = rows.groupBy("key").transformWithState(_Staleness(tuple(watched), days * DAY), f"key {kind}, status string, at long, due long", "append", clock)
    return found.select(F.col("key").alias(key), "status", F.timestamp_millis("at").alias("updated"), F.timestamp_millis("due").alias("due"))


def revivals(stream: DataFrame, key: str, time_col: str, kind_col: str, n_col: str, factor: int = 3, keep_days: int = 730, late: str = "1 day", initial: DataFrame | None = None) -> DataFrame:
    """(key, event, total, base, at): "revive" once a dismissed item's evidence reaches ``factor`` times its baseline.

    The baseline is the evidence at the last dismissal; a refusal raises it to the evidence of that moment. While an alert waits
    for its answer no second one comes. Rows are taken by time inside a batch, batches as they come; a null number counts zero.
    ``initial`` (key, total, base, dismissed, and the time column) is where counting starts, as the batch's recount gives it. A key
    without a row for ``keep_days`` leaves the state; if it is dismissed, an "archived" row with its numbers goes out, from which
    it can be an initial row again.
    """
    kind = dict(stream.dtypes)[key]
    rows = _timed(stream, time_col, late).select(F.col(key).alias("key"), time_col, F.unix_millis(time_col).alias("_at"), F.coalesce(kind_col, F.lit("")).alias("_kind"), F.coalesce(F.col(n_col).cast("long"), F.lit(0)).alias("_n"))
    start = None
    if initial is not None:
        start = initial.select(F.col(key).alias("key"), F.col("total").cast("long"), F.col("base").cast("long"), "dismissed", F.unix_millis(F.col(time_col).cast("timestamp")).alias("_at")).groupBy("key")
    found = rows.groupBy("key").transformWithState(_Revival(factor, keep_days * DAY), f"key {kind}, event string, total long, base long, at long", "append", "eventtime", start)
    return found.select(F.col("key").alias(key), "event", "total", "base", F.timestamp_millis("at").alias("at"))
