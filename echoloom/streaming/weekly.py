"""Structured Streaming forms of the weekly batch: late rows within a watermark, ISO-week counts, idempotent upserts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.write import upsert


def deduplicated(stream: DataFrame, time_col: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark. Parquet timestamps without zone are cast, as watermarks need one."""
    return stream.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, late).dropDuplicatesWithinWatermark(keys)


def weekly_counts(stream: DataFrame, time_col: str, by: list[str]) -> DataFrame:
    """Rows and sum of ``value`` by ISO week (windows begin on Mondays) and ``by``."""
    week = F.window(time_col, "7 days", "7 days", "4 days")
    return stream.groupBy(week, *by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("week_start"), *by, "n", "total")


def upsert_sink(load: Callable[[], DataFrame | None], store: Callable[[DataFrame, int], None], keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: each batch is upserted by key, so a batch that comes again changes nothing."""

    def write(batch: DataFrame, epoch: int) -> None:
        rows, old = batch.dropDuplicates(keys), load()
        store(rows if old is None else upsert(old, rows, keys), epoch)

    return write


def rolling_counts(stream: DataFrame, time_col: str, by: list[str], days: int = 60, step: str = "1 day", late: str = "1 day") -> DataFrame:
    """Rows of the last ``days`` by ``by``, a window beginning each ``step``; state older than the watermark is dropped."""
    timed = stream.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, late)
    return timed.groupBy(F.window(time_col, f"{days} days", step), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.end").alias("until"), *by, "n")


def growth_alerts(stream: DataFrame, key: str, baseline: str, factor: int = 3) -> DataFrame:
    """(key, n) once a key's rows reach ``factor`` times the baseline its first row carries. The state of a key is two numbers."""

    def run(k: tuple, frames: Iterator, state) -> Iterator:
        import pandas as pd

        n, base, told = state.get if state.exists else (0, 0, False)
        for frame in frames:
            if not n and len(frame):
                base = int(frame[baseline].iloc[0])
            n += len(frame)
        now = not told and base > 0 and n >= factor * base
        state.update((n, base, told or now))
        if now:
            yield pd.DataFrame({key: [k[0]], "n": [n]})

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, n long", "n long, base long, told boolean", "append", "NoTimeout")


def stale_alerts(stream: DataFrame, key: str, time_col: str, weeks: int = 8) -> DataFrame:
    """(key, last) of keys without a row for ``weeks`` of event time: a session that long has closed."""
    timed = stream.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, "0 seconds")
    return timed.groupBy(F.session_window(time_col, f"{7 * weeks} days"), key).agg(F.max(time_col).alias("last")).select(key, "last")
