"""Event streams: usage counters, first sightings, digests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 100_000


def usage_counts(events: DataFrame, ts: str, key: str, name: str, lateness: str = "1 day", width: str = "1 day") -> DataFrame:
    """Counters per window, key and event name, capped as shown; works on batches and streams."""
    rows = events.withWatermark(ts, lateness) if events.isStreaming else events
    counted = rows.groupBy(F.window(ts, width).alias("w"), key, name).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), key, name, F.least("n", F.lit(MOST)).alias("n"))


def since_watermark(events: DataFrame, state: DataFrame, key: str, day: Column, today: Column, window_days: int = 7) -> DataFrame:
    """Events not before each key's own watermark: its last run, at most a window back."""
    floor = F.date_sub(today, window_days)
    met = events.join(state.select(key, "last_run"), key, "left")
    return met.where((day >= F.greatest(F.coalesce("last_run", floor), floor)) & (day <= today)).drop("last_run")


def totals_by_key(events: DataFrame, key: str, value: str) -> DataFrame:
    """Running (key, n, total) of a stream by user state; emits a row whenever a key's state changes."""

    def update(group: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for batch in batches:
            n, total = n + len(batch), total + float(batch[value].sum())
        state.update((n, total))
        yield pd.DataFrame({key: [group[0]], "n": [n], "total": [total]})

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, n long, total double", "n long, total double", "update", "NoTimeout")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Drains what a stream has now into Parquet files."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
