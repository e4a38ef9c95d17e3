"""Structured Streaming twins of the batch operators over events.

Each takes a streaming (or batch) DataFrame; watermarks bound the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts and values by event type in windows of event time; rows later than the watermark are dropped."""
    at = F.window("ts", width, slide) if slide else F.window("ts", width)
    g = events.withWatermark("ts", late).groupBy(at.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("most"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"), "most")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user, ended by a gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def first_of_each(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Rows whose key has not been seen within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def running_totals(events: DataFrame) -> DataFrame:
    """After each micro-batch, the users in it with their count, sum, least and most so far."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total, least, most = state.get if state.exists else (0, 0.0, float("inf"), float("-inf"))
        for f in frames:
            n, total, least, most = n + len(f), total + float(f["value"].sum()), min(least, float(f["value"].min())), max(most, float(f["value"].max()))
        state.update((n, total, least, most))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [round(total, 4)], "least": [least], "most": [most]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, total double, least double, most double", "n long, total double, least double, most double", "update", GroupStateTimeout.NoTimeout)


def append_stream(events: DataFrame, path: str, checkpoint: str, key: str = "event_id") -> StreamingQuery:
    """Appends rows of new keys to a Parquet table, once each across restarts (checkpoint and file log)."""
    return first_of_each(events, key).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
