"""Structured Streaming: windowed counts and running bests of event streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Events of Parquet files in a folder as they come, with a time zone."""
    return spark.readStream.schema(EVENTS).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Events by type and tumbling window, with events later than ``late`` behind the newest left out when streaming."""
    df = events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return df.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def session_counts(events: DataFrame, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """Events by user and session, which ends after ``gap`` without one."""
    df = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return df.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def first_events(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each event once, though the source may repeat it within ``late``."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def running_best(events: DataFrame, scale: float = 200.0) -> DataFrame:
    """By user: events seen so far and the best score, the value over ``scale`` and at most 1, kept as state across batches."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, best = state.get if state.exists else (0, 0.0)
        for pdf in batches:
            n += len(pdf)
            best = max(best, float((pdf["value"] / scale).clip(upper=1.0).max()))
        state.update((n, best))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "best": [best]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, best double", "n long, best double", "update", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, spark: SparkSession, name: str, mode: str) -> DataFrame:
    """Run a stream over what is there and return what it has put out."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)
