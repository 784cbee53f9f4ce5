"""Event streams: windows, repeats, sessions and the state of each user, the same over a stream as over a table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATENESS = "2 hours"
SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The events tables that arrive in ``folder`` as a stream; events up to ``LATENESS`` late are awaited."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder).withWatermark("ts", LATENESS)


def once(events: DataFrame) -> DataFrame:
    """Events delivered more than once count once; on a stream, within the lateness."""
    return events.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def tumbling(events: DataFrame, width: str = "1 hour") -> DataFrame:
    w = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("value"))
    return w.select(F.col("w.start").alias("start"), "event_type", "events", "value")


def sliding(events: DataFrame, width: str = "6 hours", step: str = "2 hours") -> DataFrame:
    w = events.groupBy(F.window("ts", width, step).alias("w")).agg(F.count(F.lit(1)).alias("events"), F.approx_count_distinct("user_id").alias("users"))
    return w.select(F.col("w.start").alias("start"), "events", "users")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    w = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("events"))
    return w.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def progress(events: DataFrame) -> DataFrame:
    """(user_id, events, errors, last): what each user's stream of events came to, kept in state between batches."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, errors, last = state.get if state.exists else (0, 0, 0)
        for f in frames:
            n += len(f)
            errors += int((f["event_type"] == "error").sum())
            last = max(last, int(f["event_id"].max()))
        state.update((n, errors, last))
        yield pd.DataFrame({"user_id": [key[0]], "events": [n], "errors": [errors], "last": [last]})

    return events.select("user_id", "event_type", "event_id").groupBy("user_id").applyInPandasWithState(update, "user_id long, events long, errors long, last long", "events long, errors long, last long", "update", GroupStateTimeout.NoTimeout)
