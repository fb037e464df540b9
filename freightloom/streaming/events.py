"""Windows over the event stream: tumbling, sliding and session windows with a watermark, and stateful cool-down."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read(spark: SparkSession, folder: str, files_per_trigger: int = 8) -> DataFrame:
    """The events that arrive as Parquet files in a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def _timed(events: DataFrame, late: str | None) -> DataFrame:
    df = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return df.withWatermark("ts", late) if events.isStreaming and late else df


def tumbling(events: DataFrame, size: str, late: str | None = "1 hour") -> DataFrame:
    """(start, event_type, n, total) for each window; rows later than the watermark are dropped by a stream."""
    out = _timed(events, late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str, step: str, late: str | None = "1 hour") -> DataFrame:
    """(start, event_type, n): a row counts in every window that it falls into."""
    out = _timed(events, late).groupBy(F.window("ts", size, step).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str, late: str | None = "1 hour") -> DataFrame:
    """(user_id, start, n): a user's events less than `gap` apart are one session."""
    out = _timed(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), "n")


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event_id once within the watermark."""
    df = _timed(events, late)
    return df.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else df.dropDuplicates(["event_id"])


def cooled_down(events: DataFrame, hours: int, late: str = "1 hour") -> DataFrame:
    """Errors as actions: a user's error acts only if the last action is `hours` or more before; state is one time."""
    schema = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("ts", T.TimestampType())])
    state_schema = T.StructType([T.StructField("last", T.TimestampType())])

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for t in sorted(t for f in frames for t in f["ts"]):
            if last is None or t - last >= timedelta(hours=hours):
                last = t
                out.append((key[0], t))
        state.update((last,))
        yield pd.DataFrame(out, columns=["user_id", "ts"])

    errors = _timed(events, late).where("event_type = 'error'").select("user_id", "ts")
    return errors.groupBy("user_id").applyInPandasWithState(run, schema, state_schema, "append", "NoTimeout")
