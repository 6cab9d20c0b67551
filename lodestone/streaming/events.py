"""Streams: windows, sessions, duplicates, and a rate limit with state of its own."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as tx

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_stream(spark: SparkSession, folder: str, pattern: str, schema: str) -> DataFrame:
    """Tables of a folder as a stream, each one file or a folder of files."""
    # as a glob even if it is a plain name: only then may the source be a file as well as a folder
    fits = pattern if any(c in pattern for c in "*?[{") else f"{{{pattern}}}"
    return spark.readStream.schema(schema).parquet(f"{folder}/{fits}")


def read_events(spark: SparkSession, folder: str, pattern: str = "events.parquet", late: str = "10 minutes") -> DataFrame:
    """Events as a stream with a watermark."""
    raw = read_stream(spark, folder, pattern, SCHEMA)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def window_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums by event type in tumbling or sliding windows; the same on a table and on a stream."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Runs of a user's events that are less than a gap apart."""
    out = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), "n")


def distinct_events(events: DataFrame) -> DataFrame:
    """The first event of each id, remembered as long as the watermark says."""
    return events.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def score_stream(questions: DataFrame) -> DataFrame:
    """Questions (query_id, text) of a stream with their route."""
    r = tx.route(F.col("text"))
    return questions.select("query_id", r["intent"].alias("intent"), r["confidence"].alias("confidence"))


def rate_limited(events: DataFrame, most: int = 60, seconds: int = 60) -> DataFrame:
    """(event_id, user_id, allowed, retry_after): at most so many allowed events of a user in a sliding span.

    Rejected events don't enter the state, so it holds `most` times at most.
    """

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        for frame in frames:
            out = []
            for event_id, ts in sorted(zip(frame["event_id"], frame["ts"], strict=True), key=lambda x: (x[1], x[0])):
                now = ts.timestamp()
                kept = [t for t in kept if t > now - seconds]
                allowed = len(kept) < most
                if allowed:
                    kept.append(now)
                out.append((event_id, key[0], allowed, 0 if allowed else max(1, int(kept[0] + seconds - now))))
            yield pd.DataFrame(out, columns=["event_id", "user_id", "allowed", "retry_after"])
        state.update((kept,))

    return events.select("event_id", "user_id", "ts").groupBy("user_id").applyInPandasWithState(
        step, "event_id bigint, user_id bigint, allowed boolean, retry_after int", "times array<double>", "append", GroupStateTimeout.NoTimeout
    )
