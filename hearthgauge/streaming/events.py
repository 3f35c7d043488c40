"""Extension: the batch rules of first-seen and retention over an unbounded table of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def timed(events: DataFrame, time: str, late: str) -> DataFrame:
    """`events` with a watermark; a time without a zone counts as the session's."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def first_seen(events: DataFrame, key: list[str], time: str, late: str = "1 day") -> DataFrame:
    """The first event of each key within the watermark; state older than `late` is dropped."""
    return timed(events, time, late).dropDuplicatesWithinWatermark(key)


def tumbling_counts(events: DataFrame, time: str, width: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Events and their value by window and keys; late ones beyond the watermark are dropped."""
    return timed(events, time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), *keys, "n", "value")


def session_counts(events: DataFrame, time: str, gap: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Events by session: a key's events less than `gap` apart."""
    return timed(events, time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that is there now, through the streaming engine, as a batch DataFrame in memory."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination(300)
    return stream.sparkSession.table(name)
