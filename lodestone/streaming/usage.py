"""Usage limits over event streams: rolling windows, daily totals, cooldowns, idempotent ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Safe limits per minute and day, the day's time zone, seconds of a window.
SAFE_REQUESTS, SAFE_TOKENS, SAFE_DAILY = 9, 240_000, 240
ZONE, SECONDS = "America/Los_Angeles", 60


def timed(events: DataFrame) -> DataFrame:
    """Event times as instants (of the session's zone, which is UTC)."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def rolling(events: DataFrame, key: str, tokens: str, seconds: int = SECONDS) -> DataFrame:
    """Requests and tokens of each key in the ``seconds`` up to each event, and whether a limit is near.
    Events exactly that old still count."""
    w = Window.partitionBy(key).orderBy(F.unix_micros("ts")).rangeBetween(-seconds * 1_000_000, 0)
    rows = timed(events).withColumn("window_requests", F.count(F.lit(1)).over(w)).withColumn("window_tokens", F.round(F.sum(tokens).over(w), 4))
    return rows.withColumn("limited", (F.col("window_requests") >= SAFE_REQUESTS) | (F.col("window_tokens") > SAFE_TOKENS))


def daily(events: DataFrame, tokens: str) -> DataFrame:
    """Totals per day of the service's time zone."""
    day = F.to_date(F.from_utc_timestamp("ts", ZONE))
    return events.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("requests"), F.round(F.sum(tokens), 4).alias("tokens"), (F.count(F.lit(1)) >= SAFE_DAILY).alias("limited"))


def cooldowns(events: DataFrame, key: str, failed: str, wait: str = "60 seconds") -> DataFrame:
    """Latest expiry of each key's cooldown."""
    return events.filter(failed).groupBy(key).agg(F.max(F.expr(f"ts + INTERVAL {wait}")).alias("until"))


def minute_windows(stream: DataFrame, tokens: str, late: str = "10 minutes") -> DataFrame:
    """Streaming form: sliding windows of a minute with a watermark."""
    rows = timed(stream).withWatermark("ts", late).groupBy(F.window("ts", "60 seconds", "10 seconds"), "event_type")
    return rows.agg(F.count(F.lit(1)).alias("requests"), F.sum(tokens).alias("tokens")).select("window.start", "window.end", "event_type", "requests", "tokens")


def day_windows(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Streaming form of the daily totals: days of the service's time zone, by its clock."""
    rows = timed(stream).withColumn("clock", F.from_utc_timestamp("ts", ZONE)).withWatermark("clock", late)
    return rows.groupBy(F.window("clock", "1 day")).agg(F.count(F.lit(1)).alias("requests")).select(F.to_date("window.start").alias("day"), "requests")


def once(stream: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """Each signature once within the watermark."""
    return timed(stream).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def cooldown_stream(stream: DataFrame, key: str, failed: str, wait: str = "60 seconds") -> DataFrame:
    """Streaming form of the cooldowns: latest expiry per key so far (complete mode)."""
    return timed(stream).filter(failed).groupBy(key).agg(F.max(F.expr(f"ts + INTERVAL {wait}")).alias("until"))
