"""Exact limits over streams, as keyed state with event-time timers: rolling windows and rate gates.

Both need a state store that holds lists and timers: ``use_rocksdb`` sets it for a session that has not set
its own."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import ship
from .usage import SAFE_REQUESTS, SAFE_TOKENS, SECONDS, timed

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Fixed values of retries: seconds waited after a limit, times the attempt, and after another error; tries.
LIMIT_WAIT, ERROR_WAIT, TRIES = 60, 5, 3


def use_rocksdb(spark: SparkSession) -> None:
    key = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(key, ""):
        spark.conf.set(key, PROVIDER)


class _Rolling(StatefulProcessor):
    """Events wait until the watermark has reached their millisecond, as an earlier one may still come; then each is counted
    with those of its last seconds. An entry leaves once no waiting or coming event can reach back to it. A key has a timer
    at its earliest waiting event, not one an event: whichever fires settles all that the watermark has passed."""

    def __init__(self, seconds: int):
        self.reach = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "us long, event_id long, tokens double, waits boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        due: list[int] = []
        for frame in rows:
            tokens = [None if pd.isna(t) else float(t) for t in frame["tokens"]]
            self.held.appendList([(int(u), int(i), t, True) for u, i, t in zip(frame["us"], frame["event_id"], tokens)])
            due.append(int(frame["us"].min()) // 1000)
        if due:
            self.handle.registerTimer(min(due))
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000 + 999  # watermarks count milliseconds
        held = sorted(self.held.get(), key=lambda r: (r[0], r[1]))
        ready = [r for r in held if r[3] and r[0] <= passed]
        if not ready:  # an earlier timer of this batch has settled all
            return
        us = np.array([r[0] for r in held])
        sums = np.concatenate([[0.0], np.cumsum([r[2] or 0.0 for r in held])])
        known = np.concatenate([[0], np.cumsum([r[2] is not None for r in held])])
        out = []
        for t, event, _, _ in ready:
            a, b = np.searchsorted(us, t - self.reach, side="left"), np.searchsorted(us, t, side="right")
            out.append((event, int(b - a), round(float(sums[b] - sums[a]), 4) if known[b] > known[a] else None))
        kept = [(r[0], r[1], r[2], r[3] and r[0] > passed) for r in held if r[0] > passed - self.reach - 1]
        self.held.put(kept) if kept else self.held.clear()
        if waiting := [r[0] for r in kept if r[3]]:
            self.handle.registerTimer(min(waiting) // 1000)
        yield pd.DataFrame({"event_id": [x[0] for x in out], "window_requests": [x[1] for x in out], "window_tokens": pd.array([x[2] for x in out], dtype="Float64")})

    def close(self) -> None:
        pass


def rolling_stream(events: DataFrame, key: str, tokens: str, seconds: int = SECONDS, late: str = "10 minutes") -> DataFrame:
    """Streaming form of ``usage.rolling``: (event_id, window_requests, window_tokens, limited), row by row what
    that gives, each as soon as the watermark has passed it. Events later than ``late`` are dropped. Whole
    seconds of state a key are held, no more. Null keys and times take no part."""
    ship(events.sparkSession)
    use_rocksdb(events.sparkSession)
    rows = timed(events).withWatermark("ts", late).filter(F.col(key).isNotNull() & F.col("ts").isNotNull())
    rows = rows.select(F.col(key).alias("key"), "ts", F.unix_micros("ts").alias("us"), F.col("event_id").cast("long").alias("event_id"), F.col(tokens).cast("double").alias("tokens"))
    out = rows.groupBy("key").transformWithStateInPandas(_Rolling(seconds), "event_id long, window_requests long, window_tokens double", "Append", "eventTime")
    return out.withColumn("limited", (F.col("window_requests") >= SAFE_REQUESTS) | (F.col("window_tokens") > SAFE_TOKENS))


class _Gate(StatefulProcessor):
    """A provider's calls in the order of their due times, each with its outcome as the client tells it. Calls
    that must wait, for the minute's room or for a retry, stay in state under their new due time."""

    def __init__(self, call: Any, requests: int, seconds: int):
        self.call, self.requests, self.window = call, requests, seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "due long, request_id long, attempt int, prompt string")
        self.sent = handle.getListState("sent", "at long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for frame in rows:
            new = [(int(d), int(i), int(a), p) for d, i, a, p in zip(frame["due"], frame["request_id"], frame["attempt"], frame["prompt"])]
            self.waiting.appendList(new)
            for due in {r[0] for r in new}:
                self.handle.registerTimer(due)
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        queue = sorted(tuple(r) for r in self.waiting.get())
        sent, out = sorted(r[0] for r in self.sent.get()), []
        while queue and queue[0][0] <= now:
            due, request, attempt, prompt = queue.pop(0)
            sent = [t for t in sent if t > due - self.window]
            if len(sent) >= self.requests:  # no room: at the moment the oldest call of the window leaves it
                at = sent[len(sent) - self.requests] + self.window
                queue = sorted([*queue, (at, request, attempt, prompt)])
                continue
            sent = sorted([*sent, due])
            reply, error = self.call(key[0], prompt, attempt)
            if error is not None and attempt + 1 < TRIES:
                wait = LIMIT_WAIT * (attempt + 1) if error == "limit" else ERROR_WAIT
                queue = sorted([*queue, (due + 1000 * wait, request, attempt + 1, prompt)])
                continue
            out.append((request, key[0], due, attempt, reply, error))
        # Of each state what is left is put, or nothing is held.
        for state, left in ((self.waiting, queue), (self.sent, [(t,) for t in sent])):
            state.put(left) if left else state.clear()
        for due in {r[0] for r in queue}:
            self.handle.registerTimer(due)
        if out:
            yield pd.DataFrame(out, columns=["request_id", "provider", "at", "attempt", "reply", "error"])

    def close(self) -> None:
        pass


def gated_calls(requests: DataFrame, call: Any, per_window: int, seconds: int = SECONDS, late: str = "0 seconds") -> DataFrame:
    """Model calls under a rate limit: (request_id, provider, at, attempt, reply, error) for each of requests
    (request_id, provider, ts, prompt). Per provider at most ``per_window`` calls fall within any ``seconds`` of
    the stream's time; more wait. ``call``(provider, prompt, attempt) gives (reply, error): on the error
    ``limit`` the request is due again after 60 s times the attempt, on another after 5 s, three tries in all.
    Waiting is state under a timer: no task sleeps. ``at`` is the time, in milliseconds, of the last try.

    A call is made again if its batch is: give ``call`` a store of answers where that must cost nothing."""
    ship(requests.sparkSession)
    use_rocksdb(requests.sparkSession)
    rows = timed(requests).withWatermark("ts", late).filter("provider is not null and ts is not null")
    rows = rows.select("provider", "ts", F.unix_millis("ts").alias("due"), F.col("request_id").cast("long").alias("request_id"), F.lit(0).alias("attempt"), F.coalesce("prompt", F.lit("")).alias("prompt"))
    return rows.groupBy("provider").transformWithStateInPandas(_Gate(call, per_window, seconds), "request_id long, provider string, at long, attempt int, reply string, error string", "Append", "eventTime")
