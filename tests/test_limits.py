"""Keyed state with timers: exact rolling windows over several batches, rate gates with retries."""

import collections
import random
import sys
import uuid

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lodestone.streaming import limits, usage


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not have the tests


def drain(spark, plan, source, schema, base):
    """Run a stream over the files of ``source`` a file a batch."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    rows = plan(stream)
    query = rows.writeStream.option("checkpointLocation", f"{base}/ck-{uuid.uuid4().hex}").option("path", f"{base}/out").outputMode("append").format("parquet").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{base}/out")


def test_rolling_stream_equals_the_batch_window(spark, tmp_path):
    rng = random.Random(3)
    start, rows = 1_700_000_000.0, []
    for i in range(240):
        rows.append((i, rng.choice([1, 2, None]), start + i * 7 + rng.choice([0, 0, 0.25, -15]), rng.choice([None, 1.5, 2.25, 100_000.0])))
    rows += [(1000, 1, rows[10][2], 2.0), (1001, 1, rows[10][2], 2.0), (1002, 1, rows[10][2] + 60, 2.0)]
    last = max(r[2] for r in rows)
    rows.append((9999, 3, last + 120, 0.0))  # lets the watermark pass all others
    ddl = "event_id long, user_id long, sec double, value double"
    df = spark.createDataFrame(rows, ddl).select("event_id", "user_id", F.timestamp_seconds("sec").alias("ts"), "value")
    source = str(tmp_path / "in")
    for a, b in ((0, 100), (100, 200), (200, 10_000)):
        part = [r for r in rows if a <= r[0] < b or (a == 0 and 1000 <= r[0] < 9999)]
        df.filter(F.col("event_id").isin([r[0] for r in part])).coalesce(1).write.mode("append").parquet(source)
    got = drain(spark, lambda x: limits.rolling_stream(x, "user_id", "value", late="90 seconds"), source, df.schema, str(tmp_path))
    want = usage.rolling(df.filter("user_id is not null and event_id != 9999"), "user_id", "value").select("event_id", "window_requests", "window_tokens", "limited")
    assert sorted(map(tuple, got.filter("event_id != 9999").collect())) == sorted(map(tuple, want.collect()))


def test_a_key_has_one_timer_not_one_an_event():
    class Held(list):
        def appendList(self, rows):
            self.extend(rows)

        def get(self):
            return iter(list(self))

        def put(self, rows):
            self[:] = rows

    class Handle:
        def __init__(self):
            self.timers, self.held = [], Held()

        def getListState(self, name, schema):
            return self.held

        def registerTimer(self, at):
            self.timers.append(at)

    class Passed:
        def getCurrentWatermarkInMs(self):
            return 500

    handle, state = Handle(), limits._Rolling(60)
    state.init(handle)
    us = [i * 1000 for i in range(1, 1001)]
    list(state.handleInputRows((1,), iter([pd.DataFrame({"us": us, "event_id": range(1000), "tokens": 1.0})]), None))
    assert handle.timers == [1]
    got = pd.concat(state.handleExpiredTimer((1,), Passed(), None))
    assert got["event_id"].tolist() == list(range(500)) and got["window_requests"].tolist() == list(range(1, 501))
    assert handle.timers == [1, 501]  # the next waiting event's
    assert list(state.handleExpiredTimer((1,), Passed(), None)) == [] and handle.timers == [1, 501]


def client(provider, prompt, attempt):
    """A client that fails as its prompt says."""
    fails = {"limit": 1, "limit twice": 2, "broken": 9, "slip": 1}.get(prompt, 0)
    error = "limit" if prompt.startswith("limit") else "other"
    return (None, error) if attempt < fails else (f"{provider}: {prompt}", None)


def plain_gate(requests, per_window, seconds):
    """What each provider does by its own clock."""
    out = []
    for provider in {r[1] for r in requests}:
        queue, sent = sorted((int(t * 1000), i, 0, p) for i, who, t, p in requests if who == provider), []
        while queue:
            due, i, attempt, prompt = queue.pop(0)
            live = sorted(t for t in sent if t > due - 1000 * seconds)
            if len(live) >= per_window:
                queue = sorted([*queue, (live[-per_window] + 1000 * seconds, i, attempt, prompt)])
                continue
            sent.append(due)
            reply, error = client(provider, prompt, attempt)
            if error and attempt < 2:
                queue = sorted([*queue, (due + 1000 * (60 * (attempt + 1) if error == "limit" else 5), i, attempt + 1, prompt)])
            else:
                out.append((i, provider, due, attempt, reply, error))
    return sorted(out)


def test_gate_spaces_calls_and_retries(spark, tmp_path):
    rng = random.Random(5)
    requests = [(i, rng.choice("ab"), 1_700_000_000 + rng.randint(0, 200), rng.choice(["fine", "limit", "limit twice", "broken", "slip"])) for i in range(60)]
    more = requests + [(999, "c", 1_700_100_000, "fine")]  # moves the stream's time on
    source = str(tmp_path / "in")
    df = spark.createDataFrame(more, "request_id long, provider string, sec long, prompt string").select("request_id", "provider", F.timestamp_seconds("sec").alias("ts"), "prompt")
    for part in (df.filter("request_id < 60"), df.filter("request_id = 999")):
        part.coalesce(1).write.mode("append").parquet(source)
    # Times of the first file are whole seconds within the lateness; all are due when the second has come.
    got = drain(spark, lambda x: limits.gated_calls(x, client, 4, 60, "300 seconds"), source, df.schema, str(tmp_path))
    rows = sorted(tuple(r) for r in got.filter("request_id != 999").collect())
    assert rows == plain_gate(requests, 4, 60)
    assert collections.Counter(r[5] for r in rows)["other"] > 0 and max(r[3] for r in rows) == 2
    for who in "ab":
        at = sorted(r[2] for r in rows if r[1] == who)
        assert all(b - a >= 60_000 for a, b in zip(at, at[4:]))
