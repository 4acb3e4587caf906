"""Feeds, tokens and counters as streams, against plain models."""

from __future__ import annotations

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from quillspark.streaming import live, progress

START = dt.datetime(2024, 1, 1)
ACTIONS = "job string, subscriber string, seq long, action string, event string, data string, at timestamp"


@pytest.fixture
def rocks(spark):
    before, width = spark.conf.get("spark.sql.streaming.stateStore.providerClass"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    spark.conf.set("spark.sql.shuffle.partitions", width)


def streamed(spark, batches: list[list[tuple]], schema: str, path: str):
    """A stream that sees each batch in a file of its own, in order."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in/b{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{path}/in")


def results(stream, path: str, name: str, rows: int | None = None) -> list:
    """What a stream gives until it ends, or, as one that keeps time itself never does, until it has read so many rows."""
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{path}/ck").trigger(availableNow=True).start()
    until = time.time() + 120
    while q.isActive and time.time() < until and (rows is None or sum(p.numInputRows for p in q.recentProgress) < rows):
        time.sleep(0.2)
    q.stop()
    assert time.time() < until
    return stream.sparkSession.table(name).collect()


def test_two_subscribers_a_full_queue_and_an_idle_one(rocks, tmp_path):
    at = lambda s: START + dt.timedelta(seconds=s)
    row = lambda seq, action, who=None, event=None, data=None, s=None: ("j", who, seq, action, event, data, at(seq if s is None else s))
    first = [row(1, "subscribe", "fast"), row(2, "subscribe", "slow"), row(3, "publish", None, "progress", "a"), row(4, "take", "fast"), row(5, "publish", None, "progress", "b"), row(6, "publish", None, "progress", "c"), row(7, "publish", None, "progress", "d")]
    second = [row(8, "take", "fast", None, "9"), row(9, "publish", None, "complete", "end"), row(10, "take", "fast"), row(11, "take", "fast"), row(12, "subscribe", "late"), row(13, "take", "slow", None, "2")]
    third = [("other", "x", 14, "subscribe", None, None, at(14)), ("other", "x", 15, "publish", "progress", "y", at(2000))]
    got = results(progress.progress_feed(streamed(rocks, [first, second, third], ACTIONS, str(tmp_path)), most=3), str(tmp_path), "feed")
    seen = lambda who, kind="delivered": [(r.event, r.data) for r in sorted((r for r in got if r.job == "j" and r.subscriber == who and r.kind == kind and r.seq), key=lambda r: r.seq)]
    # Rows of one batch for one subscriber come in order; equal seq keep the queue's order.
    assert seen("fast") == [("progress", "a"), ("progress", "b"), ("progress", "c"), ("progress", "d"), ("complete", "end")]
    assert seen("slow", "dropped") == [("progress", "d"), ("complete", "end")]
    assert seen("slow") == [("progress", "a"), ("progress", "b")]
    assert seen("late") == [("complete", "end")]
    silent = [(r.kind, r.event) for r in got if r.job == "j" and r.seq is None and r.subscriber == "slow"]
    assert silent.count(("delivered", "stream_timeout")) == 1 and silent.count(("keepalive", None)) == 40
    assert not [r for r in got if r.seq is None and r.subscriber in ("fast", "late")]


def test_tokens_as_a_stream_and_as_a_batch(rocks, tmp_path):
    r = random.Random(2)
    rows = [(f"t{r.randrange(12)}", k, r.choice(["issue", "use", "use"]), r.randrange(5), r.randrange(2), START + dt.timedelta(seconds=17 * k)) for k in range(300)]
    schema = "token string, seq long, action string, user long, job long, at timestamp"
    held, want = {}, set()
    for token, seq, action, user, job, at in rows:
        if action == "issue":
            held[token] = (user, job, at)
            continue
        x = held.pop(token, None)
        outcome = "unknown" if x is None else "expired" if (at - x[2]).total_seconds() > 300 else "other_job" if x[1] != job else "accepted"
        want.add((token, seq, outcome, x[0] if outcome == "accepted" else None))
    assert {tuple(x) for x in progress.one_time_uses(rocks.createDataFrame(rows, schema)).collect()} == want
    stream = streamed(rocks, [rows[:100], rows[100:200], rows[200:]], schema, str(tmp_path))
    assert {tuple(x) for x in results(progress.one_time_uses(stream), str(tmp_path), "tokens", len(rows))} == want
    assert {x[2] for x in want} == {"unknown", "expired", "other_job", "accepted"}


def test_counters_survive_a_replay(spark, tmp_path):
    schema = "key long, counter string, by long"
    batches = [[(1, "views", 1), (1, "views", 1), (2, "views", 1)], [(1, "views", 1), (2, "points", 5)]]
    stream = streamed(spark, batches, schema, str(tmp_path))
    counters = progress.Counters(spark, f"{tmp_path}/out", "long")
    for checkpoint in ("a", "b"):  # a lost checkpoint does all batches again, under the same numbers
        counters.start(stream, f"{tmp_path}/{checkpoint}").awaitTermination(120)
        assert {tuple(r) for r in counters.totals().collect()} == {(1, "views", 3), (2, "views", 1), (2, "points", 5)}


def test_limiter_passes_hot_keys_by(spark):
    """One key over many Arrow batches equals the decisions made on all its requests at once."""
    r = random.Random(3)
    times = sorted(START + dt.timedelta(seconds=r.uniform(0, 3000)) for _ in range(3000))
    rows = [("hot" if r.random() < 0.8 else f"ip{k % 5}", "/api/auth/login", at, k) for k, at in enumerate(times)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        got = {x.seq: (x.admitted, x.retry_after) for x in live.rate_limited(spark.createDataFrame(rows, "ip string, path string, at timestamp, seq long")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for ip in {x[0] for x in rows}:
        own = [x for x in rows if x[0] == ip]
        for x, y in zip(own, live.admitted([x[2].replace(tzinfo=dt.timezone.utc).timestamp() for x in own], 5)[0], strict=True):
            want[x[3]] = y
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and len(got) == 3000
    assert all(abs(got[k][1] - want[k][1]) <= 1 for k in want)
