"""Progress feeds with bounded queues, one-time tokens and counters, as streams that keep state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window as W, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillspark.plans.registry import query
from quillspark.plans.staging import fresh_path

# Events a queue holds, events that end a feed, seconds between signs of life, seconds of silence that end it.
MOST, TERMINAL, BEAT_SECONDS, IDLE_SECONDS = 100, ("complete", "error_event"), 15, 600
TTL_SECONDS = 300

FEED = "job string, subscriber string, seq long, kind string, event string, data string"


def _ms(at) -> int:
    return int(at.timestamp() * 1000)


class Feed(StatefulProcessor):
    """One job's subscribers and their queues.

    A queue is a map from places to events with a head and a tail, so neither
    putting in nor taking out rewrites it.
    """

    def __init__(self, most: int = MOST, beat: int = BEAT_SECONDS, idle: int = IDLE_SECONDS):
        self.most, self.beat, self.idle = most, beat * 1000, idle * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clients = handle.getMapState("clients", "subscriber string", "head long, tail long, heard long, beats long")
        self.queued = handle.getMapState("queued", "subscriber string, place long", "event string, data string")
        self.ended = handle.getValueState("ended", "event string, data string")

    def _leave(self, who: str) -> None:
        held = self.clients.getValue((who,))
        for place in range(held[0], held[1]):
            self.queued.removeKey((who, place))
        self.clients.removeKey((who,))

    def _timer(self, at: int) -> None:
        if at not in set(self.handle.listTimers()):
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        (job,) = key
        for x in sorted(rows, key=lambda x: (x["at"], x["seq"])):
            who, now = x["subscriber"], _ms(x["at"])
            told = lambda kind, event=None, data=None, who=who, seq=x["seq"]: Row(job=job, subscriber=who, seq=seq, kind=kind, event=event, data=data)
            if x["action"] == "publish":
                for (each,) in list(self.clients.keys()):
                    head, tail, heard, beats = self.clients.getValue((each,))
                    if tail - head >= self.most:
                        yield told("dropped", x["event"], x["data"], each)
                    else:
                        self.queued.updateValue((each, tail), (x["event"], x["data"]))
                        self.clients.updateValue((each,), (head, tail + 1, heard, beats))
                if x["event"] in TERMINAL:
                    self.ended.update((x["event"], x["data"]))
            elif x["action"] == "subscribe":
                if self.ended.exists():
                    yield told("delivered", *self.ended.get())
                elif not self.clients.containsKey((who,)):
                    self.clients.updateValue((who,), (0, 0, now, 0))
                    self._timer(now + self.beat)
            elif who is not None and self.clients.containsKey((who,)):
                if x["action"] == "unsubscribe":
                    self._leave(who)
                elif x["action"] == "take":
                    head, tail, heard, beats = self.clients.getValue((who,))
                    left = int(x["data"] or 1)
                    while left and head < tail:
                        event, data = self.queued.getValue((who, head))
                        self.queued.removeKey((who, head))
                        head, left, heard, beats = head + 1, left - 1, now, 0
                        yield told("delivered", event, data)
                        if event in TERMINAL:
                            break
                    else:
                        event = None
                    self.clients.updateValue((who,), (head, tail, heard, beats))
                    if event in TERMINAL:
                        self._leave(who)
                    elif heard == now:
                        self._timer(now + self.beat)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        (job,) = key
        # Time may have passed by several beats at once: a timer set now would wait for another batch.
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        for (who,) in list(self.clients.keys()):
            head, tail, heard, beats = self.clients.getValue((who,))
            due = min(now - heard, self.idle) // self.beat
            for _ in range(beats, due):
                yield Row(job=job, subscriber=who, seq=None, kind="keepalive", event=None, data=None)
            if now - heard >= self.idle:
                yield Row(job=job, subscriber=who, seq=None, kind="delivered", event="stream_timeout", data=None)
                self._leave(who)
            elif due > beats:
                self.clients.updateValue((who,), (head, tail, heard, due))
                self._timer(heard + (due + 1) * self.beat)


def progress_feed(actions: DataFrame, most: int = MOST, late: str = "10 seconds") -> DataFrame:
    """(job, subscriber, seq, action, event, data, at) -> what each subscriber gets.

    Actions are publish, subscribe, take (``data`` events, one if null) and
    unsubscribe.  Published events wait in each subscriber's queue of ``most``
    places; to a full one they are lost.  A terminal event ends the feed of
    whoever takes it, and is told at once to whoever subscribes later.
    Silence brings keep-alive rows and in the end a ``stream_timeout``.
    """
    rows = actions.select("job", "subscriber", "seq", "action", "event", "data", F.col("at").cast("timestamp").alias("at"))
    rows = rows.withWatermark("at", late) if actions.isStreaming else rows
    return rows.groupBy("job").transformWithState(statefulProcessor=Feed(most), outputStructType=FEED, outputMode="append", timeMode="EventTime")


TOKENS = "token string, seq long, outcome string, user long"


class OneTimeToken(StatefulProcessor):
    """One token: a value that the state store forgets when its time is over, and that the first use takes out."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        # Spark's clock only frees room; whether a use is in time is decided by the rows' own times.
        self.issued = handle.getValueState("issued", "user long, job long, at long", 2 * self.ttl * 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for x in sorted(rows, key=lambda x: (x["at"], x["seq"])):
            if x["action"] == "issue":
                self.issued.update((x["user"], x["job"], _ms(x["at"])))
                continue
            held = self.issued.get() if self.issued.exists() else None
            if held:
                self.issued.clear()
            outcome = "unknown" if not held else "expired" if _ms(x["at"]) - held[2] > self.ttl * 1000 else "other_job" if held[1] != x["job"] else "accepted"
            yield Row(token=key[0], seq=x["seq"], outcome=outcome, user=held[0] if outcome == "accepted" else None)


def one_time_uses(actions: DataFrame, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """(token, seq, action, user, job, at) -> (token, seq, outcome, user) of each use.

    A token is good for one use, within its time and for its own job; any use
    takes it out, and issuing it again begins anew.  A stream keeps state and
    the time, so it goes on until it is stopped; a batch looks at the row
    before.
    """
    rows = actions.select("token", "seq", "action", F.col("user").cast("long").alias("user"), F.col("job").cast("long").alias("job"), F.col("at").cast("timestamp").alias("at"))
    if actions.isStreaming:
        return rows.groupBy("token").transformWithState(statefulProcessor=OneTimeToken(ttl_seconds), outputStructType=TOKENS, outputMode="append", timeMode="ProcessingTime")
    w = W.partitionBy("token").orderBy("at", "seq")
    rows = rows.withColumn("b", F.lag(F.struct("action", "user", "job", "at")).over(w)).filter("action = 'use'")
    late = (F.unix_millis("at") - F.unix_millis("b.at")) > ttl_seconds * 1000
    outcome = F.when(F.coalesce(F.col("b.action") != "issue", F.lit(True)), "unknown").when(late, "expired").when(~F.col("b.job").eqNullSafe(F.col("job")), "other_job").otherwise("accepted")
    return rows.select("token", "seq", outcome.alias("outcome"), F.when(outcome == "accepted", F.col("b.user")).alias("user"))


class Counters:
    """Counters as sums of increments, one folder a micro-batch: doing a batch again writes its folder again."""

    def __init__(self, spark: SparkSession, path: str, keys: str):
        self.spark, self.path, self.keys = spark, path, keys

    def add(self, increments: DataFrame, batch: int) -> None:
        """(key, counter, by): for ``foreachBatch``; keys are summed before they are written."""
        summed = increments.groupBy("key", "counter").agg(F.sum("by").cast("long").alias("by"))
        summed.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def start(self, increments: DataFrame, checkpoint: str):
        """Counts a stream; ends when its input does."""
        return increments.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def totals(self) -> DataFrame:
        """(key, counter, value)"""
        rows = self.spark.read.schema(f"key {self.keys}, counter string, by long, batch long").parquet(self.path)
        return rows.groupBy("key", "counter").agg(F.sum("by").alias("value"))


@query("one_time_uses", """
WITH a AS (SELECT user_id, event_id AS seq, event_type IN ('view', 'purchase') AS issue, event_id % 2 AS job, ts FROM events),
b AS (SELECT *, lag(issue) OVER w AS b_issue, lag(job) OVER w AS b_job, lag(ts) OVER w AS b_ts FROM a WINDOW w AS (PARTITION BY user_id ORDER BY ts, seq)),
o AS (SELECT user_id, seq, CASE WHEN NOT coalesce(b_issue, false) THEN 'unknown' WHEN ts - b_ts > INTERVAL 1 DAY THEN 'expired' WHEN b_job != job THEN 'other_job' ELSE 'accepted' END AS outcome FROM b WHERE NOT issue)
SELECT user_id::VARCHAR AS token, seq, outcome, CASE WHEN outcome = 'accepted' THEN user_id END AS user FROM o""")
def one_time_uses_query(t, spark):
    """Views and purchases issue their user's token, for odd or even jobs; other events use it within a day."""
    action = F.when(F.col("event_type").isin("view", "purchase"), "issue").otherwise("use")
    rows = t("events").select(F.col("user_id").cast("string").alias("token"), F.col("event_id").alias("seq"), action.alias("action"), F.col("user_id").alias("user"), (F.col("event_id") % 2).alias("job"), F.col("ts").alias("at"))
    return one_time_uses(rows, 86400)


@query("counter_increments", """
SELECT user_id AS key, 'views' AS counter, count(*) FILTER (event_type = 'view')::BIGINT AS value FROM events GROUP BY 1
UNION ALL SELECT user_id, 'points', sum(CASE WHEN event_type = 'purchase' THEN round(value)::BIGINT ELSE 0 END)::BIGINT FROM events GROUP BY 1""")
def counter_increments(t, spark):
    """Views and points from increments in three batches, of which one is done twice."""
    e = t("events")
    counters = Counters(spark, fresh_path(spark, "counters"), "long")
    said = F.explode(F.array(F.struct(F.lit("views").alias("counter"), (F.col("event_type") == "view").cast("long").alias("by")), F.struct(F.lit("points").alias("counter"), F.when(F.col("event_type") == "purchase", F.round("value").cast("long")).otherwise(0).alias("by"))))
    rows = e.select(F.col("user_id").alias("key"), "event_id", said.alias("c")).select("key", "event_id", "c.counter", "c.by")
    for batch in (0, 1, 1, 2):
        counters.add(rows.filter(F.col("event_id") % 3 == batch).drop("event_id"), batch)
    return counters.totals()
