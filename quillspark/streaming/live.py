"""Live sessions, progress events and rate limits, as streams and as batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quillspark.plans.registry import query

# Path prefixes with requests allowed in 60 seconds, first match counts.
RULES = (("/api/auth/register", 1), ("/api/auth/login", 5), ("/api/parser/parse", 5), ("/api/", 60))
WINDOW_SECONDS = 60


def answer_points(correct: Column, response_ms: Column) -> Column:
    """100 and up to 1000 for speed, if right."""
    return F.when(correct, 100 + F.greatest(F.lit(0), 1000 - F.floor(response_ms / 20))).otherwise(0).cast("long")


def is_right(key: Column, given: Column) -> Column:
    clean = lambda x: F.lower(F.trim(F.coalesce(x, F.lit(""))))
    return (clean(key) != "") & (clean(key) == clean(given))


def first_answers(answers: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The first answer for each key; a stream keeps those of a watermark's reach, a batch takes the earliest."""
    if answers.isStreaming:
        return answers.withWatermark(at, "1 hour").dropDuplicatesWithinWatermark(keys)
    rest = [c for c in answers.columns if c not in keys]
    first = answers.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(at, *[c for c in rest if c != at])).alias("_x"))
    return first.select(*keys, *[F.col("_x")[c].alias(c) for c in rest])


def scores(answers: DataFrame) -> DataFrame:
    """Score of each student in each session."""
    right = answer_points(F.col("correct"), F.col("response_ms"))
    return answers.groupBy("session", "student").agg(F.sum(right).alias("score"), F.count(F.lit(1)).alias("answers"))


def ranked(board: DataFrame) -> DataFrame:
    """Places by score, then by who joined first."""
    return board.withColumn("rank", F.row_number().over(W.partitionBy("session").orderBy(F.desc("score"), "student")))


def start_leaderboard(answers: DataFrame, path: str, checkpoint: str):
    """Keeps ``path`` at the present leaderboard of a stream of answers; ends when the input does."""

    def write(batch: DataFrame, _: int) -> None:
        ranked(batch).write.mode("overwrite").parquet(path)

    first = first_answers(answers, ["session", "student", "idx"], "at")
    return scores(first).writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_answers(t) -> DataFrame:
    """Events in the role of answers: a session a day, a question for each of ten values."""
    e = t("events")
    return e.select(F.to_date("ts").cast("string").alias("session"), F.col("user_id").alias("student"), (F.col("event_id") % 10).alias("idx"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_type") == "click").alias("correct"), (F.col("event_id") * 37 % 30000).alias("response_ms"))


@query("live_scores", """
WITH a AS (SELECT ts::DATE::VARCHAR AS session, user_id AS student, event_id % 10 AS idx, ts, event_id, event_type = 'click' AS correct, event_id * 37 % 30000 AS ms FROM events),
f AS (SELECT *, row_number() OVER (PARTITION BY session, student, idx ORDER BY ts, correct, ms) AS r FROM a)
SELECT session, student, sum(CASE WHEN correct THEN 100 + greatest(0, 1000 - floor(ms / 20)) ELSE 0 END)::BIGINT AS score, count(*) AS answers FROM f WHERE r = 1 GROUP BY 1, 2""")
def live_scores(t, spark):
    return scores(first_answers(live_answers(t), ["session", "student", "idx"], "at"))


@query("live_leaderboard", """
WITH a AS (SELECT ts::DATE::VARCHAR AS session, user_id AS student, event_id % 10 AS idx, ts, event_type = 'click' AS correct, event_id * 37 % 30000 AS ms FROM events),
f AS (SELECT *, row_number() OVER (PARTITION BY session, student, idx ORDER BY ts, correct, ms) AS r FROM a),
s AS (SELECT session, student, sum(CASE WHEN correct THEN 100 + greatest(0, 1000 - floor(ms / 20)) ELSE 0 END)::BIGINT AS score FROM f WHERE r = 1 GROUP BY 1, 2)
SELECT session, student, score, row_number() OVER (PARTITION BY session ORDER BY score DESC, student) AS rank FROM s""")
def live_leaderboard(t, spark):
    return ranked(scores(first_answers(live_answers(t), ["session", "student", "idx"], "at")).drop("answers"))


@query("progress_latest", "SELECT user_id AS job, arg_max(event_type, (ts, event_id)) AS event, max(ts) AS at FROM events GROUP BY 1")
def progress_latest(t, spark):
    """The last event of each job."""
    return t("events").groupBy(F.col("user_id").alias("job")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event"), F.max("ts").alias("at"))


@query("activity_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def activity_windows(t, spark):
    """Daily tumbling windows; the same expression runs on a stream."""
    rows = t("events").withColumn("at", F.col("ts").cast("timestamp"))
    return rows.groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def rule_of(path: Column) -> tuple[Column, Column]:
    """(prefix, limit) of the first rule that matches; null where none does."""
    prefix, limit = F.lit(None).cast("string"), F.lit(None).cast("int")
    for p, n in reversed(RULES):
        prefix, limit = F.when(path.startswith(p), p).otherwise(prefix), F.when(path.startswith(p), n).otherwise(limit)
    return prefix, limit


def admitted(times: list[float], limit: int, kept: list[float] | None = None) -> tuple[list[tuple[bool, int]], list[float]]:
    """For each request in order: is it let in, and how long to wait if not.  Only those let in count."""
    kept, out = list(kept or []), []
    for now in times:
        kept = [x for x in kept if x > now - WINDOW_SECONDS]
        if len(kept) >= limit:
            out.append((False, int(kept[0] + WINDOW_SECONDS - now) + 1))
        else:
            kept.append(now)
            out.append((True, 0))
    return out, kept


def _in_order(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Decisions on requests sorted by key and time; only the last key's admitted times are kept from one batch to the next."""
    last, kept = None, []
    for pdf in frames:
        at, limits = pdf["at"].map(lambda x: x.timestamp()).to_numpy(), pdf["limit"].to_numpy()
        keys = list(zip(pdf["ip"], pdf["prefix"], strict=True))
        out: list[tuple[bool, int]] = []
        for k, key in enumerate(keys):
            if key != last:
                last, kept = key, []
            got, kept = admitted([at[k]], int(limits[k]), kept)
            out += got
        yield pdf.assign(admitted=[g[0] for g in out], retry_after=[g[1] for g in out])[["ip", "prefix", "seq", "admitted", "retry_after"]]


def _decided(pdf: pd.DataFrame, kept: list[float]) -> tuple[pd.DataFrame, list[float]]:
    pdf = pdf.sort_values(["at", "seq"])
    got, kept = admitted([x.timestamp() for x in pdf["at"]], int(pdf["limit"].iloc[0]), kept)
    return pdf.assign(admitted=[g[0] for g in got], retry_after=[g[1] for g in got])[["ip", "prefix", "seq", "admitted", "retry_after"]], kept


DECISION = "ip string, prefix string, seq long, admitted boolean, retry_after int"


def rate_limited(requests: DataFrame) -> DataFrame:
    """(ip, path, at, seq) -> the decision on each request that a rule covers.

    The state of a key is the times of its admitted requests in the window,
    never more than the limit, so a stream needs little memory for each.  In a
    batch requests are sorted by key and time, and pass by one after the
    other: a key of any size needs no more memory.
    """
    prefix, limit = rule_of(F.col("path"))
    rows = requests.withColumn("prefix", prefix).withColumn("limit", limit).filter("prefix is not null")
    if not requests.isStreaming:
        dealt = rows.select("ip", "prefix", "limit", "at", "seq").repartition("ip", "prefix").sortWithinPartitions("ip", "prefix", "at", "seq")
        return dealt.mapInPandas(_in_order, DECISION)

    def step(key, frames: Iterator[pd.DataFrame], state):
        pdf = pd.concat(list(frames))
        out, kept = _decided(pdf, list(state.get[0]) if state.exists else [])
        state.update((kept,))
        yield out

    return rows.groupBy("ip", "prefix").applyInPandasWithState(step, DECISION, "kept array<double>", "append", "NoTimeout")


@query("rate_limit_sim")
def rate_limit_sim(t, spark):
    """Whether a request gets in depends on those let in before: custom state, no SQL."""
    rows = t("events").select(F.concat(F.lit("ip"), F.col("user_id") % 20).alias("ip"), F.lit("/api/auth/login").alias("path"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"))
    return rate_limited(rows)


def room_states(events: DataFrame) -> DataFrame:
    """(session, seq, action) -> state and question after each action: waiting, active, ended.

    Starting works only from waiting, going on only while active; the end is
    final.  Running counts say it all, so a session's actions are sorted, never
    gathered.
    """
    so_far = W.partitionBy("session").orderBy("seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = lambda found: F.coalesce(F.max(found.cast("int")).over(so_far), F.lit(0))
    rows = events.select("session", "seq", "action").withColumn("ended", seen(F.col("action") == "end"))
    rows = rows.withColumn("started", seen((F.col("action") == "start") & (F.col("ended") == 0)))
    passed = F.count_if((F.col("action") == "next") & (F.col("started") == 1) & (F.col("ended") == 0)).over(so_far)
    state = F.when(F.col("ended") == 1, "ended").when(F.col("started") == 1, "active").otherwise("waiting")
    return rows.select("session", "seq", state.alias("state"), F.when(F.col("started") == 1, passed).otherwise(-1).cast("int").alias("idx"))


def tokens_used(events: DataFrame, ttl_seconds: int = 300) -> DataFrame:
    """(token, action, at) -> accepted: a one-time token counts once, within its time."""
    issued = events.filter("action = 'issue'").groupBy("token").agg(F.min("at").alias("issued"))
    used = events.filter("action = 'use'").groupBy("token").agg(F.min("at").alias("used"))
    return issued.join(used, "token", "left").select("token", F.coalesce((F.unix_timestamp("used") - F.unix_timestamp("issued")).between(0, ttl_seconds), F.lit(False)).alias("accepted"))


REFUSED = "token string, seq long, refused boolean"


def revoked_tokens(events: DataFrame, ttl_seconds: int) -> DataFrame:
    """(token, seq, action, at) -> (token hash, seq, refused) of each use; actions are ``revoke`` and ``use``.

    A token is refused from its latest revocation on until its time is over,
    that moment included.  A stream keeps one number for each revoked token
    and forgets it once the watermark has passed it.
    """
    rows = events.select(F.sha2("token", 256).alias("token"), "seq", "action", "at")
    if not events.isStreaming:
        until = F.when(F.col("action") == "revoke", F.col("at") + F.make_dt_interval(secs=F.lit(ttl_seconds)))
        so_far = W.partitionBy("token").orderBy("at", "seq").rowsBetween(W.unboundedPreceding, W.currentRow)
        told = rows.withColumn("until", F.last(until, ignorenulls=True).over(so_far)).filter("action = 'use'")
        return told.select("token", "seq", F.coalesce(F.col("until") >= F.col("at"), F.lit(False)).alias("refused"))

    def step(key, frames: Iterator[pd.DataFrame], state):
        if state.hasTimedOut:
            state.remove()
            return
        until, out = (state.get[0] if state.exists else None), []
        for x in pd.concat(list(frames)).sort_values(["at", "seq"]).itertuples():
            if x.action == "revoke":
                until = x.at.timestamp() + ttl_seconds
            elif x.action == "use":
                out.append((key[0], x.seq, until is not None and until >= x.at.timestamp()))
        if until is not None:
            state.update((until,))
            state.setTimeoutTimestamp(max(int(until * 1000), state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=["token", "seq", "refused"])

    return rows.withWatermark("at", "1 hour").groupBy("token").applyInPandasWithState(step, REFUSED, "until double", "append", "EventTimeTimeout")


@query("token_blacklist", """
SELECT event_id AS seq, coalesce(last_value(CASE WHEN event_type = 'purchase' THEN ts + INTERVAL 1 DAY END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) >= ts, false) AS refused
FROM events QUALIFY event_type != 'purchase'""")
def token_blacklist(t, spark):
    """A purchase revokes its user's token for a day."""
    rows = t("events").select(F.col("user_id").cast("string").alias("token"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "purchase", "revoke").otherwise("use").alias("action"), F.col("ts").cast("timestamp").alias("at"))
    return revoked_tokens(rows, 86400).drop("token")


def index_steps(batch: DataFrame, steps: dict) -> dict[str, str | None]:
    """Runs every step on the batch; one that fails does not stop the others."""
    out: dict[str, str | None] = {}
    for name, f in steps.items():
        try:
            f(batch)
            out[name] = None
        except Exception as e:  # isolated on purpose: each index is rebuilt on its own
            out[name] = str(e)[:200]
    return out
