"""Rankings, running states and latest rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from quillspark.functions import scalars as S
from quillspark.plans.registry import query

XP_PER_CORRECT, XP_PER_STREAK_DAY = 20, 10


@query("leaderboard", """
SELECT row_number() OVER (ORDER BY xp DESC, c_custkey) AS rank, c_custkey, xp, c_custkey = 10 AS is_me FROM
(SELECT c_custkey, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS xp FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = 2 GROUP BY 1) ORDER BY rank LIMIT 50""")
def leaderboard(t, spark):
    """The top 50 are found first; only they are numbered in one task."""
    xp = t("customer").filter("c_nationkey = 2").join(t("orders"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("xp"))
    top = xp.orderBy(F.desc("xp"), "c_custkey").limit(50)
    return top.select(F.row_number().over(W.orderBy(F.desc("xp"), "c_custkey")).alias("rank"), "c_custkey", "xp", (F.col("c_custkey") == 10).alias("is_me"))


@query("attempt_numbers", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS attempt FROM orders")
def attempt_numbers(t, spark):
    return t("orders").select("o_orderkey", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("attempt"))


@query("latest_row", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, max(o_orderdate) AS o_orderdate FROM orders GROUP BY 1")
def latest_row(t, spark):
    return t("orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"), F.max("o_orderdate").alias("o_orderdate"))


@query("last_n_history", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3")
def last_n_history(t, spark):
    last = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))
    return t("conversations").withColumn("r", last).filter("r <= 3").select("conv_id", "turn", "role").orderBy("conv_id", "turn")


@query("chat_sessions", "SELECT conv_id, count(*) AS messages, count(*) FILTER (role = 'user') AS asked, max(turn) AS last_turn FROM conversations GROUP BY 1")
def chat_sessions(t, spark):
    return t("conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), F.count_if(F.col("role") == "user").alias("asked"), F.max("turn").alias("last_turn"))


def activity(submissions: DataFrame) -> DataFrame:
    """(student, at, seq, correct, total) with streak, bonus, xp, running total and level after each submission.

    A day directly after the last active one lengthens the streak and gives
    the first submission of that day a bonus; a gap starts again at 1.
    """
    days = submissions.select("student", F.to_date("at").alias("day")).distinct()
    by = W.partitionBy("student").orderBy("day")
    days = days.withColumn("island", F.date_sub("day", F.row_number().over(by)))
    days = days.withColumn("streak", F.row_number().over(W.partitionBy("student", "island").orderBy("day")))
    rows = submissions.withColumn("day", F.to_date("at")).join(days.drop("island"), ["student", "day"])
    first = F.row_number().over(W.partitionBy("student", "day").orderBy("at", "seq")) == 1
    rows = rows.withColumn("bonus", F.when(first & (F.col("streak") >= 2), F.col("streak") * XP_PER_STREAK_DAY).otherwise(0))
    rows = rows.withColumn("xp", F.col("correct") * XP_PER_CORRECT + F.col("bonus"))
    rows = rows.withColumn("total_xp", F.sum("xp").over(W.partitionBy("student").orderBy("at", "seq").rowsBetween(W.unboundedPreceding, 0)))
    return rows.withColumn("level", S.level(F.col("total_xp")))


def badges(states: DataFrame) -> DataFrame:
    """(student, badge, at): the earliest submission that earns each badge."""
    earned = F.array_compact(F.array(
        F.when((F.col("correct") == F.col("total")) & (F.col("total") > 0), "perfect_score"), F.when(F.col("streak") >= 7, "streak_7"), F.when(F.col("streak") >= 30, "streak_30"), F.when(F.col("total_xp") >= 1000, "xp_1000"),
    ))
    return states.select("student", "at", F.explode(earned).alias("badge")).groupBy("student", "badge").agg(F.min("at").alias("at"))


def event_submissions(t) -> DataFrame:
    return t("events").select(F.col("user_id").alias("student"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), (F.col("event_id") % 4).alias("correct"), F.lit(3).cast("long").alias("total"))


_STATES = """
s AS (SELECT user_id AS student, ts AS tm, event_id AS seq, event_id % 4 AS correct, 3 AS total, ts::DATE AS day FROM events),
d AS (SELECT student, day, day - row_number() OVER (PARTITION BY student ORDER BY day)::INT AS island FROM (SELECT DISTINCT student, day FROM s)),
k AS (SELECT student, day, row_number() OVER (PARTITION BY student, island ORDER BY day) AS streak FROM d),
b AS (SELECT s.*, streak, CASE WHEN streak >= 2 AND row_number() OVER (PARTITION BY student, day ORDER BY tm, seq) = 1 THEN streak * 10 ELSE 0 END AS bonus FROM s JOIN k USING (student, day)),
x AS (SELECT *, correct * 20 + bonus AS xp FROM b),
z AS (SELECT *, sum(xp) OVER (PARTITION BY student ORDER BY tm, seq ROWS UNBOUNDED PRECEDING)::BIGINT AS total_xp FROM x)"""


@query("streaks", f"WITH {_STATES} SELECT student, seq, streak, bonus::BIGINT AS bonus FROM z")
def streaks(t, spark):
    return activity(event_submissions(t)).select("student", "seq", "streak", F.col("bonus").cast("long").alias("bonus"))


@query("xp_levels", f"WITH {_STATES} SELECT student, seq, total_xp, (SELECT count(*) FROM (VALUES (0), (100), (250), (500), (900), (1400), (2100), (3000), (4200), (5700), (7500)) v(start) WHERE start <= total_xp)::INT AS level FROM z")
def xp_levels(t, spark):
    return activity(event_submissions(t)).select("student", "seq", "total_xp", "level")


@query("badges", f"""WITH {_STATES}
SELECT student, badge, min(tm) AS "at" FROM (SELECT student, tm, unnest([CASE WHEN correct = total THEN 'perfect_score' END, CASE WHEN streak >= 7 THEN 'streak_7' END, CASE WHEN streak >= 30 THEN 'streak_30' END, CASE WHEN total_xp >= 1000 THEN 'xp_1000' END]) AS badge FROM z)
WHERE badge IS NOT NULL GROUP BY 1, 2""")
def badges_query(t, spark):
    return badges(activity(event_submissions(t)))


@query("segment_bounds", "SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_turn FROM conversations")
def segment_bounds(t, spark):
    return t("conversations").select("conv_id", "turn", F.lead("turn").over(W.partitionBy("conv_id").orderBy("turn")).alias("next_turn"))


@query("score_then_time", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderdate ASC NULLS FIRST, o_orderkey) AS place FROM orders")
def score_then_time(t, spark):
    by = W.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc_nulls_last(), F.col("o_orderdate").asc_nulls_first(), "o_orderkey")
    return t("orders").select("o_custkey", "o_orderkey", F.row_number().over(by).alias("place"))


@query("batch_ordinals", "SELECT o_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS question_order FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def batch_ordinals(t, spark):
    order = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", order.alias("question_order"))
