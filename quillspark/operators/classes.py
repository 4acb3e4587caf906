"""Class views for all classes at once, and pages that go on from a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quillspark.functions import scalars as S
from quillspark.operators.analytics import BINS, SUBMISSIONS_SQL, submissions
from quillspark.plans.registry import query


def student_statistics(rows: DataFrame, keys: list[str], score: Column, done: Column, at: Column) -> DataFrame:
    """Submissions, mean score of those completed (none for a mean of 0) and last time, for each of ``keys``: one aggregation, however many students."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("submissions"), F.bround(S.null_if_zero(F.avg(F.when(done, score))), 1).alias("avg_score"), F.max(at).alias("last_at"))


@query("students_by_class", f"""
SELECT c_nationkey, o_custkey, count(*) AS submissions, round_even(nullif(avg(score) FILTER (o_orderstatus = 'F'), 0), 1) AS avg_score, max(o_orderdate) AS last_at FROM {SUBMISSIONS_SQL} s GROUP BY 1, 2""")
def students_by_class(t, spark):
    """The students of every class."""
    return student_statistics(submissions(t), ["c_nationkey", "o_custkey"], F.col("score"), F.col("o_orderstatus") == "F", F.col("o_orderdate"))


def histograms(rows: DataFrame, keys: list[str], score: Column) -> DataFrame:
    """Five right-closed bins for each of ``keys`` that has rows, empty ones kept: counted in one pass, unfolded afterwards."""
    score = F.coalesce(score, F.lit(0))
    low, counts = None, []
    for name, top in BINS:
        inside = score <= top if low is None else (score > low) & (score <= top) if name != BINS[-1][0] else score > low
        counts.append(F.count_if(inside).alias(name))
        low = top
    per = rows.groupBy(*keys).agg(*counts)
    return per.select(*keys, F.explode(F.array(*[F.struct(F.lit(name).alias("bin"), F.col(f"`{name}`").alias("n")) for name, _ in BINS])).alias("b")).select(*keys, "b.bin", "b.n")


@query("histograms_by_class", f"""
WITH s AS (SELECT c_nationkey, CASE WHEN score <= 20 THEN '0-20' WHEN score <= 40 THEN '21-40' WHEN score <= 60 THEN '41-60' WHEN score <= 80 THEN '61-80' ELSE '81-100' END AS bin FROM {SUBMISSIONS_SQL} x),
k AS (SELECT DISTINCT c_nationkey FROM s), b AS (SELECT * FROM (VALUES ('0-20'), ('21-40'), ('41-60'), ('61-80'), ('81-100')) v(bin))
SELECT k.c_nationkey, b.bin, count(s.bin) AS n FROM k CROSS JOIN b LEFT JOIN s ON s.c_nationkey = k.c_nationkey AND s.bin = b.bin GROUP BY 1, 2""")
def histograms_by_class(t, spark):
    return histograms(submissions(t), ["c_nationkey"], F.col("score"))


def leaderboards(rows: DataFrame, group: str, member: str, points: Column, top: int = 50) -> DataFrame:
    """(group, rank, member, xp): the best of each group; no task passes on more than ``top`` of one."""
    xp = rows.groupBy(group, member).agg(F.sum(points).alias("xp"))
    return xp.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(F.desc("xp"), member))).filter(F.col("rank") <= top).select(group, "rank", member, F.col("xp").cast("double").alias("xp"))


@query("leaderboards_by_class", """
SELECT c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY x DESC, c_custkey) AS rank, c_custkey, x::DOUBLE AS xp FROM
(SELECT c_nationkey, c_custkey, sum(o_totalprice::DECIMAL(18,2)) AS x FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2) QUALIFY rank <= 50""")
def leaderboards_by_class(t, spark):
    rows = t("customer").select("c_nationkey", "c_custkey").join(t("orders").select("o_custkey", "o_totalprice"), F.col("o_custkey") == F.col("c_custkey"))
    return leaderboards(rows, "c_nationkey", "c_custkey", F.col("o_totalprice").cast("decimal(18,2)"))


@query("delete_impacts", """
SELECT c_custkey, count(DISTINCT o_orderkey) AS quizzes, count(l_orderkey) AS answers, count(DISTINCT l_partkey) AS questions FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def delete_impacts(t, spark):
    """What goes with each owner: lines are counted for each quiz before quizzes meet their owner."""
    per = t("lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("answers"))
    quizzes = t("orders").select("o_orderkey", "o_custkey").join(per, F.col("l_orderkey") == F.col("o_orderkey"), "left").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("quizzes"), F.coalesce(F.sum("answers"), F.lit(0)).alias("answers"))
    parts = t("lineitem").select("l_orderkey", "l_partkey").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("c_custkey"), "l_partkey").distinct().groupBy("c_custkey").agg(F.count("l_partkey").alias("questions"))
    out = t("customer").select("c_custkey").join(quizzes.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left").join(parts, "c_custkey", "left")
    return out.na.fill(0, ["quizzes", "answers", "questions"])


def page_after(rows: DataFrame, key: str, after, n: int) -> DataFrame:
    """The ``n`` rows whose key comes next: a filter that reaches the scan and a top-n, as cheap on the last page as on the first."""
    return (rows if after is None else rows.filter(F.col(key) > F.lit(after))).orderBy(key).limit(n)


@query("pages_by_key", """
SELECT page, p_partkey FROM (SELECT p_partkey, (row_number() OVER (ORDER BY p_partkey) - 1) // 10 AS page FROM part WHERE p_size = 5) WHERE page < 3""")
def pages_by_key(t, spark):
    """Three pages, each from where the one before ended."""
    rows, out, after = t("part").filter("p_size = 5").select("p_partkey"), None, None
    for page in range(3):
        held = [r[0] for r in page_after(rows, "p_partkey", after, 10).collect()]  # a page
        if not held and page:
            break
        shown = spark.createDataFrame([(page, k) for k in held], "page long, p_partkey long")
        out, after = shown if out is None else out.unionByName(shown), held[-1] if held else after
    return out
