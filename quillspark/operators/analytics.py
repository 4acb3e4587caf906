"""Dashboard, classroom and assignment analytics: joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quillspark.functions import scalars as S
from quillspark.plans.registry import query

AS_OF = "2024-01-31"


def overview(events: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """Totals, distinct topics, this week and last week, and growth, in one scan."""
    now = F.lit(as_of).cast("timestamp_ntz")
    week, two = now - F.expr("INTERVAL 7 DAYS"), now - F.expr("INTERVAL 14 DAYS")
    counts = events.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_distinct("event_type").alias("topics"),
        F.count_if(F.col("ts") >= week).alias("this_week"),
        F.count_if((F.col("ts") >= two) & (F.col("ts") < week)).alias("last_week"),
    )
    return counts.withColumn("growth", S.growth(F.col("this_week"), F.col("last_week")).cast("double"))


@query("dashboard_overview", f"""
WITH c AS (SELECT count(*) AS total, count(DISTINCT event_type) AS topics,
 count(*) FILTER (ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY) AS this_week,
 count(*) FILTER (ts >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY AND ts < TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY) AS last_week FROM events)
SELECT *, CASE WHEN last_week > 0 THEN round_even((this_week - last_week) / last_week * 100, 0) WHEN this_week > 0 THEN 100.0 ELSE 0.0 END::DOUBLE AS growth FROM c""")
def dashboard_overview(t, spark):
    return overview(t("events"))


@query("exam_totals", "SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS completed FROM orders")
def exam_totals(t, spark):
    return t("orders").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("completed"))


@query("activity_daily", f"""SELECT ts::DATE AS day, count(*) AS n FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY GROUP BY 1""")
def activity_daily(t, spark):
    since = F.lit(AS_OF).cast("timestamp_ntz") - F.expr("INTERVAL 30 DAYS")
    return t("events").filter(F.col("ts") >= since).groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("counts_by_type", "SELECT event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1")
def counts_by_type(t, spark):
    return t("events").filter("event_type is not null").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("top_topics", "SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_type LIMIT 10")
def top_topics(t, spark):
    return t("part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "p_type").limit(10)


@query("recent_activity", """
SELECT c_custkey, c_name, count(o_orderkey) AS n_orders FROM (SELECT * FROM customer ORDER BY c_custkey DESC LIMIT 10) c
LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL""")
def recent_activity(t, spark):
    newest = t("customer").orderBy(F.desc("c_custkey")).limit(10)
    return newest.join(t("orders"), F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey", "c_name").agg(F.count("o_orderkey").alias("n_orders"))


@query("author_email", "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def author_email(t, spark):
    return t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_name")


@query("preagg_left_join", """
SELECT n_nationkey, n_name, coalesce(c.n, 0) AS members, coalesce(s.n, 0) AS assignments FROM nation
LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1) c ON c_nationkey = n_nationkey
LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey""")
def preagg_left_join(t, spark):
    """Aggregates first, joins after: no fan-out between the two counts."""
    members = t("customer").filter("c_acctbal > 0").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("members"))
    assignments = t("supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("assignments"))
    out = t("nation").join(members, "n_nationkey", "left").join(assignments, "n_nationkey", "left")
    return out.select("n_nationkey", "n_name", F.coalesce("members", F.lit(0)).alias("members"), F.coalesce("assignments", F.lit(0)).alias("assignments"))


def submissions(t) -> DataFrame:
    """Orders in the role of submissions: score 0 to 100, state, class of the student."""
    o = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", (F.col("o_totalprice") % 101).cast("int").alias("score"))
    return o.join(t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_acctbal"), "o_custkey")


SUBMISSIONS_SQL = "(SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate, floor(o_totalprice % 101)::INT AS score, c_nationkey, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey)"


@query("class_summary", f"""
SELECT c_nationkey, count(DISTINCT o_custkey) FILTER (o_orderdate >= TIMESTAMP '1998-07-01') AS active_recent,
 round_even(nullif(avg(score) FILTER (o_orderstatus = 'F'), 0), 1) AS avg_score, count(*) AS submissions
FROM {SUBMISSIONS_SQL} s GROUP BY 1""")
def class_summary(t, spark):
    done = F.when(F.col("o_orderstatus") == "F", F.col("score"))
    return submissions(t).groupBy("c_nationkey").agg(
        F.count_distinct(F.when(F.col("o_orderdate") >= F.lit("1998-07-01").cast("timestamp_ntz"), F.col("o_custkey"))).alias("active_recent"),
        F.bround(S.null_if_zero(F.avg(done)), 1).alias("avg_score"), F.count(F.lit(1)).alias("submissions"),
    )


@query("student_stats", f"""
SELECT o_custkey, count(*) AS submissions, round_even(nullif(avg(score) FILTER (o_orderstatus = 'F'), 0), 1) AS avg_score, max(o_orderdate) AS last_at
FROM {SUBMISSIONS_SQL} s WHERE c_nationkey = 5 GROUP BY 1""")
def student_stats(t, spark):
    rows = submissions(t).filter("c_nationkey = 5").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("submissions"), F.bround(S.null_if_zero(F.avg(F.when(F.col("o_orderstatus") == "F", F.col("score")))), 1).alias("avg_score"), F.max("o_orderdate").alias("last_at")
    )
    return rows.orderBy(F.coalesce("avg_score", F.lit(0.0)).desc(), "o_custkey")


@query("topic_breakdown_fanout", """
SELECT p_brand, count(*) AS answers, count(DISTINCT o_orderkey) AS submissions, round_even(avg(floor(o_totalprice % 101)), 1) AS avg_score
FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE o_orderstatus = 'F' GROUP BY 1""")
def topic_breakdown_fanout(t, spark):
    """The mean is weighted by answers; the number of different submissions is given beside it."""
    rows = t("lineitem").join(t("orders").filter("o_orderstatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("part"), F.col("p_partkey") == F.col("l_partkey"))
    return rows.groupBy("p_brand").agg(F.count(F.lit(1)).alias("answers"), F.count_distinct("o_orderkey").alias("submissions"), F.bround(F.avg(F.floor(F.col("o_totalprice") % 101)), 1).alias("avg_score"))


@query("completion_rate", """
WITH latest AS (SELECT arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS p FROM orders)
SELECT round_even((SELECT count(DISTINCT o_custkey) FROM orders, latest WHERE o_orderpriority = p AND o_orderstatus = 'F') * 100.0 / (SELECT count(*) FROM customer WHERE c_acctbal > 0), 1) AS rate""")
def completion_rate(t, spark):
    """Different completers of the newest assignment over active members; may exceed 100."""
    latest = t("orders").agg(F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("o_orderpriority"))
    done = t("orders").filter("o_orderstatus = 'F'").join(F.broadcast(latest), "o_orderpriority", "left_semi").agg(F.count_distinct("o_custkey").alias("done"))
    return done.crossJoin(F.broadcast(t("customer").filter("c_acctbal > 0").agg(F.count(F.lit(1)).alias("members")))).select(S.percent(F.col("done"), F.col("members")).alias("rate"))


BINS = (("0-20", 20), ("21-40", 40), ("41-60", 60), ("61-80", 80), ("81-100", 100))


def histogram(df: DataFrame, score: Column) -> DataFrame:
    """Five right-closed bins, empty ones kept; a missing score counts as 0."""
    score = F.coalesce(score, F.lit(0))
    label = F.lit(BINS[-1][0])
    for name, top in reversed(BINS[:-1]):
        label = F.when(score <= top, name).otherwise(label)
    bins = df.sparkSession.createDataFrame([(b,) for b, _ in BINS], "bin string")
    return bins.join(df.groupBy(label.alias("bin")).agg(F.count(F.lit(1)).alias("n")), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


@query("assignment_histogram", f"""
WITH s AS (SELECT CASE WHEN score <= 20 THEN '0-20' WHEN score <= 40 THEN '21-40' WHEN score <= 60 THEN '41-60' WHEN score <= 80 THEN '61-80' ELSE '81-100' END AS bin FROM {SUBMISSIONS_SQL} x WHERE c_nationkey = 1)
SELECT b.bin, count(s.bin) AS n FROM (VALUES ('0-20'), ('21-40'), ('41-60'), ('61-80'), ('81-100')) b(bin) LEFT JOIN s USING (bin) GROUP BY 1""")
def assignment_histogram(t, spark):
    return histogram(submissions(t).filter("c_nationkey = 1"), F.col("score"))


@query("assignment_stats", """
SELECT o_orderpriority, count(*) AS submitted, round_even(avg(coalesce(CASE WHEN o_orderstatus = 'F' THEN floor(o_totalprice % 101) END, 0)), 1) AS avg_score,
 round_even(count(*) FILTER (o_orderstatus = 'F') * 100.0 / count(*), 1) AS completion FROM orders GROUP BY 1""")
def assignment_stats(t, spark):
    return t("orders").groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("submitted"), F.bround(F.avg(F.coalesce(F.when(F.col("o_orderstatus") == "F", F.floor(F.col("o_totalprice") % 101)), F.lit(0))), 1).alias("avg_score"),
        S.percent(F.count_if(F.col("o_orderstatus") == "F"), F.count(F.lit(1))).alias("completion"),
    )


@query("hardest_items", """
SELECT p_partkey, count(*) AS total, count(*) FILTER (l_returnflag = 'R') AS correct FROM lineitem JOIN part ON p_partkey = l_partkey
GROUP BY 1 HAVING count(*) > 0 ORDER BY count(*) FILTER (l_returnflag = 'R') / count(*), p_partkey LIMIT 5""")
def hardest_items(t, spark):
    rows = t("lineitem").join(t("part").select("p_partkey"), F.col("p_partkey") == F.col("l_partkey")).groupBy("p_partkey").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("l_returnflag") == "R").alias("correct"))
    return rows.filter("total > 0").orderBy(F.col("correct") / F.col("total"), "p_partkey").limit(5)


@query("weak_topics", """
WITH r AS (SELECT o_custkey, p_brand, count(l_orderkey) AS answers, avg(CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 END) AS r FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)
SELECT o_custkey, p_brand, answers, round_even(r, 4) AS rate FROM r QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY r NULLS FIRST, p_brand) <= 5""")
def weak_topics(t, spark):
    """The five lowest rates of each customer; ungraded answers count as answers but not in the rate."""
    mark = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 0)
    rows = t("lineitem").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("part").select("p_partkey", "p_brand"), F.col("p_partkey") == F.col("l_partkey"))
    rows = rows.groupBy("o_custkey", "p_brand").agg(F.count("l_orderkey").alias("answers"), F.avg(mark).alias("r"))
    place = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.col("r").asc_nulls_first(), "p_brand"))
    return rows.withColumn("place", place).filter("place <= 5").select("o_custkey", "p_brand", "answers", F.bround("r", 4).alias("rate"))


@query("batch_counts", "SELECT o_orderpriority, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS completed FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1")
def batch_counts(t, spark):
    return t("orders").filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("completed"))


@query("reconcile_totals", """
SELECT o_orderkey, count(l_orderkey) AS question_count, coalesce(sum(l_quantity::DECIMAL(8,2)), 0)::DOUBLE AS total_points FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def reconcile_totals(t, spark):
    rows = t("orders").join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return rows.groupBy("o_orderkey").agg(F.count("l_orderkey").alias("question_count"), F.coalesce(F.sum(F.col("l_quantity").cast("decimal(8,2)")), F.lit(0)).cast("double").alias("total_points"))


@query("delete_impact", """
SELECT (SELECT count(*) FROM orders WHERE o_custkey = 7) AS quizzes, (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey = 7) AS answers,
 (SELECT count(DISTINCT l_partkey) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey = 7) AS questions""")
def delete_impact(t, spark):
    mine = t("orders").filter("o_custkey = 7").select("o_orderkey")
    rows = mine.join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return rows.agg(F.count_distinct("o_orderkey").alias("quizzes"), F.count("l_orderkey").alias("answers"), F.count_distinct("l_partkey").alias("questions"))


@query("admin_counters", """
SELECT (SELECT count(*) FROM customer) AS users, (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS active, (SELECT count(*) FROM documents) AS questions,
 (SELECT coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1)) AS duplicates""")
def admin_counters(t, spark):
    users = t("customer").agg(F.count(F.lit(1)).alias("users"), F.count_if(F.col("c_acctbal") > 0).alias("active"))
    per = t("documents").groupBy(F.md5("text").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return users.crossJoin(F.broadcast(per.agg(F.sum("n").alias("questions"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicates"))))


@query("curriculum_tree", """
SELECT r_name, n_name, count(s_suppkey) AS n FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL
UNION ALL SELECT r_name, NULL, count(s_suppkey) FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY r_name
UNION ALL SELECT NULL, NULL, count(s_suppkey) FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey""")
def curriculum_tree(t, spark):
    """Lesson counts rolled up to chapters and the whole."""
    rows = t("region").join(t("nation"), F.col("n_regionkey") == F.col("r_regionkey")).join(t("supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return rows.rollup("r_name", "n_name").agg(F.count("s_suppkey").alias("n"))


def nested_tree(leaves: DataFrame) -> DataFrame:
    """(grade, chapter, lesson, n) as one row a grade with nested, ordered chapters and lessons and their totals."""
    chapters = leaves.groupBy("grade", "chapter").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("lesson", "n"))).alias("lessons"))
    return chapters.groupBy("grade").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("chapter", "n", "lessons"))).alias("chapters"))


@query("summary_strings", "SELECT r_name, r_name || ': ' || string_agg(DISTINCT n_name, '|' ORDER BY n_name) AS summary FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def summary_strings(t, spark):
    rows = t("region").join(t("nation"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.array_join(F.array_sort(F.collect_set("n_name")), "|").alias("s"))
    return rows.select("r_name", F.concat("r_name", F.lit(": "), "s").alias("summary"))


def most_common(df: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """The most frequent value of each group; of equals, the one seen first."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("seen"))
    return counts.groupBy(by).agg(F.max_by(value, F.struct("n", (-F.col("seen")).alias("early"))).alias(value), F.max("n").alias("n"))


@query("mode_infer", """
SELECT source, lang, n FROM (SELECT source, lang, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, min(doc_id)) AS r FROM documents GROUP BY 1, 2) WHERE r = 1""")
def mode_infer(t, spark):
    return most_common(t("documents"), "source", "lang", "doc_id")


@query("verification_stats", """
SELECT count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS correct, count(*) FILTER (l_returnflag = 'A') AS wrong, count(*) FILTER (l_returnflag = 'N') AS ambiguous,
 count(*) FILTER (l_returnflag = 'A' AND l_linestatus = 'F') AS fixed FROM lineitem""")
def verification_stats(t, spark):
    is_ = lambda c, v: F.col(c) == v
    return t("lineitem").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_("l_returnflag", "R")).alias("correct"), F.count_if(is_("l_returnflag", "A")).alias("wrong"), F.count_if(is_("l_returnflag", "N")).alias("ambiguous"), F.count_if(is_("l_returnflag", "A") & is_("l_linestatus", "F")).alias("fixed"))


def usage_observed(df: DataFrame, tokens: Column, name: str = "usage"):
    """The frame and an Observation that adds up token usage while it runs."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.sum(tokens).alias("tokens"), F.count(F.lit(1)).alias("calls")), seen


def grouped_sections(flat: DataFrame) -> DataFrame:
    """(pos, section, instruction, passage, question...) as sections in order of first appearance; the first non-empty passage of a section wins."""
    text = lambda c: F.when(F.trim(c) != "", F.col(c))
    groups = flat.groupBy("section", "instruction").agg(F.min("pos").alias("at"), F.min_by(text("passage"), F.when(text("passage").isNotNull(), F.col("pos"))).alias("passage"), F.min(F.when(text("passage").isNotNull(), F.col("pos"))).alias("passage_at"), F.array_sort(F.collect_list(F.struct("pos", "question"))).alias("questions"))
    sections = groups.groupBy("section").agg(F.min("at").alias("at"), F.min_by("passage", "passage_at").alias("passage"), F.array_sort(F.collect_list(F.struct("at", "instruction", "questions"))).alias("groups"))
    return sections.orderBy("at")


@query("grouped_by_difficulty", """
SELECT CASE WHEN n_chars < 500 THEN 'NB' WHEN n_chars < 2000 THEN 'TH' WHEN n_chars < 6000 THEN 'VD' ELSE 'VDC' END AS difficulty, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1""")
def grouped_by_difficulty(t, spark):
    from quillspark.operators.filters import bank

    rows = bank(t).groupBy("difficulty").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))
    return rows.orderBy(S.difficulty_rank(F.col("difficulty")))


@query("page_with_total", "SELECT p_partkey, (SELECT count(*) FROM part WHERE p_size = 5) AS total FROM part WHERE p_size = 5 ORDER BY p_partkey LIMIT 10 OFFSET 10")
def page_with_total(t, spark):
    """A page and the number of all rows, counted by aggregation, not in one window."""
    rows = t("part").filter("p_size = 5").select("p_partkey")
    return rows.orderBy("p_partkey").offset(10).limit(10).crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("total"))))


@query("topic_ranking_stable", "SELECT o_orderkey, try_cast(regexp_extract(o_orderpriority, '([0-9]+)', 1) AS INT) AS k FROM orders ORDER BY k, o_orderkey")
def topic_ranking_stable(t, spark):
    k = F.coalesce(F.regexp_extract("o_orderpriority", "([0-9]+)", 1).try_cast("int"), F.lit(999))
    return t("orders").select("o_orderkey", k.alias("k")).orderBy("k", "o_orderkey")


@query("shaped_children", """
SELECT o_orderkey, count(*) AS n, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) AS lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def shaped_children(t, spark):
    rows = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list("l_linenumber")).alias("ls"))
    return t("orders").join(rows, "o_orderkey").select("o_orderkey", F.size("ls").cast("long").alias("n"), F.array_join(F.col("ls").cast("array<string>"), ",").alias("lines"))


@query("existence_probe", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS enrolled FROM customer")
def existence_probe(t, spark):
    seen = t("orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("enrolled", F.lit(True))
    return t("customer").join(seen, "c_custkey", "left").select("c_custkey", F.coalesce("enrolled", F.lit(False)).alias("enrolled"))


@query("missing_ids", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def missing_ids(t, spark):
    return t("customer").join(t("orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("last_wins_merge", """
SELECT l_orderkey, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC) AS r FROM lineitem) WHERE r = 1""")
def last_wins_merge(t, spark):
    return t("lineitem").groupBy("l_orderkey").agg(F.max_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("l_partkey"))
