"""Row changes on immutable tables: each returns the table after the change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quillspark.functions import scalars as S
from quillspark.plans.registry import query


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], version: list[str] | None = None) -> DataFrame:
    """The change wins over the row with its key; of several changes, the last by ``version``."""
    if version:
        rest = [c for c in changes.columns if c not in keys]
        last = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("_x"))
        changes = last.select(*keys, *[F.col("_x")[c].alias(c) for c in rest])
    return table.join(changes, keys, "left_anti").unionByName(changes.select(*table.columns))


def patch(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Fields that a change sets; nulls leave the old value."""
    new = changes.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in changes.columns if c != key])
    set_ = {c for c in changes.columns if c != key}
    return table.join(new, key, "left").select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in set_ else F.col(c) for c in table.columns])


def publishable(public: Column, answer: Column) -> Column:
    """Only what has an answer can be made public."""
    return public & (F.trim(F.coalesce(answer, F.lit(""))) != "")


def delete_owned(table: DataFrame, ids: DataFrame, key: str, owner: Column, most: int | None = 200) -> DataFrame:
    """Without the named rows of the owner; a request that names more than ``most`` is rejected, never cut short."""
    if most is not None and ids.limit(most + 1).count() > most:
        raise ValueError(f"no more than {most} rows can be deleted at a time")
    gone = table.filter(owner).join(ids, key, "left_semi").select(key)
    return table.join(gone, key, "left_anti")


def insert_absent(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """New rows whose key is free; of equal ones the first by their other columns."""
    rest = [c for c in table.columns if c not in keys]
    new = rows.groupBy(*keys).agg(*[F.min_by(c, F.struct(*rest)).alias(c) for c in rest]) if rest else rows.distinct()
    return table.unionByName(new.join(table, keys, "left_anti").select(*table.columns))


def replace_group(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Everything of the groups that ``rows`` holds is replaced by it; running it twice changes nothing."""
    return table.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows.select(*table.columns))


def overwrite_groups(rows: DataFrame, path: str, key: str) -> None:
    """The same on disk: partitions of the groups written are replaced, others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def abandon_stale(attempts: DataFrame) -> DataFrame:
    """Attempts in progress that a later one of the same student replaced."""
    last = attempts.groupBy("student", "quiz").agg(F.max("attempt").alias("_last"))
    state = F.when((F.col("status") == "in_progress") & (F.col("attempt") < F.col("_last")), "abandoned").otherwise(F.col("status"))
    return attempts.join(last, ["student", "quiz"]).withColumn("status", state).drop("_last")


def fan_out(assignment: DataFrame, class_ids: list[int]) -> DataFrame:
    """One assignment row for each class named."""
    return assignment.withColumn("class_id", F.explode(F.array(*map(F.lit, class_ids))))


def with_title(sessions: DataFrame, messages: DataFrame, default: str = "New chat") -> DataFrame:
    """A session with the default title takes its first question's first 60 characters."""
    first = messages.filter("role = 'user'").groupBy("session_id").agg(F.min_by("content", F.struct("created_at", "msg_id")).alias("_first"))
    return sessions.join(first, "session_id", "left").withColumn("title", F.when((F.col("title") == default) & F.col("_first").isNotNull(), F.substring("_first", 1, 60)).otherwise(F.col("title"))).drop("_first")


def import_result(asked: DataFrame, bank: DataFrame, key: str, usable: Column) -> DataFrame:
    """Each requested id with ``imported`` or why it was skipped."""
    found = asked.join(bank.withColumn("_ok", usable).select(key, "_ok"), key, "left")
    return found.select(key, F.when(F.col("_ok").isNull(), "not_found").when(~F.col("_ok"), "no_answer").otherwise("imported").alias("result"))


@query("upsert_latest", """
WITH c AS (SELECT o_orderkey, 'X' AS o_orderstatus FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT 100000000, 'N')
SELECT o.o_orderkey, coalesce(c.o_orderstatus, o.o_orderstatus) AS o_orderstatus FROM orders o LEFT JOIN c USING (o_orderkey) UNION ALL SELECT 100000000, 'N'""")
def upsert_latest(t, spark):
    base = t("orders").select("o_orderkey", "o_orderstatus")
    one = base.filter("o_orderkey % 5 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.lit(2).alias("v"))
    changes = one.unionByName(one.withColumn("o_orderstatus", F.lit("old")).withColumn("v", F.lit(1))).unionByName(spark.range(1).select(F.lit(100000000).cast("long").alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), F.lit(1).alias("v")))
    return upsert(base, changes, ["o_orderkey"], ["v"])


@query("partial_update", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE p_size END AS p_size, p_brand FROM part")
def partial_update(t, spark):
    base = t("part").select("p_partkey", "p_size", "p_brand")
    return patch(base, base.filter("p_partkey % 3 = 0").select("p_partkey", F.lit(1).alias("p_size"), F.lit(None).cast("string").alias("p_brand")), "p_partkey")


@query("bulk_delete", "SELECT c_custkey FROM customer WHERE NOT (c_nationkey = 3 AND c_custkey % 2 = 0)")
def bulk_delete(t, spark):
    base = t("customer").select("c_custkey", "c_nationkey")
    return delete_owned(base, base.filter("c_custkey % 2 = 0").select("c_custkey"), "c_custkey", F.col("c_nationkey") == 3, most=None).select("c_custkey")


@query("insert_if_absent", "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT 77, 'NEW'")
def insert_if_absent(t, spark):
    base = t("nation").select("n_nationkey", "n_name")
    rows = spark.createDataFrame([(77, "NEW"), (77, "OTHER"), (1, "TAKEN")], base.schema)
    return insert_absent(base, rows, ["n_nationkey"])


@query("abandoned_attempts", """
SELECT o_orderkey AS attempt, CASE WHEN o_orderstatus = 'O' AND o_orderkey < max(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority) THEN 'abandoned' WHEN o_orderstatus = 'O' THEN 'in_progress' ELSE o_orderstatus END AS status FROM orders""")
def abandoned_attempts(t, spark):
    rows = t("orders").select(F.col("o_custkey").alias("student"), F.col("o_orderpriority").alias("quiz"), F.col("o_orderkey").alias("attempt"), F.when(F.col("o_orderstatus") == "O", "in_progress").otherwise(F.col("o_orderstatus")).alias("status"))
    return abandon_stale(rows).select("attempt", "status")


def quiz_json(quizzes: DataFrame, questions: DataFrame, theories: DataFrame) -> DataFrame:
    """One JSON document a quiz; hints point to (theory, section) places instead of row ids, so an import elsewhere finds them."""
    place = theories.select("quiz_id", "section_id", (F.dense_rank().over(W.partitionBy("quiz_id").orderBy("theory_order")) - 1).alias("theory_idx"), (F.row_number().over(W.partitionBy("quiz_id", "theory_order").orderBy("section_order")) - 1).alias("section_idx"))
    q = questions.join(place, (questions["quiz_id"] == place["quiz_id"]) & (questions["hint_section_id"] == place["section_id"]), "left").select(questions["quiz_id"], F.struct("pos", "question", "answer", "points", F.when(F.col("theory_idx").isNotNull(), F.struct("theory_idx", "section_idx")).alias("hint")).alias("q"))
    per = q.groupBy("quiz_id").agg(F.array_sort(F.collect_list("q")).alias("questions"))
    return quizzes.join(per, "quiz_id", "left").select("quiz_id", F.to_json(F.struct("title", F.coalesce("questions", F.array().cast(per.schema["questions"].dataType)).alias("questions"))).alias("json"))


@query("quiz_json_export", """
SELECT l_orderkey AS quiz_id, '[' || string_agg('{"line":' || l_linenumber || ',"part":' || l_partkey || '}', ',' ORDER BY l_linenumber, l_partkey) || ']' AS body FROM lineitem GROUP BY 1""")
def quiz_json_export(t, spark):
    rows = t("lineitem").groupBy(F.col("l_orderkey").alias("quiz_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part")))).alias("q"))
    return rows.select("quiz_id", F.to_json("q").alias("body"))


def html_document(questions: DataFrame) -> DataFrame:
    """(exam, pos, question, answer) as one printable HTML text an exam."""
    item = F.concat(F.lit("<li>"), S.html_escaped(F.col("question")), F.lit("<p class='answer'>"), S.html_escaped(F.coalesce("answer", F.lit(""))), F.lit("</p></li>"))
    rows = questions.groupBy("exam").agg(F.array_sort(F.collect_list(F.struct("pos", item.alias("s")))).alias("x"))
    return rows.select("exam", F.concat(F.lit("<ol>"), F.array_join(F.transform("x", lambda i: i["s"]), ""), F.lit("</ol>")).alias("html"))


def latex_document(questions: DataFrame, title: Column) -> DataFrame:
    """(exam, pos, question) as one LaTeX text an exam; only the title is escaped, questions hold LaTeX already."""
    rows = questions.groupBy("exam").agg(F.array_sort(F.collect_list(F.struct("pos", F.concat(F.lit("\\item "), F.col("question")).alias("s")))).alias("x"))
    return rows.select("exam", F.concat(F.lit("\\section*{"), S.latex_escaped(title), F.lit("}\n\\begin{enumerate}\n"), F.array_join(F.transform("x", lambda i: i["s"]), "\n"), F.lit("\n\\end{enumerate}")).alias("latex"))


def audit_sink(events: DataFrame, path: str) -> None:
    """Append-only JSON records."""
    events.write.mode("append").json(path)
