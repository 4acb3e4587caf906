"""Rules of texts and replies over whole tables whose rows are made to trigger every branch."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from quillspark.operators.bank import _keyword_sql, keyword_search
from quillspark.operators.text import ERRORS, arbitrate, error_class, fill_from_pool, is_mock
from quillspark.plans.registry import query


def _part_words(t):
    return t("part").withColumn("about", F.concat_ws(" ", "p_type", "p_name"))


@query("keyword_words", _keyword_sql("ring"))
def keyword_words(t, spark):
    """A word of the table: the first tier answers."""
    return keyword_search(_part_words(t), "ring", "about", "p_partkey")


@query("keyword_inside", _keyword_sql("idge"))
def keyword_inside(t, spark):
    """A piece of a word: the second tier answers."""
    return keyword_search(_part_words(t), "idge", "about", "p_partkey")


@query("missing_urgent", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey IS NOT NULL)")
def missing_urgent(t, spark):
    """Customers that no pending order names."""
    return t("customer").select("c_custkey").join(t("orders").filter("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti")


# A message of each class in the order of precedence, two of them with words of a later class, one of none.
_MESSAGES = ("No Google_API_KEY, error 429", "RESOURCE_EXHAUSTED for quota", "503 Service Unavailable: timeout", "Deadline exceeded on connect", "Blocked for SAFETY", "DNS failure", "all is well", "chưa được cấu hình")
_KINDS = (*ERRORS, None, "ai_not_configured")


@query("error_classes_planted", "SELECT conv_id, turn, [" + ", ".join("NULL" if k is None else f"'{k}'" for k in _KINDS) + f"][(conv_id + turn) % {len(_KINDS)} + 1] AS kind FROM conversations")
def error_classes_planted(t, spark):
    """Each turn with a service's message, by its class."""
    said = F.get(F.array(*map(F.lit, _MESSAGES)), ((F.col("conv_id") + F.col("turn")) % len(_MESSAGES)).cast("int"))
    return t("conversations").select("conv_id", "turn", error_class(said).alias("kind"))


@query("mock_results", """
WITH l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS r, (l_quantity < 20)::INT + (l_returnflag = 'R')::INT + (l_linestatus = 'O')::INT AS signs FROM lineitem)
SELECT o_orderkey, count(r) = 0 OR sum(signs) > 2 * count(r) AS mock FROM orders LEFT JOIN l ON l_orderkey = o_orderkey AND r <= 5 GROUP BY 1""")
def mock_results(t, spark):
    """Every order as a parse result: short questions, missing answers and missing steps by its lines."""
    q = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.repeat(F.lit("q"), F.col("l_quantity").cast("int")).alias("question"), F.when(F.col("l_returnflag") != "R", "a").alias("answer"), F.when(F.col("l_linestatus") != "O", F.array(F.lit("s"))).otherwise(F.array().cast("array<string>")).alias("solution_steps"))
    per = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(q)).alias("rows"))
    rows = t("orders").select("o_orderkey").join(per, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return rows.select("o_orderkey", is_mock(F.coalesce("rows", F.array().cast(per.schema["rows"].dataType))).alias("mock"))


@query("answer_sources", """
WITH l AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS n, first_value(l_returnflag) OVER w AS f, first_value(l_linestatus) OVER w AS s FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity)),
c AS (SELECT o, count(*) AS total, count(*) FILTER (f != 'R') AS t, count(*) FILTER (s = 'O') AS i, count(*) FILTER (f = 'A' AND s = 'F') AS x, count(*) FILTER (f != 'R' OR s = 'O') AS m FROM l GROUP BY o),
p AS (SELECT *, CASE WHEN t / total >= 0.8 THEN 0.95 ELSE t / total * 0.9 END AS tc FROM c)
SELECT o AS exam, CASE WHEN tc >= 0.6 THEN 'table' WHEN i / total * 0.85 >= 0.6 THEN 'inline' WHEN x > 0 THEN 'section' WHEN m / total * 0.8 >= 0.6 THEN 'merged' ELSE 'none' END AS source,
 round(CASE WHEN tc >= 0.6 THEN tc WHEN i / total * 0.85 >= 0.6 THEN i / total * 0.85 WHEN x > 0 THEN 0.7 WHEN m / total * 0.8 >= 0.6 THEN m / total * 0.8 ELSE 0 END, 6) AS confidence,
 CASE WHEN tc >= 0.6 THEN t WHEN i / total * 0.85 >= 0.6 THEN i WHEN x > 0 THEN x WHEN m / total * 0.8 >= 0.6 THEN m ELSE 0 END AS answers FROM p""")
def answer_sources(t, spark):
    """Every order as an exam whose lines are answered by a table, inline or in sections: which source is trusted."""
    lines = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min_by(F.struct("l_returnflag", "l_linestatus"), F.struct("l_partkey", "l_suppkey", "l_quantity")).alias("x"))
    held = lambda keep: F.map_from_entries(F.array_compact(F.collect_list(F.when(keep, F.struct("l_linenumber", F.lit("A"))))))
    f, s = F.col("x.l_returnflag"), F.col("x.l_linestatus")
    per = lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("total"), held(f != "R").alias("t"), held(s == "O").alias("i"), held((f == "A") & (s == "F")).alias("x"))
    found = arbitrate(F.col("t"), F.col("i"), F.col("x"), F.col("total"))
    return per.withColumn("a", found).select(F.col("l_orderkey").alias("exam"), "a.source", F.round("a.confidence", 6).alias("confidence"), F.size("a.answers").cast("long").alias("answers"))


@query("answer_pool", """
WITH q AS (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS pos, l_linenumber % 4 AS number, l_returnflag, l_linestatus, l_partkey FROM lineitem),
r AS (SELECT doc, pos, number, CASE WHEN l_returnflag = 'R' THEN 'Câu ' || number || '. B' ELSE 'A question about part ' || l_partkey END AS question, CASE WHEN l_linestatus = 'O' AND l_returnflag != 'R' THEN 'C' END AS answer, l_returnflag = 'R' AS bare FROM q),
p AS (SELECT doc, number, arg_max(coalesce(answer, CASE WHEN bare THEN 'B' END), pos) FILTER (answer IS NOT NULL OR bare) AS pooled FROM r GROUP BY ALL)
SELECT doc, pos, number, question, coalesce(answer, pooled) AS answer FROM r LEFT JOIN p USING (doc, number) WHERE NOT bare""")
def answer_pool(t, spark):
    """Every order as a document whose returned lines are bare key rows: they fill the blanks of their number and go."""
    pos = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    number, bare = F.col("l_linenumber") % 4, F.col("l_returnflag") == "R"
    rows = t("lineitem").select(
        F.col("l_orderkey").alias("doc"), pos.alias("pos"), number.alias("number"), F.when(bare, F.concat(F.lit("Câu "), number.cast("string"), F.lit(". B"))).otherwise(F.concat(F.lit("A question about part "), "l_partkey")).alias("question"),
        F.when((F.col("l_linestatus") == "O") & ~bare, "C").alias("answer"),
    )
    return fill_from_pool(rows).select("doc", "pos", "number", "question", "answer")
