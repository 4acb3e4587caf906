"""The question bank's own jobs: keyword search with fallback, groups of duplicates, counters, conversions and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quillspark.functions import scalars as S
from quillspark.operators.similarity import _COS, clusters, links_above, pairs_above, tokens, vectors
from quillspark.plans.registry import query
from quillspark.plans.staging import staged


def keyword_search(rows: DataFrame, word: str, text: str, key: str, limit: int = 200) -> DataFrame:
    """Rows that hold the word as a token, else those that hold it anywhere; the first ``limit`` by key.

    One pass over the table: each row is put in the better tier it belongs
    to, and the best tier that anything is in answers.
    """
    found = rows.select(F.col(key), F.when(F.array_contains(tokens(F.col(text)), word), 1).when(F.lower(text).contains(word), 2).alias("tier")).filter("tier is not null")
    first = found.agg(F.min("tier").alias("tier"))
    return found.join(F.broadcast(first), "tier").orderBy(key).limit(limit).select(key, "tier")


def _keyword_sql(word: str) -> str:
    return f"""
WITH f AS (SELECT p_partkey, CASE WHEN list_contains(regexp_split_to_array(lower(p_type || ' ' || p_name), '[^a-z0-9]+'), '{word}') THEN 1 WHEN contains(lower(p_type || ' ' || p_name), '{word}') THEN 2 END AS tier FROM part)
SELECT p_partkey, tier FROM f WHERE tier = (SELECT min(tier) FROM f) ORDER BY p_partkey LIMIT 200"""


@query("keyword_index", _keyword_sql("steel"))
def keyword_index(t, spark):
    return keyword_search(t("part").withColumn("about", F.concat_ws(" ", "p_type", "p_name")), "steel", "about", "p_partkey")


@query("keyword_fallback", _keyword_sql("art"))
def keyword_fallback(t, spark):
    return keyword_search(t("part").withColumn("about", F.concat_ws(" ", "p_type", "p_name")), "art", "about", "p_partkey")


@query("two_roles", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, a.n_name AS customer_nation, b.n_name AS supplier_nation FROM lineitem JOIN orders ON o_orderkey = l_orderkey
JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation a ON a.n_nationkey = c_nationkey JOIN nation b ON b.n_nationkey = s_nationkey""")
def two_roles(t, spark):
    """An edge's two ends, both looked up in the same table."""
    role = lambda name: t("nation").select(F.col("n_nationkey").alias(f"{name}_key"), F.col("n_name").alias(f"{name}_nation"))
    edges = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    edges = edges.join(t("customer").select("c_custkey", F.col("c_nationkey").alias("customer_key")), F.col("c_custkey") == F.col("o_custkey")).join(t("supplier").select("s_suppkey", F.col("s_nationkey").alias("supplier_key")), F.col("s_suppkey") == F.col("l_suppkey"))
    return edges.join(role("customer"), "customer_key").join(role("supplier"), "supplier_key").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "customer_nation", "supplier_nation")


def duplicate_groups(edges: DataFrame) -> DataFrame:
    """(a, b, score) edges of any kind -> (group_id, members, max_score, is_exact) of each group they connect.

    ``group_id`` is the least member; a group is exact when an edge of it has score 1.
    """
    edges = staged(edges.select("a", "b", "score"))
    labels = clusters(edges.select("a", "b"))
    scores = edges.join(labels.withColumnRenamed("id", "a"), "a").groupBy("label").agg(F.max("score").alias("top"))
    members = labels.groupBy("label").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return members.join(scores, "label").select(F.col("label").alias("group_id"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("members"), F.round("top", 4).alias("max_score"), (F.col("top") >= 1).alias("is_exact"))


def member_scores(edges: DataFrame) -> DataFrame:
    """(a, b, score) edges -> (id, best): each member's best similarity to any other."""
    return edges.select(F.col("a").alias("id"), "score").union(edges.select("b", "score")).groupBy("id").agg(F.round(F.max("score"), 4).alias("best"))


_EDGES = f"""h AS (SELECT a.vec_id AS a, b.vec_id AS b, 1.0::DOUBLE AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND a.label = b.label AND a.vec_id % 40 = b.vec_id % 40),
v AS (SELECT a.vec_id AS a, b.vec_id AS b, {_COS} AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {_COS} >= 0.42),
e AS (SELECT a, b, max(score) AS score FROM (SELECT * FROM h UNION ALL SELECT * FROM v) GROUP BY a, b)"""


def _edges(t, found=None) -> DataFrame:
    """Exact edges (equal key) and vector edges; where both are, the exact one counts.  Copies are tied to the next one of their key, not each to each.  ``found`` makes the vector edges, all pairs if not told."""
    e = t("embeddings").select(F.col("vec_id").alias("a"), "label", (F.col("vec_id") % 40).alias("m"))
    exact = e.withColumn("b", F.lead("a").over(W.partitionBy("label", "m").orderBy("a"))).filter("b is not null").select("a", "b", F.lit(1.0).alias("score"))
    v = vectors(t)
    near = pairs_above(v, v, 0.42, later_only=True) if found is None else found(v, v, 0.42)
    return exact.unionByName(near.select("a", "b", "score")).groupBy("a", "b").agg(F.max("score").alias("score"))


@query("duplicate_groups", f"""
WITH RECURSIVE {_EDGES}, u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS id, a AS reach FROM u UNION SELECT r.id, u.b FROM r JOIN u ON r.reach = u.a),
l AS (SELECT id, min(reach) AS label FROM r GROUP BY id)
SELECT label AS group_id, string_agg(id::VARCHAR, ',' ORDER BY id) AS members, round(any_value(s.top), 4) AS max_score, any_value(s.top) >= 1 AS is_exact
FROM l JOIN (SELECT label, max(score) AS top FROM e JOIN l ON l.id = e.a GROUP BY label) s USING (label) GROUP BY label""")
def duplicate_groups_query(t, spark):
    """Exact and vector edges together, grouped over the whole table."""
    return duplicate_groups(_edges(t, links_above))


@query("duplicate_members", f"WITH {_EDGES} SELECT id, round(max(score), 4) AS best FROM (SELECT a AS id, score FROM e UNION ALL SELECT b, score FROM e) GROUP BY id")
def duplicate_members(t, spark):
    return member_scores(_edges(t))


@query("sample_dedup", "SELECT substring(text, 1, 80) AS k, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def sample_dedup(t, spark):
    """Samples that agree in their first 80 characters count once."""
    return t("documents").groupBy(F.substring("text", 1, 80).alias("k")).agg(F.min("doc_id").alias("doc_id"))


@query("generated_duplicates", f"""
WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, {_COS} AS s FROM embeddings a JOIN embeddings b ON a.vec_id % 10 = 0 AND b.vec_id % 10 != 0 WHERE {_COS} >= 0.3),
k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM p QUALIFY r <= 3)
SELECT e.vec_id AS id, count(k.b) AS n, coalesce(string_agg(k.b::VARCHAR, ',' ORDER BY r), '') AS like_ids, round(max(s), 4) AS best FROM embeddings e LEFT JOIN k ON k.a = e.vec_id WHERE e.vec_id % 10 = 0 GROUP BY e.vec_id""")
def generated_duplicates(t, spark):
    """Each new item (every tenth) against the bank of all others: how many are alike, the three most so, and the best."""
    v = vectors(t)
    new, bank = v.filter("id % 10 = 0"), v.filter("id % 10 != 0")
    place = F.row_number().over(W.partitionBy("a").orderBy(F.desc("score"), "b"))
    near = pairs_above(new, bank, 0.3).withColumn("r", place).filter("r <= 3").groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("r", "b"))).alias("bs"), F.max("score").alias("best"))
    ids = F.array_join(F.transform("bs", lambda x: x["b"].cast("string")), ",")
    return new.select("id").join(near, F.col("a") == F.col("id"), "left").select("id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(ids, F.lit("")).alias("like_ids"), F.round("best", 4).alias("best"))


@query("view_counters", """
SELECT c_custkey, coalesce(n, 0) AS view_count, coalesce(p, 0) AS point_delta FROM customer
LEFT JOIN (SELECT user_id, count(*) FILTER (event_type = 'view') AS n, sum(CASE WHEN event_type = 'purchase' THEN round(value)::BIGINT ELSE 0 END) AS p FROM events GROUP BY 1) ON user_id = c_custkey""")
def view_counters(t, spark):
    """Counters come from the rows they count, never from increments, so running a job twice changes nothing."""
    seen = t("events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("n"), F.sum(F.when(F.col("event_type") == "purchase", F.round("value").cast("bigint")).otherwise(0)).alias("p"))
    return t("customer").join(seen, F.col("user_id") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("view_count"), F.coalesce("p", F.lit(0)).alias("point_delta"))


@query("voted_difficulty", """
WITH v AS (SELECT l_partkey, l_returnflag AS d, count(*) AS n FROM lineitem GROUP BY ALL), w AS (SELECT *, sum(n) OVER (PARTITION BY l_partkey) AS total FROM v QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, d) = 1)
SELECT p_partkey, CASE WHEN n * 2 > total AND total >= 3 THEN d ELSE p_size::VARCHAR END AS difficulty FROM part LEFT JOIN w ON l_partkey = p_partkey""")
def voted_difficulty(t, spark):
    """A majority of three votes or more replaces the difficulty; else it stays."""
    votes = t("lineitem").groupBy("l_partkey", F.col("l_returnflag").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    winner = votes.groupBy("l_partkey").agg(F.min_by(F.struct("d", "n"), F.struct(-F.col("n"), "d")).alias("w"), F.sum("n").alias("total"))
    sure = (F.col("w.n") * 2 > F.col("total")) & (F.col("total") >= 3)
    return t("part").join(winner, F.col("l_partkey") == F.col("p_partkey"), "left").select("p_partkey", F.when(sure, F.col("w.d")).otherwise(F.col("p_size").cast("string")).alias("difficulty"))


@query("derived_cleanup", "SELECT vec_id FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE text IS NOT NULL AND length(trim(text)) > 0)")
def derived_cleanup(t, spark):
    """Vector rows whose document is gone (or empty) go with it."""
    alive = t("documents").filter(F.length(F.trim("text")) > 0).select("doc_id")
    return t("embeddings").join(alive, F.col("doc_id") == F.col("vec_id"), "left_semi").select("vec_id")


@query("saved_sets", "SELECT l_orderkey AS exam_id, first(l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey) AS subject, count(*) AS questions FROM lineitem GROUP BY 1")
def saved_sets(t, spark):
    """A generated set becomes an exam; its subject is that of the first question."""
    return t("lineitem").groupBy(F.col("l_orderkey").alias("exam_id")).agg(F.min_by("l_returnflag", F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("subject"), F.count(F.lit(1)).alias("questions"))


# A bank question's type as a quiz question's, and difficulty codes of the bank by those of a quiz.
QUIZ_TYPES = {"multiple_choice": "multiple_choice", "fill_blank": "fill_blank", "true_false": "true_false", "matching": "matching"}


def quiz_type(bank_type: Column, n_choices: Column) -> Column:
    """A known type stays; otherwise choices make a multiple-choice question, and none a blank to fill."""
    return F.when(bank_type.isin(*QUIZ_TYPES), bank_type).when(F.coalesce(n_choices, F.lit(0)) > 1, "multiple_choice").otherwise("fill_blank")


@query("bank_to_quiz", """
SELECT o_orderkey, CASE WHEN count(l_orderkey) > 1 THEN 'multiple_choice' ELSE 'fill_blank' END AS type, coalesce(string_agg(l_partkey::VARCHAR, ' | ' ORDER BY l_linenumber, l_partkey), '') AS shown
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def bank_to_quiz(t, spark):
    """Bank questions with their choices as quiz questions."""
    lines = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("c"))
    rows = t("orders").select("o_orderkey").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return rows.select("o_orderkey", quiz_type(F.lit(None).cast("string"), F.size("c")).alias("type"), F.coalesce(F.array_join(F.transform("c", lambda x: x["l_partkey"].cast("string")), " | "), F.lit("")).alias("shown"))


def answer_text(kind: Column, answer: Column) -> Column:
    """A JSON answer as a line to show: items of a list joined, pairs as ``left - right``, text as it is."""
    items = F.from_json(answer, "array<string>")
    pairs = F.from_json(answer, "map<string,string>")
    shown = F.array_join(F.transform(F.array_sort(F.map_entries(pairs)), lambda e: F.concat_ws(" - ", e["key"], e["value"])), "; ")
    return F.when(kind.isin("multi", "ordering"), F.array_join(items, ", ")).when(kind == "matching", shown).otherwise(answer)


@query("cached_results", """
SELECT doc_id, lag(doc_id) OVER (PARTITION BY md5(text) ORDER BY doc_id) AS cached FROM documents WHERE length(text) >= 100
QUALIFY cached IS NOT NULL""")
def cached_results(t, spark):
    """For each upload that passes the quality gate, the latest earlier one with the same hash."""
    good = t("documents").filter(F.length("text") >= 100).select("doc_id", F.md5("text").alias("h"))
    return good.withColumn("cached", F.lag("doc_id").over(W.partitionBy("h").orderBy("doc_id"))).filter("cached is not null").select("doc_id", "cached")


@query("chapter_retrieval", f"""
WITH q AS (SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY label), n AS (SELECT greatest(2, 8 // count(*)) AS k FROM q),
s AS (SELECT q.label AS chapter, b.vec_id AS id, {_COS} AS s FROM q JOIN embeddings a ON a.vec_id = q.vec_id JOIN embeddings b ON b.label = q.label AND b.vec_id != q.vec_id),
t AS (SELECT *, max(s) OVER (PARTITION BY chapter) >= 0.25 AS near FROM s)
SELECT chapter, id, near FROM t WHERE NOT near OR s >= 0.25 QUALIFY row_number() OVER (PARTITION BY chapter ORDER BY CASE WHEN near THEN -s ELSE 0 END, id) <= (SELECT k FROM n)""")
def chapter_retrieval(t, spark):
    """Samples of each chapter: those most like its first item, or where none is like it the first by id; more for few chapters."""
    e = t("embeddings").select("label", "vec_id", "embedding")
    asked = e.groupBy("label").agg(F.min_by(F.struct(F.col("vec_id").alias("own"), F.col("embedding").alias("q")), "vec_id").alias("x")).select("label", "x.own", "x.q")
    k = asked.agg(F.greatest(F.lit(2), F.floor(F.lit(8) / F.count(F.lit(1)))).alias("k"))
    rows = e.join(asked, "label").filter("vec_id != own").withColumn("s", S.cosine(F.col("q"), F.col("embedding"))).drop("q", "embedding")
    rows = rows.withColumn("near", F.max("s").over(W.partitionBy("label")) >= 0.25).filter("not near or s >= 0.25")
    place = F.row_number().over(W.partitionBy("label").orderBy(F.when(F.col("near"), -F.col("s")).otherwise(0.0), "vec_id"))
    return rows.withColumn("r", place).crossJoin(F.broadcast(k)).filter("r <= k").select(F.col("label").alias("chapter"), F.col("vec_id").alias("id"), "near")


@query("generator_samples", """
WITH r AS (SELECT o_orderpriority AS difficulty, o_orderstatus AS topic, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders)
SELECT difficulty, topic, string_agg(o_orderkey::VARCHAR, ',' ORDER BY n) AS samples FROM r WHERE n <= 5 GROUP BY ALL""")
def generator_samples(t, spark):
    """The five newest questions of each topic and difficulty."""
    place = F.row_number().over(W.partitionBy("o_orderpriority", "o_orderstatus").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    rows = t("orders").withColumn("n", place).filter("n <= 5").groupBy(F.col("o_orderpriority").alias("difficulty"), F.col("o_orderstatus").alias("topic"))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "o_orderkey"))), lambda x: x["o_orderkey"].cast("string")), ",").alias("samples"))


def canonical_code(code: Column, prefix: str) -> Column:
    """Trimmed and in capitals, with the prefix where it is lacking."""
    plain = F.upper(F.trim(code))
    return F.when(plain.startswith(prefix), plain).otherwise(F.concat(F.lit(prefix), plain))


@query("scalar_rules", """
SELECT event_id, CASE WHEN starts_with(upper(trim(event_type)), 'P') THEN upper(trim(event_type)) ELSE 'P' || upper(trim(event_type)) END AS code, starts_with(event_type, 'view') AS is_push,
       date_diff('second', TIMESTAMP '2020-01-01', date_trunc('second', ts)) AS elapsed, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, strftime(ts, '%d/%m/%Y') AS shown,
       CASE event_type WHEN 'view' THEN 'NB' WHEN 'click' THEN 'TH' WHEN 'purchase' THEN 'VD' ELSE 'VDC' END AS level, length(event_type) >= 5 AND regexp_matches(event_type, '[a-z]') AS name_ok FROM events""")
def scalar_rules(t, spark):
    """Codes, prefixes, elapsed seconds, dates to show, mapped enums and naming rules of all events."""
    kind = F.col("event_type")
    level = F.when(kind == "view", "NB").when(kind == "click", "TH").when(kind == "purchase", "VD").otherwise("VDC")
    return t("events").select(
        "event_id", canonical_code(kind, "P").alias("code"), kind.startswith("view").alias("is_push"), (F.unix_timestamp(F.date_trunc("second", "ts")) - F.unix_timestamp(F.lit("2020-01-01 00:00:00"))).alias("elapsed"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.date_format("ts", "dd/MM/yyyy").alias("shown"), level.alias("level"), ((F.length(kind) >= 5) & kind.rlike("[a-z]")).alias("name_ok"),
    )
