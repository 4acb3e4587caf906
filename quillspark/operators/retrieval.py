"""What a chat or an embedding model is given: enriched texts, and samples by a cascade of searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quillspark.functions import scalars as S
from quillspark.plans.registry import query
from quillspark.plans.staging import staged

# Least similarities with and without the class, and the words and letters that the last search looks for.
WITH_GRADE, ANY_GRADE, WORDS, LETTERS = 0.3, 0.35, 6, 30


def enriched(text: Column, topic: Column, grade: Column, chapter: Column, difficulty: Column) -> Column:
    """A text with its class, chapter, topic (unless it is the chapter) and difficulty before it; blank parts are left out."""
    some = lambda x: F.when(F.coalesce(x, F.lit("")) != "", x)
    parts = F.array_compact(F.array(F.when(F.coalesce(grade, F.lit(0)) != 0, F.concat(F.lit("Toán "), grade.cast("string"))), F.substring(some(chapter), 1, 80), F.when(~topic.eqNullSafe(chapter), F.substring(some(topic), 1, 60)), some(difficulty)))
    body = F.substring(F.coalesce(text, F.lit("")), 1, 500)
    return F.when(F.size(parts) > 0, F.concat(F.array_join(parts, " | "), F.lit(": "), body)).otherwise(body)


@query("enriched_texts", """
WITH d AS (SELECT doc_id, text, CASE WHEN doc_id % 4 != 0 THEN 6 + doc_id % 4 END AS g, CASE WHEN doc_id % 3 = 0 THEN '' ELSE substring(text, 1, 90) END AS c, CASE WHEN doc_id % 5 = 0 THEN substring(text, 1, 90) WHEN doc_id % 5 < 3 THEN source || source || source || source || source || source || source || source || source || source || source || source END AS t, CASE WHEN doc_id % 7 < 4 THEN 'TH' END AS f FROM documents),
p AS (SELECT doc_id, text, list_filter([CASE WHEN g IS NOT NULL THEN 'Toán ' || g END, CASE WHEN coalesce(c, '') != '' THEN substring(c, 1, 80) END, CASE WHEN coalesce(t, '') != '' AND t IS DISTINCT FROM c THEN substring(t, 1, 60) END, f], lambda x: x IS NOT NULL) AS parts FROM d)
SELECT doc_id, CASE WHEN len(parts) > 0 THEN array_to_string(parts, ' | ') || ': ' ELSE '' END || substring(coalesce(text, ''), 1, 500) AS enriched FROM p""")
def enriched_texts(t, spark):
    """All documents with metadata of every kind: missing, blank, long, the topic equal to the chapter."""
    k = F.col("doc_id")
    chapter = F.when(k % 3 == 0, "").otherwise(F.substring("text", 1, 90))
    topic = F.when(k % 5 == 0, F.substring("text", 1, 90)).when(k % 5 < 3, F.repeat("source", F.lit(12)))
    return t("documents").select("doc_id", enriched(F.col("text"), topic, F.when(k % 4 != 0, 6 + k % 4), chapter, F.when(k % 7 < 4, "TH")).alias("enriched"))


def cascade(asked: DataFrame, bank: DataFrame, most: int = 3) -> DataFrame:
    """(request, text, grade, q) and (id, text, grade, v, has_steps) -> (request, tier, pos, id).

    Tier 1: the nearest of the class; tier 2: the nearest of any class, where
    a class was given; tier 3: texts that hold the request's first words, of
    the class, by id.  Of the nearest only those with steps are used, so a
    tier may answer with fewer; the first tier that answers counts.  A request
    without a vector or a row without one meets in tier 3 only.
    """
    # Requests are users' questions: few at a time.
    # A text is lowered once, not once a request.
    pairs = bank.withColumn("low", F.lower("text")).join(F.broadcast(asked.select("request", F.col("text").alias("said"), F.col("grade").alias("wanted"), "q")))
    s = F.when(F.col("v").isNotNull() & F.col("q").isNotNull(), S.cosine(F.col("v"), F.col("q")))
    words = F.slice(F.filter(F.split("said", "\\s+"), lambda w: w != ""), 1, WORDS)
    key = F.substring(F.array_join(words, " "), 1, LETTERS)
    in_grade = F.col("wanted").isNull() | F.col("wanted").eqNullSafe(F.col("grade"))
    pairs = pairs.select("request", "wanted", "id", "has_steps", s.alias("s"), in_grade.alias("in_grade"), F.col("low").contains(F.lower(key)).alias("held"))
    # Compared once: what no tier can use is left out, the rest is read by each.
    pairs = staged(pairs.filter(((F.col("s") >= WITH_GRADE) & F.col("in_grade")) | ((F.col("s") >= ANY_GRADE) & F.col("wanted").isNotNull()) | F.expr("held and in_grade and has_steps")))
    near = F.row_number().over(W.partitionBy("request").orderBy(F.desc("s"), "id"))
    plain = F.row_number().over(W.partitionBy("request").orderBy("id"))
    one = pairs.filter((F.col("s") >= WITH_GRADE) & F.col("in_grade")).select("request", "id", "has_steps", near.alias("pos")).withColumn("tier", F.lit(1))
    two = pairs.filter((F.col("s") >= ANY_GRADE) & F.col("wanted").isNotNull()).select("request", "id", "has_steps", near.alias("pos")).withColumn("tier", F.lit(2))
    three = pairs.filter("held and in_grade and has_steps").select("request", "id", "has_steps", plain.alias("pos")).withColumn("tier", F.lit(3))
    tiers = one.unionByName(two).unionByName(three).filter((F.col("pos") <= most) & F.col("has_steps"))
    first = tiers.groupBy("request").agg(F.min("tier").alias("tier"))
    return tiers.join(first, ["request", "tier"]).select("request", "tier", F.row_number().over(W.partitionBy("request").orderBy("pos")).alias("pos"), "id")


@query("chat_cascade", """
WITH b AS (SELECT doc_id AS id, text, label % 4 AS grade, embedding, doc_id % 3 != 0 AS has_steps FROM documents LEFT JOIN embeddings ON vec_id = doc_id),
r AS (SELECT vec_id AS request, text AS said, CASE WHEN vec_id % 4 = 0 THEN NULL ELSE vec_id % 5 END AS wanted, embedding AS q FROM embeddings JOIN documents ON doc_id = vec_id WHERE vec_id < 24),
m AS (SELECT request, wanted, id, has_steps, list_cosine_similarity(b.embedding::DOUBLE[], q::DOUBLE[]) AS s, wanted IS NULL OR wanted IS NOT DISTINCT FROM grade AS in_grade,
 contains(lower(text), lower(substring(array_to_string(list_filter(regexp_split_to_array(said, '\\s+'), lambda w: w != '')[:6], ' '), 1, 30))) AS held FROM r, b),
t AS (SELECT request, 1 AS tier, id, has_steps, row_number() OVER (PARTITION BY request ORDER BY s DESC, id) AS pos FROM m WHERE s >= 0.3 AND in_grade
 UNION ALL SELECT request, 2, id, has_steps, row_number() OVER (PARTITION BY request ORDER BY s DESC, id) FROM m WHERE s >= 0.35 AND wanted IS NOT NULL
 UNION ALL SELECT request, 3, id, has_steps, row_number() OVER (PARTITION BY request ORDER BY id) FROM m WHERE held AND in_grade AND has_steps), u AS (SELECT * FROM t WHERE pos <= 3 AND has_steps)
SELECT request, tier, (row_number() OVER (PARTITION BY request ORDER BY pos))::INTEGER AS pos, id FROM u WHERE tier = (SELECT min(tier) FROM u v WHERE v.request = u.request)""".replace("\\\\s", "\\s"))
def chat_cascade(t, spark):
    """A user's last questions (the first vectors stand for them) against all documents and their vectors."""
    e = t("embeddings")
    bank = t("documents").join(e, F.col("vec_id") == F.col("doc_id"), "left").select(F.col("doc_id").alias("id"), "text", (F.col("label") % 4).alias("grade"), F.col("embedding").alias("v"), (F.col("doc_id") % 3 != 0).alias("has_steps"))
    asked = e.filter("vec_id < 24").join(t("documents"), F.col("vec_id") == F.col("doc_id")).select(F.col("vec_id").alias("request"), "text", F.when(F.col("vec_id") % 4 != 0, (F.col("vec_id") % 5).cast("int")).alias("grade"), F.col("embedding").alias("q"))
    return cascade(asked, bank)
