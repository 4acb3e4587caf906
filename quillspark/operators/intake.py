"""From texts to saved questions: the parse path around a model, batch saving with flags, type maps, account rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quillspark.functions import scalars as S
from quillspark.operators.quizzes import DIFFICULTY
from quillspark.operators.replies import json_salvage
from quillspark.operators.text import chunk_text, fill_from_pool
from quillspark.plans.registry import query
from quillspark.plans.staging import staged

# A quiz question's type as the bank's.
BANK_TYPES = {"multiple_choice": "TN", "checkbox": "TN", "true_false": "TN", "fill_blank": "TL", "reorder": "TL", "essay": "DS"}


def _mapped(value: Column, by: dict[str, str], otherwise: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in by.items() for x in pair]), value), otherwise)


def bank_type(quiz_type: Column) -> Column:
    """The bank's code of a quiz type; others are open questions."""
    return _mapped(quiz_type, BANK_TYPES, F.lit("TL"))


def bank_difficulty(word: Column) -> Column:
    """The bank's code of a quiz difficulty; a code stays, others are unknown."""
    return _mapped(word, {v: k for k, v in DIFFICULTY.items()}, F.when(word.isin(*DIFFICULTY), word))


@query("bank_codes", """
WITH q AS (SELECT p_partkey, ['multiple_choice', 'checkbox', 'true_false', 'fill_blank', 'reorder', 'essay', 'matching', NULL][p_partkey % 8 + 1] AS t, ['easy', 'medium', 'hard', 'expert', 'NB', 'odd', NULL][p_size % 7 + 1] AS d FROM part)
SELECT p_partkey, CASE WHEN t IN ('multiple_choice', 'checkbox', 'true_false') THEN 'TN' WHEN t = 'essay' THEN 'DS' ELSE 'TL' END AS type, CASE d WHEN 'easy' THEN 'NB' WHEN 'medium' THEN 'TH' WHEN 'hard' THEN 'VD' WHEN 'expert' THEN 'VDC' WHEN 'NB' THEN 'NB' END AS difficulty FROM q""")
def bank_codes(t, spark):
    """Every part as a quiz question of some type and difficulty, in the bank's codes."""
    kind = F.get(F.array(*map(F.lit, ("multiple_choice", "checkbox", "true_false", "fill_blank", "reorder", "essay", "matching")), F.lit(None).cast("string")), (F.col("p_partkey") % 8).cast("int"))
    level = F.get(F.array(*map(F.lit, ("easy", "medium", "hard", "expert", "NB", "odd")), F.lit(None).cast("string")), F.col("p_size") % 7)
    return t("part").select("p_partkey", bank_type(kind).alias("type"), bank_difficulty(level).alias("difficulty"))


def password_fault(password: Column) -> Column:
    """Why a password is refused: short, letter, digit; null for a good one."""
    return F.when(F.length(F.coalesce(password, F.lit(""))) < 8, "short").when(~password.rlike("[A-Za-z]"), "letter").when(~password.rlike("[0-9]"), "digit")


def name_ok(name: Column) -> Column:
    """An empty name is none; any other has two characters besides blanks."""
    return F.coalesce(F.length(name) == 0, F.lit(True)) | (F.length(F.trim(name)) >= 2)


@query("account_rules", """
WITH a AS (SELECT c_custkey, [c_name, '1234567', c_mktsegment || c_custkey, c_mktsegment || 'xyz', '12345678' || c_custkey][c_custkey % 5 + 1] AS p, ['', ' x ', c_name, NULL][c_custkey % 4 + 1] AS n FROM customer)
SELECT c_custkey, CASE WHEN length(p) < 8 THEN 'short' WHEN NOT regexp_matches(p, '[A-Za-z]') THEN 'letter' WHEN NOT regexp_matches(p, '[0-9]') THEN 'digit' END AS fault, coalesce(length(n) = 0, true) OR length(trim(n)) >= 2 AS name_ok FROM a""")
def account_rules(t, spark):
    """Every customer with a password and a name of some kind."""
    k = F.col("c_custkey")
    said = F.array("c_name", F.lit("1234567"), F.concat("c_mktsegment", k.cast("string")), F.concat("c_mktsegment", F.lit("xyz")), F.concat(F.lit("12345678"), k.cast("string")))
    names = F.array(F.lit(""), F.lit(" x "), F.col("c_name"), F.lit(None).cast("string"))
    return t("customer").select("c_custkey", password_fault(F.get(said, (k % 5).cast("int"))).alias("fault"), name_ok(F.get(names, (k % 4).cast("int"))).alias("name_ok"))


def registered_tokens(calls: DataFrame) -> DataFrame:
    """(user, token, platform, seq) registrations in order -> the tokens that stand: one a user, with the platform last told.

    A new token takes the place of the user's others; the same one again only
    changes its platform; blank ones are refused.
    """
    rows = calls.withColumn("token", F.trim("token")).filter("token != ''")
    return rows.groupBy("user").agg(F.max_by(F.struct("token", "platform"), "seq").alias("x")).select("user", "x.token", "x.platform")


@query("token_register", """
WITH c AS (SELECT user_id, event_id, trim(CASE WHEN floor(value)::INT % 7 = 0 THEN '  ' ELSE ' token-' || (event_id % 3) || ' ' END) AS token, event_type FROM events)
SELECT user_id AS user, arg_max(token, event_id) AS token, arg_max(event_type, event_id) AS platform FROM c WHERE token != '' GROUP BY 1""")
def token_register(t, spark):
    token = F.when(F.floor("value").cast("int") % 7 == 0, "  ").otherwise(F.concat(F.lit(" token-"), (F.col("event_id") % 3).cast("string"), F.lit(" ")))
    return registered_tokens(t("events").select(F.col("user_id").alias("user"), token.alias("token"), F.col("event_type").alias("platform"), F.col("event_id").alias("seq")))


def json_list(value: Column) -> Column:
    """A JSON list that holds something; anything else is null."""
    held = F.from_json(F.when(F.ltrim(value).startswith("[") & F.try_parse_json(value).isNotNull(), value), "array<string>")
    return F.when(F.size(held) > 0, held)


def typed_answer(answer: Column, kind: Column) -> Column:
    """(object, text): a JSON object for the types that are answered blank by blank, else the text; nothing is the empty text."""
    fields = F.from_json(F.when(kind.isin("matching", "matching_headings", "fill_blank") & F.trim(answer).startswith("{") & F.try_parse_json(answer).isNotNull(), answer), "map<string,string>")
    return F.struct(fields.alias("object"), F.when(fields.isNull(), F.coalesce(answer, F.lit(""))).alias("text"))


@query("json_fields", """
WITH e AS (SELECT event_id, event_id % 6 AS k, floor(value)::INT AS v FROM events)
SELECT event_id, CASE WHEN k = 0 THEN 2 END AS choices, CASE WHEN k IN (3, 4) THEN NULL ELSE ['["a",' || v || ']', '[]', '', '', '', '{"B1":"' || v || '"}'][k + 1] END AS text, CASE WHEN k IN (3, 4) THEN v::VARCHAR END AS b1 FROM e""")
def json_fields(t, spark):
    """Every event with a field of some shape, read as choices and as an answer."""
    k, v = (F.col("event_id") % 6).cast("int"), F.floor("value").cast("int").cast("string")
    field = F.get(F.array(F.concat(F.lit('["a",'), v, F.lit("]")), F.lit("[]"), F.lit(""), F.concat(F.lit('{"B1":"'), v, F.lit('"}')), F.concat(F.lit(' {"B1":"'), v, F.lit('"}')), F.concat(F.lit('{"B1":"'), v, F.lit('"}'))), k)
    rows = t("events").select("event_id", json_list(field).alias("c"), typed_answer(field, F.when(k == 5, "essay").otherwise("matching")).alias("a"))
    return rows.select("event_id", F.when(F.col("c").isNotNull(), F.size("c")).alias("choices"), "a.text", F.try_element_at(F.col("a.object"), F.lit("B1")).alias("b1"))


def saved_batch(rows: DataFrame, bank: DataFrame, text: str = "text") -> DataFrame:
    """(exam, user, pos, text) and (exam, user, text) -> (exam, pos, saved, is_bank_duplicate) of the rows that say something.

    Of equal texts of an exam the first is saved.  It is flagged where the
    same user has the text in another exam; bank rows without an exam do not
    count, nor do other users' rows.
    """
    rows = rows.filter(F.trim(text) != "").withColumn("h", S.content_hash(F.col(text)))
    first = rows.groupBy("exam", "h").agg(F.min("pos").alias("first"))
    held = bank.filter("exam is not null").select("user", S.content_hash(F.col(text)).alias("h"), "exam").distinct().groupBy("user", "h").agg(F.min("exam").alias("low"), F.max("exam").alias("high"))
    out = rows.join(first, ["exam", "h"]).join(held, ["user", "h"], "left")
    other = (F.col("low") != F.col("exam")) | (F.col("high") != F.col("exam"))
    saved = F.col("pos") == F.col("first")
    return out.select("exam", "pos", saved.alias("saved"), (saved & F.coalesce(other, F.lit(False))).alias("is_bank_duplicate"))


_HASH = r"md5(lower(trim(regexp_replace({0}, '\s+', ' ', 'g'))))"


@query("saved_batches", f"""
WITH d AS (SELECT doc_id % 50 AS exam, source AS u, doc_id AS pos, text, {_HASH.format('text')} AS h FROM documents WHERE trim(text) != '' AND source IS NOT NULL),
f AS (SELECT *, row_number() OVER (PARTITION BY exam, h ORDER BY pos) = 1 AS saved FROM d)
SELECT exam, pos, saved, saved AND EXISTS (SELECT 1 FROM d o WHERE o.u = f.u AND o.h = f.h AND o.exam != f.exam) AS is_bank_duplicate FROM f""")
def saved_batches(t, spark):
    """All documents as questions of fifty exams, each of its source's user."""
    rows = t("documents").filter("source is not null").select((F.col("doc_id") % 50).alias("exam"), F.col("source").alias("user"), F.col("doc_id").alias("pos"), "text")
    return saved_batch(rows, rows.filter("trim(text) != ''").select("exam", "user", "text"))


@query("saved_counts", f"""
WITH d AS (SELECT doc_id % 50 AS exam, {_HASH.format('text')} AS h FROM documents WHERE trim(text) != '' AND source IS NOT NULL)
SELECT exam, count(DISTINCT h) AS saved, count(*) - count(DISTINCT h) AS skipped FROM d GROUP BY 1""")
def saved_counts(t, spark):
    """How many questions of each exam were saved and how many skipped."""
    return saved_batches(t, spark).groupBy("exam").agg(F.count_if("saved").alias("saved"), F.count_if(~F.col("saved")).alias("skipped"))


ITEM = "array<struct<question:string,answer:string,number:int>>"


def parsed_texts(docs: DataFrame, provider: Callable[[Column], Column], most: int = 15_000) -> DataFrame:
    """(doc, text) -> (doc, pos, number, question, answer): the whole path from a text to its questions.

    Texts are cut into chunks, each chunk's reply is asked of ``provider`` (a
    column expression or a batched function), read as far as it can be, and
    the pieces are put together in order: of questions that agree in their
    first 100 letters the first stays, and answers that stand alone fill the
    blanks of their number.
    """
    pieces = docs.select("doc", F.posexplode(chunk_text(F.col("text"), F.lit(most))).alias("chunk", "said"))
    # Asked once: a reply costs far more than its storage.
    replies = staged(pieces.withColumn("reply", provider(F.col("said"))).select("doc", "chunk", "reply"))
    rows = replies.select("doc", "chunk", F.posexplode(F.from_json(json_salvage("reply"), ITEM)).alias("place", "q")).filter("trim(q.question) != ''")
    key = F.substring(F.lower(F.trim(F.regexp_replace("q.question", "\\s+", " "))), 1, 100)
    # Places differ within a document, so the least of them brings its question along.
    first = rows.groupBy("doc", key.alias("key")).agg(F.min(F.struct("chunk", "place", "q")).alias("x"))
    flat = first.select("doc", F.row_number().over(W.partitionBy("doc").orderBy("x.chunk", "x.place")).alias("pos"), "x.q.number", "x.q.question", "x.q.answer")
    place = F.row_number().over(W.partitionBy("doc").orderBy("pos"))
    return fill_from_pool(flat).select("doc", place.alias("pos"), "number", "question", "answer")


@query("parse_path", """
WITH l AS (SELECT l_orderkey AS doc, l_linenumber AS n, min(l_partkey) AS part, min(l_linestatus) AS s FROM lineitem GROUP BY ALL)
SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY n) AS pos, n AS number, 'Question about part ' || part || ' of line ' || n AS question, CASE WHEN s = 'O' THEN 'B' ELSE 'C' END AS answer FROM l""")
def parse_path(t, spark):
    """Every order as an exam text of several chunks; the stand-in for a model gives back the chunk, cut off and with a key row of its own.

    Each question comes twice, so the second is dropped; open lines have their
    answer in the reply, the others in a bare key row.
    """
    lines = t("lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("n")).agg(F.min("l_partkey").alias("part"), F.min("l_linestatus").alias("s"))
    said = F.concat(F.lit("Câu "), F.col("n").cast("string"), F.lit(": "), F.to_json(F.struct(F.concat(F.lit("Question about part "), F.col("part").cast("string"), F.lit(" of line "), F.col("n").cast("string")).alias("question"), F.when(F.col("s") == "O", "B").otherwise("").alias("answer"), F.col("n").alias("number"))), F.lit("\n"))
    docs = lines.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", said.alias("x")))), lambda q: q["x"]), "").alias("text"))

    def echo(chunk: Column) -> Column:
        found = F.regexp_extract_all(chunk, F.lit(r"(?m)^Câu \d+: (\{.*\})$"), F.lit(1))
        keys = F.transform(F.filter(found, lambda q: q.contains('"answer":""')), lambda q: F.concat(F.lit('{"question":"Câu '), F.regexp_extract(q, r'"number":(\d+)', 1), F.lit('. C","answer":"","number":'), F.regexp_extract(q, r'"number":(\d+)', 1), F.lit("}")))
        return F.concat(F.lit("Here you are:\n["), F.array_join(F.concat(found, keys, found), ", "), F.lit(', {"question": "cut'))

    return parsed_texts(docs, echo, 250)
