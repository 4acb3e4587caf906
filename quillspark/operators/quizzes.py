"""Bank questions as quiz questions and back, whole quizzes as documents, samples for a generator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quillspark.functions import scalars as S
from quillspark.operators.text import choices, mark_choice
from quillspark.plans.registry import query

# Difficulty codes of the bank and of quizzes, types with data of their own, and all types that can be asked for.
DIFFICULTY = {"NB": "easy", "TH": "medium", "VD": "hard", "VDC": "expert"}
STRUCTURED = ("matching", "matching_headings", "true_false_not_given", "yes_no_not_given")
FORCED = ("multiple_choice", "checkbox", "fill_blank", "true_false", "reorder", "essay")
_CHOICE_LINE = r"(?m)^\s*[A-H]\s*[.):\]]\s*.*"


def quiz_difficulty(code: Column) -> Column:
    """The quiz's word for a code of the bank; others stay."""
    known = F.create_map(*[F.lit(x) for pair in DIFFICULTY.items() for x in pair])
    return F.coalesce(F.try_element_at(known, code), code)


def _json(text: Column) -> Column:
    """A JSON text as it is, another text as a JSON string."""
    return F.when(F.try_parse_json(text).isNotNull(), text).otherwise(F.to_json(F.struct(text.alias("v")), {"ignoreNullFields": "false"}).substr(F.lit(6), F.length(F.to_json(F.struct(text.alias("v")))) - 6))


def _blank(answer: Column) -> Column:
    return F.to_json(F.struct(F.coalesce(answer, F.lit("")).alias("B1")))


def as_quiz_questions(bank: DataFrame, target: str | None = None) -> DataFrame:
    """(id, question, type, difficulty, answer, extra) -> (id, type, text, difficulty, choices, answer, has_correct_answer).

    Answers are JSON texts.  Structured types with their own data (``extra``
    is a JSON object) go over as they are; blanks with data keep a map of
    answers.  Otherwise lettered choices in the text make a multiple-choice
    question, marked by the answer, and the text before them is the question;
    a text without choices is one blank.  A forced ``target`` is what is
    left when no model helps: empty choices, no order, true.
    """
    found = choices(F.col("question"))
    has = found.isNotNull()
    extra = F.coalesce(F.schema_of_variant(F.try_parse_json("extra")).startswith("OBJECT") & (F.trim("extra") != "{}"), F.lit(False))
    structured, blanks = extra & F.col("type").isin(*STRUCTURED), extra & (F.col("type") == "fill_blank")
    key = mark_choice(found, F.coalesce("answer", F.lit("")))
    marked = F.transform(found, lambda c: F.struct(c["key"].alias("key"), c["text"].alias("text"), (c["key"] == key).alias("is_correct")))
    stem = F.trim(F.regexp_replace(F.regexp_extract("question", r"(?s)^(.*?)(?=^\s*[A-H]\s*[.):\]])".replace("(?s)", "(?sm)"), 1), r"\s+$", ""))
    text = F.when(has & ~structured & ~blanks, stem).otherwise(F.coalesce("question", F.lit("")))
    none = F.lit(None).cast("string")
    quoted = lambda x: F.when(x.isNotNull(), F.concat(F.lit('"'), x, F.lit('"')))
    auto = F.when(has, F.struct(F.lit("multiple_choice").alias("type"), quoted(key).alias("answer"), F.lit(True).alias("known"))).otherwise(F.struct(F.lit("fill_blank").alias("type"), _blank(F.col("answer")).alias("answer"), F.lit(True).alias("known")))
    to = lambda kind, answer, known=True: F.struct(F.lit(kind).alias("type"), answer.alias("answer"), F.lit(known).alias("known"))
    if target not in FORCED:
        chosen = auto
    elif target == "multiple_choice":
        chosen = F.when(has, auto).otherwise(to("multiple_choice", none))
    else:
        chosen = {"checkbox": to("checkbox", F.lit("[]")), "fill_blank": to("fill_blank", _blank(F.col("answer"))), "true_false": to("true_false", F.lit("true")), "reorder": to("reorder", F.lit("[]")), "essay": to("essay", none, False)}[target]
    stored = _json(F.coalesce("answer", F.lit("")))
    chosen = F.when(structured, F.struct(F.col("type").alias("type"), stored.alias("answer"), F.lit(True).alias("known"))).when(blanks, F.struct(F.lit("fill_blank").alias("type"), F.when(stored.startswith("{"), stored).otherwise(_blank(F.col("answer"))).alias("answer"), F.lit(True).alias("known"))).otherwise(chosen)
    empty = F.transform(F.array(*map(F.lit, "ABCD")), lambda k: F.struct(k.alias("key"), F.lit("").alias("text"), F.lit(False).alias("is_correct")))
    shown = F.when(structured | blanks, F.lit(None)).when(F.lit(target == "checkbox"), empty).when(F.col("_c.type") == "multiple_choice", F.coalesce(marked, empty))
    out = bank.withColumn("_c", chosen)
    return out.select("id", F.col("_c.type").alias("type"), text.alias("text"), quiz_difficulty(F.col("difficulty")).alias("difficulty"), shown.alias("choices"), F.col("_c.answer").alias("answer"), F.col("_c.known").alias("has_correct_answer"))


def shown_answer(kind: Column, answer: Column) -> Column:
    """A quiz answer (JSON) as the bank's plain text: keys and orders joined by commas, accepted blanks by bars, True or False; nothing for none."""
    items = F.from_json(F.when(answer.startswith("["), answer), "array<string>")
    plain = F.when(answer.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), answer, F.lit("}")), "$.v")).otherwise(answer)
    joined = F.when(kind.isin("checkbox", "reorder"), F.array_join(items, ", ")).when(kind == "fill_blank", F.array_join(items, " | "))
    return F.coalesce(F.when(answer == "null", "").when(kind == "true_false", F.initcap(plain)).otherwise(F.coalesce(joined, plain)), F.lit(""))


@query("bank_conversion", """
WITH b AS (SELECT p_partkey AS id, p_partkey % 6 AS k, p_name, p_brand, ['NB', 'TH', 'VD', 'VDC', 'other', NULL][p_size % 6 + 1] AS d FROM part)
SELECT id, CASE k WHEN 0 THEN 'multiple_choice' WHEN 1 THEN 'fill_blank' WHEN 2 THEN 'matching' WHEN 3 THEN 'fill_blank' WHEN 4 THEN 'true_false_not_given' ELSE 'multiple_choice' END AS type,
 CASE WHEN k IN (0, 5) THEN 'Which of ' || p_name || '?' ELSE 'About ' || p_name END AS text, CASE d WHEN 'NB' THEN 'easy' WHEN 'TH' THEN 'medium' WHEN 'VD' THEN 'hard' WHEN 'VDC' THEN 'expert' ELSE d END AS difficulty,
 CASE WHEN k IN (0, 5) THEN 'A=' || p_brand || ',B=none' END AS choices,
 CASE k WHEN 0 THEN '"A"' WHEN 1 THEN '{"B1":"' || p_brand || '"}' WHEN 2 THEN '{"1":"' || p_brand || '"}' WHEN 3 THEN '{"B1":"' || p_brand || '"}' WHEN 4 THEN '"NG"' ELSE '"B"' END AS answer,
 CASE k WHEN 0 THEN 'A' WHEN 1 THEN '{"B1":"' || p_brand || '"}' WHEN 2 THEN '{"1":"' || p_brand || '"}' WHEN 3 THEN '{"B1":"' || p_brand || '"}' WHEN 4 THEN 'NG' ELSE 'B' END AS shown FROM b""")
def bank_conversion(t, spark):
    """Every part as a bank question of one of six kinds, converted and its answer shown."""
    k = F.col("p_partkey") % 6
    asked = F.concat(F.lit("Which of "), F.col("p_name"), F.lit("?\nA. "), F.col("p_brand"), F.lit("\nB) none"))
    kinds = F.when(k == 2, "matching").when(k == 3, "fill_blank").when(k == 4, "true_false_not_given").otherwise("TN")
    answer = F.when(k == 0, F.concat(F.lit("1: "), F.col("p_brand"))).when(k == 2, F.concat(F.lit('{"1":"'), F.col("p_brand"), F.lit('"}'))).when(k == 4, "NG").when(k == 5, "b").otherwise(F.col("p_brand"))
    level = F.get(F.array(*map(F.lit, ("NB", "TH", "VD", "VDC", "other")), F.lit(None).cast("string")), F.col("p_size") % 6)
    bank = t("part").select(F.col("p_partkey").alias("id"), F.when(k.isin(0, 5), asked).otherwise(F.concat(F.lit("About "), F.col("p_name"))).alias("question"), kinds.alias("type"), level.alias("difficulty"), answer.alias("answer"), F.when(k.isin(2, 3, 4), '{"word_limit":2}').alias("extra"))
    out = as_quiz_questions(bank)
    said = F.array_join(F.transform("choices", lambda c: F.concat(c["key"], F.lit("="), c["text"])), ",")
    return out.select("id", "type", "text", "difficulty", said.alias("choices"), "answer", shown_answer(F.col("type"), F.col("answer")).alias("shown"))


def quiz_documents(quizzes: DataFrame, theories: DataFrame, sections: DataFrame, questions: DataFrame) -> DataFrame:
    """(quiz, name), (quiz, theory, title, display_order), (theory, section, position, content), (quiz, position, type, text, points, answer, hint_section) -> one JSON document a quiz.

    Hints name the places of their theory and section, counted from 0 in the
    document's own order, so that an import finds them whatever ids it gives;
    hints to sections elsewhere are left out.
    """
    placed = theories.withColumn("hint_theory_index", F.row_number().over(W.partitionBy("quiz").orderBy("display_order", "theory")) - 1)
    inside = sections.withColumn("hint_section_index", F.row_number().over(W.partitionBy("theory").orderBy("position", "section")) - 1)
    per = inside.groupBy("theory").agg(F.array_sort(F.collect_list(F.struct(F.col("hint_section_index").alias("i"), "position", "content"))).alias("s"))
    told = placed.join(per, "theory", "left").groupBy("quiz").agg(F.array_sort(F.collect_list(F.struct(F.col("hint_theory_index").alias("i"), "title", "display_order", "s"))).alias("t"))
    told = told.select("quiz", F.transform("t", lambda x: F.struct(x["title"].alias("title"), x["display_order"].alias("display_order"), F.coalesce(F.transform(x["s"], lambda s: F.struct(s["position"].alias("order"), s["content"].alias("content"))), F.array().cast("array<struct<order:int,content:string>>")).alias("sections"))).alias("theories"))
    place = placed.join(inside, "theory").select("quiz", F.col("section").alias("hint_section"), "hint_theory_index", "hint_section_index")
    q = questions.join(place, ["quiz", "hint_section"], "left")
    asked = q.groupBy("quiz").agg(F.array_sort(F.collect_list(F.struct(F.col("position").alias("order"), "type", F.col("text").alias("question_text"), F.col("points").cast("double").alias("points"), "answer", "hint_theory_index", "hint_section_index"))).alias("questions"))
    out = quizzes.join(told, "quiz", "left").join(asked, "quiz", "left")
    empty = lambda c, df: F.coalesce(c, F.array().cast(df.schema[c].dataType)).alias(c)
    return out.select("quiz", F.to_json(F.struct(F.struct("name").alias("quiz"), empty("theories", told), empty("questions", asked))).alias("document"))


DOCUMENT = "quiz struct<name string>, theories array<struct<title string, display_order int, sections array<struct<order int, content string>>>>, questions array<struct<order int, type string, question_text string, points double, answer string, hint_theory_index int, hint_section_index int>>"


def imported(documents: DataFrame) -> DataFrame:
    """(quiz, document) -> (quiz, order, type, question_text, points, answer, hint): the questions of each document with the text that their hint points to."""
    # An outer explode: an inner one would read each document once more, to see whether it has questions.
    rows = documents.select("quiz", F.from_json("document", DOCUMENT).alias("d")).select("quiz", "d.theories", F.posexplode_outer("d.questions").alias("place", "q")).filter("place is not null")
    hint = F.get(F.get("theories", F.col("q.hint_theory_index"))["sections"], F.col("q.hint_section_index"))["content"]
    return rows.select("quiz", "q.order", "q.type", "q.question_text", "q.points", "q.answer", hint.alias("hint"))


def _quiz_tables(t) -> DataFrame:
    """Orders as quizzes; two theories each, a section a line, each question with the hint of the line before."""
    lines = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"), F.max("l_quantity").alias("points"))
    quizzes = t("orders").select(F.col("o_orderkey").alias("quiz"), F.concat(F.lit("Quiz "), F.col("o_orderkey")).alias("name"))
    theory = F.concat_ws("-", "quiz", (F.col("l_linenumber") % 2).cast("string"))
    lines = lines.withColumnRenamed("l_orderkey", "quiz")
    theories = lines.select("quiz", theory.alias("theory"), F.concat(F.lit("T"), F.col("l_linenumber") % 2).alias("title"), (1 - F.col("l_linenumber") % 2).alias("display_order")).distinct()
    sections = lines.select(theory.alias("theory"), F.concat_ws("-", "quiz", "l_linenumber").alias("section"), (-F.col("l_linenumber")).alias("position"), F.concat(F.lit("Part "), F.col("part")).alias("content"))
    questions = lines.select("quiz", F.col("l_linenumber").alias("position"), F.lit("fill_blank").alias("type"), F.concat(F.lit("Line \""), F.col("l_linenumber"), F.lit("\"")).alias("text"), "points", F.col("part").cast("string").alias("answer"), F.concat_ws("-", "quiz", (F.col("l_linenumber") - 1).cast("string")).alias("hint_section"))
    return quiz_documents(quizzes, theories, sections, questions)


@query("quiz_round_trip", """
WITH l AS (SELECT l_orderkey AS quiz, l_linenumber AS n, min(l_partkey) AS part, max(l_quantity) AS points FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY ALL)
SELECT a.quiz, a.n AS order, 'fill_blank' AS type, 'Line "' || a.n || '"' AS question_text, a.points::DOUBLE AS points, a.part::VARCHAR AS answer, 'Part ' || b.part AS hint FROM l a LEFT JOIN l b ON b.quiz = a.quiz AND b.n = a.n - 1""")
def quiz_round_trip(t, spark):
    """Every order as a document and back: each hint still points to the line before."""
    return imported(_quiz_tables(t))


def generator_context(requests: DataFrame, bank: DataFrame, least: float, most: int = 5) -> DataFrame:
    """(request, topic, difficulty, q, own) and (id, topic, difficulty, v, created) -> (request, tier, pos, id).

    The nearest questions of the request's topic and difficulty (null asks
    for any) but ``own``; where none is near enough, the newest ones of them.
    """
    open_to = lambda c: F.col(f"w_{c}").isNull() | (F.col(f"w_{c}") == F.col(c))
    asked = requests.select("request", F.col("topic").alias("w_topic"), F.col("difficulty").alias("w_difficulty"), "q", "own")
    # A request is a user's question: few at a time.
    rows = bank.join(F.broadcast(asked), open_to("topic") & open_to("difficulty") & ~F.col("id").eqNullSafe(F.col("own"))).withColumn("s", S.cosine(F.col("v"), F.col("q")))
    near = F.row_number().over(W.partitionBy("request").orderBy(F.desc("s"), "id"))
    new = F.row_number().over(W.partitionBy("request").orderBy(F.desc("created"), F.desc("id")))
    first = rows.filter(F.col("s") >= least).select("request", "id", near.alias("pos")).filter(F.col("pos") <= most).withColumn("tier", F.lit("vector"))
    second = rows.join(first.select("request").distinct(), "request", "left_anti").select("request", "id", new.alias("pos")).filter(F.col("pos") <= most).withColumn("tier", F.lit("newest"))
    return first.unionByName(second).select("request", "tier", "pos", "id")


@query("generator_context", """
WITH r AS (SELECT label AS request, CASE WHEN label % 3 = 0 THEN NULL ELSE label END AS topic, CASE WHEN label % 2 = 0 THEN label % 4 END AS difficulty, min(vec_id) AS own FROM embeddings GROUP BY label),
b AS (SELECT vec_id AS id, label AS topic, vec_id % 4 AS difficulty, embedding, vec_id % 17 AS created FROM embeddings),
m AS (SELECT r.request, b.id, b.created, list_cosine_similarity(e.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM r JOIN embeddings e ON e.vec_id = r.own JOIN b ON (r.topic IS NULL OR r.topic = b.topic) AND (r.difficulty IS NULL OR r.difficulty = b.difficulty) WHERE b.id != r.own),
n AS (SELECT request, 'vector' AS tier, row_number() OVER (PARTITION BY request ORDER BY s DESC, id) AS pos, id FROM m WHERE s >= 0.25),
o AS (SELECT request, 'newest' AS tier, row_number() OVER (PARTITION BY request ORDER BY created DESC, id DESC) AS pos, id FROM m WHERE request NOT IN (SELECT request FROM n))
SELECT request, tier, pos::INTEGER AS pos, id FROM (SELECT * FROM n UNION ALL SELECT * FROM o) WHERE pos <= 5""")
def generator_context_query(t, spark):
    """A request for each label, for its topic or any, for a difficulty or any, with its first vector as the question."""
    e = t("embeddings")
    own = e.groupBy("label").agg(F.min_by(F.struct(F.col("vec_id").alias("own"), F.col("embedding").alias("q")), "vec_id").alias("x"))
    requests = own.select(F.col("label").alias("request"), F.when(F.col("label") % 3 != 0, F.col("label")).alias("topic"), F.when(F.col("label") % 2 == 0, (F.col("label") % 4).cast("long")).alias("difficulty"), "x.q", "x.own")
    bank = e.select(F.col("vec_id").alias("id"), F.col("label").alias("topic"), (F.col("vec_id") % 4).alias("difficulty"), F.col("embedding").alias("v"), (F.col("vec_id") % 17).alias("created"))
    return generator_context(requests, bank, 0.25)
