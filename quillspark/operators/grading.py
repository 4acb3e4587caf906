"""Grading of polymorphic answers as column expressions.

Answers are JSON texts.  Each grader gives (is_correct, points); a missing
answer or an unknown type is wrong with no points, an essay stays ungraded.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.functions import scalars as S
from quillspark.plans.registry import query

LIST, MAP = "array<string>", "map<string,string>"


def _result(ok: Column, points: Column) -> Column:
    return F.struct(ok.cast("boolean").alias("is_correct"), points.cast("double").alias("points"))


def _plain(x: Column) -> Column:
    """A JSON string without its quotes; other texts as they are."""
    return F.when(x.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), x, F.lit("}")), "$.v")).otherwise(x)


@dataclass(frozen=True)
class Answer:
    """An answer as it is, as a plain text, and as the keys, list or map that its type needs, each read once a row."""

    raw: Column
    plain: Column
    keys: Column
    items: Column
    fields: Column


def _read(df: DataFrame, name: str) -> tuple[DataFrame, Answer]:
    """Adds the readings of an answer as columns of their own: expressions that use them do not read the JSON again."""
    x, kind = F.col(name), F.col("type")
    keys = F.when(kind == "checkbox", F.array_distinct(F.transform(_list(x), S.code_key)))
    items = F.from_json(F.when((kind == "reorder") & x.startswith("["), x), LIST)
    fields = F.from_json(F.when(kind.isin("fill_blank", "matching", "matching_headings") & x.startswith("{"), x), MAP)
    made = {"plain": _plain(x), "keys": keys, "items": items, "fields": fields}
    return df.withColumns({f"_{name}_{k}": v for k, v in made.items()}), Answer(x, *[F.col(f"_{name}_{k}") for k in made])


def choice(correct: Answer, given: Answer, points: Column) -> Column:
    ok = S.code_key(correct.plain) == S.code_key(given.plain)
    return _result(ok, F.when(ok, points).otherwise(0.0))


def _list(x: Column) -> Column:
    """A JSON list as texts; another answer is a list of its own, an empty one an empty list."""
    return F.when(x.startswith("["), F.coalesce(F.from_json(x, LIST), F.array().cast(LIST))).when(F.coalesce(_plain(x), F.lit("")) == "", F.array().cast(LIST)).otherwise(F.array(_plain(x)))


def checkbox(correct: Answer, given: Answer, points: Column, mode: Column, penalty: Column) -> Column:
    """Equal sets of keys; any mode but all_or_nothing gives parts: hits less penalties, between 0 and the points."""
    right, chosen = correct.keys, given.keys
    ok = F.array_sort(right) == F.array_sort(chosen)
    hits, wrong = F.size(F.array_intersect(right, chosen)), F.size(F.array_except(chosen, right))
    part = F.greatest(F.lit(0.0), F.least(points, points / F.greatest(F.size(right), F.lit(1)) * hits - F.coalesce(penalty, F.lit(0.0)) * wrong))
    whole = F.when(ok, points).otherwise(0.0)
    return _result(ok, F.bround(F.when((F.coalesce(mode, F.lit("all_or_nothing")) == "all_or_nothing") | (F.size(right) == 0), whole).otherwise(part), 2))


def _blank(expected: Column, said: Column) -> Column:
    """What one blank expects, what was said, and the rule in it, read once."""
    rule = F.from_json(F.when(expected.startswith("{"), expected), "accept array<string>, case_sensitive boolean, trim_whitespace boolean")
    return F.struct(expected.alias("expected"), said.alias("said"), rule.alias("rule"))


def _blank_hit(blank: Column) -> Column:
    """Whether one blank is filled as expected: a text without regard to case, or one of ``accept`` under its own rules."""
    expected, said, rule = blank["expected"], blank["said"], blank["rule"]
    trim, exact = F.coalesce(rule["trim_whitespace"], F.lit(True)), F.coalesce(rule["case_sensitive"], F.lit(False))
    fixed = lambda x: F.when(exact, F.when(trim, F.trim(x)).otherwise(x)).otherwise(F.lower(F.when(trim, F.trim(x)).otherwise(x)))
    own = F.trim(F.coalesce(said, F.lit("")))
    accepted = F.coalesce(F.exists(rule["accept"], lambda a: fixed(a) == fixed(own)), F.lit(False))
    return F.when(expected.startswith("{"), accepted).otherwise(F.lower(F.trim(expected)) == F.lower(own))


def fill_blank(correct: Answer, given: Answer, points: Column, mode: Column, per_blank: Column) -> Column:
    """Blank by blank where both sides are maps, else as texts.  Points for each blank, all of them or a share; without blanks, full marks."""
    right, got = correct.fields, given.fields
    keys = F.map_keys(right)
    total = F.size(keys)
    blanks = F.transform(keys, lambda k: _blank(right[k], F.try_element_at(got, k)))
    hits = F.size(F.filter(blanks, lambda b: F.coalesce(_blank_hit(b), F.lit(False))))
    mode, ok = F.coalesce(mode, F.lit("per_blank")), hits == total
    earned = F.when(mode == "per_blank", hits * F.coalesce(per_blank, points / total)).when(mode == "all_or_nothing", F.when(ok, points).otherwise(0.0)).otherwise(hits / total * points)
    same = F.lower(F.trim(correct.plain)) == F.lower(F.trim(given.plain))
    plain = _result(same, F.when(same, points).otherwise(0.0))
    return F.when(correct.raw.startswith("{") & given.raw.startswith("{"), _result(ok, F.when(total == 0, points).otherwise(F.bround(earned, 2)))).otherwise(plain)


def matching(correct: Answer, given: Answer, points: Column, mode: Column) -> Column:
    """Key by key without regard to case; parts only in the mode per_blank."""
    right, got = correct.fields, given.fields
    keys = F.map_keys(right)
    total = F.size(keys)
    hits = F.size(F.filter(keys, lambda k: S.code_key(F.coalesce(F.try_element_at(got, k), F.lit(""))) == S.code_key(right[k])))
    ok = hits == total
    earned = F.when(total == 0, points).when(F.coalesce(mode, F.lit("")) == "per_blank", F.bround(hits / total * points, 2)).otherwise(F.when(ok, points).otherwise(0.0))
    return F.when(correct.raw.startswith("{") & given.raw.startswith("{"), _result(ok, earned)).otherwise(_result(F.lit(False), F.lit(0.0)))


def reorder(correct: Answer, given: Answer, points: Column, mode: Column, partial: Column) -> Column:
    """Equal lists; a share for places that are right only where parts are wanted and the mode is another than all_or_nothing, which it is unless told."""
    right, got = correct.items, given.items
    parts = F.coalesce(partial, F.lit(False)) & (F.coalesce(mode, F.lit("all_or_nothing")) != "all_or_nothing")
    hits = F.size(F.filter(F.zip_with(right, got, lambda a, b: a == b), lambda x: F.coalesce(x, F.lit(False))))
    same, all_hit = right == got, (hits == F.size(right)) | (F.size(right) == 0)
    graded = F.when(parts, _result(all_hit, F.when(F.size(right) == 0, points).otherwise(F.bround(hits / F.size(right) * points, 2)))).otherwise(_result(same, F.when(same, points).otherwise(0.0)))
    return F.when(correct.raw.startswith("[") & given.raw.startswith("["), graded).otherwise(_result(F.lit(False), F.lit(0.0)))


def true_false(correct: Answer, given: Answer, points: Column) -> Column:
    ok = F.coalesce(S.to_bool(correct.plain), F.lit(True)) == S.to_bool(given.plain)
    return _result(ok, F.when(ok, points).otherwise(0.0))


def not_given(correct: Answer, given: Answer, points: Column) -> Column:
    ok = S.not_given_key(correct.plain) == S.not_given_key(given.plain)
    return _result(ok, F.when(ok, points).otherwise(0.0))


def grade(df: DataFrame) -> DataFrame:
    """Adds is_correct and points_earned to (type, correct, given, points, mode, penalty, per_blank, partial)."""
    c, known = F.col, df.columns
    df, right = _read(df, "correct")
    df, said = _read(df, "given")
    read = [x for x in df.columns if x not in known]
    args = (right, said, c("points").cast("double"))
    by = {
        ("multiple_choice",): choice(*args), ("checkbox",): checkbox(*args, c("mode"), c("penalty")), ("fill_blank",): fill_blank(*args, c("mode"), c("per_blank")),
        ("reorder",): reorder(*args, c("mode"), c("partial")), ("true_false",): true_false(*args), ("true_false_not_given", "yes_no_not_given"): not_given(*args), ("matching", "matching_headings"): matching(*args, c("mode")),
    }
    result = F.when(c("given").isNull(), _result(F.lit(False), F.lit(0.0))).when(c("type") == "essay", _result(F.lit(None), F.lit(0.0)))
    for types, expression in by.items():
        result = result.when(c("type").isin(*types), expression)
    result = result.otherwise(_result(F.lit(False), F.lit(0.0)))
    return df.withColumn("_r", result).withColumn("is_correct", F.col("_r.is_correct")).withColumn("points_earned", F.col("_r.points")).drop("_r", *read)


def attempt_totals(answers: DataFrame, negative: bool = False, passing: float | None = None, by: str = "percentage") -> DataFrame:
    """(attempt, max_points, points, is_correct, given, hint_penalty) -> totals of each attempt.

    With negative scoring an answer that is given and not right costs 0.5; a
    hint takes its share off positive points only.  The percentage is not
    below 0; passing is unknown without a bar.
    """
    p = F.col("points")
    if negative:
        p = F.when(F.col("given").isNotNull() & ~F.coalesce(F.col("is_correct"), F.lit(False)), F.lit(-0.5)).otherwise(p)
    p = F.when(p > 0, p * (1 - F.coalesce(F.col("hint_penalty"), F.lit(0.0)))).otherwise(p)
    rows = answers.groupBy("attempt").agg(F.sum(p).alias("earned"), F.sum("max_points").alias("max_points"), F.count_if("is_correct").alias("n_correct"), F.count_if(F.col("given").isNotNull() & F.col("is_correct").isNull()).alias("n_pending"))
    rows = rows.withColumn("percentage", F.bround(F.greatest(F.lit(0.0), F.coalesce(F.try_divide(F.col("earned") * 100, F.col("max_points")), F.lit(0.0))), 2))
    bar = F.lit(None).cast("boolean") if passing is None else (F.col("percentage") if by == "percentage" else F.col("earned")) >= passing
    return rows.withColumn("passed", bar)


_GRADED = [
    (1, "multiple_choice", '"b"', "B ", 1.0, None, None, None, None, True, 1.0), (2, "multiple_choice", "A", "C", 1.0, None, None, None, None, False, 0.0), (3, "multiple_choice", "", "", 1.0, None, None, None, None, True, 1.0),
    (4, "checkbox", '["A","B"]', '["b","a"]', 2.0, None, None, None, None, True, 2.0), (5, "checkbox", '["A","B"]', '["A","C"]', 2.0, "partial", 0.5, None, None, False, 0.5), (6, "checkbox", '["A","B"]', '["A"]', 2.0, "all_or_nothing", None, None, None, False, 0.0),
    (7, "fill_blank", '{"B1":{"accept":["x","y"]},"B2":"z"}', '{"B1":"Y","B2":"q"}', 3.0, None, None, None, None, False, 1.5), (8, "fill_blank", '{"B1":"x","B2":"z"}', '{"B1":"x","B2":"z"}', 3.0, None, None, 2.0, None, True, 4.0), (9, "fill_blank", "Paris", " paris", 1.0, None, None, None, None, True, 1.0),
    (10, "reorder", '["1","2","3"]', '["1","3","2"]', 3.0, "partial", None, None, True, False, 1.0), (11, "reorder", '["1","2"]', "no list", 3.0, None, None, None, True, False, 0.0), (12, "true_false", "true", "yes", 1.0, None, None, None, None, True, 1.0),
    (13, "true_false_not_given", "NG", "not given", 1.0, None, None, None, None, True, 1.0), (14, "matching", '{"1":"a","2":"b"}', '{"1":"A","2":"c"}', 2.0, "per_blank", None, None, None, False, 1.0), (15, "essay", None, "text", 5.0, None, None, None, None, None, 0.0),
    (16, "multiple_choice", "A", None, 1.0, None, None, None, None, False, 0.0), (17, "unknown", "A", "A", 1.0, None, None, None, None, False, 0.0), (18, "yes_no_not_given", "yes", "n", 1.0, None, None, None, None, False, 0.0),
]


@query("grade_answers", "SELECT * FROM (VALUES " + ", ".join(f"({r[0]}, {'NULL' if r[9] is None else str(r[9]).lower()}, {r[10]}::DOUBLE)" for r in _GRADED) + ") v(id, is_correct, points_earned)")
def grade_answers(t, spark):
    rows = spark.createDataFrame([r[:9] for r in _GRADED], "id int, type string, correct string, given string, points double, mode string, penalty double, per_blank double, partial boolean")
    return grade(rows).select("id", "is_correct", "points_earned")


@query("grade_answers_all", """
WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_linenumber % 2 = 1 THEN l_returnflag = 'R' ELSE l_linestatus = 'O' END AS ok FROM lineitem)
SELECT l_orderkey, l_linenumber, ok AS is_correct, CASE WHEN ok THEN l_quantity ELSE 0 END::DOUBLE AS points_earned FROM a""")
def grade_answers_all(t, spark):
    """Each lineitem as an answer: a choice on odd lines, true or false on even ones."""
    odd, none = F.col("l_linenumber") % 2 == 1, F.lit(None)
    rows = t("lineitem").select(
        "l_orderkey", "l_linenumber", F.when(odd, "multiple_choice").otherwise("true_false").alias("type"), F.when(odd, "R").otherwise("true").alias("correct"), F.when(odd, F.col("l_returnflag")).when(F.col("l_linestatus") == "O", "yes").when(F.col("l_linestatus") == "F", "no").alias("given"),
        F.col("l_quantity").alias("points"), none.cast("string").alias("mode"), none.cast("double").alias("penalty"), none.cast("double").alias("per_blank"), none.cast("boolean").alias("partial"),
    )
    return grade(rows).select("l_orderkey", "l_linenumber", "is_correct", "points_earned")


@query("attempt_totals", """
WITH a AS (SELECT l_orderkey AS attempt, 1.0 AS m, l_returnflag = 'R' AS ok, CASE WHEN l_returnflag = 'R' THEN 1.0 * (1 - CASE WHEN l_linestatus = 'O' THEN 0.5 ELSE 0 END) ELSE -0.5 END AS p FROM lineitem)
SELECT attempt, sum(p)::DOUBLE AS earned, sum(m)::DOUBLE AS max_points, count(*) FILTER (ok) AS n_correct, round_even(greatest(0.0, sum(p)::DOUBLE * 100 / sum(m)::DOUBLE), 2) AS percentage, round_even(greatest(0.0, sum(p)::DOUBLE * 100 / sum(m)::DOUBLE), 2) >= 50 AS passed FROM a GROUP BY 1""")
def attempt_totals_query(t, spark):
    right = F.col("l_returnflag") == "R"
    a = t("lineitem").select(F.col("l_orderkey").alias("attempt"), F.lit(1.0).alias("max_points"), right.alias("is_correct"), F.when(right, 1.0).otherwise(0.0).alias("points"), F.lit("x").alias("given"), F.when(F.col("l_linestatus") == "O", 0.5).alias("hint_penalty"))
    return attempt_totals(a, True, 50.0).drop("n_pending")


def final_grades(answers: DataFrame, manual: DataFrame) -> DataFrame:
    """Manual points over automatic ones, no more than the maximum; right unless stated otherwise if positive."""
    m = manual.select("attempt", "question", F.col("points").alias("given_points"), F.col("is_correct").alias("given_correct"))
    rows = answers.join(m, ["attempt", "question"], "left")
    points = F.when(F.col("given_points").isNotNull(), F.least("given_points", "max_points")).otherwise(F.col("points"))
    ok = F.when(F.col("given_points").isNotNull(), F.coalesce("given_correct", points > 0)).otherwise(F.col("is_correct"))
    return rows.withColumn("points", points).withColumn("is_correct", ok).drop("given_points", "given_correct")


@query("attempt_limits", "SELECT o_custkey, count(*) AS attempts, count(*) FILTER (o_orderstatus = 'F') AS completed, count(*) < 12 AND count(*) FILTER (o_orderstatus = 'F') <= 5 AS may_start FROM orders GROUP BY 1")
def attempt_limits(t, spark):
    rows = t("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("o_orderstatus") == "F").alias("completed"))
    return rows.withColumn("may_start", (F.col("attempts") < 12) & (F.col("completed") <= 5))


@query("assignment_score", "SELECT l_orderkey, round_even(count(*) FILTER (l_returnflag = 'R') * 100.0 / count(*), 0)::INT AS score FROM lineitem GROUP BY 1")
def assignment_score(t, spark):
    return t("lineitem").groupBy("l_orderkey").agg(F.bround(F.count_if(F.col("l_returnflag") == "R") * 100.0 / F.count(F.lit(1)), 0).cast("int").alias("score"))


@query("grade_all_types", """
WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity::INT AS q, l_partkey % 9 AS k, l_returnflag AS f, l_linestatus AS s, (l_quantity::INT % 4)::DOUBLE AS pen FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, k::INT AS kind,
 CASE k WHEN 0 THEN f = 'R' WHEN 1 THEN f = 'R' AND s = 'O' WHEN 2 THEN f = 'R' AND s = 'O' WHEN 3 THEN f = 'R' AND s = 'O' WHEN 4 THEN f = 'R' WHEN 5 THEN f = 'R' WHEN 6 THEN s = 'O' WHEN 7 THEN NULL ELSE s = 'O' END AS is_correct,
 CASE k WHEN 0 THEN CASE WHEN f = 'R' THEN 4.0 ELSE 0 END
  WHEN 1 THEN greatest(0.0, least(4.0, 2.0 * ((f = 'R')::INT + (s = 'O')::INT) - pen * ((f != 'R')::INT + (s != 'O')::INT)))
  WHEN 2 THEN CASE q % 3 WHEN 0 THEN 2.5 * ((f = 'R')::INT + (s = 'O')::INT) WHEN 1 THEN CASE WHEN f = 'R' AND s = 'O' THEN 4.0 ELSE 0 END ELSE 2.0 * ((f = 'R')::INT + (s = 'O')::INT) END
  WHEN 3 THEN CASE WHEN q % 2 = 0 THEN 2.0 * ((f = 'R')::INT + (s = 'O')::INT) WHEN f = 'R' AND s = 'O' THEN 4.0 ELSE 0 END
  WHEN 4 THEN CASE WHEN f = 'R' THEN 4.0 WHEN q % 2 = 0 AND f = 'N' THEN 1.33 ELSE 0 END
  WHEN 5 THEN CASE WHEN f = 'R' THEN 4.0 ELSE 0 END WHEN 6 THEN CASE WHEN s = 'O' THEN 4.0 ELSE 0 END WHEN 7 THEN 0 ELSE CASE WHEN s = 'O' THEN 4.0 ELSE 0 END END::DOUBLE AS points_earned FROM l""")
def grade_all_types(t, spark):
    """Every line as an answer of one of nine kinds: all types, modes, penalties and spellings over the whole table."""
    f, s, q, k = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_quantity").cast("int"), (F.col("l_partkey") % 9).cast("int")
    types = ("multiple_choice", "checkbox", "fill_blank", "matching", "reorder", "true_false", "true_false_not_given", "essay", "yes_no_not_given")
    said = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    correct = {0: F.lit('"r"'), 1: F.lit('["R","O"]'), 2: F.lit('{"B1":{"accept":["x","R"],"case_sensitive":true},"B2":"o"}'), 3: F.lit('{"1":"r","2":"O"}'), 4: F.lit('["R","x","y"]'), 5: F.lit("true"), 6: F.lit("NG"), 8: F.lit("Y")}
    given = {
        0: said(" ", f, " "), 1: said('["', f, '","', F.lower(s), '"]'), 2: said('{"B2":" ', s, '","B1":"', f, '"}'), 3: said('{"1":"', f, '","2":"', s, '","3":"z"}'),
        4: F.when(f == "R", '["R","x","y"]').when(f == "N", '["x","R","y"]').otherwise('["x","y","R"]'), 5: F.when(f == "R", "đúng").otherwise("sai"), 6: F.when(s == "O", "not given").otherwise("T"), 7: F.lit("an essay"), 8: F.when(s == "O", "yes").otherwise("N"),
    }
    pick = lambda by: F.coalesce(*[F.when(k == n, x) for n, x in by.items()])
    mode = pick({1: F.lit("partial"), 2: F.get(F.array(F.lit("per_blank"), F.lit("all_or_nothing"), F.lit("ratio")), q % 3), 3: F.when(q % 2 == 0, "per_blank"), 4: F.when(q % 2 == 0, "partial")})
    rows = t("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", k.alias("kind"), F.get(F.array(*map(F.lit, types)), k).alias("type"), pick(correct).alias("correct"), pick(given).alias("given"), F.lit(4.0).alias("points"), mode.alias("mode"),
        (q % 4).cast("double").alias("penalty"), F.when((k == 2) & (q % 3 == 0), 2.5).alias("per_blank"), F.lit(True).alias("partial"),
    )
    return grade(rows).select("l_orderkey", "l_linenumber", "l_partkey", "kind", "is_correct", "points_earned")
