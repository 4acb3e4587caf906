"""Fuzzy matching of texts by Ratcliff-Obershelp similarity as a join with upper bounds.

The similarity of two texts is twice the matched letters over all letters.
No more letters can match than the shorter text has, nor more than the two
have in common whatever their order; both bounds are column expressions over
letter counts made once for each text, and only pairs that pass them reach
the comparison itself.  Equal texts on either side are compared once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.functions import scalars as S
from quillspark.operators.text import coverage, seq_ratio
from quillspark.plans.registry import query

#: Rows of the smaller side that are broadcast at the most; a larger one is joined by shuffling.
BROADCAST = 100_000
#: Least similarities: a chapter's text beside its number, a chapter by text alone, a lesson.
NUMBERED, CHAPTER, LESSON = 0.35, 0.5, 0.3


def _clean(text: Column) -> Column:
    return F.lower(F.trim(text))


def letter_counts(text: Column) -> Column:
    """Each letter with its number, as an array of (letter, n) in the order of letters."""
    letters = F.array_sort(F.split(text, ""))
    step = lambda acc, c: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["c"] == c), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(c.alias("c"), (F.element_at(acc, -1)["n"] + 1).alias("n"))))).otherwise(F.concat(acc, F.array(F.struct(c.alias("c"), F.lit(1).alias("n")))))
    return F.aggregate(F.filter(letters, lambda c: c != ""), F.array().cast("array<struct<c:string,n:int>>"), step)


def at_most(a: str, b: str) -> Column:
    """No similarity of the two texts can be larger: (text, letters, counts as a map) on both sides."""
    total = F.col(f"{a}_n") + F.col(f"{b}_n")
    common = F.aggregate(F.map_entries(f"{a}_c"), F.lit(0), lambda s, e: s + F.least(e["value"], F.coalesce(F.try_element_at(F.col(f"{b}_c"), e["key"]), F.lit(0))))
    return F.when(total == 0, 1.0).when(2 * F.least(f"{a}_n", f"{b}_n") / total < F.col("least"), 0.0).otherwise(2 * common / total)


def _profiled(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the text's length and letters; texts are expected to be distinct within ``df``."""
    return df.withColumn(f"{name}_n", F.length(text)).withColumn(f"{name}_c", F.map_from_entries(letter_counts(F.col(text))))


def similar_pairs(left: DataFrame, right: DataFrame, keys: list[str], least: float) -> DataFrame:
    """(keys, a, b, similarity): pairs of different texts ``a`` of ``left`` and ``b`` of ``right`` with equal keys and at least that similarity.

    Texts are compared trimmed and in lower case; null and blank ones are like
    nothing.  Within a key every pair meets the bounds, so keys should be as
    narrow as the data allow; a text that occurs many times counts once.
    """
    one = left.select(*keys, F.col("a"), _clean(F.col("a")).alias("x")).filter("x != ''")
    two = right.select(*keys, F.col("b"), _clean(F.col("b")).alias("y")).filter("y != ''")
    one_d, two_d = _profiled(one.select(*keys, "x").distinct(), "x", "x"), _profiled(two.select(*keys, "y").distinct(), "y", "y")
    small = two_d.limit(BROADCAST + 1).count() <= BROADCAST
    pairs = one_d.join(F.broadcast(two_d) if small else two_d, keys).withColumn("least", F.lit(float(least)))
    pairs = pairs.filter(at_most("x", "y") >= F.col("least") - 1e-12)
    pairs = pairs.select(*keys, "x", "y", seq_ratio(F.col("x"), F.col("y")).alias("similarity")).filter(F.col("similarity") >= least)
    return one.distinct().join(pairs, [*keys, "x"]).join(two.distinct(), [*keys, "y"]).select(*keys, "a", "b", "similarity")


# What stands before a chapter's text: ``Chương 6``, ``Chương VI.``, ``C6.``.
_WORD = r"(?iu)^\s*chương\s*(?:\d+|[IVX]+)\s*[.:\-–]?\s*"
_SHORT = r"^\s*[Cc](\d+)\s*\.\s*"


def chapter_number(chapter: Column) -> Column:
    """The number a hint gives: after the word, in digits or Roman, after a short C, or alone at the start from 1 to 15."""
    found = lambda pattern: F.nullif(F.regexp_extract(chapter, pattern, 1), F.lit(""))
    lead = found(r"^\s*(\d+)").try_cast("int")
    return F.coalesce(found(r"[Cc]hương\s+(\d+)").try_cast("int"), S.roman(F.upper(found(r"(?u)[Cc]hương\s+([IVXivx]+)\b"))), found(_SHORT).try_cast("int"), F.when(lead.between(1, 15), lead))


def chapter_text(chapter: Column) -> Column:
    """What a hint says beside its number."""
    return F.trim(F.when(chapter.rlike(_SHORT), F.regexp_replace(chapter, _SHORT, "")).otherwise(F.regexp_replace(chapter, _WORD, "")))


def matched_curriculum(rows: DataFrame, curriculum: DataFrame) -> DataFrame:
    """(id, subject, grade, chapter, lesson) -> the same with chapter_no, chapter_name and lesson_match.

    Lessons of the subject and grade count, or of the grade in any subject
    where that subject has none.  A chapter number is trusted if no text
    stands beside it or the text is like the chapter's name; else the likest
    chapter counts, if it is like enough.  In a chapter the only lesson
    counts, or the likest to the lesson's hint.  Each different hint is
    compared once, whatever the number of rows.
    """
    held = curriculum.select("subject_code", "grade", "chapter_no", "chapter", "lesson_no", "lesson_title")
    known = held.select(F.col("subject_code").alias("subject"), "grade", F.lit(True).alias("own")).distinct()
    rows = rows.join(known, ["subject", "grade"], "left").withColumn("scope", F.when(F.col("own"), F.col("subject")).otherwise("*")).drop("own")
    both = held.withColumn("scope", F.col("subject_code")).unionByName(held.withColumn("scope", F.lit("*")))
    first = F.struct("lesson_no", "subject_code")
    chapters = both.groupBy("scope", "grade", "chapter_no").agg(F.min_by("chapter", first).alias("chapter_name"))
    hint = F.coalesce("chapter", F.lit(""))
    asked = rows.select("scope", "grade", F.trim(hint).alias("hint"), chapter_number(hint).alias("number"), chapter_text(F.trim(hint)).alias("said")).distinct()
    # The hint against full names and against names without their numbers.
    plain = chapters.withColumn("b", F.explode(F.array("chapter_name", F.trim(F.regexp_replace("chapter_name", _WORD, ""))))).filter("b != ''")
    like = similar_pairs(asked.select("scope", "grade", F.col("said").alias("a")), plain.select("scope", "grade", "b"), ["scope", "grade"], NUMBERED)
    like = like.join(plain, ["scope", "grade", "b"]).groupBy("scope", "grade", F.col("a").alias("said"), "chapter_no").agg(F.max("similarity").alias("s"))
    numbered = asked.join(chapters.select("scope", "grade", F.col("chapter_no").alias("number")), ["scope", "grade", "number"])
    numbered = numbered.join(like.withColumnRenamed("chapter_no", "number"), ["scope", "grade", "said", "number"], "left").filter("said = '' or s is not null")
    best = like.filter(F.col("s") >= CHAPTER).groupBy("scope", "grade", "said").agg(F.max_by("chapter_no", F.struct("s", (-F.col("chapter_no")).alias("n"))).alias("likest"))
    chosen = asked.join(numbered.select("scope", "grade", "hint", F.col("number").alias("trusted")), ["scope", "grade", "hint"], "left").join(best, ["scope", "grade", "said"], "left")
    chosen = chosen.select("scope", "grade", "hint", F.coalesce("trusted", "likest").alias("chapter_no")).join(chapters, ["scope", "grade", "chapter_no"], "left")
    out = rows.withColumn("hint", F.trim(hint)).join(chosen, ["scope", "grade", "hint"], "left").drop("hint")

    lessons = both.select("scope", "grade", "chapter_no", "lesson_no", "lesson_title")
    only = lessons.groupBy("scope", "grade", "chapter_no").agg(F.count(F.lit(1)).alias("lessons"), F.first("lesson_title").alias("only"))
    titles = out.filter("chapter_no is not null and lesson is not null").select("scope", "grade", "chapter_no", F.col("lesson").alias("a")).distinct()
    near = similar_pairs(titles, lessons.select("scope", "grade", "chapter_no", F.col("lesson_title").alias("b")), ["scope", "grade", "chapter_no"], LESSON)
    near = near.join(lessons.withColumnRenamed("lesson_title", "b"), ["scope", "grade", "chapter_no", "b"]).groupBy("scope", "grade", "chapter_no", F.col("a").alias("lesson")).agg(F.max_by("b", F.struct("similarity", (-F.col("lesson_no")).alias("n"))).alias("likest"))
    out = out.join(only, ["scope", "grade", "chapter_no"], "left").join(near, ["scope", "grade", "chapter_no", "lesson"], "left")
    return out.withColumn("lesson_match", F.when(F.col("lessons") == 1, F.col("only")).otherwise(F.col("likest"))).drop("scope", "lessons", "only", "likest")


def _tables(t) -> tuple[DataFrame, DataFrame]:
    """Regions as subjects, their nations as chapters and suppliers as lessons; customers as questions with hints of many kinds."""
    nation = t("nation").join(t("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    number = F.floor(F.col("n_nationkey") / 5).cast("int") + 1
    title = F.concat(F.lit("Chương "), number.cast("string"), F.lit(". "), F.col("n_name"))
    curriculum = t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    curriculum = curriculum.select(F.col("r_name").alias("subject_code"), F.lit(6).alias("grade"), number.alias("chapter_no"), title.alias("chapter"), F.col("s_suppkey").cast("int").alias("lesson_no"), F.col("s_name").alias("lesson_title"))
    kind, k = F.col("c_custkey") % 7, F.col("c_custkey")
    number_said = (k % 6).cast("string")
    said = F.when(kind == 0, F.concat(F.lit("Chương "), number_said)).when(kind == 1, F.concat(F.lit("C"), number_said, F.lit("."), F.lower("n_name"))).when(kind == 2, F.concat(F.substring("n_name", 2, 30), F.lit("x"))).when(kind == 3, F.lit("zzzz")).when(kind == 4, F.col("n_name")).when(kind == 5, F.concat(F.lit("Chương II: "), F.col("n_name")))
    rows = t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.select(F.col("c_custkey").alias("id"), F.when(k % 11 == 0, "elsewhere").otherwise(F.col("r_name")).alias("subject"), F.when(k % 13 == 0, 7).otherwise(6).alias("grade"), said.alias("chapter"), F.when(k % 3 == 0, F.concat(F.lit("Supplier "), (k % 10).cast("string"))).alias("lesson"))
    return rows, curriculum


@query("curriculum_match")
def curriculum_match(t, spark):
    """Every customer's hints against the chapters and lessons; tests compare it with a matcher row by row."""
    rows, curriculum = _tables(t)
    return matched_curriculum(rows, curriculum).select("id", "chapter_no", "chapter_name", "lesson_match")


@query("curriculum_coverage")
def curriculum_coverage(t, spark):
    """How many questions have a grade, a chapter and a lesson."""
    return coverage(matched_curriculum(*_tables(t)))


@query("fuzzy_names")
def fuzzy_names(t, spark):
    """Pairs of different part names of one size that are alike by 0.8 or more, copies told once."""
    names = t("part").select("p_size", "p_name").distinct()
    found = similar_pairs(names.select("p_size", F.col("p_name").alias("a")), names.select("p_size", F.col("p_name").alias("b")), ["p_size"], 0.8)
    return found.filter("a < b").select("p_size", "a", "b", F.round("similarity", 6).alias("similarity"))
