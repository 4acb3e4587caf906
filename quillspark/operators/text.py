"""Segmentation, answer keys, quality gates and JSON recovery for exam texts."""

from __future__ import annotations

import bisect
import functools
import re
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from quillspark.functions import scalars as S
from quillspark.operators.replies import json_salvage, salvage  # noqa: F401
from quillspark.plans.registry import query

_MARK = r"(?mu)^[ \t]*(?:câu|bài|question)[ \t]*(\d+)[ \t]*[.:)]"
_NUMBERED = r"(?m)^[ \t]*(\d+)[.)][ \t]"
_CUT = "\u241e"


def split_questions(df: DataFrame, text: str = "text") -> DataFrame:
    """One row a question: number, pos, question.

    Marked lines (Câu, Bài, Question) count if there are two or more, else
    numbered lines if there are two or more, else the whole text is question
    1.  What stands before the first mark is dropped.
    """
    marks, numbers = F.regexp_count(F.lower(text), F.lit(_MARK)), F.regexp_count(text, F.lit(_NUMBERED))
    marked = F.regexp_replace(text, _MARK.replace("(?mu)", "(?mui)"), f"{_CUT}$0")
    numbered = F.regexp_replace(text, _NUMBERED, f"{_CUT}$0")
    body = F.when(marks >= 2, marked).when(numbers >= 2, numbered).otherwise(F.concat(F.lit(_CUT), F.col(text)))
    plain = (marks < 2) & (numbers < 2)
    rows = df.withColumn("_plain", plain).withColumn("_parts", F.filter(F.transform(F.slice(F.split(body, _CUT), 2, 1 << 20), lambda s: F.btrim(s, F.lit(" \t\r\n"))), lambda s: s != ""))
    rows = rows.select("*", F.posexplode("_parts").alias("pos", "_q"))
    number = F.regexp_extract("_q", r"(\d+)", 1).try_cast("int")
    return rows.withColumn("number", F.when(F.col("_plain"), F.lit(1)).otherwise(number)).withColumn("question", F.col("_q")).drop("_plain", "_parts", "_q")


# Headings of an answer key, each on a line of its own.
HEADINGS = ("đáp án", "answer key", "bảng đáp án", "phần đáp án")
_HEADING = r"(?isu)(?:^|\n)\s*(?:" + "|".join(h.replace(" ", r"\s*") for h in HEADINGS) + r")\s*[:.]?\s*\n(.*)$"
#: ``1. A``, ``Câu 1: A``, ``1) A``; and the dense ``1A 2B 3C``, three or more on a line.
_PAIR = r"(?iu)(\d+)\s*[.:\-)\]]\s*([A-D])\b"
_DENSE = r"(?iu)(\d+)\s*\.?\s*([A-D])(?=\s|$)"
DENSE_LINE = 3


def _entries(area: Column, pattern: str) -> Column:
    found = lambda group: F.regexp_extract_all(area, F.lit(pattern), F.lit(group))
    return F.filter(F.zip_with(found(1), found(2), lambda k, v: F.struct(k.try_cast("int").alias("key"), F.upper(v).alias("value"))), lambda e: e["key"].isNotNull())


def answer_table(text: Column, total: Column | None = None) -> Column:
    """number -> letter from an answer key: what follows its heading line, else the last 30 % of the text; later entries win.

    Entries with a mark between number and letter count wherever they are.
    Lines of dense entries are added if the marked ones are fewer than half of
    ``total`` questions, or, without it, than the dense ones.
    """
    heading = F.regexp_extract(text, _HEADING, 1)
    area = F.when(heading != "", heading).otherwise(F.substring(text, F.floor(F.length(text) * 0.7).cast("int") + 1, F.length(text)))
    marked = _entries(area, _PAIR)
    dense = F.flatten(F.filter(F.transform(F.split(area, "\n"), lambda line: _entries(F.trim(line), _DENSE)), lambda found: F.size(found) >= DENSE_LINE))
    few = F.size(marked) < F.size(dense) if total is None else F.size(F.array_distinct(F.transform(marked, lambda e: e["key"]))) < total * 0.5
    entries = F.when(few, F.concat(marked, dense)).otherwise(marked)
    last = F.aggregate(entries, F.create_map().cast("map<int,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.map_from_arrays(F.array(e["key"]), F.array(e["value"]))))
    return last


def inline_answer(text: Column) -> Column:
    """The letter named in the question's own text, plain or bold."""
    named = F.regexp_extract(text, r"(?iu)(?:đáp án|answer|chọn)\s*:?\s*\**([A-D])\b", 1)
    bold = F.regexp_extract(text, r"(?i)\*\*?([A-D])[.)]?\*", 1)
    return F.nullif(F.upper(F.coalesce(F.nullif(named, F.lit("")), bold)), F.lit(""))


def section_answer(text: Column) -> Column:
    """What follows the heading of a solution."""
    return F.nullif(F.trim(F.regexp_extract(text, r"(?isu)(?:lời giải|hướng dẫn giải|solution)\s*:?\s*(.*)$", 1)), F.lit(""))


def arbitrate(table: Column, inline: Column, section: Column, total: Column) -> Column:
    """(source, confidence, answers): the first strategy that is sure enough.

    Each strategy is a map number -> answer.  Table: 0.95 from a coverage of
    0.8 on, else 0.9 of it; inline 0.85 of it; section 0.7 as soon as it has
    anything; merged, where the table wins, 0.8.  Below 0.6 there is none.
    """
    cover = lambda m: F.size(m) / total
    t, i = cover(table), cover(inline)
    t_conf = F.when(t >= 0.8, 0.95).otherwise(t * 0.9)
    merged = F.map_concat(F.map_filter(inline, lambda k, _: ~F.map_contains_key(table, k)), table)
    pick = lambda name, conf, m: F.struct(F.lit(name).alias("source"), conf.cast("double").alias("confidence"), m.alias("answers"))
    none = pick("none", F.lit(0.0), F.create_map().cast("map<int,string>"))
    return F.when(t_conf >= 0.6, pick("table", t_conf, table)).when(i * 0.85 >= 0.6, pick("inline", i * 0.85, inline)).when(F.size(section) > 0, pick("section", F.lit(0.7), section)).when(cover(merged) * 0.8 >= 0.6, pick("merged", cover(merged) * 0.8, merged)).otherwise(none)


_SEGMENT = re.compile(r"(?im)^[ \t]*(?:(?:câu|bài|question)\s*\d+|\d+[.)]\s)")
_BREAK = re.compile(r"(?P<blank>\n\n)|(?P<line>\n)|(?P<sentence>\. )")


def _breaks(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places after line and sentence ends, and how good each is to cut at."""
    found = [(m.end(), ("sentence", "line", "blank").index(m.lastgroup)) for m in _BREAK.finditer(text)]
    return np.array([p for p, _ in found], np.int64), np.array([k for _, k in found], np.int64)


def chunks(text: str, most: int) -> list[str]:
    """Contiguous pieces of at most ``most`` characters that together are the text, blank ones left out.

    Where the text has question segments, pieces end at their starts only, and
    a segment longer than ``most`` is a piece of its own; what stands before
    the first goes with it.  Otherwise a piece ends at the best break in its
    second half (a blank line, then a line end, then a sentence end; the last
    of equals), or is full.
    """
    if len(text) <= most:
        return [text] if text.strip() else []
    ends = [m.start() for m in _SEGMENT.finditer(text)]
    marked = bool(ends)
    ends = [*ends[1:], len(text)]
    places, kinds = (None, None) if marked else _breaks(text)
    cuts = [0]
    while cuts[-1] < len(text):
        at = cuts[-1]
        if marked:
            k = bisect.bisect_right(ends, at + most)  # ends within reach
            cuts.append(ends[k - 1] if k and ends[k - 1] > at else ends[k])
        elif len(text) - at <= most:
            cuts.append(len(text))
        else:
            lo, hi = np.searchsorted(places, [at + most // 2 + 1, at + most], side="right")
            best = lo + np.flatnonzero(kinds[lo:hi] == kinds[lo:hi].max())[-1] if hi > lo else None
            cuts.append(at + most if best is None else int(places[best]))
    return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if text[a:b].strip()]


@F.pandas_udf(T.ArrayType(T.StringType()))
def chunk_text(text: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([chunks(t or "", int(m)) for t, m in zip(text, most, strict=True)])


def fill_from_pool(rows: DataFrame) -> DataFrame:
    """(doc, pos, number, question, answer): bare key rows (short text that is only an answer) fill blank answers of their number and go."""
    bare = F.coalesce(F.regexp_like(F.trim("question"), F.lit(r"^(?iu)(?:câu\s*)?\d+\s*[.:)\-]?\s*[A-D]?\.?$")), F.lit(False)) & (F.length("question") <= 20)
    pool = rows.withColumn("a", F.coalesce(F.nullif(F.trim("answer"), F.lit("")), F.nullif(F.regexp_extract("question", "([A-D])\\.?$", 1), F.lit("")))).filter(F.col("a").isNotNull()).groupBy("doc", "number").agg(F.max_by("a", "pos").alias("pooled"))
    out = rows.filter(~bare).join(pool, ["doc", "number"], "left")
    return out.withColumn("answer", F.coalesce(F.nullif(F.trim("answer"), F.lit("")), "pooled")).drop("pooled")


MARKERS = ("câu", "bài", "question", "a.", "b.", "c.", "d.")


def text_quality(text: Column, least_markers: int = 2) -> Column:
    """good or the reason against: short, markers, garble."""
    low = F.lower(text)
    found = sum((low.contains(m).cast("int") for m in MARKERS), F.lit(0))
    odd = F.length(F.regexp_replace(text, "[^\\x{10000}-\\x{10FFFF}\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", ""))
    return F.when(F.length(text) < 50, "short").when(found < least_markers, "markers").when(odd > F.length(text) * 0.1, "garble").otherwise("good")


def layout_ok(text: Column) -> Column:
    """Long enough, few line ends, few very short lines."""
    lines = F.split(text, "\n")
    newlines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    short = F.size(F.filter(lines, lambda s: F.length(F.trim(s)) <= 2))
    return (F.length(text) >= 100) & (newlines <= F.length(text) * 0.2) & (short <= F.size(lines) * 0.3)


def math_quality(text: Column) -> Column:
    """0 to 1: penalties for broken mathematics; texts with hardly any are taken as 0.8."""
    n = F.greatest(F.length(text), F.lit(1))
    words = F.greatest(F.size(F.split(text, "\\s+")), F.lit(1))
    lines = F.split(text, "\n")
    count = lambda p: F.regexp_count(text, F.lit(p))
    keywords = count("(?iu)phương trình|hàm số|tích phân|đạo hàm|equation|function|integral|sin|cos|log")
    score = F.lit(1.0)
    score = score - F.when(count("(?<=\\s)[a-zA-Z0-9](?=\\s)") / words > 0.08, 0.3).otherwise(0.0)
    score = score - F.when(count("(\\d)\\1{4,}") > 3, 0.2).otherwise(0.0)
    score = score - F.when((count("[\\\\^_{}√∫∑]") == 0) & (keywords >= 3), 0.3).otherwise(0.0)
    score = score - F.when(count("(?m)^\\s*[+\\-=*/]\\s*$") / F.size(lines) > 0.15, 0.2).otherwise(0.0)
    score = score - F.when(F.size(F.filter(lines, lambda s: F.length(F.trim(s)) < 4)) / F.size(lines) > 0.4, 0.15).otherwise(0.0)
    score = score - F.when(count(" ") / n > 0.35, 0.15).otherwise(0.0)
    return F.when(keywords < 2, 0.8).otherwise(F.greatest(score, F.lit(0.0)))


def is_mock(rows: Column) -> Column:
    """Whether a parse result looks made up: none, or more than two of three signs a row among the first five."""
    first = F.slice(rows, 1, 5)
    signs = F.aggregate(first, F.lit(0), lambda s, q: s + (F.length(q["question"]) < 20).cast("int") + (F.coalesce(q["answer"], F.lit("")) == "").cast("int") + (F.size(q["solution_steps"]) <= 0).cast("int"))
    return (F.size(rows) == 0) | (signs > 2 * F.size(first))


def choices(text: Column) -> Column:
    """Lettered choices; a line that starts none goes on the last one; fewer than two are none."""
    line = "^\\s*([A-H])\\s*[.):\\]]\\s*(.*)$"
    step = lambda acc, s: F.when(s.rlike(line), F.concat(acc, F.array(F.struct(F.regexp_extract(s, line, 1).alias("key"), F.trim(F.regexp_extract(s, line, 2)).alias("text"))))).when(
        (F.size(acc) > 0) & (F.trim(s) != ""), F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.element_at(acc, -1)["key"].alias("key"), F.concat_ws(" ", F.element_at(acc, -1)["text"], F.trim(s)).alias("text"))))
    ).otherwise(acc)
    found = F.aggregate(F.split(text, "\n"), F.array().cast("array<struct<key:string,text:string>>"), step)
    return F.when(F.size(found) >= 2, found)


def mark_choice(found: Column, answer: Column) -> Column:
    """Key of the right choice: the answer itself, the letter it begins with, containment either way, else the first; none without an answer."""
    keys = F.transform(found, lambda c: c["key"])
    key = F.upper(F.trim(answer))
    letter = F.upper(F.regexp_extract(F.trim(answer), "^([A-Za-z])", 1))
    like = F.filter(found, lambda c: F.lower(c["text"]).contains(F.lower(F.trim(answer))) | F.lower(answer).contains(F.lower(c["text"])))
    return F.when(F.coalesce(key, F.lit("")) == "", F.lit(None)).when(F.array_contains(keys, key), key).when(F.array_contains(keys, letter), letter).when((F.size(like) > 0) & (F.trim(answer) != ""), F.get(like, F.lit(0))["key"]).otherwise(F.get(keys, F.lit(0)))


def grade_in_message(text: Column) -> Column:
    """6 to 12 after the word for class."""
    return F.nullif(F.regexp_extract(F.lower(text), "(?u)lớp\\s*(6|7|8|9|10|11|12)(?!\\d)", 1), F.lit("")).cast("int")


def steps(raw: Column, otherwise: str = "lines") -> Column:
    """A JSON list of steps; else lines, the raw text alone, or none."""
    parsed = F.from_json(raw, "array<string>")
    lines = F.filter(F.transform(F.split(raw, "\n"), F.trim), lambda s: s != "")
    rest = {"lines": lines, "raw": F.array(raw), "none": F.array().cast("array<string>")}[otherwise]
    return F.when(raw.isNull() | (F.trim(raw) == ""), F.array().cast("array<string>")).when(F.ltrim(raw).startswith("[") & parsed.isNotNull(), parsed).otherwise(rest)


QUESTION = "array<struct<question:string,type:string,difficulty:string,answer:string,solution_steps:array<string>>>"


def recovered(raw: Column) -> Column:
    """The cheap way first: a list that parses never goes through Python's repair."""
    direct = F.from_json(F.when(F.try_parse_json(raw).isNotNull() & F.ltrim(raw).startswith("["), raw), QUESTION)
    return F.coalesce(direct, F.from_json(json_salvage(raw), QUESTION))


@F.pandas_udf(T.DoubleType())
def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of trimmed, lower-cased texts."""

    def one(x, y):
        x, y = (x or "").strip().lower(), (y or "").strip().lower()
        return 1.0 if x == y else SequenceMatcher(None, x, y).ratio()

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])


def match_curriculum(rows: DataFrame, curriculum: DataFrame) -> DataFrame:
    """(id, subject, grade, chapter, lesson) -> chapter_no, chapter and lesson of the curriculum.

    A chapter number is trusted if no text comes with it or the text is like
    the chapter's name by 0.35; else the likest chapter counts from 0.5, the
    likest lesson from 0.3, or the only one.  The curriculum is a small
    dimension and is broadcast.
    """
    digits = F.regexp_extract("chapter", "(?iu)^\\s*(?:chương|chapter|c)\\s*(\\d+)", 1)
    lead = F.regexp_extract("chapter", "^\\s*(\\d{1,2})\\b", 1)
    number = F.coalesce(F.nullif(digits, F.lit("")).cast("int"), S.roman(F.regexp_extract("chapter", "(?iu)chương\\s+([IVX]+)\\b", 1)), F.when(F.nullif(lead, F.lit("")).cast("int").between(1, 15), lead.cast("int")))
    hint = F.trim(F.regexp_replace("chapter", "(?iu)^\\s*(?:(?:chương|chapter)\\s*(?:\\d+|[IVX]+)|c\\d+|\\d{1,2})\\s*[.:\\-]?\\s*", ""))
    asked = rows.withColumn("number", number).withColumn("hint", hint)
    names = curriculum.groupBy("subject_code", "grade", "chapter_no").agg(F.min_by("chapter", "lesson_no").alias("c_name"))
    pairs = asked.join(F.broadcast(names.withColumnRenamed("subject_code", "subject")), ["subject", "grade"], "left")
    stripped = F.regexp_replace("c_name", "(?iu)^\\s*chương\\s*(?:\\d+|[IVX]+)\\s*[.:\\-]?\\s*", "")
    pairs = pairs.withColumn("sim", F.greatest(seq_ratio(F.col("hint"), F.col("c_name")), seq_ratio(F.col("hint"), stripped)))
    named = F.col("chapter_no") == F.col("number")
    good = F.when(named & ((F.col("hint") == "") | (F.col("sim") >= 0.35)), 2.0).when((F.col("hint") != "") & (F.col("sim") >= 0.5), F.col("sim"))
    best = pairs.groupBy("id").agg(F.max_by(F.struct("chapter_no", "c_name"), F.struct(good.alias("g"), (-F.col("chapter_no")).alias("n"))).alias("x"), F.max(good).alias("g"))
    out = rows.join(best, "id").withColumn("chapter_no", F.when(F.col("g").isNotNull(), F.col("x.chapter_no"))).withColumn("chapter_name", F.when(F.col("g").isNotNull(), F.col("x.c_name"))).drop("x", "g")
    lessons = out.select("id", "subject", "grade", "chapter_no", F.col("lesson").alias("asked")).join(F.broadcast(curriculum.withColumnRenamed("subject_code", "subject").select("subject", "grade", "chapter_no", "lesson_no", "lesson_title")), ["subject", "grade", "chapter_no"])
    lessons = lessons.withColumn("sim", seq_ratio(F.col("asked"), F.col("lesson_title")))
    chosen = lessons.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max_by("lesson_title", F.struct("sim", (-F.col("lesson_no")).alias("k"))).alias("title"), F.max("sim").alias("sim"), F.max(F.coalesce(F.trim("asked"), F.lit(""))).alias("asked"))
    chosen = chosen.select("id", F.when(F.col("n") == 1, F.col("title")).when((F.col("asked") != "") & (F.col("sim") >= 0.3), F.col("title")).alias("lesson_match"))
    return out.join(chosen, "id", "left")


def coverage(matched: DataFrame) -> DataFrame:
    return matched.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("grade").isNotNull()).alias("grades"), F.count_if(F.col("chapter_no").isNotNull()).alias("chapters"), F.count_if(F.col("lesson_match").isNotNull()).alias("lessons"))


# LaTeX commands and the characters they stand for.
LATEX = {"alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "pi": "π", "theta": "θ", "lambda": "λ", "mu": "μ", "sigma": "σ", "phi": "φ", "omega": "ω", "Delta": "Δ", "Omega": "Ω", "times": "×", "div": "÷", "cdot": "·", "pm": "±", "leq": "≤", "le": "≤", "geq": "≥", "ge": "≥", "neq": "≠", "ne": "≠", "approx": "≈", "infty": "∞", "rightarrow": "→", "to": "→", "in": "∈", "notin": "∉", "subset": "⊂", "cup": "∪", "cap": "∩", "forall": "∀", "exists": "∃", "int": "∫", "sum": "∑", "sqrt": "√", "angle": "∠", "perp": "⊥", "parallel": "∥", "circ": "°", "ldots": "…"}
_UP, _DOWN = str.maketrans("0123456789+-=()n", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿ"), str.maketrans("0123456789+-=()", "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎")


def latex_plain(s: str) -> str:
    """LaTeX as Unicode text: fractions, roots, scripts and symbols."""
    s, before = (s or "").replace("$", ""), None
    while before != s:
        before = s
        s = re.sub(r"\\d?frac\{([^{}]*)\}\{([^{}]*)\}", r"(\1)/(\2)", s)
        s = re.sub(r"\\sqrt\{([^{}]*)\}", r"√(\1)", s)
        s = re.sub(r"\\(?:text|mathrm|mathbf)\{([^{}]*)\}", r"\1", s)
    s = re.sub(r"\^\{([^{}]*)\}|\^(\w)", lambda m: (m[1] if m[1] is not None else m[2]).translate(_UP), s)
    s = re.sub(r"_\{([^{}]*)\}|_(\w)", lambda m: (m[1] if m[1] is not None else m[2]).translate(_DOWN), s)
    s = re.sub(r"\\(left|right)\b", "", s)
    s = re.sub(r"\\([A-Za-z]+)", lambda m: LATEX.get(m[1], m[1]), s)
    return re.sub(r"[{}]", "", s).strip()


@F.pandas_udf(T.StringType())
def latex_to_text(s: pd.Series) -> pd.Series:
    return s.map(latex_plain)


# Words in an error message and the class they point to, in order of precedence; the marked ones in the case given.
ERRORS = {
    "ai_not_configured": ("google_api_key", "api key", "no google", "=chưa được cấu hình"),
    "ai_rate_limit": ("429", "resource_exhausted", "quota", "rate limit", "too many requests"),
    "ai_maintenance": ("503", "service_unavailable", "unavailable", "server error", "internal error", "500"),
    "ai_timeout": ("timeout", "deadline", "timed out", "deadline_exceeded"),
    "ai_content_blocked": ("safety", "blocked", "harm", "recitation"),
    "ai_network": ("connection", "network", "dns", "connect", "ssl"),
}


def error_class(message: Column) -> Column:
    """The class of a service's error; null for any other error."""
    out, low = None, F.lower(message)
    for kind, words in ERRORS.items():
        found = functools.reduce(lambda a, b: a | b, [message.contains(w[1:]) if w.startswith("=") else low.contains(w) for w in words])
        out = F.when(found, kind) if out is None else out.when(found, kind)
    return out


_ERROR_SQL = "CASE " + " ".join(
    f"WHEN {' OR '.join(f"contains(text, '{w[1:]}')" if w.startswith('=') else f"contains(lower(text), '{w}')" for w in words)} THEN '{kind}'" for kind, words in ERRORS.items()
) + " END"


@query("doc_quality", r"""
SELECT doc_id, length(text) >= 100 AND length(text) - length(replace(text, chr(10), '')) <= length(text) * 0.2 AND len(list_filter(string_split(text, chr(10)), lambda s: length(trim(s)) <= 2)) <= len(string_split(text, chr(10))) * 0.3 AS layout_ok FROM documents""")
def doc_quality(t, spark):
    return t("documents").select("doc_id", layout_ok(F.col("text")).alias("layout_ok"))


@query("json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(t, spark):
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("choice_parsing", "SELECT * FROM (VALUES (1, 2, 'B'), (2, 2, 'A'), (3, NULL, NULL)) v(id, n, marked)")
def choice_parsing(t, spark):
    rows = spark.createDataFrame([(1, "stem\nA. one\nB) two\nand more", "b"), (2, "A: red\nB: blue", "the red one"), (3, "A. alone", "A")], "id int, text string, answer string")
    found = choices(F.col("text"))
    return rows.select("id", F.when(found.isNotNull(), F.size(found)).alias("n"), F.when(found.isNotNull(), mark_choice(found, F.col("answer"))).alias("marked"))


@query("json_recovery")
def json_recovery(t, spark):
    """Questions in each turn, taken as a model's reply; repair needs a scan that knows strings."""
    return t("conversations").select("conv_id", "turn", F.size(recovered(F.col("text"))).alias("n"))


_SEGMENT_SQL = r"""
WITH n AS (SELECT doc_id, text, len(regexp_extract_all(text, '(?im)^[ \t]*(?:câu|bài|question)[ \t]*([0-9]+)[ \t]*[.:)]')) AS m, len(regexp_extract_all(text, '(?m)^[ \t]*([0-9]+)[.)][ \t]')) AS k FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, m < 2 AND k < 2 AS plain, string_split(CASE WHEN m >= 2 THEN regexp_replace(text, '(?im)^[ \t]*(?:câu|bài|question)[ \t]*([0-9]+)[ \t]*[.:)]', '␞\0', 'g') WHEN k >= 2 THEN regexp_replace(text, '(?m)^[ \t]*([0-9]+)[.)][ \t]', '␞\0', 'g') ELSE '␞' || text END, '␞')[2:] AS cut FROM n),
p AS (SELECT doc_id, plain, list_filter(list_transform(cut, lambda x: trim(x, chr(32) || chr(9) || chr(13) || chr(10))), lambda x: x != '') AS parts FROM s)
SELECT doc_id, (i - 1)::INT AS pos, CASE WHEN plain THEN 1 ELSE try_cast(regexp_extract(q, '([0-9]+)', 1) AS INT) END AS number, q AS question FROM (SELECT doc_id, plain, unnest(parts) AS q, generate_subscripts(parts, 1) AS i FROM p)"""


@query("question_segments_all", _SEGMENT_SQL)
@query("question_segments", _SEGMENT_SQL)
def question_segments(t, spark):
    """The questions of every document."""
    return split_questions(t("documents").select("doc_id", "text")).select("doc_id", "pos", "number", "question")


_KEY_SQL = r"""
WITH h AS (SELECT doc_id, text, regexp_extract(text, '(?is)(?:^|\n)\s*(?:đáp\s*án|answer\s*key|bảng\s*đáp\s*án|phần\s*đáp\s*án)\s*[:.]?\s*\n(.*)$', 1) AS head FROM documents),
a AS (SELECT doc_id, CASE WHEN head != '' THEN head ELSE substring(text, floor(length(text) * 0.7)::INT + 1) END AS area FROM h),
l AS (SELECT doc_id, pos, trim(line, ' ') AS line FROM (SELECT doc_id, unnest(string_split(area, chr(10))) AS line, generate_subscripts(string_split(area, chr(10)), 1) AS pos FROM a)),
d AS (SELECT doc_id, pos, unnest(regexp_extract_all(line, '(?i)([0-9]+)\s*\.?\s*([A-D])(?:\s|$)', 1)) AS k, unnest(regexp_extract_all(line, '(?i)([0-9]+)\s*\.?\s*([A-D])(?:\s|$)', 2)) AS v, generate_subscripts(regexp_extract_all(line, '(?i)([0-9]+)\s*\.?\s*([A-D])(?:\s|$)', 1), 1) AS i FROM l),
dense AS (SELECT * FROM d WHERE try_cast(k AS INT) IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, pos) >= 3),
m AS (SELECT doc_id, 0 AS pos, unnest(regexp_extract_all(area, '(?i)([0-9]+)\s*[.:\-)\]]\s*([A-D])\b', 1)) AS k, unnest(regexp_extract_all(area, '(?i)([0-9]+)\s*[.:\-)\]]\s*([A-D])\b', 2)) AS v, generate_subscripts(regexp_extract_all(area, '(?i)([0-9]+)\s*[.:\-)\]]\s*([A-D])\b', 1), 1) AS i FROM a),
marked AS (SELECT * FROM m WHERE try_cast(k AS INT) IS NOT NULL),
more AS (SELECT doc_id FROM (SELECT doc_id, count(*) AS n FROM dense GROUP BY doc_id) x LEFT JOIN (SELECT doc_id, count(*) AS n FROM marked GROUP BY doc_id) y USING (doc_id) WHERE coalesce(y.n, 0) < x.n),
e AS (SELECT * FROM marked UNION ALL SELECT * FROM dense WHERE doc_id IN (SELECT doc_id FROM more))
SELECT doc_id, k::INT AS number, upper(v) AS answer FROM e QUALIFY row_number() OVER (PARTITION BY doc_id, k::INT ORDER BY pos DESC, i DESC) = 1"""


@query("answer_key_extract_all", _KEY_SQL)
def answer_key_extract_all(t, spark):
    """The answer key of every document that has one."""
    return t("documents").select("doc_id", F.explode(answer_table(F.col("text"))).alias("number", "answer"))


_KEYS = ("\n Đáp án:\n1. A 2-c\nCâu 3: b 1) D", "\n1A 2 B 3.C\n4a 5d", "\nAnswer key\n1A 2B 3C 4D\n5-A")


@query("answer_key_extract", _KEY_SQL.replace("FROM documents)", "FROM (SELECT doc_id, text || replace([" + ", ".join("'" + k.replace("\n", "#") + "'" for k in _KEYS) + "][doc_id % 3 + 1], '#', chr(10)) AS text FROM documents))", 1))
def answer_key_extract(t, spark):
    """The same with a key put at the end of each: under a heading, dense without one, and both kinds."""
    ends = F.get(F.array(*map(F.lit, _KEYS)), (F.col("doc_id") % 3).cast("int"))
    return t("documents").select("doc_id", F.explode(answer_table(F.concat("text", ends))).alias("number", "answer"))


@query("choice_parsing_all")
def choice_parsing_all(t, spark):
    """Choices of each document, marked by the letter its own text names."""
    found = choices(F.col("text"))
    return t("documents").select("doc_id", F.when(found.isNotNull(), F.size(found)).alias("n"), F.when(found.isNotNull(), mark_choice(found, inline_answer(F.col("text")))).alias("marked"))


_MOCK_SQL = """
WITH n AS (SELECT conv_id, role, text, lead(text) OVER w AS answer, row_number() OVER w AS r FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS LAST, text NULLS LAST)),
q AS (SELECT conv_id, (length(coalesce(text, '')) < 20)::INT + (coalesce(answer, '') = '')::INT + (trim(coalesce(answer, '')) = '')::INT AS signs FROM n WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY r) <= 5)
SELECT conv_id, count(signs) = 0 OR sum(signs) > 2 * count(signs) AS mock FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN q USING (conv_id) GROUP BY conv_id"""


@query("mock_detector_all", _MOCK_SQL)
@query("mock_detector", _MOCK_SQL)
def mock_detector(t, spark):
    """Each conversation as a parse result: a user's turn is a question, the turn after it the answer."""
    turns = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("ts"))
    answered = F.transform("ts", lambda x, i: F.struct(x["role"].alias("role"), x["text"].alias("question"), F.get("ts", i + 1)["text"].alias("answer")))
    rows = F.transform(F.filter(answered, lambda x: x["role"] == "user"), lambda x: F.struct(x["question"].alias("question"), x["answer"].alias("answer"), steps(x["answer"]).alias("solution_steps")))
    return turns.select("conv_id", is_mock(rows).alias("mock"))


@query("error_classes", f"SELECT conv_id, turn, {_ERROR_SQL} AS kind FROM conversations")
def error_classes(t, spark):
    """Each message as an error report."""
    return t("conversations").select("conv_id", "turn", error_class(F.col("text")).alias("kind"))
