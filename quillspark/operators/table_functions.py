"""Table functions for SQL: questions, chunks and choices of a text as rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.functions import scalars as S
from quillspark.functions.omml import latex_to_omml
from quillspark.operators.replies import json_salvage, json_truncated
from quillspark.operators.text import chunks, latex_to_text, seq_ratio, split_questions
from quillspark.plans.registry import query
from quillspark.sources.docx import docx_text

_CHOICE = re.compile(r"\s*([A-H])\s*[.):\]]\s*(.*)$")
_MARK = re.compile(r"(?mi)^[ \t]*(?:câu|bài|question)[ \t]*(\d+)[ \t]*[.:)]")
_NUMBERED = re.compile(r"(?m)^[ \t]*(\d+)[.)][ \t]")


class SplitQuestions:
    """(pos, number, question) of a text, by the rule of ``text.split_questions``."""

    def eval(self, text: str):
        if text is None:
            return
        found = next((m for m in (list(p.finditer(text)) for p in (_MARK, _NUMBERED)) if len(m) >= 2), None)
        if found is None:
            if text.strip(" \t\r\n"):
                yield 0, 1, text.strip(" \t\r\n")
            return
        ends = [m.start() for m in found[1:]] + [len(text)]
        for pos, (m, end) in enumerate(zip(found, ends, strict=True)):
            number = int(m[1])
            yield pos, number if number < 1 << 31 else None, text[m.start() : end].strip(" \t\r\n")


class ChunkText:
    """(pos, chunk) of a text in pieces of at most so many characters."""

    def eval(self, text: str, most: int):
        yield from enumerate(chunks(text or "", most))


class ParseChoices:
    """(pos, key, choice) of the lettered lines of a text; fewer than two are none."""

    def eval(self, text: str):
        found: list[list[str]] = []
        for line in (text or "").split("\n"):
            m = _CHOICE.match(line)
            if m:
                found.append([m[1], m[2].strip()])
            elif found and line.strip():
                found[-1][1] += f" {line.strip()}"
        if len(found) >= 2:
            for pos, (key, choice) in enumerate(found):
                yield pos, key, choice


FUNCTIONS = {
    "split_questions": (SplitQuestions, "pos int, number int, question string"),
    "chunk_text": (ChunkText, "pos int, chunk string"),
    "parse_choices": (ParseChoices, "pos int, key string, choice string"),
}


SCALARS = {"seq_ratio": seq_ratio, "json_salvage": json_salvage, "json_truncated": json_truncated, "latex_to_text": latex_to_text, "latex_to_omml": latex_to_omml, "docx_text": docx_text}


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL.

    ``ascii_fold`` is an SQL expression and stays in the engine; the others
    take batches.
    """
    for name, (rows, schema) in FUNCTIONS.items():
        spark.udtf.register(name, F.udtf(rows, returnType=schema))
    for name, f in SCALARS.items():
        spark.udf.register(name, f)
    marked, plain = "".join(S._BASES.values()), "".join(base * len(v) for base, v in S._BASES.items())
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION ascii_fold(s STRING) RETURNS STRING RETURN translate(s, '{marked}{marked.upper()}', '{plain}{plain.upper()}')")


def _exams(t) -> DataFrame:
    """Every part as an exam text: a heading, three marked questions, the second with choices; a third of them with plain numbers."""
    p = t("part").select("p_partkey", "p_name", "p_brand", "p_size")
    marked = F.concat(F.lit("Exam\nCâu 1. About "), "p_name", F.lit("\n\nCâu 2: Which?\nA. "), "p_brand", F.lit("\nB) none\n  of these\nBài 3) Size "), F.col("p_size").cast("string"), F.lit("\n"))
    numbered = F.concat(F.lit("1. About "), "p_name", F.lit("\n2) Size "), F.col("p_size").cast("string"))
    return p.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, numbered).otherwise(marked).alias("text"))


@query("udtf_questions", """
SELECT p_partkey, 0 AS pos, 1 AS number, CASE WHEN p_partkey % 3 = 0 THEN '1. About ' ELSE 'Câu 1. About ' END || p_name AS question FROM part
UNION ALL SELECT p_partkey, 1, 2, CASE WHEN p_partkey % 3 = 0 THEN '2) Size ' || p_size ELSE 'Câu 2: Which?' || chr(10) || 'A. ' || p_brand || chr(10) || 'B) none' || chr(10) || '  of these' END FROM part
UNION ALL SELECT p_partkey, 2, 3, 'Bài 3) Size ' || p_size FROM part WHERE p_partkey % 3 != 0""")
def udtf_questions(t, spark):
    """The questions of planted exams, from SQL."""
    register(spark)
    _exams(t).createOrReplaceTempView("quillspark_exams")
    return spark.sql("SELECT p_partkey, q.pos, q.number, q.question FROM quillspark_exams, LATERAL split_questions(text) q")


@query("split_exams", """
SELECT p_partkey, 0 AS pos, 1 AS number, CASE WHEN p_partkey % 3 = 0 THEN '1. About ' ELSE 'Câu 1. About ' END || p_name AS question FROM part
UNION ALL SELECT p_partkey, 1, 2, CASE WHEN p_partkey % 3 = 0 THEN '2) Size ' || p_size ELSE 'Câu 2: Which?' || chr(10) || 'A. ' || p_brand || chr(10) || 'B) none' || chr(10) || '  of these' END FROM part
UNION ALL SELECT p_partkey, 2, 3, 'Bài 3) Size ' || p_size FROM part WHERE p_partkey % 3 != 0""")
def split_exams(t, spark):
    """The same by column expressions."""
    return split_questions(_exams(t)).select("p_partkey", "pos", "number", "question")


@query("udtf_choices", """
SELECT p_partkey, 0 AS pos, 'A' AS key, p_brand AS choice FROM part WHERE p_partkey % 3 != 0 UNION ALL SELECT p_partkey, 1, 'B', 'none of these' FROM part WHERE p_partkey % 3 != 0""")
def udtf_choices(t, spark):
    """The choices of the planted exams' questions: table functions chained."""
    register(spark)
    _exams(t).createOrReplaceTempView("quillspark_exams")
    return spark.sql("SELECT p_partkey, c.pos, c.key, c.choice FROM quillspark_exams, LATERAL split_questions(text) q, LATERAL parse_choices(q.question) c")


@query("udtf_chunks", "SELECT doc_id, md5(text) AS joined FROM documents WHERE text IS NOT NULL AND trim(text, chr(32) || chr(9) || chr(10) || chr(13)) != ''")
def udtf_chunks(t, spark):
    """Chunks of 400 characters put together again are the text."""
    register(spark)
    t("documents").select("doc_id", "text").createOrReplaceTempView("quillspark_texts")
    rows = spark.sql("SELECT doc_id, c.pos, c.chunk FROM quillspark_texts, LATERAL chunk_text(text, 400) c")
    return rows.groupBy("doc_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "chunk"))), lambda x: x["chunk"]), "")).alias("joined"))


@query("sql_functions", """
SELECT c_custkey, 'Tran ' || c_custkey AS folded, c_mktsegment = c_mktsegment AS same, '[{"question": "' || c_mktsegment || '"}]' AS items, '(' || c_custkey || ')/(2)' AS plain FROM customer""")
def sql_functions(t, spark):
    """The scalar functions from SQL, over every customer."""
    register(spark)
    t("customer").createOrReplaceTempView("quillspark_customers")
    return spark.sql("""
SELECT c_custkey, ascii_fold('Trần ' || c_custkey) AS folded, seq_ratio(c_mktsegment, lower(c_mktsegment)) = 1.0 AS same,
       json_salvage('Reply: [{"question": "' || c_mktsegment || '"},]') AS items, latex_to_text('\\\\frac{' || c_custkey || '}{2}') AS plain FROM quillspark_customers""")
