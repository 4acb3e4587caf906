"""Fuzzy matching against plain loops over all pairs."""

from __future__ import annotations

import random
import re
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from quillspark.operators import fuzzy
from quillspark.plans import catalogue

SF = "/root/testdata/sf0.001"


def ratio(a: str, b: str) -> float:
    a, b = a.strip().lower(), b.strip().lower()
    return 0.0 if not a or not b else 1.0 if a == b else SequenceMatcher(None, a, b).ratio()


def test_bounds_never_cut_a_pair(spark):
    r = random.Random(4)
    words = ["".join(r.choice("abcé ") for _ in range(r.randint(0, 9))) for _ in range(60)] + ["Abc", " abc ", "", None]
    left = spark.createDataFrame([(k % 2, w) for k, w in enumerate(words)], "k int, a string")
    right = spark.createDataFrame([(k % 2, w) for k, w in enumerate(reversed(words))], "k int, b string")
    for least in (0.3, 0.6, 1.0):
        got = {(x.k, x.a, x.b): x.similarity for x in fuzzy.similar_pairs(left, right, ["k"], least).collect()}
        want = {(x.k, x.a, y.b): s for x in left.collect() for y in right.collect() if x.k == y.k and x.a and y.b and (s := ratio(x.a, y.b)) >= least}
        assert got == want


def test_chapter_hints(spark):
    hints = {"Chương 6": (6, ""), "Chương VII. Biểu thức": (7, "Biểu thức"), "C6.Hàm bậc hai": (6, "Hàm bậc hai"), "3 Số": (3, "3 Số"), "16 x": (None, "16 x"), "Đa thức": (None, "Đa thức"), "": (None, "")}
    rows = spark.createDataFrame([(h,) for h in hints], "h string").select("h", fuzzy.chapter_number(F.col("h")).alias("n"), fuzzy.chapter_text(F.col("h")).alias("t"))
    assert {x.h: (x.n, x.t) for x in rows.collect()} == hints


def _matched(row, curriculum: list):
    """One question against the curriculum, step by step."""
    lessons = [c for c in curriculum if (c.subject_code, c.grade) == (row.subject, row.grade)] or [c for c in curriculum if c.grade == row.grade]
    if not lessons:
        return None, None, None
    lessons.sort(key=lambda c: (c.lesson_no, c.subject_code))
    chapters = {}
    for c in lessons:
        chapters.setdefault(c.chapter_no, c.chapter)
    hint = (row.chapter or "").strip()
    m = re.search(r"[Cc]hương\s+(\d+)", hint) or re.match(r"[Cc](\d+)\s*\.", hint)
    roman = re.search(r"[Cc]hương\s+([IVX]+)\b", hint)
    number = int(m[1]) if m else {"I": 1, "II": 2, "III": 3, "IV": 4, "V": 5}[roman[1]] if roman else None
    said = re.sub(r"^[Cc]\d+\s*\.\s*|^[Cc]hương\s*(?:\d+|[IVX]+)\s*[.:\-]?\s*", "", hint).strip()
    score = lambda name: max(ratio(said, name), ratio(said, re.sub(r"^Chương\s*\d+\s*\.\s*", "", name)))
    chapter = number if number in chapters and (not said or score(chapters[number]) >= 0.35) else None
    if chapter is None and said:
        best = max(sorted(chapters), key=lambda n: score(chapters[n]))
        chapter = best if score(chapters[best]) >= 0.5 else None
    if chapter is None:
        return None, None, None
    own = [c for c in lessons if c.chapter_no == chapter]
    if len(own) == 1:
        return chapter, chapters[chapter], own[0].lesson_title
    best = max(own, key=lambda c: (ratio(row.lesson or "", c.lesson_title), -c.lesson_no))
    return chapter, chapters[chapter], best.lesson_title if ratio(row.lesson or "", best.lesson_title) >= 0.3 else None


def test_curriculum_against_a_matcher_row_by_row(spark):
    t = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    rows, curriculum = (x.collect() for x in fuzzy._tables(t))
    want = {x.id: _matched(x, curriculum) for x in rows}
    got = {x.id: (x.chapter_no, x.chapter_name, x.lesson_match) for x in catalogue.QUERIES["curriculum_match"](spark, SF).collect()}
    assert got == want
    assert {tuple(v is None for v in x) for x in want.values()} == {(True, True, True), (False, False, True), (False, False, False)}
    told = catalogue.QUERIES["curriculum_coverage"](spark, SF).first()
    assert (told.n, told.chapters, told.lessons) == (len(want), sum(x[0] is not None for x in want.values()), sum(x[2] is not None for x in want.values()))


def test_names_against_all_pairs(spark):
    names = {(x.p_size, x.p_name) for x in spark.read.parquet(f"{SF}/part.parquet").collect()}
    want = {(k, a, b, round(s, 6)) for k, a in names for j, b in names if k == j and a < b and (s := ratio(a, b)) >= 0.8}
    assert {tuple(x) for x in catalogue.QUERIES["fuzzy_names"](spark, SF).collect()} == want
