"""Documents of quizzes on their way in."""

from __future__ import annotations

from quillspark.operators import quizzes


def test_a_document_is_not_read_to_see_whether_it_has_questions(spark):
    said = ['{"theories":[{"sections":[{"content":"s"}]}],"questions":[{"order":1,"hint_theory_index":0,"hint_section_index":0},null]}', '{"questions":[]}', "{}", "no json", None]
    out = quizzes.imported(spark.createDataFrame(list(enumerate(said)), "quiz int, document string"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("from_json") <= 2
    assert [(r.quiz, r.order, r.hint) for r in out.collect()] == [(0, 1, "s"), (0, None, None)]
