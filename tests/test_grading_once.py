"""Answers are read once a row."""

from __future__ import annotations

from quillspark.operators import grading


def test_json_of_an_answer_is_not_read_anew_for_each_use(spark):
    rows = spark.createDataFrame([r[:9] for r in grading._GRADED], "id int, type string, correct string, given string, points double, mode string, penalty double, per_blank double, partial boolean")
    graded = grading.grade(rows)
    assert graded.columns == [*rows.columns, "is_correct", "points_earned"]
    plan = graded._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") <= 12 and plan.count("get_json_object") <= 8
    assert {r.id: (r.is_correct, r.points_earned) for r in graded.collect()} == {r[0]: r[9:] for r in grading._GRADED}
