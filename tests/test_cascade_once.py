"""The chat's cascade compares requests with the bank once."""

from __future__ import annotations

from quillspark.operators import retrieval


def test_tiers_read_pairs_that_were_compared_once(spark):
    asked = spark.createDataFrame([(1, "Of The rest", None, None), (2, "zzz", 2, [1.0, 0.0])], "request long, text string, grade int, q array<double>")
    bank = spark.createDataFrame([(7, "one OF THE REST", 1, None, True), (8, "of the rest", 1, None, False), (9, "x", 3, [1.0, 0.1], True)], "id long, text string, grade int, v array<double>, has_steps boolean")
    got = retrieval.cascade(asked, bank)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString() and "lower(" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r) for r in got.collect()) == [(1, 3, 1, 7), (2, 2, 1, 9)]
