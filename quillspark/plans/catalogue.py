"""All queries of the analytics engine and the SQL each must agree with."""

from __future__ import annotations

from quillspark.operators import analytics, bank, classes, dml, duplicates, filters, fuzzy, grading, intake, planted, quizzes, ranking, replies, retrieval, rules, sampling, similarity, table_functions, text, text_index, vector_index  # noqa: F401  (modules register their queries)
from quillspark.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
from quillspark.sources import docx, tables  # noqa: F401
from quillspark.streaming import live, progress  # noqa: F401
