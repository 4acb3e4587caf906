"""Tables that are made when they are missing and widened when columns are; vectors made for rows that lack one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from quillspark.functions import scalars as S
from quillspark.operators.similarity import hashed_embedding
from quillspark.plans.registry import query
from quillspark.plans.staging import fresh_path

#: Numbers of a stored vector; shorter ones are filled up with zeros, longer ones cut.
DIMS = 64

# The derived tables beside the question bank.
SCHEMAS = {
    "question_embedding": "question_id bigint, user_id bigint, topic string, difficulty string, grade int, chapter string, embedding array<float>",
    "question_similarity": "question_id bigint, similar_id bigint, score double",
    "chat_session": "id bigint, user_id bigint, title string, grade int, created_at timestamp",
    "chat_message": "id bigint, session_id bigint, role string, content string, context_ids array<bigint>, created_at timestamp",
}


def ensured(spark: SparkSession, path: str, schema: str) -> list[str]:
    """Makes an empty table where none is, else adds the columns that it lacks; returns what was added.

    A column that is there with another type is an error: it is never guessed.
    Old files are not rewritten; readers take added columns as null there.
    """
    want = T._parse_datatype_string(schema)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root):
        spark.createDataFrame([], want).coalesce(1).write.parquet(path)
        return want.fieldNames()
    have = {f.name: f.dataType for f in spark.read.option("mergeSchema", True).parquet(path).schema}
    for f in want:
        if f.name in have and have[f.name] != f.dataType:
            raise ValueError(f"{path}: column {f.name} is {have[f.name].simpleString()}, not {f.dataType.simpleString()}")
    added = [f for f in want if f.name not in have]
    if added:
        spark.createDataFrame([], T.StructType(added)).coalesce(1).write.mode("append").parquet(path)
    return [f.name for f in added]


def table(spark: SparkSession, path: str) -> DataFrame:
    """A table that was widened, read with all columns."""
    return spark.read.option("mergeSchema", True).parquet(path)


def materialised(spark: SparkSession, path: str, rows: DataFrame, provider: Callable[[Column], Column], text: str = "text", key: str = "question_id", dims: int = DIMS) -> DataFrame:
    """Makes vectors for the rows (key, text, ...) that have none yet and appends them; returns the table.

    Rows that have a vector keep it, even if their text has changed.  Blank
    texts get none.  ``provider`` is a column expression or a batched function.
    """
    held = table(spark, path)
    new = rows.filter(F.trim(F.coalesce(text, F.lit(""))) != "").join(held.select(key), key, "left_anti")
    made = new.withColumn("embedding", S.fitted(provider(F.col(text)), dims).cast("array<float>")).drop(text)
    made.select(*[c for c in held.columns if c in made.columns]).write.mode("append").parquet(path)
    return table(spark, path)


@query("materialised_vectors", """
SELECT doc_id AS question_id, source AS topic, 64 AS dims, doc_id % 3 = 0 AS early FROM documents WHERE trim(text) != ''""")
def materialised_vectors(t, spark):
    """Vectors of all documents, made in two runs by a stand-in for a model; the second finds what the first has made."""
    path = fresh_path(spark, "vectors")
    ensured(spark, path, SCHEMAS["question_embedding"])
    ensured(spark, path, "question_id bigint, early boolean")
    docs = t("documents").select(F.col("doc_id").alias("question_id"), F.col("source").alias("topic"), "text", (F.col("doc_id") % 3 == 0).alias("early"))
    short = lambda x: F.slice(hashed_embedding(x), 1, 40)
    materialised(spark, path, docs.filter("early"), short)
    return materialised(spark, path, docs, hashed_embedding).select("question_id", "topic", F.size("embedding").alias("dims"), "early")
