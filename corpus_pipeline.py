"""The corpus pipeline: stages over ``documents``, each written and read by the next.

A stage takes what its predecessor kept, drops what it decides against, and
returns the columns of ``documents``; the last one adds the token ids.  Where
ids repeat or are null, rows are told apart by their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.llm.bpe import encode_documents
from quillspark.llm.common import free_name, numbered, stage
from quillspark.llm.decontaminate import contamination
from quillspark.llm.exact_dedup import exact_groups
from quillspark.llm.jaccard_join import near_duplicate_groups
from quillspark.llm.quality import fit_quality, score_quality

#: Tokenizer file of the last stage.
TOKENIZER = "word_bpe_49k.json"
#: Documents that score less go.
LEAST_QUALITY = 0.5


def _without(docs: DataFrame, row: str, gone: DataFrame) -> DataFrame:
    return docs.join(gone.hint("merge"), row, "left_anti").drop(row)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble accepts."""
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = free_name(docs, "quality_score")
    return score_quality(docs, model, score=score).filter(F.col(score) >= LEAST_QUALITY).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id."""
    rows, row = numbered(docs)
    groups = exact_groups(rows, doc_id=row)
    return _without(rows, row, groups.filter("not kept").select(F.col("doc_id").alias(row)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by similarity, the one with the smallest id."""
    rows, row = numbered(docs)
    groups = near_duplicate_groups(rows, doc_id=row)
    return _without(rows, row, groups.filter("doc_id != component_id").select(F.col("doc_id").alias(row)))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    rows, row = numbered(docs)
    found = contamination(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), doc_id=row)
    return _without(rows, row, found.filter("contaminated").select(F.col("doc_id").alias(row)))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document and the text they decode to."""
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path(TOKENIZER)).drop("text")


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", tokens),
]

#: The classifier's model, the components of links and the encoding are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, f) in enumerate(STAGES):
        docs = f(spark, docs if k == 0 else stage(docs), sf_dir)
    return docs
