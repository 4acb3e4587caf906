"""Labelled rows for the two classifiers: folds and a bounded sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Most labelled rows a model is fitted on; scoring always covers all rows.
MOST_ROWS = 20_000
FOLDS, HELD_OUT = 3, 1


def held_out(doc_id: Column) -> Column:
    """Whether labels of the row must stay unseen; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == HELD_OUT


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, doc_id: str = "doc_id", text: str = "text", most: int = MOST_ROWS) -> DataFrame:
    """(body, y) of at most ``most`` labelled rows outside the held-out fold.

    Rows are taken in the order of a hash of their id, so the sample is the
    same on every run.  Null labels are dropped; of repeated labels of one id
    the largest counts.  The sampled ids, ``most`` at the most, are broadcast.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
    known = known.groupBy(F.col(doc_id).alias("_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(most)
    return docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("body")).join(F.broadcast(known), "_id").select("body", "y")
