"""Contiguous shards of near equal bytes, by global prefix sums.

Documents are put in one global order (by content, then id), dealt into
ranges of it, and every range's totals are summed: the running totals of the
ranges before it, plus the running sum inside, give each document its global
byte offset.  Cuts lie at equal byte targets.  Documents of equal text are
neighbours in the order, and a cut that falls into such a group moves to the
nearer end of it, unless the group is larger than a set part of a shard.

Only DataFrame functions run, and only ids, sizes and hashes are moved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from quillspark.llm.common import spread, stage, whole

#: Added to the bytes of each text.
OVERHEAD = 8
#: A group of equal texts is kept whole up to this part of a shard.
WHOLE_GROUP = 0.125


def shard_by_bytes(docs: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text", overhead: int = OVERHEAD, whole_group: float = WHOLE_GROUP) -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the text's UTF-8 bytes plus ``overhead``; a null text has no
    bytes and the checksum of the empty one.  ``shard`` is in 0..shards-1,
    ``slot`` counts from 0 without gaps inside it.  Shards differ from the
    equal share by no more than the larger of one row and ``whole_group`` of
    the share.  Rows with equal or null ids are rows of their own; an empty
    table gives no rows, and with fewer rows than shards some stay empty.
    """
    given = F.col(doc_id)
    rows = docs.select(
        given.alias("doc_id"),
        (F.octet_length(whole(text)).cast("long") + overhead).alias("size"),
        F.crc32(whole(text)).alias("text_crc32"),
        F.xxhash64(whole(text)).alias("h"),
    )
    n = spread(docs)
    order = ["h", "text_crc32", "size", "doc_id"]
    ranged = stage(rows.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))

    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    # One row for each partition: a count that does not grow with a partition's rows.
    starts = totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank0"))
    inside = W.partitionBy("part").orderBy(*order)
    placed = stage(
        ranged.withColumn("run", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)))
        .withColumn("seq", F.row_number().over(inside))
        .join(F.broadcast(starts), "part")
        .select("doc_id", "size", "text_crc32", "h", (F.col("run") - F.col("size") + F.col("bytes0")).alias("at"), (F.col("seq") - 1 + F.col("rank0")).alias("rank"))
    )

    total = placed.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"))
    # The cuts: shards - 1 rows, whatever the input.
    cuts = total.select("total", F.explode(F.sequence(F.lit(1), F.lit(shards - 1))).alias("k")).select("k", "total", (F.col("total") * F.col("k") / F.lit(shards)).cast("long").alias("target")) if shards > 1 else total.select(F.lit(1).alias("k"), "total", F.col("total").alias("target"))
    hit = placed.join(F.broadcast(cuts), (F.col("at") <= F.col("target")) & (F.col("target") < F.col("at") + F.col("size")))
    hit = hit.select("k", "total", "target", "h", "text_crc32", "size", F.col("at").alias("row_at"))
    key = ["h", "text_crc32", "size"]
    groups = placed.join(F.broadcast(hit.select(*key).distinct()), key).groupBy(*key).agg(F.min("at").alias("first"), (F.max("at") + F.max("size")).alias("end"))
    near = lambda lo, hi: F.when(F.col("target") - lo <= hi - F.col("target"), lo).otherwise(hi)
    moved = hit.join(F.broadcast(groups), key).select(
        F.when(F.col("end") - F.col("first") <= F.col("total") / shards * whole_group, near(F.col("first"), F.col("end"))).otherwise(near(F.col("row_at"), F.col("row_at") + F.col("size"))).alias("cut")
    )
    bounds = moved.agg(F.sort_array(F.collect_list("cut")).alias("cuts"))
    dealt = placed.crossJoin(F.broadcast(bounds)).withColumn("shard", F.size(F.filter("cuts", lambda c: c <= F.col("at"))).cast("int"))
    firsts = dealt.groupBy("shard").agg(F.min("rank").alias("rank0"))
    return dealt.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("rank0")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
