"""Exact deduplication by deterministic block naming.

Texts that share their 64-bit fingerprint and length with another row are
cut into blocks of a fixed size.  Distinct blocks are sorted and numbered,
part by part; then neighbouring pairs of numbers are sorted and numbered, level by level,
until every document has one number.  Two texts have one number at one level
exactly when they are equal: no hash decides that.  A text whose fingerprint
nobody shares equals no other, so it is its own identity and is not cut: the
fingerprint only tells apart what is certainly different.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.llm.common import spread, stage, whole

#: Bytes of a block.
BLOCK = 4096


def _numbered(keys: DataFrame, by: list[str], name: str) -> DataFrame:
    """Distinct rows of ``keys`` with integer names, written once.

    Equal keys meet after each task has dropped its own repeats.  Each part
    of the keys is sorted and numbered from an offset of its own, so no key
    is sent to the driver to find the parts.
    """
    ordered = keys.select(*by).distinct().repartition(spread(keys), *by).sortWithinPartitions(*by)
    return stage(ordered.withColumn(name, F.monotonically_increasing_id()))


def _name_blocks(texts: DataFrame, block: int) -> DataFrame:
    """(rid, body) -> (rid, level, name): equal (level, name) means equal bodies."""
    cut = texts.select("rid", "body", F.greatest(F.ceil(F.octet_length("body") / block), F.lit(1)).cast("int").alias("n"))
    blocks = cut.select("rid", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("idx"), "body")
    blocks = blocks.select("rid", "n", "idx", F.substring(F.col("body"), F.col("idx") * block + 1, F.lit(block)).alias("part"))
    names = _numbered(blocks, ["part"], "name")
    named = stage(blocks.join(names, "part").select("rid", "n", "idx", "name"))
    done, level = named.filter("n = 1").select("rid", F.lit(0).alias("level"), "name"), 0
    rest = named.filter("n > 1")
    while not rest.isEmpty():
        level += 1
        pairs = rest.groupBy("rid", "n", (F.col("idx").bitwiseAND(F.lit(-2)) / 2).cast("int").alias("idx")).agg(
            F.max(F.when(F.col("idx").bitwiseAND(F.lit(1)) == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("idx").bitwiseAND(F.lit(1)) == 1, F.col("name"))), F.lit(-1)).alias("b"),
        )
        names = _numbered(pairs, ["a", "b"], "name")
        rest = stage(pairs.join(names, ["a", "b"]).select("rid", ((F.col("n") + 1) / 2).cast("int").alias("n"), "idx", "name"))
        done = done.unionByName(rest.filter("n = 1").select("rid", F.lit(level).alias("level"), "name"))
        rest = rest.filter("n > 1")
    return done


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; null counts as empty.  Of each
    group the row with the largest id stays (null ids are smallest).  Of rows
    that repeat that very id in one group, one stays.  An empty table gives
    no rows.  Other columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("body")).select("doc_id", "body", F.xxhash64("body").alias("h"), F.octet_length("body").alias("len"))
    shared = rows.groupBy("h", "len").agg(F.count(F.lit(1)).alias("same")).filter("same > 1").drop("same")
    shared = stage(shared.withColumn("shared", F.lit(True)))
    # One pass moves the texts to their fingerprints; skewed partitions of the left side are split.
    marked = stage(
        rows.join(shared.hint("merge"), ["h", "len"], "left").select(
            "doc_id", F.sha2(F.col("body").cast("binary"), 256).alias("text_sha256"), F.when(F.col("shared"), F.col("body").cast("binary")).alias("body"), F.monotonically_increasing_id().alias("rid")
        )
    )
    named = stage(_name_blocks(marked.filter("body is not null").select("rid", "body"), block))
    ids = marked.filter("body is not null").select("rid", "doc_id", "text_sha256").join(named, "rid")
    ids = stage(ids)
    best = ids.groupBy("level", "name").agg(F.max(F.struct("doc_id", "rid")).alias("top"), F.count(F.lit(1)).alias("group_size"))
    groups = best.select("level", "name", F.col("top.doc_id").alias("keep_id"), F.col("top.rid").alias("keep_rid"), "group_size")
    copies = ids.join(groups.hint("merge"), ["level", "name"]).select("doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), "text_sha256")
    alone = marked.filter("body is null").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return alone.unionByName(copies)


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
