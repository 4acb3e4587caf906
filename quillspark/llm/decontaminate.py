"""Benchmark decontamination by SimHash windows.

Windows of the benchmark items' sizes are taken from the documents: those that
start at a word n-gram of an item of that size, or end the document, and hold
enough such n-grams to reach the similarity; any other window can be moved
right to one of these without losing a shared n-gram.  Each window and item
gets a 64-bit SimHash, whose bits are cut into RADIUS + 1 blocks:
fingerprints that differ in RADIUS bits at most have a block in common, so
the index of all items' blocks names every item within the radius of a
window.  These candidates are verified by their exact weighted n-gram
similarity, where an n-gram weighs as often as it occurs.

Only DataFrame functions run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillspark.llm.common import keyed, stage

#: Words of an n-gram and least similarity.
WORDS, SIMILAR = 5, 0.75
#: Bits that a window's fingerprint may differ by.  Fingerprints are made of the bags that are compared.  At similarity 0.75 an angle of 0.54 is expected, or 11 of 64 bits
#: with a deviation of 3; 24 lies more than four deviations beyond.
BITS, RADIUS = 64, 24
#: n-grams of the benchmark that are broadcast at the most (about 40 bytes each); more are joined by shuffling.
BROADCAST = 500_000


def words_of(text: Column) -> Column:
    """Lower-cased words between white space; null has none."""
    clean = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\x0b\f\r"))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, "[ \\t-\\r]+"))


def grams_of(words: Column, m: int) -> Column:
    """Hashes of the m-word sequences, in order, with repeats."""
    hashed = F.transform(F.sequence(F.lit(0), F.size(words) - m), lambda i: F.xxhash64(F.lit(m), *[F.get(words, i + k) for k in range(m)]))
    return F.when(F.size(words) >= m, hashed).otherwise(F.array().cast("array<bigint>"))


def bag_of(grams: Column) -> Column:
    """A set that stands for a bag: each n-gram with the number of its repeat."""
    return F.transform(grams, lambda g, i: F.xxhash64(g, F.size(F.filter(F.slice(grams, F.lit(1), i), lambda x: x == g))))


def simhash(grams: Column) -> Column:
    """64-bit SimHash: each bit is the majority of the n-grams' bits."""
    bit = lambda j: F.aggregate(grams, F.lit(0), lambda a, g: a + (F.getbit(g, j) * 2 - 1).cast("int"))
    bits = F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda j: F.when(bit(j) > 0, F.lit(1)).otherwise(F.lit(0)))
    return F.conv(F.array_join(F.transform(bits, lambda b: b.cast("string")), ""), 2, -10).cast("long")


def blocks_of(print_: Column) -> Column:
    """Number and bits of each of RADIUS + 1 blocks."""
    edges = [round(k * BITS / (RADIUS + 1)) for k in range(RADIUS + 2)]
    return F.array(*[F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(print_, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("bits")) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))])


def starts(similar: float) -> Column:
    """Starts of the windows to look at, from ``ps``, the sorted positions of shared n-grams in a document of ``n`` words.

    Moved right up to the next shared n-gram, or to the document's end, a
    window loses none, so the best one starts at one of ``ps`` or is the last.
    Of those, windows with too few shared n-grams for ``similar`` are left out.
    """
    n, size, ps = F.col("n"), F.col("len"), F.col("ps")
    grams = size - F.col("m") + 1
    least = F.greatest(F.ceil(2 * grams * similar / (1 + similar) - 1e-9).cast("int"), F.lit(1))
    last = F.greatest(n - size, F.lit(0))
    full = F.filter(ps, lambda p, i: (p <= n - size) & (F.get(ps, i + least - 1) - p < grams))
    end = F.when((n < size) | (F.get(ps, F.size(ps) - least) >= last), F.array(last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.concat(full, end))


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", words: int = WORDS, similar: float = SIMILAR) -> DataFrame:
    """(rid, item, similarity): the best window of each document for each item it holds."""
    items = benchmark.select(F.col(item_id).alias("item"), words_of(F.col(item_text)).alias("w")).filter("size(w) > 0 and item is not null")
    items = stage(items.withColumn("len", F.size("w")).withColumn("m", F.least(F.lit(words), F.col("len"))))
    totals = items.groupBy("m").agg(F.sum(F.col("len") - F.col("m") + 1).alias("grams")).collect()  # one row for each m up to ``words``
    small = sum(r["grams"] for r in totals) <= BROADCAST
    side = (lambda df: F.broadcast(df)) if small else (lambda df: df.hint("merge"))

    split = docs.select("rid", words_of(F.col("text")).alias("w"))
    found = None
    for m in sorted(r["m"] for r in totals):
        index = items.filter(F.col("m") == m).select("item", "len", F.explode(grams_of(F.col("w"), m)).alias("g")).distinct()
        seen = split.select("rid", F.size("w").alias("n"), F.posexplode(grams_of(F.col("w"), m)).alias("p", "g"))
        hits = seen.join(side(index), "g").select("rid", "n", "item", "len", "p", F.lit(m).alias("m"))
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return docs.sparkSession.createDataFrame([], "rid long, item long, similarity double")
    found = found.groupBy("rid", "n", "item", "len", "m").agg(F.sort_array(F.collect_set("p")).alias("ps"))
    wanted = found.select("rid", "item", "len", "m", F.explode(starts(similar)).alias("s")).groupBy("rid").agg(F.collect_set(F.struct("len", "s", "m")).alias("wanted"))
    windows = split.join(wanted.hint("merge"), "rid").select("rid", F.explode(F.transform("wanted", lambda x: F.struct(x["len"].alias("len"), x["m"].alias("m"), F.slice("w", x["s"] + 1, x["len"]).alias("w")))).alias("x"))
    # The same window text in many documents is judged once, for whichever items are near it.
    windows = stage(windows.select("rid", "x.len", "x.m", "x.w", F.xxhash64("x.w").alias("wid")))

    def prints(df: DataFrame) -> DataFrame:
        grams = None
        for m in sorted(r["m"] for r in totals):
            grams = F.when(F.col("m") == m, grams_of(F.col("w"), m)) if grams is None else grams.when(F.col("m") == m, grams_of(F.col("w"), m))
        return df.withColumn("grams", grams).withColumn("bag", bag_of(F.col("grams"))).withColumn("print", simhash(F.col("bag")))

    different = prints(windows.groupBy("len", "m", "wid", "w").agg(F.count(F.lit(1)).alias("times")).drop("times"))
    known = prints(items.select("item", "len", "m", "w"))
    left = stage(different.select("len", "m", "wid", "bag", "print"))
    right = stage(known.select("item", "len", "m", F.col("bag").alias("item_bag"), F.col("print").alias("item_print")))
    size = ["len", "m"]
    lookup = right.select("item", *size, "item_print", F.explode(blocks_of(F.col("item_print"))).alias("b")).select("item", *size, "item_print", "b.block", "b.bits")
    asked = left.select(*size, "wid", "print", F.explode(blocks_of(F.col("print"))).alias("b")).select(*size, "wid", "print", "b.block", "b.bits")
    near = asked.join(side(lookup), [*size, "block", "bits"]).filter(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS).select("item", *size, "wid").distinct()
    shared = F.size(F.array_intersect("bag", "item_bag"))
    judged = (
        near.join(left.select(*size, "wid", "bag"), [*size, "wid"])
        .join(side(right.select("item", "item_bag")), "item")
        .select("item", *size, "wid", (shared / (F.size("bag") + F.size("item_bag") - shared)).alias("similarity"))
        .filter(F.col("similarity") >= similar)
    )
    judged = judged.groupBy("item", *size, "wid").agg(F.max("similarity").alias("similarity"))
    return windows.select("rid", *size, "wid").join(judged.hint("merge"), [*size, "wid"]).groupBy("rid", "item").agg(F.max("similarity").alias("similarity"))


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row for each row of ``docs``: doc_id, contaminated, n_items, item_ids, similarity.

    A document is contaminated by an item if a window of the item's number of
    words has similarity 0.75 or more with it (the whole document, where it is
    shorter); ``similarity`` is the best of all, 0 where there is none.  Null texts and ids are kept and are clean
    unless shown otherwise; items without words are passed over; items of
    fewer than five words must occur as they are.  An empty benchmark leaves
    all documents clean; an empty table gives no rows.
    """
    rows = keyed(docs, doc_id, text)
    found = leaks(rows, benchmark, **options)
    per_doc = found.groupBy("rid").agg(F.count(F.lit(1)).alias("n_items"), F.sort_array(F.collect_list("item")).alias("item_ids"), F.max("similarity").alias("similarity"))
    out = rows.select("rid", "doc_id").join(per_doc.hint("merge"), "rid", "left")
    return out.select(
        "doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"), F.coalesce("similarity", F.lit(0.0)).alias("similarity")
    )


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
