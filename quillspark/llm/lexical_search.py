"""Ranked lexical search by deduplicated bags.

A document's bag holds the items' words that it has, with their counts; other
words only tell its length.  Documents of one bag and one length factor score
alike for every item, so such a class is scored once, and only the members of
the classes that reach a result are looked up, least doc_id first.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from quillspark.llm.anchors import ROWS
from quillspark.llm.common import documents, position, stage, whole

TOP = 10
#: Bytes of item texts whose words and postings are sent to every task at a time; more items make more passes.
ITEM_BYTES = 4 << 20
#: Scores and bytes of bags held before the best of each item are picked; more where the picked ones alone fill half of it.
SCORES, HELD = 1 << 18, 32 << 20
#: Upper case to lower case for A-Z, separators to spaces, all else (letters of other scripts too) as it is.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words(text: str | None) -> list[bytes]:
    """The terms of a text in UTF-8; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def bags(docs: DataFrame, vocabulary: dict[bytes, int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, bag) for each row: its number of terms, and the vocabulary's terms in it with their counts, packed in order."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, ROWS):
                b = whole_batch.slice(at, ROWS)
                n, packed = [], []
                for body in b.column("text").to_pylist():
                    found = words(body)
                    n.append(len(found))
                    counts = Counter(map(known.get, found))
                    counts.pop(None, None)
                    packed.append(np.array(sorted(counts.items()), np.int64).reshape(-1, 2).astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(packed, pa.binary())], names=["doc_id", "n", "bag"])

    return rows.mapInArrow(run, "doc_id long, n long, bag binary")


def document_frequencies(bagged: DataFrame, size: int) -> np.ndarray:
    """Number of documents that hold each of the vocabulary's terms; a task adds up its own before anything moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, np.int64)
        for b in batches:
            joined = np.frombuffer(b"".join(b.column("bag").to_pylist()), "<u4").reshape(-1, 2)
            seen += np.bincount(joined[:, 0], minlength=size)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], names=["term", "df"])

    out = np.zeros(size, np.int64)
    for term, df in bagged.select("bag").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df")).collect():
        out[term] = df
    return out


def _scored(classes: DataFrame, postings: tuple[np.ndarray, np.ndarray, np.ndarray], items: int, top: int) -> DataFrame:
    """(bag, m, first) -> (item, bag, m, first, score): of each task and item the ``top`` best classes."""
    held = classes.sparkSession.sparkContext.broadcast(postings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, holder, weight = held.value
        best: list[tuple[np.ndarray, ...]] = []  # item, score, first, and the class's place in ``kept``
        kept: list[tuple[bytes, int]] = []
        least = np.ones(items, np.int64)  # scores below cannot enter any more
        size, most, room, full = 0, SCORES, 0, HELD

        def pick() -> None:
            nonlocal best, kept, size, most, room, full
            item, score, first, at = (np.concatenate(c) for c in zip(*best, strict=True))
            order = np.lexsort((first, -score, item))
            item, score, first, at = item[order], score[order], first[order], at[order]
            place = np.arange(len(item)) - np.searchsorted(item, item)
            stay = place < top
            last = place == top - 1
            least[item[last]] = score[last]
            item, score, first = item[stay], score[stay], first[stay]
            used, at = np.unique(at[stay], return_inverse=True)
            kept = [kept[k] for k in used]
            best, size = [(item, score, first, at)], len(item)
            room = sum(len(k[0]) for k in kept)
            most, full = max(SCORES, 2 * size), max(HELD, 2 * room)

        for b in batches:
            for bag, m, first in zip(b.column("bag").to_pylist(), b.column("m").to_numpy(), b.column("first").to_numpy(), strict=True):
                pairs = np.frombuffer(bag, "<u4").reshape(-1, 2).astype(np.int64)
                term, tf = pairs[:, 0], pairs[:, 1]
                value = (1_000_000_000 * tf) // (1000 * tf + 8 * m)
                counts = starts[term + 1] - starts[term]
                where = np.repeat(starts[term] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
                total = np.zeros(items, np.int64)
                np.add.at(total, holder[where], weight[where] * np.repeat(value, counts))
                good = np.flatnonzero(total >= least)
                if len(good):
                    best.append((good, total[good], np.full(len(good), first), np.full(len(good), len(kept))))
                    kept.append((bag, int(m)))
                    size, room = size + len(good), room + len(bag)
                    if size >= most or room >= full:
                        pick()
        if best:
            pick()
            item, score, first, at = best[0]
            for k in range(0, len(item), 4096):
                part = slice(k, k + 4096)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(item[part]), pa.array([kept[a][0] for a in at[part]], pa.binary()), pa.array([kept[a][1] for a in at[part]], pa.int64()), pa.array(first[part]), pa.array(score[part])], names=["item", "bag", "m", "first", "score"]
                )

    return classes.select("bag", "m", F.coalesce("first", F.lit((1 << 63) - 1)).alias("first")).mapInArrow(run, "item long, bag binary, m long, first long, score long")


def _block(docs: DataFrame, texts: list[str | None], top: int) -> DataFrame | None:
    """(item, doc_id, score, rank) for one block of items, numbered as given."""
    counts = [Counter(words(x)) for x in texts]
    vocabulary = {w: k for k, w in enumerate(sorted(set().union(*counts)))}
    if not vocabulary:
        return None
    bagged = stage(bags(docs, vocabulary))
    told = bagged.filter("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_docs, n_terms = int(told[0]), int(told[1])
    if not n_docs:
        return None
    df = document_frequencies(bagged, len(vocabulary))
    weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    # Postings of each term: the items that hold it and its weight times its number there.
    entries = np.array(sorted((vocabulary[w], item, c) for item, held in enumerate(counts) for w, c in held.items()), np.int64)
    starts = np.searchsorted(entries[:, 0], np.arange(len(vocabulary) + 1))
    postings = (starts, entries[:, 1].copy(), weight[entries[:, 0]] * entries[:, 2])
    m = F.lit(25) + F.expr(f"(75 * n * {n_docs}L) div {n_terms}L")
    some = bagged.filter(F.octet_length("bag") > 0).select("doc_id", m.cast("long").alias("m"), "bag")
    # The hash spreads and orders the rows; bags and factors themselves are what is compared.
    classes = stage(some.groupBy(F.xxhash64("bag", "m").alias("h"), "bag", "m").agg(F.min("doc_id").alias("first")))
    scored = stage(_scored(classes, postings, len(texts), top))
    place = W.partitionBy("item").orderBy(F.desc("score"), "first")
    chosen = scored.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= top).drop("place", "first")
    # At most ``top`` classes an item, so their hashes are fewer than ``top`` for each 64 of ``item_bytes``; each task passes on the least ids of a class only.
    chosen = stage(chosen)
    wanted = chosen.select(F.xxhash64("bag", "m").alias("h")).distinct()
    own = F.row_number().over(W.partitionBy("bag", "m").orderBy(F.asc_nulls_last("doc_id")))
    members = some.withColumn("h", F.xxhash64("bag", "m")).join(F.broadcast(wanted), "h", "left_semi").withColumn("own", own).filter(F.col("own") <= top).select("bag", "m", "doc_id", "own")
    rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "own"))
    return chosen.join(members, ["bag", "m"]).withColumn("rank", rank).filter(F.col("rank") <= top).select("item", "doc_id", "score", "rank")


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents for each row of ``items``, best first.

    Scores are whole numbers, the same on every run.  Null texts have no
    terms; such items, and items of which no document holds a term, have no
    rows.  Repeated ids of documents or items are rows of their own; null ids
    come last among equal scores.  Items are taken in blocks of about
    ``item_bytes`` of text, so what a task holds of them is bounded (a longer
    item makes a block of its own size), whatever their number.
    """
    spark = docs.sparkSession
    asked = stage(items.select(F.col(item_id).alias("item_id"), whole(item_text).alias("text")).withColumn("row", F.monotonically_increasing_id()))
    total = asked.agg(F.coalesce(F.sum(F.octet_length("text").cast("long") + 64), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // item_bytes))
    rows = docs.select(F.col(docs.columns[position(docs, doc_id)]).alias("doc_id"), F.col(docs.columns[position(docs, text)]).alias("text"))
    out = None
    for k in range(blocks):
        block = [tuple(x) for x in asked.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == k).select("row", "text").orderBy("row").collect()]
        found = _block(rows, [x[1] for x in block], top) if block else None
        if found is None:
            continue
        numbers = spark.createDataFrame([(i, x[0]) for i, x in enumerate(block)], "item long, row long")
        found = found.join(F.broadcast(numbers), "item").select("row", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "row long, rank int, doc_id long, score long")
    return out.join(asked.select("row", "item_id"), "row").select("item_id", F.col("rank").cast(T.IntegerType()).alias("rank"), "doc_id", "score")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all documents for each item of ``benchmark``."""
    return ranked_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH t AS (SELECT doc_id, unnest({_TERMS.format('text')}) AS w FROM documents), f AS (SELECT doc_id, w, count(*) AS tf FROM t GROUP BY ALL), d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM f GROUP BY doc_id),
s AS (SELECT count(*) AS nd, sum(n)::BIGINT AS nl FROM d), x AS (SELECT w, count(*) AS df FROM f GROUP BY w),
q AS (SELECT item_id, w, count(*) AS c FROM (SELECT item_id, unnest({_TERMS.format('text')}) AS w FROM benchmark) GROUP BY ALL),
k AS (SELECT q.item_id, q.w, q.c * floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight FROM q JOIN x USING (w), s),
m AS (SELECT doc_id, 25 + ((75 * n * nd) // nl) AS m FROM d, s),
r AS (SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM k JOIN f USING (w) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM r WHERE score > 0 QUALIFY rank <= {TOP}"""
