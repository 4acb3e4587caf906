"""Substring dedup by prefix-partitioned suffix trees over words.

A window of words goes if its word sequence also starts in a document with a
smaller id.  Windows are routed by anchors first (``anchors``): only suffixes
in segments whose anchor is repeated can lie below a deep node of the suffix
tree.  Segments that are equal as a whole hang at the same leaves, so the one
of the least document stands for all.

Suffixes are placed once, by a prefix whose length varies: four words, or
eight where one in a few hundred suffixes shares the four, or the whole window
where that many share the eight.  In a group the suffixes arrive sorted by
their words, and the common prefixes of neighbours give the internal nodes of
the group's suffix tree.  The nodes as deep as the window, with leaves of two
documents or more, are the maximal repeats: their leaves of all documents but
the least are removed.  A window that one in a few hundred suffixes shares is
such a node by itself and is settled by aggregation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.llm.anchors import batch, binaries, gram_hashes, lots, repeated_spans, rows_of, steady, word_codes
from quillspark.llm.common import keyed, spread, stage, stage_by

#: Words of a window, words of the grams whose least hash is the anchor, words of the two shorter prefixes.
WINDOW, GRAM, PREFIXES = 13, 5, (4, 8)
#: Documents looked at to find prefixes that need more words, and the share of their suffixes that makes a prefix such a one.
SAMPLE, SHARE = 4096, 1 / 512
#: Parts of the suffixes that are placed one after the other, to need less disk.
WAVES = 2

_SPANS = {"rid": pa.int64(), "a": pa.int64(), "e": pa.int64()}
_SPANS_SQL = "rid long, a long, e long"


def common_prefixes(suffixes: np.ndarray) -> np.ndarray:
    """Number of words that each sorted suffix, a row of words, shares with the one before it."""
    return np.concatenate([[0], np.logical_and.accumulate(suffixes[1:] == suffixes[:-1], axis=1).sum(1)])


def deep_nodes(shared: np.ndarray, depth: int) -> np.ndarray:
    """First leaf of the node of at least that depth above each sorted suffix; itself where it has none."""
    first = np.flatnonzero(np.concatenate([[True], shared[1:] < depth])) if len(shared) else np.zeros(0, np.int64)
    return np.repeat(first, np.diff(np.append(first, len(shared))))


def _trees(window: int):
    """Sorted (words, rid, p) -> the windows of each node but those of its least document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the last suffix seen and the least document of its node, which may go on in the next batch
        for b in batches:
            if not b.num_rows:
                continue
            words = np.frombuffer(b"".join(b["words"].to_pylist()), np.uint64).reshape(-1, window)
            rid, p = b["rid"].to_numpy(), b["p"].to_numpy().astype(np.int64)
            least = rid[deep_nodes(common_prefixes(words), window)]
            if last is not None and (last[0] == words[0]).all():
                least[: int(np.argmin(np.append((words == words[0]).all(1), False)))] = last[1]
            last = words[-1].copy(), least[-1]
            gone = rid > least
            yield batch({"rid": rid[gone], "a": p[gone], "e": p[gone] + window}, _SPANS)

    return run


def repeated_words(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, prefixes: tuple[int, int] = PREFIXES, share: float = SHARE) -> DataFrame:
    """(rid, body binary) -> (rid, n_words, sha, body, spans), as ``string_dedup.repeated_bytes``, in words; bodies are compressed."""

    def compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for lot in lots(rows_of(batches), lambda r: len(r[1])):
            yield batch({"rid": [r for r, _ in lot], "body": [pack(b) for _, b in lot]}, {"rid": pa.int64(), "body": pa.binary()})

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"rid": pa.int64(), "n_words": pa.int64(), "sha": pa.string(), "body": pa.binary(), "spans": kind}
        unpack = zstandard.ZstdDecompressor().decompress
        for lot in lots(rows_of(batches), lambda r: 2 * len(r[1])):
            rows, bodies = [], [unpack(b) for _, b, _ in lot]
            for (rid, packed, spans), body, codes in zip(lot, bodies, word_codes(bodies), strict=True):
                if not spans:
                    rows.append((rid, len(codes), hashlib.sha256(b" ".join(body.split())).hexdigest(), None, None))
                    continue
                for x in spans:
                    x["g"] = xxhash.xxh3_128_digest(codes[x["s"] : x["s"] + x["n"] + window - 1])
                rows.append((rid, len(codes), None, packed, spans))
            yield batch(dict(zip(types, zip(*rows, strict=True), strict=True)), types)

    spans = repeated_spans(docs, word_codes, gram, window)
    kind = pa.list_(pa.struct([("s", pa.int32()), ("n", pa.int32()), ("key", pa.int64()), ("g", pa.binary())]))
    span = "array<struct<s int, n int, key long, g binary>>"
    # The one pass that moves all texts; those without a repeated anchor are done after it, the others stay in its buckets.
    moved = docs.mapInArrow(steady(compressed), "rid long, body binary").join(spans.hint("merge"), "rid", "left").select("rid", "body", "spans")
    table = stage_by(moved.mapInArrow(steady(settled), f"rid long, n_words long, sha string, body binary, spans {span}"), "rid")
    segs = table.filter("spans is not null").select("rid", F.explode("spans").alias("x")).select("rid", "x.s", "x.n", "x.key", "x.g")
    met = segs.groupBy("g").agg(F.min("rid").alias("least"), F.count(F.lit(1)).alias("times")).filter("times > 1").drop("times")
    marked = stage(segs.join(met.hint("merge"), "g", "left").select("rid", "s", "n", "key", F.coalesce(F.col("rid") > F.col("least"), F.lit(False)).alias("gone")))
    live = marked.filter("not gone")
    shared = live.groupBy("key").agg(F.min("rid").alias("lo"), F.max("rid").alias("hi")).filter("lo < hi").select("key")
    asked = stage(live.join(shared.hint("merge"), "key").groupBy("rid").agg(F.collect_list(F.struct("s", "n")).alias("asked")))
    cuts = (*prefixes, window)

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"rid": pa.int64(), "p": pa.int32(), "words": pa.binary()}
        unpack = zstandard.ZstdDecompressor().decompress
        for lot in lots(rows_of(batches), lambda r: 2 * len(r[1])):
            rows = []
            for (rid, _, asked), codes in zip(lot, word_codes([unpack(body) for _, body, _ in lot]), strict=True):
                at = np.unique(np.concatenate([np.arange(x["s"], x["s"] + x["n"]) for x in asked]))
                first = np.flatnonzero(np.concatenate([[True], np.diff(at) > 1]))
                for a, e in zip(at[first], at[np.append(first[1:], len(at)) - 1], strict=True):
                    rows.append((rid, a, codes[a : e + window].tobytes()))
            yield batch(dict(zip(types, zip(*rows, strict=True), strict=True)), types)

    # Runs of suffixes that may be repeated, by their words.
    runs = stage(table.select("rid", "body").join(asked.hint("merge"), "rid").mapInArrow(steady(sliced), "rid long, p int, words binary"))

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Words, ids, places and hashes of the prefixes of many suffixes at a time."""
        for lot in lots(rows_of(batches), lambda r: len(r[2]) // 2):
            words = [np.frombuffer(w, np.uint64) for *_, w in lot]
            codes, each = np.concatenate(words), np.array([len(w) for w in words])
            off = np.cumsum(each) - each
            count = each - window + 1
            run = np.repeat(np.arange(len(lot)), count)
            local = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
            at = local + off[run]
            rid, p = (np.array([r[k] for r in lot], np.int64)[run] for k in (0, 1))
            yield np.lib.stride_tricks.sliding_window_view(codes, window)[at], rid, p + local, [gram_hashes(codes, k)[at] for k in cuts]

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"words": pa.int32(), "prefix": pa.int64(), "n": pa.int64()}
        for *_, hashes in suffixes(batches):
            for k, h in zip(cuts, hashes, strict=True):
                prefix, n = np.unique(h, return_counts=True)
                yield batch({"words": np.full(len(n), k, np.int32), "prefix": prefix.view(np.int64), "n": n}, types)

    one_in = max(1, asked.count() // SAMPLE)
    counts = runs.filter(F.pmod(F.xxhash64("rid"), F.lit(one_in)) == 0).mapInArrow(steady(sampled), "words int, prefix long, n long").groupBy("words", "prefix").agg(F.sum("n").alias("n"))
    counts = stage(counts.filter("n > 1"))
    many = counts.filter(F.col("words") == cuts[0]).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * share
    # No more than 1 / share prefixes of each length can be so frequent.
    frequent = counts.filter(F.col("n") > max(many, 1)).select("words", "prefix").toArrow()
    often = {k: np.sort(frequent["prefix"].to_numpy()[frequent["words"].to_numpy() == k].view(np.uint64)) for k in cuts}

    def placed(wave: int | None):
        """Suffixes of a wave with their prefixes; or those whose whole window is frequent."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for words, rid, p, hashes in suffixes(batches):
                place, deeper = hashes[0], np.ones(len(p), bool)
                for k, h in zip(cuts, (*hashes[1:], None), strict=True):
                    deeper &= np.isin(place, often[k]) if len(often[k]) else False
                    place = place if h is None else np.where(deeper, h, place)
                mine = deeper if wave is None else ~deeper & (place % np.uint64(WAVES) == np.uint64(wave))
                if mine.any():
                    columns = [pa.array(place[mine].view(np.int64)), binaries(np.full(int(mine.sum()), 8 * window), words[mine]), pa.array(rid[mine]), pa.array(p[mine].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, names=["place", "words", "rid", "p"])

        return runs.mapInArrow(steady(run), "place long, words binary, rid long, p int")

    removed = marked.filter("gone").select("rid", F.col("s").cast("long").alias("a"), (F.col("s") + F.col("n") + (window - 1)).cast("long").alias("e"))
    for wave in range(WAVES):
        groups = placed(wave).repartition(spread(docs), "place").select("words", "rid", "p").sortWithinPartitions("words", "rid")
        removed = removed.union(stage(groups.mapInArrow(steady(_trees(window)), _SPANS_SQL)))
    if len(often[window]):
        nodes = stage(placed(None).select("words", "rid", "p"))
        # As many rows as there are frequent windows: no more than 1 / share.
        least = nodes.groupBy("words").agg(F.min("rid").alias("least"))
        whole = nodes.join(F.broadcast(least), "words").filter("rid > least")
        removed = removed.union(whole.select("rid", F.col("p").cast("long").alias("a"), (F.col("p") + window).cast("long").alias("e")))
    return table.drop("spans").join(removed.groupBy("rid").agg(F.collect_list(F.struct("a", "e")).alias("spans")).hint("merge"), "rid", "left")


def drop_repeated_passages(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", digests: bool = False, gram: int = GRAM, share: float = SHARE) -> DataFrame:
    """One row for each row of ``docs``, without each word covered by a ``window``-word sequence that also starts in a document with a smaller id.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; a null text has none.
    Windows are judged on the input.  Returns doc_id, n_words, n_removed and
    ``kept`` (the kept words joined by one space) or ``kept_sha256`` with
    ``digests``.  Null ids come after all others; among equal or null ids the
    earlier row counts as the smaller one.  Texts shorter than a window stay whole; an empty table gives no
    rows.  Columns other than the two are not read.
    """
    from quillspark.llm.string_dedup import merged

    rows = keyed(docs, doc_id, text)
    bodies = rows.select("rid", F.col("text").cast("binary").alias("body"))
    found = repeated_words(bodies, window, gram, share=share)
    if not digests:  # the texts of settled documents come back
        found = found.join(bodies.withColumnRenamed("body", "whole"), "rid")
    else:
        found = found.withColumn("whole", F.lit(None).cast("binary"))
    last = ("kept_sha256", pa.string()) if digests else ("kept", pa.string())
    types = {"rid": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), last[0]: last[1]}

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for lot in lots(rows_of(batches), lambda r: r[1]):
            out = []
            for rid, n, sha, body, spans, whole in lot:
                runs, at, kept = merged(spans), 0, []
                words = unpack(body).split() if body is not None else (whole or b"").split()
                for a, e in runs:
                    kept += words[at:a]
                    at = e
                rest = b" ".join(kept + words[at:])
                out.append((rid, n, sum(e - a for a, e in runs), (sha or hashlib.sha256(rest).hexdigest()) if digests else rest.decode()))
            yield batch(dict(zip(types, zip(*out, strict=True), strict=True)), types)

    done = found.select("rid", "n_words", "sha", "body", "spans", "whole").mapInArrow(steady(keep), f"rid long, n_words long, n_removed long, {last[0]} string")
    return done.join(rows.select("rid", "doc_id"), "rid").select("doc_id", "n_words", "n_removed", last[0])


#: The rows of the query by all windows.
ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS p, ws FROM w WHERE len(ws) >= 13),
h AS (SELECT doc_id, p, array_to_string(ws[p : p + 12], ' ') AS words FROM g),
hit AS (SELECT doc_id, p FROM h QUALIFY min(doc_id) OVER (PARTITION BY words) < doc_id),
gone AS (SELECT doc_id, list(DISTINCT q) AS qs FROM (SELECT doc_id, unnest(range(p, p + 13)) AS q FROM hit) GROUP BY doc_id),
kept AS (SELECT w.doc_id, len(ws) AS n_words, coalesce(len(qs), 0) AS n_removed, array_to_string(list_filter(ws, lambda x, i: NOT list_contains(coalesce(qs, []), i)), ' ') AS kept FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id)
SELECT doc_id, n_words, n_removed, sha256(kept) AS kept_sha256 FROM kept
"""


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_repeated_passages(docs, digests=True)
