"""Suffix-array dedup: bytes covered by a string that also starts elsewhere.

Windows of the wanted length are routed by their anchors (``anchors``), so
equal windows meet wherever they come from.  Segments that are equal as a
whole are settled by counting.  What is left is grouped by anchor, and each
memory-sized lot of groups is decided by breadth-first interval expansion on
its Burrows-Wheeler transform (``bwt``), stopped at the wanted length.  An
anchor with very many different segments, such as the edge of a passage that
a third of all documents quote, is split: its windows are counted one by one
by 128-bit fingerprints, collapsed within each task before they move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.llm.anchors import batch, lots, repeated_spans, rows_of, steady
from quillspark.llm.bwt import repeated_runs
from quillspark.llm.common import keyed, spread, stage

#: Length of a repeated string, and of the grams whose least hash is the anchor.
LENGTH, GRAM = 200, 100
#: More different segments of one anchor than this are counted window by window.
GROUP = 4000
#: Bytes of segments transformed at a time.
LOT = 1 << 20


def _bytes(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.uint8)


def _symbols(bodies: list[bytes]) -> list[np.ndarray]:
    return [_bytes(b) for b in bodies]


_SPANS = {"rid": pa.int64(), "a": pa.int64(), "e": pa.int64()}
_SPANS_SQL = "rid long, a long, e long"


def _transformed(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(rows: list[tuple]) -> pa.RecordBatch:
            sizes = np.array([len(r[4]) + 1 for r in rows])
            text = _bytes(b"\xff".join([*(r[4] for r in rows), b""])).astype(np.int16)
            text[text == 255] = -1  # a byte that UTF-8 never has
            at = np.sort(repeated_runs(text, length)[0])
            owner = np.repeat(np.arange(len(rows)), sizes)[at]
            # a segment met more often than once is removed as a whole already
            alone = np.array([r[3] == 1 for r in rows])[owner]
            at, owner = at[alone], owner[alone]
            if not len(at):
                return batch({n: [] for n in _SPANS}, _SPANS)
            first = np.flatnonzero(np.concatenate([[True], (np.diff(at) > 1) | (np.diff(owner) > 0)]))
            last = np.append(first[1:], len(at)) - 1
            shift = np.array([r[2] for r in rows], np.int64) - (np.cumsum(sizes) - sizes)
            rid = np.array([r[1] for r in rows], np.int64)
            return batch({"rid": rid[owner[first]], "a": at[first] + shift[owner[first]], "e": at[last] + shift[owner[first]] + length}, _SPANS)

        rows, held, key = [], 0, None
        for row in rows_of(batches):
            if held >= LOT and row[0] != key:
                yield solve(rows)
                rows, held = [], 0
            rows.append(row)
            held += len(row[4])
            key = row[0]
        if rows:
            yield solve(rows)

    return run


def repeated_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """(rid, body binary) -> (rid, n_bytes, sha, body, spans): removed byte ranges [a, e) of each document.

    ``body`` and ``spans`` are null where nothing can be removed, and ``sha``
    is null where something may be.
    """
    spans = repeated_spans(docs, _symbols, gram, length)
    whole_sha = F.sha2(F.col("body"), 256)
    # The one pass that moves all texts; those without a repeated anchor are done after it.
    table = stage(
        docs.join(spans.hint("merge"), "rid", "left").select(
            "rid", F.octet_length("body").cast("long").alias("n_bytes"), F.when(F.col("spans").isNull(), whole_sha).alias("sha"), F.when(F.col("spans").isNotNull(), F.col("body")).alias("body"), "spans"
        )
    )
    held = table.filter("spans is not null").select("rid", "body", "spans")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"rid": pa.int64(), "s": pa.int32(), "n": pa.int32(), "key": pa.int64(), "twice": pa.bool_(), "g": pa.binary()}
        for lot in lots(rows_of(batches), lambda r: len(r[1])):
            rows = [(rid, x["s"], x["n"], x["key"], x["twice"], xxhash.xxh3_128_digest(body[x["s"] : x["s"] + x["n"] + length - 1])) for rid, body, spans in lot for x in spans]
            yield batch(dict(zip(types, zip(*rows, strict=True), strict=True)), types)

    segs = held.mapInArrow(steady(named), "rid long, s int, n int, key long, twice boolean, g binary")
    met = segs.groupBy("g").agg(F.count(F.lit(1)).alias("times"), F.min("rid").alias("rep")).filter("times > 1")
    # weight 2: the copy that stands for equal segments; 0: the other copies
    marked = segs.join(met.hint("merge"), "g", "left").select("rid", "s", "n", "key", "twice", F.when(F.col("times").isNull(), 1).when(F.col("rep") == F.col("rid"), 2).otherwise(0).alias("weight"))
    marked = stage(marked)
    live = marked.filter("weight > 0")
    sizes = live.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.max("twice").alias("twice"))
    sizes = sizes.filter((F.col("m") > 1) | F.col("twice")).select("key", (F.col("m") > group).alias("hot"))
    asked = live.drop("twice").join(sizes.hint("merge"), "key").groupBy("rid").agg(F.collect_list(F.struct("s", "n", "key", "weight", "hot")).alias("asked"))
    asked = stage(held.select("rid", "body").join(asked.hint("merge"), "rid"))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"key": pa.int64(), "rid": pa.int64(), "s": pa.int32(), "weight": pa.int32(), "body": pa.binary()}
        for lot in lots(rows_of(batches), lambda r: len(r[1])):
            rows = [(x["key"], rid, x["s"], x["weight"], body[x["s"] : x["s"] + x["n"] + length - 1]) for rid, body, asked in lot for x in asked if not x["hot"]]
            if rows:
                yield batch(dict(zip(types, zip(*rows, strict=True), strict=True)), types)

    groups = asked.mapInArrow(steady(cut_out), "key long, rid long, s int, weight int, body binary")
    ordered = groups.repartition(spread(docs), "key").sortWithinPartitions("key")
    by_transform = ordered.mapInArrow(steady(_transformed(length)), _SPANS_SQL)

    hot = asked.filter(F.exists("asked", lambda x: x["hot"]))

    def prints(placed: bool):
        types = {"f": pa.binary(), "rid": pa.int64(), "p": pa.int32()} if placed else {"f": pa.binary(), "n": pa.int64()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for lot in lots(rows_of(batches), lambda r: len(r[1])):
                got: dict = {}
                rows = []
                for rid, body, asked in lot:
                    for x in asked:
                        if x["hot"]:
                            for p in range(x["s"], x["s"] + x["n"]):
                                f = xxhash.xxh3_128_digest(body[p : p + length])
                                if not placed:
                                    got[f] = got.get(f, 0) + x["weight"]
                                elif x["weight"] == 1:
                                    rows.append((f, rid, p))
                for at in range(0, len(rows := rows if placed else list(got.items())), 200_000):
                    yield batch(dict(zip(types, zip(*rows[at : at + 200_000], strict=True), strict=True)), types)

        return run

    counted = hot.mapInArrow(steady(prints(False)), "f binary, n long").groupBy("f").agg(F.sum("n").alias("n")).filter("n > 1").select("f")
    by_print = hot.mapInArrow(steady(prints(True)), "f binary, rid long, p int").join(counted.hint("merge"), "f").select("rid", F.col("p").cast("long").alias("a"), (F.col("p") + length).cast("long").alias("e"))
    copies = marked.filter("weight != 1").select("rid", F.col("s").cast("long").alias("a"), (F.col("s") + F.col("n") + (length - 1)).cast("long").alias("e"))
    removed = copies.unionByName(by_transform).unionByName(by_print).groupBy("rid").agg(F.collect_list(F.struct("a", "e")).alias("spans"))
    return table.drop("spans").join(removed.hint("merge"), "rid", "left")


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs that the ranges cover."""
    out: list[list[int]] = []
    for a, e in sorted((x["a"], x["e"]) for x in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([a, e])
    return [tuple(x) for x in out]


def drop_repeated_strings(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", digests: bool = False, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """One row for each row of ``docs``, without each byte covered by a ``length``-byte string that also starts elsewhere.

    Texts are UTF-8 bytes, null is empty, and matches lie inside one document
    (the same one twice included; occurrences may overlap).  Repeats are
    judged on the input.  Returns doc_id, n_bytes, n_removed, n_spans and
    ``kept`` (binary), or ``kept_sha256`` with ``digests``.  Equal rows are
    copies of each other; texts shorter than ``length`` stay whole; an empty
    table gives no rows.  Columns other than the two are not read.
    """
    rows = keyed(docs, doc_id, text)
    bodies = rows.select("rid", F.col("text").cast("binary").alias("body"))
    found = repeated_bytes(bodies, length, gram, group)
    last = ("kept_sha256", pa.string()) if digests else ("kept", pa.binary())
    types = {"rid": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), last[0]: last[1]}

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in lots(rows_of(batches), lambda r: r[1]):
            out = []
            for rid, n, sha, body, spans in lot:
                runs, at, kept = merged(spans), 0, []
                for a, e in runs:
                    kept.append(body[at:a])
                    at = e
                rest = b"".join([*kept, body[at:]]) if body is not None else None
                out.append((rid, n, sum(e - a for a, e in runs), len(runs), (sha or hashlib.sha256(rest).hexdigest()) if digests else rest))
            yield batch(dict(zip(types, zip(*out, strict=True), strict=True)), types)

    done = found.select("rid", "n_bytes", "sha", "body", "spans").mapInArrow(steady(keep), f"rid long, n_bytes long, n_removed long, n_spans long, {last[0]} {'string' if digests else 'binary'}")
    if not digests:
        whole = bodies.join(done.filter("kept is null").select("rid"), "rid", "left_semi").select("rid", F.col("body").alias("text_body"))
        done = done.join(whole, "rid", "left").withColumn("kept", F.coalesce("kept", "text_body")).drop("text_body")
    return done.join(rows.select("rid", "doc_id"), "rid").select("doc_id", "n_bytes", "n_removed", "n_spans", last[0])


#: The rows of the query by all strings of 200 bytes.
ORACLE = """
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
g AS (SELECT doc_id, p, md5(substring(x, 2 * p + 1, 400)) AS h FROM (SELECT doc_id, x, unnest(range(0, n - 199)) AS p FROM d WHERE n >= 200)),
hit AS (SELECT doc_id, p FROM g QUALIFY count(*) OVER (PARTITION BY h) > 1),
s AS (SELECT doc_id, p, coalesce(p > lag(p) OVER w + 200, true) AS fresh FROM hit WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
k AS (SELECT doc_id, p, count(*) FILTER (fresh) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS run FROM s),
r AS (SELECT doc_id, run, min(p) AS a, max(p) + 200 AS b FROM k GROUP BY ALL),
o AS (SELECT doc_id, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed, max(b) AS last FROM r GROUP BY doc_id),
pre AS (SELECT r.doc_id, string_agg(substring(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r) r JOIN d ON d.doc_id = r.doc_id GROUP BY r.doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(CASE WHEN n_spans IS NULL THEN x ELSE pre.kept || substring(x, 2 * last + 1) END)) AS kept_sha256 FROM d LEFT JOIN o ON o.doc_id = d.doc_id LEFT JOIN pre ON pre.doc_id = d.doc_id
"""


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_repeated_strings(docs, digests=True)
