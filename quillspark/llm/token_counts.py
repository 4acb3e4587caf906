"""Token counts of sections, from one encoding of the whole document.

A document is encoded once.  The tokens' byte lengths give their spans, and
an ordered interval join lays the spans over the sections.  A token that
crosses a section's edge is allotted by an explicit rule, so the sections'
counts always add up to the document's.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T

from quillspark.llm.common import position

#: first: the section of the token's first character; last: of its last one;
#: most: the section that holds most of its characters, the earlier of equals.
RULES = ("first", "last", "most")
#: Splits a text into sections: each line with its line end is one.
SECTION_END = "\n"


@functools.lru_cache(maxsize=2)
def _coder(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines())}
    lengths = np.zeros(max(table.values()) + 1, np.int64)
    lengths[list(table.values())] = [len(t) for t in table]
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={}), lengths


def token_spans(text: str, coder, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, and first and past-the-last character of each token.

    Tokens are byte strings; one that starts or ends inside a character
    counts as covering that character.
    """
    ids = np.asarray(coder.encode_ordinary(text), np.int64)
    ends = np.cumsum(lengths[ids])
    starts = ends - lengths[ids]
    if text.isascii():
        return ids, starts, ends
    body = np.frombuffer(text.encode("utf-8"), np.uint8)
    seen = np.concatenate([[0], np.cumsum((body & 0xC0) != 0x80)])  # characters begun before each byte
    opens = np.concatenate([(body & 0xC0) != 0x80, [True]])
    return ids, np.where(opens[starts], seen[starts], seen[starts] - 1), seen[ends]


def section_edges(text: str, end: str = SECTION_END) -> np.ndarray:
    """Past-the-last character of each section; an empty text has none."""
    edges, at = [], text.find(end)
    while at >= 0:
        edges.append(at + len(end))
        at = text.find(end, at + len(end))
    if text and (not edges or edges[-1] < len(text)):
        edges.append(len(text))
    return np.array(edges, np.int64)


def attribute(starts: np.ndarray, ends: np.ndarray, edges: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token by the rule, and whether it crosses an edge."""
    first, last = np.searchsorted(edges, starts, side="right"), np.searchsorted(edges, np.maximum(ends - 1, starts), side="right")
    crosses = first != last
    if rule == "first" or not crosses.any():
        return first, crosses
    if rule == "last":
        return last, crosses
    out = first.copy()
    for k in np.flatnonzero(crosses):
        at = np.arange(first[k], last[k] + 1)
        lo = np.maximum(np.concatenate([[0], edges])[at], starts[k])
        out[k] = at[int(np.argmax(np.minimum(edges[at], ends[k]) - lo))]
    return out, crosses


def count_tokens(docs: DataFrame, ranks_path: str, pattern: str, rule: str = "first", text: str = "text", end: str = SECTION_END) -> DataFrame:
    """All columns of ``docs`` and n_tokens, n_sections, n_crossing, section_tokens (array of long).

    ``section_tokens`` has one count for each section and adds up to
    ``n_tokens``.  A null or empty text has no sections and no tokens.  Input
    columns of these names are replaced.  No shuffle; the rank file is read
    once and broadcast, its size does not depend on the data.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    with open(ranks_path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    made = [("n_tokens", T.LongType()), ("n_sections", T.LongType()), ("n_crossing", T.LongType()), ("section_tokens", T.ArrayType(T.LongType()))]
    new = {n for n, _ in made}
    at = position(docs, text)
    kept = [k for k, c in enumerate(docs.columns) if c.lower() not in new]
    names = [docs.columns[k] for k in kept] + [n for n, _ in made]
    schema = T.StructType([*(docs.schema[k] for k in kept), *(T.StructField(n, kind) for n, kind in made)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, lengths = _coder(ranks.value, pattern)
        for b in batches:
            rows = []
            for value in b.column(at):
                body = value.as_py() or ""
                ids, starts, ends = token_spans(body, coder, lengths)
                edges = section_edges(body, end)
                section, crosses = attribute(starts, ends, edges, rule)
                rows.append((len(ids), len(edges), int(crosses.sum()), np.bincount(section, minlength=len(edges))))
            cols = [*zip(*rows, strict=True)] if rows else [[], [], [], []]
            arrays = [pa.array(c, pa.int64()) for c in cols[:3]] + [pa.array([x.tolist() for x in cols[3]], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), *arrays], names=names)

    return docs.mapInArrow(run, schema)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.drop("text")
