"""Routing of fixed-length windows by their anchors.

A window's anchor is the least hash among the grams it holds, so equal
windows have equal anchors, wherever they lie.  Neighbouring windows mostly
share theirs, and a run of such windows is one segment.  Windows that occur
twice lie in segments whose anchors occur twice; all else is settled without
another look.  Symbols are 64-bit numbers: bytes, or hashes of words.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from quillspark.llm.common import spread, stage

#: Symbols worked on at a time; running sums over so many stay in a processor's cache.
LOT = 1 << 17
#: Rows of a batch that are Python objects at a time.
ROWS = 256
#: Bytes from which a word has a hash of its own kind: sums of powers modulo 2**64 can be made to collide for long words.
LONG = 32
#: Bytes of text whose anchors make one fragment, and anchors packed at a time in a task.
FRAGMENT, PACK = 1 << 24, 1 << 20
#: Segments of anchors known to be repeated in a row, places they go on by, and the bit of a number of windows that marks an anchor whose segments went.
DIRECT, SPREAD, TOLD = 1 << 16, 1 << 20, 1 << 31
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _table(base: int, n: int) -> np.ndarray:
    got = _powers.get(base)
    if got is None or len(got) < n:
        got = _powers[base] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, LOT), base, np.uint64))])
    return got[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers evenly, one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_hashes(symbols: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of the k symbols from each position on."""
    n = len(symbols)
    if n < k:
        return np.zeros(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((symbols + np.uint64(1)) * _table(_BASE, n))])
    return mixed((sums[k:] - sums[:-k]) * _table(_INVERSE, n - k + 1))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_codes(bodies: list[bytes]) -> list[np.ndarray]:
    """64-bit numbers of the words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 texts, all at once from running sums over their bytes; long words from xxh3."""
    if not bodies:
        return []
    blob = np.frombuffer(b" ".join([*bodies, b""]), np.uint8)
    n = len(blob)
    space = _SPACE[blob]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    ends = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((blob.astype(np.uint64) + np.uint64(1)) * _table(_BASE, n))])
    codes = mixed((sums[ends] - sums[starts]) * _table(_INVERSE, n)[starts] + (ends - starts).astype(np.uint64))
    for k in np.flatnonzero(ends - starts >= LONG):
        codes[k] = xxhash.xxh3_64_intdigest(blob[starts[k] : ends[k]])
    edges = np.searchsorted(starts, np.cumsum([len(b) + 1 for b in bodies]))
    return np.split(codes, edges[:-1])


def least_of_next(h: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours."""
    span = 1
    while span * 2 <= w:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return h if span == w else np.minimum(h[: len(h) - (w - span)], h[w - span :])


def segments(docs: list[np.ndarray], gram: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each run of windows with one anchor: number of the document, first window, number of windows, anchor, is it met twice inside."""
    lens = np.array([len(d) for d in docs], np.int64)
    counts = np.maximum(lens - window + 1, 0)
    if not counts.sum():
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(bool)
    # The place modulo 256 rides along in the low bits, once rising and once falling: both agree where a window's least gram is the only one.
    hashes = gram_hashes(np.concatenate(docs).astype(np.uint64), gram) & ~np.uint64(255)
    place = np.arange(len(hashes)).astype(np.uint8).astype(np.uint64)
    low = least_of_next(hashes | place, window - gram + 1)
    other = least_of_next(hashes | (np.uint64(255) - place), window - gram + 1)
    offs = np.cumsum(lens) - lens
    doc = np.repeat(np.arange(len(docs)), counts)
    local = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    low, other = low[local + offs[doc]], other[local + offs[doc]]
    new_doc = doc[1:] != doc[:-1]
    first = np.flatnonzero(np.concatenate([[True], (low[1:] >> np.uint64(8) != low[:-1] >> np.uint64(8)) | new_doc]))
    again = (low & np.uint64(255)) != (np.uint64(255) - (other & np.uint64(255)))
    again[1:] |= low[1:] != low[:-1]
    again[first] = (low[first] & np.uint64(255)) != (np.uint64(255) - (other[first] & np.uint64(255)))
    return doc[first], local[first], np.diff(np.append(first, len(doc))), low[first] >> np.uint64(8), np.logical_or.reduceat(again, first)


def lots(items: Iterable, size: Callable) -> Iterator[list]:
    lot, held = [], 0
    for item in items:
        lot.append(item)
        held += size(item)
        if held >= LOT:
            yield lot
            lot, held = [], 0
    if lot:
        yield lot


def _give_back() -> None:
    """Returns freed memory to the system: a worker lives on between tasks, and others work beside it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def steady(run: Callable) -> Callable:
    """A batch function that runs without the garbage collector: its many short lists hold no cycles."""

    @functools.wraps(run)
    def wrapped(batches):
        gc.disable()
        try:
            yield from run(batches)
        finally:
            gc.enable()
            _give_back()

    return wrapped


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples, a few at a time."""
    for b in batches:
        for k in range(0, b.num_rows, ROWS):
            yield from zip(*(c.slice(k, ROWS).to_pylist() for c in b.columns), strict=True)


def batch(arrays: dict, types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(arrays[n], t) for n, t in types.items()], names=list(types))


def planes(a: np.ndarray) -> bytes:
    """The numbers' bytes by place, so that those that are always zero take no room once compressed."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes()


def unplaned(b: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(width, -1).T).view(kind).ravel()


def binaries(sizes: np.ndarray, data: np.ndarray) -> pa.Array:
    """Pieces of ``data`` of so many bytes."""
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])


def repeated_spans(docs: DataFrame, symbols: Callable[[list[bytes]], list[np.ndarray]], gram: int, window: int, pack: int = PACK) -> DataFrame:
    """(rid, body) -> (rid, spans): the segments whose anchor occurs more than once anywhere.

    The range of anchors is cut into fragments of about FRAGMENT bytes of
    text each.  A task sends each fragment its anchors, packed; the fragment
    tells which occur more than once.  What occurs twice among the anchors
    that a task packs at a time is known to be repeated there and then: its
    segments go on by a place that has nothing to do with the anchor, and the
    fragment is sent one mark.  So an anchor that is in every document brings
    a fragment one entry for each pack, not one for each document.
    """
    total = docs.agg(F.coalesce(F.sum(F.octet_length("body").cast("long")), F.lit(0))).first()[0]
    cuts = max(spread(docs), total // FRAGMENT + 1)
    edges = np.array([k * (1 << 56) // cuts for k in range(cuts)], np.uint64)
    types = {"fragment": pa.int32(), "keys": pa.binary(), "owner": pa.binary(), "rids": pa.binary(), "s": pa.binary(), "n": pa.binary()}

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packs(key, rid, s, n, at, first) -> list[tuple]:
            out = []
            for k, (a, e) in enumerate(zip(at, at[1:], strict=False)):
                if a < e:
                    rids, owner = np.unique(rid[a:e], return_inverse=True)
                    out.append((first + k, planes(np.diff(key[a:e], prepend=np.uint64(0))), planes(owner.astype(np.uint32)), rids.tobytes(), planes(s[a:e]), planes(n[a:e])))
            return out

        def rows(held: list[tuple]) -> Iterator[pa.RecordBatch]:
            key, rid, s, n = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.argsort(key, kind="stable")
            key, rid, s, n = key[order], rid[order], s[order], n[order]
            same = key[1:] == key[:-1]
            known = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            head = known & ~np.concatenate([[False], same])
            # A head stays with its fragment, marked as met twice and as told already; the rest of a known anchor goes on.
            n[head] |= np.uint32(TOLD)
            out = packs(*(c[~known | head] for c in (key, rid, s, n)), np.append(np.searchsorted(key[~known | head], edges), int((~known | head).sum())), 0)
            if known.any():
                gone = np.flatnonzero(known)
                n[head] &= np.uint32(~TOLD & 0xFFFFFFFF)
                parts = np.append(np.arange(0, len(gone), DIRECT), len(gone))
                out += packs(*(c[gone] for c in (key, rid, s, n)), parts, cuts + int(rid[gone[0]] % SPREAD))
            for k in range(0, len(out), 64):
                yield batch(dict(zip(types, zip(*out[k : k + 64], strict=True), strict=True)), types)

        held, size = [], 0
        for lot in lots(rows_of(batches), lambda r: len(r[1])):
            doc, s, n, key, twice = segments(symbols([b for _, b in lot]), gram, window)
            held.append((key, np.array([r for r, _ in lot], np.int64)[doc], s.astype(np.uint32), (n.astype(np.uint32) << np.uint32(1)) | twice.astype(np.uint32)))
            size += len(key)
            if size >= pack:
                yield from rows(held)
                held, size = [], 0
        if size:
            yield from rows(held)

    told = {"rid": pa.int64(), "at": pa.int64(), "key": pa.int64()}

    def met(parts: list[tuple]) -> pa.RecordBatch:
        key = np.concatenate([np.cumsum(unplaned(p[1], np.uint64), dtype=np.uint64) for p in parts])
        rid = np.concatenate([np.frombuffer(p[3], np.int64)[unplaned(p[2], np.uint32)] for p in parts])
        s, n = (np.concatenate([unplaned(p[c], np.uint32) for p in parts]) for c in (4, 5))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        often = np.zeros(len(key), bool)
        often[order] = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        told_already = (n & np.uint32(TOLD)) != 0
        # A head that is marked makes the others of its anchor repeated, but is itself known.
        often |= (n & np.uint32(1)).astype(bool)
        often &= ~told_already
        n = n & np.uint32(~TOLD & 0xFFFFFFFF)
        return spans_of(rid[often], s[often], n[often], key[often])

    def spans_of(rid, s, n, key) -> pa.RecordBatch:
        # First window, number of windows and the mark travel in one long.
        return batch({"rid": rid, "at": (s.astype(np.int64) << 32) | n, "key": key.view(np.int64)}, told)

    def unpacked(p: tuple) -> tuple:
        return np.frombuffer(p[3], np.int64)[unplaned(p[2], np.uint32)], unplaned(p[4], np.uint32), unplaned(p[5], np.uint32), np.cumsum(unplaned(p[1], np.uint64), dtype=np.uint64)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        for row in rows_of(batches):
            if row[0] >= cuts:
                yield spans_of(*unpacked(row))
                continue
            if parts and row[0] != parts[0][0]:
                yield met(parts)
                parts = []
            parts.append(row)
        if parts:
            yield met(parts)

    dealt = docs.select("rid", "body").mapInArrow(steady(packed), "fragment int, keys binary, owner binary, rids binary, s binary, n binary").repartition(spread(docs), "fragment").sortWithinPartitions("fragment")
    spans = stage(dealt.mapInArrow(steady(joined), "rid long, at long, key long"))
    at = F.col("at")
    span = F.struct(F.shiftright(at, 32).cast("int").alias("s"), F.shiftright(at, 1).bitwiseAND(F.lit((1 << 31) - 1)).cast("int").alias("n"), "key", (at.bitwiseAND(F.lit(1)) == 1).alias("twice"))
    return spans.groupBy("rid").agg(F.collect_list(span).alias("spans"))
