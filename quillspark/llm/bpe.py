"""BPE encoding and decoding by forced-boundary splitting.

A pair of neighbouring bytes that occurs inside no token of the vocabulary
can never be joined by a merge, so the merges left and right of it are
independent.  Each pre-token is cut at all such pairs, the fragments are
encoded on their own, and their ids are concatenated.  Fragments repeat far
more often than words, so a bounded memo of fragments and one of
white-space-free chunks carry nearly all of the work.

Normalisation, pre-tokenisation and special tokens follow the tokenizer
file; only the merges are done here.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, types as T

from quillspark.llm.common import position

#: Entries held in each memo of a worker, of MEMO_CHARS characters at the most; a full memo is emptied.
MEMO = 200_000
#: Chunks longer than this are not remembered.
MEMO_CHARS = 64
#: Fragments of so many symbols are merged as rows of a matrix, longer ones with a heap.
SHORT = 48
NEVER = 1 << 60
WIDE = 1 << 24
#: Characters split and encoded at a time.
LOT = 1 << 21

#: Beyond Latin letters, and what Python alone takes for white space.
BEYOND_LATIN = re.compile("[^\\x00-\\x1b\\x20-\\u024f]")

#: The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 as it is, the rest from U+0100 on.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_OTHERS = [b for b in range(256) if b not in _PRINTED]
BYTES = [chr(b) if b in _PRINTED else chr(0x100 + _OTHERS.index(b)) for b in range(256)]


class ForcedBoundaryBPE:
    """Encoder and decoder of one tokenizer file (its JSON text)."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        data = json.loads(spec)
        model = data["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.tokens = {i: t for t, i in self.vocab.items()} | {x["id"]: x["content"] for x in data["added_tokens"]}
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.find_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        merges = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.ranks = {(a, b): k for k, (a, b) in enumerate(merges)}
        pairs = sorted((self.vocab[a] * WIDE + self.vocab[b], k) for (a, b), k in self.ranks.items())
        self.codes, self.code_ranks = (np.array([p[i] for p in pairs], np.int64) for i in (0, 1))
        self.made = np.array([self.vocab[a + b] for a, b in self.ranks], np.int64)
        joined: set[str] = set()
        for token in self.vocab:
            body = token.removesuffix(self.end) if self.end else token
            joined.update(map("".join, zip(body, body[1:], strict=False)))
        self.joined = joined
        rules = Tokenizer.from_str(json.dumps(data | {"model": model | {"vocab": {"a": 0}, "merges": []}, "added_tokens": []}))
        self.normalizer, self.pre_tokenizer = rules.normalizer, rules.pre_tokenizer
        self.fragments: dict[tuple[str, bool], tuple[int, ...]] = {}
        self.chunks: dict[str | tuple, tuple[int, bytes, str]] = {}
        self.simple = None
        splits = [x for x in (data.get("pre_tokenizer") or {}).get("pretokenizers", []) if x["type"] == "Split"]
        steps = [x["type"] for x in (data.get("normalizer") or {}).get("normalizers", [])]
        if steps == ["NFC", "Replace", "Lowercase"] and len(splits) == 1 and splits[0]["behavior"] == "Removed":
            self.simple = regex.compile(splits[0]["pattern"]["Regex"].replace(r"[^\s", r"[^\t-\r \x85\xa0")).findall

    def cut(self, piece: str) -> list[str]:
        """Fragments between the neighbouring symbols that no token holds."""
        joined, out, start = self.joined, [], 0
        for k in range(1, len(piece)):
            if piece[k - 1 : k + 1] not in joined:
                out.append(piece[start:k])
                start = k
        out.append(piece[start:])
        return out

    def _start(self, fragment: str, last: bool) -> list[int]:
        """The vocabulary's numbers of the single symbols; -1 for one that it lacks."""
        ids = [self.vocab.get(s, -1) for s in fragment]
        if last and self.end:
            ids[-1] = self.vocab.get(fragment[-1] + self.end, -1)
        return ids

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; NEVER where no merge joins them."""
        codes = a.astype(np.int64) * WIDE + b
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where((self.codes[at] == codes) & (a >= 0) & (b >= 0), self.code_ranks[at], NEVER)

    def merge_many(self, fragments: list[tuple[str, bool]]) -> list[tuple[int, ...]]:
        """Ids of each fragment: its pair of lowest rank is joined, the leftmost among equals, until none is left.

        Fragments of one length are rows of a matrix; each round joins one
        pair in every row that still has one.
        """
        out: list[tuple[int, ...]] = [()] * len(fragments)
        of_length: dict[int, list[int]] = {}
        for k, (text, last) in enumerate(fragments):
            if len(text) > SHORT or not len(self.codes):
                out[k] = self.merge_long(text, last)
            else:
                of_length.setdefault(len(text), []).append(k)
        for rows in of_length.values():
            ids, at = np.array([self._start(*fragments[k]) for k in rows], np.int64), np.array(rows)
            rank = self._rank(ids[:, :-1], ids[:, 1:])
            while len(at):
                width = ids.shape[1]
                best = rank.argmin(1) if width > 1 else np.zeros(len(at), np.int64)
                least = rank[np.arange(len(at)), best] if width > 1 else np.full(len(at), NEVER)
                done = least == NEVER
                for k, row in zip(at[done].tolist(), ids[done].tolist(), strict=True):
                    out[k] = tuple([i for i in row if i >= 0])
                live = ~done
                ids, at, best, least, rank = ids[live], at[live], best[live], least[live], rank[live]
                if not len(at):
                    break
                here, columns = np.arange(len(at)), np.arange(width - 1)
                ids[here, best] = self.made[least]
                ids = np.take_along_axis(ids, columns + (columns > best[:, None]), 1)
                columns = columns[:-1]
                rank = np.take_along_axis(rank, columns + (columns >= best[:, None]), 1)
                inner = best > 0
                r, k = here[inner], best[inner]
                rank[r, k - 1] = self._rank(ids[r, k - 1], ids[r, k])
                inner = best < width - 2
                r, k = here[inner], best[inner]
                rank[r, k] = self._rank(ids[r, k], ids[r, k + 1])
        return out

    def merge_long(self, fragment: str, last: bool) -> tuple[int, ...]:
        """As merge_many(), for one fragment of any length, with a heap of pairs."""
        symbols: list[str | None] = list(fragment)
        if last and self.end:
            symbols[-1] = fragment[-1] + self.end
        n, ranks = len(symbols), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k, symbols[k], symbols[k + 1]) for k in range(n - 1) if (r := ranks.get((symbols[k], symbols[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, left, right = heapq.heappop(heap)
            j = after[k]
            if symbols[k] != left or j >= n or symbols[j] != right:
                continue
            symbols[k], symbols[j] = left + right, None
            after[k] = after[j]
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b < n and (r := ranks.get((symbols[a], symbols[b]))) is not None:
                    heapq.heappush(heap, (r, a, symbols[a], symbols[b]))
            if after[k] < n:
                before[after[k]] = k
        return tuple([self.vocab[s] for s in symbols if s is not None and s in self.vocab])

    def _pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text, in the byte alphabet, by the rules of the file."""
        text = self.normalizer.normalize_str(text) if self.normalizer else text
        return [p for p, _ in self.pre_tokenizer.pre_tokenize_str(text)] if self.pre_tokenizer else [text]

    def words_ids(self, pieces: list[str]) -> list[list[int]]:
        """Ids of pre-tokens: each is cut, fragments not yet known are merged together, ids are concatenated."""
        cuts = [[(f, False) for f in parts[:-1]] + [(parts[-1], True)] if p else [] for p in pieces for parts in [self.cut(p)]]
        new = list({f for parts in cuts for f in parts if f not in self.fragments})
        made = dict(zip(new, self.merge_many(new), strict=True))
        known = self.fragments
        out = [[i for f in parts for i in (made[f] if f in made else known[f])] for parts in cuts]
        if len(known) + len(made) > MEMO:
            known.clear()
        known.update({k: v for k, v in made.items() if len(k[0]) <= MEMO_CHARS})
        return out

    def parts(self, text: str) -> Iterator[str | int]:
        """The text between special tokens, and the special tokens as ids."""
        at = 0
        if self.find_special and "<" in text:
            for m in self.find_special.finditer(text):
                yield text[at : m.start()]
                yield self.special[m[0]]
                at = m.end()
        yield text[at:]

    def ids(self, text: str) -> list[int]:
        """Ids of a text by the rules of the file, without any memo of words."""
        return [i for part in self.parts(text) for i in ([part] if isinstance(part, int) else [i for w in self.words_ids(self._pieces(part)) for i in w])]

    def decode(self, ids: list[int]) -> str:
        """As a tokenizer file without a decoder says: its tokens, joined by one space."""
        return " ".join([t for i in ids if (t := self.tokens.get(i)) is not None])

    def _packed(self, ids: list[int]) -> tuple[int, bytes, str]:
        return len(ids), pack(f"<{len(ids)}I", *ids), self.decode(ids)

    def _split(self, text: str) -> list[str | tuple[str | int, ...]]:
        """White-space-free chunks of a text, or else its pre-tokens and special tokens in one tuple.

        Texts of Latin letters alone (to U+024F, where each letter is its own
        NFC form) are lower-cased and split here, as no rule of the file looks
        across a blank; for others the rules of the file are called.
        """
        if self.simple and "<|" not in text and not BEYOND_LATIN.search(text):
            return text.lower().split()
        return [tuple(x for part in self.parts(text) for x in ([part] if isinstance(part, int) else self._pieces(part)))]

    def documents(self, texts: Iterable[str]) -> Iterator[tuple[int, bytes, str]]:
        """For each text: number of ids, ids as little-endian unsigned 32-bit integers, decoded text.

        Texts are taken in lots of LOT characters.  A chunk that the memo
        lacks is encoded once, together with the lot's other new chunks.
        """
        lot: list[str] = []
        size = 0
        for text in texts:
            lot.append(text)
            size += len(text)
            if size >= LOT:
                yield from self._lot(lot)
                lot, size = [], 0
        yield from self._lot(lot)

    def _lot(self, texts: list[str]) -> Iterator[tuple[int, bytes, str]]:
        split = [self._split(t) for t in texts]
        if len(self.chunks) > MEMO:
            self.chunks.clear()
        new = list({c for chunks in split for c in chunks}.difference(self.chunks))
        pieces = [["".join([BYTES[b] for b in p.encode()]) for p in self.simple(c)] if isinstance(c, str) else c for c in new]
        words = list({p for ps in pieces for p in ps if isinstance(p, str)})
        ids = dict(zip(words, self.words_ids(words), strict=True))
        for chunk, ps in zip(new, pieces, strict=True):
            self.chunks[chunk] = self._packed(ids[ps[0]] if len(ps) == 1 and ps[0] in ids else [i for p in ps for i in (ids[p] if isinstance(p, str) else [p])])
        for chunks in split:
            n, packed, decoded = zip(*map(self.chunks.__getitem__, chunks), strict=True) if chunks else ((), (), ())
            yield sum(n), b"".join(packed), " ".join(decoded if 0 not in n else [d for k, d in zip(n, decoded, strict=True) if k])
        for chunk in new:
            if not isinstance(chunk, str) or len(chunk) > MEMO_CHARS:
                del self.chunks[chunk]


@functools.lru_cache(maxsize=2)
def _coder(spec: str) -> ForcedBoundaryBPE:
    """One coder for each worker process, so that later tasks find its memos filled."""
    return ForcedBoundaryBPE(spec)


def encode_documents(docs: DataFrame, tokenizer_path: str, text: str = "text", digests: bool = False) -> DataFrame:
    """All columns of ``docs`` and what its whole texts encode to; no shuffle.

    Adds ``n_tokens`` and ``ids`` (array of int) and ``decoded``; with
    ``digests`` instead ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``.
    A null text counts as empty: no ids, an empty decoded text.  Columns of
    the input with one of these names are replaced.
    The tokenizer file is read once on the driver and broadcast: its size
    does not depend on the data.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    pair = [("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())] if digests else [("ids", T.ArrayType(T.IntegerType())), ("decoded", T.StringType())]
    made = [("n_tokens", T.LongType()), *pair]
    new = {n for n, _ in made}
    at = position(docs, text)
    kept = [k for k, c in enumerate(docs.columns) if c.lower() not in new]
    names = [docs.columns[k] for k in kept] + [n for n, _ in made]

    def emitted(batch: pa.RecordBatch, made: list[tuple[int, bytes, str]]) -> pa.RecordBatch:
        counts, packed, decoded = zip(*made, strict=True)
        if digests:
            left = pa.array([hashlib.sha256(x).hexdigest() for x in packed], pa.string())
            right = pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string())
        else:
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            left = pa.ListArray.from_arrays(ends, np.frombuffer(b"".join(packed), "<i4"))
            right = pa.array(decoded, pa.string())
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(counts, pa.int64()), left, right], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(spec.value)
        gc.disable()  # the memos hold no cycles, and walking them takes longer than encoding
        try:
            for batch in batches:
                done, held, made = 0, 0, []
                for row in coder.documents(v.as_py() or "" for v in batch.column(at)):
                    made.append(row)
                    held += len(row[1])
                    if held >= LOT:  # what has been encoded does not wait for the rest of the batch
                        yield emitted(batch.slice(done, len(made)), made)
                        done, held, made = done + len(made), 0, []
                if made:
                    yield emitted(batch.slice(done), made)
        finally:
            gc.enable()

    return docs.mapInArrow(run, T.StructType([*(docs.schema[k] for k in kept), *(T.StructField(n, kind) for n, kind in made)]))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), digests=True)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
