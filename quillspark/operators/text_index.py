"""A positional text index: a base, deltas of changes, and searches that read the asked words' postings only.

Documents are numbered within segments, which are the batches they are read
in.  Postings are rows (term, segment, places in its documents) laid out by a
hash of the term and sorted by it, so a search opens the files of its words
and within them the row groups that hold them.  One row a segment, in a folder
of its own, holds its documents' ids and numbers of words.  A change writes a
delta of the next generation: postings of new texts, and the older documents
that no longer count, as numbers within their segments.  Numbers for ranking
(documents, words) are kept as sums beside each generation, so no search sums
over all documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillspark.functions import scalars as S
from quillspark.operators.similarity import _PHRASE_SQL, _POSTINGS_SQL, B, K1, tokens
from quillspark.plans.registry import query
from quillspark.plans.staging import fresh_path, staged

#: Folders of postings; a search of n words opens n of them at most.
PARTS = 64
#: Most files of a folder and generation.
SLICES = 8

#: Most documents of a segment: as many as Spark's bitmaps have places.
SEGMENT = 32_768

#: Rows of a segment's documents have no term, which no word has, and lie in the folder behind the words'.
POSTINGS = "term string, seg long, docs int, data binary, gen int, part int"
GONE = "seg long, ord int"
STATS = "gen int, docs long, words long"


def _part(term: Column) -> Column:
    return F.when(term == "", PARTS).otherwise(F.pmod(F.xxhash64(term), F.lit(PARTS))).cast("int")


def _counted(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count anew."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _steps(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Differences, but for what stands first in a list."""
    out = np.diff(x, prepend=0)
    out[first] = x[first]
    return out


def _summed(steps: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The lists of ``counts`` numbers each that had these steps."""
    sums, first = np.cumsum(steps), np.cumsum(counts) - counts
    some = counts > 0
    base = np.zeros(len(counts), np.int64)
    base[some] = sums[first[some]] - steps[first[some]]
    return sums - np.repeat(base, counts)


def _packed(counts: list[np.ndarray], sections: list[np.ndarray]) -> pa.Array:
    """One binary a block: of each section as many numbers as the block counts there, in groups of seven bits, the last below 128."""
    starts = np.cumsum(counts, axis=0) - counts + (np.cumsum(sum(counts)) - sum(counts))
    values = np.empty(sum(map(len, sections)), np.uint64)
    for start, count, section in zip(starts, counts, sections, strict=True):
        values[np.repeat(start, count) + _counted(count)] = section.astype(np.int64).view(np.uint64)
    sizes = np.ones(len(values), np.int64)
    for k in range(1, 10):
        sizes += values >= np.uint64(1 << 7 * k)
    ends = np.append(0, np.cumsum(sizes))
    out = np.zeros(ends[-1], np.uint8)
    for k in range(sizes.max(initial=0)):
        some = np.flatnonzero(sizes > k)
        out[ends[some] + k] = ((values[some] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | ((sizes[some] > k + 1).astype(np.uint8) << 7)
    borders = ends[np.append(0, np.cumsum(sum(counts)))].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(borders) - 1, [None, pa.py_buffer(borders), pa.py_buffer(out)])


def _numbers(data: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the blocks, and where each block's begin and the last's end."""
    data = data.cast(pa.binary())
    borders = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1]
    held = np.frombuffer(data.buffers()[2] or b"", np.uint8)[borders[0] : borders[-1]]
    last = np.flatnonzero(held < 128)
    first = np.append(0, last + 1)
    shift = np.arange(len(held)) - np.repeat(first[:-1], np.diff(first))
    values = np.add.reduceat((held & 127).astype(np.uint64) << (7 * shift).astype(np.uint64), first[:-1]) if len(held) else np.empty(0, np.uint64)
    return values.view(np.int64), np.searchsorted(first, borders - borders[0])


def _words_of(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each word of each document of a batch (id, w): the words, and for each posting the word's number, the document's row and its number of places, and all places."""
    words, sizes = batch.column("w"), pc.list_value_length(batch.column("w")).to_numpy()
    said = words.flatten().dictionary_encode()
    order = np.argsort(said.indices.to_numpy(), kind="stable").astype(np.int32)  # documents stay in order within a word, and places within a document
    code = said.indices.to_numpy()[order]
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
    first = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (row[1:] != row[:-1]))[: len(code)])
    places = order - (np.cumsum(sizes) - sizes).astype(np.int32)[row]
    return said.dictionary, code[first], row[first], np.diff(np.append(first, len(code))), places


_BLOCK = ["term", "seg", "docs", "data"]
#: So many postings are packed at a time; a block stays whole.
CHUNK = 1 << 17


def _word_blocks(code: np.ndarray, ords: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """(code of each block, its documents, its data) for postings sorted by code and document, a chunk at a time."""
    begins = np.append(np.flatnonzero(np.append(True, code[1:] != code[:-1])[: len(code)]), len(code))
    place_at = np.append(0, np.cumsum(sizes))
    for cut in np.split(np.arange(len(begins) - 1), np.flatnonzero(np.diff(begins[:-1] // CHUNK)) + 1):
        if len(cut):
            a, b = begins[cut[0]], begins[cut[-1] + 1]
            first, docs = begins[cut] - a, begins[cut + 1] - begins[cut]
            held, own = place_at[begins[cut + 1]] - place_at[begins[cut]], sizes[a:b]
            steps = _steps(places[place_at[a] : place_at[b]].astype(np.int64), np.cumsum(own) - own)
            yield code[begins[cut]], docs, _packed([docs, docs, held], [_steps(ords[a:b].astype(np.int64), first), own, steps])


def _document_data(ords: np.ndarray, ids: np.ndarray, lens: np.ndarray) -> pa.Array:
    """A segment's documents as one block; steps of ids may be negative, so their sign goes to the lowest bit."""
    n, step = np.array([len(ords)]), np.diff(ids, prepend=0)
    return _packed([n, n, n], [_steps(ords, np.array([0])), (step << 1) ^ (step >> 63), lens])


def _segments(gen: int):
    """(id, w) -> blocks: a batch is a segment, named by its place and its ids; rows without an id are a segment of their own, with an odd name."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = [gen, TaskContext.get().partitionId(), 0]
        for whole in batches:
            for part in (whole.slice(k, SEGMENT) for k in range(0, len(whole), SEGMENT)):
                for batch, odd in ((part.filter(part.column("id").is_valid()), 0), (part.filter(part.column("id").is_null()), 1)):
                    if not len(batch):
                        continue
                    ids = np.zeros(len(batch), np.int64) if odd else batch.column("id").to_numpy()
                    place[2] += 1
                    name = hashlib.blake2b(np.array(place).tobytes() + ids.tobytes(), digest_size=8).digest()
                    seg = int.from_bytes(name, "big", signed=True) & ~1 | odd
                    lens = pc.list_value_length(batch.column("w")).to_numpy()
                    yield pa.RecordBatch.from_arrays([pa.array([""]), pa.array([seg]), pa.array([len(ids)], pa.int32()), _document_data(np.arange(len(ids)), ids, lens)], names=_BLOCK)
                    terms, *postings = _words_of(batch)
                    for code, docs, data in _word_blocks(*postings):
                        yield pa.RecordBatch.from_arrays([terms.take(pa.array(code)).cast(pa.string()), pa.array(np.full(len(code), seg)), pa.array(docs, pa.int32()), data], names=_BLOCK)

    return blocks


def _postings_in(batch: pa.RecordBatch, gone: dict[int, bytes]) -> tuple[np.ndarray, ...]:
    """Of blocks of words, for each posting that counts: row in the batch, document's number, places; and all these places."""
    docs = batch.column("docs").to_numpy().astype(np.int64)
    values, at = _numbers(batch.column("data"))
    block, rank = np.repeat(np.arange(len(docs)), docs), _counted(docs)
    ords, sizes = _summed(values[at[block] + rank], docs), values[at[block] + docs[block] + rank]
    held = np.diff(at) - 2 * docs
    places = _summed(values[np.repeat(at[:-1] + 2 * docs, held) + _counted(held)], sizes)
    stays = _living(batch.column("seg").to_numpy(), block, ords, gone)
    return block[stays], ords[stays], sizes[stays], places[np.repeat(stays, sizes)]


def _documents_in(batch: pa.RecordBatch, gone: dict[int, bytes]) -> tuple[np.ndarray, ...]:
    """Of rows of documents, for each document that counts: row in the batch, number, id and words."""
    docs = batch.column("docs").to_numpy().astype(np.int64)
    values, at = _numbers(batch.column("data"))
    block, rank = np.repeat(np.arange(len(docs)), docs), _counted(docs)
    ords, steps, lens = (values[at[block] + k * docs[block] + rank] for k in range(3))
    steps, ords = (steps.view(np.uint64) >> np.uint64(1)).view(np.int64) ^ -(steps & 1), _summed(ords, docs)
    stays = _living(batch.column("seg").to_numpy(), block, ords, gone)
    return block[stays], ords[stays], _summed(steps, docs)[stays], lens[stays]


def _living(segs: np.ndarray, block: np.ndarray, ords: np.ndarray, gone: dict[int, bytes]) -> np.ndarray:
    stays = np.ones(len(ords), bool)
    row_of = segs[block]
    for seg in np.unique(segs):
        if bits := gone.get(int(seg)):
            own = np.flatnonzero(row_of == seg)
            marked = np.zeros(SEGMENT, bool)
            marked[: len(bits) * 8] = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")
            stays[own] = ~marked[ords[own]]
    return stays


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, w) -> (term, id, len, positions): all words of a batch are numbered once and sorted by document and number."""
    for batch in batches:
        words, sizes = batch.column("w"), pc.list_value_length(batch.column("w")).to_numpy()
        said = words.flatten().dictionary_encode()
        if not len(said):
            continue
        row = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        key = row * len(said.dictionary) + said.indices.to_numpy()
        order = np.argsort(key, kind="stable")  # places stay in order within a word
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        row, code = np.divmod(key[first], len(said.dictionary))
        positions = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)), pa.int32()), pa.array(place[order], pa.int32()))
        yield pa.RecordBatch.from_arrays([said.dictionary.take(pa.array(code)), batch.column("id").take(pa.array(row)), pa.array(sizes[row], pa.int32()), positions], names=["term", "id", "len", "positions"])


def positions_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(term, id, len, positions): each word of each document with its places, from 0, and the document's number of words.

    A document's words are grouped inside its batch: the one exchange comes
    when postings are laid out by term.
    """
    words = docs.select(F.col(doc_id).cast("long").alias("id"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("w"))
    return words.mapInArrow(_placed, "term string, id long, len int, positions array<int>")


def n_words(text: Column) -> Column:
    """How many ``tokens`` a text has, without a list of them."""
    return F.regexp_count(S.fold(F.lower(F.coalesce(text, F.lit("")))), F.lit("[\\p{L}\\p{N}]+"))


def _laid_out(rows: DataFrame) -> DataFrame:
    """Postings as they are written: a part is sorted by term, in ``SLICES`` files at most; a word of all documents is spread over these."""
    spread = F.pmod(F.xxhash64("seg"), F.lit(SLICES)).cast("int")
    return rows.repartition("part", spread).sortWithinPartitions("part", "term", "seg")


@dataclass
class TextIndex:
    """Postings under ``path``; a new object sees all generations written so far."""

    spark: SparkSession
    path: str

    @staticmethod
    def build(spark: SparkSession, path: str, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> TextIndex:
        """A base of all rows of ``docs``; null texts hold no words but count as documents."""
        index = TextIndex(spark, path)
        index._write(docs, doc_id, text, 0)
        spark.createDataFrame([], GONE).write.mode("overwrite").parquet(f"{path}/gone")
        return index

    def _read(self, what: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{what}")

    def _write(self, docs: DataFrame, doc_id: str, text: str, gen: int, removed: tuple[int, int] = (0, 0)) -> None:
        mode = "overwrite" if gen == 0 else "append"
        words = docs.select(F.col(doc_id).cast("long").alias("id"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("w"))
        self._put(self.path, words.mapInArrow(_segments(gen), "term string, seg long, docs int, data binary"), gen, mode)
        told = self._documents({}).filter(F.col("gen") == gen).agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("len"), F.lit(0)).alias("words"))
        told.select(F.lit(gen).alias("gen"), (F.col("docs") - removed[0]).cast("long").alias("docs"), (F.col("words") - removed[1]).cast("long").alias("words")).write.mode(mode).parquet(f"{self.path}/stats")

    @staticmethod
    def _put(path: str, blocks: DataFrame, gen: int, mode: str) -> None:
        rows = blocks.withColumn("gen", F.lit(gen)).withColumn("part", _part(F.col("term")))
        _laid_out(rows).write.mode(mode).option("compression", "zstd").partitionBy("part").parquet(f"{path}/postings")

    def _gone(self) -> dict[int, bytes]:
        """The documents that no longer count, as bits by segment: one bit for each document of a segment that has any."""
        marks = self._read("gone", GONE).groupBy("seg").agg(F.bitmap_construct_agg("ord").alias("bits"))
        return {r["seg"]: bytes(r["bits"]).rstrip(b"\0") for r in marks.toLocalIterator()}

    def _documents(self, gone: dict[int, bytes] | None = None) -> DataFrame:
        """(seg, ord, id, len, gen) of the living documents."""
        gone = self._gone() if gone is None else gone

        def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                block, ords, ids, lens = _documents_in(batch, gone)
                seg = batch.column("seg").to_numpy()[block]
                yield pa.RecordBatch.from_arrays([pa.array(seg), pa.array(ords, pa.int32()), pa.array(ids, mask=seg % 2 == 1), pa.array(lens, pa.int32()), batch.column("gen").take(pa.array(block))], names=["seg", "ord", "id", "len", "gen"])

        rows = self._read("postings", POSTINGS).filter(F.col("part") == PARTS).select("seg", "docs", "data", "gen")
        return rows.mapInArrow(documents, "seg long, ord int, id long, len int, gen int")

    def _places(self, words: list[str] | None = None) -> DataFrame:
        """(term, seg, ord, positions) of the living documents."""
        gone, rows = self._gone(), self._read("postings", POSTINGS).filter(F.col("part") < PARTS)
        if words is not None:
            parts = [r[0] for r in self.spark.createDataFrame([(w,) for w in words], "w string").select(_part(F.col("w"))).distinct().collect()]  # as many as the phrase has words
            rows = rows.filter(F.col("part").isin(parts) & F.col("term").isin(words))

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                block, ords, sizes, places = _postings_in(batch, gone)
                positions = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(places, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("term").take(pa.array(block)), batch.column("seg").take(pa.array(block)), pa.array(ords, pa.int32()), positions], names=["term", "seg", "ord", "positions"])

        return rows.select("term", "seg", "docs", "data").mapInArrow(placed, "term string, seg long, ord int, positions array<int>")

    @property
    def generation(self) -> int:
        return self._read("stats", STATS).agg(F.max("gen")).first()[0]

    def apply(self, upserts: DataFrame, deletes: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text") -> None:
        """Puts rows in, in place of those of the same ids, and takes ids out; the ids given must be unique."""
        gen = self.generation + 1
        ids = upserts.select(F.col(doc_id).cast("long").alias("id"))
        if deletes is not None:
            ids = ids.union(deletes.select(F.col(doc_id).cast("long"))).distinct()
        old = staged(self._documents().join(ids, "id", "left_semi").select("seg", "ord", "len"))
        told = old.agg(F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0))).first()
        # The mark last: it names documents of older generations only, so a failure in between loses no text that stays.
        self._write(upserts, doc_id, text, gen, (told[0], told[1]))
        old.select("seg", "ord").write.mode("append").parquet(f"{self.path}/gone")

    def compacted(self, path: str) -> TextIndex:
        """An index elsewhere with the living postings only, as one base; segments keep their names and numbers."""
        out, gone = TextIndex(self.spark, path), self._gone()

        def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                hit = pa.array([s in gone for s in whole.column("seg").to_pylist()])
                yield whole.filter(pc.invert(hit))
                batch = whole.filter(pc.and_(hit, pc.not_equal(whole.column("term"), "")))
                for kept, docs, data in _word_blocks(*_postings_in(batch, gone)):
                    yield pa.RecordBatch.from_arrays([batch.column("term").take(pa.array(kept)), batch.column("seg").take(pa.array(kept)), pa.array(docs, pa.int32()), data], names=_BLOCK)
                rows = whole.filter(pc.and_(hit, pc.equal(whole.column("term"), "")))
                for row in (rows.slice(k, 1) for k in range(len(rows))):
                    _, ords, ids, lens = _documents_in(row, gone)
                    if len(ords):
                        yield pa.RecordBatch.from_arrays([row.column("term"), row.column("seg"), pa.array([len(ords)], pa.int32()), _document_data(ords, ids, lens)], names=_BLOCK)

        blocks = self._read("postings", POSTINGS).select(*_BLOCK).mapInArrow(merged, "term string, seg long, docs int, data binary")
        self._put(path, blocks, 0, "overwrite")
        self._read("stats", STATS).agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")).select(F.lit(0).alias("gen"), "docs", "words").write.mode("overwrite").parquet(f"{path}/stats")
        self.spark.createDataFrame([], GONE).write.mode("overwrite").parquet(f"{path}/gone")
        return out

    def postings(self, words: list[str] | None = None) -> DataFrame:
        """(term, id, len, positions) of the living documents, of some words or all; words are folded already."""
        return self._places(words).join(self._documents(), ["seg", "ord"]).select("term", "id", "len", "positions")

    def frequencies(self) -> DataFrame:
        """(term, df): how many living documents hold each word, from the blocks' counts where no document of a segment is gone."""
        gone = self._gone()

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = np.bincount(_postings_in(batch, gone)[0], minlength=len(batch))
                yield pa.RecordBatch.from_arrays([batch.column("term"), pa.array(n, pa.int64())], names=["term", "n"])

        rows = self._read("postings", POSTINGS).filter(F.col("part") < PARTS)
        if gone:
            rows = rows.select("term", "seg", "docs", "data").mapInArrow(counted, "term string, n long")
        else:
            rows = rows.select("term", F.col("docs").alias("n"))
        return rows.groupBy("term").agg(F.sum("n").alias("df")).filter("df > 0")

    def phrase(self, phrase: str, limit: int = 20) -> DataFrame:
        """(id, score): documents that hold the phrase as consecutive words, best BM25 first; a phrase without words finds nothing."""
        words = self.spark.createDataFrame([(phrase,)], "p string").select(tokens(F.col("p"))).first()[0]
        if not words:
            return self.spark.createDataFrame([], "id long, score double")
        own = list(dict.fromkeys(words))
        rows = self._places(own)
        held = rows.groupBy("seg", "ord").agg(*[F.first(F.when(F.col("term") == w, F.col("positions")), ignorenulls=True).alias(f"p{k}") for k, w in enumerate(own)])
        begins = lambda i: F.transform(f"p{own.index(words[i])}", lambda p: p - i)
        shifted = [begins(i) for i in range(len(words))]
        held = held.select("seg", "ord", F.size(reduce(F.array_intersect, shifted)).alias("tf")).filter("tf > 0")
        stats = self._read("stats", STATS).agg(F.sum("docs").alias("docs"), (F.sum("words") / F.sum("docs")).alias("mean")).first()
        held = staged(held.join(self._documents(), ["seg", "ord"]).select("id", "len", "tf"))
        df = held.count()
        idf = F.log(F.lit(1 + (stats["docs"] - df + 0.5) / (df + 0.5)))
        score = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(float(stats["mean"] or 1))))
        return held.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(limit)

    def keyword(self, docs: DataFrame, word: str, limit: int = 200, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """(id, tier): the phrase search's documents, best first; where it finds none, those that hold ``word`` anywhere in any case, by id.

        The table itself is read in the second case only.
        """
        found = staged(self.phrase(word, limit).select("id"))
        if not found.isEmpty():
            return found.withColumn("tier", F.lit(1))
        if not word.strip():
            return self.spark.createDataFrame([], "id long, tier int")
        held = docs.filter(F.lower(F.col(text)).contains(word.strip().lower())).select(F.col(doc_id).cast("long").alias("id"))
        return held.orderBy("id").limit(limit).withColumn("tier", F.lit(2))


def _changed_index(t, spark) -> TextIndex:
    """An index of all documents that has seen changes: texts replaced, put in and taken out."""
    docs = t("documents").select("doc_id", "text")
    index = TextIndex.build(spark, fresh_path(spark, "text-index"), docs.filter("doc_id % 5 != 1").withColumn("text", F.when(F.col("doc_id") % 5 == 2, "of the old of the text").otherwise(F.col("text"))))
    index.apply(docs.filter("doc_id % 5 < 3 and doc_id % 5 > 0"), docs.filter("doc_id % 5 = 3"))
    index.apply(docs.filter("doc_id % 5 = 3"))
    return index


@query("phrase_index", _PHRASE_SQL)
def phrase_index(t, spark):
    """The phrase search from the postings of its words, after changes."""
    return _changed_index(t, spark).phrase("of the").select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query("postings_index", _POSTINGS_SQL)
def postings_index(t, spark):
    """Documents of every word from a base and its deltas, after they were merged."""
    merged = _changed_index(t, spark).compacted(fresh_path(spark, "text-index"))
    return merged.frequencies().withColumnRenamed("term", "w")


@query("keyword_cascade", """
SELECT 'inside a word' AS asked, doc_id AS id, 2 AS tier FROM (SELECT doc_id FROM documents WHERE contains(lower(text), 'he tha') ORDER BY doc_id LIMIT 200)
UNION ALL SELECT 'nowhere', doc_id, 2 FROM documents WHERE contains(lower(text), 'qqzzqq')""")
def keyword_cascade(t, spark):
    """Index first, then any place in the text: a piece of two words is no phrase, so the second tier answers."""
    docs = t("documents").select("doc_id", "text")
    index = TextIndex.build(spark, fresh_path(spark, "text-index"), docs)
    inside = index.keyword(docs, "he tha").withColumn("asked", F.lit("inside a word"))
    return inside.unionByName(index.keyword(docs, "qqzzqq").withColumn("asked", F.lit("nowhere")))
