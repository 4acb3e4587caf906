"""Postings as blocks: what goes in comes out, and an index takes little disk."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.operators import text_index


@pytest.mark.parametrize("chunk", [1, 3, 1 << 17])
def test_numbers_of_blocks_come_back(monkeypatch, chunk):
    monkeypatch.setattr(text_index, "CHUNK", chunk)
    rng = np.random.default_rng(2)
    code, ords = np.divmod(np.sort(rng.choice(40 * 300, 900, replace=False)), 300)
    sizes = rng.integers(1, 5, 900)
    places = np.concatenate([np.sort(rng.choice(10 ** rng.integers(1, 9), n)) for n in sizes])
    made = list(text_index._word_blocks(code, ords, sizes, places))
    data = pa.concat_arrays([x for _, _, x in made])
    batch = pa.RecordBatch.from_arrays([pa.array(np.full(len(data), 6)), pa.array(np.concatenate([d for _, d, _ in made]), pa.int32()), data], names=["seg", "docs", "data"])
    for part, off in ((batch, 0), (batch.slice(7), 7)):
        block, *got = text_index._postings_in(part, {})
        some = code >= np.unique(code)[off]
        assert np.array_equal(np.unique(code)[off:][block], code[some]) and np.array_equal(got[0], ords[some]) and np.array_equal(got[1], sizes[some])
        assert np.array_equal(got[2], places[np.repeat(some, sizes)])
    ids = np.array([5, -3, 2**63 - 1, -(2**63), 0])
    row = pa.RecordBatch.from_arrays([pa.array([6]), pa.array([5], pa.int32()), text_index._document_data(np.array([0, 2, 3, 7, 32767]), ids, np.array([0, 1, 2**31 - 1, 5, 128]))], names=["seg", "docs", "data"])
    _, ords, got, lens = text_index._documents_in(row, {6: b"\x04"})
    assert ords.tolist() == [0, 3, 7, 32767] and got.tolist() == ids[[0, 2, 3, 4]].tolist() and lens.tolist() == [0, 2**31 - 1, 5, 128]


def test_null_and_repeated_ids_and_small_segments(spark, tmp_path, monkeypatch):
    """Rows without an id, equal rows in two tasks, and segments of three documents."""
    rows = [(None, "a b"), (None, "a"), (1, "a a c"), (1, "a a c"), (2, None), (3, "b")] + [(k, f"a w{k % 3}") for k in range(10, 31)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    want = sorted((r.term, r.id or -1, r.len, tuple(r.positions)) for r in text_index.positions_of(docs, "doc_id", "text").collect())
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        index = text_index.TextIndex.build(spark, f"{tmp_path}/a", docs)
        said = lambda i: sorted((r.term, r.id or -1, r.len, tuple(r.positions)) for r in i.postings().collect())
        assert said(index) == want
        index.apply(spark.createDataFrame([(11, "new b")], "doc_id long, text string"), spark.createDataFrame([(1,), (12,), (13,)], "doc_id long"))
        want = sorted([x for x in want if x[1] not in (1, 11, 12, 13)] + [("new", 11, 2, (0,)), ("b", 11, 2, (1,))])
        merged = index.compacted(f"{tmp_path}/b")
        assert said(index) == said(merged) == want
        count = {w: sum(x[0] == w for x in want) for w in {x[0] for x in want}}
        assert {r.term: r.df for r in index.frequencies().collect()} == {r.term: r.df for r in merged.frequencies().collect()} == count
        assert merged._read("stats", text_index.STATS).first()[1:] == (len(rows) - 4, sum(len((t or "").split()) for k, t in rows if k not in (1, 11, 12, 13)) + 2)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)


def test_an_index_takes_few_bytes_a_posting(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").coalesce(1)
    text_index.TextIndex.build(spark, f"file://{tmp_path}/a", docs)
    size = sum(f.stat().st_size for f in (tmp_path / "a").rglob("*.parquet"))
    text = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    assert size < text * 0.9, (size, text)
