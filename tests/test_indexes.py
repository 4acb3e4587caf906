"""The vector and text indexes against scans of everything."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import duplicates, similarity, text_index, vector_index
from quillspark.plans import catalogue

SF = "/root/testdata/sf0.01"


def _brute(ids, x, queries, k, least=-1.0):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in queries:
        s = x @ x[list(ids).index(q)]
        near = sorted(((-s[j], i) for j, i in enumerate(ids) if i != q and s[j] >= least))[:k]
        out[q] = [i for _, i in near]
    return out


def test_recall_of_probed_cells(spark):
    """Recall of the approximate search against all rows, on the given vectors and on clustered ones."""
    want = {(r.a, r.b) for r in catalogue.QUERIES["index_topk"](spark, SF).collect()}
    got = {(r.a, r.b) for r in catalogue.QUERIES["ann_topk"](spark, SF).collect()}
    assert len(got & want) / len(want) >= 0.9
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16))
    x = (centres[rng.integers(0, 20, 2000)] + 0.3 * rng.normal(size=(2000, 16))).astype(np.float32)
    rows = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(x)], "id long, v array<float>")
    index = vector_index.build_index(rows, k=5)
    assert index.probes < len(index.centroids) // 2  # a fraction of the cells is enough where vectors form groups
    queries = list(range(0, 2000, 50))
    brute = _brute(range(2000), x.astype(float), queries, 5)
    for exact, least in ((False, 0.9), (True, 1.0)):
        found = {}
        for r in index.search(rows.filter("id % 50 = 0"), 5, exact=exact).collect():
            found.setdefault(r.a, set()).add(r.b)
        hits = sum(len(found[q] & set(brute[q])) for q in queries)
        assert hits >= least * 5 * len(queries)


def test_pairs_within_reach(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 12))
    x = centres[rng.integers(0, 8, 400)] + 0.2 * rng.normal(size=(400, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(x)] + [(900, [0.0] * 12), (901, None)], "id long, v array<double>")
    s = x @ x.T
    got = {(r.a, r.b) for r in vector_index.build_index(rows).within(rows, 0.97, later_only=True).collect()}
    assert got == {(i, j) for i in range(400) for j in range(i + 1, 400) if s[i, j] >= 0.97} and got


def test_index_edges(spark, tmp_path):
    schema = "id long, v array<float>, kind string"
    rows = spark.createDataFrame([(1, [1.0, 0.0], "x"), (2, [1.0, 0.1], "y"), (3, [0.0, 0.0], "x"), (4, None, "x"), (5, [-1.0, 0.0], "y")], schema)
    index = vector_index.build_index(rows, k=2)
    q = rows.select("id", "v")
    near = lambda i, **o: sorted((r.a, r.b) for r in i.search(q, 2, **o).collect())
    assert near(index, exact=True) == [(1, 2), (1, 5), (2, 1), (2, 5), (5, 1), (5, 2)]
    assert near(index, exact=True, least=0.5) == [(1, 2), (2, 1)]
    assert near(index, exact=True, where="kind = 'y'") == [(1, 2), (1, 5), (2, 5), (5, 2)]
    index.save(f"{tmp_path}/i")
    again = vector_index.VectorIndex.load(spark, f"{tmp_path}/i").with_rows(added=spark.createDataFrame([(2, [0.0, 1.0], "y"), (6, [1.0, 0.0], "z")], schema), removed=spark.createDataFrame([(5,)], "id long"))
    assert near(again, exact=True, least=0.5) == [(1, 6), (2, 1), (2, 6)]
    empty = vector_index.build_index(rows.limit(0))
    assert empty.search(q, 3).count() == empty.search(q, 3, exact=True).count() == 0
    assert index.search(q.limit(0), 3, exact=True).count() == 0


DOCS = "doc_id long, text string"


def test_index_follows_changes(spark, tmp_path):
    """After each change the index says what a new one over the present rows would say, and what a scan finds."""
    rows = {k: f"{'of the ' * (k % 3)}word{k % 4} Élan {k} the of" for k in range(12)} | {20: None, 21: "", 22: "..."}
    frame = lambda r: spark.createDataFrame(list(r.items()), DOCS)
    index = text_index.TextIndex.build(spark, f"{tmp_path}/a", frame(rows))
    changes = [({3: "of the new", 30: "the of the of the"}, [4]), ({4: "back of the book", 3: None}, []), ({}, [0, 1, 999])]
    for upserts, deletes in changes:
        index.apply(frame(upserts) if upserts else spark.createDataFrame([], DOCS), spark.createDataFrame([(d,) for d in deletes], "doc_id long"))
        rows = {k: v for k, v in (rows | upserts).items() if k not in deletes}
        for phrase in ("of the", "the of the", "word1 elan", "nothing like it", " "):
            want = {r.doc_id: round(r.score, 9) for r in similarity.phrase_search(frame({k: v or "" for k, v in rows.items()}), phrase, 100).collect()}
            assert {r.id: round(r.score, 9) for r in index.phrase(phrase, 100).collect()} == want, phrase
    fresh = text_index.TextIndex.build(spark, f"{tmp_path}/b", frame(rows))
    said = lambda i: sorted((r.term, r.id, r.len, tuple(r.positions)) for r in i.postings().collect())
    merged = index.compacted(f"{tmp_path}/c")
    assert said(index) == said(fresh) == said(merged)
    assert [r.id for r in merged.phrase("of the").collect()] == [r.id for r in fresh.phrase("of the").collect()]
    assert [(r.id, r.tier) for r in index.keyword(frame(rows), "elan", 3).collect()][0][1] == 1
    assert {(r.id, r.tier) for r in index.keyword(frame(rows), "ord").collect()} == {(k, 2) for k, v in rows.items() if v and "ord" in v}
    assert index.keyword(frame(rows), "  ").count() == 0


def test_a_search_reads_the_words_files_only(spark, tmp_path):
    index = text_index.TextIndex.build(spark, f"{tmp_path}/a", spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(200))) for k in range(5)], DOCS))
    plan = index.postings(["w7"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan or "PartitionFilters: [(part" in plan or "part#" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert "EqualTo(term,w7)" in plan or "In(term, [w7])" in plan


def test_votes(spark):
    questions = spark.createDataFrame([(1, 1, None), (2, 1, "TH"), (3, 1, "VD"), (4, 1, None), (5, 1, "TH"), (11, 2, "VD"), (12, 2, "VD"), (13, 3, "TH"), (14, 1, "NB"), (15, None, "VDC"), (16, 2, "odd"), (17, 2, None), (18, 2, "NB")], "id long, exam int, difficulty string")
    edges = spark.createDataFrame([
        (1, 11, 0.91), (1, 12, 0.87), (1, 13, 0.84),  # VD with 1.78 of 2.62
        (2, 13, 0.9), (2, 11, 0.74),  # TH wins, but is there already; the other is too far
        (3, 13, 0.99),  # not asked
        (4, 14, 0.99), (4, 15, 0.99), (4, 16, 0.99), (4, 17, 0.99),  # same exam, no exam, unknown, none
        (5, 11, 0.8), (5, 18, 0.8),  # no share of 0.6
        (17, 14, 0.9), (17, 3, 0.9), (17, 999, 0.9),  # a tie of two labels: no share either
    ], "question long, similar long, score double")
    assert [tuple(r) for r in duplicates.voted_updates(questions, edges).collect()] == [(1, None, "VD", 0.679)]
    tie = spark.createDataFrame([(1, 11, 0.9), (1, 13, 0.9)], edges.schema)
    assert [tuple(r) for r in duplicates.voted_updates(questions, tie, share=0.5).collect()] == [(1, None, "VD", 0.5)]
    after = {r.id: r.difficulty for r in duplicates.updated_difficulties(questions, edges).collect()}
    assert after[1] == "VD" and after[2] == "TH" and after[4] is None


def test_groups_after_each_batch(spark):
    """However edges come, the groups are those of all edges so far."""
    rng = np.random.default_rng(3)
    labels, seen = spark.createDataFrame([], "id long, label long"), set()
    for _ in range(4):
        edges = {tuple(sorted(map(int, e))) for e in rng.integers(0, 60, (12, 2)) if e[0] != e[1]}
        seen |= edges
        labels = duplicates.regrouped(labels, spark.createDataFrame(list(edges), "a long, b long"))
        want: dict[int, int] = {k: k for e in seen for k in e}
        for _ in want:
            for a, b in seen:
                want[a] = want[b] = min(want[a], want[b])
        assert {r.id: r.label for r in labels.collect()} == want
    assert {r.id for r in duplicates.regrouped(labels, spark.createDataFrame([(0, 0)], "a long, b long")).collect()} == set(want)


@pytest.mark.parametrize("held", [1_000_000, 0])
def test_clusters_in_one_task_and_in_rounds(spark, held):
    """A chain, a star, a ring, and random edges: both ways give the least id that each reaches."""
    rng = np.random.default_rng(8)
    edges = [(k, k + 1) for k in range(100, 140)] + [(7, k) for k in range(200, 230)] + [(300, 301), (301, 302), (302, 300)] + [(5, 5), (301, 300)] + [tuple(map(int, e)) for e in rng.integers(1000, 1060, (40, 2))]
    want = {k: k for a, b in edges if a != b for k in (a, b)}
    for _ in want:
        for a, b in edges:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    got = [tuple(r) for r in similarity.clusters(spark.createDataFrame(edges, "a long, b long"), held=held).collect()]
    assert dict(got) == want and len(got) == len(want)
    assert similarity.clusters(spark.createDataFrame([], "a long, b long"), held=held).count() == 0


@pytest.mark.parametrize("keys", [["k"], ["k", "j"]])
def test_report_of_duplicates(spark, keys):
    rows = spark.createDataFrame([(1, 5, "x", 1), (2, 3, "x", 1), (3, 4, "y", 1), (4, 9, None, 1), (5, 1, None, 1), (6, 2, "z", 1)], "id long, created int, k string, j int")
    semantic = spark.createDataFrame([(2, 3, 0.91234567), (4, 5, 0.95), (6, 6, 1.0)], "a long, b long, score double")
    got = [tuple(r) for r in duplicates.duplicate_report(rows, keys, semantic).orderBy("place", "pos").collect()]
    assert got == [(1, 1, 3, 1.0, 1, 2, 1.0, True), (1, 1, 3, 1.0, 2, 3, 0.9123, False), (1, 1, 3, 1.0, 3, 1, 1.0, True), (2, 4, 2, 0.95, 1, 5, 0.95, False), (2, 4, 2, 0.95, 2, 4, 0.95, False)]
