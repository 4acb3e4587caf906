"""Pairs of vectors by blocks: what leaves a task, what a task holds, and that slices and blocks lose nothing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quillspark.operators import duplicates, similarity, vector_index


def _vectors(spark, n=60, copies=40, dims=6):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(n, dims)).astype(np.float32)
    v[:copies] = v[0]
    v[-1] = 0
    return v, spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(n, None)], "id long, v array<float>").cache()


def _cosines(v):
    unit = v.astype(np.float64) / np.maximum(np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True), 1e-300)
    s = unit @ unit.T
    np.fill_diagonal(s, -2)
    s[-1, :] = s[:, -1] = -2
    return s


def test_pairs_by_blocks_and_slices(spark, monkeypatch):
    v, rows = _vectors(spark)
    s = _cosines(v)
    monkeypatch.setattr(similarity, "SLICE", 50)
    want = {(int(i), int(j)) for i, j in np.argwhere(s >= 0.6)}
    assert {(r.a, r.b) for r in similarity.pairs_above(rows, rows, 0.6, block=7).collect()} == want
    assert {(r.a, r.b) for r in similarity.pairs_above(rows, rows.filter("true"), 0.6, later_only=True, block=9).collect()} == {(i, j) for i, j in want if i < j}
    best = sum(min(3, int((row >= 0.1).sum())) for row in s)
    assert similarity.pairs_above(rows, rows.filter("true"), 0.1, k=3, block=7).count() == best


def test_the_best_of_a_block_are_all_that_leaves_it(spark, monkeypatch):
    """knn_topk: no more than k a query, slice and pair of blocks."""
    _, rows = _vectors(spark)
    seen = []
    by_blocks = similarity._by_blocks
    monkeypatch.setattr(similarity, "_by_blocks", lambda *a: seen.append(by_blocks(*a)) or seen[-1])
    similarity.pairs_above(rows.filter("id % 5 = 0"), rows, 0.1, k=3, block=1000)
    assert seen[0].groupBy("a").count().agg(F.max("count")).first()[0] == 3


def test_links_connect_what_pairs_connect(spark):
    """Copies give one link each, not one a pair, and keep the best score of what they connect."""
    v, rows = _vectors(spark)
    pairs = similarity.pairs_above(rows, rows, 0.6, later_only=True, block=20)
    links = similarity.links_above(rows, rows, 0.6, block=20).cache()
    labels = lambda e: {r.id: r.label for r in similarity.clusters(e).collect()}
    assert labels(links) == labels(pairs) and links.count() < pairs.count() / 2
    assert similarity.links_above(rows, rows, 0.6, block=1000).count() <= len(v)
    of = labels(pairs)
    top = lambda e: {g: round(max(r.score for r in e if of[r.a] == g), 6) for g in {of[r.a] for r in e}}
    assert top(links.collect()) == top(pairs.collect())


def test_votes_are_summed_where_pairs_are_found(spark):
    v, rows = _vectors(spark)
    levels = [None, "TH", "VD", "NB", "VDC", "?"]
    q = spark.createDataFrame([(i, None if i % 9 == 0 else i % 9, levels[i % 6]) for i in range(len(v))], "id long, exam long, difficulty string")
    edges = similarity.pairs_above(rows, rows, 0.3).select(F.col("a").alias("question"), F.col("b").alias("similar"), "score")
    want = {tuple(r) for r in duplicates.voted_updates(q, edges, 0.3, 0.4).collect()}
    assert want and {tuple(r) for r in duplicates.voted_by_vectors(q, rows, 0.3, 0.4).collect()} == want
    asked = q.select("id", F.coalesce("exam", F.lit(0)).alias("own")).join(rows, "id")
    voters = q.filter("difficulty is not null and exam is not null").select("id", "exam", F.col("difficulty").alias("said")).join(rows, "id")
    got = {(r.question, r.said): (round(r.w, 9), -r.best.s) for r in similarity.votes_above(asked, voters, 0.3, block=11).collect()}
    plain = {}
    for e in edges.collect():
        if levels[e.similar % 6] and e.similar % 9 and e.similar % 9 != e.question % 9:
            plain.setdefault((e.question, levels[e.similar % 6]), []).append((e.score, e.similar))
    assert {k: x[0] for k, x in got.items()} == {k: round(sum(s for s, _ in x), 9) for k, x in plain.items()}


def test_no_task_of_the_index_holds_more_than_two_blocks(spark, monkeypatch):
    """pairs_within: whatever cells the queries visit."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(5000, 4)).astype(np.float32)
    v[:2500] = v[0]
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, v array<float>").cache()
    index = vector_index.build_index(rows, cells=5)
    seen = []
    met = similarity.met
    monkeypatch.setattr(similarity, "met", lambda rows, *a: seen.append(rows) or met(rows, *a))
    got = index.within(rows.filter("id >= 2400 and id < 2700"), 0.99, later_only=True)
    s = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    i, j = np.nonzero(s[2400:2700] @ s.T >= 0.99)
    assert got.count() == int((j > i + 2400).sum())
    index.within(rows, 0.99, later_only=True)
    sides = seen[1].groupBy("i", "j", "side").count().agg(F.max("count")).first()[0]
    assert sides <= 2048 * 1.2


def test_words_of_a_stand_in_vector_are_hashed_once(spark):
    """materialised_vectors: the words were taken from the text anew for each of the vector's places."""
    rows = spark.createDataFrame([(0, "Điểm a a b Ä"), (1, ""), (2, None), (3, " ".join(f"w{i}" for i in range(500)))], "id long, text string")
    words = similarity.tokens(F.col("text"))
    plain = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.aggregate(words, F.lit(0.0), lambda s, w: s + F.when(F.pmod(F.xxhash64(w), F.lit(64)) == k, F.when(F.pmod(F.crc32(w), F.lit(2)) == 0, 1.0).otherwise(-1.0)).otherwise(0.0)))
    made = rows.select(similarity.hashed_embedding(F.col("text")).alias("v"))
    assert "aggregate(" not in made._jdf.queryExecution().optimizedPlan().toString()
    got = rows.select("id", plain.alias("plain"), similarity.hashed_embedding(F.col("text")).alias("made")).filter("text is not null").collect()
    assert all(r.plain == r.made for r in got) and len(got) == 3
