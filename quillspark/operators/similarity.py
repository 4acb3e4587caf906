"""Duplicates, vector neighbours, clusters, votes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quillspark.functions import scalars as S
from quillspark.plans.registry import query
from quillspark.plans.staging import dropped, staged

#: Most vectors of a block, of which a task holds two, cosines that it holds at a time, and edges that one task may hold (16 bytes each).
BLOCK, SLICE, HELD_EDGES = 16_384, 2_000_000, 1_000_000


@query("content_hash_groups", r"""
SELECT h, count(*) AS n, min(doc_id) AS first_id FROM (SELECT doc_id, md5(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS h FROM documents) GROUP BY h HAVING count(*) >= 2""")
def content_hash_groups(t, spark):
    d = t("documents").select("doc_id", S.content_hash(F.col("text")).alias("h"))
    return d.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).filter("n >= 2")


@query("dedup_first_wins", """
SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS r FROM documents WHERE trim(text) != '') WHERE r = 1""")
def dedup_first_wins(t, spark):
    """Blanks go first, then the first of each text stays; found by aggregation, so a large group never meets in one task."""
    d = t("documents").filter("trim(text) != ''")
    return d.groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("dup_flag", """
SELECT doc_id, EXISTS (SELECT 1 FROM documents o WHERE o.text = d.text AND o.source != d.source) AS is_bank_duplicate FROM documents d""")
def dup_flag(t, spark):
    """Whether another collection holds the same text; rows of unknown collection do not count."""
    d = t("documents").select("doc_id", "source", F.md5("text").alias("h"))
    per = d.filter("source is not null").groupBy("h").agg(F.count_distinct("source").alias("sources"))
    return d.join(per, "h", "left").select("doc_id", F.coalesce((F.col("sources") > 1) & F.col("source").isNotNull(), F.lit(False)).alias("is_bank_duplicate"))


@query("prefix_dedup", r"""
SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY substring(lower(regexp_replace(text, '\s+', ' ', 'g')), 1, 150)""")
def prefix_dedup(t, spark):
    """Merges chunks whose first 150 normalised characters agree."""
    key = F.substring(F.lower(F.regexp_replace("text", "\\s+", " ")), 1, 150)
    return t("documents").groupBy(key.alias("k")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")).drop("k")


@query("exact_pairs", "SELECT a.doc_id AS a, b.doc_id AS b, 1.0::DOUBLE AS score FROM documents a JOIN documents b ON a.text = b.text AND a.doc_id < b.doc_id AND a.source = b.source")
def exact_pairs(t, spark):
    """All pairs of one owner's equal texts."""
    d = t("documents").select("doc_id", "source", F.md5("text").alias("h"))
    b = d.withColumnRenamed("doc_id", "b")
    return d.withColumnRenamed("doc_id", "a").join(b, ["h", "source"]).filter("a < b").select("a", "b", F.lit(1.0).alias("score"))


def _unit(batches: list[pa.RecordBatch]) -> np.ndarray:
    """Unit vectors of the batches' column v; zero vectors stay zero."""
    parts = [b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1) for b in batches if b.num_rows]
    rows = np.concatenate(parts) if parts else np.zeros((0, 1))
    norm = np.sqrt((rows * rows).sum(1, keepdims=True))
    return rows / np.where(norm == 0, 1, norm)


def _alike(a: np.ndarray, b: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of a, rows of b, cosines) from the threshold on, a slice of a at a time."""
    step = max(1, SLICE // max(1, len(b)))
    for at in range(0, len(a) if len(b) else 0, step):
        score = a[at : at + step] @ b.T
        x, y = np.nonzero(score >= threshold)
        yield x + at, y, score[x, y]


def _best_of(x: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the best ``k`` of each x, ties by the smaller id."""
    rank = np.lexsort((ids, -score, x))
    held = x[rank]
    return rank[np.arange(len(held)) - np.searchsorted(held, held) < k]


def least_ids(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, labels) of the edges a - b: the least id that each one reaches."""
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = place[: len(a)], place[len(a) :], np.arange(len(ids))
    while True:
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        if (low == high).all():
            return ids, ids[label]
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]


def _by_blocks(left: DataFrame, right: DataFrame, block: int | None, compare, schema: str) -> DataFrame:
    """What ``compare`` makes of every pair of blocks of two tables (id, v, other columns): it is given both blocks' batches and whether they are one.

    No side is broadcast and no task holds more than two blocks.  A table
    against itself (the same object) meets in each pair of blocks once.
    """
    itself = left is right
    n_left = left.count()
    n_right = n_left if itself else right.count()
    # Blocks small enough that there is work for all; a row goes to as many tasks as the other side has blocks.
    block = block or max(2048, min(BLOCK, max(n_left, n_right) // 16))
    n_left, n_right = max(1, -(-n_left // block)), max(1, -(-n_right // block))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda first, n: F.explode(F.sequence(first, F.lit(n - 1)))
    a = left.filter("v is not null").withColumn("i", own(n_left)).withColumn("j", every(F.col("i") if itself else F.lit(0), n_right)).withColumn("side", F.lit(0))
    b = right.filter("v is not null").withColumn("j", own(n_right))
    if itself:
        b = b.filter("j > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("j") - 1)))
    else:
        b = b.withColumn("i", every(F.lit(0), n_left))
    rows = a.unionByName(b.withColumn("side", F.lit(1)), allowMissingColumns=True)

    return met(rows, compare, schema, itself)


def met(rows: DataFrame, compare, schema: str, itself: bool = False) -> DataFrame:
    """What ``compare`` makes of the batches of sides 0 and 1 of each (i, j), and of whether they are one."""

    def meet(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = [], []
        for batch in batches:
            side = batch.column("side").to_numpy()
            for k in (0, 1):
                sides[k].append(batch.filter(pa.array(side == k)))
        same = itself and key[0].as_py() == key[1].as_py()
        yield from compare(sides[0], sides[0] if same else sides[1], same)

    return rows.groupBy("i", "j").applyInArrow(meet, schema)


def _ids(batches: list[pa.RecordBatch], column: str = "id") -> np.ndarray:
    return np.concatenate([b.column(column).to_numpy(zero_copy_only=False) for b in batches]) if batches else np.zeros(0, np.int64)


def pairs_above(left: DataFrame, right: DataFrame, threshold: float, k: int | None = None, later_only: bool = False, block: int | None = None) -> DataFrame:
    """(a, b, score) with cosine at or above the threshold, the best k for each a.

    ``left`` and ``right`` have (id, v).  Each side is cut into blocks and
    every pair of blocks is a matrix product in a task of its own, made and
    given out slice by slice; ties go to the smaller b.  A zero vector has no
    neighbours.
    """
    itself = left is right

    def compare(of_a, of_b, same):
        a, b, x, y = _ids(of_a), _ids(of_b), _unit(of_a), _unit(of_b)
        x, a = x[some := x.any(1)], a[some]
        y, b = y[some := y.any(1)], b[some]
        for i, j, score in _alike(x, y, threshold):
            p, q = a[i], b[j]
            keep = q > p if same or (later_only and not itself) else p != q
            p, q, score = p[keep], q[keep], score[keep]
            if itself:  # each pair is met once
                p, q = np.minimum(p, q), np.maximum(p, q)
                if not later_only:
                    p, q, score = np.concatenate([p, q]), np.concatenate([q, p]), np.concatenate([score, score])
            if k is not None:
                best = _best_of(p, q, score, k)
                p, q, score = p[best], q[best], score[best]
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(q), pa.array(score)], names=["a", "b", "score"])

    found = _by_blocks(left, right, block, compare, "a long, b long, score double")
    if k is None:
        return found
    best = F.row_number().over(W.partitionBy("a").orderBy(F.desc("score"), "b"))
    return found.withColumn("r", best).filter(F.col("r") <= k).drop("r")


def links_above(left: DataFrame, right: DataFrame, threshold: float, block: int | None = None) -> DataFrame:
    """(a, b, score) that connect what the pairs of ``pairs_above`` connect: in each pair of blocks, every id with the least one it reaches and the best score of what is connected there.

    There are no more of them than ids in the two blocks, however many pairs are alike.
    """

    def compare(of_a, of_b, same):
        a, b, x, y = _ids(of_a), _ids(of_b), _unit(of_a), _unit(of_b)
        x, a = x[some := x.any(1)], a[some]
        y, b = y[some := y.any(1)], b[some]
        held, size = [], 0

        def collapsed():
            p, q, score = (np.concatenate(c) for c in zip(*held, strict=True))
            ids, label = least_ids(p, q)
            top = np.full(len(ids), -np.inf)
            np.maximum.at(top, np.searchsorted(ids, label[np.searchsorted(ids, p)]), score)
            tied = ids != label
            return ids[tied], label[tied], top[np.searchsorted(ids, label[tied])]

        for i, j, score in _alike(x, y, threshold):
            p, q = a[i], b[j]
            keep = q > p if same else p != q
            held.append((p[keep], q[keep], score[keep]))
            size += int(keep.sum())
            if size > 4 * (len(a) + len(b)) + 100_000:
                held = [collapsed()]
                size = len(held[0][0])
        if size:
            yield pa.RecordBatch.from_arrays([*map(pa.array, collapsed())], names=["a", "b", "score"])

    return _by_blocks(left, right, block, compare, "a long, b long, score double")


def votes_above(asked: DataFrame, voters: DataFrame, threshold: float, block: int | None = None) -> DataFrame:
    """(id, v, own) and (id, v, exam, said) -> (question, said, w, best): for each question and label the sum of the cosines from the threshold on, and the best one with the voter's id, negated.

    Votes of the same exam do not count.  Sums are made in each pair of
    blocks, so that pairs never leave a task.
    """

    def compare(of_a, of_b, same):
        a, b, x, y = _ids(of_a), _ids(of_b), _unit(of_a), _unit(of_b)
        own, exam = _ids(of_a, "own"), _ids(of_b, "exam")
        said = pa.chunked_array([c.column("said") for c in of_b], pa.string()).combine_chunks().dictionary_encode()
        words, code = said.dictionary, said.indices.to_numpy()
        some, more = x.any(1), y.any(1)
        x, a, own, y, b, exam, code = x[some], a[some], own[some], y[more], b[more], exam[more], code[more]
        for i, j, score in _alike(x, y, threshold):
            keep = (a[i] != b[j]) & (own[i] != exam[j])
            i, j, score = i[keep], j[keep], score[keep]
            key = i * len(words) + code[j]
            first = _best_of(key, b[j], score, 1)
            sums = np.bincount(np.searchsorted(key[first], key), score, len(first))
            yield pa.RecordBatch.from_arrays([pa.array(a[i[first]]), words.take(pa.array(code[j[first]])), pa.array(sums, pa.float64()), pa.array(score[first]), pa.array(-b[j[first]])], names=["question", "said", "w", "score", "s"])

    parts = _by_blocks(asked, voters, block, compare, "question long, said string, w double, score double, s long")
    return parts.groupBy("question", "said").agg(F.sum("w").alias("w"), F.max(F.struct("score", "s")).alias("best"))


def vectors(t) -> DataFrame:
    return t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query("near_dup_pairs", f"SELECT a.vec_id AS a, b.vec_id AS b, round({_COS}, 4) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {_COS} >= 0.4")
def near_dup_pairs(t, spark):
    v = vectors(t)
    return pairs_above(v, v, 0.4, later_only=True).select("a", "b", F.round("score", 4).alias("score"))


@query("knn_topk", f"""
SELECT a, b, round(s, 4) AS score FROM (SELECT a.vec_id AS a, b.vec_id AS b, {_COS} AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS r
 FROM embeddings a JOIN embeddings b ON a.vec_id != b.vec_id WHERE a.vec_id % 50 = 0 AND {_COS} >= 0.1) WHERE r <= 3""")
def knn_topk(t, spark):
    """The three nearest of each query vector among all vectors."""
    v = vectors(t)
    return pairs_above(v.filter("id % 50 = 0"), v, 0.1, k=3).select("a", "b", F.round("score", 4).alias("score"))


@query("knn_filtered", f"""
SELECT b.vec_id AS id, round({_COS}, 4) AS score FROM embeddings a JOIN embeddings b ON b.label = 3 WHERE a.vec_id = 0 AND b.vec_id != 0 AND {_COS} >= 0.05 ORDER BY {_COS} DESC, b.vec_id LIMIT 5""")
def knn_filtered(t, spark):
    """One query vector, a metadata filter, a least similarity and a limit."""
    one = t("embeddings").filter("vec_id = 0").select(F.col("embedding").alias("q"))
    rows = t("embeddings").filter("label = 3 and vec_id != 0").crossJoin(F.broadcast(one)).withColumn("s", S.cosine(F.col("embedding"), F.col("q")))
    return rows.filter("s >= 0.05").orderBy(F.desc("s"), "vec_id").limit(5).select(F.col("vec_id").alias("id"), F.round("s", 4).alias("score"))


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Ties the larger neighbours of every vertex to its least one, or else the vertex and all its smaller ones."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    near = down.union(down.select("v", "u")) if larger else down
    least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    tied = near.join(least, "u")
    out = tied.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")) if larger else tied.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a != b").distinct()


def _in_one_task(edges: DataFrame) -> DataFrame:
    """(id, label) of edges that one task can hold."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        a, b = (np.concatenate([x.column(k).to_numpy() for x in held]) for k in (0, 1))
        ids, label = least_ids(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(label)], names=["id", "label"])

    return edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).coalesce(1).mapInArrow(run, "id long, label long")


def clusters(edges: DataFrame, held: int = HELD_EDGES) -> DataFrame:
    """(a, b) edges -> (id, label): the least id that each one reaches.

    Up to ``held`` edges, counted first, are settled in one task.  More are
    contracted to stars in rounds, about the logarithm of the longest chain;
    a round is written before the next, which takes its place.
    """
    edges = staged(edges.select("a", "b").filter("a != b").distinct())
    if edges.limit(held + 1).count() <= held:
        return staged(_in_one_task(edges))
    before = None
    while True:
        after = staged(_star(_star(edges, True), False))
        dropped(edges)
        edges = after
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("label")).union(edges.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct())
        before = now


@query("dup_components", f"""
WITH RECURSIVE e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {_COS} >= 0.42),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS id, a AS reach FROM u UNION SELECT r.id, u.b FROM r JOIN u ON r.reach = u.a)
SELECT id, min(reach) AS label FROM r GROUP BY id""")
def dup_components(t, spark):
    v = vectors(t)
    return clusters(links_above(v, v, 0.42))


@query("difficulty_vote", f"""
WITH e AS (SELECT a.vec_id AS a, b.label % 4 AS d, {_COS} AS s FROM embeddings a JOIN embeddings b ON a.vec_id != b.vec_id WHERE {_COS} >= 0.3),
w AS (SELECT a, d, sum(s) AS w, max(s) AS best FROM e GROUP BY ALL), x AS (SELECT *, w / sum(w) OVER (PARTITION BY a) AS share, row_number() OVER (PARTITION BY a ORDER BY w DESC, best DESC, d) AS r FROM w)
SELECT a AS id, d AS winner, round(share, 4) AS share FROM x WHERE r = 1 AND share >= 0.6""")
def difficulty_vote(t, spark):
    """Weighted vote over similar items: the label with the largest sum wins if its share is 0.6 or more."""
    v = vectors(t)
    # Every vector is asked and every other one votes; an unknown label is one of its own.
    voters = t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.lit(1).alias("exam"), F.coalesce((F.col("label") % 4).cast("string"), F.lit("")).alias("said"))
    per = votes_above(v.withColumn("own", F.lit(0)), voters, 0.3).select(F.col("question").alias("a"), F.nullif("said", F.lit("")).cast("int").alias("d"), "w", F.col("best.score").alias("best"))
    won = per.groupBy("a").agg(F.max_by(F.struct("d", "w"), F.struct("w", "best", (-F.col("d")).alias("nd"))).alias("x"), F.sum("w").alias("all"))
    return won.withColumn("s", F.col("x.w") / F.col("all")).filter("s >= 0.6").select(F.col("a").alias("id"), F.col("x.d").alias("winner"), F.round("s", 4).alias("share"))


@query("nested_similar", f"SELECT a.vec_id AS id, count(*) AS n, max(round({_COS}, 4)) AS best FROM embeddings a JOIN embeddings b ON a.vec_id != b.vec_id WHERE {_COS} >= 0.4 GROUP BY 1")
def nested_similar(t, spark):
    """Each item with its similar ones as an array, best first."""
    v = vectors(t)
    edges = pairs_above(v, v, 0.4)
    nested = edges.groupBy(F.col("a").alias("id")).agg(F.sort_array(F.collect_list(F.struct(F.round("score", 4).alias("score"), F.col("b").alias("other"))), asc=False).alias("similar"))
    return nested.select("id", F.size("similar").cast("long").alias("n"), F.element_at("similar", 1)["score"].alias("best"))


@query("union_of_pairs", f"""
WITH h AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id AND a.vec_id % 40 = b.vec_id % 40),
s AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {_COS} >= 0.4)
SELECT a, b, 'hash' AS kind FROM h UNION ALL SELECT a, b, 'vector' FROM s WHERE (a, b) NOT IN (SELECT (a, b) FROM h)""")
def union_of_pairs(t, spark):
    """Pairs by key, and vector pairs that the key has not found already."""
    e = t("embeddings").select("vec_id", "label", (F.col("vec_id") % 40).alias("m"))
    h = e.select(F.col("vec_id").alias("a"), "label", "m").join(e.select(F.col("vec_id").alias("b"), "label", "m"), ["label", "m"]).filter("a < b").select("a", "b")
    v = vectors(t)
    s = pairs_above(v, v, 0.4, later_only=True).select("a", "b").join(h, ["a", "b"], "left_anti")
    return h.withColumn("kind", F.lit("hash")).unionByName(s.withColumn("kind", F.lit("vector")))


def tokens(x: Column) -> Column:
    """Lower-cased runs of letters and digits without accents."""
    return F.filter(F.split(S.fold(F.lower(x)), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


K1, B = 1.2, 0.75


def phrase_search(docs: DataFrame, phrase: str, limit: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents that hold the phrase as consecutive words, best BM25 first; a blank phrase finds nothing."""
    words = [w for w in re.split(r"[\W_]+", phrase.lower()) if w]
    if not words:
        return docs.select(F.col(doc_id), F.lit(0.0).alias("score")).limit(0)
    # Two blanks between words and one at either end: each word lies between blanks of its own, so that occurrences side by side are all counted, overlapping ones too.
    said = F.trim(F.regexp_replace(S.fold(F.lower(F.col(text))), "[^\\p{L}\\p{N}]+", "  "))
    d = docs.select(F.col(doc_id), F.concat(F.lit(" "), said, F.lit(" ")).alias("w"))
    length = F.when(F.col("w") == "  ", 0).otherwise((F.length("w") - F.length(F.replace("w", F.lit("  "), F.lit("")))) / 2 + 1).cast("int")
    d = d.select(F.col(doc_id), length.alias("len"), F.regexp_count("w", F.lit(f"(?= {'  '.join(words)} )")).alias("tf"))
    d = staged(d)  # three numbers a document: no text is folded twice
    stats = d.agg(F.count(F.lit(1)).alias("docs"), F.avg("len").alias("mean"), F.count_if(F.col("tf") > 0).alias("df"))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    return d.filter("tf > 0").crossJoin(F.broadcast(stats)).select(F.col(doc_id), score.alias("score")).orderBy(F.desc("score"), doc_id).limit(limit)


# The same words in SQL: lower case, letters without accents, runs of letters and digits.
_FROM, _TO = ("".join(x) for x in zip(*((x, base) for base, marked in S._BASES.items() for x in marked), strict=True))
_TOK = f"list_filter(regexp_split_to_array(translate(lower(text), '{_FROM}', '{_TO}'), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x != '')"
_PHRASE_SQL = f"""
WITH d AS (SELECT doc_id, {_TOK} AS w FROM documents), f AS (SELECT doc_id, len(w) AS len, len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) AS tf FROM d),
s AS (SELECT count(*) AS docs, avg(len) AS mean, count(*) FILTER (tf > 0) AS df FROM f)
SELECT doc_id, round(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean)), 6) AS score FROM f, s WHERE tf > 0 ORDER BY score DESC, doc_id LIMIT 20"""
_POSTINGS_SQL = f"SELECT w, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_TOK}) AS w FROM documents) GROUP BY w"


@query("phrase_search_all", _PHRASE_SQL)
@query("phrase_search", _PHRASE_SQL)
def phrase_search_query(t, spark):
    """Over all documents, in any language."""
    return phrase_search(t("documents"), "of the").withColumn("score", F.round("score", 6))


@query("postings_all", _POSTINGS_SQL)
@query("postings", _POSTINGS_SQL)
def postings(t, spark):
    """All words of all documents."""
    d = t("documents").select("doc_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("w")).distinct()
    return d.groupBy("w").agg(F.count(F.lit(1)).alias("df"))


@query("retrieval_cascade", f"""
WITH q AS (SELECT embedding, label FROM embeddings WHERE vec_id = 7), r AS (SELECT b.vec_id AS id, b.label, {_COS} AS s FROM q a, embeddings b WHERE b.vec_id != 7),
t1 AS (SELECT 1 AS tier, id, s FROM r WHERE s >= 0.3 AND label = 99), t2 AS (SELECT 2 AS tier, id, s FROM r WHERE s >= 0.2)
SELECT tier, id, round(s, 4) AS score FROM (SELECT * FROM t1 UNION ALL SELECT * FROM t2) WHERE tier = (SELECT min(tier) FROM (SELECT * FROM t1 UNION ALL SELECT * FROM t2)) ORDER BY s DESC, id LIMIT 3""")
def retrieval_cascade(t, spark):
    """The first tier that finds anything answers, in order of similarity."""
    one = t("embeddings").filter("vec_id = 7").select(F.col("embedding").alias("q"))
    r = t("embeddings").filter("vec_id != 7").crossJoin(F.broadcast(one)).select(F.col("vec_id").alias("id"), "label", S.cosine(F.col("embedding"), F.col("q")).alias("s"))
    tiers = r.withColumn("tier", F.when((F.col("s") >= 0.3) & (F.col("label") == 99), 1).when(F.col("s") >= 0.2, 2)).filter("tier is not null")
    first = tiers.agg(F.min("tier").alias("tier"))
    return tiers.join(F.broadcast(first), "tier").orderBy(F.desc("s"), "id").limit(3).select("tier", "id", F.round("s", 4).alias("score"))


@query("embedding_backlog", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def embedding_backlog(t, spark):
    return t("documents").join(t("embeddings"), F.col("vec_id") == F.col("doc_id"), "left_anti").select("doc_id")


@query("embedding_text", "SELECT doc_id, concat_ws(' | ', 'Toán', lang, source) || ': ' || substring(text, 1, 500) AS enriched FROM documents")
def embedding_text(t, spark):
    return t("documents").select("doc_id", F.concat(F.concat_ws(" | ", F.lit("Toán"), "lang", "source"), F.lit(": "), F.substring("text", 1, 500)).alias("enriched"))


def hashed_embedding(text: Column, dims: int = 64) -> Column:
    """A deterministic stand-in for an embedding model: signed counts of hashed words."""
    # Twice the place, and one more where the word counts against it.
    codes = F.transform(tokens(text), lambda w: (F.pmod(F.xxhash64(w), F.lit(dims)) * 2 + F.when(F.pmod(F.crc32(w), F.lit(2)) == 0, 0).otherwise(1)).cast("int"))

    @F.pandas_udf("array<double>")
    def counted(codes: pd.Series) -> pd.Series:
        def one(c):
            n = np.bincount(c, minlength=2 * dims)
            return (n[0::2] - n[1::2]).astype(np.float64)

        return codes.map(lambda c: None if c is None else one(c))

    return counted(codes)
