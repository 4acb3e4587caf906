"""A vector index by coarse cells: approximate search of the nearest cells, or exact search by bounds.

Centroids are fitted on a bounded sample; every vector is stored in the cell
of its nearest centroid, with the cell's widest angle beside it.  A search
compares a query with the cells it probes only, cell by cell as matrix
products; the best of each cell are all that leaves a task.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from quillspark.operators import similarity
from quillspark.operators.similarity import _COS, vectors
from quillspark.plans.registry import query
from quillspark.plans.staging import fresh_path, staged

#: Most vectors that centroids are fitted on, taken by a hash of the id, and most centroids (their number is the root of the table's).
SAMPLE, CELLS = 20_000, 4096
#: Vectors of a cell compared by one task at a time; larger cells are split.
BLOCK = 4096
#: Queries times cells that are ranked at a time.
PAIRS = 100_000
#: Share of the true neighbours that the probed cells must hold, as measured on the sample.
RECALL = 0.95
ROUNDS, SEED = 12, 11


def _unit(column) -> np.ndarray:
    """Unit vectors of an Arrow column of equally long lists; zero vectors stay zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 1))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    norm = np.sqrt((flat * flat).sum(1, keepdims=True))
    return flat / np.where(norm == 0, 1, norm)


def fit_centroids(sample: np.ndarray, cells: int) -> np.ndarray:
    """Unit centroids by spherical k-means."""
    rng = np.random.default_rng(SEED)
    centroids = sample[rng.permutation(len(sample))[:cells]].copy()
    for _ in range(ROUNDS):
        own = np.argmax(sample @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norm > 0, sums / np.where(norm == 0, 1, norm), centroids)
    return centroids


def probes_for(sample: np.ndarray, centroids: np.ndarray, k: int, recall: float) -> int:
    """Fewest nearest cells that hold ``recall`` of the ``k`` nearest others of sampled vectors."""
    asked = sample[: min(len(sample), 512)]
    near = np.argsort(-(asked @ sample.T), axis=1, kind="stable")[:, 1 : k + 1]
    order = np.argsort(np.argsort(-(asked @ centroids.T), axis=1), axis=1)
    own = np.argmax(sample @ centroids.T, axis=1)
    rank = np.sort(np.take_along_axis(order, own[near], axis=1).ravel())
    return int(rank[max(0, math.ceil(recall * len(rank)) - 1)]) + 1 if len(rank) else 1


@dataclass
class VectorIndex:
    """Cells of unit vectors (cell, id, v, and other columns) with their centroids and widest angles."""

    spark: SparkSession
    centroids: np.ndarray
    probes: int
    rows: DataFrame

    @functools.cached_property
    def angles(self) -> np.ndarray:
        """Widest angle of each cell; -1 for an empty one."""
        out = np.full(len(self.centroids), -1.0)
        for cell, angle in self.rows.groupBy("cell").agg(F.max("angle")).collect():  # one row a cell
            out[cell] = angle
        return out

    def save(self, path: str) -> None:
        """Vectors by cell, and the centroids beside them."""
        self.rows.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
        told = [(k, [float(x) for x in c], self.probes) for k, c in enumerate(self.centroids)]
        self.spark.createDataFrame(told, "cell int, centroid array<double>, probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")

    @staticmethod
    def load(spark: SparkSession, path: str) -> VectorIndex:
        told = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
        rows = spark.read.parquet(f"{path}/vectors").withColumn("cell", F.col("cell").cast("int"))
        return VectorIndex(spark, np.array([r["centroid"] for r in told]), told[0]["probes"] if told else 1, rows)

    def with_rows(self, added: DataFrame | None = None, removed: DataFrame | None = None) -> VectorIndex:
        """The index with rows (id, v, ...) put in place of those of the same ids, and ids taken out; cells stay as they are."""
        rows = self.rows
        for gone in (removed, added):
            if gone is not None:
                rows = rows.join(gone.select("id").distinct(), "id", "left_anti")
        if added is not None:
            rows = rows.unionByName(_in_cells(added, self.centroids), allowMissingColumns=True)
        return VectorIndex(self.spark, self.centroids, self.probes, rows)

    def search(self, queries: DataFrame, k: int, least: float = -1.0, where=None, exact: bool = False, probes: int | None = None) -> DataFrame:
        """(a, b, score): for each query (id, v) the ``k`` most similar stored vectors but itself, with cosine ``least`` or more; ties go to the smaller b.

        Without ``exact`` the nearest ``probes`` cells answer.  With it, cells
        that may still hold something better than the k-th found are looked
        at in a second pass: a vector in a cell is at least the angle to the
        centroid less the cell's widest angle away.  ``where`` filters stored
        rows by their other columns.  Zero vectors find nothing.
        """
        asked = _probed(queries.filter("v is not null"), self.centroids, probes or self.probes, exact)
        rows = self.rows if where is None else self.rows.filter(where)
        found = self._compared(asked.filter("near"), rows, k, least)
        if exact:
            found = staged(found)
            floor = found.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("worst"))
            known = self.spark.createDataFrame([(c, float(a)) for c, a in enumerate(self.angles) if a >= 0], "cell int, widest double")
            # One row a cell: at most CELLS.
            rest = asked.filter("not near").join(F.broadcast(known), "cell").join(floor.withColumnRenamed("a", "id"), "id", "left")
            reach = F.cos(F.greatest(F.lit(0.0), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "s"))) - F.col("widest")))
            need = F.when(F.col("n") >= k, F.greatest("worst", F.lit(float(least)))).otherwise(F.lit(float(least)))
            more = self._compared(rest.filter(reach >= need - 1e-9).select("cell", "id", "v", "near"), rows, k, least)
            found = found.unionByName(more)
        return _best(found, k)

    def within(self, queries: DataFrame, least: float, later_only: bool = False) -> DataFrame:
        """(a, b, score): every stored vector with cosine ``least`` or more to a query (id, v), itself aside; only larger ids with ``later_only``.

        A query visits the cells whose widest angle reaches it: the rest cannot
        hold such a vector.  Vectors in groups visit a few cells, vectors
        without any structure all of them.
        """
        # Cells side by side in blocks of up to so many vectors; a larger cell has several of its own.
        counts = np.zeros(len(self.centroids), np.int64)
        for cell, n in self.rows.groupBy("cell").count().collect():  # one row a cell
            counts[cell] = n
        n_asked = queries.count()
        size = max(2048, min(similarity.BLOCK, max(n_asked, int(counts.sum())) // 16))
        first, last = np.zeros(len(counts), np.int64), np.full(len(counts), -1)
        block = held = 0
        for cell in np.flatnonzero(counts):
            if held and held + counts[cell] > size:
                block, held = block + 1, 0
            held += counts[cell]
            first[cell], last[cell] = block, block + (held - 1) // size
            block, held = last[cell], (held if last[cell] == block else size)
        reach = math.acos(max(-1.0, min(1.0, least))) + 1e-9
        told = self.spark.sparkContext.broadcast((self.centroids, self.angles, first, last))

        @F.pandas_udf("array<int>")
        def visited(v):
            import pandas as pd

            centroids, widest, first, last = told.value
            out = []
            for at in range(0, len(v), 1024):
                near = np.arccos(np.clip(_unit(pa.array(v.iloc[at : at + 1024].tolist(), pa.list_(pa.float64()))) @ centroids.T, -1, 1)) - widest <= reach
                # A block is visited when one of its cells is: cells lie side by side, so counts of the first and behind the last are enough.
                steps = np.zeros((len(near), int(last.max()) + 2), np.int32)
                rows, cells = np.nonzero(near & (last >= first))
                np.add.at(steps, (rows, first[cells]), 1)
                np.add.at(steps, (rows, last[cells] + 1), -1)
                hit = np.cumsum(steps, axis=1) > 0
                out += [np.flatnonzero(h).astype(np.int32) for h in hit]
            return pd.Series(out, dtype=object)

        parts = max(1, -(-n_asked // size))
        sizes = self.spark.createDataFrame([(int(c), int(first[c]), int(last[c] - first[c]) + 1) for c in np.flatnonzero(counts)], "cell int, first int, blocks int")
        mine = queries.filter("v is not null").select("id", "v", F.explode(visited("v")).alias("j")).withColumn("i", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("side", F.lit(0))
        # One row a cell: at most CELLS.
        stored = self.rows.join(F.broadcast(sizes), "cell").select("id", "v", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("blocks"))).cast("int").alias("j"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("i"), F.lit(1).alias("side"))

        def product(of_a, of_b, same):
            a, b, x, y = similarity._ids(of_a), similarity._ids(of_b), similarity._unit(of_a), similarity._unit(of_b)
            x, a = x[some := x.any(1)], a[some]
            y, b = y[some := y.any(1)], b[some]
            for i, j, score in similarity._alike(x, y, least):
                keep = b[j] > a[i] if later_only else b[j] != a[i]
                yield pa.RecordBatch.from_arrays([pa.array(a[i[keep]]), pa.array(b[j[keep]]), pa.array(score[keep])], names=["a", "b", "score"])

        return similarity.met(mine.unionByName(stored), product, "a long, b long, score double")

    @staticmethod
    def _dealt(asked: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Stored rows in blocks of their cell, and queries for each block of the cells they visit."""
        sizes = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
        dealt = rows.join(F.broadcast(sizes), "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), "id", "v")
        return asked.join(F.broadcast(sizes), "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "id", "v"), dealt

    def _compared(self, asked: DataFrame, rows: DataFrame, k: int, least: float) -> DataFrame:
        """(a, b, score): the best ``k`` of each query in each block of a cell, then of all."""
        asked, dealt = self._dealt(asked, rows)

        def product(left: pa.Table, right: pa.Table) -> pa.Table:
            out = {"a": [], "b": [], "score": []}
            q, x, ids, stored = _unit(left["v"]), _unit(right["v"]), left["id"].to_numpy(), right["id"].to_numpy()
            order = np.argsort(stored, kind="stable")
            x, stored = x[order], stored[order]
            some = np.flatnonzero(np.abs(x).sum(1) > 0)
            x, stored = x[some], stored[some]
            for at in range(0, len(q) if len(x) else 0, 1024):
                score = q[at : at + 1024] @ x.T
                score[(ids[at : at + 1024, None] == stored[None, :]) | (score < least) | ~q[at : at + 1024].any(1)[:, None]] = -np.inf
                if score.shape[1] > k:  # all that ties with the k-th stays; the smaller ids win below
                    kth = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
                    score[score < kth] = -np.inf
                i, j = np.nonzero(score > -np.inf)
                rank = np.lexsort((stored[j], -score[i, j], i))
                i, j = i[rank], j[rank]
                best = np.arange(len(i)) - np.searchsorted(i, i) < k
                for c, v in zip(out, (ids[at + i[best]], stored[j[best]], score[i[best], j[best]]), strict=True):
                    out[c].append(v)
            return pa.table({c: np.concatenate(v) if v else np.zeros(0, np.float64 if c == "score" else np.int64) for c, v in out.items()}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64()), ("score", pa.float64())]))

        found = asked.groupBy("cell", "block").cogroup(dealt.groupBy("cell", "block")).applyInArrow(product, "a long, b long, score double")
        return _best(found, k)


def _best(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy("a").orderBy(F.desc("score"), "b"))
    return found.withColumn("_r", place).filter(F.col("_r") <= k).drop("_r")


def _in_cells(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Rows (id, v, ...) with the cell of the nearest centroid and the angle to it."""
    told = rows.sparkSession.sparkContext.broadcast(centroids)

    @F.pandas_udf("cell int, angle double")
    def nearest(v):
        import pandas as pd

        at, angles = [], []
        for k in range(0, len(v), 2048):
            unit = _unit(pa.array(v.iloc[k : k + 2048].tolist(), pa.list_(pa.float64())))
            s = unit @ told.value.T
            own = np.argmax(s, axis=1)
            at.append(own)
            angles.append(np.arccos(np.clip(s[np.arange(len(own)), own], -1, 1)))
        return pd.DataFrame({"cell": np.concatenate(at).astype(np.int32), "angle": np.concatenate(angles)}) if at else pd.DataFrame({"cell": np.zeros(0, np.int32), "angle": np.zeros(0)})

    return rows.withColumn("_c", nearest("v")).select("*", "_c.cell", "_c.angle").drop("_c")


def _probed(queries: DataFrame, centroids: np.ndarray, probes: int, every: bool) -> DataFrame:
    """(cell, id, v, s, near) for each query and its nearest cells, or with ``every`` all: similarity to the centroid, and whether the cell is among the nearest."""
    told = queries.sparkSession.sparkContext.broadcast(centroids)
    step = max(1, PAIRS // len(centroids))

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                s = _unit(part.column("v")) @ told.value.T
                order = np.argsort(-s, axis=1, kind="stable")[:, : None if every else probes]
                row = np.repeat(np.arange(len(order)), order.shape[1])
                near = np.tile(np.arange(order.shape[1]) < probes, len(order))
                yield pa.RecordBatch.from_arrays([pa.array(order.ravel().astype(np.int32)), part.column("id").take(row), part.column("v").take(row), pa.array(np.take_along_axis(s, order, axis=1).ravel()), pa.array(near)], names=["cell", "id", "v", "s", "near"])

    rows = queries.select(F.col("id").cast("long").alias("id"), "v")
    return rows.mapInArrow(ranked, f"cell int, id long, v {rows.schema['v'].dataType.simpleString()}, s double, near boolean")


def build_index(rows: DataFrame, k: int = 10, recall: float = RECALL, cells: int | None = None, sample: int = SAMPLE) -> VectorIndex:
    """Index of rows (id, v, ...): all of them are stored, but those whose vector is null.

    Centroids and the number of cells to probe come from at most ``sample``
    vectors, chosen by a hash of the id.
    """
    rows = rows.filter("v is not null")
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow()["v"]
    unit = _unit(picked)
    cells = cells or max(1, min(CELLS, len(unit), math.isqrt(rows.count())))
    centroids = fit_centroids(unit, cells) if len(picked) else np.zeros((1, 1))
    return VectorIndex(rows.sparkSession, centroids, probes_for(unit, centroids, k, recall) if len(picked) else 1, staged(_in_cells(rows, centroids)))


@query("index_topk", f"""
SELECT a, b, round(s, 4) AS score FROM (SELECT a.vec_id AS a, b.vec_id AS b, {_COS} AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS r
 FROM embeddings a JOIN embeddings b ON a.vec_id != b.vec_id WHERE a.vec_id % 50 = 0) WHERE r <= 5""")
def index_topk(t, spark):
    """The five nearest of each query vector by the index with bounds: exact."""
    v = vectors(t)
    return build_index(v, k=5).search(v.filter("id % 50 = 0"), 5, exact=True).select("a", "b", F.round("score", 4).alias("score"))


@query("index_topk_filtered", f"""
SELECT a, b, round(s, 4) AS score FROM (SELECT a.vec_id AS a, b.vec_id AS b, {_COS} AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS r
 FROM embeddings a JOIN embeddings b ON a.vec_id != b.vec_id WHERE a.vec_id % 50 = 0 AND b.label < 3 AND {_COS} >= 0.05) WHERE r <= 5""")
def index_topk_filtered(t, spark):
    """As ``index_topk``, among vectors of some labels, after the index was saved, read back and brought up to date by a change."""
    rows = t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    path = fresh_path(spark, "index")
    build_index(rows.filter("id % 7 != 3"), k=5).save(path)
    index = VectorIndex.load(spark, path).with_rows(added=rows.filter("id % 7 = 3 or id % 11 = 0"))
    return index.search(vectors(t).filter("id % 50 = 0"), 5, 0.05, where="label < 3", exact=True).select("a", "b", F.round("score", 4).alias("score"))


@query("ann_topk")
def ann_topk(t, spark):
    """The five nearest in the probed cells: nearly all of ``index_topk``'s, as tests measure."""
    v = vectors(t)
    return build_index(v, k=5).search(v.filter("id % 50 = 0"), 5).select("a", "b", F.round("score", 4).alias("score"))


@query("pairs_within", f"SELECT a.vec_id AS a, b.vec_id AS b, round({_COS}, 4) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {_COS} >= 0.4")
def pairs_within(t, spark):
    """All pairs alike by 0.4 or more, cell by cell."""
    v = vectors(t)
    return build_index(v).within(v, 0.4, later_only=True).select("a", "b", F.round("score", 4).alias("score"))
