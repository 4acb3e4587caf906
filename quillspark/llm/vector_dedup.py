"""Near duplicates among vectors by binary codes of random rotations.

Equal vectors of one label are one class.  A class is rotated at random; the
signs are its code, and the inner product of code and vector is stored beside
it as the correction factor.  Classes meet in buckets of the first bits of a
code, where each also stands under the flips of its least certain bits.  In a
bucket the other's quantised coordinates give an unbiased estimate of the
cosine with a bound; only pairs whose bound reaches the threshold are
computed again in double precision, and only these can link.

A pair is judged in one bucket alone, so counts add up and no pair leaves a
task: what comes out are sums and the ties of a forest.  The classes of a
large bucket that lie within half the angle around its first one are linked
with each other for certain; they form a ball that is counted by its size.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.llm.common import free_name, spread, stage
from quillspark.llm.components import components

THRESHOLD = 0.93
#: Share of pairs at the very threshold that must meet; closer pairs meet more often.
RECALL = 0.995
#: Bits of a key that a class takes both ways, and bits beyond those that number the rows, so that buckets stay small.
FLIPS, ROOM = 2, 3
#: Standard deviations in the bound of an estimate.
SIGMAS = 4.5
#: Levels of a quantised coordinate as a power of two.
QUERY_BITS = 4
#: Classes of a bucket that one task compares with each other.
BLOCK = 4096
#: Rows of buckets and linked pairs held at a time.
LOT, PAIRS = 1 << 14, 1 << 20
_SEED = 20240229


@functools.lru_cache(maxsize=64)
def rotation(dims: int, r: int) -> np.ndarray:
    """A random rotation; the same in every task."""
    q, up = np.linalg.qr(np.random.default_rng([_SEED, dims, r]).normal(size=(dims, dims)))
    return q * np.sign(np.diag(up))


def padded(dims: int) -> int:
    return max(64, -(-dims // 64) * 64)


def _keys(turned: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """First bits of the code as a number, and the mask of the ones nearest to zero."""
    head = turned[:, :bits]
    weight = np.int64(1) << np.arange(bits, dtype=np.int64)
    code = ((head > 0) * weight).sum(1)
    unsure = np.argsort(np.abs(head), axis=1, kind="stable")[:, :FLIPS]
    return code, weight[unsure].sum(1)


@functools.lru_cache(maxsize=16)
def rounds(bits: int, dims: int, threshold: float, recall: float = RECALL) -> int:
    """Rotations that let a pair at the threshold meet with the wanted probability, from 20,000 random pairs."""
    rng = np.random.default_rng(_SEED)
    x, z = (rng.normal(size=(20_000, dims)) for _ in range(2))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    y = threshold * x + math.sqrt(1 - threshold**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    (a, am), (b, bm) = _keys(x, bits), _keys(y, bits)
    met = float((((a ^ b) & ~(am | bm)) == 0).mean())
    return 1 if met >= recall else math.ceil(math.log(1 - recall) / math.log(1 - max(met, 1e-4)))


def _units(column: pa.Array, dims: int) -> np.ndarray:
    """Unit vectors of equally long lists, filled up with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dims)
    # The largest part first, so that squares neither overflow nor vanish.
    flat = flat / np.abs(flat).max(1, keepdims=True)
    out = np.zeros((len(flat), padded(dims)))
    out[:, :dims] = flat / np.sqrt((flat * flat).sum(1, keepdims=True))
    return out


def _coded(classes: DataFrame, dims: int, bits: int, n: int) -> DataFrame:
    """(cid, lab, v) -> (lab, r, bits, cid, code, factor): a class under each of its keys."""
    types = [("lab", pa.string()), ("r", pa.int32()), ("bits", pa.int64()), ("cid", pa.int64()), ("code", pa.binary()), ("factor", pa.float32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                unit = _units(b.column("v"), dims)
                for r in range(n):
                    turned = unit @ rotation(unit.shape[1], r).T
                    code, mask = _keys(turned, bits)
                    factor = np.abs(turned).sum(1) / math.sqrt(turned.shape[1])
                    packed = pa.array([x.tobytes() for x in np.packbits(turned > 0, axis=1)], pa.binary())
                    # All settings of the masked bits: the masks' subsets in turn.
                    subset = np.zeros(len(mask), np.int64)
                    for _ in range(1 << FLIPS):
                        yield pa.RecordBatch.from_arrays(
                            [b.column("lab").cast(pa.string()), pa.array(np.full(len(mask), r, np.int32)), pa.array((code & ~mask) | subset), b.column("cid"), packed, pa.array(factor.astype(np.float32))], names=[k for k, _ in types]
                        )
                        subset = (subset - mask) & mask

    return classes.select("cid", "lab", "v").mapInArrow(run, "lab string, r int, bits long, cid long, code binary, factor float")


def _quantised(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bit planes, step, least value and sum of levels of coordinates rounded at random, so that the mean is right."""
    low, high = turned.min(1), turned.max(1)
    step = np.maximum((high - low) / ((1 << QUERY_BITS) - 1), 1e-12)
    noise = np.random.default_rng(_SEED).random(turned.shape)
    level = np.minimum(np.floor((turned - low[:, None]) / step[:, None] + noise), (1 << QUERY_BITS) - 1).astype(np.uint8)
    planes = np.stack([np.packbits((level >> k) & 1, axis=1).view(np.uint64) for k in range(QUERY_BITS)], axis=1)
    return planes, step, low, level.sum(1, dtype=np.int64)


def estimates(code: np.ndarray, factor: np.ndarray, planes: np.ndarray, step: np.ndarray, low: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased cosines of coded vectors with quantised ones, row by row, and the bounds of their errors."""
    dims = code.shape[1] * 64
    ones = np.bitwise_count(code).sum(1, dtype=np.int64)
    hits = sum(np.bitwise_count(code & planes[:, k]).sum(1, dtype=np.int64) << k for k in range(QUERY_BITS))
    root = math.sqrt(dims)
    dot = 2 * step / root * hits + 2 * low / root * ones - step / root * total - root * low
    # The code's error falls with the dimension, the rounding's is at most a step for each coordinate.
    spread_of = np.sqrt(np.maximum(1 - factor**2, 0)) / factor / math.sqrt(dims - 1) + step / 2 / factor
    return dot / factor, SIGMAS * spread_of


def _judged(rows: dict[str, np.ndarray], unit: np.ndarray, bits: int, n: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of linked pairs of one lot of whole buckets, some at a time, each pair in the one bucket where it counts."""
    count = len(unit)
    code = np.empty((n, count), np.int64)
    mask = np.empty((n, count), np.int64)
    planes = np.empty((count, QUERY_BITS, unit.shape[1] // 64), np.uint64)
    step, low, total = np.empty(count), np.empty(count), np.empty(count, np.int64)
    for r in range(n):
        turned = unit @ rotation(unit.shape[1], r).T
        code[r], mask[r] = _keys(turned, bits)
        here = rows["r"] == r
        if here.any():
            planes[here], step[here], low[here], total[here] = _quantised(turned[here])
    bucket_end = np.append(np.flatnonzero((np.diff(rows["kid"]) != 0) | (np.diff(rows["part"]) != 0)) + 1, count)
    end = bucket_end[np.searchsorted(bucket_end, np.arange(count), side="right")]
    xs, ys, size = [], [], 0
    live = np.arange(count)
    for offset in range(1, count):
        live = live[live + offset < end[live]]
        if not len(live):
            break
        x, y = live, live + offset
        at = rows["r"][x]
        key = (code[at, x] & ~mask[at, x]) | (code[at, y] & mask[at, x] & ~mask[at, y])
        good = (key == rows["bits"][x]) & (rows["cell"][x] | (rows["side"][x] != rows["side"][y])) & ((rows["ball"][x] != rows["ball"][y]) | (rows["ball"][x] < 0))
        x, y, at = x[good], y[good], at[good]
        if n > 1 and len(x):
            before = ((((code[:, x] ^ code[:, y]) & ~(mask[:, x] | mask[:, y])) == 0) & (np.arange(n)[:, None] < at)).any(0)
            x, y = x[~before], y[~before]
        if len(x):
            one = estimates(rows["code"][x], rows["factor"][x], planes[y], step[y], low[y], total[y])
            two = estimates(rows["code"][y], rows["factor"][y], planes[x], step[x], low[x], total[x])
            open_ = np.minimum(one[0] + one[1], two[0] + two[1]) >= threshold
            x, y = x[open_], y[open_]
        if len(x):
            linked = np.einsum("ij,ij->i", unit[x], unit[y]) >= threshold
            xs.append(x[linked])
            ys.append(y[linked])
            size += len(xs[-1])
        if size >= PAIRS:
            yield np.concatenate(xs), np.concatenate(ys)
            xs, ys, size = [], [], 0
    if size:
        yield np.concatenate(xs), np.concatenate(ys)


def hooked(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Lowers labels to the least number that each reaches by these pairs and those before."""
    while True:
        a, b = label[x], label[y]
        move = a != b
        if not move.any():
            return
        np.minimum.at(label, np.maximum(a, b)[move], np.minimum(a, b)[move])
        while (label[label] != label).any():
            label = label[label]


def _compared(cells: DataFrame, dims: int, bits: int, n: int, threshold: float) -> DataFrame:
    """(place, kid, part, r, bits, cell, side, ball, cid, w, code, factor, v) in order of place -> (cid, other, links): sums for a class, ties of a forest where ``other`` is set."""

    def lot_of(table: pa.Table) -> pa.RecordBatch:
        rows = {k: table[k].to_numpy() for k in ("place", "r", "bits", "cell", "side", "ball", "cid", "w", "factor", "kid", "part")}
        rows["cell"] = rows["cell"].astype(bool)
        rows["factor"] = rows["factor"].astype(np.float64)
        rows["code"] = np.frombuffer(b"".join(table["code"].to_pylist()), np.uint64).reshape(len(rows["r"]), -1)
        unit = _units(table["v"].combine_chunks(), dims)
        ids, own = np.unique(rows["cid"], return_inverse=True)
        weight, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for x, y in _judged(rows, unit, bits, n, threshold):
            np.add.at(weight, own[x], rows["w"][y])
            np.add.at(weight, own[y], rows["w"][x])
            hooked(label, own[x], own[y])
        some, tied = np.flatnonzero(weight), np.flatnonzero(label != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([ids[some], ids[tied]])), pa.array([None] * len(some) + ids[label[tied]].tolist(), pa.int64()), pa.array(np.concatenate([weight[some], np.zeros(len(tied), np.int64)]))], names=["cid", "other", "links"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size < LOT:
                continue
            table = pa.Table.from_batches(held)
            place = table["place"].to_numpy()
            cut = int(np.searchsorted(place, place[-1]))  # the last bucket may go on
            if cut:
                yield lot_of(table.slice(0, cut))
            held = table.slice(cut).to_batches()
            size -= cut
        if size:
            yield lot_of(pa.Table.from_batches(held))

    return cells.mapInArrow(run, "cid long, other long, links long")


def _cosine(a: str, b: str):
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    return dot(a, b) / F.sqrt(dot(a, a)) / F.sqrt(dot(b, b))


def _links(classes: DataFrame, dims: int, threshold: float, block: int) -> tuple[DataFrame, DataFrame]:
    """(cid, lab, v, w) of one dimension -> (cid, links) to be summed and (x, y) ties."""
    spark = classes.sparkSession
    most = classes.groupBy("lab").count().agg(F.max("count")).first()[0] or 1
    bits = min(FLIPS + ROOM + math.ceil(math.log2(max(most, 2))), padded(dims) - 1, 62)
    n = rounds(bits, padded(dims), threshold)
    key = ["lab", "r", "bits"]
    keys = stage(_coded(classes, dims, bits, n))
    # A key that one class holds alone needs no other look.
    met = stage(keys.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("cid").alias("lead")).filter("n > 1").withColumn("kid", F.monotonically_increasing_id()))
    rows = keys.join(met.drop("lead"), key)
    ball = spark.createDataFrame([], "cid long, ball long")
    hot = met.filter(F.col("n") > block)
    cells = rows.select("kid", F.lit(0).cast("long").alias("part"), "r", "bits", F.lit(1).alias("cell"), F.lit(0).alias("side"), "cid", "code", "factor", F.lit(-1).cast("long").alias("ball"))
    if not hot.isEmpty():
        # Where the angle to a bucket's first class is at most half the threshold's, any two are linked.
        half = math.cos(math.acos(threshold) / 2) + 1e-9
        near = keys.join(hot.select(*key, "lead"), key).select("cid", "lead").distinct()
        near = near.join(classes.select("cid", "v"), "cid").join(classes.select(F.col("cid").alias("lead"), F.col("v").alias("u")), "lead")
        ball = stage(near.filter(_cosine("v", "u") >= half).groupBy("cid").agg(F.min("lead").alias("ball")))
        rows = stage(rows.join(ball, "cid", "left").withColumn("ball", F.coalesce("ball", F.lit(-1))))
        # In a large bucket the most frequent ball needs no comparison within; it meets the rest block by block.
        sizes = rows.filter(F.col("n") > block).groupBy("kid", "ball").agg(F.count(F.lit(1)).alias("k"))
        split = sizes.groupBy("kid").agg(F.max_by(F.struct("ball", "k"), F.struct((F.col("ball") >= 0).alias("is"), "k", "ball")).alias("x"), F.sum("k").alias("all"))
        held = F.when(F.col("x.ball") >= 0, F.col("x.k")).otherwise(0)
        cuts = lambda count: F.greatest(F.lit(1), F.ceil(count / block)).cast("int")
        split = split.select("kid", F.when(held > 0, F.col("x.ball")).otherwise(-2).alias("major"), cuts(held).alias("a"), cuts(F.col("all") - held).alias("b"), (F.col("all") > held).alias("mixed"))
        big = rows.join(split, "kid").withColumn("side", F.when(F.col("ball") == F.col("major"), 0).otherwise(1))
        own = F.pmod(F.xxhash64("cid"), F.when(F.col("side") == 0, F.col("a")).otherwise(F.col("b"))).cast("int")
        upto = lambda count: F.sequence(F.lit(0), count - 1)
        # Cells: a block of the ball against a block of the rest, or two blocks of the rest; blocks of the ball never meet.
        place = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"))
        big = big.withColumn("own", own).filter("mixed")
        with_ball = F.when(F.col("major") >= 0, upto(F.col("a"))).otherwise(F.array().cast("array<int>"))
        places = F.when(F.col("side") == 0, F.transform(upto(F.col("b")), lambda j: place(0, F.col("own"), j))).otherwise(
            F.concat(F.transform(with_ball, lambda i: place(0, i, F.col("own"))), F.transform(upto(F.col("b")), lambda j: place(1, F.least("own", j), F.greatest("own", j))))
        )
        big = big.select("kid", "r", "bits", "side", "own", "cid", "code", "factor", "ball", F.explode(places).alias("p"))
        side = F.when(F.col("p.kind") == 0, F.col("side")).otherwise((F.col("own") == F.col("p.i")).cast("int"))
        big = big.select("kid", F.xxhash64("p.kind", "p.i", "p.j").alias("part"), "r", "bits", ((F.col("p.kind") == 1) & (F.col("p.i") == F.col("p.j"))).cast("int").alias("cell"), side.alias("side"), "cid", "code", "factor", "ball")
        small = rows.filter(F.col("n") <= block).select("kid", F.lit(0).cast("long").alias("part"), "r", "bits", F.lit(1).alias("cell"), F.lit(0).alias("side"), "cid", "code", "factor", "ball")
        cells = small.unionByName(big)
    full = cells.join(classes.select("cid", "w", "v"), "cid")
    # Lots are cut where the hash changes; buckets and cells in them are told apart by their numbers.
    dealt = full.withColumn("place", F.xxhash64("kid", "part")).repartition(spread(classes), "kid", "part").sortWithinPartitions("place", "kid", "part")
    found = stage(_compared(dealt.select("place", "kid", "part", "r", "bits", "cell", "side", "ball", "cid", "w", "code", "factor", "v"), dims, bits, n, threshold))
    weights = found.filter("other is null").select("cid", "links")
    ties = found.filter("other is not null").select(F.col("cid").alias("x"), F.col("other").alias("y"))
    if not hot.isEmpty():
        inside = ball.join(classes.select("cid", "w"), "cid")
        per = inside.groupBy("ball").agg(F.sum("w").alias("all"), F.min("cid").alias("first"))
        inside = stage(inside.join(per, "ball"))
        weights = weights.unionByName(inside.select("cid", (F.col("all") - F.col("w")).alias("links")))
        ties = ties.unionByName(inside.filter("cid != first").select(F.col("cid").alias("x"), F.col("first").alias("y")))
    return weights, ties


def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", block: int = BLOCK) -> DataFrame:
    """All columns of ``vectors`` but the vector, with n_links, component_id and kept.

    Vectors link where labels are equal and not null, lengths are equal and
    the cosine is at least ``threshold``.  Vectors that are null, empty, zero
    or hold a null, NaN or infinity link with nothing, as do those without a
    label: n_links 0, component_id their own id.  Copies and repeated ids
    count as rows of their own; ``component_id`` is the least id reachable,
    null ids aside, and a row is kept whose id it is.  No link is false; at
    least ``RECALL`` of the pairs at the threshold are found, more above it.
    Columns named as results move aside by an underscore.
    """
    rest = [c for c in vectors.columns if c.lower() not in (vector.lower(), vec_id.lower(), label.lower())]
    taken = {"n_links", "component_id", "kept", "vec_id"}
    own = F.col(vector).cast("array<double>")
    fine = F.size(own) > 0
    fine &= F.forall(own, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(own, lambda x: x != 0) & F.col(label).isNotNull()
    rows = vectors.select(F.col(vec_id).alias("_id"), F.struct(F.col(label), *[F.col(c).alias(free_name(vectors, c + "_") if c.lower() in taken else c) for c in rest]).alias("_rest"), F.when(F.coalesce(fine, F.lit(False)), own).alias("_v"), F.col(label).cast("string").alias("_lab"))
    good = rows.filter("_v is not null")
    classes = good.groupBy(F.col("_lab").alias("lab"), F.col("_v").alias("v")).agg(F.min("_id").alias("first"), F.count(F.lit(1)).alias("w"))
    classes = stage(classes.withColumn("dims", F.size("v")).withColumn("cid", F.monotonically_increasing_id()))
    weights = ties = None
    # One pass for each length of vectors; nearly always there is one.
    for (dims,) in classes.select("dims").distinct().collect():
        w, t = _links(classes.filter(F.col("dims") == dims), dims, threshold, block)
        weights, ties = (w, t) if weights is None else (weights.unionByName(w), ties.unionByName(t))
    if weights is None:
        out = rows.withColumn("n_links", F.lit(0).cast("long")).withColumn("component_id", F.col("_id"))
    else:
        label_of = components(ties)
        known = classes.select("cid", "lab", "v", "first", "w").join(label_of.withColumnRenamed("x", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
        least = known.groupBy("label").agg(F.min("first").alias("component"))
        known = known.join(least, "label").join(weights.groupBy("cid").agg(F.sum("links").alias("links")), "cid", "left")
        known = stage(known.select(F.col("lab").alias("_lab"), F.col("v").alias("_v"), (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.col("component").alias("_component")))
        out = rows.join(known, ["_lab", "_v"], "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long")).withColumn("component_id", F.when(F.col("_v").isNotNull(), F.col("_component")).otherwise(F.col("_id")))
        out = out.withColumn("component_id", F.coalesce("component_id", "_id"))
    return out.select(F.col("_id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("_id") == F.col("component_id"), F.lit(False)).alias("kept"), "_rest.*")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of all rows of ``embeddings``."""
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).select("vec_id", "n_links", "component_id", "kept")


_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
ORACLE = f"""
WITH RECURSIVE g AS (SELECT vec_id, embedding, label FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x != 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id != b.vec_id AND {_COS} >= {THRESHOLD}),
r AS (SELECT vec_id AS id, vec_id AS reach FROM embeddings UNION SELECT r.id, e.b FROM r JOIN e ON r.reach = e.a),
c AS (SELECT id, min(reach) AS component_id FROM r GROUP BY id), n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT id AS vec_id, coalesce(n, 0) AS n_links, component_id, id = component_id AS kept FROM c LEFT JOIN n ON a = id"""
