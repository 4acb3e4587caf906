"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(bias + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), where x
marks the distinct hashed terms of a text.  The pairwise part learns what an
insult together with a group mention means, which additive weights miss.
It is fitted by gradient steps on a bounded labelled sample; only
term numbers reach the driver.  All rows are scored batch by batch.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.llm.common import position
from quillspark.llm.training import MOST_ROWS, held_out, labelled_sample

#: Hashed terms and factors of each.
TERMS, FACTORS = 1 << 18, 4
#: Steps, their size, and the pull of weights and factors to zero.
STEPS, RATE, DECAY = 400, 0.05, 1e-5
#: A term is learnt from so many rows, and standard errors off the mean, at least.
LEAST_ROWS, LEAST_Z = 3, 4.0
#: The same for a term beside another one, and how many of the most frequent terms are paired.
LEAST_PAIRS, PAIR_Z, PAIRED = 20, 7.0, 1024
#: Words remembered by a worker.
MEMO = 300_000

_WORD = re.compile(r"\w+")


class TermHasher:
    """Distinct hashed terms (lower-cased words) of texts."""

    def __init__(self, terms: int = TERMS):
        self.terms, self.memo = terms, {}

    def of(self, text: str) -> np.ndarray:
        memo, out = self.memo, []
        if len(memo) > MEMO:
            memo.clear()
        for word in set(_WORD.findall(text.lower())):
            term = memo.get(word)
            if term is None:
                term = memo[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % self.terms
            out.append(term)
        return np.unique(np.array(out, np.int32))


@dataclass
class FactorizationMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margin(self, terms: np.ndarray) -> float:
        v = self.factors[terms]
        return self.bias + float(self.linear[terms].sum()) + 0.5 * float((v.sum(0) ** 2 - (v**2).sum(0)).sum())

    def score(self, terms: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(terms), -35, 35))))


def informative(rows: list[np.ndarray], y: np.ndarray, terms: int) -> np.ndarray:
    """Terms that tell of the label alone or together with another term.

    Alone: the labels of a term's rows differ from the mean by more than
    LEAST_Z standard errors; among tens of thousands of terms chance passes
    that bar for one or two.  Together: of the PAIRED most frequent of the
    other terms, those with which the labels of another such term's rows, or
    of the rows of a term that tells alone, differ by more than PAIR_Z from
    what they are without it, and so by more than chance does among all those
    pairs.  The rest would only be learnt by heart.
    """
    flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    seen, share = np.bincount(flat, minlength=terms), y.mean()
    excess = np.bincount(flat, (y - share)[owner], terms)
    z = np.abs(excess) / np.sqrt(np.maximum(seen * share * (1 - share) * (1 - seen / (len(y) + 1)), 1e-9))
    known = np.flatnonzero((seen >= LEAST_ROWS) & (z > LEAST_Z))
    others = np.setdiff1d(np.argsort(-seen, kind="stable")[:PAIRED], known)
    others = others[(seen[others] >= LEAST_PAIRS) & (seen[others] < len(rows))]
    leading = np.concatenate([others, known[np.argsort(-seen[known], kind="stable")[:PAIRED]]])

    def marks(names: np.ndarray) -> np.ndarray:
        place = np.full(terms, -1, np.int64)
        place[names] = np.arange(len(names))
        x = np.zeros((len(rows), len(names)), np.float32)
        at = place[flat] >= 0
        x[owner[at], place[flat[at]]] = 1
        return x

    x, beside = marks(others), marks(leading)
    n = beside.sum(0)[:, None]
    mean = (beside.T @ y[:, None].astype(np.float32)) / np.maximum(n, 1)
    both, labels = beside.T @ x, (beside * y[:, None].astype(np.float32)).T @ x
    spread = np.clip(mean * (1 - mean), 0.05, None)
    pair = np.abs(labels - both * mean) / np.sqrt(np.maximum(both * spread * (1 - both / (n + 1)), 1e-9))
    tells = ((both >= LEAST_PAIRS) & (n - both >= LEAST_PAIRS) & (pair > PAIR_Z)).any(0)
    return np.union1d(known, others[tells])


def fit(rows: list[np.ndarray], y: np.ndarray, terms: int = TERMS, seed: int = 7) -> FactorizationMachine:
    """Fits bias, weights and factors together, over all rows at each step.

    Terms that tell nothing stay at zero.  Without both classes, the smoothed
    share of label 1 is the score of all; without rows, 0.5.
    """
    model = FactorizationMachine(0.0, np.zeros(terms), np.zeros((terms, FACTORS)))
    if not len(y) or y.min() == y.max():
        model.bias = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))) if len(y) else 0.0
        return model
    names = informative(rows, y, terms)
    m, n = len(names), len(y)
    place = np.full(terms, -1, np.int64)
    place[names] = np.arange(m)
    kept = [p[p >= 0] for p in (place[r] for r in rows)]
    idx, row = np.concatenate(kept), np.repeat(np.arange(n), [len(k) for k in kept])
    rng = np.random.default_rng(seed)
    at = np.concatenate([[np.log(y.mean() / (1 - y.mean()))], np.zeros(m), rng.normal(0, 0.05, m * FACTORS)])
    first, second = np.zeros_like(at), np.zeros_like(at)
    for step in range(1, STEPS + 1):
        w, v = at[1 : m + 1], at[m + 1 :].reshape(m, FACTORS)
        vi = v[idx]
        sums = np.stack([np.bincount(row, vi[:, f], n) for f in range(FACTORS)], 1)
        margin = at[0] + np.bincount(row, w[idx], n) + 0.5 * ((sums**2).sum(1) - np.bincount(row, (vi**2).sum(1), n))
        error = (1 / (1 + np.exp(-np.clip(margin, -35, 35))) - y) / n
        e = error[row]
        gv = np.stack([np.bincount(idx, e * (sums[row, f] - vi[:, f]), m) for f in range(FACTORS)], 1)
        grad = np.concatenate([[error.sum()], np.bincount(idx, e, m) + DECAY * w, (gv + DECAY * v).ravel()])
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        at = at - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    model.bias, model.linear[names], model.factors[names] = float(at[0]), at[1 : m + 1], at[m + 1 :].reshape(m, FACTORS)
    return model


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = TermHasher()
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([hasher.of(t.as_py() or "") for t in b.column(0)], pa.list_(pa.int32())), b.column(1)], names=["terms", "y"])


def fit_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", most: int = MOST_ROWS) -> FactorizationMachine:
    """Fits on at most ``most`` labelled rows outside the held-out fold."""
    rows = labelled_sample(docs, labels, label, doc_id, text, most).mapInArrow(_terms, "terms array<int>, y int").toArrow()
    terms = [np.asarray(r.values, np.int64) for r in rows["terms"]]
    y = rows["y"].to_numpy().astype(np.float64)
    order = sorted(range(len(y)), key=lambda k: (y[k], terms[k].tobytes()))  # rows arrive in no fixed order
    return fit([terms[k] for k in order], y[order])


def score_toxicity(docs: DataFrame, model: FactorizationMachine, text: str = "text", score: str = "score") -> DataFrame:
    """All columns of ``docs`` and the probability of label 1; null counts as empty.  No shuffle.

    The broadcast model holds TERMS rows, whatever the input.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.linear.astype(np.float32), model.factors.astype(np.float32)))
    names = [c for c in docs.columns if c.lower() != score.lower()]
    at = position(docs, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, fm = TermHasher(), FactorizationMachine(*shared.value)
        for b in batches:
            scores = [fm.score(hasher.of(t.as_py() or "")) for t in b.column(at)]
            kept = [b.column(k) for k, c in enumerate(b.schema.names) if c.lower() != score.lower()]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(scores, pa.float64())], names=[*names, score])

    schema = docs.select(*names).withColumn(score, F.lit(0.0)).schema
    return docs.mapInArrow(run, schema)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
