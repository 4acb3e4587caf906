"""Quality classifier: a sparse ensemble of rules.

Statistics of the text are Spark columns.  Shallow trees are boosted on a
bounded labelled sample, every path from a root to a node becomes a
conjunctive rule over the statistics, a lasso-penalised logistic regression
keeps the few rules that matter, and those are compiled into one Spark
column expression that scores all rows inside the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillspark.llm.common import free_name
from quillspark.llm.training import MOST_ROWS, held_out, labelled_sample

#: Shape of the ensemble.
TREES, DEPTH, BINS, LEARNING_RATE, LEAST_LEAF = 24, 3, 32, 0.3, 20
#: Lasso penalty a row, and steps of its solver.
PENALTY, STEPS = 1e-3, 400


def _gone(text: Column, pattern: str) -> Column:
    """Number of characters that the pattern matches."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _literal(text: Column, s: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(s), F.lit("")))


def statistics(text: Column, words: Column) -> dict[str, Column]:
    """Statistics of a non-null text and its words; an empty text has zeros throughout."""
    n, w = F.greatest(F.length(text), F.lit(1)), F.greatest(F.size(words), F.lit(1))
    again = F.size(F.filter(F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: a == b), lambda same: same))
    return {
        "log_chars": F.log1p(F.length(text).cast("double")),
        "word_chars": F.length(text) / w,
        "upper": _gone(text, r"\p{Lu}+") / n,
        "digits": _gone(text, "[0-9]+") / n,
        "symbols": _gone(text, r"[#$%&*+<=>@\[\\\]^_`{|}~]+") / n,
        "bars": _literal(text, "|") / n,
        "bangs": _literal(text, "!") / n,
        "stops": _literal(text, ".") / w,
        "commas": _literal(text, ",") / w,
        "lines": _literal(text, "\n") / w,
        "distinct": F.size(F.array_distinct(words)) / w,
        "repeats": again / w,
    }


def with_statistics(df: DataFrame, text: str = "body") -> tuple[DataFrame, dict[str, str]]:
    """Adds the statistics as columns under free names, which are told for each statistic."""
    split = free_name(df, "stat_words")
    out = df.withColumn(split, F.when(F.trim(text) == "", F.array().cast("array<string>")).otherwise(F.split(F.trim(text), "[ \\t-\\r]+")))
    stats = statistics(F.col(text), F.col(split))
    names = {k: free_name(df, f"stat_{k}") for k in stats}
    return out.withColumns({names[k]: v.cast("double") for k, v in stats.items()}).drop(split), names


@dataclass(frozen=True)
class RuleEnsemble:
    """Weighted conjunctions of (statistic, is above, threshold)."""

    bias: float
    rules: tuple[tuple[float, tuple[tuple[str, bool, float], ...]], ...]

    def column(self, names: dict[str, str]) -> Column:
        """Probability of label 1 as a column over the statistics, which stand in columns of these names."""
        total = F.lit(self.bias)
        for weight, conditions in self.rules:
            test = F.lit(True)
            for name, above, at in conditions:
                test = test & ((F.col(names[name]) > F.lit(at)) if above else (F.col(names[name]) <= F.lit(at)))
            total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def used(self) -> list[str]:
        return sorted({c[0] for _, cs in self.rules for c in cs})


def _paths(x: np.ndarray, residual: np.ndarray, cuts: list[np.ndarray], binned: np.ndarray) -> tuple[list[tuple], np.ndarray]:
    """The conditions of every node below the root of one regression tree, and the tree's prediction."""
    found: list[tuple] = []
    predicted = np.zeros(len(x))
    todo = [((), np.arange(len(x)))]
    while todo:
        path, rows = todo.pop()
        best = None
        if len(path) < DEPTH and len(rows) >= 2 * LEAST_LEAF:
            whole, count = residual[rows].sum(), len(rows)
            for j, at in enumerate(cuts):
                if not len(at):
                    continue
                n = np.bincount(binned[rows, j], minlength=len(at) + 1).cumsum()[:-1]
                s = np.bincount(binned[rows, j], residual[rows], minlength=len(at) + 1).cumsum()[:-1]
                fine = (n >= LEAST_LEAF) & (count - n >= LEAST_LEAF)
                gain = np.where(fine, s**2 / np.maximum(n, 1) + (whole - s) ** 2 / np.maximum(count - n, 1) - whole**2 / count, -1.0)
                k = int(gain.argmax())
                if gain[k] > 1e-9 and (best is None or gain[k] > best[0]):
                    best = (gain[k], j, k)
        if best is None:
            predicted[rows] = residual[rows].mean() if len(rows) else 0.0
            continue
        _, j, k = best
        left = binned[rows, j] <= k
        for above, part in ((False, rows[left]), (True, rows[~left])):
            found.append((*path, (j, above, float(cuts[j][k]))))
            todo.append((found[-1], part))
    return found, predicted


def _lasso(x: np.ndarray, y: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """Weights and bias of the penalised logistic loss, by accelerated proximal steps; the bias is free."""
    n, m = x.shape
    step = 4 * n / max(float(np.linalg.norm(np.hstack([x, np.ones((n, 1))]), 2)) ** 2, 1e-9)
    w = seen = np.zeros(m + 1)
    w[m] = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    t = 1.0
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ seen[:m] + seen[m], -30, 30)))
        moved = seen - step * np.append(x.T @ (p - y), (p - y).sum()) / n
        moved[:m] = np.sign(moved[:m]) * np.maximum(np.abs(moved[:m]) - step * penalty, 0)
        ahead = (1 + np.sqrt(1 + 4 * t * t)) / 2
        seen, w, t = moved + (t - 1) / ahead * (moved - w), moved, ahead
    return w[:m], float(w[m])


def fit(x: np.ndarray, y: np.ndarray, names: list[str]) -> RuleEnsemble:
    """Rules from boosted trees, weighted by the lasso.

    Without rows the score is 0.5 everywhere; with one class alone it is
    that class's smoothed share.
    """
    if not len(y):
        return RuleEnsemble(0.0, ())
    if y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return RuleEnsemble(float(np.log(share / (1 - share))), ())
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(at, c, side="left") for at, c in zip(cuts, x.T, strict=True)], 1)
    margin = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    rules: dict[tuple, None] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        found, step = _paths(x, y - p, cuts, binned)
        rules.update(dict.fromkeys(tuple(sorted(f)) for f in found))
        margin += LEARNING_RATE * step / max(float((p * (1 - p)).mean()), 0.05)
    kept = list(rules)
    holds = np.stack([np.all([(x[:, j] > at) == above for j, above, at in rule], 0) for rule in kept], 1).astype(np.float64) if kept else np.zeros((len(y), 0))
    weights, bias = _lasso(holds, y, PENALTY)
    return RuleEnsemble(bias, tuple((float(w), tuple((names[j], above, at) for j, above, at in rule)) for w, rule in zip(weights, kept, strict=True) if abs(w) > 1e-4))


def fit_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", most: int = MOST_ROWS) -> RuleEnsemble:
    """Fits on at most ``most`` labelled rows outside the held-out fold; only their statistics reach the driver."""
    stats, names = with_statistics(labelled_sample(docs, labels, label, doc_id, text, most))
    rows = stats.select("y", *names.values()).toPandas()
    return fit(rows[list(names.values())].to_numpy(np.float64), rows["y"].to_numpy(np.float64), list(names))


def score_quality(docs: DataFrame, model: RuleEnsemble, text: str = "text", score: str = "score") -> DataFrame:
    """All columns of ``docs`` and the probability of label 1; a null text counts as empty.  No shuffle.

    A column of the name ``score`` is replaced; no other column of the input is touched.
    """
    body = free_name(docs, "stat_body")
    stats, names = with_statistics(docs.withColumn(body, F.coalesce(F.col(text), F.lit(""))), body)
    return stats.withColumn(score, model.column(names)).drop(body, *names.values())


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
