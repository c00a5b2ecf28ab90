"""Document quality by a sparse ensemble of rules over text statistics.

Statistics are Spark expressions. Boosted shallow trees are grown in numpy on a bounded sample of
them, every path of a tree becomes a conjunctive rule, and lasso logistic regression gives most
rules the weight zero. What is left is compiled into one Spark column expression, so scoring runs
without Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rectio.llm.common import unused, with_new

THRESHOLD = 0.3
#: Labelled documents of each class that a fit takes at most.
SAMPLE = 8000
TREES, DEPTH, BINS, SHRINKAGE = 40, 3, 32, 0.3


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a whole text, all of them doubles; null counts as empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    length = F.greatest(F.length(text), F.lit(1)).cast("double")
    words = F.filter(F.split(text, "[ \n]+", -1), lambda w: w != "")
    share = lambda chars: (F.length(text) - F.length(F.translate(text, chars, ""))) / length
    count = F.size(words).cast("double")
    return {
        "chars": F.length(text).cast("double"),
        "words": count,
        "distinct": F.size(F.array_distinct(words)) / F.greatest(count, F.lit(1.0)),
        "word_length": length / F.greatest(count, F.lit(1.0)),
        "upper": share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "marks": share("!%*&$#|=~^<>{}[]\\/_+"),
        "bars": share("|"),
        "digits": share("0123456789"),
        "stops": share(".,;:?"),
        "lines": share("\n"),
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction: for each statistic, its number, a threshold, and whether it lies above."""

    terms: tuple[tuple[int, float, bool], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for k, t, above in self.terms:
            out &= (x[:, k] > t) if above else (x[:, k] <= t)
        return out

    def column(self, names: list[str], prefix: str) -> Column:
        out = F.lit(True)
        for k, t, above in self.terms:
            value = F.col(f"{prefix}.{names[k]}")
            out = out & ((value > t) if above else (value <= t))
        return out


@dataclass
class RuleEnsemble:
    names: list[str]
    rules: list[Rule]
    weights: list[float]
    bias: float

    def column(self, prefix: str) -> Column:
        """Score from 0 to 1 over a struct of statistics."""
        total = F.lit(float(self.bias))
        for rule, weight in zip(self.rules, self.weights):
            total = total + F.when(rule.column(self.names, prefix), float(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for rule, weight in zip(self.rules, self.weights):
            total += weight * rule.holds(x)
        return 1 / (1 + np.exp(-total))


def _thresholds(x: np.ndarray) -> list[np.ndarray]:
    """Midpoints between neighbouring quantiles, so that a rule never cuts at a value itself."""
    out = []
    for k in range(x.shape[1]):
        values = np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1), method="nearest"))
        out.append((values[1:] + values[:-1]) / 2)
    return out


def _tree(bins: np.ndarray, edges: list[np.ndarray], gradient: np.ndarray, curve: np.ndarray) -> tuple[list[tuple], np.ndarray]:
    """Paths of one regression tree, inner nodes included, and its step for every row."""
    paths: list[tuple] = []
    step = np.zeros(len(bins))

    def grow(rows: np.ndarray, terms: tuple, depth: int) -> None:
        if terms:
            paths.append(terms)
        best = (1e-6, None)
        g, h = gradient[rows].sum(), curve[rows].sum()
        if depth < DEPTH and len(rows) >= 20:
            for k, cuts in enumerate(edges):
                if not len(cuts):
                    continue
                left_g = np.bincount(bins[rows, k], gradient[rows], len(cuts) + 1).cumsum()[:-1]
                left_h = np.bincount(bins[rows, k], curve[rows], len(cuts) + 1).cumsum()[:-1]
                gain = left_g**2 / (left_h + 1) + (g - left_g) ** 2 / (h - left_h + 1) - g**2 / (h + 1)
                gain[(left_h < 1) | (h - left_h < 1)] = 0
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (gain[at], (k, at))
        if best[1] is None:
            step[rows] = -SHRINKAGE * g / (h + 1)
            return
        k, at = best[1]
        low = bins[rows, k] <= at
        grow(rows[low], (*terms, (k, float(edges[k][at]), False)), depth + 1)
        grow(rows[~low], (*terms, (k, float(edges[k][at]), True)), depth + 1)

    grow(np.arange(len(bins)), (), 0)
    return paths, step


def _lasso(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty, by accelerated proximal gradients."""
    n = weight.sum()
    theta, bias = np.zeros(x.shape[1]), 0.0
    ahead, ahead_bias, t = theta.copy(), bias, 1.0
    vector = np.ones(x.shape[1]) / max(1.0, np.sqrt(x.shape[1]))
    for _ in range(20):  # the largest curvature sets the step
        vector = x.T @ (weight * (x @ vector))
        size = np.linalg.norm(vector)
        vector /= max(size, 1e-12)
    rate = 1 / (0.25 * (size / n + 1) + 1e-9)
    for _ in range(rounds):
        error = weight * (1 / (1 + np.exp(-np.clip(x @ ahead + ahead_bias, -40, 40))) - y) / n
        new = ahead - rate * (x.T @ error)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        new_bias = ahead_bias - rate * error.sum()
        next_t = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_bias = new + (t - 1) / next_t * (new - theta), new_bias + (t - 1) / next_t * (new_bias - bias)
        theta, bias, t = new, new_bias, next_t
    return theta, float(bias)


def train(x: np.ndarray, y: np.ndarray, names: list[str], rate: float | None = None, penalty: float = 5e-4) -> RuleEnsemble:
    """Rules and weights for rows of statistics; ``rate`` is the share of label 1 where scores are used."""
    if len(y) == 0 or y.min() == y.max():
        return RuleEnsemble(names, [], [], 3.0 if len(y) and y.min() == 1 else -3.0)
    edges = _thresholds(x)
    bins = np.stack([np.searchsorted(cuts, x[:, k], side="left") for k, cuts in enumerate(edges)], axis=1)
    rate = y.mean() if rate is None else rate
    weight = np.where(y == 1, rate / y.mean(), (1 - rate) / (1 - y.mean()))
    margin, found = np.full(len(y), np.log(rate / (1 - rate))), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        paths, step = _tree(bins, edges, weight * (p - y), weight * p * (1 - p))
        found.update(dict.fromkeys(paths))
        margin += step
    rules = [Rule(terms) for terms in found]
    hold = np.stack([rule.holds(x) for rule in rules], axis=1).astype(np.float64) if rules else np.zeros((len(y), 0))
    theta, bias = _lasso(hold, y.astype(float), weight, penalty)
    kept = np.flatnonzero(theta)
    return RuleEnsemble(names, [rules[k] for k in kept], theta[kept].tolist(), bias)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", learn: Column | None = None) -> RuleEnsemble:
    """Train on the statistics of a bounded sample of labelled documents, the first by a hash of the id.

    Labels other than 0 and 1 and ids without a document teach nothing, a document labelled both ways
    counts as 1; without both classes every score is alike.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    known = known.where(F.col("y").isin(0, 1) & (F.lit(True) if learn is None else learn)).groupBy("doc_id").agg(F.max("y").alias("y"))
    one, zero = (known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for y in (1, 0))
    picked = one.unionByName(zero)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")
    stats = statistics(F.col("text"))
    table = rows.select("y", *[v.alias(k) for k, v in stats.items()]).toPandas().sort_values(["y", *stats]).to_numpy(dtype=float)
    return train(table[:, 1:], table[:, 0], list(stats), known.agg(F.avg("y")).first()[0])


def score(docs: DataFrame, ensemble: RuleEnsemble, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a double column ``out``; null and empty texts get the score of empty statistics.

    Whole texts of any length count. Rows, repeated ones included, and their other columns stay as
    they are, but a column named ``out`` gives way.
    """
    stats = F.struct(*[v.alias(k) for k, v in statistics(F.col(text_col)).items()])
    [name] = unused(docs, "stats")
    return with_new(docs.withColumn(name, stats), **{out: ensemble.column(name)}).drop(name)
