"""Quality classifier: a sparse ensemble of rules over text statistics.

Small trees are grown on the statistics of a bounded labelled sample; every
path from a root to a node is a conjunctive rule. Lasso logistic regression
(accelerated proximal gradient) gives most rules the weight 0. The remaining
rules are compiled into one Spark column expression over the statistics.

The sample bound is ``sample_rows`` labelled documents, chosen by a hash of
doc_id; scoring reads every whole text. Labels, lang, source and doc_id are no
inputs of a score.

Edge cases: a null or empty text has all statistics 0 and a score like any
other; null labels do not train; if a doc_id has several labels, each counts;
with one class or none to learn from the score is the constant share of label
1 (0.5 without rows). Extra columns are ignored by ``score`` and kept by
``keep``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, free

STATS = ["n_words", "mean_word", "symbols", "pipes", "bangs", "digits", "upper", "distinct", "dup_lines", "letters", "mean_line", "top_word"]
STATS_TYPE = T.StructType([T.StructField(s, T.DoubleType()) for s in STATS])

_KIND = np.zeros((256, 5), dtype=bool)
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = (_b < 128 and _c in "#*$%&<>^~=+@\\{}[]", _c == "|", _c in "!?", _b < 128 and _c.isdigit(), _b < 128 and _c.isupper())
_LETTER = np.array([_b >= 128 or chr(_b).isalpha() for _b in range(256)])


def statistics(text: str | None) -> tuple[float, ...]:
    if not text:
        return (0.0,) * len(STATS)
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw)
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    kinds = counts @ _KIND
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x]
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    # Distinct words against what a text of this size would have at most, so that length alone says little.
    m = len(words)
    return (
        math.log1p(m),
        sum(map(len, words)) / m if m else 0.0,
        kinds[0] / n,
        kinds[1] / n,
        kinds[2] / n,
        kinds[3] / n,
        kinds[4] / n,
        len(seen) / m**0.8 if m else 0.0,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        float(counts @ _LETTER) / n,
        math.log1p(n / max(1, len(lines))),
        max(seen.values()) / m if m else 0.0,
    )


@F.pandas_udf(STATS_TYPE)
def text_statistics(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        yield pd.DataFrame([statistics(t) for t in batch], columns=STATS, dtype=float)


#: A rule is a list of (statistic, above, threshold): statistic > threshold if above, else <=.
Rule = tuple[tuple[int, bool, float], ...]


def grow(x: np.ndarray, target: np.ndarray, weight: np.ndarray, features: np.ndarray, depth: int, least: int) -> list[Rule]:
    """The paths of a regression tree that splits for the largest drop of weighted squared error."""
    rules: list[Rule] = []

    def split(rows: np.ndarray, path: Rule, left: int) -> None:
        if path:
            rules.append(path)
        if left == 0 or len(rows) < 2 * least:
            return
        best = (1e-9, -1, 0.0)
        w, y = weight[rows], target[rows]
        total, mass = (w * y).sum(), w.sum()
        for f in features:
            v = x[rows, f]
            order = np.argsort(v, kind="stable")
            vs = v[order]
            cw, cy = np.cumsum(w[order]), np.cumsum((w * y)[order])
            ok = np.flatnonzero(vs[1:] > vs[:-1])
            ok = ok[(ok + 1 >= least) & (len(rows) - ok - 1 >= least)]
            if not len(ok):
                continue
            gain = cy[ok] ** 2 / cw[ok] + (total - cy[ok]) ** 2 / np.maximum(mass - cw[ok], 1e-12) - total**2 / mass
            j = int(gain.argmax())
            if gain[j] > best[0]:
                best = (float(gain[j]), int(f), float((vs[ok[j]] + vs[ok[j] + 1]) / 2))
        if best[1] < 0:
            return
        up = x[rows, best[1]] > best[2]
        split(rows[~up], (*path, (best[1], False, best[2])), left - 1)
        split(rows[up], (*path, (best[1], True, best[2])), left - 1)

    split(np.arange(len(x)), (), depth)
    return rules


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return reduce(lambda a, b: a & b, [(x[:, f] > t) if up else (x[:, f] <= t) for f, up, t in rule])


def lasso_logistic(z: np.ndarray, y: np.ndarray, w: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient; the intercept is not penalised."""
    w = w / w.sum()
    a = np.concatenate([np.ones((len(z), 1)), z], axis=1)
    rate = 4.0 / max(np.linalg.eigvalsh((a * w[:, None]).T @ a)[-1], 1e-9)
    b = np.zeros(a.shape[1])
    v, t = b.copy(), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ v, -30, 30)))
        new = v - rate * (a.T @ (w * (p - y)))
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, b, t = new + (t - 1) / t2 * (new - b), new, t2
    return float(b[0]), b[1:]


class RuleModel:
    def __init__(self, intercept: float, rules: list[Rule], weights: list[float]):
        self.intercept, self.rules, self.weights = intercept, rules, weights

    def column(self, stats: Column) -> Column:
        """The ensemble as one expression over a struct of statistics."""
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            cond = reduce(lambda a, b: a & b, [(stats[STATS[f]] > t) if up else (stats[STATS[f]] <= t) for f, up, t in rule])
            total = total + F.when(cond, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            total += weight * holds(rule, x)
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, penalty: float = 2e-3, seed: int = 7) -> RuleModel:
    """Rules from boosted trees on random halves of rows and statistics, then lasso weights. Classes weigh alike."""
    if not len(y):
        return RuleModel(0.0, [], [])
    share = float(y.mean())
    if share in (0.0, 1.0):
        p = min(max(share, 1e-6), 1 - 1e-6)
        return RuleModel(math.log(p / (1 - p)), [], [])
    w = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    rng = np.random.default_rng(seed)
    least = max(3, len(y) // 200)
    found: dict[Rule, np.ndarray] = {}
    current = np.zeros(len(y))
    for _ in range(trees):
        rows = np.sort(rng.permutation(len(y))[: max(2 * least, len(y) // 2)])
        features = np.sort(rng.permutation(x.shape[1])[: (x.shape[1] + 1) // 2])
        p = 1 / (1 + np.exp(-current))
        tree = grow(x[rows], (y - p)[rows], w[rows], features, depth, least)
        for rule in tree:
            found.setdefault(rule, holds(rule, x))
        leaves = [r for r in tree if not any(q != r and q[: len(r)] == r for q in tree)]
        for r in leaves:
            m = found[r]
            if m.any():
                current[m] += 0.5 * np.clip((w * (y - p))[m].sum() / max((w * p * (1 - p))[m].sum(), 1e-6), -3, 3)
    rules, columns, same = [], [], set()
    for rule, m in found.items():
        k = m.tobytes()
        if k not in same and 0 < m.sum() < len(m):
            same.add(k)
            rules.append(rule)
            columns.append(m)
    z = np.array(columns, dtype=float).T
    intercept, weights = lasso_logistic(z, y, w, penalty)
    keep = np.flatnonzero(np.abs(weights) > 1e-3)
    return RuleModel(intercept, [rules[i] for i in keep], [float(weights[i]) for i in keep])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = 12_000) -> RuleModel:
    """Fit on at most ``sample_rows`` labelled documents."""
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    chosen = rows.select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("__y")).orderBy(F.xxhash64("__id"), "__id", "__y").limit(sample_rows)
    got = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select("doc_id", "__y", text_statistics("text").alias("s")).select("doc_id", "__y", "s.*")
    # One row per document and label, so that repeated rows of a doc_id stay within the bound as well.
    got = got.groupBy("doc_id", "__y").agg(F.min(F.struct(*STATS)).alias("s")).select("doc_id", "__y", "s.*")
    data = got.toPandas().sort_values(["doc_id", "__y", *STATS])
    return fit(data[STATS].to_numpy(dtype=float), data["__y"].to_numpy(dtype=float))


def score(docs: DataFrame, model: RuleModel) -> DataFrame:
    """doc_id and score of every row."""
    return docs.select("doc_id", text_statistics("text").alias("__s")).select("doc_id", model.column(F.col("__s")).alias("score"))


def train_held_out(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, **how) -> RuleModel:
    """Learn only from labels of documents whose crc32 modulo ``folds`` is not ``held``."""
    return train(docs, labels.where(crc_mod(F.col("doc_id"), folds) != held), **how)


def keep(docs: DataFrame, model: RuleModel, threshold: float) -> DataFrame:
    """The rows with score >= threshold, all columns as they were."""
    names = docs.columns
    stats = free(names, "__s")
    return docs.withColumn(stats, text_statistics("text")).where(model.column(F.col(stats)) >= threshold).select(*names)
