"""Quality classifier: a sparse rule ensemble compiled into Spark column expressions.

Boosted shallow trees over text statistics are cut into their paths; each path is a conjunctive rule.
An L1-penalised logistic regression keeps few of the rules, and those become one Spark expression:
``1 / (1 + exp(-(b + sum(w * rule))))``. Scoring is one narrow pass without a shuffle.

Fitting uses at most ``sample`` labelled rows (the bound is this parameter), chosen by hash; only their
statistics reach the driver, never texts. The trees and the penalty are deterministic.

Defined results: null and empty texts have all statistics 0 and are scored by them; a null label is no
label; several labels of one row each count; without both labels in the sample the score is the share
of label 1 (0.5 without labels). Repeated rows repeat. Columns beyond the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import fold

STATS = [
    "n_words", "mean_word", "upper_share", "digit_share", "stop_share", "mark_share", "shout_share", "wide_share", "space_share",
    "distinct_words", "repeated_words", "distinct_lines", "line_words", "longest_word",
]
_GROUPS = np.zeros((256, 7))
for _b in range(256):
    _c = chr(_b)
    _GROUPS[_b] = [_c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ", _c in "0123456789", _c in ".,;:", _c in "#$%&*+/<=>@[]^_`{|}~\\\"'()-", _c in "!?", _b >= 128, _c in " \t\n\r\v\f"]


def statistics(text: str) -> tuple[float, ...]:
    """The values of ``STATS`` for one whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return (0.0,) * len(STATS)
    shares = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _GROUPS / len(raw)
    lines = [x for x in raw.split(b"\n") if x]
    upper, digit, stop, mark, shout, wide, space = shares.tolist()
    repeated = sum(map(eq, words, words[1:])) / n
    return (float(n), (len(raw) * (1 - space)) / n, upper, digit, stop, mark, shout, wide, space, len(set(words)) / n, repeated, len(set(lines)) / len(lines), n / len(lines), float(max(map(len, words))))


def with_statistics(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns and the statistics, which carry the prefix ``stat_``."""
    names = [f"k{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([statistics(t.as_py() or "") for t in batch.column(len(names))]).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *map(pa.array, rows.T.copy())], [*names, *STATS])

    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col(text_col).alias("text"))
    kinds = [f"{n} {rows.schema[n].dataType.simpleString()}" for n in names]
    out = rows.mapInArrow(run, ", ".join(kinds + [f"{s} double" for s in STATS]))
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], *[F.col(s).alias(f"stat_{s}") for s in STATS])


@dataclass
class RuleModel:
    """Bias and rules: (weight, ((statistic, is_above, threshold), ...))."""

    bias: float
    rules: list[tuple[float, tuple[tuple[str, bool, float], ...]]] = field(default_factory=list)

    def column(self) -> Column:
        """Score between 0 and 1 over the ``stat_`` columns."""
        z = F.lit(self.bias)
        for weight, tests in self.rules:
            rule = F.lit(True)
            for stat, above, at in tests:
                rule = rule & ((F.col(f"stat_{stat}") > at) if above else (F.col(f"stat_{stat}") <= at))
            z = z + F.when(rule, F.lit(weight)).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-z))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _grow(binned: np.ndarray, grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int, least: int, path: tuple, out: list, step: np.ndarray) -> None:
    """One regression tree on gradients; adds every path below the root to ``out`` and leaf steps to ``step``."""
    g, h = grad[rows].sum(), hess[rows].sum()
    best, where = 1e-6 + g * g / (h + 1.0), None
    if depth:
        for f in range(binned.shape[1]):
            b = binned[rows, f]
            gl, hl, nl = (np.cumsum(np.bincount(b, w, minlength=64))[:-1] for w in (grad[rows], hess[rows], None))
            gain = gl**2 / (hl + 1.0) + (g - gl) ** 2 / (h - hl + 1.0)
            gain[(nl < least) | (len(rows) - nl < least)] = 0
            if gain.max() > best + 1e-9:
                best, where = gain.max(), (f, int(gain.argmax()))
    if where is None:
        step[rows] = -g / (h + 1.0)
        return
    f, cut = where
    for above in (False, True):
        part = rows[(binned[rows, f] > cut) == above]
        here = (*path, (f, above, cut))
        out.append(here)
        _grow(binned, grad, hess, part, depth - 1, least, here, out, step)


def tree_rules(binned: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.3) -> list[tuple]:
    """Distinct paths of boosted trees, each as ((statistic, is_above, bin), ...)."""
    z, found = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), []
    for t in range(trees):
        p = sigmoid(z)
        rows = np.flatnonzero((np.arange(len(y)) * 2654435761 + t * 40503) % 97 < 60)
        step = np.zeros(len(y))
        _grow(binned, p - y, p * (1 - p), rows, 1 + t % depth, max(5, len(rows) // 500), (), found, step)
        z += rate * step
    return list(dict.fromkeys(tuple(sorted(x)) for x in found))


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient on mean logistic loss + penalty * |w|."""
    n, d = x.shape
    rate = 4.0 / (np.linalg.norm(x, 2) ** 2 / n + 1.0)
    w = v = np.zeros(d)
    b = c = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    t = 1.0
    for _ in range(rounds):
        r = (sigmoid(x @ v + c) - y) / n
        nw = v - rate * (x.T @ r)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - rate * penalty, 0)
        nb = c - rate * r.sum()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, b


def fit_rules(stats: np.ndarray, y: np.ndarray, names: list[str] = STATS, penalties: tuple[float, ...] = (0.01, 0.003, 0.001, 0.0003)) -> RuleModel:
    """Fit on statistics (rows, names) and labels 0/1; the penalty is chosen on a fifth of the rows."""
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6))
        return RuleModel(float(np.log(share / (1 - share))))
    cuts = [np.unique(np.quantile(stats[:, f], np.linspace(0.01, 0.99, 63))) for f in range(stats.shape[1])]
    binned = np.stack([np.searchsorted(c, stats[:, f], side="left") for f, c in enumerate(cuts)], 1).astype(np.uint8)
    found = tree_rules(binned, y)
    if not found:  # no statistic tells the labels apart: the share of good ones is all there is
        return RuleModel(float(np.log(y.mean() / (1 - y.mean()))))
    x = np.stack([np.logical_and.reduce([(binned[:, f] > cut) == above for f, above, cut in r]) for r in found], 1).astype(np.float64)
    held = np.arange(len(y)) % 5 == 0
    if len(set(y[~held])) < 2:
        held[:] = False
    best = None
    for penalty in penalties:
        w, b = lasso_logistic(x[~held], y[~held], penalty)
        at = held if held.any() else ~held
        p = np.clip(sigmoid(x[at] @ w + b), 1e-9, 1 - 1e-9)
        loss = -np.mean(y[at] * np.log(p) + (1 - y[at]) * np.log(1 - p))
        if best is None or loss < best[0] - 1e-4:
            best = (loss, penalty)
    w, b = lasso_logistic(x, y, best[1])
    rules = [(float(w[i]), tuple((names[f], bool(above), float(cuts[f][min(cut, len(cuts[f]) - 1)])) for f, above, cut in found[i])) for i in np.flatnonzero(np.abs(w) > 1e-6)]
    return RuleModel(float(b), rules)


def training_rows(labels: DataFrame, label: str, fold_parts: int, held_fold: int, sample: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``sample`` labelled ids of the training folds, chosen by hash."""
    rows = labels.select(F.col(id_col).alias("id"), F.col(label).cast("double").alias("y")).filter("id IS NOT NULL AND y IN (0, 1)")
    return rows.filter(fold(F.col("id"), fold_parts) != held_fold).orderBy(F.xxhash64("id"), "id", "y").limit(sample)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", fold_parts: int = 5, held_fold: int = 0, sample: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> RuleModel:
    """Rule model from the labels of all folds but ``held_fold``; ``sample`` bounds the rows that are read for it."""
    chosen = F.broadcast(training_rows(labels, label, fold_parts, held_fold, sample, id_col))  # at most `sample` rows of 16 bytes
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id")
    stats = with_statistics(texts, ["id", "y"])
    # one row a label, however many rows share its id
    one = stats.groupBy("id", "y").agg(F.min(F.struct(*[f"stat_{c}" for c in STATS])).alias("s")).select("id", "y", "s.*")
    rows = one.toPandas().sort_values(["id", "y"])
    ids = rows["id"].to_numpy()
    numbers = ids.astype(np.uint64) if ids.dtype.kind in "iu" else np.array([crc32(str(i).encode()) for i in ids], np.uint64)
    rows = rows.iloc[np.argsort((numbers * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20), kind="stable")]
    return fit_rules(rows[[f"stat_{s}" for s in STATS]].to_numpy(), rows["y"].to_numpy())


def score(docs: DataFrame, model: RuleModel, keep: list[str], cut: float = 0.3, text_col: str = "text", names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``keep`` columns, the score and whether it reaches ``cut`` (1 or 0), under ``names``."""
    stats = with_statistics(docs, keep, text_col)
    value = model.column()
    return stats.select(*[F.col(f"`{c}`") for c in keep], value.alias(names[0]), (value >= cut).cast("int").alias(names[1]))
