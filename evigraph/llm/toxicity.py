"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (3 to 5, with word ends) and itself, each hashed to one of
``buckets`` embedding rows; a segment of a text is the average of its words, and the softmax over the
two classes is linear in it. A text is as toxic as its most toxic segment, so a few words count in a
long text as in a short one. Misspellings and unseen inflections share n-grams with words seen.

Fitting uses at most ``sample`` rows of each label, chosen by hash: their texts reach the driver. First
all segments of a text carry its label, then only the most toxic ones do. Scoring is one narrow pass;
each task gets ``buckets`` floats, since embedding and softmax multiply out to one weight a bucket.

Defined results: null and empty texts (and texts without word characters) get the score of the bias
alone; a null label is no label; without both labels the score is the share of label 1 (0.5 without
labels). Repeated rows repeat. Columns beyond the named ones are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from operator import methodcaller

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import fold

WORDS = re.compile(r"\w+")
_group = methodcaller("group")


def word_buckets(word: str, buckets: int) -> list[int]:
    """Hashed n-grams of one word; words beyond 64 characters give those of their whole length too."""
    raw = f"<{word}>"
    grams = [raw, *(raw[i : i + n] for n in (3, 4, 5) for i in range(len(raw) - n + 1))]
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) % buckets for g in grams]


@dataclass
class SubwordModel:
    """Weight by bucket, bias, words a segment, and the map from the best segment to a probability."""

    weights: np.ndarray
    bias: float
    window: int
    slope: float
    shift: float

    def scorer(self):
        return TextScorer(self)


class TextScorer(dict):
    """Scores texts; keeps the values of seen words up to a number of characters."""

    LIMIT = 24_000_000

    def __init__(self, model: SubwordModel):
        self.model, self.held = model, 0

    def __missing__(self, word: str) -> float:
        value = float(self.model.weights[word_buckets(word, len(self.model.weights))].mean())
        if self.held > self.LIMIT:
            self.clear()
            self.held = 0
        self[word] = value
        self.held += len(word) + 60
        return value

    def best(self, text: str) -> float:
        values = np.fromiter(map(self.__getitem__, map(_group, WORDS.finditer(text.lower()))), np.float64)
        if not len(values):
            return self.model.bias
        starts = np.arange(0, len(values), self.model.window)
        return float((np.add.reduceat(values, starts) / np.diff(np.append(starts, len(values)))).max() + self.model.bias)

    def __call__(self, text: str) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.model.slope * self.best(text) + self.model.shift, -30, 30))))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def fit_texts(texts: list[str], y: np.ndarray, prior: float, buckets: int = 1 << 16, size: int = 8, window: int = 4, rounds: int = 36, seed: int = 7) -> SubwordModel:
    """Train on texts and labels 0/1; ``prior`` is the share of label 1 among all training rows."""
    if not len(y) or y.min() == y.max():
        share = float(np.clip(prior, 1e-6, 1 - 1e-6))
        return SubwordModel(np.zeros(buckets, np.float32), 0.0, window, 0.0, float(np.log(share / (1 - share))))
    number: dict[str, int] = {}
    rows = [np.fromiter((number.setdefault(w, len(number)) for w in map(_group, WORDS.finditer(t.lower()))), np.int32) for t in texts]
    kept = [i for i, r in enumerate(rows) if len(r)]
    y, rows = y[kept], [rows[i] for i in kept]
    packed, sizes = array("i"), np.zeros(len(number), np.int64)
    for i, w in enumerate(number):
        bag = word_buckets(w, buckets)
        packed.extend(bag)
        sizes[i] = len(bag)
    flat = np.frombuffer(packed, np.int32)
    first = np.cumsum(sizes) - sizes
    lots = [slice(i, i + 20_000) for i in range(0, len(sizes), 20_000)]  # words a step: bounds what a step gathers
    edges = [(int(first[lot][0]), int(first[lot][-1] + sizes[lot][-1])) for lot in lots]
    words = np.concatenate(rows)
    counts = np.array([-(-len(r) // window) for r in rows])
    lengths = np.concatenate([np.append(np.full(c - 1, window), len(r) - window * (c - 1)) for c, r in zip(counts, rows)])
    begin = np.cumsum(lengths) - lengths
    segment = np.repeat(np.arange(len(lengths)), lengths)
    doc = np.repeat(np.arange(len(rows)), counts)
    doc_begin = np.cumsum(counts) - counts
    balance = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (buckets, size)).astype(np.float32)
    soft = rng.normal(0, 0.5, (size, 2)).astype(np.float32)
    bias, table_sq, soft_sq, bias_sq = 0.0, np.full(buckets, 1e-12), np.full((size, 2), 1e-12), 1e-12

    def forward():
        vectors = np.empty((len(sizes), size), np.float32)
        for lot, (lo, hi) in zip(lots, edges):
            vectors[lot] = np.add.reduceat(table[flat[lo:hi]], first[lot] - lo, axis=0) / sizes[lot, None]
        values = vectors @ (soft[:, 1] - soft[:, 0])
        return vectors, np.add.reduceat(values[words], begin) / lengths + bias

    for t in range(rounds):
        vectors, z = forward()
        if t < rounds // 3:
            weight = (balance / counts)[doc]
        else:
            top = np.maximum.reduceat(z, doc_begin)
            best = z >= top[doc]
            weight = np.where(best, balance[doc], 0) / np.maximum(1, np.add.reduceat(best.astype(float), doc_begin))[doc]
            weight += 0.3 * np.where(y[doc] == 0, (balance / counts)[doc], 0)
        g = weight * (_sigmoid(z) - y[doc])
        gw = np.bincount(words, (g / lengths)[segment], minlength=len(sizes))
        gb = np.zeros(buckets)
        for lot, (lo, hi) in zip(lots, edges):
            gb += np.bincount(flat[lo:hi], np.repeat((gw / sizes)[lot], sizes[lot]), minlength=buckets)
        diff = soft[:, 1] - soft[:, 0]
        dv = gw @ vectors
        table_sq += gb**2 * float(diff @ diff) / size
        table -= (0.3 * gb / np.sqrt(table_sq))[:, None].astype(np.float32) * diff[None] / max(1e-6, float(np.sqrt(diff @ diff / size)))
        both = np.stack([-dv, dv], 1)
        soft_sq += both**2
        soft -= (0.1 * both / np.sqrt(soft_sq)).astype(np.float32)
        bias_sq += g.sum() ** 2
        bias -= 0.1 * g.sum() / np.sqrt(bias_sq)
    top = np.maximum.reduceat(forward()[1], doc_begin)
    center, spread = top.mean(), top.std() + 1e-9
    x, odds = (top - center) / spread, np.where(y == 1, prior / (y == 1).mean(), (1 - prior) / (y == 0).mean())
    a, c = 1.0, 0.0
    for _ in range(50):  # Newton steps of a logistic fit on one feature, slightly ridged
        p = _sigmoid(a * x + c)
        r, h = odds * (p - y), odds * p * (1 - p) + 1e-9
        m = np.array([[(h * x * x).sum() + 0.1, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(m, np.array([(r * x).sum() + 0.1 * a, r.sum()]))
        a, c = a - np.clip(step[0], -1, 1), c - np.clip(step[1], -1, 1)
    weights = (table @ (soft[:, 1] - soft[:, 0])).astype(np.float32)
    return SubwordModel(weights, float(bias), window, float(a / spread), float(c - a * center / spread))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", fold_parts: int = 3, held_fold: int = 1, sample: int = 1_200, id_col: str = "doc_id", text_col: str = "text") -> SubwordModel:
    """Model from the labels of all folds but ``held_fold``; at most ``sample`` rows of each label are read for it."""
    rows = labels.select(F.col(id_col).alias("id"), F.col(label).cast("double").alias("y")).filter("id IS NOT NULL AND y IN (0, 1)")
    rows = rows.filter(fold(F.col("id"), fold_parts) != held_fold)
    share = rows.agg(F.avg("y")).first()[0]
    pick = lambda v: rows.filter(F.col("y") == v).orderBy(F.xxhash64("id"), "id").limit(sample)
    chosen = F.broadcast(pick(0).unionByName(pick(1)))  # at most 2 * sample rows of 16 bytes
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(chosen, "id")
    texts = texts.groupBy("id", "y").agg(F.min("text").alias("text"))  # one row a label, however many rows share its id
    got = texts.toPandas().sort_values(["id", "y", "text"])
    listed, y = got["text"].tolist(), got["y"].to_numpy(dtype=float)
    del got
    return fit_texts(listed, y, 0.5 if share is None else float(share))


def score(docs: DataFrame, model: SubwordModel, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.7) -> DataFrame:
    """Columns id, score and predicted (1 from ``cut`` on)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([scorer(t.as_py() or "") for t in batch.column(1)], pa.float64())], ["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double")
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
