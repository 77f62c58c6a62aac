"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct byte n-grams (lower case, n in ``ORDERS``) of a text, hashed to ``BUCKETS``. Each has the ratio
r = log((p + a) / |p|) - log((q + a) / |q|) of its smoothed counts in toxic and other texts, and a logistic regression is
fitted on x * r. Buckets that are rare or say little are pruned, so that scoring gathers one weight for each place.

Results for odd input: a null or empty text scores with the bias alone and isn't toxic; repeated rows are scored each;
without labels of both classes every score is 0 and nothing is toxic; an empty table gives an empty result. Other columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bytesops import fold, text_slices
from .tables import documents, labelled_sample, table

ORDERS = (3, 4, 5)
BUCKETS = 1 << 18
#: At most so many labelled documents are used to fit the model.
MAX_TRAIN_ROWS = 4000
#: Weight of the squared weights (divided by their number); strong, as labels are noisy.
L2 = 300.0
#: A bucket counts from so many texts on, and from this absolute log-count ratio on.
MIN_TEXTS, MIN_RATIO = 5, 1.0
#: The share of clean held-out documents that may be called toxic, over so many folds.
MAX_FALSE, FOLDS = 0.002, 3

_K = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)]


def gram_buckets(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the places where an n-gram that stays within its row starts (as a mask), and the bucket of every place."""
    low = fold(data).astype(np.uint32)
    n = len(low)
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n) if n else np.zeros(0, np.int64)
    h = np.zeros(n, np.uint32)
    for k in range(max(ORDERS)):
        if n > k:
            h[: n - k] += (low[k:] + np.uint32(1)) * _K[k]
            h[: n - k] ^= h[: n - k] >> np.uint32(13)
            h[: n - k] *= np.uint32(0x2C1B3C6D)
        if k + 1 in ORDERS:
            yield left >= k + 1, ((h ^ (h >> np.uint32(15)) ^ np.uint32(k)) & np.uint32(BUCKETS - 1)).astype(np.int32)


def distinct_buckets(data: np.ndarray, offsets: np.ndarray, useful: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of the distinct n-grams of every row, of the useful buckets only where they are given."""
    keys = []
    for mask, bucket in gram_buckets(data, offsets):
        at = np.flatnonzero(mask & useful[bucket] if useful is not None else mask)
        keys.append((np.searchsorted(offsets, at, "right") - 1) * BUCKETS + bucket[at])
    key = np.unique(np.concatenate(keys))
    return key // BUCKETS, key % BUCKETS


class RatioClassifier:
    def __init__(self) -> None:
        self.weight, self.bias, self.threshold = np.zeros(BUCKETS, np.float32), 0.0, 0.5
        self.useful, self.trained = np.zeros(BUCKETS, bool), False

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.zeros(len(offsets) - 1)
        row, bucket = distinct_buckets(data, offsets, self.useful)
        raw = self.bias + np.bincount(row, self.weight[bucket], len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))

    def fit(self, rows: list[np.ndarray], y: np.ndarray, epochs: int = 200, rate: float = 0.3, l2: float = L2, smooth: float = 1.0) -> RatioClassifier:
        """rows: the distinct buckets of each text."""
        toxic, other = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for r, t in zip(rows, y, strict=True):
            (toxic if t else other)[r] += 1
        ratio = np.log((toxic + smooth) / (toxic.sum() + smooth * BUCKETS)) - np.log((other + smooth) / (other.sum() + smooth * BUCKETS))
        self.useful = (toxic + other >= MIN_TEXTS) & (np.abs(ratio) >= MIN_RATIO)
        # Only what is kept of the texts is put together: most of their buckets say little.
        kept = [r[self.useful[r]] for r in rows]
        row = np.repeat(np.arange(len(rows)), [len(r) for r in kept])
        columns, place = np.unique(np.concatenate(kept), return_inverse=True)
        scaled = ratio[columns]
        w, b = np.zeros(len(columns)), 0.0
        sample = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum()))
        x, step_w, step_b = scaled[place], np.full(len(columns), 1e-8), 1e-8
        for _ in range(epochs):
            raw = b + np.bincount(row, x * w[place], len(rows))
            slope = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y) * sample
            dw = np.bincount(place, x * slope[row], len(columns)) + l2 * w / max(1, len(columns))
            step_w += dw * dw
            step_b += slope.sum() ** 2
            w -= rate * 0.1 * dw / np.sqrt(step_w)
            b -= rate * slope.sum() / step_b**0.5
        self.weight[columns] = w * scaled
        self.bias, self.trained = float(b), True
        return self


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in text_slices(batch["text"]):
            row, bucket = distinct_buckets(data, offsets)
            first = np.searchsorted(row, np.arange(b - a + 1))
            yield pa.RecordBatch.from_arrays([
                batch["doc_id"].slice(a, b - a).cast(pa.int64()), batch["_target"].slice(a, b - a),
                pa.array([bucket[i:j].astype(np.int32).tobytes() for i, j in zip(first[:-1], first[1:], strict=True)], pa.binary()),
            ], ["doc_id", "target", "buckets"])


def fit(docs: DataFrame, labels: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS) -> RatioClassifier:
    sample = labelled_sample(docs.select("doc_id", "text"), labels, "toxic", max_train_rows)
    got = sorted(sample.select("doc_id", "text", "_target").mapInArrow(_grams, "doc_id long, target int, buckets binary").collect(), key=lambda r: (r.doc_id, len(r.buckets)))
    y = np.array([r.target for r in got], np.int64).clip(0, 1)
    model = RatioClassifier()
    if len(set(y.tolist())) < 2:
        return model
    rows = [np.frombuffer(r.buckets, np.int32) for r in got]
    # The threshold is set on the scores that clean documents get from models that haven't seen them.
    raw = []
    for k in range(FOLDS):
        seen = np.arange(len(rows)) % FOLDS != k
        if len(set(y[seen].tolist())) == 2:
            part = RatioClassifier().fit([r for r, s in zip(rows, seen, strict=True) if s], y[seen])
            raw += [part.bias + float(part.weight[r].sum()) for r, s, t in zip(rows, seen, y, strict=True) if not s and not t]
    model.fit(rows, y)
    if raw:
        model.threshold = float(max(0.5, 1 / (1 + np.exp(-np.clip(np.quantile(raw, 1 - MAX_FALSE), -30, 30)))))
    return model


def toxicity(docs: DataFrame, labels: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """doc_id, score in [0, 1] and toxic, for every row of docs."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_train_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.where(np.diff(offsets) > 0, model.value.score(data, offsets), 0.0) for _, _, data, offsets in text_slices(batch["text"])]
            score = np.concatenate([*parts, np.zeros(0)])
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pa.array(score), pa.array(score > model.value.threshold)], ["doc_id", "score", "toxic"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, toxic boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
