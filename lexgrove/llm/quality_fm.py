"""Document quality by a factorisation machine over hashed words, structure statistics and metadata.

    score(x) = w0 + sum_i w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ]

which is every pairwise interaction of rank ``RANK`` in time linear in the features of a document. The features are
word counts in ``WORDS`` buckets (scaled to unit length), ``STATS`` structure statistics, and a bucket each for the language
and the source. Fitted in numpy on a bounded labelled sample; scored in Arrow batches without a shuffle.

Results for odd input: a null or empty text scores 0 and is rejected; a null language or source is a value of its own;
repeated rows are scored each; without labels of both classes nothing is learnt, every text with content scores 1 and is kept.
An empty table gives an empty result. Other columns are passed over, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from .bytesops import fold, span_hashes, text_slices, word_bounds
from .tables import documents, labelled_sample, table

WORDS = 1 << 13
META = 1 << 8
STATS = 9
DIM = WORDS + META + STATS
RANK = 8
#: At most so many labelled documents are used to fit the model.
MAX_TRAIN_ROWS = 6000
#: The share of good held-out documents that the threshold may cost.
MAX_LOSS = 0.005


def _row_sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[offsets])


def _meta(values: list, salt: str) -> np.ndarray:
    cache: dict = {}
    for v in set(values):
        cache[v] = WORDS + xxhash.xxh32_intdigest(f"{salt}={v}") % META
    return np.array([cache[v] for v in values], np.int64)


def features(text: pa.Array, lang: pa.Array, source: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of the rows: first entry of each row (with a last one), feature numbers, values, and whether there is text."""
    langs, sources = _meta(lang.to_pylist(), "lang"), _meta(source.to_pylist(), "source")
    for a, b, data, offsets in text_slices(text):
        n = b - a
        starts, ends, rows = word_bounds(data, offsets)
        bucket = (span_hashes(fold(data), starts, ends) % np.uint64(WORDS)).astype(np.int64)
        n_words, size = np.diff(rows), np.diff(offsets)
        key, count = np.unique(np.repeat(np.arange(n), n_words) * WORDS + bucket, return_counts=True)
        row, index, value = key // WORDS, key % WORDS, count.astype(np.float64)
        value /= np.sqrt(np.bincount(row, value * value, n))[row]
        letters = np.maximum(_row_sums((data >= 65) & (data <= 122), offsets), 1)
        some, some_words = np.maximum(size, 1), np.maximum(n_words, 1)
        spaces = _row_sums((data == 32) | (data == 10), offsets)
        word_bytes = _row_sums(np.isin(data, _PLAIN) | (data >= 128), offsets)
        stats = np.stack([
            word_bytes / some, _row_sums((data >= 65) & (data <= 90), offsets) / letters, _row_sums((data >= 48) & (data <= 57), offsets) / some,
            (size - spaces - word_bytes) / some_words, _row_sums(data == 10, offsets) / some_words, np.minimum(word_bytes / some_words / 16, 2),
            np.log1p(n_words) / 10, np.bincount(row, minlength=n) / some_words, np.full(n, 1.0),
        ], 1)
        meta = np.stack([langs[a:b], sources[a:b]], 1)
        order = np.argsort(np.concatenate([row, np.repeat(np.arange(n), 2), np.repeat(np.arange(n), STATS)]), kind="stable")
        index = np.concatenate([index, meta.ravel(), np.tile(np.arange(DIM - STATS, DIM), n)])[order]
        value = np.concatenate([value, np.full(2 * n, 0.3), stats.ravel()])[order].astype(np.float32)
        first = np.zeros(n + 1, np.int64)
        np.cumsum(np.bincount(row, minlength=n) + 2 + STATS, out=first[1:])
        yield first, index, value, size > 0


_PLAIN = np.array([*range(48, 58), *range(65, 91), *range(97, 123)], np.uint8)


class FactorisationMachine:
    def __init__(self, dim: int, rank: int = RANK, seed: int = 7):
        self.w0, self.w = 0.0, np.zeros(dim, np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.02, (dim, rank)).astype(np.float32)
        self.constant: float | None = None
        self.threshold = 0.5

    def raw(self, first: np.ndarray, index: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Every row has at least one entry."""
        xv = self.v[index] * value[:, None]
        at = first[:-1]
        return self.w0 + np.add.reduceat(self.w[index] * value, at) + 0.5 * (np.square(np.add.reduceat(xv, at)).sum(1) - np.add.reduceat(np.square(xv).sum(1), at))

    def score(self, first: np.ndarray, index: np.ndarray, value: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(first) - 1, self.constant)
        return 1 / (1 + np.exp(-np.clip(self.raw(first, index, value).astype(np.float64), -30, 30)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 12, rate: float = 0.05, l2: float = 1e-5, batch: int = 64, seed: int = 7) -> FactorisationMachine:
        """Adagrad on the logistic loss, both classes weighted alike."""
        rng = np.random.default_rng(seed)
        weight = np.where(y > 0, len(y) / max(1, 2 * (y > 0).sum()), len(y) / max(1, 2 * (y == 0).sum()))
        gw, gv, g0 = np.full(self.w.shape, 1e-6, np.float32), np.full(self.v.shape, 1e-6, np.float32), 1e-6
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), batch):
                take = order[at : at + batch]
                first = np.concatenate([[0], np.cumsum([len(rows[i][0]) for i in take])])
                index, value = (np.concatenate([rows[i][k] for i in take]) for k in (0, 1))
                xv = self.v[index] * value[:, None]
                total = np.add.reduceat(xv, first[:-1])
                raw = self.w0 + np.add.reduceat(self.w[index] * value, first[:-1]) + 0.5 * (np.square(total).sum(1) - np.add.reduceat(np.square(xv).sum(1), first[:-1]))
                slope = ((1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[take]) * weight[take] / len(take)).astype(np.float32)
                row = np.repeat(np.arange(len(take)), np.diff(first))
                used, inverse = np.unique(index, return_inverse=True)
                dw = np.bincount(inverse, slope[row] * value).astype(np.float32) + l2 * self.w[used]
                dv = np.zeros((len(used), self.v.shape[1]), np.float32)
                np.add.at(dv, inverse, (slope[row] * value)[:, None] * (total[row] - xv))
                dv += l2 * self.v[used]
                gw[used] += dw * dw
                gv[used] += dv * dv
                g0 += float(slope.sum()) ** 2
                self.w[used] -= rate * dw / np.sqrt(gw[used])
                self.v[used] -= 0.3 * rate * dv / np.sqrt(gv[used])
                self.w0 -= rate * float(slope.sum()) / g0**0.5
        return self


_SPARSE = "doc_id long, target int, idx array<int>, val array<float>"


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for first, index, value, _ in features(batch["text"], batch["lang"], batch["source"]):
            n, flat = len(first) - 1, pa.array(first, pa.int32())
            yield pa.RecordBatch.from_arrays([
                batch["doc_id"].slice(at, n).cast(pa.int64()), batch["_target"].slice(at, n),
                pa.ListArray.from_arrays(flat, pa.array(index, pa.int32())), pa.ListArray.from_arrays(flat, pa.array(value, pa.float32())),
            ], ["doc_id", "target", "idx", "val"])
            at += n


def fit(docs: DataFrame, labels: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS) -> FactorisationMachine:
    """Model and threshold: four fifths of the sample are fitted, the threshold is set on the others."""
    sample = labelled_sample(docs.select("doc_id", "text", "lang", "source"), labels, "quality", max_train_rows)
    got = sorted(sample.select("doc_id", "text", "lang", "source", "_target").mapInArrow(_sparse, _SPARSE).collect(), key=lambda r: (r.doc_id, len(r.idx)))
    y = np.array([r.target for r in got], np.int64).clip(0, 1)
    model = FactorisationMachine(DIM)
    if len(set(y.tolist())) < 2:
        model.constant = 1.0
        return model
    rows = [(np.array(r.idx, np.int64), np.array(r.val, np.float32)) for r in got]
    held = np.arange(len(rows)) % 5 == 4
    model.fit([r for r, h in zip(rows, held, strict=True) if not h], y[~held])
    good = [r for r, h, t in zip(rows, held, y, strict=True) if h and t]
    if good:
        scores = model.score(np.cumsum([0] + [len(r[0]) for r in good]), *(np.concatenate([r[k] for r in good]) for k in (0, 1)))
        model.threshold = float(min(0.5, np.quantile(scores, MAX_LOSS)))
    return model


def scores_of(model: FactorisationMachine, text: pa.Array, lang: pa.Array, source: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Score and whether the document is kept, for each row."""
    parts = [np.where(some, model.score(first, index, value), 0.0) for first, index, value, some in features(text, lang, source)]
    score = np.concatenate([*parts, np.zeros(0)])
    has_text = np.concatenate([*(p > 0 for p in parts), np.zeros(0, bool)])
    return score, has_text & (score >= model.threshold)


def quality(docs: DataFrame, labels: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """doc_id, score in [0, 1] and keep, for every row of docs."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_train_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, keep = scores_of(model.value, batch["text"], batch["lang"], batch["source"])
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pa.array(score), pa.array(keep)], ["doc_id", "score", "keep"])

    return docs.select("doc_id", "text", "lang", "source").mapInArrow(run, "doc_id long, score double, keep boolean")


def drop_rejected(docs: DataFrame, labels: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """The rows of docs that the classifier keeps, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_train_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scores_of(model.value, batch["text"], batch["lang"], batch["source"])[1]))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
