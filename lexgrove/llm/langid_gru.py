"""Language identification by a bidirectional gated recurrent network over bytes.

Bytes are looked up as gate inputs; a recurrence of ``HIDDEN`` units reads each window of ``SPAN`` bytes forwards and another one backwards, and
a softmax over both states labels every byte (against one recurrence over each whole text, windows change 0.01 % of the labels). The network is trained here, in numpy, by backpropagation through time on windows of a bounded
sample of documents, with the document's language as the label of each position. The sample is of ``MAX_TRAIN_ROWS`` documents, and of up to
``LANGUAGE_ROWS`` ones of each language, so that every language of the table is a class. Scoring runs whole texts, all windows of a batch in step.

    z = s(x_z + h U_z)   r = s(x_r + h U_r)   n = tanh(x_n + r * (h U_n))   h' = n + z * (h - n)

A document's probabilities are the means of its positions' ones; its segments are the runs of equal labels (``SMOOTH`` bytes or more; shorter
runs join the one before).

Results for odd input: a null or empty text has no language (null), probability 0 and no segments; a null language isn't trained on, nor is a row with a null doc_id; without any
language, or in an empty table, there is nothing to say and the language is null throughout; repeated rows are labelled each. Other columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytesops import text_slices
from .tables import documents

HIDDEN = 8
SPAN = 1024
SMOOTH = 16
#: At most so many documents are used to train the network.
MAX_TRAIN_ROWS = 1500
#: Of each language at least so many documents are among these or are added, or all where it has fewer.
LANGUAGE_ROWS = 50
TRAIN_SPAN, TRAIN_BATCH, TRAIN_STEPS = 64, 96, 400


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class ByteGru:
    """Parameters have both directions in their first axis: x (2, 256, 3H), u (2, H, 3H), out (2, H, C), bias (C)."""

    def __init__(self, classes: list[str], hidden: int = HIDDEN, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.classes, self.hidden = classes, hidden
        self.p = {
            "x": rng.normal(0, 0.3, (2, 256, 3 * hidden)), "u": rng.normal(0, hidden**-0.5, (2, hidden, 3 * hidden)),
            "out": rng.normal(0, hidden**-0.5, (2, hidden, len(classes))), "bias": np.zeros(len(classes)),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def loss_and_gradients(self, data: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """data: (B, T) bytes; y: (B) classes. Mean cross-entropy over all positions, and its gradients by backpropagation through time."""
        hid, p = self.hidden, self.p
        b, t_max = data.shape
        both = np.stack([data, data[:, ::-1]])
        d = np.arange(2)[:, None]
        h = np.zeros((2, b, hid), p["x"].dtype)
        steps = []
        for t in range(t_max):
            a, g = p["x"][d, both[:, :, t]], h @ p["u"]
            zr = _sigmoid(a[..., : 2 * hid] + g[..., : 2 * hid])
            z, r, gn = zr[..., :hid], zr[..., hid:], g[..., 2 * hid :]
            n = np.tanh(a[..., 2 * hid :] + r * gn)
            steps.append((h, z, r, gn, n))
            h = n + z * (h - n)
        states = np.stack([s[0] for s in steps[1:]] + [h])  # (T, 2, B, H)
        forward, backward = states[:, 0], states[::-1, 1]
        logits = forward @ p["out"][0] + backward @ p["out"][1] + p["bias"]
        logits -= logits.max(-1, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(-1, keepdims=True)
        loss = -float(np.log(np.maximum(prob[:, np.arange(b), y], 1e-12)).mean())
        delta = prob
        delta[:, np.arange(b), y] -= 1
        delta /= b * t_max
        grads = {k: np.zeros_like(v) for k, v in p.items()}
        grads["bias"] = delta.sum((0, 1))
        grads["out"][0], grads["out"][1] = np.einsum("tbh,tbc->hc", forward, delta), np.einsum("tbh,tbc->hc", backward, delta)
        into = np.stack([delta @ p["out"][0].T, (delta @ p["out"][1].T)[::-1]], 1)
        dh = np.zeros_like(h)
        u_t = p["u"].transpose(0, 2, 1)
        for t in range(t_max - 1, -1, -1):
            h_was, z, r, gn, n = steps[t]
            dh = dh + into[t]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h_was - n) * z * (1 - z)
            dr = dn * gn * r * (1 - r)
            dg = np.concatenate([dz, dr, dn * r], -1)
            grads["u"] += h_was.transpose(0, 2, 1) @ dg
            np.add.at(grads["x"], (d, both[:, :, t]), np.concatenate([dz, dr, dn], -1))
            dh = dh * z + dg @ u_t
        return loss, grads

    def train(self, texts: list[bytes], y: np.ndarray, steps: int = TRAIN_STEPS, rate: float = 0.02, seed: int = 11) -> ByteGru:
        """Adam on random windows; classes are drawn alike."""
        rng = np.random.default_rng(seed)
        by_class = [np.flatnonzero(y == c) for c in range(len(self.classes))]
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            c = rng.integers(0, len(self.classes), TRAIN_BATCH)
            data = np.full((TRAIN_BATCH, TRAIN_SPAN), 32, np.uint8)
            for k, label in enumerate(c):
                text = texts[rng.choice(by_class[label])]
                at = int(rng.integers(0, max(1, len(text) - TRAIN_SPAN + 1)))
                piece = np.frombuffer(text[at : at + TRAIN_SPAN], np.uint8)
                data[k] = np.resize(piece, TRAIN_SPAN)  # short texts go round
            _, grads = self.loss_and_gradients(data, c)
            for k, g in grads.items():
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                self.p[k] -= (rate * min(1, 3 * (1 - step / steps)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def position_probabilities(self, data: np.ndarray, offsets: np.ndarray, span: int = SPAN) -> np.ndarray:
        """(bytes, C): the probabilities of every position of the rows; all windows advance together, longest first."""
        hid, p = self.hidden, self.p
        size = np.diff(offsets)
        count = -(-size // span)
        owner = np.repeat(np.arange(len(size)), count)
        begin = offsets[:-1][owner] + span * (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count))
        length = np.minimum(begin + span, offsets[1:][owner]) - begin
        if not len(begin):
            return np.zeros((0, len(self.classes)), np.float32)
        order = np.argsort(-length, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        # Of each position: its window (by rank) and its place in it.
        window, place = np.repeat(rank, length), np.arange(len(data)) - np.repeat(begin, length)
        length = length[order]
        last = length[window] - 1 - place
        # s(x) = tanh(x / 2) / 2 + 1/2: halving the inputs of z and r leaves one tanh for them. Units are rows and windows columns.
        half = np.full(3 * hid, 1, np.float32)
        half[: 2 * hid] = 0.5
        x, u, read = (np.ascontiguousarray((p[k] * f).transpose(0, 2, 1), np.float32) for k, f in (("x", half), ("u", half), ("out", np.float32(1))))
        logits = np.empty((len(data), len(self.classes)), np.float32)
        logits[:] = p["bias"]
        live = np.searchsorted(-length, -np.arange(int(length[0])), "left").tolist()  # windows longer than t
        codes, states = np.zeros((len(live), len(length)), np.uint8), np.zeros((len(live), hid, len(length)), np.float32)
        for side, step in ((0, place), (1, last)):
            codes[step, window] = data
            h = np.zeros((hid, len(length)), np.float32)
            for t, k in enumerate(live):
                now = h[:, :k]
                a = x[side].take(codes[t, :k], axis=1)
                g = u[side] @ now
                zr = a[: 2 * hid]
                zr += g[: 2 * hid]
                np.tanh(zr, out=zr)
                zr *= 0.5
                zr += 0.5
                n = g[2 * hid :]
                n *= zr[hid:]
                n += a[2 * hid :]
                np.tanh(n, out=n)
                now -= n
                now *= zr[:hid]
                now += n
                states[t, :, :k] = now
            logits += np.matmul(read[side], states).transpose(0, 2, 1).reshape(-1, len(self.classes)).take(step * len(length) + window, axis=0)
        logits -= logits.max(1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(1, keepdims=True)
        return logits


def fit(docs: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS) -> ByteGru | None:
    chosen = docs.where("doc_id is not null and lang is not null").select(F.col("doc_id").alias("_id")).distinct().orderBy(F.xxhash64("_id"), "_id").limit(max_train_rows)
    each = docs.where("doc_id is not null and lang is not null and text != ''").select(F.col("doc_id").alias("_id"), "lang").distinct()
    each = each.withColumn("_k", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("_id"), "_id"))).where(F.col("_k") <= LANGUAGE_ROWS)
    chosen = chosen.unionByName(each.select("_id")).distinct()
    # The parameter and the number of languages bound this side, so it is small whatever the input.
    sample = docs.join(F.broadcast(chosen), docs["doc_id"] == chosen["_id"]).where("lang is not null and text != ''").select("doc_id", "lang", F.encode("text", "UTF-8").alias("text"))
    rows = sorted(sample.collect(), key=lambda r: (r.doc_id, r.lang, bytes(r.text)))
    if not rows:
        return None
    classes = sorted({r.lang for r in rows})
    y = np.array([classes.index(r.lang) for r in rows])
    return ByteGru(classes).train([bytes(r.text) for r in rows], y)


def _runs(labels: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, begin, end (in the row) and label of the runs of SMOOTH positions or more; shorter ones join the run before, or the one after at a row's start."""
    if not len(labels):
        return (np.zeros(0, np.int64),) * 4
    rows = offsets[:-1][np.diff(offsets) > 0]
    for least in (SMOOTH, 0):
        new = np.ones(len(labels), bool)
        new[1:] = labels[1:] != labels[:-1]
        new[rows] = True
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(labels))
        row = np.searchsorted(offsets, begin, "right") - 1
        if not least:
            return row, begin - offsets[row], end - offsets[row], labels[begin]
        long = end - begin >= least
        some = np.zeros(len(offsets) - 1, bool)
        some[row[long]] = True
        long |= ~some[row] & np.append(True, row[1:] != row[:-1])  # a row of short runs has the label of its first
        k = np.flatnonzero(long)
        before = k[np.maximum(np.searchsorted(k, np.arange(len(begin)), "right") - 1, 0)]
        after = k[np.minimum(np.searchsorted(k, np.arange(len(begin))), len(k) - 1)]
        labels = np.repeat(np.where(row[before] == row, labels[begin[before]], labels[begin[after]]), end - begin)
    raise AssertionError


_RESULT = "doc_id long, lang string, probability double, probabilities array<double>, segments array<struct<start_byte: int, end_byte: int, lang: string>>"


def identify(docs: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """For every row of docs: the language, its probability, those of all languages (in their order), and the segments of the text."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, max_train_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        names = pa.array(net.classes if net else [], pa.string())
        for batch in batches:
            for a, b, data, offsets in text_slices(batch["text"]):
                n, size = b - a, np.diff(offsets)
                mean = np.zeros((n, max(1, len(names))))
                row = begin = end = label = np.zeros(0, np.int64)
                has = (size > 0) & (net is not None)
                if has.any():
                    prob = net.position_probabilities(data, offsets)
                    mean[has] = np.add.reduceat(prob, offsets[:-1][has], axis=0, dtype=np.float64) / size[has, None]
                    row, begin, end, label = _runs(prob.argmax(1), offsets)
                best = mean.argmax(1)
                lang = names.take(pa.array(best, mask=~has)) if len(names) else pa.nulls(n, pa.string())
                width = len(names)
                segments = pa.StructArray.from_arrays([pa.array(begin, pa.int32()), pa.array(end, pa.int32()), names.take(pa.array(label))], ["start_byte", "end_byte", "lang"])
                yield pa.RecordBatch.from_arrays([
                    batch["doc_id"].slice(a, n).cast(pa.int64()), lang, pa.array(mean[np.arange(n), best]),
                    pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(mean[:, :width].ravel())),
                    pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32()), segments),
                ], ["doc_id", "lang", "probability", "probabilities", "segments"])

    return docs.select("doc_id", "text").mapInArrow(run, _RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))
