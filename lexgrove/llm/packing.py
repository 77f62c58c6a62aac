"""Order-preserving packing of documents into training windows by dynamic programming.

Tokens are UTF-8 bytes, and one separator ends each document. Documents stand in the order of (doc_id, text); windows of ``CAPACITY``
tokens are cut at document ends, at sentence ends (``SENTENCE_PENALTY`` tokens each, for the truncation) or, only in a sentence that is longer
than a window, at ``HARD_PENALTY``. With S the tokens before a cut,

    cost(i) = min over j < i, S_i - S_j <= CAPACITY, of cost(j) + (CAPACITY - (S_i - S_j)) + penalty(i)

so the transition is a sliding minimum of cost(j) + S_j, which a monotone queue gives in constant time. The order is split into shards of
``SHARD_TOKENS`` tokens at document ends, by the running total over all documents, so that the result doesn't hang on the partitioning;
each is solved exactly.

One row a piece: shard, window, piece, doc_id, start_byte and end_byte in the document's text, n_tokens, and the padding of the window.

Results for odd input: a null or empty text has no piece; a null doc_id comes first in the order and stays null; rows that repeat are packed each;
an empty table gives no windows. Other columns aren't read.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesops import text_slices, word_bounds
from .tables import cut, documents

CAPACITY = 8192
SENTENCE_PENALTY = 64
HARD_PENALTY = 512
SHARD_TOKENS = 1 << 22

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SIGN = np.zeros(256, bool)
_SIGN[[33, 46, 63]] = True


def sentence_ends(data: np.ndarray, offsets: np.ndarray, most: int = CAPACITY - 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """End byte (in the row), whether it is a hard cut, and the first unit of each row (with a last entry).

    A sentence ends before the word after a full stop, ! or ?, or after a line break; it has the space that follows. Longer ones than ``most`` are cut between characters."""
    starts, ends, rows = word_bounds(data, offsets, ~_SPACE[data])
    breaks = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == 10, out=breaks[1:])
    inner = np.ones(len(starts), bool)
    inner[rows[:-1][rows[:-1] < len(starts)]] = False
    if len(starts):
        inner[1:] &= _SIGN[data[ends[:-1] - 1]] | (breaks[starts[1:]] > breaks[ends[:-1]])
    filled = offsets[1:][np.diff(offsets) > 0]
    at = np.sort(np.concatenate([starts[inner], filled]))
    begin = np.concatenate([[0], at[:-1]])
    hard = np.zeros(len(at), bool)
    if len(at) and (at - begin).max() > most:
        more, flags = [], []
        for b, e in zip(begin.tolist(), at.tolist(), strict=True):
            while e - b > most:
                b += most
                while data[b] & 0xC0 == 0x80:
                    b -= 1
                more.append(b)
                flags.append(True)
            more.append(e)
            flags.append(False)
        at, hard = np.array(more, np.int64), np.array(flags)
    row = np.searchsorted(offsets, at - 1, "right") - 1
    return at - offsets[row], hard, np.searchsorted(row, np.arange(len(offsets)))


def best_cuts(lengths: np.ndarray, penalties: np.ndarray, capacity: int = CAPACITY) -> list[int]:
    """Cuts (numbers of units before each, the last is all) of least padding plus penalties; no unit is longer than the capacity."""
    before = np.concatenate([[0], np.cumsum(lengths)]).tolist()
    penalty = penalties.tolist()
    came = [0] * len(before)
    queue = deque([(0, 0)])  # (unit, cost + tokens before), the latter ascending
    for i in range(1, len(before)):
        s = before[i]
        while s - before[queue[0][0]] > capacity:
            queue.popleft()
        j, least = queue[0]
        came[i] = j
        value = least + capacity + penalty[i - 1]  # cost(i) + S_i
        while queue and queue[-1][1] > value:
            queue.pop()
        queue.append((i, value))
    cuts, at = [], len(before) - 1
    while at > 0:
        cuts.append(at)
        at = came[at]
    return cuts[::-1]


_UNITS = "doc_id long, text_key long, part int, tokens long, ends array<int>, hard array<boolean>"
_FIRST = -(1 << 63)


def part_of(doc: np.ndarray, key: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Number of bounds (rows of doc and key, ascending) below each (doc, key)."""
    low, high = (np.searchsorted(bounds[:, 0], doc, side) for side in ("left", "right"))
    out = low.copy()
    for k in np.flatnonzero(low < high):
        out[k] += np.searchsorted(bounds[low[k] : high[k], 1], key[k])
    return out


def _units(bounds: np.ndarray):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch["text"]):
                ends, hard, first = sentence_ends(data, offsets)
                flat = pa.array(first, pa.int32())
                ids, keys = batch["doc_id"].slice(a, b - a).cast(pa.int64()), batch["text_key"].slice(a, b - a)
                yield pa.RecordBatch.from_arrays([
                    ids, keys, pa.array(part_of(ids.fill_null(_FIRST).to_numpy(), keys.to_numpy(), bounds), pa.int32()), pa.array(np.diff(offsets) + 1),
                    pa.ListArray.from_arrays(flat, pa.array(ends, pa.int32())), pa.ListArray.from_arrays(flat, pa.array(hard)),
                ], ["doc_id", "text_key", "part", "tokens", "ends", "hard"])

    return run


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the tokens of the part before each row; rows come part by part."""
    at, total = None, 0
    for batch in batches:
        part, tokens = batch["part"].to_numpy(), batch["tokens"].to_numpy()
        sums = np.concatenate([[0], np.cumsum(tokens)])
        opens = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
        base = np.repeat(sums[opens], np.diff(np.append(opens, len(part))))
        before = sums[:-1] - base
        if len(part) and part[0] == at:
            before[: opens[1] if len(opens) > 1 else len(part)] += total
        if len(part):
            at, total = part[-1], int(before[-1] + tokens[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before)], [*batch.schema.names, "running"])


_PIECES = "shard long, window long, piece int, doc_id long, text_key long, start_byte int, end_byte int, n_tokens int, padding int"


def pack_shard(ids: list, keys: list, ends: list[np.ndarray], hard: list[np.ndarray], capacity: int = CAPACITY) -> list[tuple]:
    """Pieces (window, piece, doc_id, text_key, start, end, tokens, padding) of the documents in their order; each has a unit."""
    doc = np.repeat(np.arange(len(ends)), [len(e) for e in ends])
    end = np.concatenate(ends)
    last = np.ones(len(end), bool)
    last[:-1] = doc[1:] != doc[:-1]
    begin = np.concatenate([[0], end[:-1]])
    begin[1:][last[:-1]] = 0
    length = end - begin + last
    cuts = best_cuts(length, np.where(last, 0, np.where(np.concatenate(hard), HARD_PENALTY, SENTENCE_PENALTY)), capacity)
    cut_at = np.array(cuts)
    window = np.searchsorted(cut_at, np.arange(len(end)), "right")
    used = np.bincount(window, length).astype(np.int64)
    opens = np.ones(len(end), bool)
    opens[1:] = (window[1:] != window[:-1]) | (doc[1:] != doc[:-1])
    opens = np.flatnonzero(opens)
    closes = np.append(opens[1:], len(end)) - 1
    w, d = window[opens], doc[opens]
    piece = np.arange(len(opens)) - np.searchsorted(w, w)
    tokens = np.add.reduceat(length, opens)
    return list(zip(w.tolist(), piece.tolist(), [ids[k] for k in d], [keys[k] for k in d], begin[opens].tolist(), end[closes].tolist(), tokens.tolist(), (capacity - used[w]).tolist(), strict=True))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in the order of (shard, doc_id, text_key)."""
    schema = pa.schema([("shard", pa.int64()), ("window", pa.int64()), ("piece", pa.int32()), ("doc_id", pa.int64()), ("text_key", pa.int64()), *((n, pa.int32()) for n in ("start_byte", "end_byte", "n_tokens", "padding"))])
    held: tuple[list, list, list, list] = ([], [], [], [])
    shard = None

    def close() -> pa.RecordBatch:
        rows = [(shard, *r) for r in pack_shard(*held)]
        for x in held:
            x.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    for batch in batches:
        ends, hard = batch["ends"], batch["hard"]
        first, flat_ends, flat_hard = ends.offsets.to_numpy(), ends.values.to_numpy().astype(np.int64), hard.values.to_numpy(zero_copy_only=False)
        h_first = hard.offsets.to_numpy()
        for k, (s, i, key) in enumerate(zip(batch["shard"].to_pylist(), batch["doc_id"].to_pylist(), batch["text_key"].to_pylist(), strict=True)):
            if s != shard and held[0]:
                yield close()
            shard = s
            for x, v in zip(held, (i, key, flat_ends[first[k] : first[k + 1]], flat_hard[h_first[k] : h_first[k + 1]]), strict=True):
                x.append(v)
    if held[0]:
        yield close()


def pack(docs: DataFrame, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).where("text is not null and text != ''")
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_key")]
    # Parts of the order, between bounds that a sample of the keys gives (100 keys a part; it shapes tasks, not the result); each text is cut into units once.
    places = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts, rows = 3 * places, docs.count()
    some = texts.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)).alias("doc"), "text_key").sample(min(1.0, 100 * parts / max(1, rows)), 7).toPandas().to_numpy(np.int64)
    some = np.unique(some, axis=0)
    bounds = some[np.linspace(0, len(some) - 1, parts + 1).astype(int)[1:-1]] if len(some) > parts else some
    made = texts.mapInArrow(_units(bounds), _UNITS).repartition(places, "part").sortWithinPartitions("part", *order)
    units = cut(made.mapInArrow(_running, _UNITS + ", running long"))
    # Tokens before each part: one number a part meets on the driver.
    totals = sorted(units.groupBy("part").agg(F.max(F.col("running") + F.col("tokens")).alias("tokens")).collect(), key=lambda r: r.part)
    before, rows = 0, []
    for r in totals:
        rows.append((r.part, before))
        before += r.tokens
    offsets = spark.createDataFrame(rows, "part int, before long")
    placed = units.join(F.broadcast(offsets), "part")
    placed = placed.select(F.floor((F.col("before") + F.col("running")) / shard_tokens).alias("shard"), "doc_id", "text_key", "ends", "hard")
    return placed.repartition("shard").sortWithinPartitions(F.col("shard"), *order).mapInArrow(_pack, _PIECES)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t.encode()[a:b].decode() for t, a, b in zip(batch["text"].to_pylist(), batch["start_byte"].to_pylist(), batch["end_byte"].to_pylist(), strict=True)]
        names = [n for n in batch.schema.names if n not in ("text", "text_key")]
        yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), pa.array(texts, pa.string())], [*names, "text"])


def pack_with_text(docs: DataFrame) -> DataFrame:
    """The pieces of pack(), each with its text."""
    pieces = pack(docs)
    texts = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_key"), "text").where("text is not null and text != ''").groupBy("_id", "_key").agg(F.first("text").alias("text"))
    joined = pieces.join(texts, pieces["doc_id"].eqNullSafe(texts["_id"]) & (pieces["text_key"] == texts["_key"])).drop("_id", "_key")
    return joined.mapInArrow(_texts, _PIECES.replace("text_key long, ", "") + ", text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir)).drop("text_key")
