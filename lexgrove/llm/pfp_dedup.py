"""Repeated passages of ``LENGTH`` words or more, by prefix-free parsing and suffix sorting.

Parse. A rolling hash of ``SEED`` words triggers at the places where it is the least of its window of ``LENGTH`` words, so that
each window has one trigger and equal windows have equal ones, wherever they stand. The windows of one trigger make a phrase:
the words from the start of the first to the end of the last. Phrases overlap by less than a window, none is a prefix of
another's windows, and every window of the corpus is in exactly one phrase occurrence.

Dictionary. Phrases are made distinct over ``GROUP`` words of text before they move: the dictionary gets one row for each, with its first and its last
occurrence, and these meet by their triggers. Suffixes of the distinct phrases that share a trigger, cut at a window, are sorted; equal neighbours in that order are the windows that
repeat, and their first occurrence in the order of the corpus is the least of their phrases' ones. A phrase without a rival repeats as a whole or not at all. So highly repetitive text costs one
copy of it.

Parse again. The occurrences of each phrase, packed by group, are joined with what the dictionary says of the phrase. A suffix array of the parse isn't needed for this: as a window is never in two
phrases, what follows a phrase can't tell equal windows apart.

Hot triggers, with more than ``HOT`` distinct phrases (around a passage that very many documents have, each in other surroundings), would make one task too large. Their phrases are cut into
single windows, each a phrase of its own that meets its equals only.

A window counts once it occurs twice, in two documents or in one; its first occurrence by (doc_id, text, place) is kept, the others may go.
Words are compared without case, by 16 bits of their hashes beyond the trigger, which is compared by 64.

Results for odd input: rows with a null doc_id or text, and texts of fewer than ``LENGTH`` words, have no repeats; rows that repeat both
id and text are one document; rows with one id and different texts are different documents; an empty table gives no spans. Other columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytesops import mix, ngram_hashes, powers, text_slices, within_rows, word_bounds, words
from .tables import documents

LENGTH = 50
SEED = 12
#: Dictionary suffixes are sorted in portions of about so many, whole triggers at a time.
PORTION = 400_000
#: Words over which phrases are made distinct before they move.
GROUP = 1 << 21
#: Distinct phrases from which on a trigger is hot; a group tells of those of NOTICE or more. At most HOT_MOST triggers are hot, as the bound grows with the table.
HOT, NOTICE, HOT_MOST = 20_000, 16, 1_000_000


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width] for every i that has so many."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def phrases(h: np.ndarray, rows: np.ndarray, length: int = LENGTH, seed: int = SEED) -> dict[str, np.ndarray]:
    """Phrase occurrences of the rows of words. row, start (in the row), before (words before the trigger), trigger (hash),
    first (of each phrase's words in ``body``, with a last entry) and body (16-bit word hashes without the trigger's words)."""
    row, at = within_rows(rows, length)
    if not len(at):
        none = np.zeros(0, np.int64)
        return {"row": none, "start": none, "before": none, "trigger": none, "first": np.zeros(1, np.int64), "body": np.zeros(0, np.uint16)}
    grams = ngram_hashes(h, seed)
    bits = np.uint64(int(len(grams)).bit_length())
    packed = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    place = (_sliding_min(packed, length - seed + 1)[at] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    opens = np.flatnonzero(new)
    begin, end = at[opens], at[np.append(opens[1:], len(at)) - 1] + length
    place, row = place[opens], row[opens]
    before, size = place - begin, end - begin - seed
    first = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=first[1:])
    index = np.arange(first[-1]) + np.repeat(begin - first[:-1], size)
    index += seed * (index >= np.repeat(place, size))
    return {"row": row, "start": begin - rows[row], "before": before, "trigger": grams[place].view(np.int64), "first": first, "body": (h >> np.uint64(48)).astype(np.uint16)[index]}


def _binary(first: np.ndarray, data: np.ndarray) -> pa.Array:
    """Rows of data; first counts its items."""
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer((first * data.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _expand(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and number within it, for count[k] things of each owner k."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)


def _ranks(*columns: np.ndarray) -> np.ndarray:
    """Dense ranks of the rows in the order of the columns; equal rows have one rank."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        new[1:] |= c[order[1:]] != c[order[:-1]]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


class Group:
    """The distinct phrases of some texts: trigger, phrase (a hash), before, windows, bodies, and the occurrences of each in the order of the corpus."""

    def __init__(self, doc: np.ndarray, key: np.ndarray, trigger: np.ndarray, start: np.ndarray, before: np.ndarray, first: np.ndarray, body: np.ndarray, hot: np.ndarray, length: int = LENGTH, seed: int = SEED):
        width = length - seed
        size = np.diff(first)
        windows = size - width + 1
        where = np.searchsorted(hot, trigger)
        is_hot = np.zeros(len(trigger), bool)
        is_hot[where < len(hot)] = hot[where[where < len(hot)]] == trigger[where < len(hot)]
        # A phrase of a hot trigger becomes as many as it has windows.
        parts = np.where(is_hot, windows, 1)
        owner, offset = _expand(parts)
        at, many = first[:-1][owner] + offset, is_hot[owner]
        size, windows, before, start = np.where(many, width, size[owner]), np.where(many, 1, windows[owner]), before[owner] - offset, start[owner] + offset
        doc, key, trigger = doc[owner], key[owner], trigger[owner]
        who, within = _expand(size)
        spell = (body[at[who] + within].astype(np.uint64) + np.uint64(1)) * powers(int(size.max()) + 1)[within] if len(size) else np.zeros(0, np.uint64)
        spell = np.add.reduceat(spell, np.cumsum(size) - size) if len(size) else spell
        spell = mix(spell + mix(trigger.view(np.uint64) + mix((before * 65536 + size).astype(np.uint64)))).view(np.int64)
        trigger = np.where(many, spell, trigger)
        order = np.lexsort((start, key, doc, spell))
        self.doc, self.key, self.start, spell = doc[order], key[order], start[order], spell[order]
        self.opens = np.flatnonzero(np.append(True, spell[1:] != spell[:-1])) if len(spell) else np.zeros(0, np.int64)
        lead = order[self.opens]
        self.phrase, self.trigger, self.before, self.windows = spell[self.opens], trigger[lead], before[lead], windows[lead]
        # Single windows need no body: nothing else has their trigger.
        kept = np.where(many[lead], 0, size[lead])
        who, within = _expand(kept)
        self.first, self.body = np.concatenate([[0], np.cumsum(kept)]), body[at[lead][who] + within]

    def entries(self) -> pa.RecordBatch:
        """For the dictionary."""
        closes = np.append(self.opens[1:], len(self.doc)) - 1 if len(self.opens) else self.opens
        return pa.RecordBatch.from_arrays([
            pa.array(self.trigger), pa.array(self.phrase), pa.array(self.before, pa.int32()), pa.array(self.windows, pa.int32()), _binary(self.first, self.body),
            *(pa.array(x[k], t) for k in (self.opens, closes) for x, t in ((self.doc, pa.int64()), (self.key, pa.int64()), (self.start, pa.int32()))),
        ], [c.split()[0] for c in _ENTRIES.split(", ")])

    def occurrences(self) -> pa.RecordBatch:
        first = np.append(self.opens, len(self.doc)) if len(self.opens) else np.zeros(1, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(self.phrase), *(_binary(first, x) for x in (self.doc, self.key, self.start.astype(np.int32)))], ["phrase", "docs", "keys", "starts"])

    def busy(self) -> pa.RecordBatch:
        """Triggers of many distinct phrases, and their numbers."""
        trigger, n = np.unique(self.trigger, return_counts=True)
        some = n >= NOTICE
        return pa.RecordBatch.from_arrays([pa.array(trigger[some]), pa.array(n[some], pa.int64())], ["trigger", "n"])


_ENTRIES = "trigger long, phrase long, before int, windows int, body binary, doc long, key long, start int, last_doc long, last_key long, last_start int"
_OCCURRENCES = "phrase long, docs binary, keys binary, starts binary"


def _parse(make, hot: Broadcast | None, most: int):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        triggers = hot.value if hot else np.zeros(0, np.int64)
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def close() -> pa.RecordBatch:
            doc, key, trigger, start, before, sizes, body = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            return make(Group(doc, key, trigger, start, before, np.concatenate([[0], np.cumsum(sizes)]), body, triggers))

        for batch in batches:
            ids, keys = (batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "text_key"))
            for a, _, data, offsets in text_slices(batch["text"]):
                _, _, rows, h = words(data, offsets)
                p = phrases(h, rows)
                row = p["row"] + a
                held.append((ids[row], keys[row], p["trigger"], p["start"], p["before"], np.diff(p["first"]), p["body"]))
                size += len(h)
                if size >= most:
                    yield close()
                    size = 0
        if held:
            yield close()

    return run


def repeats(trigger: np.ndarray, phrase: np.ndarray, before: np.ndarray, windows: np.ndarray, first: np.ndarray, body: np.ndarray, begin: tuple[np.ndarray, ...], last: tuple[np.ndarray, ...], length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """Of the phrases that have repeated windows: row, and runs of these (row of the phrase, first and last window, whether the phrase's first occurrence is the corpus's first).

    begin and last: (doc, key, start) of the first and last occurrence that a row knows of."""
    n = len(phrase)
    # The dictionary: one entry a phrase.
    order = np.lexsort((*begin[::-1], phrase))
    lead = order[np.append(True, phrase[order[1:]] != phrase[order[:-1]])] if n else order
    order = np.lexsort((*last[::-1], phrase))
    tail = order[np.append(phrase[order[1:]] != phrase[order[:-1]], True)] if n else order
    begin, last = tuple(x[lead] for x in begin), tuple(x[tail] for x in last)
    trigger, before, windows, at = trigger[lead], before[lead], windows[lead], first[:-1][lead]
    owner, offset = _expand(windows)
    base = np.cumsum(windows) - windows
    several = np.zeros(len(lead), bool)
    for a, b in zip(begin, last, strict=True):
        several |= a != b
    many, leads = several[owner], np.ones(len(owner), bool)
    # Suffixes of phrases that share a trigger with another phrase are sorted; the others have no equal but their own copies.
    _, family, kin = np.unique(trigger, return_inverse=True, return_counts=True)
    mixed = np.flatnonzero(kin[family] > 1)
    mixed = mixed[np.argsort(family[mixed], kind="stable")]
    width = length - seed
    if len(mixed):
        total = np.cumsum(windows[mixed])
        edge = np.append(np.flatnonzero(np.diff(family[mixed])) + 1, len(mixed))
        low = 0
        while low < len(mixed):
            done = total[low - 1] if low else 0
            high = int(edge[max(np.searchsorted(total[edge - 1], done + PORTION, "right") - 1, np.searchsorted(edge, low, "right"))])
            part, low = mixed[low:high], high
            own, off = _expand(windows[part])
            e = part[own]
            suffix = np.empty((len(e), width + 3), ">u2")
            suffix[:, 0], suffix[:, 1] = family[e] >> 16 & 0xFFFF, family[e] & 0xFFFF
            suffix[:, 2] = before[e] - off
            suffix[:, 3:] = np.lib.stride_tricks.sliding_window_view(body, width)[at[e] + off]
            order = np.argsort(suffix.view(f"S{2 * (width + 3)}").ravel(), kind="stable")
            heads = np.flatnonzero(np.append(True, (suffix[order[1:]] != suffix[order[:-1]]).any(1)))
            cls = np.cumsum(np.bincount(heads, minlength=len(order))) - 1
            e, off = e[order], off[order]
            rank = _ranks(*(np.concatenate([a[e], b[e]]) + (np.tile(off, 2) if k == 2 else 0) for k, (a, b) in enumerate(zip(begin, last, strict=True))))
            least, most = np.minimum.reduceat(rank[: len(e)], heads), np.maximum.reduceat(rank[len(e) :], heads)
            where = base[e] + off
            many[where] = (least != most)[cls]
            leads[where] = rank[: len(e)] == least[cls]
    # Runs of windows of a phrase with the same answer.
    state = np.where(many, 1 + leads, 0)
    opens = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (state[1:] != state[:-1]))) if len(owner) else np.zeros(0, np.int64)
    closes = np.append(opens[1:], len(owner)) - 1 if len(opens) else opens
    said = state[opens] > 0
    opens, closes = opens[said], closes[said]
    return lead, owner[opens], offset[opens], offset[closes], state[opens] == 2


_RUNS = "phrase long, doc long, key long, start int, begins binary, ends binary, leads binary"


def _sort_dictionary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All distinct phrases of the triggers of a partition."""
    columns: list[tuple] = []
    for batch in batches:
        body = batch["body"]
        first = np.frombuffer(body.buffers()[1], np.int32)[body.offset : body.offset + len(body) + 1].astype(np.int64) // 2 if len(body) else np.zeros(1, np.int64)
        data = np.frombuffer(body.buffers()[2] or b"", np.uint8)[first[0] * 2 : first[-1] * 2].view(np.uint16) if len(body) else np.zeros(0, np.uint16)
        columns.append((*(batch[c].to_numpy().astype(np.int64) for c in ("trigger", "phrase", "before", "windows", "doc", "key", "start", "last_doc", "last_key", "last_start")), np.diff(first), data.copy()))
    if not columns:
        return
    trigger, phrase, before, windows, *places, size, body = (np.concatenate(x) for x in zip(*columns, strict=True))
    columns.clear()
    first = np.concatenate([[0], np.cumsum(size)])
    lead, row, begin, end, leads = repeats(trigger, phrase, before, windows, first, body, tuple(places[:3]), tuple(places[3:]))
    some = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else row
    of, runs = lead[row[some]], np.append(some, len(row))
    yield pa.RecordBatch.from_arrays([
        pa.array(phrase[of]), pa.array(places[0][of]), pa.array(places[1][of]), pa.array(places[2][of], pa.int32()),
        *(_binary(runs, x.astype(np.int32)) for x in (begin, end, leads)),
    ], [c.split()[0] for c in _RUNS.split(", ")])


_SPANS = "doc_id long, text_key long, start_word int, end_word int, kept boolean"


def _flat(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Number of items of each row, and all items."""
    if not len(column):
        return np.zeros(0, np.int64), np.zeros(0, kind)
    first = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.diff(first) // np.dtype(kind).itemsize, np.frombuffer(np.frombuffer(column.buffers()[2], np.uint8)[first[0] : first[-1]].tobytes(), kind)


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of all occurrences of a phrase: its runs of windows, each kept or not."""
    for batch in batches:
        times, docs = _flat(batch["docs"], np.int64)
        (_, keys), (_, starts) = _flat(batch["keys"], np.int64), _flat(batch["starts"], np.int32)
        runs, begins = _flat(batch["begins"], np.int32)
        (_, ends), (_, leads) = _flat(batch["ends"], np.int32), _flat(batch["leads"], np.int32)
        row, _ = _expand(times)
        is_first = (docs == batch["doc"].to_numpy()[row]) & (keys == batch["key"].to_numpy()[row]) & (starts == batch["start"].to_numpy()[row])
        occurrence, k = _expand(runs[row])
        run = (np.cumsum(runs) - runs)[row[occurrence]] + k
        yield pa.RecordBatch.from_arrays([
            pa.array(docs[occurrence]), pa.array(keys[occurrence]), pa.array(starts[occurrence] + begins[run], pa.int32()), pa.array(starts[occurrence] + ends[run] + LENGTH, pa.int32()),
            pa.array(is_first[occurrence] & (leads[run] > 0)),
        ], ["doc_id", "text_key", "start_word", "end_word", "kept"])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).where("doc_id is not null and text is not null")


def repeated_spans(docs: DataFrame, group: int = GROUP, hot: int = HOT) -> DataFrame:
    """(doc_id, text_key, start_word, end_word, kept): maximal spans, in words, that are covered by repeated windows that are kept (first in the corpus) or that may go."""
    texts = _keyed(docs)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Each hot trigger has ``limit`` phrases, a phrase takes more than 20 bytes of text: so there are at most HOT_MOST of them.
    limit = max(hot, size // (20 * HOT_MOST))
    busy = texts.mapInArrow(_parse(Group.busy, None, group), "trigger long, n long").groupBy("trigger").agg(F.sum("n").alias("n")).where(F.col("n") > limit)
    triggers = docs.sparkSession.sparkContext.broadcast(np.sort(np.array(busy.select("trigger").toPandas()["trigger"], np.int64)))
    runs = texts.mapInArrow(_parse(Group.entries, triggers, group), _ENTRIES).repartition("trigger").mapInArrow(_sort_dictionary, _RUNS)
    found = texts.mapInArrow(_parse(Group.occurrences, triggers, group), _OCCURRENCES).join(runs, "phrase").mapInArrow(_spans, _SPANS)
    order = Window.partitionBy("doc_id", "text_key", "kept").orderBy("start_word", "end_word")
    opens = F.coalesce(F.col("start_word") > F.max("end_word").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    island = F.sum(F.col("opens").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return (
        found.withColumn("opens", opens).withColumn("island", island)
        .groupBy("doc_id", "text_key", "kept", "island").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"))
        .select("doc_id", "text_key", "start_word", "end_word", "kept")
    )


def _cutter(names: list[str], spans_name: str):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch[spans_name]
            texts, keep = batch["text"].to_pylist(), np.ones(batch.num_rows, bool)
            for k in np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False)):
                raw = texts[k].encode()
                data = np.frombuffer(raw, np.uint8)
                starts, ends, _ = word_bounds(data, np.array([0, len(data)]))
                parts, at, left = [], 0, len(starts)
                for s in sorted(spans[k].as_py(), key=lambda x: x["start_word"]):
                    parts.append(raw[at : starts[s["start_word"]]])
                    at = int(starts[s["end_word"]]) if s["end_word"] < len(starts) else len(raw)
                    left -= s["end_word"] - s["start_word"]
                texts[k] = b"".join([*parts, raw[at:]]).decode()
                keep[k] = left > 0
            arrays = [batch[n] for n in names]
            where = {n: i for i, n in enumerate(names)}
            arrays[where["text"]] = pa.array(texts, batch["text"].type)
            if "n_chars" in where:
                cut = spans.is_valid().to_numpy(zero_copy_only=False)
                old = batch["n_chars"].to_pylist()
                arrays[where["n_chars"]] = pa.array([len(t) if c else o for t, c, o in zip(texts, cut, old, strict=True)], batch["n_chars"].type)
            yield pa.RecordBatch.from_arrays(arrays, names).filter(pa.array(keep))

    return run


def drop_repeats(docs: DataFrame) -> DataFrame:
    """docs without the later occurrences of repeated passages (n_chars follows); a text that is left without a word goes."""
    spans = "_spans"
    while spans in docs.columns:
        spans += "_"
    lose = (
        repeated_spans(docs).where("not kept").groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
        .agg(F.collect_list(F.struct("start_word", "end_word")).alias(spans))
    )
    joined = docs.join(lose, (docs["doc_id"] == lose["_id"]) & (F.xxhash64(docs["text"]) == lose["_key"]), "left").select(*[docs[c] for c in docs.columns], lose[spans])
    return joined.mapInArrow(_cutter(docs.columns, spans), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(documents(spark, sf_dir)).select("doc_id", "start_word", "end_word", "kept")
