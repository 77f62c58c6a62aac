"""Titles in free text: a dictionary of page titles, and the spans of documents that match it.

A title's key is its lower-case text without the first ``_( ... )``, cut into tokens; underscores and signs only part them. A dictionary of at most ``BROADCAST_BYTES`` is sent to all tasks
as sorted hashes of its keys and of their beginnings; documents are then walked in one pass without a shuffle: places go on to the next token only while what was read begins a key. A larger
one is joined: the n-grams of documents that start with a key's first token meet the keys by their text, and the titles come along. Of the matches the scan takes the
longest from left to right without overlap; sub-matches are those within a taken one.

Results for odd input: null or empty words, and an empty dictionary, give no matches; null titles are left out; rows that repeat an id are scanned each in the pass, and taken together as one document in the join;
other columns aren't read. A null doc_id's matches have a null id. Keys are compared by 64-bit hashes in the pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx


def clean_title(title: Column) -> Column:
    """The title without its first _( ... ); unbalanced ones stay."""
    return F.regexp_replace(title, r"^(.*?)_\([^)]*\)", "$1")


def title_index(titles: DataFrame) -> DataFrame:
    """titles (title, ord) as (key, n_tokens, titles): titles that share a key, in their order. Empty titles, and those without a letter or digit, are left out."""
    cleaned = F.lower(clean_title(F.col("title")))
    used = F.when(cleaned == "", F.lower("title")).otherwise(cleaned)
    tokens = F.filter(tx.words(used), lambda t: t.rlike(r"[\p{L}\p{N}]"))
    rows = titles.where("title is not null and title != ''").select("title", "ord", tokens.alias("tokens")).where("size(tokens) > 0")
    return (
        rows.groupBy(F.array_join("tokens", " ").alias("key")).agg(F.first(F.size("tokens")).alias("n_tokens"), F.array_sort(F.collect_list(F.struct("ord", "title"))).alias("t"))
        .select("key", "n_tokens", F.col("t.title").alias("titles"))
    )


def lookup_words(docs: DataFrame) -> DataFrame:
    """docs whose ``words`` are lemmas where a noun's tag says so; needs the columns tag and lemma."""
    return docs.withColumn("words", F.zip_with(F.arrays_zip("words", "tag"), "lemma", lambda w, lemma: F.when(w["tag"].isin("NN", "NNS"), lemma).otherwise(w["words"])))


#: Estimated size up to which a dictionary is broadcast.
BROADCAST_BYTES = 64 << 20
_SPANS = "start int, end int, titles array<string>"


def _hash(token: str) -> int:
    return int.from_bytes(blake2b(token.encode(), digest_size=8).digest(), "little")


def _extend(h: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Hash of a run of tokens and one more."""
    h = (h ^ (token >> np.uint64(7))) * np.uint64(0x9E3779B97F4A7C15) + token
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def _within(sorted_values: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each x is among the values, and where it would be."""
    at = np.searchsorted(sorted_values, x)
    inside = at < len(sorted_values)
    inside[inside] = sorted_values[at[inside]] == x[inside]
    return inside, at


class Dictionary:
    """Keys by their number of tokens: sorted hashes of keys with their numbers, and of all beginnings of longer keys."""

    def __init__(self, keys: list[str], titles: list[list[str]]):
        # Arrow's arrays, of which a worker has no second form.
        self.titles = pa.array(titles, pa.list_(pa.string()))
        runs = [np.array([_hash(t) for t in k.split(" ")], np.uint64) for k in keys]
        self.most = max(map(len, runs), default=0)
        live = np.argsort([len(r) for r in runs], kind="stable")
        h = np.zeros(len(runs), np.uint64)
        self.keys: list[tuple[np.ndarray, np.ndarray]] = []
        self.begins: list[np.ndarray] = []
        for n in range(1, self.most + 1):
            live = live[[len(runs[k]) >= n for k in live]]
            h[live] = _extend(h[live], np.array([runs[k][n - 1] for k in live], np.uint64))
            done = live[[len(runs[k]) == n for k in live]]
            done = done[np.argsort(h[done])]
            self.keys.append((h[done], done))
            self.begins.append(np.unique(h[live[[len(runs[k]) > n for k in live]]]))

    def walk(self, token: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First token, number of tokens, and key of every match; last: for each token the end of its document."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        at, h = np.arange(len(token)), np.zeros(len(token), np.uint64)
        for n in range(1, self.most + 1):
            some = at + n <= last[at]
            at = at[some]
            h = _extend(h[some], token[at + n - 1])
            hashes, numbers = self.keys[n - 1]
            if len(hashes):
                hit, where = _within(hashes, h)
                out.append((at[hit], np.full(int(hit.sum()), n), numbers[where[hit]]))
            goes_on, _ = _within(self.begins[n - 1], h)
            at, h = at[goes_on], h[goes_on]
        if not out:
            return (np.zeros(0, np.int64),) * 3
        start, size, key = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.lexsort((size, start))
        return start[order], size[order], key[order]


def longest(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Numbers of the spans that are taken from left to right, the longest from each start; spans are in the order (start, end)."""
    best = np.flatnonzero(np.append(start[1:] != start[:-1], True)) if len(start) else np.zeros(0, np.int64)
    taken, free = [], -1
    for k, s, e in zip(best.tolist(), start[best].tolist(), end[best].tolist(), strict=True):
        if s >= free:
            taken.append(k)
            free = e
    return np.array(taken, np.int64)


def choose(start: np.ndarray, end: np.ndarray, within: bool) -> np.ndarray:
    """Numbers of the taken spans, or of all that lie within one."""
    taken = longest(start, end)
    if not within or not len(taken):
        return taken
    outer = np.searchsorted(start[taken], start, "right") - 1
    return np.flatnonzero((outer >= 0) & (end <= end[taken][outer]))


def _pass(shared: Broadcast, key: str, within: bool | None):  # noqa: ANN202
    """within: all matches in a taken one (True), the taken ones (False), or all there are (None)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        letters = regex.compile(r"[\p{L}\p{N}]")
        hashes: dict[str, int] = {}
        titles = known.titles
        for batch in (b.slice(k, n) for b in batches for k, n in tx.pieces(b["words"])):
            words = batch["words"]
            offsets = words.offsets.to_numpy().astype(np.int64)
            size = np.where(words.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
            flat = words.flatten().dictionary_encode()
            by_value = []
            for v in flat.dictionary.to_pylist():
                low = v.lower() if v is not None else ""
                if low not in hashes:
                    if len(hashes) > 1 << 20:
                        hashes.clear()
                    hashes[low] = _hash(low) if letters.search(low) else 0
                by_value.append(hashes[low])
            value = np.array(by_value, np.uint64)[flat.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.uint64)
            kept = np.flatnonzero(value != 0)  # signs are passed over
            doc = np.repeat(np.arange(len(size)), size)[kept]
            place = (np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size))[kept]
            ends = np.searchsorted(doc, doc, "right")
            first, n, which = known.walk(value[kept], ends)
            owner, start, end = doc[first], place[first], place[first + n - 1] + 1
            if within is not None and len(first):
                # Documents one after another: a document's places come after all of the one before.
                shift = (np.cumsum(size) - size)[owner]
                some = choose(start + shift, end + shift, within)
                owner, start, end, which = owner[some], start[some], end[some], which[some]
            yield pa.RecordBatch.from_arrays([batch[key].take(pa.array(owner)), pa.array(start, pa.int32()), pa.array(end, pa.int32()), titles.take(pa.array(which))], [key, "start", "end", "titles"])

    return run


def _joined(docs: DataFrame, index: DataFrame, key: str, most_tokens: int) -> DataFrame:
    """(key, start, end, titles) of all matches, by a join."""
    placed = F.filter(F.transform("words", lambda w, i: F.struct(F.lower(w).alias("w"), i.alias("i"))), lambda x: x["w"].rlike(r"[\p{L}\p{N}]"))
    kept = docs.where("size(words) > 0").select(key, placed.alias("p"))
    opens = index.select(F.substring_index("key", " ", 1).alias("open")).distinct()
    width = F.least(F.lit(most_tokens), F.size("p") - F.col("j"))
    starts = kept.select(key, "p", F.explode(F.sequence(F.lit(0), F.size("p") - 1)).alias("j")).where("size(p) > 0")
    starts = starts.select(key, F.get("p", F.col("j"))["w"].alias("open"), F.slice("p", F.col("j") + 1, width).alias("run")).join(opens, "open", "left_semi")
    grams = F.transform("run", lambda x, k: F.struct((x["i"] + 1).alias("end"), F.array_join(F.transform(F.slice("run", F.lit(1), k + 1), lambda y: y["w"]), " ").alias("key")))
    spans = starts.select(key, F.get("run", F.lit(0))["i"].alias("start"), F.explode(grams).alias("g")).select(F.col(key).alias("_doc"), "start", "g.end", F.col("g.key").alias("_key"))
    return spans.join(index.select(F.col("key").alias("_key"), "titles"), "_key").select(F.col("_doc").alias(key), "start", "end", "titles")


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _taken(spans: pa.Array, within: pa.Array) -> pa.Array:
    out = []
    for row, w in zip(spans, within.to_pylist(), strict=True):
        at = row.values
        out.append(choose(at.field("start").to_numpy(), at.field("end").to_numpy(), w))
    return pa.array(out, pa.list_(pa.int32()))


def _matches(docs: DataFrame, index: DataFrame, key: str, within: bool | None, broadcast_bytes: int) -> DataFrame:
    size = index.agg(F.sum(F.length("key") + 64 + F.size("titles") * 32), F.max("n_tokens")).first()
    if (size[0] or 0) <= broadcast_bytes:
        rows = index.select("key", "titles").orderBy("key").collect()  # of the size just checked
        known = docs.sparkSession.sparkContext.broadcast(Dictionary([r.key for r in rows], [list(r.titles) for r in rows]))
        return docs.select(key, "words").mapInArrow(_pass(known, key, within), f"`{key}` {dict(docs.dtypes)[key]}, {_SPANS}")
    found = _joined(docs, index, key, size[1])
    if within is None:
        return found
    gathered = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "titles"))).alias("spans"))
    chosen = gathered.select(key, "spans", F.explode(_taken(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))), F.lit(within))).alias("k"))
    return chosen.select(key, F.get("spans", F.col("k")).alias("s")).select(key, "s.start", "s.end", "s.titles")


def all_matches(docs: DataFrame, index: DataFrame, key: str = "doc_id", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, start, end, titles): every span of letters-and-digits tokens that is a key. Signs between tokens are passed over."""
    return _matches(docs, index, key, None, broadcast_bytes)


def scan(docs: DataFrame, index: DataFrame, key: str = "doc_id", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, start, end, titles): non-overlapping longest matches from left to right."""
    return _matches(docs, index, key, False, broadcast_bytes)


def sub_matches(docs: DataFrame, index: DataFrame, key: str = "doc_id", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, start, end, titles): all matches that lie in a match of scan(), which are among them; each once."""
    return _matches(docs, index, key, True, broadcast_bytes)
