"""Benchmark decontamination by template canonicalisation.

A text becomes a template: words in lower case, with typed placeholders for numbers, for names (words with a capital first letter of any script, that have a
small letter and don't open a sentence, so that a text all in capitals is compared by its words) and for units (after a number). A capitalised word that opens a sentence may be
a word or a name: windows over it are emitted for each reading. Windows of ``WINDOW`` template tokens with ``LITERALS`` or more plain words are hashed, and
the windows of documents and benchmark items are joined on the hash. An item that is shorter has one window of its own length; one that has too few plain words
for a template is compared word by word, by windows of its fillers.

Along an alignment (document place less item place) the slots must be filled consistently: one filler of the item stands for one filler of the
document, and the other way round. A window that matches only by an opener read as a name counts where its fillers agree with all others of the
alignment; else it alone is passed over. The alignments of a document and an item are taken together from the largest down, each if it agrees with those before. An
item is found when they cover ``COVERAGE`` of its windows; with the same fillers everywhere it is an exact leak, else a re-parameterised one.

Documents are scanned once. Only windows whose hash is among the benchmark's in a bitmap of 2^``FILTER_BITS`` bits leave the scan (the size
is fixed: a benchmark of many millions of windows lets more through, never fewer), and only these are shuffled or joined.

Results for odd input: null ids or texts match nothing; an item of fewer than ``LITERALS`` tokens says too little and isn't found;
repeated rows of a document or an item count once; empty tables give no matches. Other columns are passed over.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesops import fold, mix, ngram_hashes, span_hashes, text_slices, within_rows, word_bounds
from .tables import documents, table

WINDOW = 6
LITERALS = 3
COVERAGE = 0.5
FILTER_BITS = 24

UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles metre metres meter meters kilometre kilometres kilometer kilometers mg g kg t oz lb lbs gram grams kilogram kilograms pound pounds ton tons "
    "tonne tonnes ounce ounces ml cl l litre litres liter liters gallon gallons ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years hz khz mhz ghz w kw mw watt watts v kv volt "
    "volts a amp amps j kj joule joules cal kcal n pa kpa bar k c f degree degrees percent pct eur euro euros usd dollar dollars cent cents gbp b kb mb gb tb bit bits byte bytes mph kmh rpm"
).split()

_NUMBER, _NAME, _UNIT = mix(np.array([1, 2, 3], np.uint64) << np.uint64(60))
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_ENDS = np.zeros(256, bool)
_ENDS[[33, 46, 63, 10, 58]] = True
#: Of code points below 2^16: capital and small letters.
_UPPER, _LOWER = (np.array([f(chr(c)) for c in range(1 << 16)]) for f in (str.isupper, str.islower))
#: Sign units stand after a number without being words.
_SIGNS = np.zeros(256, bool)
_SIGNS[[37]] = True


def _unit_hashes() -> np.ndarray:
    data = "".join(UNITS).encode()
    ends = np.cumsum([len(u) for u in UNITS])
    return np.sort(span_hashes(np.frombuffer(data, np.uint8), ends - [len(u) for u in UNITS], ends))


def code_points(data: np.ndarray) -> np.ndarray:
    """Code point of the character that starts at each byte, below 2^16; 0 for other characters and at bytes within one."""
    out = np.where(data < 128, data, 0).astype(np.uint16)
    for low, high, n in ((0xC2, 0xDF, 2), (0xE0, 0xEF, 3)):
        at = np.flatnonzero((data[: len(data) - n + 1] >= low) & (data[: len(data) - n + 1] <= high))
        code = (data[at] & (0x1F if n == 2 else 0x0F)).astype(np.uint32)
        for k in range(1, n):
            code = (code << 6) | (data[at + k] & 0x3F)
        out[at] = code
    return out


def template(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template tokens (hashes), fillers (hashes as in the text), whether each is a slot, whether each may be a name that opens a sentence, and the index of each row's first token."""
    inside = _WORD[data]
    if len(data) > 2:  # a point or comma between digits belongs to the number
        joint = ((data[1:-1] == 46) | (data[1:-1] == 44)) & _DIGIT[data[:-2]] & _DIGIT[data[2:]]
        inside[1:-1] |= joint
    inside |= _SIGNS[data]
    starts, ends, rows = word_bounds(data, offsets, inside)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, bool), rows
    h = span_hashes(fold(data), starts, ends)
    number = _DIGIT[data[starts]]
    letters = code_points(data)
    capital = _UPPER[letters[starts]]
    # A sentence opens at the start of a row, or when the gap before the word has an end sign.
    marks = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_ENDS[data] & ~inside, out=marks[1:])
    opens = np.ones(len(starts), bool)
    opens[1:] = marks[starts[1:]] > marks[ends[:-1]]
    opens[rows[:-1][rows[:-1] < len(starts)]] = True
    smalls = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_LOWER[letters], out=smalls[1:])
    named = capital & ~number & (smalls[ends] > smalls[starts])
    name = named & ~opens
    after = np.zeros(len(starts), bool)
    after[1:] = number[:-1]
    after[rows[:-1][rows[:-1] < len(starts)]] = False
    units = _unit_hashes()
    unit = after & (units[np.minimum(np.searchsorted(units, h), len(units) - 1)] == h) & ~number
    token = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, h)))
    return token, h, number | name | unit, named & opens & ~unit, rows


#: Length of a window, and whether it is of the fillers and not of the template.
KINDS = [(WINDOW, False), *((n, False) for n in range(WINDOW - 1, LITERALS - 1, -1)), *((n, True) for n in range(WINDOW, LITERALS - 1, -1))]


def windows(parts: tuple[np.ndarray, ...], kind: int, passes: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """Row, place in the row, hash, whether an opener is read as a name, and slots (place in the window and filler) of a template's windows; only those in the filter where one is given."""
    token, filler, slot, opener, rows = parts
    length, literal = KINDS[kind]
    row, at = within_rows(rows, length)
    if not len(at):
        return
    if literal:
        token, slot, opener = filler, np.zeros_like(slot), np.zeros_like(opener)
    slots = np.zeros(len(slot) + 1, np.int64)
    np.cumsum(slot, out=slots[1:])
    plain = length - (slots[at + length] - slots[at])
    openers = np.zeros(len(token) - length + 1, np.int64)
    for k in range(length):
        openers |= opener[k : k + len(openers)].astype(np.int64) << k
    openers = openers[at]
    there = np.unique(openers)
    for read in range(1 << length):  # the openers that are read as names
        if not ((there & read) == read).any():
            continue
        good = plain - read.bit_count() >= LITERALS
        good &= (openers & read) == read
        some = np.flatnonzero(good)
        if read:
            tokens = token[at[some][:, None] + np.arange(length)]
            tokens[:, [k for k in range(length) if read >> k & 1]] = _NAME
            h = ngram_hashes(tokens.ravel(), length)[::length] if len(some) else np.zeros(0, np.uint64)
        else:
            h = ngram_hashes(token, length)[at[some]]
        if kind:  # kinds have no window in common
            h = mix(h + np.uint64(kind))
        if passes is not None:
            bit = (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
            let = (passes[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)
            some, h = some[let], h[let]
        where, which = np.nonzero(slot[at[some][:, None] + np.arange(length)] | np.array([bool(read >> k & 1) for k in range(length)])) if len(some) else (np.zeros(0, np.int64),) * 2
        first = np.searchsorted(where, np.arange(len(some) + 1))
        yield row[some], at[some] - rows[row[some]], h, np.full(len(some), read > 0), first, which, filler[at[some][where] + which]


def kinds_of(parts: tuple[np.ndarray, ...]) -> np.ndarray:
    """The kind of each row's windows: the first that has one (-1: none)."""
    rows = parts[-1]
    out = np.full(len(rows) - 1, -1)
    for kind in range(len(KINDS) - 1, -1, -1):
        for row, *_ in windows(parts, kind):
            out[row] = kind
            break  # the first has the openers as words
    return out


_WINDOWS = "id long, kind int, place int, h long, loose boolean, slots array<int>, fillers array<long>"


def _emit(passes, kinds: list[int] | None):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if passes is None else passes.value
        for batch in batches:
            for a, _, data, offsets in text_slices(batch["text"]):
                parts = template(data, offsets)
                own = kinds_of(parts) if kinds is None else None
                for kind in kinds if own is None else np.unique(own[own >= 0]).tolist():
                    for row, place, h, loose, first, slots, fillers in windows(parts, kind, bits):
                        flat = pa.array(first, pa.int32())
                        made = pa.RecordBatch.from_arrays([
                            batch["id"].take(pa.array(row + a)).cast(pa.int64()), pa.array(np.full(len(row), kind), pa.int32()), pa.array(place, pa.int32()), pa.array(h.view(np.int64)), pa.array(loose),
                            pa.ListArray.from_arrays(flat, pa.array(slots, pa.int32())), pa.ListArray.from_arrays(flat, pa.array(fillers.view(np.int64))),
                        ], ["id", "kind", "place", "h", "loose", "slots", "fillers"])
                        yield made if own is None else made.filter(pa.array(own[row] == kind))

    return run


def _windows(texts: DataFrame, key: str, passes, kinds: list[int] | None) -> DataFrame:  # noqa: ANN001
    some = texts.select(F.col(key).alias("id"), "text").where("id is not null and text is not null")
    return some.mapInArrow(_emit(passes, kinds), _WINDOWS)


def _clashes(pairs: set[tuple[int, int]]) -> tuple[set[int], set[int]]:
    """Fillers of the item that stand for several, and fillers of the document that several stand for."""
    left, right = Counter(a for a, _ in pairs), Counter(b for _, b in pairs)
    return {a for a, n in left.items() if n > 1}, {b for b, n in right.items() if n > 1}


def covered(hits: list[tuple[int, int, bool, list[tuple[int, int]]]]) -> tuple[int, bool]:
    """Number of the item's windows that consistent alignments have, and whether all fillers are the same. hits: (item place, shift, loose, pairs of fillers)."""
    alignments: dict[int, list] = {}
    for place, shift, loose, pairs in hits:
        alignments.setdefault(shift, []).append((place, loose, pairs))
    fair = []
    for shift, found in alignments.items():
        strict = {p for _, loose, pairs in found if not loose for p in pairs}
        if any(_clashes(strict)):
            continue
        places = {place for place, loose, _ in found if not loose}
        loosely = [(place, pairs) for place, loose, pairs in found if loose and place not in places]
        a_bad, b_bad = _clashes(strict | {p for _, pairs in loosely for p in pairs})
        for place, pairs in loosely:
            if not any(a in a_bad or b in b_bad for a, b in pairs):
                places.add(place)
                strict.update(pairs)
        fair.append((-len(places), shift, places, strict))
    seen: set[int] = set()
    agreed: set[tuple[int, int]] = set()
    for _, _, places, pairs in sorted(fair, key=lambda x: x[:2]):
        if not any(_clashes(agreed | pairs)):
            agreed |= pairs
            seen |= places
    return len(seen), all(a == b for a, b in agreed)


_FOUND = "doc_id long, item_id long, coverage double, exact boolean"


def _cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc, item, n, hits in zip(*(batch[c].to_pylist() for c in ("doc_id", "item_id", "n", "hits")), strict=True):
            seen, exact = covered([(h["item_place"], h["shift"], h["loose"], list(zip(h["item_fillers"], h["fillers"], strict=True))) for h in hits])
            out.append((doc, item, seen / n, exact))
        columns = zip(*out, strict=True) if out else ([], [], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.bool_()), strict=True)], ["doc_id", "item_id", "coverage", "exact"])


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, coverage, exact): the benchmark items found in each document."""
    spark = docs.sparkSession
    items = _windows(benchmark, "item_id", None, None).distinct()
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    # At most 2^FILTER_BITS numbers for each of the few kinds, whatever the size of the benchmark.
    buckets = items.select("kind", F.shiftrightunsigned("h", 64 - FILTER_BITS).alias("b")).distinct().toPandas()
    bucket = np.array(buckets["b"], np.int64)
    np.bitwise_or.at(bits, bucket >> 3, (1 << (bucket & 7)).astype(np.uint8))
    kinds = sorted({int(k) for k in buckets["kind"].unique()})
    sizes = items.groupBy("id").agg(F.countDistinct("place").alias("n"))
    items = items.join(sizes, "id").select(F.col("id").alias("item_id"), F.col("place").alias("item_place"), "h", F.col("loose").alias("item_loose"), F.col("fillers").alias("item_fillers"), "n")
    hit = F.struct("item_place", (F.col("place") - F.col("item_place")).alias("shift"), (F.col("loose") | F.col("item_loose")).alias("loose"), "item_fillers", "fillers")
    # Hits of one document and one item meet; there are as many at most as the document has windows.
    hits = _windows(docs, "doc_id", spark.sparkContext.broadcast(bits), kinds).join(items, "h").groupBy(F.col("id").alias("doc_id"), "item_id", "n").agg(F.collect_set(hit).alias("hits"))
    return hits.mapInArrow(_cover, _FOUND).where(F.col("coverage") >= coverage)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents in which a benchmark item is found."""
    lose = contaminated(docs, benchmark).select(F.col("doc_id").alias("_lost")).distinct()
    return docs.join(lose, docs["doc_id"] == lose["_lost"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
