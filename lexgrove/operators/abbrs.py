"""Abbreviations and their long forms.

Candidates are upper-case words of two letters or more, and what stands in brackets (up to eight tokens). A long one in brackets is the long form of the word before the bracket; a short one is the short form
of the words before it, in the same sentence. The letters of a short form are sought in the long form from right to left: the first one has to open a word, and no letter may pass over more than two
words. Results for odd input: null or empty words have no abbreviations; rows that repeat an id are searched each; a null id stays null; columns that aren't named aren't read. Every found form is then sought in the whole document, and each hit goes with the partner of the latest definition before it. The shorter one of a pair (in tokens, then in characters) is the short form.
"""

from __future__ import annotations

import functools
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from . import sents

_OPEN, _CLOSE = ("(", "["), (")", "]")
MOST_TOKENS = 8


class Pair(NamedTuple):
    short_start: int
    short_end: int
    long_start: int
    long_end: int


def align(long_form: str, short_form: str) -> tuple[int, int] | None:
    """Character bounds of the part of long_form that short_form abbreviates."""
    text, low = long_form, long_form.lower()
    if len(low) != len(text):  # a letter whose lower case is longer
        low = "".join(c.lower()[0] for c in text)
    letters = [c.lower()[0] if c.isalpha() else "" for c in short_form]
    end = len(text)
    while end and not text[end - 1].isalnum():
        end -= 1
    at = len(text) - 1
    k = len(letters) - 1
    passed = 0
    while k >= 0 and at >= 0:
        if not letters[k]:
            k -= 1
            continue
        if low[at].isspace():
            if passed == 2:
                break
            passed += 1
        if low[at] == letters[k] and (k > 0 or at == 0 or not text[at - 1].isalnum()):
            k -= 1
            passed = 0
        at -= 1
    if k >= 0 and any(letters[: k + 1]):
        return None
    begin = at + 1
    # The beginning has to open a word.
    if begin > 0 and begin < len(text) and text[begin].isalnum() and text[begin - 1].isalnum():
        return None
    return (begin, end) if begin < end else None


def is_short_form(tokens: list[str]) -> bool:
    text = "".join(tokens)
    return bool(text) and all(2 <= len(t) < 10 for t in tokens) and 2 * sum(c.isalpha() for c in text) >= len(text) and text[0].isalpha()


def candidates(words: list[str]) -> list[tuple[int, int]]:
    """Spans of upper-case words and of bracketed texts, without the brackets."""
    out = {(i, i + 1) for i, w in enumerate(words) if len(w) > 1 and w.isalpha() and w.isupper()}
    # What is between brackets ends at the first closing one.
    close = None
    nearest: list[int | None] = [None] * len(words)
    for i in range(len(words) - 1, -1, -1):
        nearest[i] = close
        if words[i] in _CLOSE:
            close = i
    for i, w in enumerate(words):
        end = nearest[i]
        if w in _OPEN and end is not None and end > i + 1 and words[i + 1] not in _OPEN:
            out.add((i + 1, end))
    return sorted(out)


def _bounds(words: list[str], spaces: list[bool], start: int, end: int) -> tuple[str, list[int]]:
    """Text of tokens, and the character place of each (with a last entry)."""
    parts, places, at = [], [], 0
    for i in range(start, end):
        places.append(at)
        part = words[i] + (" " if spaces[i] else "")
        parts.append(part)
        at += len(part)
    return "".join(parts), [*places, at]


def find_definition(words: list[str], spaces: list[bool], sent: list[int], start: int, end: int) -> Pair | None:
    """The definition that a candidate span is part of. spaces: whether white space follows a token; sent: sentence number of each token."""
    if end - start > MOST_TOKENS:
        return None
    if end - start > 1:
        if start < 2 or not is_short_form(words[start - 2 : start - 1]):
            return None
        short, long = (start - 2, start - 1), (start, end)
    else:
        size = len(words[start])
        begin = max(start - min(size + 5, 2 * size) - 1, 0)
        if begin >= start or sent[begin] != sent[start - 1]:
            return None
        short, long = (start, end), (begin, start)
    text, places = _bounds(words, spaces, *long)
    found = align(text, "".join(words[short[0] : short[1]]))
    if not found:
        return None
    first = max(k for k in range(len(places) - 1) if places[k] <= found[0])
    last = min(k for k in range(1, len(places)) if places[k] >= found[1])
    return Pair(*short, long[0] + first, long[0] + last)


def find_pairs(words: list[str], spaces: list[bool] | None = None, starts: list[int] | None = None, spans: list[tuple[int, int]] | None = None) -> list[Pair]:
    """All pairs of a document, in the order of the long forms. starts: tokens that open a sentence; spans: candidates other than the usual ones."""
    spans = candidates(words) if spans is None else spans
    if not spans:
        return []
    spaces = spaces or [True] * len(words)
    opens = set(starts or [0])
    sent, now = [], -1
    for i in range(len(words)):
        now += i in opens or i == 0
        sent.append(now)
    definitions = _definitions(words, spaces, sent, spans)
    heads = {form[0] for form in definitions}
    return _uses(words, definitions, [i for i, w in enumerate(words) if w in heads])


def _definitions(words, spaces, sent, spans) -> dict[tuple[str, ...], list[tuple[tuple[int, int], tuple[int, int]]]]:  # noqa: ANN001
    """By form, its places and their partners, in their order."""
    out: dict[tuple[str, ...], list[tuple[tuple[int, int], tuple[int, int]]]] = defaultdict(list)
    for start, end in spans:
        pair = find_definition(words, spaces, sent, start, end)
        if pair:
            short, long = (pair.short_start, pair.short_end), (pair.long_start, pair.long_end)
            out[tuple(words[slice(*short)])].append((short, long))
            out[tuple(words[slice(*long)])].append((long, short))
    for places in out.values():
        places.sort()
    return out


def _uses(words, definitions: dict, at: list[int]) -> list[Pair]:  # noqa: ANN001
    """Each use of a form with the partner of its latest definition. at: the places of the forms' first words."""
    heads: dict[str, list[tuple[str, ...]]] = defaultdict(list)
    for form in definitions:
        heads[form[0]].append(form)
    out: dict[tuple[int, int], Pair] = {}
    for i in at:
        for form in heads.get(words[i], ()):
            if tuple(words[i : i + len(form)]) != form:
                continue
            latest = bisect_right(definitions[form], i, key=lambda d: d[0][0]) - 1
            if latest < 0:
                continue
            partner = definitions[form][latest][1]
            hit = (i, i + len(form))
            size = lambda s: (s[1] - s[0], sum(map(len, words[slice(*s)])))
            short, long = sorted((hit, partner), key=size)
            out.setdefault((long[0], short[0]), Pair(*short, *long))
    return sorted(out.values(), key=lambda p: (p.long_start, p.short_start))


class _Row:
    """The tokens of a document in an Arrow batch, of which only those that are looked at become strings."""

    def __init__(self, codes: np.ndarray, values: list[str]):
        self.codes, self.values = codes, values

    def __getitem__(self, at):  # noqa: ANN001, ANN204
        return [self.values[c] for c in self.codes[at].tolist()] if isinstance(at, slice) else self.values[self.codes[at]]


class _All:
    """True for each place."""

    def __getitem__(self, at: int) -> bool:
        return True


class _Sentence:
    """The number of the sentence that a token is in."""

    def __init__(self, starts: list[int] | None):
        self.starts = sorted({*(starts or [0]), 0})

    def __getitem__(self, at: int) -> int:
        return bisect_right(self.starts, at) - 1


@functools.lru_cache(1 << 16)
def _kind(value: str | None) -> int:
    """1: an upper-case word, 2: an opening bracket, 4: a closing one."""
    return 0 if value is None else 1 * (len(value) > 1 and value.isalpha() and value.isupper()) + 2 * (value in _OPEN) + 4 * (value in _CLOSE)


def _pairs_of_piece(words: pa.Array, spaces: pa.Array, starts: pa.Array) -> list[list[Pair] | None]:
    """find_pairs() of each row: distinct tokens are looked at once, and then only what stands at candidates and uses."""
    size = np.where(words.is_valid().to_numpy(zero_copy_only=False), np.diff(words.offsets.to_numpy().astype(np.int64)), 0)
    first = np.concatenate([[0], np.cumsum(size)])
    flat = words.flatten().dictionary_encode(null_encoding="encode")
    codes, values = flat.indices.to_numpy(zero_copy_only=False), flat.dictionary.to_pylist()
    code_of = {v: c for c, v in enumerate(values)}
    kind = np.array([_kind(v) for v in values], np.int8)[codes] if len(codes) else np.zeros(0, np.int8)
    upper, opens, closes = (np.flatnonzero(kind & k) for k in (1, 2, 4))
    # What is between brackets ends at the first closing one.
    close = np.searchsorted(closes, opens, "right")
    ended = close < len(closes)
    opens, close = opens[ended], closes[close[ended]]
    same = np.searchsorted(first, opens, "right") == np.searchsorted(first, close, "right")
    some = same & (close > opens + 1) & (kind[np.minimum(opens + 1, max(0, len(kind) - 1))] & 2 == 0)
    begins, ends = np.concatenate([upper, opens[some] + 1]), np.concatenate([upper + 1, close[some]])
    owner = np.searchsorted(first, begins, "right") - 1
    order = np.lexsort((ends, begins))
    by_row = np.searchsorted(owner[order], np.arange(len(size) + 1))
    sought = np.zeros(len(values), bool)
    out: list[list[Pair] | None] = []
    for k in range(len(size)):
        if not words[k].is_valid:
            out.append(None)
            continue
        mine = order[by_row[k] : by_row[k + 1]]
        if not len(mine):
            out.append([])
            continue
        row = _Row(codes[first[k] : first[k + 1]], values)
        spans = sorted(set(zip((begins[mine] - first[k]).tolist(), (ends[mine] - first[k]).tolist(), strict=True)))
        definitions = _definitions(row, spaces[k].as_py() or _All(), _Sentence(starts[k].as_py()), spans)
        heads = [code_of[form[0]] for form in definitions]
        sought[heads] = True
        out.append(_uses(row, definitions, np.flatnonzero(sought[row.codes]).tolist()) if heads else [])
        sought[heads] = False
    return out


@tx.evaluated_once
@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def candidates_column(words: pa.Array) -> pa.Array:
    """The candidate spans of each document."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    return pa.array([None if w is None else [{"start": a, "end": b} for a, b in candidates(w)] for w in words.to_pylist()], kind)


_PAIRS = T.ArrayType(T.StructType([T.StructField(f, T.IntegerType()) for f in Pair._fields]))


@tx.evaluated_once
@F.arrow_udf(_PAIRS)
def _find(words: pa.Array, spaces: pa.Array, starts: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([(f, pa.int32()) for f in Pair._fields]))
    got = [row for k, n in tx.pieces(words) for row in _pairs_of_piece(words.slice(k, n), spaces.slice(k, n), starts.slice(k, n))]
    return pa.array([None if row is None else [p._asdict() for p in row] for row in got], kind)


def pairs_column(words: Column, spaces: Column | None = None, starts: Column | None = None) -> Column:
    none = lambda kind: F.lit(None).cast(f"array<{kind}>")
    return _find(words, none("boolean") if spaces is None else spaces, none("int") if starts is None else starts)


def with_abbreviations(docs: DataFrame) -> DataFrame:
    """docs with ``abbrs``; sentences (sent_starts) are found where docs don't bring them."""
    docs = docs if "sent_starts" in docs.columns else sents.with_sentences(docs)
    found = pairs_column(F.col("words"), F.col("spaces") if "spaces" in docs.columns else None, F.col("sent_starts"))
    return docs.withColumn("abbrs", F.coalesce(found, F.array().cast(_PAIRS)))


def abbreviations(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, the bounds of short and long form, and their texts."""
    text = lambda a, b: F.array_join(F.slice("words", F.col(a) + 1, F.col(b) - F.col(a)), " ")
    rows = with_abbreviations(docs).select(key, "words", F.explode("abbrs").alias("a")).select(key, "words", "a.*")
    return rows.withColumn("short_text", text("short_start", "short_end")).withColumn("long_text", text("long_start", "long_end")).drop("words")


def find_for_span(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The pairs that a given span (columns span_start and span_end of docs) is a candidate for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(i, *p) for i, w, s, e, b in zip(*(batch[c].to_pylist() for c in (key, "words", "span_start", "span_end", "sent_starts")), strict=True) if w for p in find_pairs(w, None, b, [(s, e)])]
            columns = list(zip(*got, strict=True)) if got else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch[key].type), *(pa.array(c, pa.int32()) for c in columns[1:])], [key, *Pair._fields])

    docs = docs if "sent_starts" in docs.columns else sents.with_sentences(docs)
    return docs.select(key, "words", "span_start", "span_end", "sent_starts").mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, short_start int, short_end int, long_start int, long_end int")
