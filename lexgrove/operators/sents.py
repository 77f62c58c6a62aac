"""Sentence boundaries by rules.

A sentence ends after a token that ends in a full stop (with closing quotes or brackets), unless it or the one before is a safe acronym or abbreviation. It
also ends before a token that holds one of the special starters, after a noun, name, adjective or adverb, or after a line break. The first token of a
sentence is never tested, so that of adjoining boundaries every other counts. Exclamation and question marks end no sentence.

Results for odd input: null words have null starts and no sentences, empty ones none; missing or null tags are no noun's; rows that repeat an id are cut each; other columns aren't read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx

SAFE_ACRONYM = r"^(?:tm|TM|Std|Nor|Fig|FIG|Figs|FIGS|pat|Pat|ser|Ser|No|Num|eg|[1-9][0-9])$"
SAFE_ABBREVIATION = r"^[a-zA-Z]{1,3}\."
ENDS = r"\.[\"')\]]*$"
STARTER = r"(?:The|This|That|Those|These|Who|When|What|Which|Where|Whose)"
BEFORE_STARTER = ("NOUN", "PROPN", "ADJ", "ADV", "NN", "NNS", "NNP", "NNPS", "JJ", "RB")

_safe = regex.compile(f"{SAFE_ACRONYM}|{SAFE_ABBREVIATION}")
_ends, _starter, _marks = regex.compile(ENDS), regex.compile(STARTER), regex.compile(r"(?:<A>)?(?:<E>)?(?:<S>)?$")


@functools.lru_cache(1 << 16)
def _told(value: str) -> tuple[bool, bool, bool, bool, bool]:
    """Of a token: whether it is safe, safe without marks, ends a sentence, is a starter, and breaks the line."""
    bare = _marks.sub("", value)
    return _safe.search(value) is not None, _safe.search(bare) is not None, _ends.search(bare) is not None, _starter.search(value) is not None, "\n" in value


def sentence_starts(value: np.ndarray, tag: np.ndarray, first: np.ndarray, values: list[str], tags: list) -> np.ndarray:
    """Tokens (by number, over all documents) that open a sentence. value and tag: codes; first: first token of each document, with a last entry."""
    n = len(value)
    if not n:
        return np.zeros(0, np.int64)
    safe, safe_bare, ends, starter, breaks = np.array([_told(v) for v in values], bool).reshape(-1, 5).T
    after = np.fromiter((t in BEFORE_STARTER for t in tags), bool, len(tags))
    inner = np.ones(n, bool)
    inner[first[:-1][first[:-1] < n]] = False
    before = np.zeros(n, np.int64)
    before[1:] = np.arange(n - 1)
    split = inner & starter[value] & (after[tag[before]] | breaks[value[before]])
    raw = inner & ~split & ends[value] & ~safe_bare[value] & ~safe[value[before]]
    # In a run of boundaries every other one counts, from the first on.
    at = np.arange(n)
    opens = raw & ~np.concatenate([[False], raw[:-1]])
    run = np.maximum.accumulate(np.where(opens, at, -1))
    boundary = raw & ((at - run) % 2 == 0)
    starts = ~inner | split
    starts[1:] |= boundary[:-1]
    return np.flatnonzero(starts)


@tx.evaluated_once
@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _starts(words: pa.Array, pos: pa.Array) -> pa.Array:
    return pa.concat_arrays([pa.array([], pa.list_(pa.int32())), *(_of_piece(words.slice(k, n), pos.slice(k, n)) for k, n in tx.pieces(words))])


def _of_piece(words: pa.Array, pos: pa.Array) -> pa.Array:
    size = np.where(words.is_valid().to_numpy(zero_copy_only=False), np.diff(words.offsets.to_numpy()), 0)
    first = np.concatenate([[0], np.cumsum(size)])
    flat = words.flatten().dictionary_encode()
    tags = pos.flatten()
    if len(tags) != len(flat):
        tags = pa.array([t for ts, s in zip(pos.to_pylist(), size, strict=True) for t in (ts or [None] * int(s))], pa.string())
    tags = tags.dictionary_encode(null_encoding="encode")
    got = sentence_starts(flat.indices.to_numpy(zero_copy_only=False), tags.indices.to_numpy(zero_copy_only=False), first, flat.dictionary.to_pylist(), tags.dictionary.to_pylist())
    doc = np.searchsorted(first, got, "right") - 1
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(size) + 1)), pa.int32()), pa.array(got - first[doc], pa.int32()), mask=words.is_null() if words.null_count else None)


def starts_column(words: Column | str = "words", pos: Column | str | None = None) -> Column:
    """array<int> of the tokens that open a sentence; tags are optional."""
    words = F.col(words) if isinstance(words, str) else words
    return _starts(words, F.col(pos) if isinstance(pos, str) else (pos if pos is not None else F.lit(None).cast("array<string>")))


def with_sentences(docs: DataFrame) -> DataFrame:
    """docs with ``sent_starts``, from words and, where there is one, pos."""
    return docs.withColumn("sent_starts", starts_column("words", "pos" if "pos" in docs.columns else None))


def sentences(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, sent, start, end of every sentence."""
    got = with_sentences(docs).select(key, F.size("words").alias("n"), "sent_starts")
    ends = F.concat(F.slice("sent_starts", F.lit(2), F.size("sent_starts")), F.array("n"))
    return got.where("n > 0").select(key, F.posexplode(F.arrays_zip("sent_starts", ends.alias("ends"))).alias("sent", "s")).select(key, "sent", F.col("s.sent_starts").alias("start"), F.col("s.ends").alias("end"))
