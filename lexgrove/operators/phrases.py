"""Phrases: the matches of patterns, without those that end no later than an earlier one, or lie in a larger one.

Results for odd input: null or empty words have no phrases; null tags fit no pattern; rows that repeat an id are matched each, and their phrases taken together; other columns aren't read."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from . import spans
from .matcher import match
from .rules import RuleSet

#: Two noun phrases may be joined by a preposition or conjunction.
NOUN_PHRASE = [
    {"POS": {"IN": ["ADJ", "ADV", "DET", "NUM", "PROPN"]}, "OP": "*"},
    {"POS": {"IN": ["ADP", "CONJ", "CCONJ"]}, "OP": "?"},
    {"POS": {"IN": ["ADJ", "ADP", "ADV", "NOUN", "NUM", "PRON", "PROPN"]}, "OP": "*"},
    {"POS": {"IN": ["NOUN", "PROPN"]}},
]
VERB_PHRASE = [{"POS": {"IN": ["ADV", "AUX", "PART", "VERB"]}, "OP": "*"}, {"POS": {"IN": ["AUX", "VERB"]}}]

#: A lexicon of closed classes for texts that come without tags; what it doesn't hold is told by its shape and ending. It is no tagger.
CLOSED = {
    "DET": "the a an this that these those each every some any no",
    "ADP": "of in on at by for with from to into over under between through",
    "CCONJ": "and or but nor",
    "PRON": "i you he she it we they me him her us them who what which",
    "AUX": "is are was were be been being am has have had do does did will would can could may might must shall should",
    "ADV": "not very never always often also then there here now",
}


_CLOSED = {w: tag for tag, members in CLOSED.items() for w in members.split()}
_RULES = [(regex.compile(p), low, tag) for p, low, tag in (
    (r"^\p{N}[\p{N}.,]*$", False, "NUM"), (r"^[^\p{L}\p{N}]", False, "PUNCT"), (r"^\p{Lu}", False, "PROPN"),
    (r"^.{2,}(?:ly)$", True, "ADV"), (r"^.{2,}(?:ous|ful|able|ible|al|ive)$", True, "ADJ"), (r"^.{2,}(?:ed|ing)$", True, "VERB"),
)]


@functools.lru_cache(1 << 16)
def lexicon_tag(token: str | None) -> str | None:
    """A coarse tag of a token: closed classes by the lexicon, then numbers, signs, names and endings; NOUN for the rest."""
    if token is None:
        return None
    low = token.lower()
    return _CLOSED.get(low) or next((tag for p, lower, tag in _RULES if p.search(low if lower else token)), "NOUN")


@tx.evaluated_once
@F.arrow_udf(T.ArrayType(T.StringType()))
def _tags(words: pa.Array) -> pa.Array:
    """Each distinct token is tagged once."""
    return pa.concat_arrays([pa.array([], pa.list_(pa.string())), *(_of_piece(words.slice(k, n)) for k, n in tx.pieces(words))])


def _of_piece(words: pa.Array) -> pa.Array:
    flat = words.flatten().dictionary_encode()
    tags = pa.array([lexicon_tag(t) for t in flat.dictionary.to_pylist()], pa.string()).take(flat.indices)
    first = np.concatenate([[0], np.cumsum(np.where(words.is_valid().to_numpy(zero_copy_only=False), np.diff(words.offsets.to_numpy()), 0))])
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), tags, mask=words.is_null() if words.null_count else None)


def tag_by_lexicon(docs: DataFrame) -> DataFrame:
    """docs with a ``pos`` array; only for texts that bring no tags of their own."""
    return docs.withColumn("pos", _tags("words"))


def phrases(docs: DataFrame, patterns: list[list[dict]], name: str = "phrase", key: str = "doc_id") -> DataFrame:
    """key, start, end of the phrases that the patterns make."""
    return spans.outermost(match(docs, RuleSet().add(name, patterns), key, packed=spans.pack_outer), key)


def noun_phrases(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs with words and pos."""
    return phrases(docs, [NOUN_PHRASE], "noun_phrases", key)


def verb_phrases(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    return phrases(docs, [VERB_PHRASE], "verb_phrases", key)
