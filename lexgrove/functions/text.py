"""Tokens and their attributes, as built-in column expressions and, for the matcher, as predicates over distinct values."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Abbreviations of at most three letters that keep their full stop.
ABBREVIATIONS = "Mr Mrs Ms Dr St Sr Jr vs etc eg ie cf al Inc Ltd Co No Nos Num Fig Vol pp Jan Feb Apr Jun Jul Aug Sep Oct Nov Dec Sgt Lt Col Gov Rev Hon Mt Ave".split()
#: A token is letters with full stops between and after them (U.S.), an abbreviation with its full stop, a number with points or commas between its digits, a
#: run of letters and digits, or a single other sign; the same in Java, RE2 and Python.
TOKEN = rf"(?:\p{{L}}\.){{2,}}|(?:{'|'.join(ABBREVIATIONS)})\.|\p{{N}}+(?:[.,]\p{{N}}+)+|[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}\s]"
#: The same tokens in Java: most are a whole run of letters and digits without a point or comma after it, which is told without trying the alternatives.
_JAVA_TOKEN = rf"[\p{{L}}\p{{N}}]++(?![.,])|{TOKEN}"
#: Tokens that Python works on at a time, but for a document that has more.
PIECE = 1 << 18

STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has have having he her here hers "
    "herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own same she should so some such than that the their theirs them "
    "themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your yours yourself yourselves"
).split()
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion trillion".split()

_URL = r"^(?:(?:https?|ftp)://\S+|www\.\S+|(?:[\p{L}\p{N}-]+\.)+(?:com|org|net|edu|gov|io|info|co|uk|de|fr|it|es|eu)(?:/\S*)?)$"
_EMAIL = r"^[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+$"
_NUMBER = r"^[+\-~±]?(?:\p{Nd}+(?:[.,]\p{Nd}+)*(?:/\p{Nd}+)?)$"

#: Flags that one regular expression decides, in the common subset of Java, RE2 and Python.
FLAG_PATTERNS = {
    "IS_ALPHA": r"^\p{L}+$",
    "IS_ASCII": r"^[\x00-\x7F]+$",
    "IS_DIGIT": r"^\p{Nd}+$",
    "IS_TITLE": r"^\p{Lu}\P{Lu}*$",
    "IS_PUNCT": r"^\p{P}+$",
    "IS_SPACE": r"^\s+$",
    "IS_BRACKET": r"^[()\[\]{}<>]$",
    "IS_QUOTE": r"^[\"'`«»‘’‚‛“”„‟‹›]+$",
    "IS_LEFT_PUNCT": r"^[(\[{<«‘‚‛“„‟‹]$",
    "IS_RIGHT_PUNCT": r"^[)\]}>»’”›]$",
    "IS_CURRENCY": r"^\p{Sc}$",
    "LIKE_URL": _URL,
    "LIKE_EMAIL": _EMAIL,
}
FLAGS = [*FLAG_PATTERNS, "IS_LOWER", "IS_UPPER", "IS_STOP", "LIKE_NUM"]


def words(text: Column | str) -> Column:
    """array<string> of the tokens of a text; null for a null."""
    return F.regexp_extract_all(text, F.lit(_JAVA_TOKEN), F.lit(0))


def tokenize(docs: DataFrame, text: str = "text", to: str = "words") -> DataFrame:
    return docs.withColumn(to, words(F.col(text)))


def explode_tokens(docs: DataFrame, key: str = "doc_id", of: str = "words") -> DataFrame:
    """The long form: key, i (place), token."""
    return docs.select(key, F.posexplode(of).alias("i", "token"))


def flag(name: str, token: Column) -> Column:
    """A lexical flag of a token as a boolean column."""
    if name in FLAG_PATTERNS:
        return token.rlike(FLAG_PATTERNS[name])
    if name == "IS_LOWER":
        return (F.lower(token) == token) & (F.upper(token) != token)
    if name == "IS_UPPER":
        return (F.upper(token) == token) & (F.lower(token) != token)
    if name == "IS_STOP":
        return F.lower(token).isin(STOP_WORDS)
    if name == "LIKE_NUM":
        return token.rlike(_NUMBER) | F.lower(token).isin(NUMBER_WORDS)
    raise ValueError(f"unknown flag: {name}")


def shape(token: Column) -> Column:
    """X for upper case, x for other letters, d for digits, runs of more than four cut to four; LONG from 100 characters on."""
    out = token
    for kind, mark in ((r"\p{Lu}", "X"), (r"\p{Nd}", "d")):
        out = F.regexp_replace(out, kind, "\x01" if mark == "X" else "\x02")
    out = F.translate(F.regexp_replace(out, r"\p{L}", "x"), "\x01\x02", "Xd")
    for mark in "Xxd":
        out = F.regexp_replace(out, mark + "{4,}", mark * 4)
    return F.when(F.length(token) >= 100, F.lit("LONG")).otherwise(out)


def prefix(token: Column) -> Column:
    return F.left(token, F.lit(1))


def suffix(token: Column) -> Column:
    return F.right(token, F.lit(3))


_compiled = {name: regex.compile(p) for name, p in FLAG_PATTERNS.items()}
_number, _stops, _numbers = regex.compile(_NUMBER), frozenset(STOP_WORDS), frozenset(NUMBER_WORDS)


def _shape(t: str) -> str:
    if len(t) >= 100:
        return "LONG"
    out = "".join("d" if c.isdecimal() else ("X" if c.isupper() and c.isalpha() else ("x" if c.isalpha() else c)) for c in t)
    return regex.sub(r"([Xxd])\1{4,}", lambda m: m[1] * 4, out)


def value_flag(name: str) -> Callable[[str], bool]:
    """The same flags over a Python string, for evaluation on distinct tokens."""
    if name in _compiled:
        search = _compiled[name].search
        return lambda t: search(t) is not None
    return {
        "IS_LOWER": lambda t: t.lower() == t and t.upper() != t,
        "IS_UPPER": lambda t: t.upper() == t and t.lower() != t,
        "IS_STOP": lambda t: t.lower() in _stops,
        "LIKE_NUM": lambda t: _number.search(t) is not None or t.lower() in _numbers,
    }[name]


def value_attribute(name: str) -> Callable[[str], str]:
    """A textual attribute over a Python string."""
    same = lambda t: t
    return {"TEXT": same, "ORTH": same, "NORM": str.lower, "LOWER": str.lower, "LENGTH": str.lower, "SHAPE": _shape}[name]


def offsets_of(text: str, tokens: list[str]) -> list[int]:
    """Character place of each token in the text."""
    out, at = [], 0
    for t in tokens:
        at = text.index(t, at)
        out.append(at)
        at += len(t)
    return out


def pieces(words: pa.Array, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """First row and number of rows of pieces of an Arrow batch, of at most so many tokens, or of one document that has more: what is made of a piece stays small, whatever the batch."""
    ends = np.cumsum(np.diff(words.offsets.to_numpy().astype(np.int64)))
    at = 0
    while at < len(words):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, end - at
        at = end


_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True


def _sizes(words: pa.Array) -> np.ndarray:
    return np.where(words.is_valid().to_numpy(zero_copy_only=False), np.diff(words.offsets.to_numpy().astype(np.int64)), 0)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of texts, and where each begins, with a last entry; nulls are empty."""
    texts = (texts.fill_null("") if texts.null_count else texts).cast(pa.large_string())
    _, places, data = texts.buffers()
    at = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)), at - at[0]


def places_of(text: pa.Array, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Character place of each token over all texts written one after another; the first token of each document and the place of its text, each with a last entry.

    Tokens that hold all that isn't white space are placed by counting; a document whose tokens don't is searched. Rows that lack a text or tokens have none."""
    either = text.is_valid().to_numpy(zero_copy_only=False) & tokens.is_valid().to_numpy(zero_copy_only=False)
    if not either.all():
        none = pa.array(either)
        text, tokens = pc.if_else(none, text, pa.scalar(None, text.type)), pc.if_else(none, tokens, pa.scalar(None, tokens.type))
    data, begin = _bytes(text)
    flat = tokens.flatten()
    said, token = _bytes(flat)
    first = np.concatenate([[0], np.cumsum(_sizes(tokens))])
    char = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    solid = np.flatnonzero(~_SPACES[data])
    # Bytes that aren't white space, and bytes of tokens, by document.
    n_solid, n_said = np.searchsorted(solid, begin), token[first]
    good = len(solid) == len(said) and np.array_equal(n_solid, n_said) and np.array_equal(data[solid], said) and bool(np.all(np.diff(token) > 0))
    if good:
        ends = solid[token[1:] - 1]
        at = solid[token[:-1]]
        good = np.array_equal(ends - at + 1, np.diff(token))
    if good:
        return char[at], first, char[begin]
    out = [np.zeros(0, np.int64)]
    for k, (t, ws) in enumerate(zip(text, tokens, strict=True)):
        if t.is_valid:
            out.append(np.array(offsets_of(t.as_py(), ws.as_py()), np.int64) + char[begin[k]])
    return np.concatenate(out), first, char[begin]


def evaluated_once(udf):  # noqa: ANN001, ANN201
    """A function in Python that no condition on what is made of it is carried past: else the condition has it, and the cutting into tokens below it, done once more."""
    return udf.asNondeterministic()


@evaluated_once
@F.arrow_udf(T.ArrayType(T.IntegerType()))
def token_starts(text: pa.Array, tokens: pa.Array) -> pa.Array:
    """Character place of each token; linear in the text."""
    out = [pa.array([], pa.list_(pa.int32()))]
    for k, n in pieces(tokens):
        t, ws = text.slice(k, n), tokens.slice(k, n)
        place, first, begin = places_of(t, ws)
        none = ~(t.is_valid().to_numpy(zero_copy_only=False) & ws.is_valid().to_numpy(zero_copy_only=False))
        out.append(pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(place - np.repeat(begin[:-1], np.diff(first)), pa.int32()), mask=pa.array(none) if none.any() else None))
    return pa.concat_arrays(out)


def _before(text: pa.Array, tokens: pa.Array, at: pa.Array, side: str) -> pa.Array:
    """Number of tokens of each document that begin before a character, or at it (side right)."""
    out = [pa.array([], pa.int32())]
    for k, n in pieces(tokens):
        place, first, begin = places_of(text.slice(k, n), tokens.slice(k, n))
        to = at.slice(k, n)
        where = begin[:-1] + to.fill_null(0).to_numpy(zero_copy_only=False)
        got = np.clip(np.searchsorted(place, where, side), first[:-1], first[1:]) - first[:-1]
        none = pc.or_(pc.or_(text.slice(k, n).is_null(), tokens.slice(k, n).is_null()), to.is_null()).to_numpy(zero_copy_only=False)
        out.append(pa.array(got, pa.int32(), mask=none))
    return pa.concat_arrays(out)


@evaluated_once
@F.arrow_udf(T.IntegerType())
def starts_until(text: pa.Array, tokens: pa.Array, at: pa.Array) -> pa.Array:
    """Number of tokens that begin at a character or before it."""
    return _before(text, tokens, at, "right")


@evaluated_once
@F.arrow_udf(T.IntegerType())
def starts_before(text: pa.Array, tokens: pa.Array, at: pa.Array) -> pa.Array:
    """Number of tokens that begin before a character."""
    return _before(text, tokens, at, "left")


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is evaluated once, and not again in each step of a lambda of f."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def char_to_token(starts: Column, at: Column) -> Column:
    """Token of a character, by the places of the tokens: a character on the space after a token belongs to the next one."""
    return _once(at, lambda a: F.size(F.filter(starts, lambda s: s <= a))) - 1


def char_span_to_tokens(starts: Column, text_length: Column, begin: Column, end: Column) -> Column:
    """Half-open token range of a half-open character range; an end within a token takes the token in."""
    first = F.greatest(F.lit(0), char_to_token(starts, begin))
    last = F.when(end >= text_length, F.size(starts)).otherwise(_once(end, lambda e: F.size(F.filter(starts, lambda s: s < e))))
    return F.struct(first.alias("start"), F.greatest(last, first + F.lit(1)).alias("end"))
