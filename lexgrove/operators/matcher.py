"""Token-pattern matching.

A pattern's distinct token tests make a symbol for each token, and the pattern an ordinary regular expression over the symbols. From each start there is at
most one match, the one that the expression prefers; matches that end where an earlier one does are dropped, and so are repeats within a rule.

``match`` runs any number of rules in one pass: tests are evaluated on the distinct values of an Arrow batch only, values to be equal to are looked up, and a pattern looks at the documents only that have a
token for each of the tests it can't do without, found through the tokens of each value. So the cost of a rule follows its hits, and thousands of rules cost little
more than one. There is no shuffle. ``match_native`` does one pattern in built-in expressions.

Results for odd input: null or empty ``words`` have no match; a null key stays null; rows that repeat a key are matched each, with their own text; a null annotation fits no test but
NOT_IN and "!"; other columns aren't read, whatever their names.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .rules import Compiled, RuleSet, Test, Unit, compile_pattern

MATCHES = "rule string, rule_ord int, pattern_ord int, start int, end int"
_COMPARE = {"==": operator.eq, "!=": operator.ne, ">=": operator.ge, "<=": operator.le, ">": operator.gt, "<": operator.lt}
_END = 0x0A
_FIRST = 0x4E00


def _unanchored(pattern: str) -> tuple[str, bool]:
    """The expression without ^ and $, and whether it had one of them."""
    parts = regex.split(r"(?<![\[\\])\^|(?<!\\)\$", pattern)
    return "".join(parts), len(parts) > 1


def value_test(test: Test, compat: bool) -> Callable[[object], bool]:
    """The test over one value of its attribute (the token's text for flags)."""
    of = tx.value_attribute(test.attr) if test.attr in ("TEXT", "ORTH", "LOWER", "LENGTH", "SHAPE") and not test.extension else (lambda v: v)
    if test.kind == "flag":
        if test.attr == "IS_SENT_START":
            return lambda v: bool(v) is test.value
        has = tx.value_flag(test.attr)
        return lambda v: has(v) is test.value
    lower = test.attr in ("LOWER", "LENGTH") and not test.extension
    if test.attr == "LEMMA" and not test.extension:
        of = lambda v: v.lower() if isinstance(v, str) else v
    if test.kind == "eq":
        want = test.value.lower() if lower and isinstance(test.value, str) else test.value
        if isinstance(want, bool):
            return lambda v: v is want or (isinstance(v, str) and v == str(want))
        return lambda v: of(v) == want or (isinstance(want, str) and v is not None and not isinstance(v, str) and str(v) == want)
    if test.kind in ("in", "not_in"):
        if test.attr == "LENGTH" and not test.extension:
            sizes = frozenset(test.value)
            return (lambda v: len(v) in sizes) if test.kind == "in" else (lambda v: len(v) not in sizes)
        members = frozenset(m.lower() if lower and isinstance(m, str) else m for m in test.value)
        if test.kind == "in":
            return lambda v: of(v) in members
        if compat:
            heads = tuple(str(m) for m in members)
            return lambda v: not str(of(v)).startswith(heads)
        return lambda v: of(v) not in members
    if test.kind == "regex":
        bare, whole = _unanchored(test.value)
        compiled = regex.compile(bare, regex.I if lower else 0)
        fits = compiled.fullmatch if whole else compiled.search
        return lambda v: v is not None and fits(str(of(v))) is not None
    compare = _COMPARE[test.op]
    return lambda v: v is not None and compare(v if isinstance(v, int | float) and not isinstance(v, bool) else len(str(v)), test.value)


@functools.lru_cache(256)
def _kept_test(test: Test, compat: bool) -> Callable[[object], bool]:
    """The test, which keeps what it has told of values, from one piece to the next."""
    return functools.lru_cache(1 << 16)(value_test(test, compat))


class _Batch:
    """The tokens of an Arrow batch, by their distinct values."""

    def __init__(self, batch: pa.RecordBatch, columns: dict[str, str]):
        words = batch["words"]
        self.n = len(words)
        offsets = words.offsets.to_numpy().astype(np.int64)
        size = np.where(words.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
        self.first = np.concatenate([[0], np.cumsum(size)])
        self.flat = {"words": words.flatten()}
        for name, column in columns.items():
            # A null annotation, of a document or of a token, is a null value that no test but NOT_IN and "!" fits.
            got = batch[column]
            if not len(got.flatten()) == len(self.flat["words"]):
                got = pa.array([(v or [None] * int(s)) for v, s in zip(got.to_pylist(), size, strict=True)], got.type)
            self.flat[name] = got.flatten()
            if len(self.flat[name]) != len(self.flat["words"]):
                raise ValueError(f"{column} hasn't a value for each token")
            if name == "NORM":
                self.flat[name] = pc.coalesce(self.flat[name].cast(pa.string()), pc.utf8_lower(self.flat["words"]))
        self.codes: dict[str, tuple[np.ndarray, list]] = {}
        self.places: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.found: dict[tuple[str, str], dict[str, list[int]] | None] = {}
        self.tests: dict[tuple[Test, bool], np.ndarray] = {}

    def encoded(self, name: str) -> tuple[np.ndarray, list]:
        """The code of each token's value, and the values."""
        if name not in self.codes:
            got = self.flat[name].dictionary_encode(null_encoding="encode")
            self.codes[name] = (got.indices.to_numpy(zero_copy_only=False), got.dictionary.to_pylist())
        return self.codes[name]

    def tokens_of(self, name: str, codes: np.ndarray) -> np.ndarray:
        """The tokens that have one of the codes, ascending."""
        if name not in self.places:
            every, values = self.encoded(name)
            self.places[name] = (np.argsort(every, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(every, minlength=len(values)))]))
        order, first = self.places[name]
        got = [order[first[c] : first[c + 1]] for c in codes]
        return np.sort(np.concatenate(got)) if len(got) > 1 else got[0] if got else np.zeros(0, np.int64)

    def name_of(self, test: Test) -> str:
        return f"_.{test.attr}" if test.extension else (test.attr if test.attr in self.flat else "words")

    def lookup(self, name: str, kind: str) -> dict[str, list[int]] | None:
        """Codes by value, as the test's attribute has it; None where values aren't texts."""
        if (name, kind) not in self.found:
            _, values = self.encoded(name)
            made: dict[str, list[int]] | None = None
            if all(v is None or isinstance(v, str) for v in values):
                of = {"LOWER": str.lower, "LEMMA": str.lower}.get(kind, lambda v: v)
                made = {}
                for c, v in enumerate(values):
                    if v is not None:
                        made.setdefault(of(v), []).append(c)
            self.found[name, kind] = made
        return self.found[name, kind]

    def codes_of(self, test: Test, compat: bool) -> np.ndarray:
        """The codes whose values fit."""
        key = (test, compat)
        if key not in self.tests:
            name = self.name_of(test)
            _, values = self.encoded(name)
            wanted = [test.value] if test.kind == "eq" else list(test.value) if test.kind == "in" else [None]
            by = None
            if all(isinstance(w, str) for w in wanted) and (test.extension or test.attr not in ("SHAPE", "LENGTH")):
                by = self.lookup(name, "" if test.extension else test.attr if test.attr in ("LOWER", "LEMMA") else "")
            if by is not None:
                low = not test.extension and test.attr == "LOWER"
                self.tests[key] = np.array(sorted({c for w in wanted for c in by.get(w.lower() if low else w, ())}), np.int64)
            else:
                fits = _kept_test(test, compat)
                self.tests[key] = np.flatnonzero(np.fromiter((fits(v) for v in values), bool, len(values)))
        return self.tests[key]

    def fits(self, test: Test, compat: bool, tokens: np.ndarray) -> np.ndarray:
        codes, values = self.encoded(self.name_of(test))
        has = np.zeros(max(1, len(values)), bool)
        has[self.codes_of(test, compat)] = True
        return has[codes[tokens]]

    def positions(self, unit: Unit) -> np.ndarray:
        """The tokens that a unit that isn't negated fits."""
        named = [(self.name_of(t), self.codes_of(t, unit.compat)) for t in unit.tests]
        least = min(range(len(named)), key=lambda k: len(named[k][1]))
        got = self.tokens_of(*named[least])
        for k, t in enumerate(unit.tests):
            if k != least and len(got):
                got = got[self.fits(t, unit.compat, got)]
        return got

    def at(self, unit: Unit, tokens: np.ndarray) -> np.ndarray:
        """For each of the tokens, whether the unit fits."""
        out = None
        for t in unit.tests:
            if unit.negated and unit.compat and t.kind == "eq" and isinstance(t.value, str):
                codes, values = self.encoded(self.name_of(t))
                low = t.attr == "LOWER"
                by_value = np.fromiter((str(v).lower().startswith(t.value.lower()) if low else str(v).startswith(t.value) for v in values), bool, len(values))
                each = by_value[codes[tokens]]
            else:
                each = self.fits(t, unit.compat, tokens)
            out = each if out is None else (out | each) if unit.negated and unit.compat else (out & each)
        return ~out if unit.negated else out


def _class(present: np.ndarray, bit: int) -> str:
    chars = [k for k, mask in enumerate(present.tolist()) if mask >> bit & 1]
    return "[" + "".join(chr(_FIRST + k) for k in chars) + "]" if chars else "(?!)"


def _expand(first: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers of the given documents, and their firsts (with a last entry)."""
    size = first[docs + 1] - first[docs]
    at = np.concatenate([[0], np.cumsum(size)])
    return np.arange(at[-1]) + np.repeat(first[docs] - at[:-1], size), at


_ATOM = regex.compile(r"\{(\d+)\}([+*?]?\??)")


def _may_begin(template: str, present: np.ndarray, text: np.ndarray) -> np.ndarray | None:
    """Places where a match may begin, or None for all.

    Where a pattern is a row of units whose last one is a single token that fits none of the others, what stands before the first token that fits none of those decides: else each place of a long run is tried, and run through to no end."""
    atoms = _ATOM.findall(template)
    if len(atoms) < 2 or "".join(f"{{{k}}}{q}" for k, q in atoms) != template or atoms[-1][1]:
        return None
    fits = lambda k: (present >> int(k) & 1).astype(bool)
    inner = np.logical_or.reduce([fits(k) for k, _ in atoms[:-1]])
    last = fits(atoms[-1][0])
    if (inner & last).any():
        return None
    # The end sign fits nothing.
    inner, last = np.append(inner, False), np.append(last, False)
    symbol = np.where(text == _END, len(present), text.astype(np.int64) - _FIRST)
    stops = np.flatnonzero(~inner[symbol])
    first = np.append(fits(atoms[0][0]), False) if not atoms[0][1].startswith(("*", "?")) else inner | last
    at = np.flatnonzero(first[symbol])
    stop = stops[np.searchsorted(stops, at)]
    return at[last[symbol[stop]]]


def _scan(batch: _Batch, pattern: Compiled, cache: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and end of the matches of a pattern, those with the end of the one before left out."""
    none = (np.zeros(0, np.int64),) * 3
    docs = None
    for k in sorted(pattern.required):
        at = batch.positions(pattern.units[k])
        if not len(at):
            return none
        if pattern.template == "{0}":  # a single token
            doc = np.searchsorted(batch.first, at, "right") - 1
            return doc, at - batch.first[doc], at - batch.first[doc] + 1
        has = np.zeros(batch.n, bool)
        has[np.searchsorted(batch.first, at, "right") - 1] = True
        docs = np.flatnonzero(has) if docs is None else docs[has[docs]]
        if not len(docs):
            return none
    if docs is None:
        docs = np.flatnonzero(np.diff(batch.first) > 0)
    if not len(docs):
        return none
    tokens, first = _expand(batch.first, docs)
    fits = [batch.at(u, tokens) for u in pattern.units]
    mask = np.zeros(len(tokens), np.int64)
    for k, f in enumerate(fits):
        mask |= f.astype(np.int64) << k
    if len(fits) <= 16:
        number = np.bincount(mask)
        present = np.flatnonzero(number)
        number[present] = np.arange(len(present))
        symbol = number[mask]
    else:
        present, symbol = np.unique(mask, return_inverse=True)
    key = (id(pattern), present.tobytes())
    if key not in cache:
        cache[key] = regex.compile(pattern.template.format(*(_class(present, k) for k in range(len(fits))), any=r"[^\n]"))
    # One string for all: an end sign stands after each document.
    text = np.full(len(tokens) + len(docs), _END, "<u4")
    owner = np.repeat(np.arange(len(docs)), np.diff(first))
    text[np.arange(len(tokens)) + owner] = symbol + _FIRST
    written = text.tobytes().decode("utf-32-le")
    begins = _may_begin(pattern.template, present, text)
    if begins is None:
        found = (m.span() for m in cache[key].finditer(written, overlapped=True))
    else:
        at = cache[key].match
        found = (m.span() for m in (at(written, p) for p in begins.tolist()) if m)
    spans = np.array(list(found), np.int64).reshape(-1, 2)
    spans = spans[spans[:, 1] > spans[:, 0]]
    if not len(spans):
        return none
    begins = first[:-1] + np.arange(len(docs))
    which = np.searchsorted(begins, spans[:, 0], "right") - 1
    keep = np.ones(len(spans), bool)
    keep[1:] = (spans[1:, 1] != spans[:-1, 1]) | (which[1:] != which[:-1])
    which, spans = which[keep], spans[keep]
    return docs[which], spans[:, 0] - begins[which], spans[:, 1] - begins[which]


def _scan_raw(texts: list[str | None], tokens: list[list[str] | None], xp: regex.Pattern) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matches over the raw text; character bounds are rounded forward to token starts."""
    out = []
    for k, (text, ws) in enumerate(zip(texts, tokens, strict=True)):
        if not text or not ws:
            continue
        starts = None
        last = -1
        for m in xp.finditer(text, overlapped=True):
            if m.end() == m.start():
                continue
            if starts is None:
                starts = np.array([*tx.offsets_of(text, ws), len(text)])
            a, b = (int(np.searchsorted(starts, x)) for x in m.span())
            a, b = min(a, len(ws)), min(b, len(ws))
            if b != last and b > a:
                out.append((k, a, b))
                last = b
    got = np.array(out, np.int64).reshape(-1, 3)
    return got[:, 0], got[:, 1], got[:, 2]


def _texts(batch: _Batch, doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The tokens of spans, joined by spaces."""
    size = end - start
    first = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(first[-1]) + np.repeat(batch.first[doc] + start - first[:-1], size)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(first, pa.int32()), batch.flat["words"].take(pa.array(at))), " ")


def _run(rules: list[tuple[str, int, list[tuple[int, Compiled]]]], columns: dict[str, str], key: str, text: bool, packed: Callable | None = None):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for record in (b.slice(k, n) for b in batches for k, n in tx.pieces(b["words"])):
            batch = _Batch(record, columns)
            parts = []
            for name, ord_, patterns in rules:
                found = []
                for p, pattern in patterns:
                    if pattern.raw is None:
                        d, s, e = _scan(batch, pattern, cache)
                    else:
                        if pattern.raw not in cache:
                            cache[pattern.raw] = regex.compile(pattern.raw, regex.M)
                        d, s, e = _scan_raw(record["text"].to_pylist(), record["words"].to_pylist(), cache[pattern.raw])
                    found.append((np.full(len(d), p), d, s, e))
                p, d, s, e = (np.concatenate(x) for x in zip(*found, strict=True))
                if len(found) > 1 and len(d):
                    # A span that several patterns of a rule have is the first one's.
                    order = np.lexsort((p, e, s, d))
                    p, d, s, e = p[order], d[order], s[order], e[order]
                    keep = np.ones(len(d), bool)
                    keep[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1]) | (e[1:] != e[:-1])
                    p, d, s, e = p[keep], d[keep], s[keep], e[keep]
                if len(d):
                    parts.append((name, ord_, p, d, s, e))
            if not parts:
                continue
            docs, starts, ends = (np.concatenate([x[k] for x in parts]) for k in (3, 4, 5))
            if packed is not None:
                yield packed(record[key], docs, starts, ends, np.repeat([x[1] for x in parts], [len(x[3]) for x in parts]))
                continue
            yield pa.RecordBatch.from_arrays([
                record[key].take(pa.array(docs)),
                pa.array([x[0] for x in parts], pa.string()).take(pa.array(np.repeat(np.arange(len(parts)), [len(x[3]) for x in parts]))),
                pa.array(np.repeat([x[1] for x in parts], [len(x[3]) for x in parts]), pa.int32()), *(pa.array(np.concatenate([x[k] for x in parts]), pa.int32()) for k in (2, 4, 5)),
                *([_texts(batch, docs, starts, ends)] if text else []),
            ], [key, "rule", "rule_ord", "pattern_ord", "start", "end", *(["text"] if text else [])])

    return run


def match(docs: DataFrame, rules: RuleSet, key: str = "doc_id", allow_missing: bool = False, text: bool = False, packed: Callable | None = None) -> DataFrame:
    """key, rule, rule_ord, pattern_ord, start, end: the matches of all rules, in ``words`` of docs; and text, their tokens joined by spaces.

    ValueError when a rule needs an annotation that docs have no column for, unless ``allow_missing``; such an annotation is then null. A null norm is the token in lower case.

    packed: makes one row of each document's matches (see spans.pack), of the rules' numbers and without callbacks."""
    columns = rules.columns()
    missing = {a: c for a, c in columns.items() if c not in docs.columns}
    if set(missing) - {"NORM"} and not allow_missing:
        raise ValueError(f"no column for {', '.join(sorted(missing))}")
    for c in set(missing.values()):
        docs = docs.withColumn(c, F.transform("words", lambda w: F.lit(None).cast("string")))
    raw = any(c.raw is not None for r in rules.rules.values() for c in r.compiled)
    kept = docs.select(key, "words", *sorted(set(columns.values()) - {key, "words"}), *(["text"] if raw and "text" not in columns.values() else []))
    plain = [(r.key, k, list(enumerate(r.compiled))) for k, r in enumerate(rules.rules.values())]
    schema = f"`{key}` {dict(docs.dtypes)[key]}, {MATCHES}" + ", text string" * text
    if packed is not None:
        return kept.mapInArrow(_run(plain, columns, key, False, packed), f"`{key}` {dict(docs.dtypes)[key]}, start array<int>, end array<int>, rule array<int>")
    # Null words are left to the pass: a condition on them would have the texts cut into tokens twice.
    found = lambda some: kept.mapInArrow(_run(some, columns, key, text), schema)
    called = {r.key: r for r in rules.rules.values() if r.on_match is not None}
    if not called:
        return found(plain)
    # A pass for the rules without a callback, if there are any, and one for each with one: no match is made to be thrown away.
    rest = [p for p in plain if p[0] not in called]
    parts = ([found(rest)] if rest else []) + [called[p[0]].on_match(found([p])) for p in plain if p[0] in called]
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


# The native variant


def test_column(test: Test, token: Column) -> Column:
    of = {"TEXT": lambda t: t, "ORTH": lambda t: t, "LOWER": F.lower, "LENGTH": F.lower, "SHAPE": tx.shape, "LEMMA": F.lower}.get(test.attr)
    value = token["words"] if not test.extension and test.attr != "LEMMA" and (of or test.attr in tx.FLAGS) else token[test.attr if test.extension else test.attr.lower()]
    if test.kind == "flag":
        return tx.flag(test.attr, value) if test.value else ~tx.flag(test.attr, value)
    value = of(value) if of and not test.extension else value
    low = test.attr == "LOWER"
    if test.kind == "eq":
        return value == F.lit(test.value.lower() if low else test.value)
    if test.kind in ("in", "not_in"):
        has = value.isin([m.lower() if low and isinstance(m, str) else m for m in test.value])
        return has if test.kind == "in" else ~has
    if test.kind == "regex":
        bare, whole = _unanchored(test.value)
        return value.rlike(f"^(?:{bare})$" if whole else bare)
    return _COMPARE[test.op](F.length(value), test.value)


def match_native(docs: DataFrame, pattern: list[dict], key: str = "doc_id") -> DataFrame:
    """key, start, end of the matches of one pattern of at most six distinct tests, in built-in expressions alone."""
    compiled = compile_pattern(pattern)
    if compiled.raw is not None or len(compiled.units) > 6:
        raise ValueError("only patterns over tokens, of six distinct specs at most")
    names = ["words", *sorted({t.attr if t.extension else t.attr.lower() for u in compiled.units for t in u.tests if t.extension or t.attr in ("POS", "TAG", "DEP", "LEMMA", "ENT_TYPE", "NORM")})]
    token = F.arrays_zip(*names)
    alphabet = [chr(_FIRST + k) for k in range(1 << len(compiled.units))]

    def symbol(t: Column) -> Column:
        mask = F.lit(1)
        for k, u in enumerate(compiled.units):
            fits = F.lit(True)
            for x in u.tests:
                fits = fits & F.coalesce(test_column(x, t), F.lit(False))
            mask = mask + F.when(~fits if u.negated else fits, F.lit(1 << k)).otherwise(F.lit(0))
        return F.element_at(F.array(*map(F.lit, alphabet)), mask)

    expression = compiled.template.format(*("[" + "".join(a for j, a in enumerate(alphabet) if j >> k & 1) + "]" for k in range(len(compiled.units))), any=".")
    sym = docs.select(key, F.array_join(F.transform(token, symbol), "").alias("sym"))
    # One pass: each symbol gets the match that begins at it put before it, between two signs; so the work grows with the text and its matches, and not with its square.
    marked = F.regexp_replace("sym", f"(?=({expression}))", "\x01$1\x02")
    sizes = F.transform(F.regexp_extract_all(marked, F.lit("(?:\x01([^\x02]*)\x02)?[^\x01\x02]"), F.lit(1)), lambda m, i: F.struct(i.alias("start"), (i + F.length(m)).alias("end")))
    spans = F.filter(sizes, lambda s: s["end"] > s["start"])
    kept = F.filter("spans", lambda s, j: (j == 0) | (F.get("spans", j - 1)["end"] != s["end"]))
    return sym.select(key, spans.alias("spans")).select(key, F.explode(kept).alias("s")).select(key, "s.start", "s.end")
