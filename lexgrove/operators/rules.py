"""The token-pattern language: rules, their checks, and their compiled form.

A pattern is a list of token specs; a spec maps attributes to values and may have a quantifier under OP:

    absent or 1  one token          ?  at most one          +  one or more          *  any number          !  one token that doesn't fit

A value is a literal, or predicates: {"REGEX": r}, {"IN": [...]}, {"NOT_IN": [...]}, and comparisons. Comparisons are of the length of a string, and
of the value itself for numbers. A literal with spaces stands for several tokens. A regular expression with ^ or $ has to fit the whole value, another
one may fit anywhere in it. A spec without attributes fits any token ("+" is then lazy). Attributes of a spec all have to fit; with "!" not all of
them. ``compat=True`` excludes by prefix, as NOT_IN and "!" once did: a value that begins with an excluded one is excluded too.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

import regex
from pyspark.sql import DataFrame

from ..functions import text as tx

STRINGS = {"ORTH", "TEXT", "LOWER", "POS", "TAG", "DEP", "LEMMA", "SHAPE", "ENT_TYPE", "NORM"}
BOOLEANS = {*tx.FLAGS, "IS_SENT_START", "SENT_START"}
COMPARISONS = {"==", "!=", ">=", "<=", ">", "<"}
SETS = {"IN", "NOT_IN"}
QUANTIFIERS = {"1", "?", "+", "*", "!"}
#: Annotations that a column has to bring; LEMMA, POS, TAG and DEP are refused without, unless missing ones are allowed.
ANNOTATED = {"POS": "pos", "TAG": "tag", "DEP": "dep", "LEMMA": "lemma", "ENT_TYPE": "ent_type", "NORM": "norm", "IS_SENT_START": "is_sent_start"}


class PatternError(ValueError):
    """Patterns that don't fit the language: by number of the pattern, what is wrong."""

    def __init__(self, key: str, errors: dict[int, list[str]]):
        super().__init__(f"invalid patterns for rule {key!r}: {errors}")
        self.key, self.errors = key, errors


def _kind_ok(value: Any, kinds: tuple[type, ...]) -> bool:
    return isinstance(value, kinds) and not (isinstance(value, bool) and bool not in kinds)


def check_pattern(pattern: Any) -> list[str]:
    """Everything in a pattern that the full schema doesn't allow."""
    if not isinstance(pattern, list):
        return ["a pattern is a list of token specs"]
    errors = []
    for i, spec in enumerate(pattern):
        if not isinstance(spec, dict):
            errors.append(f"[{i}] a token spec is a dict")
            continue
        for attr, value in normalise_spec(spec).items():
            where = f"[{i}.{attr}]"
            if attr == "OP":
                if value not in QUANTIFIERS:
                    errors.append(f"{where} unknown quantifier {value!r}")
            elif attr == "_":
                if not isinstance(value, dict):
                    errors.append(f"{where} extension attributes are a dict")
                    continue
                for name, v in value.items():
                    errors += _check_predicates(f"{where}.{name}", v, (str, int)) if isinstance(v, dict) else []
            elif attr in STRINGS or attr == "REGEX":
                if isinstance(value, dict):
                    errors += _check_predicates(where, value, (str,), comparisons=False)
                elif not isinstance(value, str):
                    errors.append(f"{where} not a string: {value!r}")
            elif attr == "LENGTH":
                if isinstance(value, dict):
                    errors += _check_predicates(where, value, (int,))
                elif not _kind_ok(value, (int,)):
                    errors.append(f"{where} not an integer: {value!r}")
            elif attr in BOOLEANS:
                if not isinstance(value, bool):
                    errors.append(f"{where} not a boolean: {value!r}")
            else:
                errors.append(f"{where} unknown attribute")
    return errors


def _check_predicates(where: str, value: dict, members: tuple[type, ...], comparisons: bool = True) -> list[str]:
    errors = []
    for p, a in value.items():
        if p == "REGEX":
            if not isinstance(a, str):
                errors.append(f"{where} REGEX takes a string")
        elif p in SETS:
            if not isinstance(a, list | tuple) or not all(_kind_ok(x, members) for x in a):
                errors.append(f"{where} {p} takes a list of {' or '.join(m.__name__ for m in members)}")
        elif p in COMPARISONS and comparisons:
            if not _kind_ok(a, (int,)):
                errors.append(f"{where} {p} takes an integer")
        else:
            errors.append(f"{where} unknown predicate {p!r}")
    return errors


def normalise_spec(spec: dict) -> dict:
    """Upper-case attribute and predicate names, SENT_START by its full name; the caller's spec stays as it is."""
    out = {}
    for attr, value in spec.items():
        attr = attr.upper() if isinstance(attr, str) and attr.islower() else attr
        attr = "IS_SENT_START" if attr == "SENT_START" else attr
        if isinstance(value, dict):
            value = {n: _upper_keys(v) for n, v in value.items()} if attr == "_" else _upper_keys(value)
        out[attr] = value
    return out


def _upper_keys(value: Any) -> Any:
    return {k.upper(): v for k, v in value.items()} if isinstance(value, dict) else value


@dataclass(frozen=True)
class Test:
    """One test of one attribute: kind is eq, in, not_in, regex, cmp or flag."""

    attr: str
    kind: str
    value: Any
    op: str = ""
    extension: bool = False


@dataclass(frozen=True)
class Unit:
    """One token: all tests hold; when negated, not all of them (compat: none of them)."""

    tests: tuple[Test, ...]
    negated: bool = False
    compat: bool = False


@dataclass
class Compiled:
    """A pattern as a regular expression over tokens: ``template`` has {k} for unit k, and {any} for any token."""

    units: list[Unit] = field(default_factory=list)
    template: str = ""
    #: Units that every match has a token for.
    required: set[int] = field(default_factory=set)
    #: A pattern over the raw text.
    raw: str | None = None

    def unit(self, unit: Unit) -> int:
        if unit not in self.units:
            self.units.append(unit)
        return self.units.index(unit)


def _as_list(value: Any) -> tuple:
    return tuple(value)


def _tests(attr: str, value: Any, extension: bool = False) -> list[Test]:
    if isinstance(value, dict):
        out = []
        for p, a in value.items():
            if p == "REGEX":
                out.append(Test(attr, "regex", a, extension=extension))
            elif p in SETS:
                out.append(Test(attr, p.lower(), _as_list(a), extension=extension))
            elif p in COMPARISONS:
                out.append(Test(attr, "cmp", a, p, extension))
            else:
                raise ValueError(f"unknown predicate {p!r} of {attr}")
        return out
    if attr in BOOLEANS and not extension:
        return [Test(attr, "flag", bool(value))]
    if attr == "LENGTH" and not extension:
        return [Test(attr, "cmp", int(value), "==")]
    return [Test(attr, "eq", value, extension=extension)]


def compile_pattern(pattern: list[dict], compat: bool = False) -> Compiled:
    """ValueError for what can't be compiled."""
    out = Compiled()
    specs = [normalise_spec(s) if isinstance(s, dict) else s for s in pattern]
    if any(not isinstance(s, dict) for s in specs):
        raise ValueError("a token spec is a dict")
    if any("REGEX" in s and not isinstance(s["REGEX"], str) for s in specs):
        raise ValueError("REGEX takes a string")
    if specs and all("REGEX" in s for s in specs):
        out.raw = "".join(f"(?:{s['REGEX']})" for s in specs)
        regex.compile(out.raw)
        return out
    for spec in specs:
        q = str(spec.get("OP", "1"))
        if q not in QUANTIFIERS:
            raise ValueError(f"unknown quantifier {q!r}")
        tests: list[Test] = []
        for attr, value in spec.items():
            if attr == "OP":
                continue
            if attr == "REGEX":  # beside others it is one token, whose whole text it fits
                tests.append(Test("TEXT", "regex", f"^{value}$"))
                continue
            if not isinstance(value, str | bool | int | dict):
                raise ValueError(f"values of type {type(value).__name__} aren't supported")
            if attr == "_":
                if not isinstance(value, dict):
                    raise ValueError("extension attributes are a dict")
                for name, v in value.items():
                    tests += _tests(name, v, True)
            elif attr not in STRINGS | BOOLEANS | {"LENGTH"}:
                raise ValueError(f"unknown attribute {attr!r}")
            else:
                tests += _tests(attr, value)
        sign = {"1": "", "!": ""}.get(q, q)
        if not tests:
            out.template += "(?!)" if q == "!" else "{any}" + ("+?" if q == "+" else sign)
            continue
        long = [t for t in tests if t.kind == "eq" and isinstance(t.value, str) and len(t.value.split()) > 1]
        if long and q != "!":
            # A literal of several tokens: one unit each; the other tests hold for all of them.
            others = tuple(t for t in tests if t is not long[0])
            ks = [out.unit(Unit((Test(long[0].attr, "eq", part, extension=long[0].extension), *others), compat=compat)) for part in long[0].value.split()]
            out.template += "(?:" + "".join(f"{{{k}}}" for k in ks) + ")" + sign
            if q in "1+":
                out.required.update(ks)
            continue
        k = out.unit(Unit(tuple(tests), negated=q == "!", compat=compat))
        out.template += f"{{{k}}}{sign}"
        if q in ("1", "+"):
            out.required.add(k)
    return out


@dataclass
class Rule:
    key: str
    patterns: list[list[dict]] = field(default_factory=list)
    compiled: list[Compiled] = field(default_factory=list)
    on_match: Callable[[DataFrame], DataFrame] | None = None


class RuleSet:
    """Named rules of one or more patterns, in the order in which they were added."""

    def __init__(self, validate: bool = False, compat: bool = False):
        self.validate, self.compat = validate, compat
        self.rules: dict[str, Rule] = {}

    def __len__(self) -> int:
        return len(self.rules)

    def __contains__(self, key: str) -> bool:
        return key in self.rules

    def __getitem__(self, key: str) -> tuple[Callable | None, list[list[dict]]]:
        rule = self.rules[key]
        return rule.on_match, rule.patterns

    def get(self, key: str, default: Any = None) -> tuple:
        return self[key] if key in self else (default, default)

    def add(self, key: str, patterns: list[list[dict]], on_match: Callable[[DataFrame], DataFrame] | None = None) -> RuleSet:
        """Appends patterns to a rule, and replaces its callback: a transform of the DataFrame of the rule's matches."""
        if on_match is not None and not callable(on_match):
            raise ValueError("on_match isn't callable")
        errors = {}
        for i, pattern in enumerate(patterns):
            if not isinstance(pattern, list):
                raise ValueError(f"a pattern of rule {key!r} isn't a list")
            if not pattern:
                raise ValueError(f"a pattern of rule {key!r} is empty")
            if self.validate and (found := check_pattern(pattern)):
                errors[i] = found
        if errors:
            raise PatternError(key, errors)
        compiled = []
        for i, pattern in enumerate(patterns):
            try:
                compiled.append(compile_pattern(pattern, self.compat))
            except ValueError as error:
                raise PatternError(key, {i: [str(error)]}) from error
        rule = self.rules.setdefault(key, Rule(key))
        rule.patterns += patterns
        rule.compiled += compiled
        rule.on_match = on_match
        return self

    def remove(self, key: str) -> None:
        if key not in self.rules:
            raise ValueError(f"no rule {key!r}")
        del self.rules[key]

    def columns(self) -> dict[str, str]:
        """Annotations and extension attributes that the rules read, and the columns they are in."""
        out = {}
        for rule in self.rules.values():
            for c in rule.compiled:
                for t in (t for u in c.units for t in u.tests):
                    if t.extension:
                        out[f"_.{t.attr}"] = t.attr
                    elif t.attr in ANNOTATED:
                        out[t.attr] = ANNOTATED[t.attr]
        return out


def rules_of(patterns: Iterable[str] | Iterable[dict], key: str = "rule") -> RuleSet:
    """Rules from JSON lines: each a pattern, or an object that has it under "pattern" (and maybe its rule under "key")."""
    out = RuleSet()
    for line in patterns:
        made = json.loads(line) if isinstance(line, str) else line
        if isinstance(made, dict):
            out.add(made.get("key", key), [made["pattern"]])
        else:
            out.add(key, [made])
    return out
