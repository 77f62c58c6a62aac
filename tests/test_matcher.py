"""Pattern cases over hand-made tokens, and the batch matcher against the native one and a brute-force one."""

from __future__ import annotations

import json

import pytest
import regex
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexgrove.functions import text as tx
from lexgrove.operators.matcher import match, match_native
from lexgrove.operators.rules import PatternError, RuleSet, check_pattern, rules_of

T = lambda w, **k: {"TEXT": w, **k}
#: pattern, words, spans (or their number)
CASES = [
    ([{"ORTH": "OpenRiver"}], "OpenRiver runs fast", [(0, 1)]),
    ([{"ORTH": "Green"}, {"ORTH": "Hill"}], "we saw Green Hill again", [(2, 4)]),
    ([{"LOWER": "mill"}], "the old Mill", [(2, 3)]),
    ([{"ORTH": "p"}, {}, {"ORTH": "r"}], "p q r", [(0, 3)]),
    ([{"ORTH": "all"}, {"OP": "*"}], "all that follows", [(0, 3)]),
    ([T("p"), {"IS_ALPHA": True, "OP": "+"}, T("r")], "p q r", [(0, 3)]),
    ([T("|"), {"IS_PUNCT": True, "OP": "!"}, {"IS_PUNCT": True, "OP": "!"}, T("|")], "left | two cells | right", 1),
    ([T("'"), {"IS_PUNCT": True, "OP": "!"}, {"IS_PUNCT": True, "OP": "!"}, T("'")], "she wrote ' one two three ' here", 0),
    ([T("'"), {"IS_PUNCT": False, "OP": "*"}, T("'")], "she wrote ' one two three ' here", 1),
    ([T("ho", OP="1"), T("ho", OP="+")], "ho ho", 1),
    ([{"ORTH": {"IN": ["to", "of"]}}], "of to town", 2),
    ([{"ORTH": {"IN": ["to", "of"]}}], "tower", 0),
    ([{"LOWER": {"IN": ["my", "our"]}, "OP": "?"}, {"LOWER": "boat"}], "On our boat", 1),
    ([{"LOWER": {"IN": ["my", "our"]}, "OP": "?"}, {"LOWER": "boat"}], "his boat", 1),
    ([{"ORTH": {"REGEX": r"(?:to|ot)"}}], "tot ot x", 2),
    ([{"ORTH": {"REGEX": r"(?:to|ot)"}}], "nil", 0),
    ([{"SHAPE": {"REGEX": r"^[^x]+$"}}], "7 dwarfs ?", 2),
    ([{"SHAPE": {"REGEX": r"^[^x]+$"}}], "nil", 0),
    *[([{"LENGTH": {op: 3}}], "oo ooo oooo", n) for op, n in zip(("==", "!=", ">=", "<=", ">", "<"), (1, 2, 2, 2, 1, 1), strict=True)],
    *[([T("p"), T("q", OP="*")], w, 1) for w in ("p", "p q", "p r", "p q r", "p q q r", "p q q")],
    *[([T("q", OP="*"), T("r")], w, 1) for w in ("r", "q r", "p r", "p q r", "p q q r", "q q r")],
    *[([{"TEXT": {"NOT_IN": ["m", "n"]}, "OP": "*"}, T("r")], w, 1) for w in ("r", "q r", "n r", "n q r", "m n q r", "p m n r")],
    *[([T("p", OP="*"), T("q", OP="*"), T("r")], w, 1) for w in ("r", "q r", "n r", "p q r", "p n q r", "p q n r")],
    ([T("p", OP="+"), T("q", OP="*")], "q", 0),
    *[([T("p", OP="+"), T("q", OP="*")], w, 1) for w in ("p", "p q", "p q q", "n p q", "p n q", "p q n q")],
    ([{"LENGTH": {"==": 1}, "OP": "*"}, {"LOWER": "mid"}, {"LENGTH": {"==": 1}, "OP": "*"}], "oo o mid p pp", [(1, 4)]),
    ([T("(3) [4]")], "(3) [4]", 1),
    ([T("p", OP="+")], "p p p q", [(0, 3)]),
    ([T("p"), {"OP": "+"}, T("r")], "p q r r", [(0, 3)]),
    ([{"LENGTH": 3}], "o ooo 3", [(1, 2)]),
    ([{"lower": {"in": ["oo"]}}], "o Oo 2", [(1, 2)]),
    ([{"LOWER": "page"}, {"REGEX": r"\d+|[ivx]+"}, {"IS_PUNCT": True}], "Page xi . page x1 . page 12 !", [(0, 3), (6, 9)]),
    ([{"REGEX": r"[a-c]+", "OP": "+"}, T("end")], "ab bca end d end", [(0, 3), (1, 3)][:1]),
]
FLAGS = {
    "IS_ALPHA": "word", "IS_ASCII": "k!", "IS_DIGIT": "90", "IS_LOWER": "low", "IS_UPPER": "UP", "IS_TITLE": "Title", "IS_PUNCT": ";", "IS_SPACE": "\t", "IS_BRACKET": "}", "IS_QUOTE": "\u00bb",
    "IS_LEFT_PUNCT": "[", "IS_RIGHT_PUNCT": "]", "IS_STOP": "which", "LIKE_NUM": "seven", "LIKE_URL": "www.example.org", "LIKE_EMAIL": "me@mail.example.org", "IS_CURRENCY": "\u20ac",
}


def docs_of(spark, rows, **more):
    names = ["doc_id", "words", *more]
    return spark.createDataFrame([(k, w, *(m[k] for m in more.values())) for k, w in enumerate(rows)], ", ".join(["doc_id long", "words array<string>", *(f"{n} array<string>" for n in more)])).select(*names)


def test_cases(spark):
    rules = RuleSet()
    for k, (pattern, _, _) in enumerate(CASES):
        rules.add(str(k), [pattern])
    docs = docs_of(spark, [w.split(" ") for _, w, _ in CASES])
    got = {}
    for r in match(docs, rules).where("cast(doc_id as string) = rule").collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end))
    for k, (pattern, words, want) in enumerate(CASES):
        found = sorted(got.get(k, []))
        assert (len(found) if isinstance(want, int) else found) == want, (pattern, words, found)


def test_flags(spark):
    rules = RuleSet()
    for flag in FLAGS:
        rules.add(flag, [[{flag: True}]])
    docs = docs_of(spark, [[w] for w in FLAGS.values()])
    got = {(r.rule, r.doc_id) for r in match(docs, rules).collect()}
    assert {(flag, k) for k, flag in enumerate(FLAGS)} <= got
    words = sorted(set(FLAGS.values()))
    columns = spark.createDataFrame([(w,) for w in words], "w string").select("w", *(tx.flag(f, F.col("w")).alias(f) for f in FLAGS)).collect()
    for row in columns:
        for f in FLAGS:
            assert row[f] == tx.value_flag(f)(row.w), (f, row.w)


def test_extension_annotation_and_missing(spark):
    docs = docs_of(spark, [["an", "apple"], ["an", "aardvark"]], pos=[["DET", "NOUN"], ["DET", "NOUN"]], is_fruit=[["no", "yes"], ["no", "no"]])
    got = match(docs, RuleSet().add("r", [[T("an"), {"_": {"is_fruit": "yes"}}]])).collect()
    assert [(r.doc_id, r.start, r.end) for r in got] == [(0, 0, 2)]
    assert match(docs, RuleSet().add("r", [[{"POS": "NOUN"}]])).count() == 2
    with pytest.raises(ValueError, match="no column"):
        match(docs, RuleSet().add("r", [[{"TAG": "NN"}]]))
    assert match(docs, RuleSet().add("r", [[{"TAG": "NN"}]]), allow_missing=True).count() == 0


def test_raw_regex(spark):
    text = "000\t000;\n000. 0000, 000"
    docs = tx.tokenize(spark.createDataFrame([(0, text), (1, None)], "doc_id long, text string"))
    assert match(docs, RuleSet().add("r", [[{"REGEX": r"\b000\b"}]])).count() == 4


def test_dedup_callback_nulls_and_other_columns(spark):
    docs = spark.createDataFrame([(1, ["a", "b"], "x"), (2, None, "y"), (3, [], None), (None, ["a"], "z"), (1, ["a", "b"], "x")], "doc_id long, words array<string>, rule string")
    rules = RuleSet().add("r", [[T("a")], [{"LOWER": "a"}]])
    assert sorted((r.doc_id or -1, r.pattern_ord) for r in match(docs, rules).collect()) == [(-1, 0), (1, 0), (1, 0)]
    called = RuleSet().add("r", [[T("a")]], lambda m: m.where("doc_id = 1").limit(1))
    assert match(docs, called).count() == 1
    assert match(docs.limit(0), rules).count() == 0


def test_rule_set():
    rules = RuleSet().add("a", [[T("x")]]).add("a", [[T("y")]]).add("b", [[{}]])
    assert len(rules) == 2 and "a" in rules and "c" not in rules and rules["a"][1] == [[T("x")], [T("y")]] and rules.get("c") == (None, None)
    with pytest.raises(KeyError):
        rules["c"]
    rules.remove("a")
    assert "a" not in rules
    for bad, error in ((lambda: rules.remove("a"), ValueError), (lambda: rules.add("x", [[]]), ValueError), (lambda: rules.add("x", [{}]), ValueError), (lambda: rules.add("x", [[{}]], 3), ValueError), (lambda: rules.add("x", [[{"OP": "^"}]]), PatternError), (lambda: rules.add("x", [[{"FOO": "a"}]]), PatternError), (lambda: rules.add("x", [[{"TEXT": {"FOO": "a"}}]]), PatternError)):
        with pytest.raises(error):
            bad()
    spec = {"lower": {"in": ["A"]}}
    RuleSet().add("x", [[spec]])
    assert spec == {"lower": {"in": ["A"]}}  # the caller's pattern stays
    assert len(rules_of([json.dumps([T("a")]), json.dumps({"pattern": [T("b")], "key": "k"})])) == 2


@pytest.mark.parametrize(
    ("pattern", "ok"),
    [
        ([{"XX": "foo"}], False), ([{"IS_ALPHA": {"==": True}}, {"LIKE_NUM": None}], False), ([{"IS_PUNCT": True, "OP": "$"}], False), ([{"_": "foo"}], False), ('[{"TEXT": "foo"}]', False), ([1, 2, 3], False),
        ([{"TEXT": "foo"}, {"LOWER": {"IN": ["x", "y"]}}], True), ([{"LENGTH": {">": 2}}], True), ([{"LENGTH": "2"}], False), ([{"LOWER": 5}], False), ([{"TEXT": {"IN": "abc"}}], False), ([{"TEXT": {"VALUE": "foo"}}], False),
        ([{"_": {"foo": "bar", "baz": {"IN": [1, 2]}}}], True), ([{"IS_PUNCT": True, "OP": "!"}], True), ([{"lower": "foo", "op": "+"}], True), ([{"LENGTH": {"VALUE": 5}}], False), ([{"TEXT": []}], False), ([{"IS_DIGIT": 10}], False),
    ],
)
def test_validation(pattern, ok):
    assert (not check_pattern(pattern)) is ok
    if isinstance(pattern, list) and not ok:
        with pytest.raises(ValueError):
            RuleSet(validate=True).add("x", [pattern])


def brute(words: list[str], units: list[tuple[str, str]]) -> list[tuple[int, int]]:
    """Perl's leftmost-greedy match from each start by backtracking over tokens, then the suppression of same ends."""

    def run(i: int, k: int) -> int | None:
        if k == len(units):
            return i
        letter, q = units[k]
        most = {"": 1, "?": 1}.get(q, len(words))
        fit = 0
        while fit < most and i + fit < len(words) and (letter == "." or words[i + fit] == letter):
            fit += 1
        for n in range(fit, (0 if q in "?*" and q else 1) - 1, -1):
            end = run(i + n, k + 1)
            if end is not None:
                return end
        return None

    out, last = [], None
    for i in range(len(words)):
        end = run(i, 0)
        if end is not None and end > i:
            if end != last:
                out.append((i, end))
            last = end
    return out


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from(["", "?", "+", "*"])), min_size=1, max_size=4), st.lists(st.lists(st.sampled_from("abc"), max_size=9), min_size=1, max_size=6))
def test_against_brute_force(spark, units, texts):
    pattern = [{"TEXT": c, **({"OP": q} if q else {})} for c, q in units]
    docs = docs_of(spark, texts)
    got = sorted((r.doc_id, r.start, r.end) for r in match(docs, RuleSet().add("r", [pattern])).collect())
    assert got == [(k, *s) for k, t in enumerate(texts) for s in brute(t, units)]


def test_native_is_the_same(spark):
    docs = docs_of(spark, ["a b b c a . b".split(), ["c"], [], "a a a . .".split()])
    for pattern in ([T("a"), {"OP": "*"}, T(".")], [{"IS_ALPHA": True, "OP": "+"}, {"TEXT": {"IN": ["."]}, "OP": "?"}], [T("b", OP="!"), T("c", OP="?")]):
        native = sorted(map(tuple, match_native(docs, pattern).collect()))
        assert native == sorted((r.doc_id, r.start, r.end) for r in match(docs, RuleSet().add("r", [pattern])).collect())


def test_token_pattern_is_common():
    assert regex.findall(tx.TOKEN, "it's 3.5%, naïve… 1,000.5 (U.S.) Mr. Roe, e.g. at 3 p.m. in cars. No.7") == [
        "it", "'", "s", "3.5", "%", ",", "naïve", "…", "1,000.5", "(", "U.S.", ")", "Mr.", "Roe", ",", "e.g.", "at", "3", "p.m.", "in", "cars", ".", "No.", "7",
    ]


def test_annotations_case_and_fallback(spark):
    docs = docs_of(spark, [["Ran", "runs"], ["x", "y"]], lemma=[["RUN", "run"], ["walk", None]], norm=[[None, "gonna"], None], tag=[["VBD", "VBZ"], ["NN", "NN"]], dep=[["ROOT", "x"], ["a", "b"]], ent_type=[["", "ORG"], ["", ""]])
    rules = RuleSet().add("lemma", [[{"LEMMA": "run"}]]).add("LEMMA", [[{"LEMMA": "RUN"}]]).add("norm", [[{"NORM": {"IN": ["ran", "gonna", "y"]}}]])
    rules.add("tag", [[{"TAG": {"NOT_IN": ["NN"]}}]]).add("dep", [[{"DEP": "ROOT"}, {"ENT_TYPE": "ORG"}]])
    got = {}
    for r in match(docs, rules).collect():
        got.setdefault(r.rule, set()).add((r.doc_id, r.start))
    assert got == {"lemma": {(0, 0), (0, 1)}, "norm": {(0, 0), (0, 1), (1, 1)}, "tag": {(0, 0), (0, 1)}, "dep": {(0, 0)}}
    assert match(docs.drop("norm"), RuleSet().add("norm", [[{"NORM": "ran"}]])).count() == 1


def test_texts_of_repeated_ids(spark):
    docs = spark.createDataFrame([(1, ["the", "one"], "x"), (1, ["the", "other", "two"], "y"), (None, ["the", "third"], None)], "doc_id long, words array<string>, text string")
    got = match(docs, RuleSet().add("r", [[{"LOWER": "the"}, {"OP": "+"}]]), text=True)
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == [(0, "the third"), (1, "the one"), (1, "the other")] or sorted((r.doc_id or 0, r.text) for r in got.collect()) == [(0, "the third"), (1, "the one"), (1, "the other two")]


def test_many_rules_are_each_as_alone(spark):
    import random

    rng = random.Random(3)
    words = ["The", "the", "Cat", "cat", "dog", "7", ".", "ran"]
    docs = docs_of(spark, [[rng.choice(words) for _ in range(rng.randint(0, 25))] for _ in range(30)])
    specs = [{"LOWER": "the"}, {"TEXT": "Cat"}, {"LOWER": {"IN": ["cat", "dog"]}, "IS_TITLE": True}, {"IS_DIGIT": True}, {"TEXT": {"NOT_IN": ["."]}}, {"LENGTH": {">": 3}}, {"TEXT": {"REGEX": "[cd]"}}, {"IS_PUNCT": True, "OP": "!"}, {"OP": "*"}, {"LOWER": "cat", "OP": "?"}, {"LOWER": "ran", "OP": "+"}]
    patterns = [[s] for s in specs] + [[rng.choice(specs) for _ in range(rng.randint(2, 4))] for _ in range(60)]
    rules = RuleSet()
    for k, p in enumerate(patterns):
        rules.add(f"r{k}", [p])
    together = {}
    for r in match(docs, rules).collect():
        together.setdefault(r.rule, []).append((r.doc_id, r.start, r.end))

    def fits(spec, w):
        lower, title = w.lower(), regex.search(r"^\p{Lu}\P{Lu}*$", w) is not None
        has = {"LOWER": lambda v: lower in v["IN"] if isinstance(v, dict) else lower == v, "TEXT": lambda v: w not in v["NOT_IN"] if isinstance(v, dict) and "NOT_IN" in v else regex.search(v["REGEX"], w) is not None if isinstance(v, dict) else w == v,
               "IS_TITLE": lambda v: title is v, "IS_DIGIT": lambda v: w.isdigit() is v, "IS_PUNCT": lambda v: (w == ".") is v, "LENGTH": lambda v: len(w) > v[">"]}
        return all(has[a](v) for a, v in spec.items() if a != "OP") != (spec.get("OP") == "!")

    rows = {r.doc_id: r.words for r in docs.collect()}
    for k, p in enumerate(patterns):
        tests = [s for s in p if set(s) != {"OP"}]
        expression = "".join("." + s["OP"] if set(s) == {"OP"} else f"[{''.join(chr(65 + m) for m in range(1 << len(tests)) if m >> tests.index(s) & 1)}]" + {"!": ""}.get(s.get("OP", ""), s.get("OP", "")) for s in p)
        want = []
        for i, w in rows.items():
            text, last = "".join(chr(65 + sum(fits(s, t) << n for n, s in enumerate(tests))) for t in w), None
            for at in range(len(text)):
                m = regex.compile(expression).match(text, at)
                if m and m.end() > at:
                    if m.end() != last:
                        want.append((i, at, m.end()))
                    last = m.end()
        assert sorted(together.get(f"r{k}", [])) == sorted(want), p
