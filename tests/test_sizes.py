"""What keeps the work of a batch, a document or a task small, against the plain way of doing it."""

from __future__ import annotations

import random
import time

import numpy as np
import pyarrow as pa
import regex
from conftest import SF
from pyspark.sql import functions as F

from lexgrove import catalog
from lexgrove.functions import text as tx
from lexgrove.operators import abbrs, graph, matcher, phrases, sents, spans
from lexgrove.operators.matcher import match, match_native
from lexgrove.operators.rules import RuleSet

WORDS = "the of U.S. Mr. No. 3.5 1,000 é naïve 𝒳y . , ( ) — a\x0bb x　y".split(" ")


def _texts(n: int, seed: int = 1) -> list[str | None]:
    rng = random.Random(seed)
    return [None, "", " \n", *(" ".join(rng.choice(WORDS) + rng.choice(["", " ", "."]) for _ in range(rng.randint(1, 40))) for _ in range(n))]


def _tokens(text: str | None) -> list[str] | None:
    return None if text is None else regex.findall(tx.TOKEN.replace(r"\s", r" \t\n\x0b\f\r"), text)


def test_places_of_tokens(spark):
    texts = _texts(60)
    words = [_tokens(t) for t in texts]
    some = [w and w[:-1] for w in words]  # tokens that leave something out are searched
    for tokens in (words, some):
        for skip in (0, 4):
            place, first, begin = tx.places_of(pa.array(texts, pa.string())[skip:], pa.array(tokens, pa.list_(pa.string()))[skip:])
            for k, (t, ws) in enumerate(zip(texts[skip:], tokens[skip:], strict=True)):
                assert (place[first[k] : first[k + 1]] - begin[k]).tolist() == (tx.offsets_of(t, ws) if t else [])
    rows = [(k, t, None if t is None else len(t) // 2) for k, t in enumerate(texts)]
    docs = tx.tokenize(spark.createDataFrame(rows, "k int, text string, at int"))
    for r in docs.select("*", tx.starts_until("text", "words", "at").alias("until"), tx.starts_before("text", "words", "at").alias("before")).collect():
        assert (r.words is None) == (r.text is None) and (r.text is None or r.words == _tokens(r.text))
        starts = tx.offsets_of(r.text, r.words) if r.text is not None else None
        assert r.until == (None if starts is None else sum(s <= r["at"] for s in starts))
        assert r.before == (None if starts is None else sum(s < r["at"] for s in starts))


def test_pieces_of_a_batch():
    words = pa.array([["a"] * n if n is not None else None for n in (3, 0, None, 9, 2, 2, 1)], pa.list_(pa.string()))
    assert list(tx.pieces(words, 4)) == [(0, 3), (3, 1), (4, 2), (6, 1)]
    assert list(tx.pieces(words.slice(3), 100)) == [(0, 4)] and list(tx.pieces(words.slice(7))) == []


def test_packed_spans_against_the_operators_on_rows(spark, monkeypatch):
    monkeypatch.setattr(spans, "PIECE", 20)
    rng = random.Random(5)
    rows = []
    for k in range(40):
        some = [(s := rng.randint(0, 12), s + rng.randint(1, 6), rng.randint(0, 2)) for _ in range(rng.randint(1, 14))]
        rows.append((None if k > 37 else k % 25, *(list(x) for x in zip(*some, strict=True))))
    packed = spark.createDataFrame(rows, "doc_id long, start array<int>, end array<int>, rule array<int>")
    names = ["B", "A", "C"]
    flat = packed.where("doc_id is not null").select("doc_id", F.explode(F.arrays_zip("start", "end", "rule")).alias("x")).select("doc_id", "x.*").withColumn("label", F.array(*map(F.lit, names))[F.col("rule")])
    got = lambda df: sorted(tuple(r) for r in df.where("doc_id is not null").collect())
    bounds = flat.select("doc_id", "start", "end")
    assert got(spans.outermost(packed)) == got(spans.drop_contained(bounds, ["doc_id"])) == got(spans.running_end(bounds.distinct(), ["doc_id"]))
    assert got(spans.only_longest_packed(packed, names)) == got(spans.only_longest(flat))
    assert got(spans.token_labels_packed(packed, names)) == got(spans.token_labels(flat))
    hits, since = flat.where("rule = 0").select("doc_id", F.col("start").alias("at")), flat.where("rule = 1").select("doc_id", F.col("start").alias("since"))
    assert got(spans.as_of_packed(packed)) == got(spans.as_of(hits, since, ["doc_id"], "at", "since", F.col("since")).select("doc_id", "at", "_value"))
    assert spans.outermost(packed).where("doc_id is null").count() == len({(s, e) for s, e in spans_of(rows[38:]) if not any((a <= s and e < b) or (a < s and e <= b) for a, b in spans_of(rows[38:]))})


def spans_of(rows):
    return [(s, e) for _, start, end, _ in rows for s, e in zip(start, end, strict=True)]


def test_native_match_of_a_long_document(spark):
    words = ["the", "é", "of", "b", "c", ".", "of", "."] * 4000
    docs = spark.createDataFrame([(1, words), (2, []), (3, None)], "doc_id int, words array<string>")
    pattern = [{"LOWER": {"IN": ["the", "of"]}}, {"IS_ALPHA": True, "OP": "+"}, {"TEXT": "."}]
    began = time.monotonic()
    got = sorted(tuple(r) for r in match_native(docs, pattern).collect())
    assert got == sorted(tuple(r) for r in match(docs, RuleSet().add("r", [pattern])).select("doc_id", "start", "end").collect()) and len(got) == 4000
    # Before, each of the 32,000 places read the document to its end.
    assert time.monotonic() - began < 60 and "substring" not in match_native(docs, pattern)._jdf.queryExecution().optimizedPlan().toString()


def test_callbacks_have_passes_of_their_own(spark):
    docs = tx.tokenize(spark.createDataFrame([(1, "the end of it"), (2, None)], "doc_id int, text string"))
    both = match(docs, RuleSet().add("the", [[{"LOWER": "the"}]], lambda m: m.withColumn("n", F.lit(1))).add("of", [[{"LOWER": "of"}]]))
    assert sorted((r.rule, r.start, r.n) for r in both.collect()) == [("of", 2, None), ("the", 0, 1)]
    alone = match(docs, RuleSet().add("the", [[{"LOWER": "the"}]], lambda m: m.groupBy("doc_id").count()))
    plan = alone._jdf.queryExecution().optimizedPlan().toString()
    assert alone.collect() == [(1, 1)] and plan.count("MapInArrow") == 1 and plan.count("regexp_extract_all") == 1


def test_sentences_and_tags_of_pieces(spark, monkeypatch):
    texts = _texts(30, 2)
    docs = tx.tokenize(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).coalesce(1)
    whole = [(r.doc_id, r.pos, r.sent_starts) for r in sents.with_sentences(phrases.tag_by_lexicon(docs)).orderBy("doc_id").collect()]
    words = pa.array([r.words for r in docs.orderBy("doc_id").collect()], pa.list_(pa.string()))
    pos = pa.array([p for _, p, _ in whole], pa.list_(pa.string()))
    parts = [sents._of_piece(words.slice(k, n), pos.slice(k, n)) for k, n in tx.pieces(words, 7)]
    assert len(parts) > 5 and pa.concat_arrays(parts).to_pylist() == [s for _, _, s in whole]
    assert pa.concat_arrays([phrases._of_piece(words.slice(k, n)) for k, n in tx.pieces(words, 7)]).to_pylist() == pos.to_pylist()


def test_pairs_of_a_piece_against_one_document_at_a_time():
    rng = random.Random(8)
    some = "too cool ( TC ) TC [ ] CT cool too , . of The ab AB".split()
    rows = [None, [], *([rng.choice(some) for _ in range(rng.randint(1, 60))] for _ in range(300))]
    starts = [None if r is None or k % 3 == 0 else sorted(rng.sample(range(len(r)), min(len(r), 3))) for k, r in enumerate(rows)]
    spaces = [[rng.random() < 0.7 for _ in r] if r and k % 4 == 0 else None for k, r in enumerate(rows)]
    got = abbrs._pairs_of_piece(pa.array(rows, pa.list_(pa.string())), pa.array(spaces, pa.list_(pa.bool_())), pa.array(starts, pa.list_(pa.int32())))
    assert got == [None if r is None else abbrs.find_pairs(r, s, b) for r, s, b in zip(rows, spaces, starts, strict=True)] and sum(len(g or ()) for g in got) > 300
    assert [abbrs._pairs_of_piece(pa.array(rows, pa.list_(pa.string()))[k : k + 1], pa.nulls(1, pa.list_(pa.bool_())), pa.nulls(1, pa.list_(pa.int32())))[0] for k in range(40)] == [None if r is None else abbrs.find_pairs(r) for r in rows[:40]]


def test_reach_of_starts_that_are_alike(spark, monkeypatch):
    monkeypatch.setattr(graph, "_PART", 3)
    rng = random.Random(3)
    ids = list(range(40))
    pages = spark.createDataFrame([(f"p{i}", i) for i in ids], "title string, id long")
    none = spark.createDataFrame([], "title string, id long")
    edges = spark.createDataFrame(sorted({(i, rng.choice([100, 101, 102])) for i in ids} | {(i, i % 3 + 103) for i in ids[:20]} | {(100, 103)}), "src long, dst long")
    made = graph.PageGraph(pages, none.withColumnRenamed("id", "target_id"), none, none, edges)
    asked = pages.select("title").unionByName(spark.createDataFrame([("no",), ("p3",)], "title string"))
    both = graph.both_ways(edges)
    want = sorted((f"p{r.start}", r.id) for r in graph.reachable(both, pages.select(F.col("id").alias("start")), 2).collect())
    got = graph.neighbours_of(made, asked, 2)
    assert sorted((r.title, r.id) for r in got.collect()) == want
    assert all(r.reached == (f"p{r.id}" if r.id < 100 else None) for r in got.collect())


def test_texts_are_cut_once(spark):
    most = {"label_abbr_merge": 5}
    for name in ("idx2i_lookup", "char_span_tokens", "abbr_pairs", "abbr_candidates", "sent_boundaries", "sent_counts", "np_phrases", "match_plus", "title_scan", "label_tokens", "nb_features", "label_abbr_merge", "match_callback"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert 1 <= plan.count("regexp_extract_all(text") <= most.get(name, 1), name


def test_places_where_a_match_may_begin():
    rng = random.Random(4)
    for template in ("{0}+{1}*{2}", "{0}*{1}?{2}", "{0}{1}+?{2}", "{1}{0}*{2}"):
        present = np.array([1, 2, 3, 4, 8])
        classes = [[k for k, m in enumerate(present.tolist()) if m >> b & 1] for b in range(3)]
        xp = regex.compile(template.format(*("[" + "".join(chr(matcher._FIRST + k) for k in c) + "]" for c in classes)))
        text = np.array([*(rng.choice([matcher._END] + [matcher._FIRST + k for k in range(5)]) for _ in range(500)), matcher._END], "<u4")
        said = text.tobytes().decode("utf-32-le")
        begins = matcher._may_begin(template, present, text)
        assert [m.span() for m in xp.finditer(said, overlapped=True)] == [m.span() for m in (xp.match(said, p) for p in begins.tolist()) if m]
        assert len(begins) < len(text) / 2
    assert matcher._may_begin("{0}{1}+", np.array([1, 2, 3]), text) is None
