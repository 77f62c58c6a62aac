"""Abbreviations, labels, phrases, sentences, coordinates, clusters, and pipes in a chain."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexgrove.functions import text as tx
from lexgrove.operators import abbrs, bayes, clusters, labels, phrases, sents, spans
from lexgrove.plans.pipes import chain, pipe


@pytest.mark.parametrize(
    ("long", "shorts", "want"),
    [
        ("this is another short abbreviation", ["asa", "ASA", "as-9a", "AS-9A"], "another short abbreviation"),
        ("this is another short in abbreviation", ["asa", "ASA"], "another short in abbreviation"),
        ("this is not our short abbreviation", ["asa", "ASA"], None),
        ("this is a short abbreviation", ["afbrv", "AFBRV", "TSO"], None),
        ("abbreviation", ["abbrv", "ABBRV", "abb-9rv"], "abbreviation"),
        ("more words are considered aaaabbreviation", ["abbrn", "ABBRN"], "aaaabbreviation"),
        ("abbreviation", ["aebbrn", "AEBBRN"], None),
        ("yet another short abbreviation - ", ["asa"], "another short abbreviation"),
    ],
)
def test_alignment(long, shorts, want):
    for short in shorts:
        found = abbrs.align(long, short)
        assert (long[found[0] :].split(" - ")[0] if found else None) == want, short


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("this is my abbr (MA)", [("MA", "my abbr")]),
        ("this is other abbr OA", [("OA", "other abbr")]),
        ("this is TC (too cool)", [("TC", "too cool")]),
        ("This is My Abbr (MA). I like MA. This is My Another (MA)", [("MA", "My Abbr"), ("MA", "My Abbr"), ("MA", "My Another")]),
        ("too cool (TC) is cool, this is TC", [("TC", "too cool"), ("TC", "too cool")]),
        ("my abbr is cool, this is my abbr (MA)", [("MA", "my abbr")]),
        ("this is not an abbreviation. (AA)", []),
        ("", []),
    ],
)
def test_abbreviations_of_a_document(text, want):
    import regex

    words = regex.findall(tx.TOKEN, text)
    starts = tx.offsets_of(text, words)
    spaces = [text[s + len(w) : s + len(w) + 1] == " " for s, w in zip(starts, words, strict=True)]
    value = np.arange(len(words))
    opens = sents.sentence_starts(value, np.zeros(len(words), np.int64), np.array([0, len(words)]), words, [None]).tolist()
    got = [(" ".join(words[p.short_start : p.short_end]), " ".join(words[p.long_start : p.long_end])) for p in abbrs.find_pairs(words, spaces, opens)]
    assert sorted(got) == sorted(want)


def test_labels_merge_and_longest(spark):
    docs = spark.createDataFrame([(1, "a antilock braking system ( abs ) works".split()), (2, "a computer system engineer".split())], "doc_id long, words array<string>")
    rules = labels.label_rules([("ABS", [[{"LOWER": "abs"}]]), ("CS", [[{"LOWER": "computer system"}], [{"LOWER": "system engineer"}]])])
    found = abbrs.abbreviations(docs)
    assert [(r.short_text, r.long_text) for r in found.collect()] == [("abs", "antilock braking system")]
    got = sorted(map(tuple, labels.labelings(docs, rules, found).where("doc_id = 1").collect()))
    assert got == [(1, 1, 4, "ABS"), (1, 5, 6, "ABS")]
    assert sorted(map(tuple, labels.labelings(docs, rules, longest=True).where("doc_id = 2").collect())) == [(2, 1, 4, "CS")]


def test_span_algebra(spark):
    rows = [(1, 0, 3, "a"), (1, 1, 3, "a"), (1, 2, 5, "b"), (1, 2, 5, "b"), (1, 70, 200, "c"), (1, 100, 130, "d"), (2, 0, 1, "e")]
    s = spark.createDataFrame(rows, "doc_id long, start int, end int, label string")
    bounds = lambda df: sorted((r.doc_id, r.start, r.end) for r in df.collect())
    assert bounds(spans.drop_contained(s.select("doc_id", "start", "end"), ["doc_id"])) == [(1, 0, 3), (1, 2, 5), (1, 70, 200), (2, 0, 1)]
    assert bounds(spans.suppress_same_end(s.select("doc_id", "start", "end").distinct(), ["doc_id"])) == [(1, 0, 3), (1, 2, 5), (1, 70, 200), (1, 100, 130), (2, 0, 1)]
    assert sorted(map(tuple, spans.only_longest(s).collect())) == [(1, 0, 5, "b"), (1, 70, 200, "c"), (2, 0, 1, "e")]
    assert spans.only_longest(s.limit(0)).count() == 0
    assert {r.i: r.labels for r in spans.token_labels(s.where("doc_id = 1 and start < 5")).collect()} == {0: ["a"], 1: ["a"], 2: ["a", "b"], 3: ["b"], 4: ["b"]}
    pairs = spans.overlapping_pairs(s.distinct(), s.distinct())
    want = {(x, y) for x in set(rows) for y in set(rows) if x[0] == y[0] and x[1] < y[2] and y[1] < x[2]}
    assert pairs.count() == len(want)


def test_phrases_on_hand_made_tags(spark):
    rows = [
        ("a simple noun phrase and a second noun phrase .", "DET ADJ NOUN NOUN CCONJ DET ADJ NOUN NOUN PUNCT"),
        ("this is the long and unexpectedly complex noun phrase .", "PRON AUX DET ADJ CCONJ ADV ADJ NOUN NOUN PUNCT"),
        ("I am being stuck", "PRON AUX AUX VERB"),
        ("this was created obviously simple .", "PRON AUX VERB ADV ADJ PUNCT"),
    ]
    docs = spark.createDataFrame([(k, w.split(), p.split()) for k, (w, p) in enumerate(rows)], "doc_id long, words array<string>, pos array<string>")
    noun = sorted((r.doc_id, r.start, r.end) for r in phrases.noun_phrases(docs).collect())
    assert [s for s in noun if s[0] == 1] == [(1, 2, 9)] and not [s for s in noun if s[0] == 2]
    assert [s for s in noun if s[0] == 0] == [(0, 0, 4), (0, 5, 9)]
    assert [(r.start, r.end) for r in phrases.verb_phrases(docs).where("doc_id = 3").collect()] == [(1, 3)]


def test_sentences(spark):
    cases = ["One two . Three four .", "See Fig . 2 here .", "a . . b", "end ) . Next", "no ! mark ? here", "one"]
    docs = spark.createDataFrame([(k, c.split()) for k, c in enumerate(cases)] + [(90, []), (91, None)], "doc_id long, words array<string>")
    got = {r.doc_id: r.sent_starts for r in sents.with_sentences(docs).collect()}
    assert got == {0: [0, 3], 1: [0], 2: [0, 2], 3: [0, 3], 4: [0], 5: [0], 90: [], 91: None}
    assert sorted(map(tuple, sents.sentences(docs).where("doc_id = 0").collect())) == [(0, 0, 0, 3), (0, 1, 3, 6)]
    tagged = spark.createDataFrame([(0, "big dog This runs".split(), ["ADJ", "NOUN", "PRON", "VERB"])], "doc_id long, words array<string>, pos array<string>")
    assert sents.with_sentences(tagged).first().sent_starts == [0, 2]


def sentence_texts(spark, text):
    docs = phrases.tag_by_lexicon(tx.tokenize(spark.createDataFrame([(1, text)], "doc_id long, text string")))
    words = docs.first().words
    return [" ".join(words[r.start : r.end]) for r in sents.sentences(docs).orderBy("sent").collect()]


def test_sentences_of_plain_text(spark):
    """A list, a title that runs into its text, and abbreviations: six sentences, as many as in the text that the job gives."""
    text = (
        "Here is a list which has to stay in one piece:\n\ti) the one item;\n\tii) the other item;\n\tiii) an item with items of its own:\n\t\tx) one of these;\t\ty) one more."
        "\tiv) and the end.\nSome notice The notice stands too close to its text. Words like Figs. 3 or Fig. 4 are no ends. So are No.12 or eg. Num. 12 and U.S.; there may be more of them."
    )
    got = sentence_texts(spark, text)
    assert len(got) == 6 and got[2] == "Some notice" and got[3].startswith("The notice") and got[5].startswith("So are No. 12")
    assert len(sentence_texts(spark, "The president of the U.S. and Mr. Smith, i.e. John, visits at 3 p.m. today. It costs 3.5 million.")) == 2


def test_abbreviation_candidates(spark):
    docs = tx.tokenize(spark.createDataFrame([(1, "The NASA (not (ours) here) and [ab cd] A ()"), (2, None), (3, "")], "doc_id long, text string"))
    got = {r.doc_id: r.c for r in docs.select("doc_id", abbrs.candidates_column("words").alias("c")).collect()}
    words = docs.where("doc_id = 1").first().words
    assert [" ".join(words[x.start : x.end]) for x in got[1]] == ["NASA", "not ( ours", "ours", "ab cd"] and got[2] is None and got[3] == []


def test_abbreviations_of_one_span(spark):
    words = "too cool ( TC ) is cool , this is TC".split()
    docs = spark.createDataFrame([(1, words, 3, 4), (2, words, 0, 1), (3, None, 0, 1), (1, words, 3, 4)], "doc_id long, words array<string>, span_start int, span_end int")
    got = sorted(tuple(r) for r in abbrs.find_for_span(docs).collect())
    assert got == [(1, 3, 4, 0, 2), (1, 3, 4, 0, 2), (1, 10, 11, 0, 2), (1, 10, 11, 0, 2)]


def test_coordinates(spark):
    text = "this is a sample text useful for testing"
    docs = tx.tokenize(spark.createDataFrame([(0, text)], "doc_id long, text string")).select("text", tx.token_starts("text", "words").alias("s"))
    for at, token in ((0, 0), (3, 0), (5, 1), (8, 2), (10, 3), (16, 3), (17, 4), (39, 7)):
        assert docs.select(tx.char_to_token(F.col("s"), F.lit(at))).first()[0] == token
    for begin, end, want in ((0, 4, (0, 1)), (5, 9, (1, 3)), (10, 40, (3, 8)), (0, 40, (0, 8)), (12, 14, (3, 4))):
        assert tuple(docs.select(tx.char_span_to_tokens(F.col("s"), F.length("text"), F.lit(begin), F.lit(end)).alias("x")).first().x) == want


def _vectors():
    rng = np.random.default_rng(3)
    base = {"gray": [1, 0, 0, 0.1], "black": [0.98, 0.05, 0, 0.12], "dog": [0, 1, 0.1, 0], "cat": [0.02, 0.97, 0.12, 0]}
    return {k: [float(x) for x in np.array(v) + rng.normal(0, 0.001, 4)] for k, v in base.items()}


def test_clusters_and_neighbours(spark):
    rows = [("g", k, v) for k, v in _vectors().items()] + [("g", "none", [0.0] * 4), ("g", None, [1.0] * 4), ("one", "alone", [1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "g string, key string, vec array<double>")
    got = {r.g: [] for r in df.collect()}
    for r in clusters.cluster(df, "g", min_score=0.65).collect():
        got[r.g].append(r.members)
    assert sorted(got["g"]) == [["black", "gray"], ["cat", "dog"]] and got["one"] == [["alone"]]
    near = clusters.nearest(df.where("g = 'g'").select("key", "vec"), 2, block=2)
    asked = clusters.nearest(df.where("g = 'g'"), 2, df.where("key in ('dog', 'none')"))
    assert [(r.key, r.other, r.rank) for r in asked.orderBy("rank").collect()] == [("dog", "cat", 1), ("dog", near.where("key = 'dog' and rank = 2").first().other, 2)]
    best = {r.key: r.other for r in near.where("rank = 1").collect()}
    assert best == {"gray": "black", "black": "gray", "dog": "cat", "cat": "dog"}
    assert near.groupBy("key").count().where("count != 2").count() == 0
    assert clusters.nearest(df.limit(0).select("key", "vec")).count() == 0


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(8)
    v = rng.integers(-2, 3, (300, 3)).astype(float)  # many ties
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "key long, vec array<double>").repartition(5)
    useful = [k for k in range(300) if v[k].any()]
    unit = {k: v[k] / np.linalg.norm(v[k]) for k in useful}
    for k, block in ((1, 4096), (7, 50)):
        got = {}
        for r in clusters.nearest(df, k, df.where("key % 10 = 0"), block).orderBy("key", "rank").collect():
            got.setdefault(r.key, []).append((round(r.sim, 9), r.other))
        asked = [q for q in useful if q % 10 == 0]
        assert sorted(got) == asked
        for q in asked:
            sims = sorted(((round(float(unit[q] @ unit[o]), 9), o) for o in useful if o != q), key=lambda x: (-x[0], x[1]))
            assert [s for s, _ in got[q]] == [s for s, _ in sims[:k]]
    score = {r.key: r.min_score for r in clusters.default_score(df, df.where("key % 10 = 0"), 5).collect()}
    whole = {r.key: r.min_score for r in clusters.default_score(df, None, 5).collect()}
    assert sorted(score) == asked and all(abs(whole[k] - x) < 0.2 for k, x in score.items())


def test_balls_and_their_intruder():
    angle = lambda *d: np.array([[np.cos(np.radians(x)), np.sin(np.radians(x))] for x in d])
    # Seen from the root at 0 degrees: 5 is in its core; 60 seeds a ball of 58, 62 and 85; 85 lies farthest from every mean and goes.
    made = clusters.Group(["root", "core", "a", "b", "c", "odd"], angle(0, 5, 60, 58, 62, 85))
    names = [made.names(b) for b in made.balls(0, min_score=0.75)]
    assert names[0] == ["core", "root"] and names[1] == ["a", "b", "c"] and names[2:] == [["odd"]]
    assert made.intruder(np.array([2, 3, 4, 5])) == 5 and clusters.Group(["x"], angle(0)).balls(0) == [1]
    # A square has no odd corner.
    square = clusters.Group(list("abcd"), angle(0, 90, 180, 270))
    assert square.intruder(np.arange(4)) in (None, 0, 1, 2, 3)
    rng = np.random.default_rng(5)
    many = clusters.Group(list(range(40)), rng.normal(size=(40, 5)))
    merged = many.merged(list(range(40)))
    assert set().union(*(many.names(m) for m in merged)) == set(range(40)) and len(set(merged)) == len(merged)
    for root in range(40):
        balls = many.balls(root)
        assert balls[0] >> root & 1 and sum(b.bit_count() for b in balls) == len(set().union(*(many.names(b) for b in balls)))


def test_chunk_vectors_leave_zero_vectors_out(spark):
    vectors = spark.createDataFrame([("a", [1.0, 3.0]), ("b", [3.0, 5.0]), ("z", [0.0, 0.0])], "token string, vec array<double>")
    chunks = spark.createDataFrame([(1, ["a", "b", "z"]), (2, ["z"])], "id long, words array<string>")
    assert [tuple(r) for r in clusters.chunk_vectors(chunks, vectors, ["id"]).collect()] == [(1, [2.0, 4.0])]


def test_chunk_vectors_filters(spark):
    vectors = spark.createDataFrame([("the", [9.0]), ("cat", [1.0]), ("ran", [3.0])], "token string, vec array<double>")
    chunks = spark.createDataFrame([(1, ["the", "cat", "ran"], ["DET", "NOUN", "VERB"])], "id long, words array<string>, pos array<string>")
    of = lambda **k: clusters.chunk_vectors(chunks, vectors, ["id"], **k).first().vec
    assert round(of()[0], 6) == round(13 / 3, 6) and of(stop_words=False) == [2.0] and of(only_pos=["NOUN"]) == [1.0]


def test_model_is_kept(spark, tmp_path):
    model = bayes.train(spark.createDataFrame([(1, "x"), (0, "y"), (None, "x"), (1, None)], "label int, feat string"))
    bayes.save(model, str(tmp_path / "m"))
    assert sorted(map(str, bayes.load(spark, str(tmp_path / "m")).collect())) == sorted(map(str, model.collect()))
    spark.range(1).write.parquet(str(tmp_path / "other"))
    with pytest.raises(ValueError, match="no model"):
        bayes.load(spark, str(tmp_path / "other"))


def test_bayes_by_hand(spark):
    rows = [(1, "x"), (1, "x"), (0, "y"), (0, "x")]
    model = bayes.train(spark.createDataFrame(rows, "label int, feat string"))
    got = {r.feat: (round(r.p0, 6), round(r.p1, 6)) for r in model.collect()}
    assert got == {"x": (0.5, round(2.1 / 2.2, 6)), "y": (0.5, round(0.1 / 2.2, 6)), None: (0.5, 0.5)}
    items = spark.createDataFrame([(7, "x"), (8, "unseen")], "k int, feat string")
    p = {r.k: r.p1 for r in bayes.classify(items, model, "k").collect()}
    assert abs(p[7] - (2.1 / 2.2) / (2.1 / 2.2 + 0.5)) < 1e-9 and abs(p[8] - 0.5) < 1e-9


def test_pipes_in_a_chain(spark):
    docs = spark.createDataFrame([(1, "The antilock braking system (ABS) works. The ABS is good."), (2, ""), (3, None)], "doc_id long, text string")
    out = chain(docs, "tokens", "sentences", "abbreviations", ("labels", {"labelings": [("SYS", [[{"TEXT": "ABS"}]])]}), ("phrases", {"patterns": [[{"LOWER": "the"}, {}]]}))
    rows = {r.doc_id: r for r in out.collect()}
    assert len(rows) == 3 and len(rows[1].sent_starts) == 2
    # The long form has the label of its abbreviation.
    assert {(x.start, x.end) for x in rows[1].labelings} == {(1, 4), (5, 6), (10, 11)}
    assert len(rows[1].phrases) == 2 and rows[2].labelings == [] and rows[3].phrases == []
    with pytest.raises(ValueError, match="no pipe"):
        pipe("nothing")


def test_columns_with_clashing_names(spark):
    rows = [(1, 0, 3, "a"), (1, 1, 3, "b"), (1, 2, 5, "c"), (None, 0, 1, "d")]
    s = spark.createDataFrame(rows, "doc_id long, start int, end int, label string")
    for c in ("_start", "_end", "_most", "_inside", "_bin", "bin", "same", "most", "inside", "kind", "_value", "other_x"):
        s = s.withColumn(c, F.lit(c))
    for f in (lambda d: spans.suppress_same_end(d, ["doc_id"]), lambda d: spans.running_end(d, ["doc_id"]), lambda d: spans.drop_contained(d, ["doc_id"])):
        got = f(s)
        assert got.columns == s.columns and got.first()["_start"] == "_start" and got.first()["most"] == "most"
        assert f(s.limit(0)).count() == 0
    both = spans.overlapping_pairs(s, s)
    assert both.first()["_bin"] == "_bin" and both.first()["other_bin"] == "bin" and both.count() == 9
    hits = s.select("doc_id", F.col("start").alias("at"), "kind", "_value")
    found = spans.as_of(hits, s.select("doc_id", "start"), ["doc_id"], "at", "start", F.col("start")).where("doc_id = 1").collect()
    assert len(found) == 3 and all(r.kind == "kind" and r["_value"] == "_value" for r in found)


def test_odd_documents(spark):
    """Nulls, empty and very long texts, repeated ids and no rows at all, through the pipes."""
    long = "The Long Word (LW) stays. " * 20_000
    rows = [(1, "An Old Idea (OI). OI is old."), (1, "Another text, of the same id."), (2, None), (3, ""), (4, " \n"), (None, "No id (NI)."), (5, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rule", F.lit("x")).withColumn("start", F.lit(1))
    tagged = phrases.tag_by_lexicon(tx.tokenize(docs))
    assert sents.with_sentences(tagged).count() == 7 and {r.doc_id for r in sents.sentences(tagged).collect()} == {1, 5, None}
    assert sents.sentences(tagged).where("doc_id = 5").count() == 20_000
    pairs = abbrs.abbreviations(tagged).collect()
    assert {(r.doc_id, r.short_text) for r in pairs} >= {(1, "OI"), (5, "LW"), (None, "NI")}
    found = labels.labelled(tagged, labels.label_rules([("IDEA", [[{"LOWER": {"IN": ["idea", "text"]}}]])]))
    assert sorted((r.doc_id, r.text) for r in found.collect()) == [(1, "Idea"), (1, "text")]
    assert phrases.noun_phrases(tagged).where("doc_id = 1").count() > 0
    none = phrases.tag_by_lexicon(tx.tokenize(docs.limit(0)))
    for f in (sents.sentences, abbrs.abbreviations, phrases.noun_phrases, lambda d: labels.labelled(d, labels.label_rules([("X", [[{"TEXT": "x"}]])]))):
        assert f(none).count() == 0


def test_other_pipes(spark):
    from lexgrove.operators import titles

    docs = tx.tokenize(spark.createDataFrame([(1, "Grab this juicy orange and watch a dog chase a cat"), (2, None)], "doc_id long, text string"))
    index = titles.title_index(spark.createDataFrame([("Juicy_Orange", 1), ("Orange", 2), ("Dog", 3)], "title string, ord long"))
    rows = {r.doc_id: r for r in docs.transform(pipe("title_spans", index=index)).collect()}
    assert [(x.start, x.end, x.titles) for x in rows[1].title_spans] == [(2, 4, ["Juicy_Orange"]), (3, 4, ["Orange"]), (7, 8, ["Dog"])] and rows[2].title_spans == []
    vectors = spark.createDataFrame([("orange", [1.0, 0.1, 0.0]), ("dog", [0.0, 1.0, 0.1]), ("cat", [0.05, 1.0, 0.1])], "token string, vec array<double>")
    chunked = docs.withColumn("chunks", F.when(F.col("doc_id") == 1, F.expr("array(named_struct('start', 3, 'end', 4), named_struct('start', 7, 'end', 8), named_struct('start', 10, 'end', 11))")))
    got = {r.doc_id: r.cluster_chunks for r in chunked.transform(pipe("clusters", vectors=vectors, min_score=0.65)).collect()}
    assert sorted(x.members for x in got[1]) == [["cat", "dog"], ["orange"]] and got[2] == []
    tagged = phrases.tag_by_lexicon(docs)
    for name in ("noun_phrases", "verb_phrases"):
        assert {r.doc_id for r in tagged.transform(pipe(name)).collect()} == {1, 2}
