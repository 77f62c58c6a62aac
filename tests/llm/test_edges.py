"""Every operator and every stage on nulls in any column, empty and very long texts, ties and repeated rows, empty tables, and columns with clashing names; and the pipeline as a whole."""

from __future__ import annotations

import math
import random

import corpus_pipeline
import duckdb
import numpy as np
import pyarrow as pa
import pytest
from conftest import ROOT, SF
from pyspark.sql import functions as F
from test_operators import prose, repeated_words, words

from lexgrove.llm import chat_format, decontam, entries, jaccard_tree, langid_gru, media_audio, packing, pfp_dedup, quality_fm, toxicity, zm_parse

CLASH = ["_label_id", "_target", "_lost", "_again", "_spans", "_id", "_key", "id", "rep", "key", "shard", "kind", "band", "bands", "set_hash", "text_key", "trigger", "part", "h", "n", "score", "label", "quality", "item_id", "payload", "t"]


def docs_of(spark, rows=True):
    rng = random.Random(1)
    same = prose(rng, 70)
    long = prose(rng, 60_000)
    made = [(1, same, "en", "a", 1), (1, same, "en", "a", 1), (2, same + " more", "en", None, None), (None, same, None, None, None), (None, None, None, None, None), (3, None, "en", "a", 0), (4, "", "en", "a", 0), (5, " \n", "fr", "b", 2), (6, "é中\U0001f600 !!", "fr", "b", 5), (7, long, "de", "b", len(long)), (8, "one", "en", "a", 3), (9, same + " other", "en", "a", 0), (9, "different " + prose(rng, 60), "en", "a", 0)]
    df = spark.createDataFrame(made if rows else [], "doc_id long, text string, lang string, source string, n_chars long")
    for c in CLASH:
        df = df.withColumn(c, F.lit(c))
    return df


@pytest.fixture(scope="module")
def others(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, None), (None, 1, 1), (8, 0, 1), (9, 1, 0), (5, None, 0), (77, 1, 1)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("x")).withColumn("lang", F.lit("x"))
    bench = spark.createDataFrame([(1, "the cat sat on the mat and looked at the quiet dog in the yard"), (None, "x"), (2, None), (3, ""), (1, "the cat sat on the mat and looked at the quiet dog in the yard")], "item_id long, text string").withColumn("doc_id", F.lit(1)).withColumn("id", F.lit(2))
    return labels, bench


OPERATORS = {
    "decontamination": lambda d, labels, b: decontam.contaminated(d, b),
    "decontamination_stage": lambda d, labels, b: decontam.drop_contaminated(d, b),
    "jaccard": lambda d, labels, b: jaccard_tree.jaccard_join(d),
    "jaccard_stage": lambda d, labels, b: jaccard_tree.keep_one(d),
    "toxicity": lambda d, labels, b: toxicity.toxicity(d, labels),
    "media": lambda d, labels, b: media_audio.audio_features(d, "text"),
    "langid": lambda d, labels, b: langid_gru.identify(d),
    "lm": lambda d, labels, b: zm_parse.cross_parse(d),
    "packing": lambda d, labels, b: packing.pack(d),
    "packing_stage": lambda d, labels, b: packing.pack_with_text(d),
    "quality": lambda d, labels, b: quality_fm.quality(d, labels),
    "quality_stage": lambda d, labels, b: quality_fm.drop_rejected(d, labels),
    "suffix": lambda d, labels, b: pfp_dedup.repeated_spans(d),
    "suffix_stage": lambda d, labels, b: pfp_dedup.drop_repeats(d),
}
#: Operators that give a row for every row of documents.
EVERY_ROW = {"toxicity": 13, "langid": 13, "lm": 13, "quality": 13}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, others, name):
    docs = docs_of(spark)
    got = OPERATORS[name](docs, *others)
    rows = got.collect()
    if name in EVERY_ROW:
        assert len(rows) == EVERY_ROW[name]
    if name.endswith("_stage") and name != "packing_stage":
        assert got.columns == docs.columns and all(r.rep == "rep" for r in rows)
        ids = [r.doc_id for r in rows]
        assert 7 in ids
    if name == "quality_stage":
        # Texts without content go; which others stay is the classifier's matter.
        assert not {3, 4} & set(ids)
    if name == "decontamination":
        assert not rows  # nothing here has the item
    if name == "decontamination_stage":
        assert len(rows) == 13
    if name == "media":
        frames = {}
        for r in rows:
            frames[r.doc_id] = frames.get(r.doc_id, 0) + r.n_frames
        assert set(frames) == {None, 1, 2, 5, 6, 7, 8, 9} and frames[8] == 1 and frames[7] > 1000
    if name == "jaccard":
        assert {r.doc_id: (r.class_id, r.n_links) for r in rows} == {1: (1, 2), 2: (1, 2), 3: (3, 0), 4: (4, 0), 5: (5, 0), 6: (6, 0), 7: (7, 0), 8: (8, 0), 9: (1, 2)}
    if name == "jaccard_stage":
        # One of the group stays; null ids and texts without words pass.
        assert ids.count(1) == 1 and 2 not in ids and ids.count(None) == 2 and {3, 4, 5, 6, 7, 8} <= set(ids)
    if name == "suffix_stage":
        assert ids.count(1) == 2 and ids.count(None) == 2
        assert {r.text.strip() for r in rows if r.doc_id == 2} == {"more"}
    if name == "langid":
        assert all(r.lang is None and not r.segments for r in rows if r.doc_id in (3, 4))
    if name == "lm":
        assert all(r.cross_entropy is None for r in rows if r.n_symbols == 0)
    if name == "packing":
        assert {r.doc_id for r in rows} == {None, 1, 2, 5, 6, 7, 8, 9} and sum(r.n_tokens for r in rows if r.doc_id == 7) > 300_000


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, others, name):
    labels, bench = others
    assert OPERATORS[name](docs_of(spark, False), labels, bench).count() == 0
    rows = OPERATORS[name](docs_of(spark), labels.limit(0), bench.limit(0)).collect()
    if name in EVERY_ROW:
        assert len(rows) == EVERY_ROW[name]
    if name == "toxicity":
        assert not any(r.toxic for r in rows)
    if name == "quality_stage":
        assert {r.doc_id for r in rows} >= {1, 2, 7, 8, 9}
    if name == "decontamination":
        assert not rows


def test_item_in_odd_rows(spark, others):
    """The item is found in a very long text, in a row that comes twice, in one of an id's texts, and not where the id is null."""
    item = "the cat sat on the mat and looked at the quiet dog in the yard"
    rng = random.Random(8)
    rows = [(1, f"Say {item} again"), (1, f"Say {item} again"), (2, f"{prose(rng, 50_000)}. {item}. {prose(rng, 50_000)}"), (3, "nothing"), (3, item.upper()), (None, item), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(9)).withColumn("coverage", F.lit("x"))
    got = sorted(map(tuple, decontam.contaminated(docs, others[1]).collect()))
    assert got == [(1, 1, 1.0, True), (2, 1, 1.0, True), (3, 1, 1.0, True)]
    assert sorted(r.doc_id or 0 for r in decontam.drop_contaminated(docs, others[1]).collect()) == [0, 4, 5]


def test_chat_of_a_very_long_text(spark):
    long = prose(random.Random(2), 100_000)
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", long), (2, 0, "assistant", None), (None, 0, "user", "")], "conv_id long, turn long, role string, text string")
    rows = chat_format.chat_segments(df).collect()
    assert any(r.text is not None and long in r.text and r.loss for r in rows if r.conv_id == 1)
    assert chat_format.chat_segments(df.union(df)).count() >= 1


def test_chat_clashes(spark):
    df = spark.createDataFrame([(1, 0, "user", "a", 1, 2), (1, 1, "assistant", "b", 1, 2)], "conv_id long, turn long, role string, text string, t int, turns int").withColumn("segment", F.lit(1)).withColumn("error", F.lit("x")).withColumn("loss", F.lit("x"))
    assert chat_format.chat_segments(df).count() == 8 and chat_format.chat_segments(df.limit(0)).count() == 0


def test_chat_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{SF}/conversations.parquet')")
    names = ["conv_id", "segment", "turn", "role", "text", "loss", "error"]
    want = sorted(map(str, con.execute(f"select {', '.join(names)} from ({entries.ORACLE['op8_chat']})").fetchall()))
    assert sorted(str(tuple(r)) for r in entries.QUERIES["op8_chat"](spark, SF).select(*names).collect()) == want


def test_pipeline_against_brute_force(spark, tmp_path):
    """Each stage held against what it should make of all that the one before kept."""
    rng = random.Random(2)
    bench = "the cat sat on the mat and looked at the quiet dog in the yard before the sun went down behind the hill"
    passage = prose(rng, 60)
    texts = [f"{prose(rng, rng.randint(30, 80)).capitalize()}." for _ in range(60)]
    junk = ["".join(rng.choice("#@$%&*0123456789 ") for _ in range(200)) for _ in range(40)]
    texts += [texts[0], texts[1] + " plus", f"Before. {bench}. {prose(rng, 9)}", f"{prose(rng, 50)} {passage}", f"{passage} {prose(rng, 50)}", None, "", *junk]
    folder = tmp_path / "sf"
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    first_junk = len(texts) - len(junk)
    spark.createDataFrame([(k, 1, 0) for k in range(40)] + [(k, 0, 0) for k in range(first_junk, first_junk + 25)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(folder))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append({r.doc_id: r.text for r in docs.collect()})
    # The classifier is fitted: what it keeps is what all pairwise interactions of a document's features add up to.
    whole_docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_fm.fit(whole_docs, labels)
    assert model.constant is None

    def keeps(t):
        if not t:
            return False
        ((first, index, value, _),) = quality_fm.features(pa.array([t]), pa.array(["en"]), pa.array(["s"]))
        gram = (model.v[index] * value[:, None]).astype(float) @ (model.v[index] * value[:, None]).T.astype(float)
        raw = model.w0 + float(model.w[index] @ value) + float(gram[np.triu_indices(len(index), 1)].sum())
        return 1 / (1 + math.exp(-raw)) >= model.threshold - 1e-7

    with_text = {k: t for k, t in enumerate(texts) if keeps(t)}
    assert kept[0] == with_text and set(range(first_junk)) - {65, 66} <= set(with_text) and len(with_text) < first_junk + 5
    assert texts[65] is None and texts[66] == ""
    without_copies = {k: t for k, t in with_text.items() if k not in (60, 61)}
    assert kept[1] == without_copies
    ids = sorted(without_copies)
    _, later = repeated_words([without_copies[i] for i in ids])
    for n, i in enumerate(ids):
        assert words(kept[2][i]) == [w for k, w in enumerate(words(without_copies[i])) if k not in later.get(n, ())]
    assert set(kept[3]) == set(kept[2]) - {62}
    packed = {}
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id, r.start_byte)):
        packed[r.doc_id] = packed.get(r.doc_id, "") + r.text
    assert packed == kept[3]
    whole = corpus_pipeline.run(spark, str(folder))
    assert sorted(map(str, whole.collect())) == sorted(map(str, docs.collect()))


def test_the_rest_works_without_these_folders(tmp_path):
    import shutil
    import subprocess
    import sys

    shutil.copytree(f"{ROOT}/lexgrove", tmp_path / "lexgrove", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        shutil.copy(f"{ROOT}/{name}", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); print('match_plus' in q and not any(n.startswith('op') or n == 'pipeline' for n in q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin", "HOME": "/tmp"})
    assert done.stdout.strip() == "True", done.stderr
    (tmp_path / "corpus_pipeline.py").unlink()
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin", "HOME": "/tmp"})
    assert done.stdout.strip() == "True", done.stderr
