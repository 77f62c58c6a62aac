"""Dumps, the page graph and titles on small tables made by hand."""

from __future__ import annotations

import gzip

import pytest
from conftest import SF
from pyspark.sql import functions as F

from lexgrove import catalog, cli
from lexgrove.functions.text import tokenize
from lexgrove.operators import graph, titles
from lexgrove.sources import dumps, store

PAGE = [(1, "0", "Apple"), (2, "0", "Fruit"), (3, "14", "Fruit"), (4, "0", "Pomme"), (5, "0", "Apfel"), (6, "0", "Mercury"), (7, "14", "Food"), (8, "0", "Food"), (9, "0", "Secret"), (10, "14", "Lonely"), (11, "1", "Talk"), (12, "0", "O'Neil_(a),b"), (13, "0", "A"), (14, "0", "B"), (15, "0", "Élan"), (16, "0", "Into_cycle")]
PROPS = [(6, "disambiguation", ""), (6, "disambiguation", "later"), (9, "noindex", ""), (1, "other", "it's")]
REDIRECT = [(4, "0", "Apfel"), (5, "0", "Apple"), (9, "0", "Apple"), (2, "0", "Nowhere"), (13, "0", "B"), (14, "0", "A"), (16, "0", "A")]
LINKS = [(1, "Fruit", "page"), (1, "Fruit", "page"), (3, "Food", "subcat"), (9, "Fruit", "page"), (2, "Lonely", "page"), (1, "Fruit", "file"), (99, "Food", "subcat")]


def _line(table, rows):
    quote = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"INSERT INTO `{table}` VALUES " + ",".join("(" + ",".join(map(quote, r)) + ")" for r in rows) + ";"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("dumps")
    made = {
        "page": [_line("page", [(i, ns, t, "", 0) for i, ns, t in PAGE])[:].replace("'0',", "0,").replace("'14',", "14,").replace("'1',", "1,")],
        "page_props": [_line("page_props", PROPS)],
        "redirect": [_line("redirect", [(i, ns, t, "", "") for i, ns, t in REDIRECT]).replace("'0',", "0,")],
        "categorylinks": [_line("categorylinks", [(i, t, "K(),'x", "2020", "", "uca", kind) for i, t, kind in LINKS])],
        "pagelinks": [_line("pagelinks", [(1, 0, "Fruit", 0), (1, 0, "Talk", 1)])],
    }
    for name, lines in made.items():
        with gzip.open(out / f"xxwiki-20200101-{name}.sql.gz", "wt", encoding="utf-8") as f:
            f.write("-- a comment (1,'x')\n" + "\n".join(lines) + "\n")
    return str(out)


@pytest.fixture(scope="module")
def made(spark, folder):
    return dumps.build_graph(spark, folder, "xx")


def _rows(df, *names):
    return {tuple(r[n] for n in names) for r in df.collect()}


def test_versions(folder, tmp_path, spark):
    assert dumps.local_versions(folder, "xx") == ["20200101"] and dumps.resolve_version(["1", "2"]) == "2" and dumps.resolve_version(["1", "2"], "1") == "1"
    with pytest.raises(ValueError, match="1, 2"):
        dumps.resolve_version(["2", "1"], "3")
    (tmp_path / "e.sql.gz").touch()
    with pytest.raises(FileNotFoundError):
        dumps.read_dump(spark, str(tmp_path / "e.sql.gz"))


def test_parser(spark):
    line = r"INSERT INTO `t` VALUES (1,'a\'b,(c)',NULL,''),(2,'\\','x\"y',0.5);"
    rows = [r.fields for r in dumps.parse_lines(spark.createDataFrame([(line, 0), ("CREATE (1)", 1), (None, 2)], "line string, ord long")).collect()]
    assert rows == [["1", r"a\'b,(c)", "NULL", ""], ["2", r"\\", r"x\"y", "0.5"]]
    long = "INSERT INTO `t` VALUES " + ",".join(f"({k},'{'x' * 50}')" for k in range(20_000)) + ";"
    assert dumps.parse_lines(spark.createDataFrame([(long, 0)], "line string, ord long")).count() == 20_000


def test_tables(spark, folder):
    assert _rows(dumps.read_table(spark, folder, "xx", "page"), "ns", "id", "title") == {(ns, i, t) for i, ns, t in PAGE if ns != "1"}
    assert _rows(dumps.read_table(spark, folder, "xx", "pagelinks"), "source_id", "target_title") == {(1, "Fruit")}


def test_build(made):
    assert _rows(made.redirects, "title", "target_id") == {("Pomme", 1), ("Apfel", 1), ("A", 14), ("B", 13), ("Into_cycle", 13)}
    assert _rows(made.disambiguations, "title", "id") == {("Mercury", 6)}
    assert _rows(made.categories, "title", "id") == {("Category:Fruit", 3), ("Category:Food", 7), ("Category:Lonely", 10)}
    assert _rows(made.pages, "title", "id") == {("Apple", 1), ("Fruit", 2), ("Food", 8), ("O'Neil_(a),b", 12), ("Élan", 15)}
    assert _rows(made.edges, "src", "dst") == {(1, 3), (3, 7), (99, 7)}


def test_questions(spark, made):
    ask = lambda *t: spark.createDataFrame([(x,) for x in t], "title string")
    assert _rows(graph.id_of_page(made, ask("Apple", "Pomme", "Category:Food", "Mercury", "x")), "title", "id") == {("Apple", 1), ("Pomme", 1), ("Category:Food", 7), ("Mercury", 6), ("x", None)}
    assert _rows(graph.redirect(made, ask("Apple", "Pomme", "x")), "title", "target") == {("Apple", "Apple"), ("Pomme", "Apple"), ("x", "x")}
    assert _rows(graph.kinds(made, ask("Pomme", "Mercury", "Category:Food")), "title", "is_redirect", "is_disambiguation", "is_category") == {("Pomme", True, False, False), ("Mercury", False, True, False), ("Category:Food", False, False, True)}
    assert _rows(graph.page_of_id(made, spark.createDataFrame([(1,), (3,), (6,), (99,)], "id long")), "id", "title") == {(1, "Apple"), (3, "Category:Fruit"), (6, "Mercury"), (99, None)}
    assert _rows(graph.categories_of(made, ask("Pomme"), 1), "reached") == {("Category:Fruit",)}
    assert _rows(graph.categories_of(made, ask("Pomme"), 2), "reached") == {("Category:Fruit",), ("Category:Food",)}
    assert _rows(graph.neighbours_of(made, ask("Category:Food"), 1), "id", "reached") == {(3, "Category:Fruit"), (99, None)}
    assert _rows(graph.neighbours_of(made, ask("Category:Food"), 2), "id") == {(3,), (99,), (1,), (7,)}
    assert graph.all_pages(made, True, True).count() == 5 + 5 + 1


def test_store_and_jobs(spark, made, folder, tmp_path):
    out = str(tmp_path / "graph")
    meta = cli.main(["create-graph", folder, "xx", out])
    assert meta["n_pages"] == 5 and store.load_meta(spark, out)["version"] == "20200101"
    assert _rows(store.load_graph(spark, out).edges, "src", "dst") == _rows(made.edges, "src", "dst")
    (tmp_path / "t.txt").write_text("An apple a day.")
    (tmp_path / "p.jsonl").write_text('[{"LOWER": "apple"}]\n{"pattern": [{"LOWER": "day"}]}\n')
    for job in (["profile-matcher", str(tmp_path / "t.txt"), str(tmp_path / "p.jsonl")], ["profile-graph-load", out], ["profile-graph-exec", out, str(tmp_path / "t.txt")]):
        assert cli.main(job)["seconds"] >= 0
    store.write_json(spark.range(2), str(tmp_path / "j"), compress=True)
    assert store.read_json(spark, str(tmp_path / "j"), "id long").count() == 2
    flags = [r.gzip for r in store.is_gzip(spark, f"{tmp_path}/j/*.gz").collect()] + [r.gzip for r in store.is_gzip(spark, str(tmp_path / "t.txt")).collect()]
    assert flags[-1] is False and all(flags[:-1])


def test_titles(spark):
    names = ["An", "Apple", "A", "Day", "The_Doctor", "The", "Doctor", "Doctor_(tv)", "Away_(band)_x", "!!!", "", None, "_(only)"]
    index = titles.title_index(spark.createDataFrame([(t, k) for k, t in enumerate(names)], "title string, ord long"))
    got = {r.key: r.titles for r in index.collect()}
    assert got["doctor"] == ["Doctor", "Doctor_(tv)"] and got["away x"] == ["Away_(band)_x"] and got["only"] == ["_(only)"] and len(got) == 9
    docs = tokenize(spark.createDataFrame([(1, "An apple a day keeps the doctor away"), (2, ""), (3, None)], "doc_id long, text string"))
    text = lambda df: sorted((r.start, r.end) for r in df.collect())
    assert text(titles.scan(docs, index)) == [(0, 1), (1, 2), (2, 3), (3, 4), (5, 7)]
    assert text(titles.sub_matches(docs, index)) == [(0, 1), (1, 2), (2, 3), (3, 4), (5, 6), (5, 7), (6, 7)]
    assert titles.scan(docs.limit(0), index).count() == 0 and titles.scan(docs, index.limit(0)).count() == 0
    tagged = spark.createDataFrame([(1, ["Apples", "run"], ["NNS", "VBP"], ["apple", "run"])], "doc_id long, words array<string>, tag array<string>, lemma array<string>")
    assert titles.scan(titles.lookup_words(tagged), index).select(F.explode("titles")).first()[0] == "Apple"


def test_titles_against_brute_force(spark):
    import random

    rng = random.Random(6)
    words = ["Red", "blue", "sky", "the", ",", "of", "7"]
    names = {"_".join(rng.choice(words[:4] + words[5:]) for _ in range(rng.randint(1, 5))) for _ in range(40)}
    index = titles.title_index(spark.createDataFrame([(t, k) for k, t in enumerate(sorted(names))], "title string, ord long"))
    keys = {tuple(t.lower().split("_")) for t in names}
    texts = [[rng.choice(words) for _ in range(rng.randint(0, 40))] for _ in range(40)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, words array<string>")
    every, taken, inner = [], [], []
    for d, t in enumerate(texts):
        at = [k for k, w in enumerate(t) if w != ","]
        own = [(at[a], at[b - 1] + 1) for a in range(len(at)) for b in range(a + 1, len(at) + 1) if tuple(t[k].lower() for k in at[a:b]) in keys]
        free, mine = 0, []
        for s in sorted({s for s, _ in own}):
            if s >= free:
                free = max(e for b, e in own if b == s)
                mine.append((s, free))
        every += [(d, *x) for x in own]
        taken += [(d, *x) for x in mine]
        inner += [(d, *x) for x in own if any(a <= x[0] and x[1] <= b for a, b in mine)]
    for size in (titles.BROADCAST_BYTES, 0):  # in one pass, and by a join
        for f, want in ((titles.all_matches, every), (titles.scan, taken), (titles.sub_matches, inner)):
            got = f(docs, index, broadcast_bytes=size).collect()
            assert sorted((r.doc_id, r.start, r.end) for r in got) == sorted(want)
            assert all("_".join(w for w in texts[r.doc_id][r.start : r.end] if w != ",").lower() in {x.lower() for x in r.titles} for r in got)


def test_build_of_all_titles(spark):
    page = spark.createDataFrame([("0", 1, "Apple", 1), ("0", 4, "Pomme", 4)], "ns string, id long, title string, ord long")
    props = spark.createDataFrame([], "id long, prop string, value string, ord long")
    red = spark.createDataFrame([(4, "Apple", 1)], "source_id long, target_title string, ord long")
    links = spark.createDataFrame([], "type string, source_id long, target_title string")
    assert _rows(graph.build(page, props, red, links, intended=False).pages, "title") == {("Apple",), ("Pomme",)}
    assert _rows(graph.build(page, props, red, links).pages, "title") == {("Apple",)}
    empty = graph.build(page.limit(0), props, red.limit(0), links)
    assert empty.pages.count() == 0 and empty.edges.count() == 0


def test_two_hops_around_all_titles(spark):
    near = {}
    for r in catalog.QUERIES["graph_edges"](spark, SF).collect():
        near.setdefault(r[0], set()).add(r[1])
        near.setdefault(r[1], set()).add(r[0])
    one = {(r.title, r.id) for r in catalog.QUERIES["graph_neighbours_k1"](spark, SF).collect()}
    got = {(r.title, r.id) for r in catalog.QUERIES["graph_neighbours_k2"](spark, SF).collect()}
    assert got == one | {(t, j) for t, i in one for j in near[i]} and len({t for t, _ in got}) == len({t for t, _ in one}) > 100
