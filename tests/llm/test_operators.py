"""Operators against brute force, round trips and held-out accuracy, on small tables."""

from __future__ import annotations

import math
import random
import time
from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from lexgrove.llm import bytesops, chat_format, decontam, jaccard_tree, langid_gru, media_audio, packing, pfp_dedup, quality_fm, toxicity, zm_parse

WORDS = [a + b for a in "bcdfghklmnprst" for b in ("ane", "oli", "eru", "ifa", "osta", "umi", "ada")]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def words(text: str) -> list[str]:
    import re

    return [w.lower() for w in re.findall(r"[^\W_]+", text)]


def docs_of(spark, texts, lang="en"):
    return spark.createDataFrame([(k, t, lang, "src", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def test_words_and_hashes():
    texts = ["One two, ÉTÉ x9!", "", "été", "one"]
    data, offsets = bytesops.column_bytes(pa.array(texts))
    starts, ends, rows, h = bytesops.words(data, offsets)
    assert [bytes(data[a:b]).decode() for a, b in zip(starts, ends, strict=True)] == ["One", "two", "ÉTÉ", "x9", "été", "one"]
    assert rows.tolist() == [0, 4, 4, 5, 6] and h[0] == h[5] and h[2] == h[4] and len(set(h.tolist())) == 4


# N-gram Jaccard join


def grams(text: str, n: int = jaccard_tree.N) -> frozenset:
    w = words(text)
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def near_texts(seed: int = 1) -> list[str]:
    rng = random.Random(seed)
    out = []
    for _ in range(40):
        base = prose(rng, rng.randint(30, 120)).split()
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = "changed"
            out.append(" ".join(copy))
    return [*out, out[0], out[0].upper(), "two words", "Two words.", "one", "", "..."]


def true_links(rows):
    """Similar texts, by their places in rows of (doc_id, text)."""
    sets = [grams(t or "") for _, t in rows]
    out = {}
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i < j and a and b and rows[i][0] != rows[j][0] and (s := len(a & b) / len(a | b)) >= jaccard_tree.THRESHOLD:
                out[i, j] = s
    return out


def test_representative_pairs_against_brute_force(spark):
    texts = near_texts()
    true = true_links(list(enumerate(texts)))
    got = {(r.doc_id, r.other_id): r.jaccard for r in jaccard_tree.representative_pairs(docs_of(spark, texts)).collect()}
    for pair, s in got.items():
        assert abs(true[pair] - s) < 1e-9
    same = {j: i for (i, j), s in sorted(got.items(), reverse=True) if s == 1.0}
    root = lambda k: same.get(k, k)
    hit = [p for p in true if root(p[0]) == root(p[1]) or tuple(sorted((root(p[0]), root(p[1])))) in got]
    assert len(true) > 40 and len(hit) >= 0.99 * len(true)


def test_jaccard_join_against_brute_force(spark):
    rng = random.Random(12)
    base = prose(rng, 60)
    rows = list(enumerate(near_texts(5), 100))
    rows += [(k, base) for k in range(10)] + [(k, f"{base} more".upper()) for k in range(10, 16)] + [(20, prose(rng, 40)), (3, prose(rng, 40)), (30, "other words here")]
    # Document 3 has two texts, so that the copies of both are one group.
    rows += [(21, rows[-2][1]), (22, rows[-2][1]), (40, None)]
    true = true_links(rows)
    up = {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    links, best = defaultdict(int), {}
    for (x, y), v in true.items():
        i, j = rows[x][0], rows[y][0]
        links[i], links[j] = links[i] + 1, links[j] + 1
        best[i], best[j] = max(v, best.get(i, 0)), max(v, best.get(j, 0))
        i, j = find(i), find(j)
        up[max(i, j)] = min(i, j)
    docs = spark.createDataFrame([*rows, (None, base), rows[-3]], "doc_id long, text string")
    for block in (jaccard_tree.BLOCK, 2):  # whole blocks, and parts of them
        got = {r.doc_id: r for r in jaccard_tree.jaccard_join(docs, block=block).collect()}
        assert set(got) == {i for i, _ in rows} and links[0] == 15
        wrong = [i for i, r in got.items() if (r.class_id, r.n_links) != (find(i), links[i]) or abs((r.best_jaccard or 0) - best.get(i, 0)) > 1e-9]
        assert not wrong


def test_labels_of_components():
    rng = np.random.default_rng(4)
    for n, m in ((1, 0), (50, 30), (50, 45), (200, 199)):
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        label = list(range(n))
        for _ in range(n):
            for x, y in zip(a, b, strict=True):
                label[x] = label[y] = min(label[x], label[y])
        assert jaccard_tree.lowest_labels(n, a, b).tolist() == label
    chain = np.arange(999)
    assert not jaccard_tree.lowest_labels(1000, chain + 1, chain).any()


def test_signature_tree_is_exact():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 60)).astype(np.uint32)) for _ in range(150)]
    sets += [np.unique(np.append(s, np.uint32(999))) for s in sets[:40]]
    a, b, s = jaccard_tree.similar_pairs(sets, 0.6)
    got = {(min(x, y), max(x, y)): v for x, y, v in zip(a.tolist(), b.tolist(), s.tolist(), strict=True)}
    true = {}
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            common = len(np.intersect1d(sets[i], sets[j]))
            if (v := common / (len(sets[i]) + len(sets[j]) - common)) >= 0.6:
                true[i, j] = v
    assert got.keys() == true.keys() and all(abs(got[k] - true[k]) < 1e-12 for k in got)


def test_components_and_keep_one(spark):
    pairs = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.9), (10, 11, 0.9), (3, 12, 0.7), (11, 20, 0.7)], "doc_id long, other_id long, jaccard double")
    assert {(r.doc_id, r.root) for r in jaccard_tree.components(pairs).collect()} == {(1, 1), (2, 1), (3, 1), (12, 1), (10, 10), (11, 10), (20, 10)}
    texts = near_texts(3)
    docs = docs_of(spark, texts)
    pairs = [(r.doc_id, r.other_id) for r in jaccard_tree.representative_pairs(docs).collect()]
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    assert sorted(r.doc_id for r in jaccard_tree.keep_one(docs).collect()) == [k for k in range(len(texts)) if find(k) == k]


# Suffix-array dedup


def repeat_texts(seed: int = 4) -> list[str]:
    rng = random.Random(seed)
    passages = [prose(rng, n) for n in (50, 51, 80, 200)]
    out = [f"{prose(rng, rng.randint(0, 90))} {rng.choice(passages)} {prose(rng, rng.randint(0, 90))}" for _ in range(30)]
    return [*out, passages[3], f"{passages[2]}, {passages[2].upper()}", out[0], prose(rng, 49), " ".join(["same"] * 400), ""]


def repeated_words(texts: list[str], n: int = pfp_dedup.LENGTH) -> tuple[dict, dict]:
    """Words of each document that lie in a window that occurs twice; and those in one that occurred before."""
    seen: dict = defaultdict(list)
    for i, t in enumerate(texts):
        w = words(t)
        for k in range(len(w) - n + 1):
            seen[tuple(w[k : k + n])].append((i, k))
    every, later = defaultdict(set), defaultdict(set)
    for places in seen.values():
        if len(places) > 1:
            for j, (i, k) in enumerate(sorted(places)):
                every[i].update(range(k, k + n))
                if j:
                    later[i].update(range(k, k + n))
    return every, later


def test_repeats_against_brute_force(spark):
    texts = repeat_texts()
    every, later = repeated_words(texts)
    rows = docs_of(spark, texts).unionByName(docs_of(spark, texts).where("doc_id < 9"))  # some come twice
    for group, hot in ((pfp_dedup.GROUP, pfp_dedup.HOT), (300, pfp_dedup.HOT), (pfp_dedup.GROUP, 0), (2000, 0)):
        got, gone = defaultdict(set), defaultdict(set)
        for r in pfp_dedup.repeated_spans(rows, group, hot).collect():
            got[r.doc_id].update(range(r.start_word, r.end_word))
            if not r.kept:
                gone[r.doc_id].update(range(r.start_word, r.end_word))
        assert got == every and len(every) > 20
        assert gone == later


def test_hot_triggers_are_cut_into_windows(spark):
    """A passage that all documents have, each in other surroundings: the phrases at its edges all differ."""
    rng = random.Random(14)
    passage = prose(rng, 70)
    texts = [f"{prose(rng, 60)} {passage} {prose(rng, 60)}" for _ in range(60)]
    every, later = repeated_words(texts)
    for hot in (pfp_dedup.HOT, 20):
        got, gone = defaultdict(set), defaultdict(set)
        for r in pfp_dedup.repeated_spans(docs_of(spark, texts).coalesce(1), hot=hot).collect():
            got[r.doc_id].update(range(r.start_word, r.end_word))
            if not r.kept:
                gone[r.doc_id].update(range(r.start_word, r.end_word))
        assert got == every and gone == later
    data, offsets = bytesops.column_bytes(pa.array(texts))
    _, _, rows, h = bytesops.words(data, offsets)
    p = pfp_dedup.phrases(h, rows)
    arrays = (p["row"], p["row"] * 0, p["trigger"], p["start"], p["before"], p["first"], p["body"])
    whole = pfp_dedup.Group(*arrays, np.zeros(0, np.int64))
    busy = whole.busy().to_pydict()
    assert max(busy["n"]) >= 40
    cut = pfp_dedup.Group(*arrays, np.sort(np.array([t for t, n in zip(busy["trigger"], busy["n"], strict=True) if n > 20])))
    assert cut.windows.sum() < whole.windows.sum() and max(cut.busy().to_pydict()["n"], default=0) <= 20


def test_repeats_are_cut_from_texts(spark):
    texts = repeat_texts()
    _, later = repeated_words(texts)
    kept = {r.doc_id: (words(r.text), r.n_chars, len(r.text)) for r in pfp_dedup.drop_repeats(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        left = [w for k, w in enumerate(words(t)) if k not in later.get(i, ())]
        if left:
            assert kept[i][0] == left and kept[i][1] == kept[i][2]
        elif words(t):
            assert i not in kept


# Benchmark decontamination


def test_templates_catch_new_parameters_and_leave_others(spark):
    item = "A train leaves the old station with 120 kg of grain and travels for 3 hours until the driver Anna meets the farmer Boris near the river."
    other = "The painter mixed the blue with the green for a long while and hung every picture on the wall of the quiet house by noon."
    docs = {
        1: f"Some text before. {item} And after.",
        2: f"Intro words here. {item.replace('120', '75').replace('3 hours', '9 days').replace('Anna', 'Clara').replace('Boris', 'David')} The end.",
        3: f"{item.upper()} SHOUTED.",
        4: other,
        5: "A train leaves the new town. Nothing else is alike in this text about the farmer and the river, or the station with grain.",
        6: item.replace("Anna", "Clara").replace("the farmer Boris near", "a farmer called Boris by"),
    }
    table = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, "short one"), (9, None)], "item_id long, text string")
    got = {r.doc_id: r for r in decontam.contaminated(table, bench).collect()}
    assert set(got) >= {1, 2, 3} and not {4, 5} & set(got)
    assert got[1].exact and not got[2].exact and got[1].coverage == 1.0
    assert {r.doc_id for r in decontam.drop_contaminated(table, bench).collect()} == set(docs) - set(got)


def test_names_that_open_short_sentences(spark):
    item = "Anna buys 3 apples at the market. Boris sells 4 pears near the river. Clara eats 5 plums under the tree. Anna gives 2 apples to her friend."
    docs = {
        1: item.replace("Anna", "Dora").replace("Boris", "Emil").replace("Clara", "Frida").replace("3", "9"), 2: item,
        3: "Dora walks slowly along the beach. Emil reads old books in bed. Frida paints small pictures of the sea. Gerd sings loud songs at night.",
        4: f"Once more: then Dora buys 3 apples at the market. {item[34:]}",
    }
    table = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in decontam.contaminated(table, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert set(got) == {1, 2, 4} and got[1].coverage == 1.0 and not got[1].exact
    assert got[2].exact and got[2].coverage == 1.0 and not got[4].exact


def test_slots_have_to_be_consistent(spark):
    item = "In the game the player 5 gives the ball to player 7 and then the player 5 takes the ball from player 7 while they run in the game"
    bad = "In the game the player 5 gives the ball to player 7 and then the player 6 takes the ball from player 8 while they run in the game"
    good = item.replace("5", "1").replace("7", "2")
    table = spark.createDataFrame([(1, good), (2, bad)], "doc_id long, text string")
    assert [r.doc_id for r in decontam.contaminated(table, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()] == [1]


def found(spark, texts, items):
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {(r.doc_id, r.item_id): r for r in decontam.contaminated(table, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}


def test_slots_are_paired_one_to_one_and_over_all_alignments(spark):
    item = "In the game the player 5 gives the ball to player 7 and then the player 5 takes the ball from player 7 while they run in the game"
    merged = item.replace("7", "5").replace("5", "1")
    # Two more words in the middle; from there on the players are others.
    apart = "In the game the player 1 gives the ball to player 2 and then after all the player 3 takes the ball from player 4 while they run in the game"
    agreed = apart.replace("3", "1").replace("4", "2")
    got = found(spark, [merged, apart, agreed], [item])
    assert (0, 0) not in got and got[2, 0].coverage > 0.6
    assert (1, 0) not in got or got[1, 0].coverage < got[2, 0].coverage


def test_short_items_and_names_of_any_script(spark):
    items = ["What is 7 times 6 ?", "7 + 5 = 12", "two words", "it was 3", "Сколько яблок купил Иван у Ольги вчера утром на рынке", "pytanie o to co kupił Łukasz od pani Żanety na targu"]
    texts = [
        "Look: What is 7 times 6 ? Well.", "so what is 12 times 9 now", "and 7 + 5 = 12 there", "and 7 + 6 = 13 there", "two words", "it was 3",
        "Сколько яблок купил Пётр у Елены вчера утром на рынке", "pytanie o to co kupił Józef od pani Ęwy na targu", "the cat is on 7 mats, 6 times",
    ]
    got = found(spark, texts, items)
    assert set(got) == {(0, 0), (1, 0), (2, 1), (5, 3), (6, 4), (7, 5)}
    assert got[0, 0].exact and not got[1, 0].exact and got[2, 1].exact and not got[6, 4].exact and got[6, 4].coverage == 1.0


def test_decontamination_against_brute_force(spark):
    rng = random.Random(21)
    plain, names, W, L = ["ham", "egg", "jam", "tea"], ["Anna", "Bob", "Cleo"], decontam.WINDOW, decontam.LITERALS

    def text(n):
        return [rng.choice(plain) if rng.random() < 0.7 or k == 0 else rng.choice(names) if rng.random() < 0.5 else str(rng.randint(1, 3)) for k in range(n)]

    items = [text(rng.randint(1, 16)) for _ in range(30)]
    texts = []
    for _ in range(120):
        own = list(rng.choice(items))
        if rng.random() < 0.7:
            to = dict(zip(names, rng.sample(names, 3), strict=True)) if rng.random() < 0.5 else {n: rng.choice(names) for n in names}
            own = [to.get(w, w) for w in own]
        if rng.random() < 0.4:
            own.insert(rng.randint(0, len(own)), "tea")
        texts.append(text(rng.randint(1, 6)) + own + text(rng.randint(0, 6)))

    def slot(w):
        return "#" if w.isdigit() else "@" if w[0].isupper() else ""

    def grams(w, n, literal):
        out = {}
        for k in range(len(w) - n + 1):
            part = w[k : k + n]
            kept = tuple(x if literal else slot(x) or x for x in part)
            if literal or sum(not slot(x) for x in part) >= L:
                out[k] = (kept, [] if literal else [x for x in part if slot(x)])
        return out

    want = {}
    for j, item in enumerate(items):
        for n, literal in [(W, False), *((n, False) for n in range(W - 1, L - 1, -1)), *((n, True) for n in range(W, L - 1, -1))]:
            own = grams(item, n, literal)
            if own:
                break
        for i, t in enumerate(texts):
            by = defaultdict(lambda: (set(), set()))
            for k, (g, f) in grams(t, n, literal).items():
                for p, (h, e) in own.items():
                    if g == h:
                        by[k - p][0].add(p)
                        by[k - p][1].update(zip(e, f, strict=True))
            fair = lambda pairs: len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
            seen, agreed = set(), set()
            for shift in sorted(by, key=lambda s: (-len(by[s][0]), s)):
                if fair(by[shift][1]) and fair(agreed | by[shift][1]):
                    agreed |= by[shift][1]
                    seen |= by[shift][0]
            if own and len(seen) >= decontam.COVERAGE * len(own):
                want[i, j] = (len(seen) / len(own), all(a == b for a, b in agreed))
    got = found(spark, [" ".join(t) for t in texts], [" ".join(t) for t in items])
    assert {k: (r.coverage, r.exact) for k, r in got.items()} == want and len(want) > 100


# Packing


def least_cost(lengths, penalties, capacity):
    cost = [0] + [math.inf] * len(lengths)
    for i in range(1, len(lengths) + 1):
        total = 0
        for j in range(i - 1, -1, -1):
            total += lengths[j]
            if total > capacity:
                break
            cost[i] = min(cost[i], cost[j] + capacity - total + penalties[i - 1])
    return cost[-1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 20), st.sampled_from([0, 3, 9])), min_size=1, max_size=30))
def test_cuts_are_the_cheapest(units):
    lengths, penalties = np.array([u[0] for u in units]), np.array([u[1] for u in units])
    cuts = packing.best_cuts(lengths, penalties, 20)
    cost = 0
    for a, b in zip([0, *cuts[:-1]], cuts, strict=True):
        used = int(lengths[a:b].sum())
        assert used <= 20
        cost += 20 - used + int(penalties[b - 1])
    assert cuts[-1] == len(units) and cost == least_cost(lengths.tolist(), penalties.tolist(), 20)


def test_parts_of_the_order():
    rng = np.random.default_rng(3)
    bounds = np.unique(rng.integers(-3, 4, (9, 2)), axis=0)
    doc, key = rng.integers(-5, 6, (2, 200))
    assert packing.part_of(doc, key, bounds).tolist() == [sum((b[0], b[1]) < (d, k) for b in bounds.tolist()) for d, k in zip(doc.tolist(), key.tolist(), strict=True)]
    assert not packing.part_of(doc, key, np.zeros((0, 2), np.int64)).any()


def test_packing_round_trip(spark):
    rng = random.Random(6)
    texts = [". ".join(prose(rng, rng.randint(1, 40)).capitalize() for _ in range(rng.randint(1, 60))) + "." for _ in range(30)] + ["é" * 20_000, "", None, "x"]
    rows = packing.pack_with_text(docs_of(spark, texts)).collect()
    by_doc, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        windows[r.shard, r.window].append(r)
    assert {k for k, t in enumerate(texts) if t} == set(by_doc)
    for k, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.start_byte)
        assert "".join(r.text for r in pieces) == texts[k]
    order = [r.doc_id for _, w in sorted(windows.items()) for r in sorted(w, key=lambda r: r.piece)]
    assert order == sorted(order)
    for w in windows.values():
        assert sum(r.n_tokens for r in w) + w[0].padding == packing.CAPACITY and len({r.padding for r in w}) == 1


# Classifiers


def test_factorisation_machine_sum_of_squares():
    rng = np.random.default_rng(1)
    model = quality_fm.FactorisationMachine(30, 4)
    model.w, model.v, model.w0 = rng.normal(size=30).astype(np.float32), rng.normal(size=(30, 4)).astype(np.float32), 0.3
    index, value, first = np.array([1, 5, 9, 2, 5]), rng.normal(size=5).astype(np.float32), np.array([0, 3, 5])
    for r, got in enumerate(model.raw(first, index, value)):
        i, x = index[first[r] : first[r + 1]], value[first[r] : first[r + 1]]
        pairs = sum(float(model.v[i[a]] @ model.v[i[b]]) * x[a] * x[b] for a in range(len(i)) for b in range(a))
        assert abs(got - (0.3 + float(model.w[i] @ x) + pairs)) < 1e-4


def test_features_by_plain_loops():
    texts = ["Two words, two WORDS! 42", "", "Zeile eins\nzeile zwei\n", None, "x"]
    parts = list(quality_fm.features(pa.array(texts), pa.array(["en", "en", "de", None, ""]), pa.array(["a", None, "a", "b", "a"])))
    assert len(parts) == 1
    first, index, value, some = parts[0]
    assert some.tolist() == [True, False, True, False, True]
    for k, t in enumerate(texts):
        t = t or ""
        w, raw = [x.lower() for x in __import__("re").findall(r"[A-Za-z0-9]+", t)], t.encode()
        got = dict(zip(index[first[k] : first[k + 1]].tolist(), value[first[k] : first[k + 1]].tolist(), strict=True))
        counts = defaultdict(float)
        for x in w:
            data = np.frombuffer(x.encode(), np.uint8)
            counts[int(bytesops.span_hashes(data, np.array([0]), np.array([len(x)]))[0] % np.uint64(quality_fm.WORDS))] += 1
        norm = math.sqrt(sum(c * c for c in counts.values()))
        assert all(abs(got[b] - c / norm) < 1e-6 for b, c in counts.items())
        letters = max(1, sum(65 <= c <= 122 for c in raw))
        plain = sum(chr(c).isalnum() for c in raw)
        spaces, n, size = raw.count(b" ") + raw.count(b"\n"), max(1, len(w)), max(1, len(raw))
        stats = [plain / size, sum(65 <= c <= 90 for c in raw) / letters, sum(48 <= c <= 57 for c in raw) / size, (len(raw) - spaces - plain) / n, raw.count(b"\n") / n, min(plain / n / 16, 2), math.log1p(len(w)) / 10, len(counts) / n, 1.0]
        assert all(abs(got[quality_fm.DIM - quality_fm.STATS + j] - x) < 1e-6 for j, x in enumerate(stats))
        assert len(got) == len(counts) + 2 + quality_fm.STATS or len(set(index[first[k] : first[k + 1]].tolist())) < first[k + 1] - first[k]


def _held_out(spark, column, make):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    known = {r.doc_id: r[column] for r in labels.collect()}
    train = labels.where("doc_id % 4 != 0")
    return [(known[r.doc_id], r) for r in make(docs, train).collect() if r.doc_id in known and r.doc_id % 4 == 0]


def test_quality_on_held_out_documents(spark):
    rows = _held_out(spark, "quality", quality_fm.quality)
    good = [r.keep for y, r in rows if y]
    bad = [r.score for y, r in rows if not y]
    assert np.mean(good) > 0.93 and np.mean(bad) < np.mean([r.score for y, r in rows if y]) - 0.4


def test_toxicity_on_held_out_insults(spark):
    rng = random.Random(8)
    insults = ["vexipod", "grundlop", "mizzlewart"]
    clean = [prose(rng, rng.randint(20, 200)) for _ in range(400)]
    toxic = [" ".join([*c.split()[:10], *(rng.choice(insults) for _ in range(3)), *c.split()[10:]]) for c in clean[:150]]
    docs = docs_of(spark, clean + toxic)
    labels = spark.createDataFrame([(k, 1, int(k >= 400)) for k in range(550) if k % 3], "doc_id long, quality int, toxic int")
    rows = [r for r in toxicity.toxicity(docs, labels).collect() if r.doc_id % 3 == 0]
    assert np.mean([r.toxic for r in rows if r.doc_id >= 400]) > 0.9 and np.mean([r.toxic for r in rows if r.doc_id < 400]) < 0.05


def test_toxicity_scores_by_hand(spark):
    """The whole query against plain dictionaries of n-grams and of weights."""
    rng = random.Random(3)
    texts = [prose(rng, rng.randint(3, 30)) + (" grundlop" if k % 3 == 0 else "") for k in range(60)] + ["", "ab", "Grundlop GRUNDLOP"]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(60)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)

    def buckets(text):
        low, out = text.lower().encode(), set()
        for n in toxicity.ORDERS:
            for i in range(len(low) - n + 1):
                h = 0
                for k in range(n):
                    h = (h + (low[i + k] + 1) * int(toxicity._K[k])) & 0xFFFFFFFF
                    h ^= h >> 13
                    h = h * 0x2C1B3C6D & 0xFFFFFFFF
                out.add((h ^ (h >> 15) ^ (n - 1)) & (toxicity.BUCKETS - 1))
        return out

    toxic, clean = defaultdict(int), defaultdict(int)
    for k, t in enumerate(texts[:60]):
        for b in buckets(t):
            (clean if k % 3 else toxic)[b] += 1
    total = {c: sum(d.values()) + toxicity.BUCKETS for c, d in (("t", toxic), ("c", clean))}
    ratio = {b: math.log((toxic[b] + 1) / total["t"]) - math.log((clean[b] + 1) / total["c"]) for b in {*toxic, *clean}}
    useful = {b for b in ratio if toxic[b] + clean[b] >= toxicity.MIN_TEXTS and abs(ratio[b]) >= toxicity.MIN_RATIO}
    assert set(np.flatnonzero(model.useful).tolist()) == useful and useful
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    for k, t in enumerate(texts):
        want = 1 / (1 + math.exp(-(model.bias + sum(float(model.weight[b]) for b in buckets(t) if b in useful)))) if t else 0.0
        assert abs(got[k].score - want) < 1e-5 and got[k].toxic == (got[k].score > model.threshold)
    assert got[62].score > max(got[k].score for k in range(60) if k % 3)


# Language ID


def test_gru_gradients():
    net = langid_gru.ByteGru(["a", "b", "c"], hidden=3, seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    data, y = np.random.default_rng(0).integers(97, 103, (4, 6)).astype(np.uint8), np.array([0, 1, 2, 1])
    _, grads = net.loss_and_gradients(data, y)
    for name, g in grads.items():
        flat = net.p[name].reshape(-1)
        for k in np.argsort(-np.abs(g).ravel())[:3]:
            was = flat[k]
            flat[k] = was + 1e-5
            up = net.loss_and_gradients(data, y)[0]
            flat[k] = was - 1e-5
            down = net.loss_and_gradients(data, y)[0]
            flat[k] = was
            assert abs((up - down) / 2e-5 - g.ravel()[k]) < 1e-6


def test_gru_scores_windows_alike():
    net = langid_gru.ByteGru(["a", "b"], seed=2)
    texts = [b"abc" * 5, b"x", b"hello world, hello"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    got = net.position_probabilities(data, offsets)
    for k, t in enumerate(texts):
        alone = net.position_probabilities(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        assert np.allclose(got[offsets[k] : offsets[k + 1]], alone, atol=1e-5)


def test_gru_scores_against_a_plain_loop():
    net = langid_gru.ByteGru(["a", "b", "c"], hidden=5, seed=4)
    net.p["bias"][:] = [0.1, -0.2, 0.3]
    texts, span = [b"some words here", b"z", b"a longer text than the others are"], 7
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    got = net.position_probabilities(data, offsets, span)
    sig = lambda v: 1 / (1 + np.exp(-v))
    for k, text in enumerate(texts):
        for b in range(0, len(text), span):
            part = text[b : b + span]
            states = np.zeros((2, len(part), 5))
            for side in (0, 1):
                h = np.zeros(5)
                for t in range(len(part)) if side == 0 else range(len(part) - 1, -1, -1):
                    x, g = net.p["x"][side, part[t]], h @ net.p["u"][side]
                    z, r = sig(x[:5] + g[:5]), sig(x[5:10] + g[5:10])
                    n = np.tanh(x[10:] + r * g[10:])
                    h = n + z * (h - n)
                    states[side, t] = h
            logits = states[0] @ net.p["out"][0] + states[1] @ net.p["out"][1] + net.p["bias"]
            want = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
            assert np.allclose(got[offsets[k] + b : offsets[k] + b + len(part)], want, atol=1e-5)
            # The training pass has the same probabilities: its loss is of these.
            loss, _ = net.loss_and_gradients(np.frombuffer(part, np.uint8)[None], np.array([1]))
            assert abs(loss + np.log(want[:, 1]).mean()) < 1e-5


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = {r.doc_id: (r.lang, len(r.text.encode())) for r in docs.collect()}
    rows = {r.doc_id: r for r in langid_gru.identify(docs.where("doc_id % 2 = 0").unionByName(docs.where("doc_id % 2 = 1").withColumn("lang", docs["lang"].cast("string").substr(1, 0))).where("lang != '' or doc_id % 2 = 1").selectExpr("doc_id", "text", "nullif(lang, '') as lang")).collect()}
    held = [(known[i][0], r.lang) for i, r in rows.items() if i % 2 and known[i][1] > 200]
    assert np.mean([a == b for a, b in held]) > 0.95
    for i, r in rows.items():
        if r.segments:
            assert r.segments[0].start_byte == 0 and r.segments[-1].end_byte == known[i][1] and all(a.end_byte == b.start_byte for a, b in zip(r.segments, r.segments[1:], strict=False))
            assert abs(sum(r.probabilities) - 1) < 1e-4


def test_every_language_is_a_class(spark):
    from pyspark.sql import functions as F

    ids = spark.range(400).withColumnRenamed("id", "doc_id")
    rare = [r.doc_id for r in ids.orderBy(F.xxhash64("doc_id").desc()).limit(2).collect()]  # a sample by hash draws these last
    docs = ids.withColumn("lang", F.when(F.col("doc_id").isin(rare), "rare").otherwise("en")).withColumn("text", F.concat(F.lit("some words of text "), F.col("doc_id").cast("string")))
    assert langid_gru.fit(docs, 20).classes == ["en", "rare"]


# Language-model scoring


def exact_phrases(text, reference):
    """The greedy parse against all substrings of the reference texts."""
    has = {tuple(r[a:b]) for r in reference for a in range(len(r)) for b in range(a + 1, len(r) + 1)}
    at = count = 0
    while at < len(text):
        n = 1
        while at + n < len(text) and tuple(text[at : at + n + 1]) in has:
            n += 1
        at, count = at + n, count + 1
    return count


def windowed_phrases(text, reference):
    """The greedy parse against strings whose substrings of the lengths of ROUNDS all are in the reference texts."""
    levels = [n for r in zm_parse.ROUNDS for n in r]
    has = {tuple(r[a : a + n]) for r in reference for n in levels for a in range(len(r) - n + 1)}
    at = count = 0
    while at < len(text):
        n = 1
        while at + n < len(text) and all(tuple(text[k : k + m]) in has for m in levels if m <= n + 1 for k in range(at, at + n + 2 - m)):
            n += 1
        at, count = at + n, count + 1
    return count


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_own_parse(text):
    seen, now, own = set(), (), 0
    for c in text:
        now += (c,)
        if now not in seen:
            seen.add(now)
            now, own = (), own + 1
    assert zm_parse.own_phrases(text) == own + bool(now)


def test_cross_parse_against_brute_force(spark):
    rng = random.Random(10)
    few = WORDS[:6]
    texts = [" ".join(rng.choice(few) for _ in range(rng.randint(1, 50))) for _ in range(60)]
    texts += [texts[0], texts[3], texts[59], prose(rng, 300), prose(rng, 5)]
    texts += [f"{prose(rng, 3)} {texts[63][400:900].strip()}", "", None, " \n", "Odd, odd! odd? 3.5 é"]
    langs = ["en"] * 50 + ["xx"] * 13 + ["en"] * 7
    rows = [(k, t, lang) for k, (t, lang) in enumerate(zip(texts, langs, strict=True))] + [(80, "alone here", "yy"), (81, "apart", "yy"), (None, texts[5], "en"), (2, texts[4], "en"), (2, texts[4], "en"), (82, "one", "zz"), (83, "null one", None), (84, "one null", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")

    def split(t):
        data, offsets = bytesops.column_bytes(pa.array([t], pa.string()))
        return zm_parse.symbols(data, offsets)[0].tolist()

    parts = [split(t) for _, t, _ in rows]
    want = []
    for k, (i, _, lang) in enumerate(rows):
        reference = [p for j, p in enumerate(parts) if j != k and (rows[j][2] or "") == (lang or "")]
        size, n = sum(map(len, reference)), len(parts[k])
        c = windowed_phrases(parts[k], reference)
        want.append((i, n, size, c))
        if n <= 4:
            assert c == exact_phrases(parts[k], reference)
    for chunk, bucket in ((zm_parse.CHUNK, zm_parse.BUCKET), (200, 50), (1, 1000)):
        got = zm_parse.cross_parse(docs.repartition(3), chunk, bucket).collect()
        assert sorted(((r.doc_id, r.n_symbols, r.reference_symbols, r.phrases) for r in got), key=str) == sorted(want, key=str)
        assert [r.doc_id for r in got if r.cross_entropy is None] and {r.doc_id for r in got if r.cross_entropy is None} == {66, 67, 68, 82}
        for r in got:
            if r.cross_entropy is not None:
                cost = r.phrases * math.log2(max(2, r.reference_symbols))
                assert abs(r.cross_entropy - cost / r.n_symbols) < 1e-9 and abs(r.relative_entropy - (cost - r.own_phrases * math.log2(r.own_phrases)) / r.n_symbols) < 1e-9


def test_phrases_are_longest_matches_in_one_other_row(spark):
    """Matches of any length, in texts whose windows all occur elsewhere, though not together; near copies, runs of one word, and rows without symbols."""
    rng = random.Random(17)
    texts = [" ".join(rng.choice(WORDS[: rng.choice((2, 4, 30))]) for _ in range(rng.randint(1, 90))) for _ in range(30)]
    # Every window of up to 8 symbols of the first text is in one of two others, which overlap by 9.
    texts += [" ".join(f"w{k}" for k in range(a, b)) for a, b in ((0, 40), (0, 24), (15, 40))]
    for k in range(12):
        near = rng.choice(texts[:30]).split()
        for _ in range(rng.randint(0, 3)):
            near[rng.randrange(len(near))] = rng.choice(WORDS)
        texts.append(" ".join(near))
    texts += ["so " * 70, "so " * 33 + "on", "", None]
    rows = [(k, t, "en") for k, t in enumerate(texts)]

    def split(t):
        data, offsets = bytesops.column_bytes(pa.array([t], pa.string()))
        return zm_parse.symbols(data, offsets)[0].tolist()

    parts = [split(t) for t in texts]
    want = {k: exact_phrases(p, parts[:k] + parts[k + 1 :]) for k, p in enumerate(parts)}
    assert want[30] == 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    for chunk, bucket in ((zm_parse.CHUNK, zm_parse.BUCKET), (150, 60)):
        assert {r.doc_id: r.phrases for r in zm_parse.cross_parse(docs, chunk, bucket).collect()} == want


def test_rounds_leave_their_files_behind_no_longer_than_they_are_read(spark):
    """Of all rounds' exchanges and checkpoints only what the result is read from stays on disk."""

    def shuffles() -> set[str]:
        files = spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return {f.getName().split("_")[1] for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(files) if f.getName().startswith("shuffle_")}

    def checkpoints() -> set[Path]:
        folder = spark.sparkContext.getCheckpointDir()
        return {*Path(folder.removeprefix("file:")).glob("rdd-*")} if folder else set()

    rng = random.Random(19)
    texts = [prose(rng, 60) for _ in range(30)]
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate([*texts, *texts[:5], prose(rng, 1500)])], "doc_id long, text string, lang string").repartition(3)
    old = shuffles(), checkpoints()
    scores = zm_parse.cross_parse(docs, 150, 60)
    assert len(scores.collect()) == 36
    until = time.time() + 20
    while len(shuffles() - old[0]) > 6 and time.time() < until:  # files go in the background
        time.sleep(0.2)
    assert len(zm_parse.rounds(1500)) == 8 and len(shuffles() - old[0]) <= 6 and len(checkpoints() - old[1]) == 2
    assert len(scores.collect()) == 36


def test_copies_score_apart_wherever_they_lie(spark):
    rng = random.Random(13)
    rows = [(k, prose(rng, 80), "en") for k in range(200)] + [(200 + k, t, "en") for k, t in enumerate(prose(rng, 80) for _ in range(5))]
    rows += [(300 + i, t, "en") for i, t, _ in rows[200:205]]
    got = {r.doc_id: r for r in zm_parse.cross_parse(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7), 500, 700).collect()}
    copies = {i for i in got if i >= 200}
    assert all(got[i].phrases == 1 for i in copies) and min(r.cross_entropy for i, r in got.items() if i not in copies) > 10 * max(got[i].cross_entropy for i in copies)
    # Texts of another language change nothing.
    more = rows + [(1000 + k, t, "fr") for k, (_, t, _) in enumerate(rows[:50])]
    again = {r.doc_id: r for r in zm_parse.cross_parse(spark.createDataFrame(more, "doc_id long, text string, lang string"), 500, 700).collect()}
    assert all(again[i].cross_entropy == r.cross_entropy for i, r in got.items())


# Audio


def test_audio_against_direct_computation(spark):
    rng = np.random.default_rng(5)
    texts = ["".join(map(chr, rng.integers(32, 127, n))) for n in (1, 300, 441, 442, 5000)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    y, first, count = media_audio.resample(data, offsets)
    frames, rows = media_audio.frames_of(y, first, count)
    mel = media_audio.log_mel(frames)
    for k, t in enumerate(texts):
        x = np.frombuffer(t.encode(), np.uint8).astype(float)
        x = (x - x.mean()) / 128
        m = np.arange(math.ceil(len(x) * media_audio.UP / media_audio.DOWN))
        direct = (media_audio.low_pass(np.arange(len(x))[None, :] - m[:, None] * media_audio.DOWN / media_audio.UP) * x).sum(1)
        assert np.allclose(y[first[k] : first[k] + count[k]], direct, atol=1e-4)
        for f in range(rows[k + 1] - rows[k]):
            frame = np.zeros(media_audio.FRAME)
            part = direct[f * media_audio.HOP : f * media_audio.HOP + media_audio.FRAME]
            frame[: len(part)] = part
            padded = np.zeros(media_audio.FFT)
            padded[: media_audio.FRAME] = frame * media_audio._HANN
            n = np.arange(media_audio.FFT)
            power = np.abs((np.exp(-2j * np.pi * np.outer(np.arange(media_audio.FFT // 2 + 1), n) / media_audio.FFT) * padded).sum(1)) ** 2
            assert np.allclose(mel[rows[k] + f], np.log(np.maximum(power @ media_audio._MEL, media_audio.LOG_FLOOR)), atol=5e-2)


def test_hysteresis_and_segments():
    rng = np.random.default_rng(6)
    energy = np.concatenate([rng.uniform(-50, 0, 60), rng.uniform(-30, -10, 25), np.full(5, -3.0), np.full(4, -90.0)]).astype(np.float32)
    rows = np.array([0, 60, 85, 90, 94])
    active = media_audio.active_frames(energy, rows)
    for a, b in zip(rows[:-1], rows[1:], strict=True):
        e = np.sort(energy[a:b])
        quiet, loud = e[(b - a - 1) // 10], e[(b - a - 1) * 95 // 100]
        even = loud - quiet < media_audio.EVEN_DB
        up = media_audio.SILENCE_DB if even else max(media_audio.SILENCE_DB, quiet + np.float32(media_audio.UPPER) * (loud - quiet))
        low = media_audio.SILENCE_DB if even else quiet + np.float32(media_audio.LOWER) * (loud - quiet)
        on = False
        for k in range(a, b):
            on = True if energy[k] >= up else (False if energy[k] < low else on)
            assert active[k] == on
    begin, end = media_audio.segments_of(np.array([1, 1, 1, 0, 1, 1, 0, 1, 1, 1], bool), np.array([0, 8, 10]))
    assert begin.tolist() == [0, 8] and end.tolist() == [2, 9]


def test_tensors(spark, tmp_path):
    made = media_audio.audio_features(docs_of(spark, ["abc" * 5000, "x", "", None]), "text")
    rows = made.collect()
    tensors = [pa.ipc.read_tensor(pa.BufferReader(bytes(r.logmel))) for r in rows]
    assert {r.doc_id for r in rows} == {0, 1} and all(t.shape == (media_audio.CHUNK, media_audio.MELS) and t.dim_names == ["frame", "mel"] for t in tensors)
    files = media_audio.write_tensors(made, f"file://{tmp_path}/t").collect()
    read = pa.concat_tables(pq.read_table(f"{tmp_path}/t/{f.file}") for f in files)
    assert isinstance(read.schema.field("logmel").type, pa.FixedShapeTensorType) and read.schema.field("logmel").type.shape == [media_audio.CHUNK, media_audio.MELS]
    assert read.num_rows == sum(f.n_rows for f in files) == len(rows)
    key = lambda r: (r["doc_id"], r["chunk"])
    want = [t.to_numpy() for _, t in sorted(zip(rows, tensors, strict=True), key=lambda x: key(x[0]))]
    got = sorted(zip(read.drop(["logmel"]).to_pylist(), read["logmel"].combine_chunks().to_numpy_ndarray(), strict=True), key=lambda x: key(x[0]))
    assert all(np.array_equal(g, w) for (_, g), w in zip(got, want, strict=True))


def test_rows_of_clips_by_plain_loops(spark):
    """The whole query: frames in chunks, what is filled, time spans, and segments by a loop over the frames."""
    rng = np.random.default_rng(6)
    texts = ["".join(map(chr, rng.integers(48, 58, 9000))) + "".join(rng.choice(list("!~"), 9000)) + "0" * 4000, "x" * 30, "".join(map(chr, rng.integers(32, 127, 700))), "", None]
    rows = defaultdict(list)
    for r in media_audio.audio_features(docs_of(spark, texts), "text").orderBy("doc_id", "chunk").collect():
        rows[r.doc_id].append(r)
    assert set(rows) == {0, 1, 2}
    m = media_audio
    for k, own in rows.items():
        data = np.frombuffer(texts[k].encode(), np.uint8)
        y, first, count = m.resample(data, np.array([0, len(data)]))
        clip, frames = y[first[0] : first[0] + count[0]], []
        for at in range(0, max(1, count[0] - m.FRAME + m.HOP), m.HOP):
            frame = np.zeros(m.FRAME, np.float32)
            frame[: len(clip[at : at + m.FRAME])] = clip[at : at + m.FRAME]
            frames.append(frame)
        mel = m.log_mel(np.array(frames))
        energy = [np.float32(10 * np.log10(max(float(np.square(f).mean()), m.LOG_FLOOR))) for f in frames]
        ranked = sorted(energy)
        quiet, loud = ranked[(len(frames) - 1) // 10], ranked[(len(frames) - 1) * 95 // 100]
        even = loud - quiet < m.EVEN_DB
        up = m.SILENCE_DB if even else max(quiet + np.float32(m.UPPER) * (loud - quiet), m.SILENCE_DB)
        low = m.SILENCE_DB if even else quiet + np.float32(m.LOWER) * (loud - quiet)
        on, runs, begin = False, [], None
        for i, e in enumerate([*energy, np.float32(-np.inf)]):
            was, on = on, i < len(energy) and (e >= up or (on and e >= low))
            if on and not was:
                begin = i
            if was and not on and i - begin >= min(m.LEAST, len(frames)):
                runs.append((begin, i - 1))
        seconds = count[0] / m.RATE
        assert len(own) == math.ceil(len(frames) / m.CHUNK)
        for c, r in enumerate(own):
            part = mel[c * m.CHUNK : (c + 1) * m.CHUNK]
            tensor = np.zeros((m.CHUNK, m.MELS), np.float32)
            tensor[: len(part)] = part
            assert r.chunk == c and r.n_frames == len(part) and np.allclose(np.maximum(m.values_of(pa.array([bytes(r.logmel)]))[0], -10), np.maximum(tensor, -10), atol=5e-2)
            assert abs(r.start_s - c * m.CHUNK * m.HOP / m.RATE) < 1e-9
            assert abs(r.end_s - min(((c * m.CHUNK + len(part) - 1) * m.HOP + m.FRAME) / m.RATE, seconds)) < 1e-9
            want = [(a * m.HOP / m.RATE, min((b * m.HOP + m.FRAME) / m.RATE, seconds)) for a, b in runs if c * m.CHUNK <= a < (c + 1) * m.CHUNK]
            assert np.allclose([tuple(s) for s in r.segments], want) if want else not r.segments
    assert any(r.segments for r in rows[0]) and len(rows[0]) > 2


# Chat


def test_chat_machine(spark):
    turns = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "ho"), (1, 1, "assistant", "ho"),
        (2, 0, "user", "a"), (2, 1, "user", "b"), (3, 0, "user", "a"), (4, None, "user", "a"), (5, 0, "user", "a"), (5, 0, "assistant", "b"), (6, 0, None, "a"), (None, 0, "user", "a"), (7, 0, "user", None), (7, 1, "assistant", ""),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    rows = sorted(chat_format.chat_segments(df).collect(), key=lambda r: (r.conv_id, r.segment))
    said = "".join(r.text for r in rows if r.conv_id == 1)
    assert said == "<|begin|><|user|>\nhi\n<|assistant|>\nho<|stop|>\n<|end|>"
    assert "".join(r.text for r in rows if r.conv_id == 1 and r.loss) == "ho<|stop|>\n<|end|>"
    assert {r.conv_id: (r.error, r.turn, r.role) for r in rows if r.error} == {2: ("order", 1, "user"), 3: ("unfinished", 0, "user"), 4: ("null_turn", None, None), 5: ("repeated_turn", 0, None), 6: ("order", 0, None)}
    assert [r.segment for r in rows if r.conv_id == 7] == list(range(8))
    with pytest.raises(ValueError, match="without pieces"):
        chat_format.check_template({**chat_format.TEMPLATE, "roles": {}})
