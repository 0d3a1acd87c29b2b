"""Alignments against a cell-by-cell loop, leaks against substring search and edited copies."""

import random

import numpy as np
import pytest
from corpus_fixtures import make_docs, table  # noqa: F401

from tillwright.llm import decontaminate as dc


def plain_score(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 2, h[i][j - 1] - 2)
    return max(map(max, h))


def test_alignment_scores():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.randint(1, 4) for _ in range(rng.randint(0, 12))] for _ in range(2))
        assert dc.align(np.array(a, int), np.array(b, int))[0] == plain_score(a, b)


def test_whole_table_against_substrings(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    flat = lambda t: f" {' '.join(dc.words_of(t))} "
    known = [(r.item_id, flat(r.text)) for r in items.collect()]
    texts = {r.doc_id: flat(r.text) for r in docs.collect()}
    want = {(d, i) for d, t in texts.items() for i, p in known if p in t}
    rows = dc.contaminated(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in rows if r.share == 1} == want and want
    assert {r.doc_id for r in rows} == {d for d, _ in want}
    assert dc.keep_clean(docs, items).count() == len(texts) - len({d for d, _ in want})


ITEM = " ".join(f"w{i}" for i in range(30))


def edited(step):
    return " ".join("zz" if i % step == 2 else f"w{i}" for i in range(30))


@pytest.mark.parametrize("block", [1_000_000, 40])
def test_edited_copies(spark, make_docs, monkeypatch, block):
    monkeypatch.setattr(dc, "BLOCK_WORDS", block)
    items = spark.createDataFrame([(1, ITEM), (2, "a b"), (3, None), (4, " ".join(f"q{i}" for i in range(50))), (None, None)], "item_id long, text string")
    shared = " ".join(f"q{i}" for i in range(5, 20))
    docs = make_docs([
        (1, f"x y {ITEM.upper()}!!"), (2, f"p {edited(7)} r"), (3, ITEM.replace(" ", " ### ")), (4, shared), (5, "w1 w2 w3 then nothing a b"),
        (6, None), (7, ""), (8, "lead " * 50_000 + ITEM), (None, ITEM), (1, f"x y {ITEM.upper()}!!"),
        (9, ITEM.replace("w9 ", "w9 in between ").replace("w20 ", "")), (10, " ".join(["w1 w2 w3"] * 20_000)),
    ])
    got = sorted((r.doc_id or -1, r.item_id) for r in dc.contaminated(docs, items).collect())
    assert got == [(-1, 1), (1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (8, 1), (9, 1)]
    assert sorted(r.doc_id for r in dc.keep_clean(docs, items).collect()) == [5, 6, 7, 10]
    assert dc.keep_clean(docs, items).columns == docs.columns
    spans = {r.doc_id: (r.start, r.end) for r in dc.contaminated(docs, items).collect()}
    assert spans[1] == (4, 4 + len(ITEM)) and spans[8] == (250_000, 250_000 + len(ITEM))


def test_a_leak_in_most_documents_is_still_found(spark, make_docs):
    docs = make_docs([(i, f"d{i} e{i} {ITEM}" if i % 3 else f"d{i}") for i in range(60)])
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert dc.contaminated(docs, items).count() == 40


def test_empty_tables(spark, make_docs):
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert dc.contaminated(make_docs([]), items).count() == 0
    assert dc.contaminated(make_docs([(1, ITEM)]), items.limit(0)).count() == 0
    assert dc.keep_clean(make_docs([(1, ITEM)]), items.limit(0)).count() == 1


def plainly_held(item, text):
    a, b = dc.words_of(item), dc.words_of(text)
    score = plain_score(a, b)
    return score >= 2 * dc.MIN_WORDS or score / (2 * len(a)) >= dc.MIN_SHARE


@pytest.mark.parametrize("copies", [0, 1, 3])
def test_edits_every_few_words_against_all_pairs(spark, make_docs, copies):
    rng = random.Random(8)
    common = [f"c{i}" for i in range(12)]
    items = [" ".join(rng.choice(common) if rng.random() < 0.4 else f"i{n}x{k}" for k in range(size)) for n, size in enumerate((15, 20, 27, 40, 60))]
    change = {
        "replaced": lambda w, k, step: "zz" if k % step == step - 1 else w,
        "left out": lambda w, k, step: None if k % step == step - 1 else w,
        "put in": lambda w, k, step: f"{w} zz" if k % step == step - 1 else w,
    }
    texts = [t for t in items for _ in range(copies)]
    for item in items:
        for step in (2, 3, 4, 5, 6):
            for edit in change.values():
                words = [edit(w, k, step) for k, w in enumerate(item.split())]
                noise = [rng.choice(common) for _ in range(30)]
                texts.append(" ".join([*noise, *filter(None, words), *noise[::-1]]))
    texts += [" ".join(rng.choice(common) for _ in range(100)) for _ in range(5)]
    want = {(d, i) for d, t in enumerate(texts) for i, item in enumerate(items) if plainly_held(item, t)}
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = dc.contaminated(make_docs(list(enumerate(texts))), table).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want and len(want) > 50


def test_pairs_that_are_left_out_lose_nothing():
    rng = random.Random(4)
    for _ in range(60):
        items = [" ".join(f"v{rng.randint(1, 9)}" for _ in range(rng.randint(14, 30))) for _ in range(3)]
        texts = [" ".join(f"v{rng.randint(1, 12)}" for _ in range(40)) for _ in range(6)]
        texts += [" ".join(w for w in items[0].split() if rng.random() < 0.8) for _ in range(2)]
        block = dc.Items(list(enumerate(items)))
        pairs = [dc.np.unique(block.codes(block.numbered(dc.words_of(t)))) for t in texts]
        seeds = dc.Seeds(block, {c: n for c in block.known.tolist() if (n := sum(c in p for p in pairs))})
        for text in texts:
            assert {i for i, *_ in seeds.find(text)} == {i for i, item in enumerate(items) if plainly_held(item, text)}


def test_short_items_must_be_there_whole(spark, make_docs):
    items = [(1, "What is the capital of France"), (2, "one two three four five six seven eight nine ten"), (3, "Lake Baikal"), (4, "Yes"), (5, "red green blue")]
    docs = make_docs([
        (1, "tell me what is the time"), (2, "he asked: what is the capital of France?"), (3, "what is the capital of Spain"),
        (4, "one two three four five six"), (5, "so one two three four five six seven then"), (6, "one two three zz four five six seven eight"),
        (7, "seen at lake baikal in may. yes, and cold"), (8, "Answer:\nLake  Baikal\nmore"), (9, "so? YES!"), (10, "red green"), (11, "a red, green, blue flag"),
    ])
    table = spark.createDataFrame(items, "item_id long, text string")
    rows = dc.contaminated(docs, table).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(2, 1), (5, 2), (6, 2), (8, 3), (9, 4), (11, 5)}
    assert {r.doc_id: (r.start, r.end) for r in rows}[8] == (8, 20)
    assert sorted(r.doc_id for r in dc.keep_clean(docs, table).collect()) == [1, 3, 4, 7, 10]


def test_scripts_without_spaces_are_cut_into_characters(spark, make_docs):
    chinese, japanese = "水在标准大气压下的沸点是一百摄氏度", "日本で一番高い山は富士山です"
    docs = make_docs([
        (1, f"问题：{chinese}。答案"), (2, chinese.replace("标准", "通常")), (3, "水在山上的时候很冷"), (4, f"昔々、{japanese}よ"), (5, "富士山は高い"), (6, "plain words"),
    ])
    table = spark.createDataFrame([(1, chinese), (2, japanese)], "item_id long, text string")
    rows = dc.contaminated(docs, table).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(1, 1), (2, 1), (4, 2)}
    assert {r.doc_id: (r.start, r.end) for r in rows}[1] == (3, 3 + len(chinese))
    assert dc.words_of("東京tower 42、ﾄｳ") == ["東", "京", "tower", "42", "ﾄ", "ｳ"]


def test_texts_are_searched_without_making_their_words(monkeypatch):
    rng = random.Random(6)
    texts = ["", "_", "İstanbul Straße é_é d’un ΟΣ á ก่", f"x {ITEM} été", f"{ITEM.upper()}—w1", "東京tower w1"]
    texts += ["".join(rng.choice("ab_1 .\né’東่　") for _ in range(80)) for _ in range(200)]
    items = dc.Items([(1, ITEM), *enumerate(texts[2:60], 10)])
    want = [items.numbered(dc.words_of(t)).tolist() for t in texts]
    seeds = dc.Seeds(items, dict.fromkeys(items.known.tolist(), 1))

    def fail(text):
        raise AssertionError(text)

    for together in (1, 300, 300_000):
        monkeypatch.setattr(dc, "TOGETHER", together)
        monkeypatch.setattr(dc, "words_of", fail)
        found = seeds.find_all([*texts, None])
        assert [items.numbers_of(t).tolist() for t in texts] == want
        assert [n for n, held in enumerate(found) if any(i == 1 for i, *_ in held)] == [3, 4]
        monkeypatch.undo()
        assert found == [seeds.find(t) for t in [*texts, None]] and all(any(i == n + 8 for i, *_ in found[n]) for n in range(3, 6))
