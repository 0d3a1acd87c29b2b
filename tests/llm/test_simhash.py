"""Fingerprints and components against plain loops."""

import random

import pytest
import xxhash

from corpus_fixtures import make_docs, table  # noqa: F401

from tillwright.llm import simhash
from tillwright.llm.components import connected_components


def plain_fingerprint(text):
    words = []
    for word in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" "):
        words += [word] if word else []
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """Smallest id reachable, by flooding."""
    ids, done = sorted(fps), {}
    for start in ids:
        if start in done:
            continue
        todo = [start]
        done[start] = start
        while todo:
            here = todo.pop()
            for other in ids:
                if other not in done and (fps[here] ^ fps[other]).bit_count() <= 3:
                    done[other] = start
                    todo.append(other)
    return done


def test_documents_against_flooding(table):
    docs = table("documents")
    fps = {r.doc_id: plain_fingerprint(r.text) for r in docs.collect()}
    want = plain_components(fps)
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (fps[i], want[i]) for i in fps}


@pytest.mark.parametrize("hot", [5, 10_000])
def test_links_against_all_pairs(spark, hot):
    rng = random.Random(1)
    centres = [rng.getrandbits(64) for _ in range(3)]
    found = set(centres) | {0, 2**64 - 1}
    for centre in centres:
        for _ in range(150):
            flips = rng.sample(range(64), rng.randint(1, 5))
            found.add(centre ^ sum(1 << b for b in flips))
    signed = {f - (1 << 64) if f >> 63 else f for f in found}
    pairs = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), hot_segment=hot).collect()
    got = {tuple(sorted((r.a, r.b))) for r in pairs}
    mask = (1 << 64) - 1
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= 3}
    assert got == want and want


def test_more_bits_than_the_index_finds_are_refused(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([], "fp long"), max_bits=4)


def test_odd_rows(make_docs):
    long_text = " ".join(f"w{i % 977}" for i in range(200_000))
    docs = make_docs([(5, None), (3, ""), (9, " \t\n"), (4, "one"), (7, "ONE"), (1, long_text), (2, long_text), (2, long_text), (None, "one"), (None, None)])
    got = sorted(((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(docs).collect()))
    assert got == [(-1, 3), (-1, 4), (1, 1), (2, 1), (2, 1), (3, 3), (4, 4), (5, 3), (7, 4), (9, 3)]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, -1, 1, 3, 4]


def test_empty_table(make_docs):
    assert simhash.near_duplicates(make_docs([])).collect() == []


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(1000, 1000 + i) for i in range(1, 40)] + [(70, 70), (5, 4)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {i: 1000 for i in range(1000, 1040)}
