"""Codes, errors and codebooks against plain whole-number arithmetic and the SQL form."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from corpus_fixtures import SF, table  # noqa: F401

from tillwright.llm import adaptive_codes

SCHEMA = "vec_id long, embedding array<double>, label int, near string, low string, code string, n long, group string"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(*row, "x", "y", "z", 1, "g") for row in rows], schema)


def plain(rows, entries=64, parts=16, rounds=2, scale=256):
    """Every distance of every part to every entry, in Python's integers."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    lengths = [len(r[1]) for r in rows if r[1] and len(r[1]) % parts == 0]
    size = max(set(lengths), key=lambda n: (lengths.count(n), -n))
    rows = [(i, [math.floor(int(x) * scale if abs(x) > 2**60 else x * scale) for x in v], label) for i, v, label in rows if len(v) == size]
    w = size // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for _, v, _ in rows]
    seeds = sorted((i, v) for i, v, _ in rows if i is not None)[:entries]
    books = [[v[p * w : (p + 1) * w] for _, v in seeds] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        found = [[nearest(c[p], books[p])[1] for p in range(parts)] for c in cut]
        new = []
        for p in range(parts):
            book = []
            for k, entry in enumerate(books[p]):
                mine = [c[p] for c, f in zip(cut, found, strict=True) if f[p] == k]
                book.append([sum(x) // len(mine) for x in zip(*mine, strict=True)] if mine else entry)
            new.append(book)
        books = new
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    last = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in last]
    sums = {}
    for (_, _, label), error in zip(rows, errors, strict=True):
        sums[label] = sums.get(label, 0) + error
    fits = lambda x: x if x < 2**63 else None
    return sorted(
        ((i, "".join(f"{k:02x}" for _, k in f), fits(e), fits(sums[label]), digest) for (i, _, label), f, e in zip(rows, last, errors, strict=True)), key=str
    )


def ours(df, **more):
    return sorted((tuple(r) for r in adaptive_codes.compress(df, **more).collect()), key=str)


def test_given_vectors_in_sql(spark, table):
    got = ours(table("embeddings"))
    want = duckdb.sql(adaptive_codes.ORACLE.replace("FROM embeddings", f"FROM '{SF}/embeddings.parquet'")).fetchall()
    assert got == sorted(want, key=str) and len(got) > 0


def test_given_vectors_in_plain_python(table):
    rows = [(r.vec_id, r.embedding, r.label) for r in table("embeddings").collect()][:150]
    df = table("embeddings").where(f"vec_id in ({', '.join(str(r[0]) for r in rows)})")
    assert ours(df) == plain(rows) and ours(df, entries=20, parts=8, rounds=4) == plain(rows, 20, 8, 4)


@pytest.mark.parametrize("seed", range(4))
def test_small_numbers_with_many_ties(spark, seed):
    rng = random.Random(seed)
    rows = [(i, [rng.randint(-2, 2) / 256 for _ in range(16 * (1 + seed % 3))], rng.choice([None, 1, 2])) for i in range(180)]
    assert ours(frame(spark, rows)) == plain(rows)


def test_odd_rows(spark):
    inf, nan = math.inf, math.nan
    good = [(i, [float((i * j) % 7) / 3 for j in range(16)], i % 3 or None) for i in range(40)]
    odd = [(100, None, 1), (101, [], 1), (102, [None] + [0.0] * 15, 1), (103, [nan] + [0.0] * 15, 1), (104, [inf] + [0.0] * 15, 1), (105, [-inf] * 16, 1),
           (106, [1.0] * 15, 1), (107, [1.0] * 32, 1), (None, [0.5] * 16, None), (7, good[7][1], 1), (7, [9.0] * 16, 5)]
    rows = good + odd
    got = ours(frame(spark, rows))
    assert got == plain(rows) and len(got) == 43
    assert ours(frame(spark, [])) == [] and ours(frame(spark, odd[:6])) == [] and ours(frame(spark, [(None, [0.0] * 16, 1)])) == []
    assert ours(frame(spark, good[:1])) == plain(good[:1])


def test_numbers_of_any_size(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([1.5, -3.25, 2.0**30, -1e15, 3e38, 1e300][: 2 + i % 5]) * rng.random() for _ in range(16)], i % 4) for i in range(60)]
    got = ours(frame(spark, rows), entries=8)
    assert got == plain(rows, 8) and any(r[2] is None for r in got) and any(r[2] is not None for r in got)


def test_rare_labels_are_joined_by_shuffle(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, [rng.random() for _ in range(16)], rng.choice([None, 1, 1, 1, 2, i])) for i in range(120)]
    monkeypatch.setattr(adaptive_codes, "LABELS", 3)
    assert ours(frame(spark, rows)) == plain(rows)
    monkeypatch.setattr(adaptive_codes, "LABELS", 0)
    assert ours(frame(spark, rows)) == plain(rows)


def test_bounds_hold_and_spare_work():
    """After entries move, no bound exceeds a true distance, and most parts need no other entry."""
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 60, (40, 32))
    vectors = np.floor(centres[rng.integers(0, 40, 3000)] + rng.normal(0, 6, (3000, 32)))
    books = adaptive_codes.Codebooks([vectors[:64, p * 8 : p * 8 + 8].astype(int).tolist() for p in range(4)])
    found = adaptive_codes.assign(vectors, books, None)
    for _ in range(3):
        near, low = adaptive_codes._narrowed(found, first=True)
        shift = rng.integers(-1, 2, (4, 64, 8))
        entries = [[[x + int(d) for x, d in zip(e, m, strict=True)] for e, m in zip(part, move, strict=True)] for part, move in zip(books.entries, shift, strict=True)]
        books = adaptive_codes.Codebooks(entries, books)
        found = adaptive_codes.assign(vectors, books, (near, low))
        full = adaptive_codes.assign(vectors, books, None)
        assert (found.near[:, :, 0] == full.near[:, :, 0]).all() and (found.squares == full.squares).all()
        for p in range(4):
            gaps = vectors[:, None, p * 8 : p * 8 + 8] - np.array(books.entries[p])[None]
            true = np.sqrt((gaps**2).sum(2))
            tracked = np.take_along_axis(true, found.near[:, p].astype(int), 1)
            assert (found.low[:, p, :-1] <= tracked[:, 1:] + 1e-9).all()
            np.put_along_axis(true, found.near[:, p].astype(int), np.inf, 1)
            assert (found.low[:, p, -1] <= true.min(1) + 1e-9).all()
    assert (found.needed == 0).mean() > 0.3 and (found.needed < near.shape[2]).mean() > 0.5
    narrow, _ = adaptive_codes._narrowed(found, first=False)
    assert narrow.shape[2] <= near.shape[2]


def test_more_entries_than_two_hex_digits_are_refused(table):
    with pytest.raises(ValueError, match="256"):
        adaptive_codes.compress(table("embeddings"), entries=257)
