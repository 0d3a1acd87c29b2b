"""Base spans against regular expressions in a loop; added spans against counted disclosures."""

import hashlib
import math
import re

import pytest
from corpus_fixtures import make_docs, table  # noqa: F401
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tillwright.llm import pii


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_base(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    rules = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.group().split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    ]
    found = [(m.start(), k, m.end()) for k, (p, ok) in enumerate(rules) for m in re.finditer(p, text or "") if ok(m)]
    return [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found)]


def check(docs):
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    rows = pii.personal_data(docs).collect()
    assert sorted((r.doc_id or 0, r.base_sha256) for r in rows) == sorted((i or 0, hashlib.sha256(",".join(plain_base(t)).encode()).hexdigest()) for i, t in texts)
    return rows


def test_counts_by_kind(make_docs):
    texts = ["a@b.co", "10.0.0.1", "4111111111111111", "+1 555 123 4567", "a@b.co c@d.co, 10.0.0.1 10.0.0.2 10.0.0.3; +1 555 123 4567; 4111 1111 1111 1111", "", None]
    rows = pii.personal_data(make_docs(list(enumerate(texts)))).collect()
    got = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone) for r in rows}
    assert got == {0: (1, 0, 0, 0), 1: (0, 1, 0, 0), 2: (0, 0, 1, 0), 3: (0, 0, 0, 1), 4: (2, 3, 1, 1), 5: (0, 0, 0, 0), 6: (0, 0, 0, 0)}


TRICKY = [
    "a@b.c_d@e.f a@b.c@d.e x@y.z. q@w..e @a.b a@b", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.000.255 1.2.3 4.5.6.7 00000.0.0.0 1.2.3.400",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111112 41111111111111114111111111111111", "+1 (555) 123-4567 +49 30 1234567. +1 +12345678901234567 +1-2",
    "é😀 a@b.co +1 555 123 4567 😀 10.0.0.1", "a." * 3_000 + "@b" + ".c" * 3_000, "1 " * 20_000, "x" * 50_000 + "@y.z", None, "", "1.1.1.1+1.1.1.1.1.1.1.1.1.1",
]


def test_tricky_texts(make_docs):
    check(make_docs(list(enumerate(TRICKY)) + [(None, "a@b.c"), (1, "a@b.c"), (1, "a@b.c")]))


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text(alphabet="a1+.@- ()_é4", max_size=40), min_size=30, max_size=60))
def test_any_text(texts):
    from tillwright.session import local_session

    spark = local_session()
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_documents(table):
    rows = check(table("documents"))
    assert sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows) > 0


def test_disclosing_words(make_docs):
    mail = "jo@mail.example"
    docs = [(i, f"the chief astronomer writes from {mail} often") for i in range(4)] + [(9, "the chief cook writes often")]
    docs += [(20 + i, "the cook writes often " * 3) for i in range(40)] + [(70, f"astronomer {'x ' * 60} {mail}")]
    rows = {r.doc_id: r for r in check(make_docs(docs))}
    # Counts by hand: astronomer is near the address in 4 documents and in 5 in all; chief in 4 of 5.
    n, entity = len(docs), 5
    share = math.log2(4 * n / (entity * 5)) / math.log2(n / entity)
    assert pii.GENERALISE_FROM <= share < pii.REMOVE_FROM
    text = docs[0][1]
    # "chief" and "astronomer" are in one document without the address beside them, "from" is in none.
    added = [s for s in rows[0].spans.split(",") if not s.startswith("email")]
    from_share = math.log2(4 * n / (entity * 4)) / math.log2(n / entity)
    kinds = {"chief": "generalise", "astronomer": "generalise", "from": "remove" if from_share >= pii.REMOVE_FROM else "generalise"}
    assert added == [f"{kind}:{text.index(w)}:{text.index(w) + len(w)}" for w, kind in kinds.items()]
    assert all(not rows[i].spans for i in (9, 20)) and rows[70].spans.startswith("email")
    clean = {r.doc_id: r.text for r in pii.sanitise(make_docs(docs)).collect()}
    assert clean[0].startswith("the [TERM] [TERM] writes ") and "[EMAIL] often" in clean[0] and clean[20] == docs[10][1]


@pytest.mark.parametrize("pairs", [[], [(1, None), (None, None), (2, "")]])
def test_odd_tables(make_docs, pairs):
    docs = make_docs(pairs)
    assert [r.spans for r in pii.personal_data(docs).collect()] == [""] * len(pairs)
    assert pii.sanitise(docs).columns == docs.columns and pii.sanitise(docs).count() == len(pairs)


def test_columns_of_any_name_stay(make_docs):
    names = ("row", "base", "near", "text_", "added", "all_spans", "doc", "DOC_", "start")
    docs = make_docs([(1, "write to jo@mail.example now"), (2, None), (2, None), (3, "")], extra=names)
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns
    got = sorted(map(tuple, clean.collect()), key=str)
    want = [(1, "write to [EMAIL] now"), (2, None), (2, None), (3, "")]
    assert [(r[0], r[1]) for r in got] == want and all(set(r[5:]) == {"x"} for r in got)


def plain_added(docs):
    """Words of whole documents that disclose an entity, counted in a loop: per document (kind, start, end)."""
    texts = [t or "" for _, t in docs]
    base = [[s.split(":") for s in plain_base(t)] for t in texts]
    named = lambda t, k, a, b: (k, re.sub("[^0-9]", "", t[a:b]) if k in ("card", "phone") else t[a:b].lower())
    entities = [{named(t, k, int(a), int(b)) for k, a, b in spans} for t, spans in zip(texts, base, strict=True)]
    words = [{w.lower() for w in re.findall(r"[^\W\d_]+", t)} for t in texts]
    share = {}
    for e in set().union(*entities):
        with_entity = [n for n, found in enumerate(entities) if e in found]
        for w in set().union(*(words[n] for n in with_entity)):
            both, with_term = sum(w in words[n] for n in with_entity), sum(w in ws for ws in words)
            if both >= pii.MIN_SHARED and len(with_entity) < len(texts):
                value = math.log2(both * len(texts) / (len(with_entity) * with_term)) / math.log2(len(texts) / len(with_entity))
                share[w] = max(share.get(w, 0), value)
    kinds = {w: "remove" if s >= pii.REMOVE_FROM else "generalise" for w, s in share.items() if s >= pii.GENERALISE_FROM}
    out = []
    for t, spans in zip(texts, base, strict=True):
        marks = [(kinds.get(m.group().lower()), m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+", t)]
        out.append([m for m in marks if m[0] and not any(m[1] < int(b) and m[2] > int(a) for _, a, b in spans)])
    return out


def test_words_of_whole_documents_are_marked_in_all_documents(make_docs):
    """Words of any length, far from the entity, in documents without it, and more of them than are placed at a time."""
    far = "word " * 400
    docs = [(i, f"Al the astronomer {far} writes from jo@mail.example or +1 555 123 4567") for i in range(4)]
    docs += [(9, f"the ASTRONOMER \U0001f600 {'zebra mail ' * 700} al rests"), (10, "jo al"), (10, "jo al"), (None, "jo; 10.0.0.1"), (None, None), (11, "")]
    docs += [(20 + i, f"the cook writes from {far} here {'and al' if i < 1 else ''}") for i in range(40)]
    rows = pii.personal_data(make_docs(docs), around=None).collect()
    want = [",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted([(int(a), pii.ALL_KINDS.index(k), k, int(b)) for k, a, b in (s.split(":") for s in plain_base(t))] + [(a, pii.ALL_KINDS.index(k), k, b) for k, a, b in added])) for (_, t), added in zip(docs, plain_added(docs), strict=True)]
    assert sorted((str(r.doc_id), r.spans) for r in rows) == sorted((str(i), w) for (i, _), w in zip(docs, want, strict=True))
    clean = {r.doc_id: r.text for r in pii.sanitise(make_docs(docs), around=None).collect()}
    assert "the [TERM] word" in clean[0] and clean[9].startswith("the [TERM] ") and "the cook writes" in clean[25] and clean[11] == ""


def test_the_query_marks_words_of_whole_documents(spark, tmp_path, make_docs):
    from tillwright.llm.catalog import QUERIES

    docs = [(i, f"Zoe {'x ' * 100} jo@mail.example") for i in range(3)] + [(3, "Zoe knows"), *((i, "nobody here") for i in range(4, 30))]
    make_docs(docs).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r.spans for r in QUERIES["op1_pii"](spark, str(tmp_path)).collect()}
    assert rows[0].startswith("generalise:0:3,") and rows[3] == "generalise:0:3" and rows[5] == ""


def test_words_that_touch_the_edge_or_the_entity_are_near(make_docs):
    """Words that begin or end just where the entity does, or where the part looked at does, are whole."""
    text = f"ab lions {'x' * 54}+1 555 123 4567quagga {'y' * 48} gnus end"
    cut = f"a tigers {'v' * 54}+1 555 123 4568jackal {'w' * 48} okapi"
    docs = [(i, [text, cut][i % 2]) for i in range(6)] + [(10 + i, "none of them") for i in range(30)]
    rows = {r.doc_id: r.spans for r in pii.personal_data(make_docs(docs)).collect()}
    got = [[t[int(a) : int(b)] for _, a, b in (s.split(":") for s in rows[i].split(","))] for i, t in enumerate((text, cut))]
    assert got == [["lions", "x" * 54, "+1 555 123 4567", "quagga", "y" * 48, "gnus"], ["v" * 54, "+1 555 123 4568", "jackal", "w" * 48]]


def test_frequent_words_beside_many_entities_disclose_none(make_docs):
    """Entities each of other documents, beside words that stand in all documents."""
    docs = [(i, " ".join(f"u{(i + n) % 90}@mail.example" for n in range(40)) + " common words here") for i in range(90)]
    docs += [(100 + i, "common words here") for i in range(30)]
    docs += [(200 + i, "solo words jo@mail.example") for i in range(3)]
    found = make_docs(docs).select("text", pii.base_spans(F.col("text")).alias("base"))
    gathered = found.select("base", F.array_join(pii._words(F.col("text")), " ").alias("words"), F.monotonically_increasing_id().alias("row"))
    got = {r.term: r.kind for r in pii.disclosing_terms(make_docs(docs), gathered).collect()}
    assert got == {w: len(pii.KINDS) + 1 for w in ("solo", "jo")}
    rows = {r.doc_id: r.spans for r in pii.personal_data(make_docs(docs), around=None).collect()}
    want = dict(zip([i for i, _ in docs], plain_added(docs), strict=True))
    for i, spans in rows.items():
        assert [s for s in spans.split(",") if s[:5] in ("gener", "remov")] == [f"{k}:{a}:{b}" for k, a, b in want[i]]


def test_the_sieve_grows_with_its_terms(spark):
    """All terms pass, however many they are, and next to no others."""
    terms = spark.range(20_000).select(F.concat(F.lit("t"), "id").alias("term"))
    others = spark.range(20_000).select(F.concat(F.lit("o"), "id").alias("term"))
    sieve = F.broadcast(pii._sieve(terms))
    passed = [df.crossJoin(sieve).where(pii._passes(F.col("sieve"), F.col("term"))).count() for df in (terms, others)]
    assert passed[0] == 20_000 and passed[1] < 100
