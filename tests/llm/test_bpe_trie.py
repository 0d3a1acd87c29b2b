"""Ids and texts against the tokenizers library, and exact round trips."""

import hashlib
import random
import struct
import tracemalloc

import public_tokenizers
import pyarrow as pa
import pytest
from corpus_fixtures import make_docs, table  # noqa: F401
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tillwright.llm import bpe_trie

PATH = public_tokenizers.path("byte_bpe_50k.json")
THEIRS = Tokenizer.from_file(PATH)
OURS = bpe_trie.vocabulary(PATH)


def theirs(text):
    return THEIRS.encode(text, add_special_tokens=False).ids


def ours(texts):
    return [list(struct.unpack(f"<{len(p) // 4}I", p)) for p in bpe_trie.encode_texts(OURS, texts, {})]


TRICKY = ["", " ", "\n\n  x\t", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", "aaaaaaaaaaaaaaaaaa" * 40, "　  x", "I'll we've don't 'S",
          "1234567890 12 3", "日本語テキスト😀👩‍👩‍👧", "é \u0000 \x1f", "ſt ǅ ª²½Ⅷ٣", " " * 300 + "x", "ÀÖØöøÿ×÷ ñandú'll it's  \t\r\n  \x0b x\x85y\xa0 z", "don't'd 'sé", "-" * 500, "\r\n\r\n a"]


def test_tricky_texts():
    assert ours(TRICKY) == [theirs(t) for t in TRICKY]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("  \n'stthe<|endoftext|>")), max_size=60), max_size=4))
def test_any_text(texts):
    assert ours(texts) == [theirs(t) for t in texts]
    assert [OURS.decode(struct.pack(f"<{len(i)}I", *i)) for i in ours(texts)] == [THEIRS.decode(theirs(t), skip_special_tokens=False) for t in texts]


def test_documents(table):
    docs = table("documents")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_trie.token_digests(docs, PATH).collect()}
    for row in docs.collect():
        ids = theirs(row.text)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        text = THEIRS.decode(ids, skip_special_tokens=False)
        assert got[row.doc_id] == (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_decoding_what_was_encoded(table):
    docs = table("documents")
    back = bpe_trie.decode_documents(bpe_trie.encode_documents(docs, PATH), PATH)
    assert back.exceptAll(docs.select("doc_id", "text")).count() == 0 and back.count() == docs.count()


def test_odd_rows(make_docs):
    docs = make_docs([(1, None), (2, ""), (None, "a"), (3, "ab" * 100_000), (3, "ab" * 100_000)])
    rows = bpe_trie.token_digests(docs, PATH).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert [(r.doc_id, r.n_tokens) for r in rows[:3]] == [(1, 0), (2, 0), (None, 1)]
    assert rows[0].ids_sha256 == rows[0].decoded_sha256 == empty and rows[3] == rows[4]
    assert rows[3].decoded_sha256 == hashlib.sha256(b"ab" * 100_000).hexdigest()
    assert bpe_trie.token_digests(make_docs([]), PATH).collect() == []


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe_trie, "REMEMBERED_WORDS", 3)
    monkeypatch.setattr(bpe_trie, "SLICE_CHARS", 10)
    texts = [f"word{i} other{i % 3}" for i in range(40)]
    known = {}
    for part in bpe_trie._slices(texts):
        assert len(part) == 1
        (packed,) = bpe_trie.encode_texts(OURS, part, known)
        assert packed == struct.pack(f"<{len(packed) // 4}I", *theirs(part[0]))


def test_a_large_batch_is_not_made_strings_at_once():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 6))) for _ in range(500)]
    texts = [" ".join(rng.choices(words, k=400)) for _ in range(2_000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts})
    want, known = bpe_trie.encode_texts(OURS, texts, {}), 0
    tracemalloc.start()
    try:
        for part in bpe_trie._encoded([batch], PATH, True):
            n = part.num_rows
            assert part.column("doc_id").to_pylist() == list(range(known, known + n))
            assert part.column("ids").to_pylist() == want[known : known + n] and part.column("decoded").to_pylist() == texts[known : known + n]
            known += n
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert known == len(texts) and sum(map(len, texts)) > 3_500_000
    assert peak < 45_000_000  # made at once, the words alone take more


def test_neighbours_stay_apart_as_merging_says():
    rng = random.Random(2)
    common = [t for t in range(256, 4000) if OURS.bytes_of[t] in OURS.standing] + [OURS.id_of[b"a"], OURS.id_of[b"aa"]]
    for _ in range(20_000):
        left, right = rng.choice(common), rng.choice(common)
        assert OURS.fits(left, right) == (OURS.merged(OURS.bytes_of[left] + OURS.bytes_of[right]) == [left, right])


def test_other_models_are_refused():
    with pytest.raises((ValueError, KeyError)):
        bpe_trie.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))
