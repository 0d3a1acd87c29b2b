"""Ids and bytes against the tiktoken library, merge by merge, and exact round trips."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from corpus_fixtures import make_docs, table  # noqa: F401
from hypothesis import given, settings
from hypothesis import strategies as st

from tillwright.llm import recursive_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
with open(PATH, "rb") as file:
    RANKS = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
THEIRS = tiktoken.Encoding("theirs", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
FILE = recursive_bpe.RankFile.read(PATH)
OURS = recursive_bpe.Merger(FILE)

TRICKY = ["", " ", "\n\n  x\t", "<|endoftext|>", "aaaaaaaaaaaaaaaaaa" * 40, "　  x", "I'll we've don't 'S", "1234567890 12 3", "日本語テキスト😀👩‍👩‍👧",
          "é \u0000 \x1f", "ſt ǅ ª²½Ⅷ٣", " " * 300 + "x", "ÀÖØöøÿ×÷ ñandú'll \x0b x\x85y\xa0 z", "-" * 500, "\r\n\r\n a", "ab" * 3000, "aba" * 999, "привет" * 60]


def unpacked(ids):
    return np.frombuffer(ids, "<u4").tolist()


def agree(texts, tool=OURS):
    found = tool.encode(texts)
    assert [unpacked(ids) for ids, _ in found] == [THEIRS.encode_ordinary(t) for t in texts]
    assert [spelled for _, spelled in found] == [t.encode() for t in texts]
    assert tool.decode([ids for ids, _ in found]) == [t.encode() for t in texts]


def test_tricky_texts():
    agree(TRICKY)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("  \n'stthe")), max_size=60), max_size=4))
def test_any_text(texts):
    agree(texts)


@pytest.mark.parametrize("long_word", [3, float("inf")])
def test_either_query_merges_as_the_library(long_word):
    """Many pairs a step and one pair a step give what merging one pair after the other gives."""
    tool, rng = recursive_bpe.Merger(FILE), random.Random(3)
    tool.long_word = long_word
    letters = ["e", "n", "t", "h", "a", "i", "o", "r", "é", "я", "の", "ab", "the"]
    words = ["".join(rng.choices(letters[: rng.randint(1, 13)], k=rng.randint(1, 80))) for _ in range(400)]
    agree([*words, "x" * 400], tool)


def test_one_merge_a_token_is_enough():
    """Whatever other pairs make a token, the merge table without them is complete."""
    assert FILE.steady and len(FILE.merges) == len(RANKS) - 256


def test_unsteady_files_merge_one_pair_a_step(tmp_path):
    """Here a merge allows one of lower rank: abc is older than ab, and no other way leads to it."""
    spelled = [bytes([b]) for b in range(256)] + [b"abc", b"ab", b"xabc", b"cd", b"aabc"]
    path = tmp_path / "odd.tiktoken"
    path.write_text("".join(f"{base64.b64encode(t).decode()} {i}\n" for i, t in enumerate(spelled)))
    file = recursive_bpe.RankFile.read(str(path))
    assert not file.steady
    theirs = tiktoken.Encoding("odd", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(spelled)}, special_tokens={})
    rng = random.Random(1)
    texts = ["".join(rng.choices("abcdx", k=rng.randint(1, 70))) for _ in range(100)]
    assert [unpacked(ids) for ids, _ in recursive_bpe.Merger(file).encode(texts)] == [theirs.encode_ordinary(t) for t in texts]


def test_files_without_single_bytes_are_refused(tmp_path):
    path = tmp_path / "short.tiktoken"
    path.write_text("YQ== 0\n")
    with pytest.raises(ValueError, match="255 single bytes"):
        recursive_bpe.RankFile.read(str(path))


def test_documents(table):
    docs = table("documents")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in recursive_bpe.token_digests(docs, PATH).collect()}
    assert len(got) == docs.count()
    for row in docs.collect():
        ids = THEIRS.encode_ordinary(row.text or "")
        text = hashlib.sha256(THEIRS.decode_bytes(ids)).hexdigest()
        assert got[row.doc_id] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), text)


def test_decoding_what_was_encoded(table):
    docs = table("documents")
    back = recursive_bpe.decode_documents(recursive_bpe.encode_documents(docs, PATH), PATH)
    assert back.selectExpr("doc_id", "decode(decoded, 'UTF-8') as text").exceptAll(docs.selectExpr("doc_id", "coalesce(text, '') as text")).count() == 0
    assert back.count() == docs.count()


def test_odd_rows(make_docs):
    docs = make_docs([(1, None), (2, ""), (None, "a"), (3, "ab" * 50_000), (3, "ab" * 50_000)], extra=("ids", "n_tokens", "word", "place", "decoded"))
    rows = recursive_bpe.token_digests(docs, PATH).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert [(r.doc_id, r.n_tokens) for r in rows[:3]] == [(1, 0), (2, 0), (None, 1)]
    assert rows[0].ids_sha256 == rows[0].decoded_sha256 == empty and rows[3] == rows[4]
    assert rows[3].decoded_sha256 == hashlib.sha256(b"ab" * 50_000).hexdigest()
    assert recursive_bpe.token_digests(make_docs([]), PATH).collect() == []
    assert recursive_bpe.decode_documents(make_docs([]).selectExpr("doc_id", "cast(null as binary) as ids"), PATH).collect() == []


def test_slices_and_forgetting_change_nothing(monkeypatch):
    monkeypatch.setattr(recursive_bpe, "REMEMBERED_WORDS", 3)
    monkeypatch.setattr(recursive_bpe, "QUERY_BYTES", 9)
    monkeypatch.setattr(recursive_bpe, "QUERY_TOKENS", 2)
    tool = recursive_bpe.Merger(FILE)
    for i in range(10):
        agree([f"wordy{i} othersome{i % 3} " + "zq" * 30, "", "x"], tool)
    assert list(recursive_bpe._parts([3, 4, 1, 9, 2], lambda n: n, 5)) == [[3], [4, 1], [9], [2]]
