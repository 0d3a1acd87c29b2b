"""Groups, links and their counts against plain walks over both libraries' tokens."""

import bisect
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from corpus_fixtures import make_docs, table  # noqa: F401
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tillwright.llm import token_alignment

PATH_A, PATH_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
A = Tokenizer.from_file(PATH_A)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=PATH_B)
LETTERS = {v: k for k, v in token_alignment.Vocabulary(PATH_A).id_of.items()}
with open(PATH_B, "rb") as file:
    MODEL = file.read()


def piece_bytes(i):
    piece = B.id_to_piece(i)
    return bytes.fromhex(piece[3:5]) if piece.startswith("<0x") and piece.endswith(">") and len(piece) == 6 else piece.replace("▁", " ").encode()


def spans(tokens):
    found, at = [], 0
    for i, spelled in tokens:
        found.append((i, at, at + len(spelled)))
        at += len(spelled)
    return found


def plain(text):
    """Tokens of either side with their places, or nothing."""
    whole = (" " + (text or "")).encode()
    if not text:
        return [], []
    a = [(i, LETTERS[i]) for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, piece_bytes(i)) for i in B.encode(text)]
    if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
        return [], []
    return spans(a), spans(b)


def plain_links(a, b):
    """Every pair of tokens whose places overlap, by a walk over both sides."""
    found, first = [], 0
    for x, s, e in a:
        while first < len(b) and b[first][2] <= s:
            first += 1
        at = first
        while at < len(b) and b[at][1] < e:
            found.append((x, b[at][0]))
            at += 1
    return found


def plain_rows(docs):
    """The contract read literally, over (doc_id, text) pairs."""
    sides = [plain(text) for _, text in docs]
    links = [plain_links(a, b) for a, b in sides]
    count = Counter(pair for found in links for pair in set(found))
    most = {}
    for (x, _), n in count.items():
        most[x] = max(most.get(x, 0), n)
    rows = []
    for (doc_id, _), (a, b), found in zip(docs, sides, links, strict=True):
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        group = [{c: [] for c in cuts} for _ in "ab"]
        for side, of in zip((a, b), group, strict=True):
            for i, _, e in side:
                of[cuts[bisect.bisect_left(cuts, e)]].append(str(i))
        parts = [",".join(group[0][c]) + "|" + ",".join(group[1][c]) for c in cuts]
        digest = hashlib.sha256(";".join(parts).encode()).hexdigest() if a else ""
        best = sum(count[p] == most[p[0]] for p in found)
        rows.append((doc_id, len(a), len(b), len(cuts), len(found), best, sum(count[p] for p in found), digest))
    return sorted(rows, key=str)


def ours(docs):
    return sorted((tuple(r) for r in token_alignment.link_documents(docs, PATH_A, PATH_B).collect()), key=str)


TRICKY = ["x", " ", "  a", "a  b   c ", "\n\n x\t y", "a\n  b", "a▁ b", "▁", "<s> <|endoftext|> <unk> </s>", "日本語テキスト😀👩‍👩‍👧 é", "é ﬁ ½ ＡＢ", "a  b  c\x1f d\x85 e",
          "\u0000 ﻿​ z", "x" * 500, "ab " * 200, "won't'd I'll", "\r\n\r\n a", "привет мир 12345", "a \n b \r\n  c", "<0x41> <0x0A>"]


SIDES = token_alignment.ByteSide(PATH_A), token_alignment.PieceSide(MODEL)
TOOL = token_alignment.Aligner(*SIDES)


def one_by_one(texts):
    for text, (sizes, links, groups) in zip(texts, TOOL.documents(texts), strict=True):
        a, b = plain(text)
        found = Counter((x, y) for x, s, e in a for y, t, f in b if s < f and t < e)
        packed = np.frombuffer(links, "<u8").tolist()
        assert Counter((p >> 32, p & 0xFFFFFFFF) for p in packed) == found, text
        assert sizes[:2] == (len(a), len(b)) and sizes[2] == (groups.count("|"))


def test_tricky_texts():
    one_by_one(TRICKY)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("  \n\t'▁the")), max_size=50), max_size=4))
def test_any_text(texts):
    one_by_one(texts)


def test_documents(table):
    docs = table("documents").orderBy("doc_id").limit(60)
    assert ours(docs) == plain_rows([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(make_docs):
    pairs = [(1, None), (2, ""), (None, "a b"), (3, "a b"), (3, "a b"), (4, "a▁b"), (5, "b a " * 400), *[(10 + i, t) for i, t in enumerate(TRICKY)]]
    docs = make_docs(pairs, extra=("row", "links", "n", "n_a", "best"))
    assert ours(docs) == plain_rows(pairs)
    assert ours(make_docs([])) == [] and ours(make_docs([(1, None), (2, "")])) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


@pytest.mark.parametrize("sent", [0, 30])
def test_rare_links_are_joined_by_shuffle(make_docs, monkeypatch, sent):
    rng = random.Random(4)
    words = ["the", "hand", "of", "naïve", "qzx", "tokenization", "12345"]
    pairs = [(i, " ".join(rng.choices(words[: 2 + i % 6], k=rng.randint(0, 30)))) for i in range(60)]
    monkeypatch.setattr(token_alignment, "SENT_LINKS", sent)
    assert ours(make_docs(pairs)) == plain_rows(pairs)


def test_slices_and_forgetting_change_nothing(make_docs, monkeypatch):
    rng = random.Random(5)
    tool = token_alignment.Aligner(*SIDES)
    texts = ["".join(rng.choices("ab é\n", k=rng.randint(0, 40))) for _ in range(60)]
    whole = tool.documents(texts)
    monkeypatch.setattr(token_alignment, "REMEMBERED", 5)
    monkeypatch.setattr(token_alignment, "SLICE_CHARS", 60)
    again = [found for part in token_alignment._slices(texts) for found in tool.documents(part)]
    assert again == whole and len(tool.number) < 40
    monkeypatch.setattr(token_alignment, "REMEMBERED", 40)
    again = [found for part in token_alignment._slices(texts * 2) for found in tool.documents(part)]
    assert again == whole * 2
    monkeypatch.setattr(token_alignment, "LINKS_AT_ONCE", 7)
    monkeypatch.setattr(token_alignment, "REMEMBERED_LINKS", 5)
    docs = list(enumerate(texts))
    rows = token_alignment._link_counts(token_alignment._aligned(make_docs(docs), PATH_A, PATH_B)).collect()
    want = Counter(pair for text in texts for pair in {(x, y) for x, s, e in plain(text)[0] for y, t, f in plain(text)[1] if s < f and t < e})
    assert {(r.link >> 32, r.link & 0xFFFFFFFF): r.n for r in rows} == want and len(rows) == len(want)
