"""Byte-level BPE, encoded by walking a trie of the distinct words.

A text is cut into words by the vocabulary's pattern. The encoding of a word's prefix is fixed by its
last token: the only vocabulary token that ends there and stays beside the last token of what precedes
it. So the last token is a state of a trie node, passed on depth first, and words that share a prefix
share its states. A word's tokens are read back from its leaf. Distinct words in byte order are the
trie's paths in depth-first order, so the path to the current node is all of the trie kept in memory.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwright.llm.common import text_or_empty

#: Characters handled at a time and words remembered by a task, so that memory is bounded.
SLICE_CHARS = 1_000_000
REMEMBERED_WORDS = 250_000
#: Pairs of tokens whose neighbourhood is remembered.
REMEMBERED_PAIRS = 300_000
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for texts of these characters only, with their letters, digits and white space spelled out.
LATIN = re.compile(r"[\t-\r !-~À-ÖØ-öø-ÿ]*+")
LATIN_WORDS = re.compile(
    r"""'(?:[stmd]|re|ve|ll)| ?[A-Za-zÀ-ÖØ-öø-ÿ]++| ?[0-9]++| ?[^\t-\r A-Za-zÀ-ÖØ-öø-ÿ0-9]++|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]++"""
)


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in vocabulary files: printable bytes are themselves."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens and merges of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        step = spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or model.get("ignore_merges") or model.get("dropout") or spec["normalizer"]:
            raise ValueError("only plain byte-level BPE files are supported")
        if step.get("type") != "ByteLevel" or step.get("add_prefix_space") or not step.get("use_regex", True):
            raise ValueError("only the byte-level pre-tokenizer without a prefix space is supported")
        added = spec["added_tokens"]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
            raise ValueError("added tokens must match their exact text")
        letters, names = _byte_letters(), model["vocab"]
        self.added = {t["content"]: t["id"] for t in added}
        spelled = {i: bytes(letters[c] for c in name) for name, i in names.items() if name not in self.added}
        self.bytes_of = spelled | {i: name.encode() for name, i in self.added.items()}
        self.id_of = {b: i for i, b in spelled.items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = {(names[a], names[b]): (rank, names[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.longest = max(map(len, self.id_of))
        #: The merge that makes each token, and its rank.
        self.parts = {token: (*pair, rank) for pair, (rank, token) in self.merges.items()}
        if len(self.parts) < len(self.merges):
            raise ValueError("a token must have one merge")
        #: Tokens whose bytes encode to themselves; no other token ever occurs.
        self.standing = {b: i for b, i in self.id_of.items() if self.merged(b) == [i]}
        self.packed = {i: np.array([i], "<u4").tobytes() for i in self.bytes_of}
        self.sizes = {i: len(b) for i, b in self.bytes_of.items()}
        self.words = regex.compile(WORDS)
        by_length = sorted(self.added, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, by_length)) + ")") if by_length else None
        self._fits: dict[int, bool] = {}

    def merged(self, piece: bytes) -> list[int]:
        """Tokens of a short piece by merging pairs in order of rank."""
        ids = [self.id_of[piece[i : i + 1]] for i in range(len(piece))]
        while len(ids) > 1:
            ranked = [(self.merges[p][0], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.merges]
            if not ranked:
                break
            _, i = min(ranked)
            ids[i : i + 2] = [self.merges[ids[i], ids[i + 1]][1]]
        return ids

    def fits(self, left: int, right: int) -> bool:
        """Whether two standing tokens stay side by side when their bytes are encoded together.

        The merges at the border are undone from the last to the first. They keep the tokens apart
        unless, before one of them, the two pieces that then meet would have merged; of equal merges
        the one further left is first.
        """
        limit = len(self.merges)
        while True:
            across = self.merges.get((left, right))
            if across and across[0] < limit:
                return False
            a, b = self.parts.get(left), self.parts.get(right)
            if not a and not b:
                return True
            if a and (not b or a[2] > b[2]):
                left, limit = a[1], a[2]
            else:
                right, limit = b[0], b[2] + 1

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Token ids of distinct words, as little-endian unsigned 32-bit integers."""
        found: dict[str, bytes] = {}
        token_of, packed, sizes, fits, longest = self.standing.get, self.packed, self.sizes, self._fits, self.longest
        path, last = b"", [0]  # per byte of the path: the last token
        for spelled, word in sorted((w.encode("utf-8", "surrogatepass"), w) for w in words):
            shared, size = 0, len(spelled)
            for a, b in zip(path, spelled, strict=False):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, size + 1):
                token = token_of(spelled[:end])
                if token is not None:
                    last.append(token)
                    continue
                for start in range(end - 1, max(0, end - longest) - 1, -1):  # one token fits; short ones are likelier
                    token = token_of(spelled[start:end])
                    if token is None:
                        continue
                    pair = last[start] << 32 | token
                    fit = fits.get(pair)
                    if fit is None:
                        if len(fits) >= REMEMBERED_PAIRS:
                            fits.clear()
                        fit = fits[pair] = self.fits(last[start], token)
                    if fit:
                        last.append(token)
                        break
                else:
                    raise ValueError("the vocabulary lacks single bytes")
            ids, end = [], size
            while end:
                ids.append(packed[last[end]])
                end -= sizes[last[end]]
            found[word], path = b"".join(ids[::-1]), spelled
        return found

    def split(self, text: str) -> list[str]:
        """The words and added tokens of a text, in order."""
        if not any(token in text for token in self.added):
            return self._plain_words(text)
        parts: list[str] = []
        for part in self.cut.split(text):
            parts += [part] if part in self.added else self._plain_words(part)
        return parts

    def _plain_words(self, text: str) -> list[str]:
        return (LATIN_WORDS if LATIN.fullmatch(text) else self.words).findall(text)

    def decode(self, packed: bytes) -> str:
        spell = self.bytes_of
        return b"".join([spell[i] for i in np.frombuffer(packed, "<u4").tolist()]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, loaded once by each worker."""
    return Vocabulary(path)


def encode_texts(vocab: Vocabulary, texts: Iterable[str], known: dict[str, bytes]) -> list[bytes]:
    """Packed ids of each text; ``known`` holds words met before, or only these texts' if it is full."""
    split = [vocab.split(text) for text in texts]
    distinct = set().union(*split)
    new = distinct - known.keys()
    if len(known) + len(new) > REMEMBERED_WORDS:
        kept = {word: known[word] for word in distinct - new}
        known.clear()
        known |= kept
    known |= {word: vocab.packed[vocab.added[word]] for word in new & vocab.added.keys()}
    known |= vocab.encode_words(new - vocab.added.keys())
    return [b"".join([known[w] for w in words]) for words in split]


def _slices(texts: Iterable[str]) -> Iterator[list[str]]:
    """Consecutive texts of about ``SLICE_CHARS`` in all; a longer text is alone or last."""
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= SLICE_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def _encoded(batches: Iterable[pa.RecordBatch], path: str, decoded: bool) -> Iterator[pa.RecordBatch]:
    """Batches of doc_id, ids and perhaps decoded, from batches of doc_id and text."""
    vocab, known = vocabulary(path), {}
    for batch in batches:
        at = 0
        # Of a batch's texts, only those of one slice are Python strings at a time.
        for texts in _slices(text.as_py() for text in batch.column("text")):
            ids = encode_texts(vocab, texts, known)
            out = {"doc_id": batch.column("doc_id").slice(at, len(ids)), "ids": pa.array(ids, pa.binary())}
            if decoded:
                out["decoded"] = pa.array([vocab.decode(packed) for packed in ids], pa.string())
            at += len(ids)
            yield pa.RecordBatch.from_pydict(out)
        # Workers outlive their tasks, and would keep the room that Arrow's batches took.
        pa.default_memory_pool().release_unused()


def encode_documents(docs: DataFrame, path: str, decoded: bool = False) -> DataFrame:
    """Columns doc_id and ids, a row per document; null and empty texts have no ids.

    Ids are packed as little-endian unsigned 32-bit integers. With ``decoded``, a column of that name
    holds the text decoded from them again.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _encoded(batches, path, decoded)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(encode, "doc_id long, ids binary" + ", decoded string" * decoded)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """Columns doc_id and text, from doc_id and packed ids."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab = vocabulary(path)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": [vocab.decode(packed) for packed in batch["ids"]]})

    rows = encoded.select(F.col("doc_id").cast("string").alias("doc_id"), "ids")
    return rows.mapInPandas(decode, "doc_id string, text string").withColumn("doc_id", F.col("doc_id").cast("long"))


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 and decoded_sha256.

    Null and empty texts have no tokens and the digests of nothing; a null doc_id stays null, repeated rows
    are repeated, other columns are left out, and an empty table gives no rows.
    """
    return encode_documents(docs, path, decoded=True).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
