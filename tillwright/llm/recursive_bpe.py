"""Byte-level BPE by rank file, merged and decoded by recursive queries inside each task.

A task gathers the distinct words of its texts as rows of token and position. A recursive DuckDB query
joins neighbouring rows with the table of merges and contracts, in every word at once, the leftmost
pair of least rank, until no word has a pair left; an ordered aggregation then gives each word's ids and
the bytes they spell. Words that are tokens themselves need no merging.

The merge table has one row per token: the two tokens of its last merge. Any other way to split a token
is never met, since the merges inside a token's bytes come in the order in which those bytes alone
would be merged. A long word contracts many pairs in one step, see ``_LONG``.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import duckdb
import numpy as np
import pyarrow as pa
import regex
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwright.llm.bpe_trie import LATIN, LATIN_WORDS
from tillwright.llm.common import text_or_empty

#: Characters of text and bytes of words handled by one query, and tokens decoded by one; a longer text or word is alone.
SLICE_CHARS, QUERY_BYTES, QUERY_TOKENS = 4_000_000, 300_000, 500_000
#: Words that a worker remembers.
REMEMBERED_WORDS = 800_000
#: Bytes from which on a word counts as long.
LONG_WORD = 48

# A place is the number of a word and, in the lower half, the byte at which the token starts.
_STARTS = "place >> 32"

# One contraction a word and step. Every step lists all rows of the words that still change; the last
# list of a word is its result.
_SHORT = f"""
WITH RECURSIVE t(place, tok, step) AS (
    SELECT place, tok, 0 FROM bytes
    UNION ALL (
        WITH pairs AS (
            SELECT place, CASE WHEN lead(place) OVER w >> 32 = {_STARTS} THEN (tok << 32) | lead(tok) OVER w END AS pair
            FROM t WINDOW w AS (ORDER BY place)),
        least AS (
            SELECT {_STARTS} AS word, min((merged << 32) | (place & 4294967295)) AS found FROM pairs JOIN merges USING (pair) GROUP BY ALL),
        contracted AS (
            SELECT word, merged, (word << 32) | (found & 4294967295) AS kept, kept + size AS gone FROM least JOIN merges ON merged = found >> 32)
        SELECT place, CASE WHEN place = kept THEN merged ELSE tok END, step + 1
        FROM t JOIN contracted ON {_STARTS} = word WHERE place <> gone)),
ends AS (SELECT {_STARTS} AS word, max(step) AS step FROM t GROUP BY ALL)
SELECT word, list(tok ORDER BY place) AS ids, unhex(string_agg(hex, '' ORDER BY place)) AS spelled
FROM t JOIN ends ON {_STARTS} = word AND t.step = ends.step JOIN spellings ON id = tok GROUP BY word
"""

# Many contractions a step: a pair of rank r goes at once if no pair of lower rank lies within reach, which
# is the length of the longest token to its left and twice that to its right. Until the leftmost-least
# order comes to that pair it takes lower ranks only, and those can't reach the pair's two tokens; what the
# pair becomes merges at higher ranks only (``RankFile.steady``). Of overlapping equal pairs every other one
# goes, from the left. The keyed recursion keeps one row per place; contracted-away ones become -1.
_LONG = f"""
WITH RECURSIVE t(place, tok) USING KEY (place) AS (
    SELECT place, tok FROM bytes
    UNION (
        WITH live AS (SELECT place, tok FROM recurring.t WHERE tok >= 0 AND {_STARTS} IN (SELECT {_STARTS} FROM t)),
        pairs AS (
            SELECT place, lead(place) OVER w AS next, (tok << 32) | lead(tok) OVER w AS pair, row_number() OVER w AS nth
            FROM live WINDOW w AS (ORDER BY place)),
        ranked AS (
            SELECT place, next, nth, merged, min(merged) OVER (ORDER BY place RANGE BETWEEN {{longest}} PRECEDING AND 2 * {{longest}} FOLLOWING) AS least
            FROM pairs JOIN merges USING (pair) WHERE next >> 32 = {_STARTS}),
        runs AS (
            SELECT place, next, merged, nth - row_number() OVER (PARTITION BY merged ORDER BY place) AS run FROM ranked WHERE merged = least),
        contracted AS (SELECT place, next, merged FROM runs QUALIFY row_number() OVER (PARTITION BY merged, run ORDER BY place) % 2 = 1)
        SELECT place, merged FROM contracted UNION ALL SELECT next, -1 FROM contracted))
SELECT {_STARTS} AS word, list(tok ORDER BY place) AS ids, unhex(string_agg(hex, '' ORDER BY place)) AS spelled
FROM t JOIN spellings ON id = tok GROUP BY ALL
"""

_DECODE = """
SELECT part, unhex(string_agg(hex, '' ORDER BY place)) AS spelled FROM tokens JOIN spellings USING (id) GROUP BY part
"""


@dataclass(frozen=True)
class RankFile:
    """The tokens of a rank file in order of id; a token's id is the rank of the merge that makes it."""

    spelled: tuple[bytes, ...]
    ids: np.ndarray
    #: Per merge: left, right, merged.
    merges: np.ndarray

    @classmethod
    def read(cls, path: str) -> RankFile:
        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the rank file lacks {len(missing)} single bytes")
        tokens = sorted(ranks, key=ranks.__getitem__)
        merges = [(*pair, ranks[t]) for t in tokens if len(t) > 1 and (pair := _last_merge(ranks, t))]
        return cls(tuple(tokens), np.array([ranks[t] for t in tokens], np.int64), np.array(merges, np.int64).reshape(-1, 3))

    @property
    def steady(self) -> bool:
        """Whether merged tokens outrank their parts, so that a merge never allows one of lower rank."""
        return bool((self.merges[:, 2] > self.merges[:, :2].max(1, initial=-1)).all())

    @cached_property
    def key(self) -> str:
        return hashlib.sha256(b"\n".join(self.spelled) + self.ids.tobytes()).hexdigest()


def _last_merge(ranks: dict[bytes, int], token: bytes) -> tuple[int, int] | None:
    """The last merge when a token's bytes are merged by themselves; none if they don't become the token."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not found:
            return None
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return ranks[parts[0]], ranks[parts[1]]


class Merger:
    """A worker's database with the merge table, and the words it remembers: word -> (packed ids, bytes)."""

    def __init__(self, file: RankFile):
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.id_of = dict(zip(file.spelled, file.ids.tolist(), strict=True))
        self.byte_ids = np.array([self.id_of[bytes([b])] for b in range(256)], np.int64)
        self.longest = max(map(len, file.spelled))
        self.long_word = LONG_WORD if file.steady else float("inf")
        self.words = regex.compile(PATTERN)
        sizes = dict(zip(file.ids.tolist(), map(len, file.spelled), strict=True))
        left, right, merged = file.merges.T
        self.database = duckdb.connect(config={"threads": 1, "memory_limit": "600MB"})
        self._store("merges", {"pair": (left << 32) | right, "merged": merged, "size": np.array([sizes[i] for i in left.tolist()], np.int64)})
        self._store("spellings", {"id": file.ids, "hex": [token.hex() for token in file.spelled]})

    def _store(self, name: str, columns: dict) -> None:
        self.database.register("given", pa.table(columns))
        self.database.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.database.unregister("given")

    def split(self, text: str) -> list[str]:
        return (LATIN_WORDS if LATIN.fullmatch(text) else self.words).findall(text)

    def _rows(self, query: str, name: str, columns: dict) -> pa.Table:
        self.database.register(name, pa.table(columns))
        try:
            return self.database.sql(query).to_arrow_table()
        finally:
            self.database.unregister(name)

    def merge(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Packed ids of words, little-endian unsigned 32-bit, and the bytes those ids spell."""
        long = len(words[0]) >= self.long_word
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        letters = np.frombuffer(b"".join(words), np.uint8)
        place = np.arange(len(letters)) - np.repeat(ends - sizes, sizes)
        place += np.repeat(np.arange(len(words)) << 32, sizes)
        query = _LONG.format(longest=self.longest) if long else _SHORT
        found = self._rows(query, "bytes", {"place": place, "tok": self.byte_ids[letters]}).sort_by("word")
        ids = found["ids"].combine_chunks()
        ends, flat = ids.offsets.to_numpy() * 4, ids.values.to_numpy().astype("<u4").tobytes()
        spelled = found["spelled"].to_pylist()
        return zip([flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], spelled, strict=True)

    def learn(self, words: set[str]) -> None:
        """Remember words not met before."""
        short, long = [], []
        for word in words:
            spelled = word.encode("utf-8", "surrogatepass")
            token = self.id_of.get(spelled)
            if token is not None:
                self.known[word] = token.to_bytes(4, "little"), spelled
            else:
                (long if len(spelled) >= self.long_word else short).append((word, spelled))
        for kind in (short, long):
            for part in _parts(kind, lambda pair: len(pair[1]), QUERY_BYTES):
                found = self.merge([spelled for _, spelled in part])
                self.known |= {word: entry for (word, _), entry in zip(part, found, strict=True)}

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Packed ids of texts, and the bytes they spell."""
        split = [self.split(text) for text in texts]
        distinct = set().union(*split)
        new = distinct - self.known.keys()
        if len(self.known) + len(new) > REMEMBERED_WORDS:
            self.known = {word: self.known[word] for word in distinct - new}
        self.learn(new)
        entries = ([self.known[word] for word in words] for words in split)
        return [(b"".join([ids for ids, _ in found]), b"".join([spelled for _, spelled in found])) for found in entries]

    def decode(self, packed: list[bytes]) -> list[bytes]:
        """The bytes of packed ids; ids that the file doesn't have spell nothing."""
        spelled: list[list[bytes]] = [[] for _ in packed]
        pieces = [(i, p[at : at + 4 * QUERY_TOKENS]) for i, p in enumerate(packed) for at in range(0, len(p), 4 * QUERY_TOKENS)]
        for part in _parts(pieces, lambda piece: len(piece[1]) // 4, QUERY_TOKENS):
            ids = np.frombuffer(b"".join(p for _, p in part), "<u4").astype(np.int64)
            numbers = np.repeat(np.arange(len(part)), [len(p) // 4 for _, p in part])
            found = self._rows(_DECODE, "tokens", {"part": numbers, "place": np.arange(len(ids)), "id": ids}).sort_by("part")
            for number, text in zip(found["part"].to_pylist(), found["spelled"].to_pylist(), strict=True):
                spelled[part[number][0]].append(text)
        return [b"".join(texts) for texts in spelled]


def _parts(items: Iterable, size, most: int) -> Iterator[list]:
    """Consecutive items of at most ``most`` in all; a larger one is alone."""
    part, total = [], 0
    for item in items:
        if part and total + size(item) > most:
            yield part
            part, total = [], 0
        part.append(item)
        total += size(item)
    if part:
        yield part


_MERGERS: dict[str, Merger] = {}


def merger(file: RankFile) -> Merger:
    """The worker's database for a rank file, made once."""
    if file.key not in _MERGERS:
        _MERGERS.clear()
        _MERGERS[file.key] = Merger(file)
    return _MERGERS[file.key]


def _encoded(docs: DataFrame, path: str, columns, schema: str) -> DataFrame:
    """doc_id and what ``columns`` makes of the list of (packed ids, spelled bytes) of some documents."""
    file = RankFile.read(path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = merger(file)
        for batch in batches:
            at, ids = 0, batch.column("doc_id")
            for texts in _parts(batch.column("text").to_pylist(), len, SLICE_CHARS):
                made = columns(tool.encode(texts))
                yield pa.RecordBatch.from_pydict({"doc_id": ids.slice(at, len(texts)), **made})
                at += len(texts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(encode, f"doc_id long, {schema}")


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """Columns doc_id and ids, packed as little-endian unsigned 32-bit integers; a row per row of ``docs``.

    The rank file is read on the driver and sent along. Null and empty texts have no ids; a null doc_id
    stays null, repeated rows are repeated, other columns are left out.
    """
    return _encoded(docs, path, lambda found: {"ids": pa.array([ids for ids, _ in found], pa.binary())}, "ids binary")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """Columns doc_id and decoded (bytes), from doc_id and packed ids; null ids count as none."""
    file = RankFile.read(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = merger(file)
        for batch in batches:
            packed = [ids or b"" for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "decoded": pa.array(tool.decode(packed), pa.binary())})

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(decode, "doc_id long, decoded binary")


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 (decimal ids joined by commas) and decoded_sha256.

    What is decoded are the ids, word by word. Odd rows are taken as by ``encode_documents``.
    """

    def columns(found: list[tuple[bytes, bytes]]) -> dict:
        numbers = [np.frombuffer(ids, "<u4").tolist() for ids, _ in found]
        return {
            "n_tokens": pa.array(map(len, numbers), pa.int64()),
            "ids_sha256": [hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() for ids in numbers],
            "decoded_sha256": [hashlib.sha256(spelled).hexdigest() for _, spelled in found],
        }

    return _encoded(docs, path, columns, "n_tokens long, ids_sha256 string, decoded_sha256 string")
