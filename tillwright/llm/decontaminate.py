"""Benchmark decontamination: word pairs as seeds, then Smith-Waterman alignment.

Test items are a small table, handled in blocks of bounded size; documents are only ever scanned. One
scan counts in how many documents each word pair of a block occurs. A pair is two neighbouring words, or
two with any one word between them: wherever an alignment scores three or more, two of its matches are
that close. More than that, neighbours counted twice and the others once, its pairs add up to its score
less two. So an item leaves out its commonest pairs only as far as the rest still meet every text that
holds it, and no alignment is computed where a stretch of text has too few of the item's pairs.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tillwright.llm.common import text_or_empty

GRAM = 3
MATCH, MISMATCH, GAP = 2, -1, -2
#: Share of the best possible score from which a document holds an item.
MIN_SHARE = 0.5
#: Or so many words in a row, net of edits, of a longer item.
MIN_WORDS = 13
#: So many words, net of edits, are the least that holds an item; one that has no more must be there whole.
LEAST_WORDS = 7
#: Words of test items handled at a time.
BLOCK_WORDS = 1_000_000
#: Scripts without spaces, whose characters count as words: Thai, Lao, Burmese, Khmer, Chinese, Japanese.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u3105-\u312f\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
CHARACTER = re.compile(f"[{UNSPACED}]")
WORD, MIXED = re.compile(r"\w+"), re.compile(rf"(?=\w)[{UNSPACED}]|[^\W{UNSPACED}]+")
#: ASCII characters of no word become spaces, so that what lies between is a word if it is ASCII too.
SPACED = bytes(c if c > 127 or chr(c).isalnum() or c == 95 else 32 for c in range(256))
#: Characters of texts that are looked up together.
TOGETHER = 300_000
#: A line, or a sentence of one.
PART = re.compile(r"[^\n\r.!?;:\u2026\u3002\uff01\uff1f\uff1b\uff1a]+")


def _pattern(text: str) -> re.Pattern[str]:
    return WORD if text.isascii() or not CHARACTER.search(text) else MIXED


def words_of(text: str | None) -> list[str]:
    text = (text or "").lower()
    return _pattern(text).findall(text)


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of an item with a stretch of words, and the word after its end."""
    row = np.zeros(len(words) + 1, np.int64)
    ramp = np.arange(len(words) + 1) * -GAP
    best, end = 0, 0
    for word in item:
        step = np.where(words == word, MATCH, MISMATCH)
        new = np.maximum(row + GAP, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + step)
        # A run of gaps costs the same each word, so the best cell to the left is a running maximum.
        row = np.maximum.accumulate(new + ramp) - ramp
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def least_score(length: int) -> int:
    """The score from which an item of so many words is held."""
    return min(MATCH * MIN_WORDS, max(math.ceil(MATCH * MIN_SHARE * length), MATCH * min(LEAST_WORDS, length)))


class Items:
    """A block of test items as numbered words, with their word pairs."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        split = [(i, words_of(t)) for i, t in items]
        #: Items too short to be aligned, by their words.
        self.short: dict[tuple[str, ...], list[int | None]] = defaultdict(list)
        for i, w in split:
            if 0 < len(w) < GRAM:
                self.short[tuple(w)].append(i)
        split = [(i, w) for i, w in split if len(w) >= GRAM]
        self.ids = [i for i, _ in split]
        self.number = {w: n for n, w in enumerate(sorted({w for _, ws in split for w in ws}), 1)}
        self.encoded = {w.encode(): n for w, n in self.number.items()}
        self.words = [np.array([self.number[w] for w in ws], np.int64) for _, ws in split]
        self.pairs = [self.codes(ws) for ws in self.words]
        own = [np.unique(p[p >= 0]) for p in self.pairs]
        self.known = np.unique(np.concatenate(own)) if split else np.zeros(0, np.int64)
        #: Places of each item's pairs among the known ones.
        self.own = [np.searchsorted(self.known, codes) for codes in own]

    def numbered(self, words: list[str]) -> np.ndarray:
        """Numbers of a document's words; 0 for words that no item has."""
        get = self.number.get
        return np.array([get(w, 0) for w in words], np.int64)

    def numbers_of(self, text: str) -> np.ndarray:
        """The same from the text itself, for which its words need not be made."""
        text = text.lower()
        cut, pattern = text.encode().translate(SPACED).split(), _pattern(text)
        # Where all other characters are letters or digits too, and none is a word by itself, the cuts are the words.
        if text.isascii() or (pattern is WORD and b"".join(cut).replace(b"_", b"").decode().isalnum()):
            return np.fromiter(map(self.encoded.get, cut, repeat(0)), np.int64, len(cut))
        out: list[int] = []
        for piece in cut:
            known = self.encoded.get(piece)
            if known is not None:
                out.append(known)
            elif piece.isascii():
                out.append(0)
            else:
                out += [self.number.get(w, 0) for w in pattern.findall(piece.decode())]
        return np.array(out, np.int64)

    def places(self, codes: np.ndarray) -> np.ndarray:
        """Places of codes among the known ones; their number for any other."""
        out = np.full(codes.shape, len(self.known), np.int64)
        if len(self.known):
            there = codes >= 0
            own = codes[there]
            at = np.minimum(np.searchsorted(self.known, own), len(self.known) - 1)
            out[there] = np.where(self.known[at] == own, at, len(self.known))
        return out

    def groups(self, texts: Sequence[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Texts some at a time: the first one, where each begins and the last ends, word numbers and places of pairs.

        Two words of number 0 end each text, so that no pair reaches into the next.
        """
        first = size = 0
        for n, text in enumerate(texts):
            size += len(text)
            if size >= TOGETHER or n == len(texts) - 1:
                numbers = [np.append(self.numbers_of(t), (0, 0)) for t in texts[first : n + 1]]
                starts = np.concatenate([[0], np.cumsum([len(x) for x in numbers])])
                numbers = np.concatenate(numbers)
                yield first, starts, numbers, self.places(self.codes(numbers))
                first, size = n + 1, 0

    def codes(self, words: np.ndarray) -> np.ndarray:
        """Two rows: a number for each word with the next one, and with the one after; -1 for foreign words."""
        size = len(self.number) + 1
        out = np.full((2, len(words)), -1, np.int64)
        for row in range(min(2, len(words) - 1)):
            left, right = words[: -1 - row], words[1 + row :]
            out[row, : len(left)] = np.where((left > 0) & (right > 0), (left * size + right) * 2 + row, -1)
        return out


class Seeds:
    """The pairs of a block of items by which texts that may hold them are found, and what they lead to."""

    def __init__(self, items: Items, documents_with: dict[int, int]):
        self.items = items
        leads: dict[int, list[int]] = defaultdict(list)
        for n, pairs in enumerate(items.pairs):
            for code in _kept(pairs, documents_with, least_score(len(items.words[n])) - 3):
                leads[code].append(n)
        codes = np.array(sorted(leads), np.int64)
        self.leads = dict(zip(np.searchsorted(items.known, codes).tolist(), (leads[c] for c in codes.tolist()), strict=True))
        self.is_seed = np.zeros(len(items.known) + 1, bool)
        self.is_seed[list(self.leads)] = True
        self.marked = np.zeros(len(items.known) + 1, np.int64)

    def find(self, text: str | None) -> list[tuple[int | None, float, int, int]]:
        """Per item that the text holds: id, share of the best score, first and last character + 1."""
        return self.find_all([text])[0]

    def find_all(self, texts: Sequence[str | None]) -> list[list[tuple[int | None, float, int, int]]]:
        """The same for each of some texts."""
        texts = [text or "" for text in texts]
        found = [self._short(text) for text in texts]
        for first, starts, numbers, places in self.items.groups(texts):
            spots = np.flatnonzero(places.min(axis=0) < len(self.items.known))
            places = places[:, spots]
            bounds = np.searchsorted(spots, starts)
            seeded = np.flatnonzero(self.is_seed[places].any(axis=0))
            for n in np.unique(np.searchsorted(bounds, seeded, "right") - 1).tolist():
                part, at = slice(bounds[n], bounds[n + 1]), starts[n]
                found[first + n] += self._long(texts[first + n], numbers[at : starts[n + 1] - 2], places[:, part], spots[part] - at)
        return found

    def _short(self, text: str | None) -> list[tuple[int | None, float, int, int]]:
        """Items of one or two words, which a text holds where one is all of a line or sentence."""
        found: dict[tuple[str, ...], tuple[int, int]] = {}
        for part in PART.finditer((text or "").lower()) if self.items.short else ():
            words = tuple(words_of(part.group()))
            if words in self.items.short and words not in found:
                spans = [m.span() for m in _pattern(part.group()).finditer(part.group())]
                found[words] = part.start() + spans[0][0], part.start() + spans[-1][1]
        return [(i, 1.0, *span) for words, span in found.items() for i in self.items.short[words]]

    def _long(self, text: str, numbers: np.ndarray, places: np.ndarray, spots: np.ndarray) -> list[tuple[int | None, float, int, int]]:
        """Of a text's words, and the places of its pairs at some spots."""
        seen = places[self.is_seed[places]]
        found = []
        for n in sorted({n for place in np.unique(seen).tolist() for n in self.leads[place]}):
            item, own = self.items.words[n], self.items.own[n]
            least = least_score(len(item))
            self.marked[own] = 1
            weights = np.maximum(2 * self.marked[places[0]], self.marked[places[1]])
            self.marked[own] = 0
            tops = [(*align(item, numbers[lo:hi]), lo) for lo, hi in _stretches(weights, spots, len(item), least)]
            tops = [top for top in tops if top[0] >= least]
            if tops:
                score, start, end = max(self._placed(item, numbers, *top) for top in tops)
                found.append((self.items.ids[n], score / (MATCH * len(item)), start, end))
        if not found:
            return []
        text = text.lower()
        spans = [m.span() for m in _pattern(text).finditer(text)]
        return [(i, share, spans[a][0], spans[b - 1][1]) for i, share, a, b in found]

    @staticmethod
    def _placed(item: np.ndarray, numbers: np.ndarray, score: int, end: int, lo: int) -> tuple[int, int, int]:
        """The score of an alignment in a stretch of words, its first word and the word after its last."""
        # The best alignment of the reversed words, from its end on, ends where the alignment begins.
        _, length = align(item[::-1], numbers[lo : lo + end][::-1])
        return score, lo + end - length, lo + end


def _kept(pairs: np.ndarray, documents_with: dict[int, int], spare: int) -> list[int]:
    """An item's pairs that occur, without the commonest that together can add no more than ``spare``."""
    places: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for row in range(2):
        for at, code in enumerate(pairs[row].tolist()):
            if code in documents_with:
                places[code].append((at, 2 - row))
    ordered = sorted(places, key=lambda code: (-documents_with[code], code))
    # From one word on, an alignment goes by one pair at most.
    lost: dict[int, int] = {}
    for dropped, code in enumerate(ordered):
        spare -= sum(max(weight - lost.get(at, 0), 0) for at, weight in places[code])
        if spare < 0:
            return ordered[dropped:]
        lost |= {at: max(weight, lost.get(at, 0)) for at, weight in places[code]}
    return []


def _stretches(weights: np.ndarray, spots: np.ndarray, length: int, least: int) -> list[tuple[int, int]]:
    """Word ranges with enough of an item's pairs, by their weights, to hold it, overlapping ones made one."""
    if weights.sum() < least - 2:
        return []
    at = spots[weights > 0]
    sums = np.concatenate([[0], np.cumsum(weights[weights > 0])])
    # Words that an alignment takes up: those of the item, and others at the cost of a gap each.
    reach = 2 * length - least // 2
    lasts = at[sums[1:] - sums[np.searchsorted(at, at - reach, "right")] >= least - 2]
    out: list[tuple[int, int]] = []
    for last in lasts.tolist():
        lo, hi = max(0, last - reach), last + reach
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def _seeds(docs: DataFrame, items: Items) -> Seeds:
    """Seeds by how many documents hold each pair; the counts are no more than the block's pairs."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = np.zeros(len(items.known), np.int64)
        for batch in batches:
            for _, starts, _, places in items.groups(batch["text"].tolist()):
                _, at = there = np.nonzero(places < len(items.known))
                by_text = (np.searchsorted(starts, at, "right") - 1) * len(items.known) + places[there]
                totals += np.bincount(np.unique(by_text) % max(len(items.known), 1), minlength=len(items.known))
        seen = np.flatnonzero(totals)
        yield pd.DataFrame({"pair": items.known[seen], "documents": totals[seen]})

    counts = docs.select(text_or_empty().alias("text")).mapInPandas(count, "pair long, documents long")
    return Seeds(items, {r[0]: r[1] for r in counts.groupBy("pair").agg(F.sum("documents")).collect()})


def _blocks(docs: DataFrame, benchmark: DataFrame) -> Iterator[Seeds]:
    """Seeds for a bounded part of the test items at a time."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("text"))
    words = F.size(F.split("text", r"\s+")) + F.regexp_count("text", F.lit(f"[{UNSPACED}]"))
    size = rows.agg(F.coalesce(F.sum(words), F.lit(0))).first()[0]
    blocks = -(-size // BLOCK_WORDS)
    for block in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        yield _seeds(docs, Items([(r.item_id, r.text) for r in part]))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Columns doc_id, item_id, share, start, end: a row per document and test item that it holds.

    ``share`` is the alignment's score over the item's best possible one; ``start`` and ``end`` count
    characters of the lower-cased text. Rows repeat where documents or items do. Null and empty texts
    hold nothing, and an item of one or two words is held only by a text with a line or sentence that is it.
    """

    def search(seeds: Seeds):
        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = [(d, *one) for d, held in zip(batch["doc_id"], seeds.find_all(batch["text"].tolist()), strict=True) for one in held]
                found = pd.DataFrame(rows, columns=["doc_id", "item_id", "share", "start", "end"])
                yield found.astype({"doc_id": "object", "item_id": "Int64"})

        return each

    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), text_or_empty().alias("text"))
    schema = "doc_id string, item_id long, share double, start long, end long"
    out = docs.sparkSession.createDataFrame([], schema)
    for seeds in _blocks(docs, benchmark):
        out = out.unionByName(rows.mapInPandas(search(seeds), schema))
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def _holds(seeds: Seeds, text: Column) -> Column:
    @pandas_udf("boolean")
    def holds(texts: pd.Series) -> pd.Series:
        return pd.Series([bool(held) for held in seeds.find_all(texts.tolist())], dtype=bool)

    return holds(text)


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no test item, with all their columns; no shuffle is needed."""
    for seeds in list(_blocks(docs, benchmark)):
        docs = docs.where(~_holds(seeds, text_or_empty()))
    return docs
