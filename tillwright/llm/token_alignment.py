"""Which tokens of two tokenizers stand for the same bytes, and how common each such link is.

Both tokenizers cut a text's bytes into consecutive intervals. All intervals, of both sides, are sorted by
start; where a start reaches the furthest end so far, both sides have ended and a new group begins. Within
a group every pair of overlapping intervals is a link.

Texts are cut into stretches before each space that follows no white space: neither tokenizer joins bytes
across such a place, so a stretch's groups and links are the same wherever it stands. A task aligns its
distinct stretches once. Per document the distinct links go to a table in the shared folder; how many
documents hold each link is summed over that table, and a second pass looks the sums up.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwright.llm.bpe_trie import LATIN, Vocabulary
from tillwright.llm.common import drop_table, heavy_from, text_or_empty, written

#: Characters aligned and links counted at a time; stretches and counts that a task remembers.
SLICE_CHARS, LINKS_AT_ONCE, REMEMBERED, REMEMBERED_LINKS = 2_000_000, 1_000_000, 400_000, 2_000_000
#: Links whose counts are sent to every task; rarer ones, if there are more, are joined by a shuffle.
SENT_LINKS = 1_000_000
SPACE = "▁"
_STRETCHES = re.compile(r"(?<=\S) ")
_NOT_AFTER_WORD = re.compile(r"\s |^ ")
_BYTE_PIECE = re.compile("<0x([0-9A-F]{2})>")


class ByteSide(Vocabulary):
    """A byte-level BPE file without added tokens: their strings are ordinary text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.added = {}
        self.lengths = np.zeros(max(self.bytes_of) + 1, np.int64)
        self.lengths[list(self.bytes_of)] = [len(b) for b in self.bytes_of.values()]

    def ids(self, kinds: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of stretches in one row, and how many each has; of some kinds, as from ``sorted_out``."""
        latin, plain, odd = kinds
        words = []
        for text in ("".join([" " + s for s in latin]), "".join([" " + s for s in plain]), *[" " + s for s in odd]):
            words += self._plain_words(text) if text else []
        found = self.encode_words(set(words))
        ids = np.frombuffer(b"".join([found[w] for w in words]), "<u4").astype(np.int64)
        ends = np.cumsum([len(s.encode()) + 1 for kind in kinds for s in kind])
        return ids, np.diff(np.searchsorted(np.cumsum(self.lengths[ids]), ends, "right"), prepend=0)


class PieceSide:
    """A sentence-piece model that puts a space before each text."""

    def __init__(self, model: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        if any(SPACE in piece.lstrip(SPACE) for piece in pieces):
            raise ValueError("pieces must have their spaces in front")
        self.bytes_of = [bytes.fromhex(m[1]) if (m := _BYTE_PIECE.fullmatch(p)) else p.replace(SPACE, " ").encode() for p in pieces]
        self.lengths = np.array(list(map(len, self.bytes_of)), np.int64)

    def ids(self, kinds: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        found = self.model.encode([s for kind in kinds for s in kind], num_threads=1)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int64, int(counts.sum())), counts


def sorted_out(texts: Iterable[str]) -> list[list[str]]:
    """Stretches of plain letters, of any others, and those that begin or end with white space.

    With the space in front of each, the first two kinds may be run together: words end before a space
    that follows no white space.
    """
    kinds: list[list[str]] = [[], [], []]
    for text in texts:
        kinds[2 if not text or text[0].isspace() or text[-1].isspace() else 0 if LATIN.fullmatch(text) else 1].append(text)
    return kinds


def stretches(text: str) -> list[str]:
    """The stretches of a text, each without the space in front that both tokenizers see."""
    parts = _STRETCHES.split(text) if _NOT_AFTER_WORD.search(text) else text.split(" ")
    if len(parts) > 1 and not parts[-1]:  # a last space stays with its word, as models read nothing into an empty text
        parts[-2:] = [parts[-2] + " "]
    return parts


@dataclass
class Aligned:
    """Some texts' groups and links: per text the numbers of tokens and groups, links packed, groups spelled out."""

    n_a: list[int]
    n_b: list[int]
    n_groups: list[int]
    links: list[bytes]
    groups: list[str]


def align(ids_a: np.ndarray, n_a: np.ndarray, a_lengths: np.ndarray, ids_b: np.ndarray, n_b: np.ndarray, b_lengths: np.ndarray) -> Aligned:
    """Coalesce the intervals of texts whose tokens, on either side, spell the same bytes.

    Each side has the ids of all texts in one row and their number per text. A link is packed as the first
    side's id in the upper half and the second's in the lower half.
    """
    ends_a, ends_b = np.cumsum(a_lengths[ids_a]), np.cumsum(b_lengths[ids_b])
    starts_a, starts_b = ends_a - a_lengths[ids_a], ends_b - b_lengths[ids_b]
    starts, ends = np.concatenate([starts_a, starts_b]), np.concatenate([ends_a, ends_b])
    order = np.lexsort((ends, starts))
    reached = np.maximum.accumulate(ends[order])
    breaks = np.ones(len(order), bool)
    breaks[1:] = starts[order][1:] >= reached[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks) - 1
    group_a, group_b = group[: len(ids_a)], group[len(ids_a) :]
    # Within its group, each interval overlaps a run of the other side's.
    first = np.searchsorted(ends_b, starts_a, "right")
    many = np.searchsorted(starts_b, ends_a, "left") - first
    links_to = np.repeat(first - np.r_[0, np.cumsum(many)[:-1]] if len(many) else first, many) + np.arange(many.sum())
    links = (np.repeat(ids_a, many) << 32 | ids_b[links_to]).astype("<u8").tobytes()
    token_ends_a, token_ends_b = np.cumsum(n_a), np.cumsum(n_b)
    link_ends = np.r_[0, np.cumsum(many)][token_ends_a] * 8
    groups_before = np.r_[group_a, group[order[-1]] + 1 if len(order) else 0][token_ends_a]
    cuts_a, cuts_b = (np.r_[0, np.cumsum(np.bincount(g, minlength=int(breaks.sum())))].tolist() for g in (group_a, group_b))
    spelled_a, spelled_b = list(map(str, ids_a.tolist())), list(map(str, ids_b.tolist()))
    each = [
        f"{','.join(spelled_a[i:j])}|{','.join(spelled_b[k:m])}" for i, j, k, m in zip(cuts_a[:-1], cuts_a[1:], cuts_b[:-1], cuts_b[1:], strict=True)
    ]
    group_ends = groups_before.tolist()
    group_starts = [0, *group_ends[:-1]]
    return Aligned(
        n_a.tolist(),
        n_b.tolist(),
        [j - i for i, j in zip(group_starts, group_ends, strict=True)],
        [links[i:j] for i, j in zip([0, *link_ends[:-1].tolist()], link_ends.tolist(), strict=True)],
        [";".join(each[i:j]) for i, j in zip(group_starts, group_ends, strict=True)],
    )


@dataclass
class Aligner:
    """A worker's tokenizers and the stretches it remembers."""

    a: ByteSide
    b: PieceSide
    number: dict[str, int] = field(default_factory=dict)
    #: Per number: tokens of either side and groups; all -1 for stretches that a side doesn't spell as they are.
    sizes: np.ndarray = field(default_factory=lambda: np.zeros((0, 3), np.int64))
    links: list[bytes] = field(default_factory=list)
    groups: list[str] = field(default_factory=list)
    #: Per number: the slices that held it.
    met: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @staticmethod
    def _right(texts: list[bytes], ids: np.ndarray, counts: np.ndarray, side) -> np.ndarray:
        """Which texts the tokens spell as they are."""
        spelled = [side.bytes_of[i] for i in ids.tolist()]
        ends = np.cumsum(counts)
        sizes = np.r_[0, np.cumsum(side.lengths[ids])]
        same = (sizes[ends] - sizes[ends - counts]) == np.fromiter(map(len, texts), np.int64, len(texts))
        if same.all() and b"".join(spelled) == b"".join(texts):
            return same
        return np.array([b"".join(spelled[e - n : e]) == text for text, e, n in zip(texts, ends.tolist(), counts.tolist(), strict=True)])

    def learn(self, new: Iterable[str]) -> None:
        kinds = sorted_out(new)
        ordered = [s for kind in kinds for s in kind]
        texts = [(" " + s).encode() for s in ordered]
        (ids_a, n_a), (ids_b, n_b) = self.a.ids(kinds), self.b.ids(kinds)
        right = self._right(texts, ids_a, n_a, self.a) & self._right(texts, ids_b, n_b, self.b)
        if not right.all():
            ids_a, ids_b = ids_a[np.repeat(right, n_a)], ids_b[np.repeat(right, n_b)]
            n_a, n_b = n_a * right, n_b * right
        found = align(ids_a, n_a, self.a.lengths, ids_b, n_b, self.b.lengths)
        start = len(self.sizes)
        self.number |= {stretch: start + i for i, stretch in enumerate(ordered)}
        sizes = np.array([found.n_a, found.n_b, found.n_groups], np.int64).T
        self.sizes = np.concatenate([self.sizes, np.where(right[:, None], sizes, -1)])
        self.links += found.links
        self.groups += found.groups
        self.met = np.concatenate([self.met, np.zeros(len(ordered), np.int64)])

    def forget(self, room: int) -> None:
        """Drop the stretches that one slice alone held, or all, so that ``room`` more can be remembered."""
        kept = [(s, i) for s, i in self.number.items() if self.met[i] > 1]
        kept = kept if len(kept) + room <= REMEMBERED else []
        old = [i for _, i in kept]
        self.number = {s: i for i, (s, _) in enumerate(kept)}
        self.sizes, self.met = self.sizes[old], self.met[old]
        self.links, self.groups = [self.links[i] for i in old], [self.groups[i] for i in old]

    def documents(self, texts: list[str]) -> list[tuple[tuple[int, int, int], bytes, str]]:
        """Per text the numbers of tokens and groups, the packed links and the groups; nothing for texts without tokens."""
        cut = [stretches(text) if text else [] for text in texts]
        distinct = set(chain.from_iterable(cut))
        new = distinct - self.number.keys()
        if len(self.number) + len(new) > REMEMBERED:
            self.forget(len(distinct))
            new = distinct - self.number.keys()
        if new:
            self.learn(new)
        self.met[[self.number[s] for s in distinct]] += 1
        found = []
        for part in cut:
            at = [self.number[s] for s in part]
            rows = self.sizes[at] if at else self.sizes[:0]
            # Where a stretch isn't spelled as it is, neither is the text: no side makes up for a byte elsewhere.
            if not at or (rows < 0).any():
                found.append(((0, 0, 0), b"", ""))
            else:
                found.append((tuple(rows.sum(0).tolist()), b"".join([self.links[i] for i in at]), ";".join([self.groups[i] for i in at])))
        return found


@lru_cache(maxsize=1)
def aligner(path_a: str, model_b: bytes) -> Aligner:
    return Aligner(ByteSide(path_a), PieceSide(model_b))


def _slices(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= SLICE_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def _aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per document: a row number of its own, counts, digest of the groups, its distinct links and how often each occurs.

    Links are ascending, packed as the steps from one to the next.
    """
    with open(path_b, "rb") as file:
        model_b = file.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(path_a, model_b)
        for batch in batches:
            at = 0
            for texts in _slices(batch.column("text").to_pylist()):
                found = tool.documents(texts)
                distinct = [np.unique(np.frombuffer(links, "<u8"), return_counts=True) for _, links, _ in found]
                columns = {
                    "doc_id": batch.column("doc_id").slice(at, len(texts)),
                    "n_a": pa.array([n[0] for n, _, _ in found], pa.int64()),
                    "n_b": pa.array([n[1] for n, _, _ in found], pa.int64()),
                    "n_groups": pa.array([n[2] for n, _, _ in found], pa.int64()),
                    "n_links": pa.array([len(links) // 8 for _, links, _ in found], pa.int64()),
                    "groups_sha256": [hashlib.sha256(groups.encode()).hexdigest() if groups else "" for _, _, groups in found],
                    "links": pa.array([np.diff(keys, prepend=np.uint64(0)).tobytes() for keys, _ in distinct], pa.binary()),
                    "times": pa.array([times.astype("<u4").tobytes() for _, times in distinct], pa.binary()),
                }
                at += len(texts)
                yield pa.RecordBatch.from_pydict(columns)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, times binary"
    return rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Some documents at a time, with all their distinct links, how often each occurs, and where documents end."""
    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column("links")).to_numpy(zero_copy_only=False)) // 8
        at = 0
        while at < len(batch):
            before = sizes[at - 1] if at else 0
            end = max(int(np.searchsorted(sizes, before + LINKS_AT_ONCE, "right")), at + 1)
            part = batch.slice(at, end - at)
            links = [np.cumsum(np.frombuffer(x, "<u8")) for x in part.column("links").to_pylist()]
            times = np.frombuffer(b"".join(part.column("times").to_pylist()), "<u4").astype(np.int64)
            yield part, np.concatenate(links).astype(np.int64), times, sizes[at:end] - before
            at = end


def _link_counts(aligned: DataFrame) -> DataFrame:
    """Per link of any document: link, n (the documents that hold it) and whether that is its first id's highest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts within a task, sent on whenever they are many."""
        known, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for _, links, _, _ in _portions(batches):
            found, n = np.unique(links, return_counts=True)
            at = np.searchsorted(known, found)
            old = np.zeros(len(found), bool)
            old[at < len(known)] = known[at[at < len(known)]] == found[at < len(known)]
            counts[at[old]] += n[old]
            known, counts = np.insert(known, at[~old], found[~old]), np.insert(counts, at[~old], n[~old])
            if len(known) >= REMEMBERED_LINKS:
                yield pa.RecordBatch.from_pydict({"link": known, "n": counts})
                known, counts = known[:0], counts[:0]
        if len(known):
            yield pa.RecordBatch.from_pydict({"link": known, "n": counts})

    counts = aligned.select("links", "times").mapInArrow(run, "link long, n long").groupBy("link").agg(F.sum("n").alias("n"))
    counts = counts.select(F.shiftright("link", 32).alias("a"), "link", "n")
    highest = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(highest, "a").select("link", "n", (F.col("n") == F.col("most")).alias("best"))


def _places(links: np.ndarray, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in the ascending ``links`` each of ``mine`` is, and whether it is there."""
    at = np.searchsorted(links, mine)
    there = at < len(links)
    there[there] = links[at[there]] == mine[there]
    return at, there


def _looked_up(aligned: DataFrame, sent) -> DataFrame:
    """The documents with n_best and count_sum over the links whose counts were sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links, n, best = sent.value
        for part, mine, times, ends in _portions(batches):
            at, there = _places(links, mine)
            totals = np.zeros((2, len(mine) + 1), np.int64)
            for total, of in zip(totals, (best, n), strict=True):
                total[1:][there] = times[there] * of[at[there]]
            of_best, of_n = np.diff(np.cumsum(totals, axis=1)[:, np.r_[0, ends]], axis=1)
            kept = {name: part.column(name) for name in names}
            yield pa.RecordBatch.from_pydict({**kept, "n_best": of_best, "count_sum": of_n})

    names = [c for c in aligned.columns if c not in ("links", "times")]
    return aligned.mapInArrow(run, aligned.select(*names).schema.add("n_best", "long").add("count_sum", "long"))


def _not_sent(aligned: DataFrame, sent) -> DataFrame:
    """row, link and times of every link whose count was not sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = sent.value[0]
        for part, mine, times, ends in _portions(batches):
            rows = np.repeat(part.column("row").to_numpy(), np.diff(np.r_[0, ends]))
            rest = ~_places(links, mine)[1]
            if rest.any():
                yield pa.RecordBatch.from_pydict({"row": rows[rest], "link": mine[rest], "times": times[rest]})

    return aligned.select("row", "links", "times").mapInArrow(run, "row long, link long, times long")


def link_documents(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``path_a`` is a byte-level BPE file, ``path_b`` a sentence-piece model; the text is read with a space in
    front. Null and empty texts, and those that either side spells otherwise, have zeros and an empty
    digest. Rows that repeat a document count as documents of their own; a null doc_id stays null; columns
    other than doc_id and text are left out; an empty table gives no rows.
    """
    spark: SparkSession = docs.sparkSession
    aligned, _ = written(_aligned(docs, path_a, path_b))
    counts, counts_path = written(_link_counts(aligned))
    cut = heavy_from(counts, "n", SENT_LINKS)
    few = counts.where(F.col("n") >= cut).select("link", "n", "best").toArrow()
    order = np.argsort(few["link"].to_numpy())
    sent = spark.sparkContext.broadcast(tuple(few[c].to_numpy()[order] for c in ("link", "n", "best")))
    found = _looked_up(aligned, sent)
    if cut:
        rare = counts.where(F.col("n") < cut)
        more = _not_sent(aligned, sent).join(rare, "link")
        of_best, of_n = F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)), F.sum(F.col("times") * F.col("n"))
        by_row = more.groupBy("row").agg(of_best.alias("more_best"), of_n.alias("more_n"))
        sums = {"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_n", F.lit(0))}
        found = found.join(by_row, "row", "left").withColumns(sums)
    else:
        drop_table(spark, counts_path)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
