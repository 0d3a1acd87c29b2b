"""Toxicity by a support vector machine with a gap-weighted subsequence kernel.

A word is compared with landmark words by the subsequences they share; gaps cost a factor each, so
letters that were inserted, dropped or spaced out lower the likeness but don't hide it. A sentence has,
per landmark, the likeness of its closest word; Nyström's map turns these into features of a linear
machine. Labels are of documents: a toxic one has some toxic sentence, so the machine is fitted on
whole documents first and then on the sentence it finds most toxic in each.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwright.llm.common import held_out, label_sample, text_or_empty

#: Labelled documents the machine is fitted on, at most.
TRAIN_ROWS = 6_000
#: Landmarks: words typical of toxic documents, and others by hash.
TYPICAL, OTHERS = 36, 4
#: Words that are this many times as frequent in toxic documents may be typical; so many are weighed.
TIMES, CANDIDATES = 5, 600
#: Length of the subsequences, factor of each letter they span, and power of the normalised kernel.
LENGTH, DECAY, POWER = 3, np.float32(0.6), 3
#: Share of a landmark's letters, in any order, that a word must have to be compared with it.
SHARED_LETTERS = 0.6
#: Longer words are looked at in windows that overlap by half.
WINDOW = 24
#: Words whose likenesses a task remembers.
REMEMBERED = 400_000
RIDGE, ITERATIONS = 0.02, 50

SENTENCE = re.compile(r"[.!?]+(?=\s)|\n")
SINGLES = re.compile(r"\s\S\s\S(?:\s|$)")
SPACED = re.compile(r"(?<!\S)\S(?:[ \t]+\S){2,}(?!\S)")
OUTER = ".,;:!?\"'()[]{}<>*#$%&|-_~=+…«»“”„"


def _codes(words: list[str]) -> np.ndarray:
    """Letters of words as numbers, padded with zeros."""
    width = max(map(len, words))
    return np.array(words, f"<U{width}").view(np.uint32).reshape(len(words), width)


def _decays(width: int) -> np.ndarray:
    gaps = np.arange(width)[None, :] - np.arange(width)[:, None]
    return np.where(gaps >= 0, DECAY ** np.maximum(gaps, 0), 0).astype(np.float32)


def kernel_of_pairs(words: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Subsequence kernel of each word with the other at its place, not normalised; both as codes."""
    codes, marks = _trimmed(words).T.copy(), _trimmed(others).T.copy()  # a row per letter, a column per pair
    spread, square = _decays(len(marks)).T.copy(), DECAY * DECAY
    marks = np.where(marks == 0, np.uint32(0xFFFFFFFF), marks)
    sums = [np.zeros(marks.shape, np.float32) for _ in range(LENGTH - 1)]
    total = np.zeros(codes.shape[1], np.float32)
    for letters in codes:
        same = (marks == letters).astype(np.float32)
        same *= square
        found = same
        for level in range(LENGTH - 1):  # subsequences that end here, by what ended before here
            longer = same.copy()
            longer[0] = 0
            longer[1:] *= sums[level][:-1]
            sums[level] *= DECAY
            sums[level] += spread @ found
            found = longer
        total += found.sum(0)
    return total


def _trimmed(codes: np.ndarray) -> np.ndarray:
    """Codes without columns that are padding throughout."""
    return codes[:, : max(1, int(np.count_nonzero(codes, axis=1).max(initial=0)))]


def _letter_counts(codes: np.ndarray) -> np.ndarray:
    """How often a word has letters of each of 64 classes."""
    rows, places = np.nonzero(codes)
    flat = np.bincount(rows * 64 + codes[rows, places] % 64, minlength=len(codes) * 64)
    return np.minimum(flat, 255).astype(np.uint8).reshape(-1, 64)


def comparable(words: np.ndarray, landmarks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of words and landmarks where the word has enough of the landmark's letters."""
    counts = _letter_counts(words)
    pairs = []
    for k, letters in enumerate(_letter_counts(landmarks)):
        used = np.flatnonzero(letters)
        common = np.minimum(counts[:, used], letters[used]).sum(1, dtype=np.int64)
        rows = np.flatnonzero(common >= max(LENGTH, SHARED_LETTERS * letters.sum(dtype=np.int64)))
        pairs.append((rows, np.full(len(rows), k)))
    return np.concatenate([r for r, _ in pairs]), np.concatenate([k for _, k in pairs])


def likeness(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Power of the normalised kernel of words with landmarks, 0 to 1.

    A word that lacks too many of a landmark's letters is not like it.
    """
    out = np.zeros((len(words), len(landmarks)), np.float32)
    if not words:
        return out
    codes, marks = _codes([w or "\1" for w in words]), _codes(landmarks)
    of_landmark = np.sqrt(kernel_of_pairs(marks, marks))
    rows, columns = comparable(codes, marks)
    order = np.argsort(np.count_nonzero(codes, axis=1)[rows], kind="stable")  # so that few letters are padding
    for k in range(0, len(order), 8192):
        r, m = rows[order[k : k + 8192]], columns[order[k : k + 8192]]
        distinct, place = np.unique(r, return_inverse=True)
        own = np.sqrt(kernel_of_pairs(codes[distinct], codes[distinct]))[place]
        out[r, m] = (kernel_of_pairs(codes[r], marks[m]) / (own * of_landmark[m])) ** POWER
    return out


def word_forms(raw: str) -> list[str]:
    """What is compared of a word: without punctuation around it, long ones in windows."""
    word = raw.replace("\0", "").strip(OUTER)
    if len(word) <= WINDOW:
        return [word]
    return [word[i : i + WINDOW] for i in range(0, len(word) - WINDOW // 2, WINDOW // 2)]


def sentences(text: str) -> list[list[str]]:
    """Words of each sentence in lower case; letters spaced out are also put together to a word."""
    text = (text or "").lower()
    if SINGLES.search(text):
        text = SPACED.sub(lambda m: f"{m.group()} {''.join(m.group().split())}", text)
    return [words for words in (part.split() for part in SENTENCE.split(text)) if words]


class Comparer:
    """Likenesses of words with landmarks; a bounded number of words is remembered."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        self.forget()

    def forget(self) -> None:
        self.row: dict[str, int] = {}
        self.rows = np.zeros((1, len(self.landmarks)), np.float32)  # the first is of words like none

    def learn(self, raw: set[str]) -> None:
        """Remember words; the strings are as they stand in the text."""
        forms = {w: word_forms(w) for w in raw}
        distinct = list({f for fs in forms.values() for f in fs})
        found = likeness(distinct, self.landmarks)
        some = np.flatnonzero(found.any(1))
        at = dict(zip([distinct[i] for i in some.tolist()], range(len(some)), strict=True))
        found, base, more = found[some], len(self.rows), []
        for word, fs in forms.items():
            if len(fs) == 1:
                place = at.get(fs[0], -1)
                self.row[word] = base + place if place >= 0 else 0
                continue
            rows = [at[f] for f in fs if f in at]
            self.row[word] = base + len(found) + len(more) if rows else 0
            if rows:
                more.append(found[rows].max(0))
        self.rows = np.concatenate([self.rows, found, *([np.array(more)] if more else [])])

    def bags(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Per text, an array with a row per sentence: the likeness of its closest word to each landmark."""
        for k in range(0, len(texts), 256):
            split = [sentences(t) for t in texts[k : k + 256]]
            new = {w for text in split for words in text for w in words if w not in self.row}
            if len(self.row) + len(new) > REMEMBERED:
                self.forget()
                new = {w for text in split for words in text for w in words}
            if new:
                self.learn(new)
            for text in split:
                if not text:
                    yield np.zeros((1, len(self.landmarks)), np.float32)
                    continue
                rows = np.array([self.row[w] for words in text for w in words])
                starts = np.cumsum([0] + [len(words) for words in text[:-1]])
                # In parts, so that a very long text needs little memory.
                cuts = np.r_[starts[:: 1 + 4096 // max(1, len(rows) // len(text))], len(rows)]
                parts = []
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    inside = starts[(starts >= a) & (starts < b)] - a
                    parts.append(np.maximum.reduceat(self.rows[rows[a:b]], inside, axis=0))
                yield np.concatenate(parts)


@dataclass(frozen=True)
class ToxicModel:
    """Landmarks, a weight for the likeness to each, and the logistic curve from margin to score."""

    landmarks: tuple[str, ...] = ()
    weights: tuple[float, ...] = ()
    bias: float = 0.0
    slope: float = 0.0
    level: float = -5.0

    def scorer(self) -> Callable[[list[str]], np.ndarray]:
        comparer, weights = Comparer(list(self.landmarks)), np.array(self.weights)

        def score(texts: list[str]) -> np.ndarray:
            if not self.landmarks:
                return np.full(len(texts), 1 / (1 + np.exp(-self.level)))
            margins = np.array([(bag @ weights).max() for bag in comparer.bags(texts)]) + self.bias
            return 1 / (1 + np.exp(-(self.slope * margins + self.level)))

        return score


def _landmarks(rows: DataFrame) -> list[str]:
    """The words that most toxic documents hold, words that cover the rest, and some drawn by hash.

    Each next covering word is the one that most toxic documents hold of which no earlier word is;
    once all are covered the count begins anew.
    """
    words = F.array_distinct(F.transform(F.split(F.lower("text"), r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")))
    places = rows.select("row", "label", F.explode(words).alias("word")).where(F.length("word").between(LENGTH + 1, 12))
    toxic, clean = rows.agg(F.sum("label"), F.sum(1 - F.col("label"))).first()
    by_word = places.groupBy("word").agg(
        F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"), F.collect_list(F.when(F.col("label") == 1, F.col("row"))).alias("held")
    ).where("toxic + clean >= 3")
    often = F.col("toxic") / toxic >= TIMES * (F.col("clean") + 1) / clean
    typical = by_word.where(often).orderBy(F.desc("toxic"), "clean", "word").limit(CANDIDATES).collect()
    others = by_word.drop("held").orderBy(F.xxhash64("word"), "word").limit(TYPICAL + OTHERS).collect()
    held = {r.word: set(r.held) for r in typical}
    chosen = list(held)[: TYPICAL // 3]
    covered: set[int] = set().union(*(held[w] for w in chosen))
    while len(chosen) < min(TYPICAL, len(held)):
        best = min((w for w in held if w not in chosen), key=lambda w: (-len(held[w] - covered), w))
        if not held[best] - covered:
            covered = set()
        chosen.append(best)
        covered |= held[best]
    return chosen + [r.word for r in others if r.word not in held][:OTHERS]


def _bag_rows(rows: DataFrame, landmarks: list[str], root: np.ndarray, weights: np.ndarray | None) -> DataFrame:
    """Columns label, stats and mapped: the likenesses of each document's closest words, or of those in
    its worst sentence, plain and by Nyström's map."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        comparer = Comparer(landmarks)
        for batch in batches:
            bags = comparer.bags(list(batch["text"]))
            found = [bag.max(0) if weights is None else bag[int((bag @ weights).argmax())] for bag in bags]
            mapped = [(f @ root).tolist() for f in found]
            yield pd.DataFrame({"label": batch["label"], "stats": [f.astype(float).tolist() for f in found], "mapped": mapped})

    return rows.select("label", "text").mapInPandas(each, "label int, stats array<double>, mapped array<double>")


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic") -> ToxicModel:
    """Learn from at most ``TRAIN_ROWS`` labelled documents outside the held-out fold.

    A document that occurs several times counts each time. With no labelled document, or all of one
    label, the model is a constant.
    """
    sample = label_sample(labels, target, TRAIN_ROWS)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.join(F.broadcast(sample), "doc_id").select("label", "text").repartition(12)
    rows = rows.withColumn("row", F.monotonically_increasing_id()).persist()
    try:
        n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
        if not 0 < toxic < n:
            return ToxicModel(level=5.0 if toxic else -5.0)
        landmarks = _landmarks(rows)
        if not landmarks:
            return ToxicModel(level=float(np.log(toxic / (n - toxic))))
        between = likeness(landmarks, landmarks).astype(float)
        values, vectors = np.linalg.eigh((between + between.T) / 2)
        root = vectors @ np.diag(np.maximum(values, 1e-3) ** -0.5) @ vectors.T
        weights, bias = None, 0.0
        for _ in range(2):
            bags = _bag_rows(rows, landmarks, root, weights).repartition(4).persist()
            weight = F.when(F.col("label") == 1, n / (2.0 * toxic)).otherwise(n / (2.0 * (n - toxic)))
            frame = bags.select("label", weight.alias("weight"), array_to_vector("mapped").alias("features")).persist()
            machine = LinearSVC(labelCol="label", weightCol="weight", regParam=RIDGE, maxIter=ITERATIONS, tol=1e-4).fit(frame)
            weights, bias = root @ machine.coefficients.toArray(), float(machine.intercept)
            frame.unpersist()
        margin = sum((F.col("stats")[i] * float(w) for i, w in enumerate(weights)), F.lit(bias))
        curve = LogisticRegression(labelCol="label", regParam=1e-3, maxIter=ITERATIONS)
        curve = curve.fit(bags.select("label", array_to_vector(F.array(margin)).alias("features")))
        bags.unpersist()
        return ToxicModel(tuple(landmarks), tuple(map(float, weights)), bias, float(curve.coefficients[0]), float(curve.intercept))
    finally:
        rows.unpersist()


def score_documents(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """Per document: doc_id, held_out, score and predicted; a null text counts as empty."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = model.scorer()
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": score(list(batch["text"]))})

    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), text_or_empty().alias("text"))
    scored = rows.mapInPandas(each, "doc_id string, score double").withColumn("doc_id", F.col("doc_id").cast("long"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
