"""Secret scans whose false positives a random forest removes; built-in functions only.

Candidates are quoted values that are assigned to something, and long tokens with a digit. The forest
judges a candidate by its length, the transitions between its characters, how far dictionary words
cover it, the path of its document and the words beside it. It is compiled into a column expression, so
scanning and redacting are projections without a shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwright.llm.common import text_or_empty
from tillwright.llm.native_spans import spans

#: Labelled findings a forest is fitted on, at most.
TRAIN_ROWS = 20_000
#: Words that occur in most documents make up the dictionary.
DICTIONARY_WORDS = 5_000
TREES, DEPTH, SEED = 20, 5, 42
SECRET_FROM = 0.5
REDACTED = "[SECRET]"
AROUND = 32

NAMES = "token|secret|passw|pwd|api.?key|access.?key|private.?key|credential|auth|bearer"
TOKEN = r"(?<![\p{L}\p{N}+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+={0,2}(?![\p{L}\p{N}])"
QUOTED = r"""(?<=[=:] ?["'])[^"'\s]{8,}+(?=["'])"""
CANDIDATE = f"{QUOTED}|{TOKEN}"
TEST_PATH = r"(?i)test|example|fixture|sample|mock|doc"
CODE_PATH = r"(?i)\.(env|ya?ml|json|toml|ini|cfg|conf|py|js|ts|go|java|rb|sh)$"
CHANGES = "|".join(rf"(?<=[{kind}])(?=[^{kind}])" for kind in ("a-z", "A-Z", "0-9"))


def candidates(text: Column) -> Column:
    """Array of (start, end, value, before, after), the latter two being the text on either side."""
    found = spans(text, CANDIDATE, F.regexp_like(text, F.lit(r"""[0-9]|[=:] ?["']""")))

    def beside(c: Column) -> Column:
        before = F.substring(text, F.greatest(c["start"] - AROUND, F.lit(0)) + 1, F.least(c["start"], F.lit(AROUND)))
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), c["value"].alias("value"), before.alias("before"), F.substring(text, c["end"] + 1, F.lit(AROUND)).alias("after"))

    return F.transform(found, beside)


def _flag(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def features(c: Column, path: Column, words: list[str]) -> Column:
    """Numbers about a candidate, as an array."""
    value, size = c["value"], F.length(c["value"]).cast("double")
    runs = F.regexp_extract_all(value, F.lit("[A-Za-z]{3,}"), F.lit(0))
    known = F.filter(runs, lambda w: F.lower(w).isin(*words)) if words else F.slice(runs, 1, 0)
    covered = F.aggregate(known, F.lit(0), lambda n, w: n + F.length(w))
    left = F.lower(F.regexp_extract(c["before"], r"(\p{L}+)[^\p{L}]*$", 1))
    return F.array(
        size,
        F.regexp_count(value, F.lit(CHANGES)) / size,
        F.size(F.array_distinct(F.split(value, ""))) / F.least(size, F.lit(64.0)),
        F.regexp_count(value, F.lit("[0-9]")) / size,
        _flag(F.regexp_like(value, F.lit("(?i)^[0-9a-f]+$"))),
        covered / size,
        _flag(F.regexp_like(F.coalesce(path, F.lit("")), F.lit(TEST_PATH))),
        _flag(F.regexp_like(F.coalesce(path, F.lit("")), F.lit(CODE_PATH))),
        _flag(F.regexp_like(c["before"], F.lit(rf"(?i)({NAMES})[^\s]{{0,12}}\s*[=:]?\s*[\"']?$"))),
        _flag(F.regexp_like(c["before"], F.lit(r"""[=:]\s*["']?$"""))),
        _flag(F.regexp_like(c["before"], F.lit(r"""["']$""")) & F.regexp_like(c["after"], F.lit(r"""^["']"""))),
        _flag(left.isin(*words) if words else F.lit(False)),
    )


def weak_label(c: Column) -> Column:
    """1 for a varied value that is assigned, in quotes, to a credential's name; 0 for plain numbers,
    for words without a digit and for what is neither assigned nor quoted; else null."""
    value, size = c["value"], F.length(c["value"])
    named = F.regexp_like(c["before"], F.lit(rf"""(?i)({NAMES})\S{{0,12}}\s*[=:]\s*["']$"""))
    varied = F.size(F.array_distinct(F.split(value, ""))) >= F.least(size / 4, F.lit(8))
    plain = ~F.regexp_like(c["before"], F.lit(r"""[=:]\s*["']?$|["']$"""))
    number = F.regexp_like(value, F.lit("^[0-9_/+-]+$")) | ~F.regexp_like(value, F.lit("[0-9]"))
    return F.when(number | plain, 0.0).when(named & varied, 1.0)


def weak_findings(docs: DataFrame) -> DataFrame:
    """Labelled findings for training, at most ``TRAIN_ROWS`` drawn by hash: columns c, path, label."""
    rows = docs.select(text_or_empty().alias("text"), F.col("source").cast("string").alias("path"))
    found = rows.select("path", F.explode(candidates(F.col("text"))).alias("c"))
    labelled = found.select("c", "path", weak_label(F.col("c")).alias("label")).where("label is not null")
    return labelled.orderBy(F.xxhash64("c.value", "c.before", "path")).limit(TRAIN_ROWS)


def dictionary(docs: DataFrame) -> list[str]:
    """The words of three letters and more that most documents hold; ties in order of the alphabet."""
    words = F.array_distinct(F.split(F.lower(text_or_empty()), r"[^\p{L}]+"))
    counts = docs.select(F.explode(words).alias("word")).where("length(word) between 3 and 24").groupBy("word").count()
    return [r.word for r in counts.orderBy(F.desc("count"), "word").limit(DICTIONARY_WORDS).collect()]


@dataclass(frozen=True)
class Node:
    """A leaf with its value, or a split of a feature at a threshold."""

    value: float = 0.0
    feature: int = -1
    threshold: float = 0.0
    low: Node | None = None
    high: Node | None = None

    def column(self, stats: Column) -> Column:
        if self.low is None or self.high is None:
            return F.lit(self.value)
        return F.when(stats[self.feature] <= self.threshold, self.low.column(stats)).otherwise(self.high.column(stats))


def printed_trees(printed: str) -> list[Node]:
    """The trees of a printed forest."""
    lines = [x.strip() for x in printed.splitlines()]

    def node(at: int) -> tuple[Node, int]:
        if found := re.match(r"Predict: (\S+)", lines[at]):
            return Node(value=float(found[1])), at + 1
        split = re.match(r"If \(feature (\d+) <= (\S+)\)", lines[at])
        low, at = node(at + 1)
        high, at = node(at + 1)  # past the Else
        return Node(feature=int(split[1]), threshold=float(split[2]), low=low, high=high), at

    return [node(at + 1)[0] for at, line in enumerate(lines) if line.startswith("Tree ")]


@dataclass(frozen=True)
class SecretModel:
    """A forest and its dictionary; without trees, a candidate's weak label decides."""

    trees: tuple[Node, ...] = ()
    words: list[str] = field(default_factory=list)

    def score(self, c: Column, path: Column) -> Column:
        """Probability that a candidate is a secret."""
        if not self.trees:
            return F.coalesce(weak_label(c), F.lit(0.0))
        # The features are an array of one, so that all trees read them computed once.
        stats = F.array(features(c, path, self.words))
        votes = F.transform(stats, lambda s: reduce(lambda a, b: a + b, (tree.column(s) for tree in self.trees)))
        return votes[0] / len(self.trees)


def fit(findings: DataFrame, words: list[str]) -> SecretModel:
    """Learn from labelled findings (columns c, path, label); of a single label nothing is learned."""
    rows = findings.select("label", features(F.col("c"), F.col("path"), words).alias("stats"))
    rows = rows.repartition(4).persist()
    try:
        n, secrets = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
        if not 0 < secrets < n:
            return SecretModel(words=words)
        forest = RandomForestRegressor(
            labelCol="label", numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="onethird", maxBins=64, seed=SEED
        ).fit(rows.select("label", array_to_vector("stats").alias("features")))
        return SecretModel(tuple(printed_trees(forest.toDebugString)), words)
    finally:
        rows.unpersist()


def train(docs: DataFrame) -> SecretModel:
    return fit(weak_findings(docs), dictionary(docs))


def _scored(docs: DataFrame, model: SecretModel) -> Column:
    path = F.col("source").cast("string")
    return F.transform(candidates(text_or_empty()), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["value"].alias("value"), model.score(c, path).alias("score")))


def findings(docs: DataFrame, model: SecretModel) -> DataFrame:
    """A row per candidate: doc_id, start, end (code points, end exclusive), sha256, score, is_secret.

    Null and empty texts have none; rows repeat where documents do.
    """
    rows = docs.select("doc_id", F.explode(_scored(docs, model)).alias("c"))
    return rows.select(
        "doc_id", "c.start", "c.end", F.sha2(F.col("c.value").cast("binary"), 256).alias("sha256"), F.round("c.score", 6).alias("score"),
        (F.col("c.score") >= SECRET_FROM).cast("int").alias("is_secret"),
    )


def redact(docs: DataFrame, model: SecretModel) -> DataFrame:
    """The documents with ``REDACTED`` in place of each secret and n_chars counted anew; no shuffle.

    Null texts stay null and empty ones empty; rows without a secret and all other columns stay as they are,
    repeated rows are repeated, and an empty table gives no rows.
    """
    text = F.col("text").cast("string")
    secrets = F.filter(_scored(docs, model), lambda c: c["score"] >= SECRET_FROM)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(seen: Column, c: Column) -> Column:
        return F.struct(c["end"].alias("at"), F.concat(seen["out"], F.substring(text, seen["at"] + 1, c["start"] - seen["at"]), F.lit(REDACTED)).alias("out"))

    def finish(seen: Column) -> Column:
        return F.when(seen["at"] == 0, text).otherwise(F.concat(seen["out"], F.substring(text, seen["at"] + 1, F.length(text))))

    clean = docs.withColumn("text", F.when(text.isNull(), text).otherwise(F.aggregate(secrets, start, step, finish)))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean
