"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow trees are grown on labelled documents; each path from a root to a node is a conjunctive rule
over the statistics. A logistic model with lasso penalty keeps few of them, and the kept rules with
their weights are compiled into one column expression, so scoring is a projection inside the scan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwright.llm.common import fresh_name, held_out, label_sample, text_or_empty

#: Labelled documents a model is fitted on, at most.
TRAIN_ROWS = 20_000
TREES, DEPTH, SEED = 24, 3, 42
LASSO = 0.001
ITERATIONS = 60
#: A document is kept from this score on.
KEEP_FROM = 0.3


def statistics(text: Column) -> Column:
    """An array of numbers that describe a text without nulls; they are finite for any text."""
    size = F.greatest(F.length(text), F.lit(1))
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    lines = F.split(text, "\n")
    n_words = F.greatest(F.size(words), F.lit(1))
    counts = [
        (r"\p{Lu}", size),
        (r"\p{Nd}", size),
        (r"[^\p{L}\p{N}\s.,]", size),
        (r"\.(?=\s|$)", n_words),
        (",", n_words),
        (r"(?<!\S)(\S++)\s+\1(?!\S)", n_words),
    ]
    return F.array(
        F.log1p(F.size(words).cast("double")),
        size / n_words,
        F.size(F.array_distinct(words)) / n_words,
        F.size(F.array_distinct(lines)) / F.size(lines),
        F.size(words) / F.size(lines),
        *(F.regexp_count(text, F.lit(pattern)) / of for pattern, of in counts),
    )


@dataclass(frozen=True, order=True)
class Condition:
    feature: int
    above: bool
    threshold: float

    def holds(self, stats: Column) -> Column:
        value = stats[self.feature]
        return value > self.threshold if self.above else value <= self.threshold


Rule = tuple[Condition, ...]


def tree_rules(printed: str) -> list[Rule]:
    """The conjunction that leads to each node, but the roots, of a printed forest."""
    rules: list[Rule] = []
    path: list[tuple[int, Condition]] = []
    for line in printed.splitlines():
        found = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if found:
            depth = len(found[1])
            path = [step for step in path if step[0] < depth]
            path.append((depth, Condition(int(found[2]), found[3] == ">", float(found[4]))))
            rules.append(tuple(condition for _, condition in path))
    return rules


@dataclass(frozen=True)
class RuleModel:
    """Weighted rules and an intercept; a model without rules scores every text alike."""

    intercept: float
    rules: tuple[tuple[Rule, float], ...] = ()

    def score(self, stats: Column) -> Column:
        """Probability that a text with these statistics is good."""
        fired = [F.when(_all_hold(rule, stats), weight).otherwise(0.0) for rule, weight in self.rules]
        return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, fired, F.lit(self.intercept))))


def _all_hold(rule: Rule, stats: Column) -> Column:
    return reduce(lambda a, b: a & b, (condition.holds(stats) for condition in rule))


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality") -> RuleModel:
    """Learn from at most ``TRAIN_ROWS`` labelled documents outside the held-out fold.

    Documents without a label, and labels without a document, are no part of the fit; a document that
    occurs several times counts each time. With no labelled document, or all of one label, the model
    is a constant.
    """
    sample = label_sample(labels, target, TRAIN_ROWS)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.join(F.broadcast(sample), "doc_id").select("label", statistics(F.col("text")).alias("stats"))
    rows = rows.repartition(4).persist()  # a bounded sample: many short iterations, so few tasks
    try:
        n, good = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
        if not 0 < good < n:
            return RuleModel(0.0 if n == 0 else 5.0 if good else -5.0)
        forest = RandomForestClassifier(
            labelCol="label", numTrees=TREES, maxDepth=DEPTH, subsamplingRate=0.5, featureSubsetStrategy="onethird",
            minInstancesPerNode=5, maxBins=64, seed=SEED,
        ).fit(rows.select("label", array_to_vector("stats").alias("features")))
        rules = sorted({tuple(sorted(rule)) for rule in tree_rules(forest.toDebugString)})
        if not rules:
            return RuleModel(0.0)
        fired = F.array(*(_all_hold(rule, F.col("stats")).cast("double") for rule in rules))
        lasso = LogisticRegression(labelCol="label", elasticNetParam=1.0, regParam=LASSO, maxIter=ITERATIONS, tol=1e-4)
        model = lasso.fit(rows.select("label", array_to_vector(fired).alias("features")))
        kept = tuple((rule, float(w)) for rule, w in zip(rules, model.coefficients, strict=True) if w)
        return RuleModel(float(model.intercept), kept)
    finally:
        rows.unpersist()


def score_documents(docs: DataFrame, model: RuleModel) -> DataFrame:
    """Per document: doc_id, held_out, score and predicted; a null text counts as empty."""
    stats = docs.select(F.col("doc_id"), statistics(text_or_empty()).alias("stats"))
    scored = stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score(F.col("stats")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= KEEP_FROM).cast("int"))


def keep_good(docs: DataFrame, model: RuleModel) -> DataFrame:
    """The documents whose score reaches ``KEEP_FROM``, with all their columns."""
    stats = fresh_name(docs, "stats")
    return docs.withColumn(stats, statistics(text_or_empty())).where(model.score(F.col(stats)) >= KEEP_FROM).drop(stats)
