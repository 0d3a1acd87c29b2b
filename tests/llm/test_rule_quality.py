"""Rules, their compilation and held-out accuracy."""

import math

from corpus_fixtures import make_docs, table  # noqa: F401
from pyspark.sql import functions as F

from tillwright.llm import rule_quality
from tillwright.llm.rule_quality import Condition, RuleModel, tree_rules

PRINTED = """RandomForestClassificationModel: numTrees=1
  Tree 0 (weight 1.0):
    If (feature 0 <= 2.5)
     If (feature 3 <= -1.0E-4)
      Predict: 0.0
     Else (feature 3 > -1.0E-4)
      Predict: 1.0
    Else (feature 0 > 2.5)
     Predict: 1.0
"""


def test_paths_become_rules():
    low, high = Condition(0, False, 2.5), Condition(0, True, 2.5)
    assert tree_rules(PRINTED) == [(low,), (low, Condition(3, False, -1e-4)), (low, Condition(3, True, -1e-4)), (high,)]


def test_compiled_score_is_the_logistic_sum(spark):
    model = RuleModel(-0.5, (((Condition(0, True, 1.0), Condition(1, False, 4.0)), 2.0), ((Condition(1, True, 3.0),), -1.0)))
    frame = spark.createDataFrame([([2.0, 4.0],), ([1.0, 4.0],), ([2.0, 5.0],)], "stats array<double>")
    got = [r[0] for r in frame.select(model.score(F.col("stats"))).collect()]
    want = [1 / (1 + math.exp(-z)) for z in (-0.5 + 2 - 1, -0.5 - 1, -0.5 - 1)]
    assert all(abs(a - b) < 1e-12 for a, b in zip(got, want, strict=True))


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = rule_quality.score_documents(docs, rule_quality.fit(docs, labels)).join(labels, "doc_id").where("held_out")
    right, n, kept, good = scored.agg(
        F.sum((F.col("predicted") == F.col("quality")).cast("int")), F.count("*"),
        F.sum(F.col("predicted") * F.col("quality")), F.sum("quality"),
    ).first()
    assert right / n > 0.9 and kept / good > 0.95


def test_odd_rows(spark, make_docs):
    docs = make_docs([(1, None), (1, ""), (None, "a b"), (2, "x" * 300_000), (3, "Re " * 50_000)])
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 1), (9, None, 1)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        model = rule_quality.fit(docs, some)
        rows = rule_quality.score_documents(docs, model).collect()
        assert len(rows) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
        assert rule_quality.keep_good(docs, model).columns == docs.columns
    assert rule_quality.score_documents(make_docs([]), rule_quality.fit(make_docs([]), labels)).collect() == []
