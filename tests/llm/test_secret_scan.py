"""Candidates, the forest's column form and redaction."""

import random
import re

from corpus_fixtures import make_docs, table  # noqa: F401
from pyspark.sql import functions as F

from tillwright.llm import secret_scan as ss
from tillwright.llm.native_spans import spans

HEX = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"


def test_spans_count_code_points(spark, make_docs):
    texts = ["", "ab😀12é345", "1", "12\n34", "x" * 40_000 + "77", "1 2 3 " * 500]
    rows = make_docs(list(enumerate(texts))).select("text", spans(F.col("text"), "[0-9]++").alias("s")).collect()
    for row in rows:
        assert [(s.start, s.end, s.value) for s in row.s] == [(*m.span(), m.group()) for m in re.finditer("[0-9]+", row.text)]


def test_planted_tokens_against_a_loop(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = ss.train(docs)
    planted = re.compile(r'(?i)token = "([0-9a-f]{40})"')
    want = {(r.doc_id, *m.span(1)) for r in docs.collect() for m in planted.finditer(r.text)}
    rows = ss.findings(docs, model).collect()
    assert {(r.doc_id, r.start, r.end) for r in rows if r.is_secret} == want and want
    assert any(not r.is_secret for r in rows)
    clean = {r.doc_id: r.text for r in ss.redact(docs, model).collect()}
    for row in docs.collect():
        assert clean[row.doc_id] == planted.sub(lambda m: m.group().replace(m[1], ss.REDACTED), row.text)


def test_forest_in_columns_is_the_forest(spark):
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import RandomForestRegressor

    rng = random.Random(5)
    points = [[rng.random(), rng.random()] for _ in range(300)]
    frame = spark.createDataFrame([(p, float(p[0] * p[1] > 0.3)) for p in points], "stats array<double>, label double")
    frame = frame.withColumn("features", array_to_vector("stats"))
    model = RandomForestRegressor(numTrees=4, maxDepth=4, seed=1).fit(frame)
    trees = ss.printed_trees(model.toDebugString)
    ours = sum((t.column(F.col("stats")) for t in trees), F.lit(0.0)) / len(trees)
    worst = model.transform(frame).select(F.max(F.abs(F.col("prediction") - ours))).first()[0]
    assert len(trees) == 4 and worst < 1e-9


def test_odd_rows(spark, make_docs):
    pairs = [(1, None), (2, ""), (None, f'api_key: "{HEX}"'), (3, f'token = "{HEX}"'), (3, f'token = "{HEX}"'), (4, "a1" * 100_000), (5, "1234567890123456 " * 30), (6, f"commit {HEX} merged"), (7, 'name = "Gutenberg"')]
    docs = make_docs(pairs)
    for model in (ss.train(docs), ss.SecretModel()):
        found = [r for r in ss.findings(docs, model).collect() if r.is_secret]
        assert {(r.doc_id, r.start) for r in found} == {(None, 10), (3, 9)} and len(found) == 3
        clean = ss.redact(docs, model)
        assert clean.columns == docs.columns
        rows = clean.collect()
        assert [r.text for r in rows[:4]] == [None, "", 'api_key: "[SECRET]"', 'token = "[SECRET]"']
        assert [r.n_chars for r in rows[:4]] == [None, 0, 19, 18] and rows[5].text == "a1" * 100_000
    empty = make_docs([])
    assert ss.findings(empty, ss.train(empty)).count() == ss.redact(empty, ss.train(empty)).count() == 0
