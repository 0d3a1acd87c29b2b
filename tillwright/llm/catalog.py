"""The corpus operators as named queries over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwright.llm import (
    adaptive_codes,
    bm25,
    bpe_trie,
    decontaminate,
    html_consensus,
    link_trust,
    pii,
    recursive_bpe,
    rule_quality,
    secret_scan,
    simhash,
    token_alignment,
    toxic_kernel,
)
from tillwright.llm.common import read_table

VOCABULARY = "byte_bpe_50k.json"
RANK_FILE = "byte_bpe_multi_50k.tiktoken"
PIECE_MODEL = "piece_bpe_32k.model"

Query = Callable[[SparkSession, str], DataFrame]


def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return rule_quality.score_documents(docs, rule_quality.fit(docs, labels))


def bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_trie.token_digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that disclose personal data are weighed over whole documents and marked in all of them."""
    return pii.personal_data(read_table(spark, sf_dir, "documents"), around=None)


def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return secret_scan.findings(docs, secret_scan.train(docs))


def main_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_consensus.main_texts(read_table(spark, sf_dir, "pages"))


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return toxic_kernel.score_documents(docs, toxic_kernel.fit(docs, labels))


def url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_trust.judge(read_table(spark, sf_dir, "pages"))


def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is divisible by 20, as a query against all documents."""
    docs = read_table(spark, sf_dir, "documents")
    queries = docs.where(F.col("doc_id") % 20 == 0).select(F.col("doc_id").alias("query_id"), "text")
    return bm25.search(docs, queries)


def token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return token_alignment.link_documents(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.path(PIECE_MODEL))


def byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recursive_bpe.token_digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path(RANK_FILE))


def vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adaptive_codes.compress(read_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_pii": personal_data,
    "op2_html_extraction": main_texts,
    "op3_toxicity": toxicity,
    "op4_secret_scans": secrets,
    "op5_bpe": bpe,
    "op6_top_k_search": top_k,
    "op7_simhash_near_dedup": near_duplicates,
    "op8_benchmark_decontamination": decontamination,
    "op9_url_filters": url_verdicts,
    "op10_quality_classifier": quality_classifier,
    "op11_cross_tokenizer_alignment": token_links,
    "op12_byte_level_bpe": byte_level_bpe,
    "op13_vector_code_compression": vector_codes,
}

ORACLE: dict[str, str] = {"op6_top_k_search": bm25.ORACLE, "op13_vector_code_compression": adaptive_codes.ORACLE}
