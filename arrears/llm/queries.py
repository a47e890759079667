"""Registered queries of this subpackage: each applies one operator, with production
parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from arrears.llm import (bpe_dp, crf_lang, exact_dedup, filter_audit, lsh_forest, packing, pii, resampling, spann, token_store, toxicity,
                         url_lm, warc)
from arrears.llm.common import table
from arrears.llm.tokens import tokenizer_path

Query = Callable[[SparkSession, str], DataFrame]


def op1_bpe_prefix_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_dp.digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op3_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_duplicates(table(spark, sf_dir, "documents"))


def op4_spann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spann.search(table(spark, sf_dir, "embeddings"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


def op7_url_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_lm.judge(table(spark, sf_dir, "pages"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.round_trip(spark, table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op9_lp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op10_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return crf_lang.identify(docs, crf_lang.train(docs))


def op11_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.digests(docs, pii.train(docs))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_bpe_prefix_dp, op2_exact_dedup, op3_lsh_forest, op4_spann, op5_toxicity, op6_warc, op7_url_model, op8_token_store, op9_lp_packing,
    op10_crf_language, op11_pii_crf, op12_filter_audit, op13_importance_resampling)}

ORACLES: dict[str, str] = {"op2_exact_dedup": exact_dedup.SQL, "op6_warc": warc.SQL, "op12_filter_audit": filter_audit.SQL,
                           "op13_importance_resampling": resampling.SQL}
