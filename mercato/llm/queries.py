"""The registered queries of the training-data operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mercato.llm import (
    exact_dedup,
    merkle,
    minhash,
    mixing,
    ngram_lm,
    pieces,
    pii,
    quotes,
    span_dedup,
    token_counts,
    topk,
    toxicity,
    whitening,
)
from mercato.llm.common import read


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), k=5, modulo=50)


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(read(spark, sf_dir, "documents"), k=2, percent=80)


def op3_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_dedup.remove_repeats(read(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(read(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.reply_threads(read(spark, sf_dir, "conversations"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(read(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.lm_scores(read(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(read(spark, sf_dir, "documents"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk": op1_topk,
    "op2_minhash": op2_minhash,
    "op3_span_dedup": op3_span_dedup,
    "op4_mixing": op4_mixing,
    "op5_pii": op5_pii,
    "op6_toxicity": op6_toxicity,
    "op7_quotation_linking": op7_quotation_linking,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_merkle": op11_merkle,
    "op12_token_counts": op12_token_counts,
    "op13_whitening": op13_whitening,
}
ORACLE: dict[str, str] = {
    "op1_topk": topk.TOP_K_SQL,
    "op9_exact_dedup": exact_dedup.EXACT_SQL,
    "op10_lm_scoring": ngram_lm.LM_SQL,
    "op11_merkle": merkle.MERKLE_SQL,
}
