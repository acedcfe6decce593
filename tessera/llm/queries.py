"""The thin ``opN_<name>`` queries: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, gif, language_id, licenses, packing, pieces, quality, simhash, token_count, toxicity, wfst
from ._runtime import held_out, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, apart = table(spark, sf_dir, "documents"), held_out("doc_id", 4, 2)
    model = language_id.train_crf(language_id.training_rows(docs, ~apart))
    return language_id.identify(docs, model).select("doc_id", apart.alias("held_out"), "lang_pred", "score")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, apart = table(spark, sf_dir, "documents"), held_out("doc_id", 3, 1)
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~apart)
    return quality.score(docs, model).select("doc_id", apart.alias("held_out"), "score", "predicted")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op4_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), pieces.model_path())


def op5_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.read_payloads(gif.store_texts(table(spark, sf_dir, "documents")))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = pieces.model_path()
    return wfst.digest(wfst.encode(table(spark, sf_dir, "documents"), path), path)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), packing.tokenizer_path())


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_components(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, apart = table(spark, sf_dir, "documents"), held_out("doc_id", 5, 0)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~apart)
    return toxicity.score(docs, model).select("doc_id", apart.alias("held_out"), "score", "predicted")


QUERIES = {f.__name__: f for f in (op1_language_id, op2_quality, op3_exact_dedup, op4_token_count, op5_gif, op6_sentencepiece, op7_license_scan, op8_packing, op9_simhash, op10_toxicity)}
