"""The corpus pipeline: toxicity, quality, exact dedup, SimHash near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; its output is written as Parquet
and read again as the next stage's docs. All but the last return the columns of ``documents``. Stages whose texts
go to Python set the session's Arrow batches to ``BATCH_ROWS`` rows; ``run`` sets them back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact_dedup, packing, quality, simhash, toxicity
from tessera.llm._runtime import batches_as_before, delete, ensure_checkpoint_dir, held_out, small_batches, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of ``docs`` that are not called toxic, by a model learnt from ``labels`` of rows that are not held out.

    Null and empty texts get the score of the bias; repeated rows stay or go together; other columns are carried
    along. Where the labels do not have both classes, and of an empty table, nothing is dropped.
    """
    small_batches(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id", 5, 0))
    return toxicity.keep(docs, model)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of ``docs`` that are not called of low quality, by a model learnt from ``labels`` of rows that are not held out; else as ``drop_toxic``."""
    small_batches(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id", 3, 1))
    return quality.keep(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, null counting as empty: the one with the smallest id, once also where it is repeated. An empty table stays empty."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies: the one with the smallest id, once also where it is repeated. Texts without a word are near copies of each other. An empty table stays empty."""
    small_batches(spark)
    return simhash.drop_near_copies(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all ``docs`` with their places in sequences of 2,048 ids; null and empty texts have the end id alone. An empty table gives no rows."""
    small_batches(spark)
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("exact_dedup", drop_exact_copies),
    ("simhash", drop_near_copies),
    ("packing", pack),
]

#: Trained models and fingerprints are not SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again; a stage's output goes when the next one is written."""
    docs = table(spark, sf_dir, "documents")
    ensure_checkpoint_dir(spark)
    base = spark.sparkContext._jsc.sc().getCheckpointDir().get() + f"/pipeline-{uuid.uuid4().hex}"
    done, before = None, small_batches(spark)
    try:
        for name, stage in STAGES:
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
            docs = spark.read.parquet(f"{base}/{name}")
            if done:
                delete(spark, done)
            done = f"{base}/{name}"
    finally:
        batches_as_before(spark, before)
    return docs
