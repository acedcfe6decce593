"""What the operators share: checkpoints in the shared folder, table reading, hash splits, text batches."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters of text that an Arrow-batched operator works on at once; bounds a Python worker's memory.
CHUNK_CHARS = 500_000
#: Rows of an Arrow batch of whole rows with their texts. Spark and the Python worker both hold it whole, and the worker its output too.
BATCH_ROWS, _BATCH_ROWS = 1_000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; fall back to a local folder only where it is unset and Spark is local."""
    sc = spark.sparkContext
    sc._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")  # a checkpoint's files go when nothing refers to it any more
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = os.path.join(tempfile.gettempdir(), "tessera-checkpoints")
    sc.setCheckpointDir(shared)


def small_batches(spark: SparkSession) -> str:
    """From now on Arrow batches of the session have at most ``BATCH_ROWS`` rows (fewer where it is set so). Returns the setting before; plans read it when they run."""
    before = spark.conf.get(_BATCH_ROWS)
    if not 0 < int(before) <= BATCH_ROWS:
        spark.conf.set(_BATCH_ROWS, str(BATCH_ROWS))
    return before


def batches_as_before(spark: SparkSession, before: str) -> None:
    spark.conf.set(_BATCH_ROWS, before)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of intermediate data, in whatever store it is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` by writing it to the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """True for rows whose crc32 of the id's decimal text leaves ``remainder``; those rows are never learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def text_chunks(batches: Iterator[pa.RecordBatch], text_col: str, limit: int = CHUNK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of Arrow batches with about ``limit`` characters of text each (a longer text makes a slice of its own); null texts come as ''."""
    for batch in batches:
        texts, start, size = [], 0, 0
        column = batch.column(batch.schema.get_field_index(text_col))
        for i in range(batch.num_rows):
            text = column[i].as_py() or ""
            if texts and size + len(text) > limit:
                yield batch.slice(start, i - start), texts
                texts, start, size = [], i, 0
            texts.append(text)
            size += len(text)
        if texts:
            yield batch.slice(start), texts


def smallest_by_hash(ids: DataFrame, per_key: int, max_keys: int) -> DataFrame:
    """At most ``per_key`` different ``_id`` of each ``_key``: those with the smallest hash. ``ids``: (_id, _key).

    Of more than ``max_keys`` keys, the most frequent ones count. Keys are counted first; then a bound on the
    hash lets some more than ``per_key`` ids of each key through to the ranking, whatever the size of ``ids``.
    """
    counts = ids.groupBy("_key").agg(F.approx_count_distinct("_id").alias("n")).orderBy(F.desc("n"), "_key").limit(max_keys).collect()
    whole, wanted = (1 << 63) - 1, 1.5 * per_key + 12 * per_key**0.5
    bounds = [(r["_key"], int(min(1.0, wanted / max(1, r["n"])) * (1 << 53)) * (1 << 10) - 1) for r in counts]
    few = ids.sparkSession.createDataFrame(bounds, f"_bounded {ids.schema['_key'].dataType.simpleString()}, _bound long")
    hashed = ids.withColumn("_hash", F.xxhash64("_id").bitwiseAND(F.lit(whole)))
    near = hashed.join(F.broadcast(few), F.col("_key") == F.col("_bounded")).where(F.col("_hash") <= F.col("_bound"))  # at most max_keys rows
    order = Window.partitionBy("_key").orderBy("_hash", "_id")
    return near.select("_id", "_key", "_hash").distinct().withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= per_key).select("_id", "_key")


def text_slice(text: str, id_col: str, limit: int) -> Column:
    """A text of at most ``limit`` characters, or so many of a longer one from a place that a hash of the id chooses."""
    n, begin = F.length(text), F.pmod(F.xxhash64(id_col), F.greatest(F.length(text) - limit + 1, F.lit(1)))
    return F.when(n <= limit, F.col(text)).otherwise(F.substr(F.col(text), (begin + 1).cast("int"), F.lit(limit)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, eligible: Column, per_class: int, max_chars: int) -> list[tuple[str, int, int]]:
    """(text, label, doc_id) of at most ``per_class`` labelled rows of either class, chosen by a hash of the id.

    Only ids of ``eligible`` rows that have a text are chosen from. Of a text over ``max_chars`` characters a slice
    is learnt from (scoring reads it whole), so that the driver holds at most ``2 * per_class * max_chars``
    characters. A document that occurs more than once, or whose labels disagree, counts once per (id, label).
    """
    ids = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_key")).where(F.col("_id").isNotNull() & F.col("_key").isin(0, 1))
    ids = ids.withColumnRenamed("_id", "doc_id").where(eligible).withColumnRenamed("doc_id", "_id")
    texts = docs.where(F.length("text") > 0).select("doc_id", "text")
    ids = checkpoint(ids.join(texts.select("doc_id"), F.col("_id") == F.col("doc_id"), "left_semi"))
    # at most 2 * per_class (id, label) pairs: a proven bound for the broadcast
    chosen = F.broadcast(smallest_by_hash(ids, per_class, 2).withColumnRenamed("_key", "_y"))
    rows = texts.join(chosen, F.col("doc_id") == F.col("_id")).select("doc_id", "_y", text_slice("text", "doc_id", max_chars).alias("text"))
    rows = rows.groupBy("doc_id", "_y").agg(F.min("text").alias("text"))
    return sorted(((r["text"], r["_y"], r["doc_id"]) for r in rows.collect()), key=lambda r: (r[2], r[1]))
