"""Sinks: Parquet, tables, Kafka messages, per-batch writers, GeoJSON-like records, model runs."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOG = logging.getLogger("tessera.alerts")


def write_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_monthly_lake(df: DataFrame, path: str, ts: str = "ts") -> None:
    """Parquet partitioned by year and month, dealt by month first so that each folder gets few files."""
    rows = df.withColumns({"year": F.year(ts), "month": F.date_format(ts, "MM")})
    rows.repartition("year", "month").write.mode("overwrite").partitionBy("year", "month").parquet(path)


def save_table(df: DataFrame, name: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).saveAsTable(name)


def kafka_messages(df: DataFrame, key: str) -> DataFrame:
    """(key, value) with the whole row as JSON, as Kafka's sink takes them."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def produce(df: DataFrame, key: str, topic: str, servers: str) -> None:
    kafka_messages(df, key).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def alert_payload(*columns: str) -> Column:
    return F.to_json(F.struct(*columns))


def log_alerts(batch: DataFrame, _: int) -> None:
    """For foreachBatch: every alert at level WARNING, on the executor that has it."""
    batch.foreach(lambda row: LOG.warning("alert %s", row.asDict()))


def stream_to_parquet(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def stream_to_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"):
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def best_run(runs: DataFrame, metric: str, run_id: str = "run_id") -> DataFrame:
    """The run with the largest metric, the smallest id of equals."""
    return runs.where(F.col(metric).isNotNull()).orderBy(F.desc(metric), run_id).limit(1)
