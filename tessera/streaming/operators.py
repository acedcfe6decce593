"""Structured Streaming forms of the event operators. Event times must be timestamps with time zone (see ``event_time``)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import event_time


def parquet_stream(spark: SparkSession, pattern: str, like: str, files_per_batch: int | None = None) -> DataFrame:
    """Stream over Parquet files that match a pattern, with the schema of the file or folder ``like``."""
    reader = spark.readStream.schema(spark.read.parquet(like).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return event_time(reader.parquet(pattern))


def minute_counts(events: DataFrame, delay: str = "2 minutes", width: str = "1 minute", ts: str = "ts") -> DataFrame:
    return events.withWatermark(ts, delay).groupBy(F.window(ts, width).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "n")


def sessions(events: DataFrame, user: str, gap: str = "30 minutes", delay: str = "2 minutes", ts: str = "ts") -> DataFrame:
    s = events.withWatermark(ts, delay).groupBy(user, F.session_window(ts, gap).alias("w")).agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count(F.lit(1)).alias("n"))
    return s.select(user, "started", "ended", "n")


def dedupe(events: DataFrame, keys: list[str], delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def cooldown_alerts(candidates: DataFrame, key: str, cooldown_s: float, ts: str = "ts") -> DataFrame:
    """(key, ts, suppressed) of alerts that fire: a key's first, then each at least ``cooldown_s`` after the last; suppressed counts those in between.

    The state of a key is two numbers; a key's rows of one batch are put in time order before they are judged.
    """

    def run(group: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, suppressed = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values("_t", kind="stable")
        out = []
        for t in rows["_t"]:
            if last is None or t >= last + cooldown_s:
                out.append((group[0], t, suppressed))
                last, suppressed = float(t), 0
            else:
                suppressed += 1
        state.update((last, suppressed))
        yield pd.DataFrame(out, columns=[key, "t", "suppressed"])

    kind = candidates.schema[key].dataType.simpleString()
    rows = candidates.select(key, (F.unix_micros(ts) / 1e6).alias("_t"))
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, t double, suppressed long", "last double, suppressed long", "append", "NoTimeout")


def run_to_end(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a query over all that its source has now, into Parquet, and read it back. ``folder`` must be shared."""
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")
