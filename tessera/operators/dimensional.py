"""Dimensional modelling: surrogate keys, date dimension, slowly changing dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def surrogate_key(*columns: str) -> Column:
    """SHA-256 of the values joined by '|', null as 'None'."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in columns]), 256)


def hashed_key(*columns: str) -> Column:
    """MD5 of the values joined by '-', null as a fixed word: the recipe of SQL model packages."""
    return F.md5(F.concat_ws("-", *[F.coalesce(F.col(c).cast("string"), F.lit("_dbt_utils_surrogate_key_null_")) for c in columns]))


def date_dim(spark: SparkSession, start: str, end: str) -> DataFrame:
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date"))
    part = lambda f: f("date").cast("long")
    return days.select("date", part(F.year).alias("year"), part(F.month).alias("month"), part(F.day).alias("day"), part(F.weekday).alias("dow"), (F.weekday("date") >= 5).alias("is_weekend"))


def scd2_snapshot(current: DataFrame, previous: DataFrame, key: str, columns: list[str], at: str) -> DataFrame:
    """History (key, columns, valid_from, valid_to, is_current) moved on to ``current``.

    Unchanged keys keep their row, changed ones close at ``at`` and get a new version, new ones begin, keys that
    are gone stay current. Comparison is null-safe. ``current`` must have each key once.
    """
    if not current.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError("a key occurs twice in the current rows")
    begin, kind = F.lit(at).cast("timestamp"), previous.schema["valid_from"].dataType
    closed = previous.where(~F.col("is_current"))
    was = previous.where("is_current")
    now = current.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    both = was.join(now, F.col(key).eqNullSafe(F.col("_k")), "full_outer")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_new_{c}"))
    had, has = F.col("valid_from").isNotNull(), F.col("_k").isNotNull()
    old = F.struct(F.col(key), *columns, "valid_from", F.when(has & ~same, begin.cast(kind)).otherwise(F.col("valid_to")).alias("valid_to"), (~(has & ~same)).alias("is_current"))
    new = F.struct(F.col("_k").alias(key), *[F.col(f"_new_{c}").alias(c) for c in columns], begin.cast(kind).alias("valid_from"), F.lit(None).cast(kind).alias("valid_to"), F.lit(True).alias("is_current"))
    versions = F.filter(F.array(F.when(had, old), F.when(has & (~had | ~same), new)), lambda v: v.isNotNull())
    return both.select(F.inline(versions)).unionByName(closed.select(key, *columns, "valid_from", "valid_to", "is_current"))


def as_of_join(facts: DataFrame, history: DataFrame, key: str, ts: str) -> DataFrame:
    """Facts with the version valid at their time (valid_from <= t < valid_to); facts without one stay, with nulls."""
    h = history.withColumnRenamed(key, "_hk")
    valid = (F.col(ts) >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col(ts) < F.col("valid_to")))
    return facts.join(h, (F.col(key) == F.col("_hk")) & valid, "left").drop("_hk")
