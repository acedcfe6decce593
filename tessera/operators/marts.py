"""Cleaning and marts over trip-like facts: ``ts, end_ts, fare, tip, passengers, payment``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Lower bounds of the duration bands, left-closed.
DURATION_BANDS = ((0, "0-5"), (5, "5-10"), (10, "10-20"), (20, "20-30"), (30, "30-60"), (60, "60+"))


def clean_trips(df: DataFrame, fare_cap: float = 500.0) -> DataFrame:
    minutes = (F.unix_micros(F.col("end_ts").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 6e7
    rows = df.withColumn("trip_minutes", minutes)
    return rows.where((F.col("fare") > 0) & (F.col("passengers") > 0) & (F.col("trip_minutes") > 0) & (F.col("fare") <= fare_cap)).withColumn("tip_pct", F.try_divide("tip", "fare"))


def hourly_demand(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.groupBy(F.hour(ts).cast("long").alias("hour")).agg(F.count(F.lit(1)).alias("trips"))


def demand_by_dow(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Monday is 0."""
    return df.groupBy(F.weekday(ts).cast("long").alias("dow")).agg(F.count(F.lit(1)).alias("trips"))


def tip_rate_by_payment(df: DataFrame) -> DataFrame:
    return df.where(F.col("payment").isNotNull()).groupBy("payment").agg(F.avg("tip_pct").alias("tip_rate"))


def fare_summary(df: DataFrame) -> DataFrame:
    """One row, also for an empty input; the median is exact."""
    return df.agg(F.count(F.lit(1)).alias("trips"), F.avg("fare").alias("mean_fare"), F.median("fare").alias("median_fare"), F.avg("trip_minutes").alias("mean_minutes"))


def duration_band(minutes: Column) -> Column:
    out = F.lit(None).cast("string")
    for low, name in DURATION_BANDS:
        out = F.when(minutes >= low, name).otherwise(out)
    return out


def trip_duration_buckets(df: DataFrame) -> DataFrame:
    """Trips by duration band, every band present."""
    counts = df.groupBy(duration_band(F.col("trip_minutes")).alias("band")).agg(F.count(F.lit(1)).alias("n"))
    bands = df.sparkSession.createDataFrame([(i, name) for i, (_, name) in enumerate(DURATION_BANDS)], "band_order int, band string")
    return bands.join(counts, "band", "left").select("band", "band_order", F.coalesce("n", F.lit(0).cast("long")).alias("trips"))


def revenue_by_day(df: DataFrame) -> DataFrame:
    return df.groupBy(F.to_date("ts").alias("day")).agg(F.sum(F.col("fare") + F.col("tip")).alias("revenue"))


def iqr_flags(df: DataFrame, columns: tuple[str, ...] = ("fare", "trip_minutes"), factor: float = 1.5) -> DataFrame:
    """Rows with ``<column>_outlier`` and ``is_outlier``: strictly outside the quartile fences; no spread, no flags. Quartiles are one row."""
    q = df.agg(*[F.percentile(c, F.array(F.lit(0.25), F.lit(0.75))).alias(f"_q_{c}") for c in columns])
    out = df.crossJoin(F.broadcast(q))
    for c in columns:
        low, high = F.col(f"_q_{c}")[0], F.col(f"_q_{c}")[1]
        outside = (high > low) & ((F.col(c) < low - factor * (high - low)) | (F.col(c) > high + factor * (high - low)))
        out = out.withColumn(f"{c}_outlier", F.coalesce(outside, F.lit(False)))
    any_of = F.lit(False)
    for c in columns:
        any_of = any_of | F.col(f"{c}_outlier")
    return out.withColumn("is_outlier", any_of).drop(*[f"_q_{c}" for c in columns])


def monthly_summary(df: DataFrame) -> DataFrame:
    """Daily station rows (station, date, tmean, tmin, tmax, precip) by month."""
    return df.groupBy("station", F.year("date").cast("long").alias("year"), F.month("date").cast("long").alias("month")).agg(
        F.avg("tmean").alias("avg_tmean"), F.min("tmin").alias("min_tmin"), F.max("tmax").alias("max_tmax"), F.sum("precip").alias("total_precip"),
        F.count_if(F.col("precip") >= 1.0).alias("rain_days"), F.count(F.lit(1)).alias("record_count"),
    )


def rating_by_type(df: DataFrame, kind: str, rating: str, votes: str, band: str) -> DataFrame:
    return df.groupBy(kind).agg(
        F.count(F.lit(1)).alias("titles"), F.round(F.avg(rating), 3).alias("avg_rating"), F.sum(votes).alias("votes"), F.avg(F.when(F.col(band) == "high", 1.0).otherwise(0.0)).alias("high_share")
    )


def rating_band(rating: Column) -> Column:
    return F.when(rating >= 8, "high").when(rating >= 5, "medium").otherwise("low")
