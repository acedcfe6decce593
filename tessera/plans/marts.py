"""Queries over trip-like facts, daily summaries and layered models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalogue import query
from tessera.operators import dimensional, marts
from tessera.sources.tables import table

from .inputs import DAYS, TRIPS, days, rounded, trips


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.clean_trips(trips(spark, sf_dir))


@query(f"WITH {TRIPS} SELECT count(*) AS n, sum(round(trip_minutes)) AS minutes, round(sum(tip_pct), 4) AS tip_pct FROM clean")
def clean_trips(spark, sf_dir):
    return _clean(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.sum(F.round("trip_minutes")).alias("minutes"), F.round(F.sum("tip_pct"), 4).alias("tip_pct"))


@query("SELECT extract(hour FROM ts)::BIGINT AS hour, count(*) AS trips FROM events GROUP BY 1")
def hourly_demand(spark, sf_dir):
    return marts.hourly_demand(table(spark, sf_dir, "events"))


@query("SELECT (isodow(ts) - 1)::BIGINT AS dow, count(*) AS trips FROM events GROUP BY 1")
def demand_by_dow(spark, sf_dir):
    return marts.demand_by_dow(table(spark, sf_dir, "events"))


@query(f"WITH {TRIPS} SELECT payment, round(avg(tip_pct), 6) AS tip_rate FROM clean WHERE payment IS NOT NULL GROUP BY 1")
def tip_rate_by_payment(spark, sf_dir):
    return rounded(marts.tip_rate_by_payment(_clean(spark, sf_dir)), "tip_rate")


@query(f"WITH {TRIPS} SELECT count(*) AS trips, round(avg(fare), 4) AS mean_fare, round(median(fare), 4) AS median_fare, round(avg(trip_minutes), 4) AS mean_minutes FROM clean")
def fare_summary(spark, sf_dir):
    return rounded(marts.fare_summary(_clean(spark, sf_dir)), "mean_fare", "median_fare", "mean_minutes", digits=4)


@query(f"""WITH {TRIPS}, bands(band_order, low, high, band) AS (VALUES (0, 0, 5, '0-5'), (1, 5, 10, '5-10'), (2, 10, 20, '10-20'), (3, 20, 30, '20-30'), (4, 30, 60, '30-60'), (5, 60, 1e9, '60+'))
SELECT band, band_order, count(ts) AS trips FROM bands LEFT JOIN clean ON trip_minutes >= low AND trip_minutes < high GROUP BY 1, 2""")
def trip_duration_buckets(spark, sf_dir):
    return marts.trip_duration_buckets(_clean(spark, sf_dir))


@query(f"WITH {TRIPS} SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, round(sum(fare + tip), 6) AS revenue FROM clean GROUP BY 1")
def revenue_by_day(spark, sf_dir):
    return rounded(marts.revenue_by_day(_clean(spark, sf_dir)), "revenue").withColumn("day", F.col("day").cast("string"))


@query(f"""WITH {TRIPS}, q AS (SELECT quantile_cont(fare, 0.25) f1, quantile_cont(fare, 0.75) f3, quantile_cont(trip_minutes, 0.25) m1, quantile_cont(trip_minutes, 0.75) m3 FROM clean),
flags AS (SELECT coalesce(f3 > f1 AND (fare < f1 - 1.5 * (f3 - f1) OR fare > f3 + 1.5 * (f3 - f1)), false) AS a, coalesce(m3 > m1 AND (trip_minutes < m1 - 1.5 * (m3 - m1) OR trip_minutes > m3 + 1.5 * (m3 - m1)), false) AS b FROM clean, q)
SELECT a AS fare_outlier, b AS trip_minutes_outlier, a OR b AS is_outlier, count(*) AS n FROM flags GROUP BY 1, 2, 3""")
def anomaly_flags(spark, sf_dir):
    return marts.iqr_flags(_clean(spark, sf_dir)).groupBy("fare_outlier", "trip_minutes_outlier", "is_outlier").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {DAYS} SELECT station, CAST(date AS VARCHAR) AS date, round(tmean, 6) AS tmean, tmin, tmax, precip FROM days")
def daily_summary(spark, sf_dir):
    return rounded(days(spark, sf_dir), "tmean").withColumn("date", F.col("date").cast("string"))


@query(f"""WITH {DAYS} SELECT station, year(date)::BIGINT AS year, month(date)::BIGINT AS month, round(avg(tmean), 6) AS avg_tmean, min(tmin) AS min_tmin, max(tmax) AS max_tmax,
round(sum(precip), 6) AS total_precip, count(*) FILTER (precip >= 1.0) AS rain_days, count(*) AS record_count FROM days GROUP BY 1, 2, 3""")
def monthly_summary(spark, sf_dir):
    return rounded(marts.monthly_summary(days(spark, sf_dir)), "avg_tmean", "total_precip")


_RATED = """rated AS (SELECT p_partkey, split_part(p_type, ' ', 1) AS kind, sum(l_quantity) / count(*) / 5 AS rating, count(*) AS votes FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY 1, 2),
banded AS (SELECT *, CASE WHEN rating >= 8 THEN 'high' WHEN rating >= 5 THEN 'medium' ELSE 'low' END AS band FROM rated)"""


def _rated(spark, sf_dir):
    votes = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg((F.sum("l_quantity") / F.count(F.lit(1)) / 5).alias("rating"), F.count(F.lit(1)).alias("votes"))
    part = table(spark, sf_dir, "part").select("p_partkey", F.split_part("p_type", F.lit(" "), F.lit(1)).alias("kind"))
    return part.join(votes, F.col("p_partkey") == F.col("l_partkey")).select("p_partkey", "kind", "rating", "votes", marts.rating_band(F.col("rating")).alias("band"))


@query(f"WITH {_RATED} SELECT p_partkey, round(rating, 6) AS rating, votes, band FROM banded")
def fct_rating_band(spark, sf_dir):
    return rounded(_rated(spark, sf_dir).drop("kind"), "rating")


@query(f"WITH {_RATED} SELECT kind, count(*) AS titles, round(avg(rating), 3) AS avg_rating, sum(votes)::BIGINT AS votes, round(avg(CASE WHEN band = 'high' THEN 1.0::DOUBLE ELSE 0 END), 6) AS high_share FROM banded GROUP BY 1")
def agg_rating_by_type(spark, sf_dir):
    return rounded(marts.rating_by_type(_rated(spark, sf_dir), "kind", "rating", "votes", "band"), "high_share")


@query("SELECT sha256(coalesce(p_partkey::VARCHAR, 'None') || '|' || coalesce(p_brand, 'None')) AS part_key, p_partkey, trim(p_name) AS name, p_brand, try_cast(p_size AS INTEGER) AS size FROM part")
def dim_part(spark, sf_dir):
    return table(spark, sf_dir, "part").select(dimensional.surrogate_key("p_partkey", "p_brand").alias("part_key"), "p_partkey", F.trim("p_name").alias("name"), "p_brand", F.expr("try_cast(p_size as int)").alias("size"))


@query("SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1997-04-01'")
def pruned_scan(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").where("l_shipdate >= timestamp_ntz '1997-01-01' and l_shipdate < timestamp_ntz '1997-04-01'")
    return line.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("""SELECT r_name, n_name, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, count(*) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE l_extendedprice > 0 AND l_quantity > 0 GROUP BY 1, 2, 3""")
def layered_revenue(spark, sf_dir):
    """Staging, fact and mart: the join order and the broadcasts of the small dimensions are left to Catalyst."""
    line = table(spark, sf_dir, "lineitem").where("l_extendedprice > 0 and l_quantity > 0").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").cast("string").alias("day"))
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    customers = table(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")
    fact = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return fact.groupBy("r_name", "n_name", "day").agg(F.round(F.sum("amount"), 4).alias("revenue"), F.count(F.lit(1)).alias("n"))
