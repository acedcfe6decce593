"""How the driver's tables stand in for the inputs of the operators, and the same mappings in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import table


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Sums of doubles depend on their order in the last bits; results are told to ``digits`` decimals."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


TRIPS = """trips AS (
  SELECT l_shipdate AS ts, l_shipdate + to_minutes(CAST(l_linenumber * 11 - 9 + l_quantity AS BIGINT)) AS end_ts,
         l_extendedprice / 100 AS fare, l_extendedprice / 100 * l_discount AS tip, l_quantity - 3 AS passengers, l_returnflag AS payment
  FROM lineitem),
clean AS (
  SELECT *, (epoch_us(end_ts) - epoch_us(ts)) / 6e7 AS trip_minutes, tip / fare AS tip_pct FROM trips
  WHERE fare > 0 AND passengers > 0 AND end_ts > ts AND fare <= 500)"""


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    minutes = F.expr("make_dt_interval(0, 0, cast(l_linenumber * 11 - 9 + l_quantity as int))")
    fare = F.col("l_extendedprice") / 100
    return line.select(
        F.col("l_shipdate").alias("ts"), (F.col("l_shipdate") + minutes).alias("end_ts"), fare.alias("fare"), (fare * F.col("l_discount")).alias("tip"), (F.col("l_quantity") - 3).alias("passengers"), F.col("l_returnflag").alias("payment")
    )


CLICKS = "clicks AS (SELECT epoch_us(ts) / 1e6 AS ts, user_id, event_type AS event, event_id, value FROM events)"


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select((F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), "user_id", F.col("event_type").alias("event"), "event_id", "value")


DAYS = """days AS (
  SELECT event_type AS station, CAST(ts AS DATE) AS date, avg(value) AS tmean, min(value) AS tmin, max(value) AS tmax, count(*) / 100.0::DOUBLE AS precip
  FROM events GROUP BY 1, 2)"""


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("station"), F.to_date("ts").alias("date")).agg(F.avg("value").alias("tmean"), F.min("value").alias("tmin"), F.max("value").alias("tmax"), (F.count(F.lit(1)) / F.lit(100.0)).alias("precip"))


PLACES = """places AS (
  SELECT c_custkey AS place_id, (c_custkey * 37 % 1600) / 100.0::DOUBLE - 8 AS lat, (c_custkey * 91 % 2400) / 100.0::DOUBLE - 12 AS lon,
         (c_custkey % 97 + 3)::DOUBLE AS population, n_name AS admin
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
facilities AS (
  SELECT s_suppkey AS facility_id, (s_suppkey * 53 % 1600) / 100.0::DOUBLE - 8 AS lat, (s_suppkey * 71 % 2400) / 100.0::DOUBLE - 12 AS lon, (s_suppkey % 9 + 1)::DOUBLE AS capacity
  FROM supplier)"""


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("admin"))
    c = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(F.col("c_custkey").alias("place_id"), F.expr("c_custkey * 37 % 1600 / 100D - 8").alias("lat"), F.expr("c_custkey * 91 % 2400 / 100D - 12").alias("lon"), F.expr("cast(c_custkey % 97 + 3 as double)").alias("population"), "admin")


def facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("facility_id"), F.expr("s_suppkey * 53 % 1600 / 100D - 8").alias("lat"), F.expr("s_suppkey * 71 % 2400 / 100D - 12").alias("lon"), F.expr("cast(s_suppkey % 9 + 1 as double)").alias("capacity"))


SCORES = "scores AS (SELECT l.doc_id, l.quality AS y, CAST(d.n_chars % 100 AS DOUBLE) / 100 AS score, CAST(d.n_chars % 2 AS BIGINT) AS pred, l.toxic FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", (F.expr("n_chars % 100") / F.lit(100.0)).alias("score"), F.expr("n_chars % 2").alias("pred"))
    return table(spark, sf_dir, "labels").join(d, "doc_id").select("doc_id", F.col("quality").alias("y"), "score", "pred", "toxic")


PIXELS = """pixels AS (
  SELECT l_orderkey % 200 AS y, l_linenumber + 8 * (l_suppkey % 8) AS x, CAST(l_shipdate AS DATE) AS t,
         l_extendedprice / 1e5 AS nir, l_discount + 0.01 AS red, l_tax + 0.02 AS green, l_quantity / 100 AS blue, (l_quantity % 7 + 1) / 20 AS rededge,
         l_discount * 2 + 0.05 AS swir1, l_tax * 3 + 0.03 AS swir2, CAST(l_partkey % 12 AS INT) AS scl
  FROM lineitem)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey % 200 as y", "l_linenumber + 8 * (l_suppkey % 8) as x", "cast(l_shipdate as date) as t", "l_extendedprice / 1e5D as nir", "l_discount + 0.01D as red", "l_tax + 0.02D as green", "l_quantity / 100 as blue",
        "(l_quantity % 7 + 1) / 20 as rededge", "l_discount * 2 + 0.05D as swir1", "l_tax * 3 + 0.03D as swir2", "cast(l_partkey % 12 as int) as scl",
    )
