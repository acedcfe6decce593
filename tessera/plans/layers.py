"""Queries for the layered build and for partitioned lakes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.catalogue import query
from tessera.operators import marts, quality
from tessera.operators.layers import Model, build_models
from tessera.runtime import fresh_folder
from tessera.sources import sinks, tables
from tessera.sources.tables import table

_MODELS = [
    Model("stg_part", lambda r: r["part"].selectExpr("p_partkey as part_id", "trim(p_type) as kind", "try_cast(p_size as int) as size"), ("part",), lambda d, _: [quality.not_null("part_id"), quality.unique(d, "part_id")]),
    Model("stg_rating", lambda r: r["lineitem"].groupBy(F.col("l_partkey").alias("part_id")).agg((F.sum("l_quantity") / F.count(F.lit(1)) / 5).alias("rating"), F.count(F.lit(1)).alias("votes")), ("lineitem",), lambda d, _: [quality.accepted_range("rating", 0, 10)]),
    Model("fct_rating", lambda r: r["stg_part"].join(r["stg_rating"], "part_id").withColumn("band", marts.rating_band(F.col("rating"))), ("stg_part", "stg_rating"), lambda d, r: [quality.accepted_values("band", ["low", "medium", "high"]), quality.relationships(d, "part_id", r["stg_part"], "part_id"), quality.expression(F.col("votes") > 0)]),
    Model("agg_kind", lambda r: r["fct_rating"].groupBy("kind").agg(F.count(F.lit(1)).alias("parts"), F.round(F.avg("rating"), 3).alias("avg_rating")), ("fct_rating",), lambda d, _: [quality.not_null("kind")]),
]


def _build(spark, sf_dir):
    return build_models(spark, {n: table(spark, sf_dir, n) for n in ("part", "lineitem")}, _MODELS)


@query("WITH r AS (SELECT l_partkey AS part_id, sum(l_quantity) / count(*) / 5 AS rating FROM lineitem GROUP BY 1) SELECT trim(p_type) AS kind, count(*) AS parts, round(avg(rating), 3) AS avg_rating FROM part JOIN r ON p_partkey = part_id GROUP BY 1")
def layered_build(spark, sf_dir):
    return _build(spark, sf_dir).frames["agg_kind"]


@query("SELECT 'stg_part' AS model, 'not_null' AS test, true AS passed UNION ALL SELECT 'stg_part', 'unique', true UNION ALL SELECT 'stg_rating', 'accepted_range', true UNION ALL SELECT 'fct_rating', 'accepted_values', true UNION ALL SELECT 'fct_rating', 'relationships', true UNION ALL SELECT 'fct_rating', 'expression', true UNION ALL SELECT 'agg_kind', 'not_null', true")
def layered_build_tests(spark, sf_dir):
    parts = [s.select(F.lit(n).alias("model"), "test", "passed") for n, s in _build(spark, sf_dir).summaries.items()]
    return reduce(DataFrame.unionByName, parts)


@query("SELECT day(ts)::BIGINT AS day, count(*) AS n, round(sum(value), 3) AS value FROM events WHERE year(ts) = 2024 AND month(ts) = 1 GROUP BY 1")
def hive_partition_pruned_scan(spark, sf_dir):
    """A lake by year and month, read by partition path."""
    root = fresh_folder(spark, "lake")
    sinks.write_monthly_lake(table(spark, sf_dir, "events").select("ts", "value"), root)
    month = spark.read.option("basePath", root).parquet(*tables.partition_paths(root, [2024], [1]))
    return month.groupBy(F.day("ts").cast("long").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("value"))


@query("SELECT user_id::VARCHAR AS key, count(*) AS n, min(json_extract_string(props, '$.k')::INTEGER) AS least FROM events GROUP BY 1")
def kafka_messages(spark, sf_dir):
    """Messages as a Kafka sink takes them, read again as its source would."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props")
    sent = sinks.kafka_messages(rows, "user_id")
    got = sent.select("key", F.from_json("value", "event_id bigint, user_id bigint, event_type string, props string").alias("m"))
    return got.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.get_json_object("m.props", "$.k").cast("int")).alias("least"))


_PAYLOAD = "to_json(named_struct('hourly', named_struct('time', time, 'pm2_5', pm25, 'pm10', pm10)))"


@query("""WITH o AS (SELECT event_type AS station, date_trunc('hour', ts) AS h, avg(value) AS v, row_number() OVER (PARTITION BY event_type ORDER BY date_trunc('hour', ts)) AS i FROM events GROUP BY 1, 2),
r AS (SELECT station, epoch(h)::BIGINT AS ts, CASE WHEN i % 3 = 0 THEN NULL ELSE round(v, 4) END AS pm25, CASE WHEN i % 2 = 0 THEN NULL ELSE round(v * 2, 4) END AS pm10 FROM o)
SELECT station, count(*) AS n, min(ts) AS first, round(sum(pm25), 4) AS pm25, round(sum(pm10), 4) AS pm10 FROM r WHERE pm25 IS NOT NULL OR pm10 IS NOT NULL GROUP BY 1""")
def parse_hourly_air(spark, sf_dir):
    """Hourly readings packed as an API's columnar JSON, and parsed back."""
    from pyspark.sql import Window

    hours = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("station"), F.window("ts", "1 hour").start.alias("h")).agg(F.avg("value").alias("v"))
    i = F.row_number().over(Window.partitionBy("station").orderBy("h"))
    r = hours.withColumn("i", i).select("station", F.struct("h", F.date_format("h", "yyyy-MM-dd'T'HH:mm").alias("time"), F.when(F.col("i") % 3 != 0, F.round("v", 4)).alias("pm25"), F.when(F.col("i") % 2 != 0, F.round(F.col("v") * 2, 4)).alias("pm10")).alias("s"))
    packed = r.groupBy("station").agg(F.array_sort(F.collect_list("s")).alias("s")).selectExpr("station", "s.time as time", "s.pm25 as pm25", "s.pm10 as pm10").selectExpr("station", f"{_PAYLOAD} as payload")
    return tables.parse_hourly_air(packed).groupBy("station").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.round(F.sum("pm25"), 4).alias("pm25"), F.round(F.sum("pm10"), 4).alias("pm10"))


@query("SELECT coalesce('s' || CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey END, 'unknown') AS id, '2024-01-0' || (s_suppkey % 9 + 1) AS datetime, round(s_acctbal, 2) AS cloud_cover, CASE s_suppkey % 3 WHEN 0 THEN 'one' WHEN 1 THEN 'two' END AS platform FROM supplier")
def scene_metadata(spark, sf_dir):
    """Catalogue items as JSON texts; some have no id, some only a constellation, some neither that nor a platform."""
    key = F.col("s_suppkey")
    properties = F.to_json(F.struct(F.concat(F.lit("2024-01-0"), key % 9 + 1).alias("datetime"), F.col("s_acctbal").alias("eo:cloud_cover"), F.when(key % 3 == 0, "one").alias("platform"), F.when(key % 3 == 1, "two").alias("constellation")))
    head = F.when(key % 4 != 0, F.concat(F.lit('"id":"s'), key, F.lit('",'))).otherwise("")
    items = table(spark, sf_dir, "supplier").select(F.concat(F.lit("{"), head, F.lit('"properties":'), properties, F.lit("}")).alias("item"))
    return items.select(tables.scene_metadata(F.col("item")).alias("m")).select("m.id", "m.datetime", F.round("m.cloud_cover", 2).alias("cloud_cover"), "m.platform")
