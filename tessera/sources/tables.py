"""Scans: Parquet tables and lakes, delimited files, JSON dumps, edge lists, Markdown corpora, GeoJSON, API payloads, Kafka."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_time(df: DataFrame, column: str = "ts") -> DataFrame:
    """Make a timestamp without time zone one with it (UTC sessions keep its wall clock), as watermarks need."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


EVENTS = T.StructType([T.StructField("ts", T.DoubleType()), T.StructField("user", T.StringType()), T.StructField("event", T.StringType())])


def load_events(spark: SparkSession, path: str) -> DataFrame:
    """Clickstream CSV with a header; ts in seconds."""
    return require_columns(spark.read.csv(path, header=True), EVENTS.fieldNames()).select(F.expr("try_cast(ts as double)").alias("ts"), "user", "event")


def query_lake(spark: SparkSession, sql: str, root: str, view: str = "trips") -> DataFrame:
    """SQL over a Hive-partitioned Parquet lake seen as ``view``."""
    spark.read.parquet(root).createOrReplaceTempView(view)
    return spark.sql(sql)


def query_frame(df: DataFrame, sql: str, view: str = "trips") -> DataFrame:
    df.createOrReplaceTempView(view)
    return df.sparkSession.sql(sql)


def run_sql_script(spark: SparkSession, script: str) -> None:
    """Every statement of a script, one after another."""
    for statement in filter(str.strip, script.split(";")):
        spark.sql(statement)


def partition_relpath(year: int, month: int) -> str:
    if not 1 <= month <= 12:
        raise ValueError("month must be 1 to 12")
    return f"year={year:04d}/month={month:02d}"


def partition_paths(root: str, years: Iterable[int], months: Iterable[int]) -> list[str]:
    months = list(months)
    return [f"{root.rstrip('/')}/{partition_relpath(y, m)}" for y in years for m in months]


def load_raw_tsv(spark: SparkSession, path: str) -> DataFrame:
    r"""Tab-separated text with a header, all strings, \N as null, no quoting."""
    return spark.read.option("sep", "\t").option("header", True).option("nullValue", "\\N").option("quote", "").csv(path)


def stale_files(spark: SparkSession, paths: list[str], max_age_hours: float) -> DataFrame:
    """Files last written over ``max_age_hours`` ago; a missing path raises."""
    files = spark.read.format("binaryFile").load(paths).select("path", "modificationTime")
    return files.where(F.col("modificationTime") < F.current_timestamp() - F.make_interval(secs=F.lit(max_age_hours * 3600)))


def parse_daily_payload(payload: Column, measures: list[str], schema_root: str = "daily") -> Column:
    """Array of per-day structs from an API's columnar JSON; shorter arrays are padded with nulls."""
    fields = ", ".join(f"{m}: array<double>" for m in measures)
    parsed = F.from_json(payload, f"{schema_root} struct<time: array<string>, {fields}>")[schema_root]
    return F.arrays_zip(parsed["time"].alias("time"), *[parsed[m].alias(m) for m in measures])


def normalize_station(records: DataFrame, station: str, measures: list[str]) -> DataFrame:
    return records.select(F.lit(station).alias("station"), F.to_date("date").alias("date"), *[F.expr(f"try_cast({m} as double)").alias(m) for m in measures])


def parse_hourly_air(payloads: DataFrame, payload_col: str = "payload", station_col: str = "station") -> DataFrame:
    """(station, ts in seconds, pm25, pm10) rows of hourly API payloads; rows without either pollutant go."""
    parsed = F.from_json(payload_col, "hourly struct<time: array<string>, pm2_5: array<double>, pm10: array<double>>")["hourly"]
    rows = payloads.select(station_col, F.explode(F.arrays_zip(parsed["time"].alias("time"), parsed["pm2_5"].alias("pm25"), parsed["pm10"].alias("pm10"))).alias("r"))
    return rows.select(station_col, F.unix_timestamp(F.to_timestamp("r.time")).alias("ts"), "r.pm25", "r.pm10").where("pm25 is not null or pm10 is not null")


def load_edges(spark: SparkSession, path: str, comment: str = "#") -> DataFrame:
    """Edge-list text: comments skipped, two integers a line."""
    parts = F.split(F.trim("value"), r"[\s,]+")
    lines = spark.read.text(path).where(~F.trim("value").startswith(comment) & (F.trim("value") != ""))
    return lines.select(F.expr("try_cast(split(trim(value), '[\\\\s,]+')[0] as bigint)").alias("src"), F.try_element_at(parts, F.lit(2)).alias("_d")).select("src", F.expr("try_cast(_d as bigint)").alias("dst")).na.drop()


def load_ratings(spark: SparkSession, path: str, user: str = "userId", item: str = "movieId", rating: str = "rating") -> DataFrame:
    rows = require_columns(spark.read.csv(path, header=True), (user, item, rating))
    return rows.select(F.col(user).cast("int").alias("user"), F.col(item).cast("int").alias("item"), F.col(rating).cast("float").alias("rating"))


def load_dumps(spark: SparkSession, paths: list[str], text_field: str = "body") -> DataFrame:
    """NDJSON posts as (text, date)."""
    rows = spark.read.schema(f"`{text_field}` string, created_utc bigint").json(paths)
    return rows.where(F.col(text_field).isNotNull()).select(F.col(text_field).alias("text"), F.timestamp_seconds("created_utc").alias("date"))


def load_points(spark: SparkSession, path: str, extra: str = "") -> DataFrame:
    """CSV of places or facilities with lat and lon (doubles) and whatever else it has."""
    rows = require_columns(spark.read.csv(path, header=True), ("lat", "lon"))
    return rows.withColumns({c: F.expr(f"try_cast({c} as double)") for c in ("lat", "lon")})


def load_corpus(spark: SparkSession, directory: str) -> DataFrame:
    """Markdown files as (doc_id, title, body): file stem, first heading or the stem."""
    docs = spark.read.option("pathGlobFilter", "*.md").text(directory, wholetext=True)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.md$", 1)
    heading = F.regexp_extract("value", r"(?m)^#\s+(.+?)\s*$", 1)
    return docs.select(stem.alias("doc_id"), F.when(heading != "", heading).otherwise(stem).alias("title"), F.col("value").alias("body"))


def load_qa(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).schema("question string, relevant_doc_id string").json(path)


def load_features_csv(spark: SparkSession, path: str, features: list[str], label: str) -> DataFrame:
    rows = require_columns(spark.read.csv(path, header=True), [*features, label])
    return rows.select(*[F.col(f).cast("double") for f in features], label)


def geojson_points(docs: DataFrame, column: str = "value") -> DataFrame:
    """Point features of GeoJSON collections as (id, name, lon, lat); other geometries and broken coordinates go."""
    shape = "features array<struct<id: string, properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"
    rows = docs.select(F.explode(F.from_json(column, shape)["features"]).alias("f")).where(F.col("f.geometry.type") == "Point")
    xy = F.from_json("f.geometry.coordinates", "array<double>")
    return rows.select(F.col("f.id").alias("id"), F.col("f.properties")["name"].alias("name"), F.get(xy, 0).alias("lon"), F.get(xy, 1).alias("lat")).where("lon is not null and lat is not null")


def clean_facilities(df: DataFrame) -> DataFrame:
    """Facilities with coordinates in range and off the null island."""
    return df.where(F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90) & ~((F.col("lon") == 0) & (F.col("lat") == 0)))


def search_scenes(items: DataFrame, bbox: tuple[float, float, float, float], start: str, end: str, max_cloud: float, limit: int) -> DataFrame:
    """Scenes that meet a box, a period and a cloud limit, earliest first; at most ``limit`` (a search's page size)."""
    west, south, east, north = bbox
    meets = (F.col("min_lon") <= east) & (F.col("max_lon") >= west) & (F.col("min_lat") <= north) & (F.col("max_lat") >= south)
    return items.where(meets & F.col("datetime").between(start, end) & (F.col("cloud_cover") < max_cloud)).orderBy("datetime").limit(limit)


def least_cloudy_scene(items: DataFrame, date: str, window_days: int, max_cloud: float) -> DataFrame:
    day = F.to_date("datetime")
    near = items.where(day.between(F.date_sub(F.lit(date), window_days), F.date_add(F.lit(date), window_days)) & (F.col("cloud_cover") <= max_cloud))
    return near.orderBy("cloud_cover", "datetime").limit(1)


def scene_metadata(item: Column) -> Column:
    """id ('unknown' without one), datetime, cloud_cover and platform (else constellation) of a catalogue item's JSON text."""
    at = lambda path: F.get_json_object(item, path)
    return F.struct(
        F.coalesce(at("$.id"), F.lit("unknown")).alias("id"), at("$.properties.datetime").alias("datetime"), at("$.properties['eo:cloud_cover']").cast("double").alias("cloud_cover"),
        F.coalesce(F.nullif(at("$.properties.platform"), F.lit("")), at("$.properties.constellation")).alias("platform"),
    )


def kafka_events(spark: SparkSession, topic: str, servers: str, schema: T.StructType = EVENTS, stream: bool = False) -> DataFrame:
    """JSON messages of a topic; needs Spark's Kafka package on the class path."""
    reader = (spark.readStream if stream else spark.read).format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest")
    return reader.load().select(F.from_json(F.col("value").cast("string"), schema).alias("m")).select("m.*")
