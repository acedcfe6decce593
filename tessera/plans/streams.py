"""Streaming queries over the events file, run to the end of what there is; windows still open then are not told."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalogue import query
from tessera.runtime import fresh_folder
from tessera.streaming import operators as st


def _events(spark, sf_dir):
    return st.parquet_stream(spark, f"{sf_dir}/events*.parquet", f"{sf_dir}/events.parquet")


def _folder(spark) -> str:
    return fresh_folder(spark, "stream")


@query("SELECT date_trunc('minute', ts) AS window_start, count(*) AS n FROM events GROUP BY 1 HAVING date_trunc('minute', any_value(ts)) + INTERVAL 1 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 2 MINUTE")
def stream_minute_counts(spark, sf_dir):
    out = st.run_to_end(st.minute_counts(_events(spark, sf_dir)), _folder(spark))
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""WITH gaps AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM gaps)
SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM numbered GROUP BY user_id, s HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 2 MINUTE""")
def stream_sessions(spark, sf_dir):
    out = st.run_to_end(st.sessions(_events(spark, sf_dir), "user_id"), _folder(spark))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started", "ended")})


@query("SELECT DISTINCT event_id // 2 AS pair FROM events")
def stream_dedupe(spark, sf_dir):
    pairs = _events(spark, sf_dir).select("ts", F.expr("event_id div 2").alias("pair"))
    return st.run_to_end(st.dedupe(pairs, ["pair"], delay="30 days").select("pair"), _folder(spark))


@query("""WITH RECURSIVE c AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn, epoch_us(ts) / 1e6 AS t FROM events WHERE value > 60),
r AS (SELECT event_type, rn, t AS last, true AS fired FROM c WHERE rn = 1 UNION ALL SELECT c.event_type, c.rn, CASE WHEN c.t >= r.last + 21600 THEN c.t ELSE r.last END, c.t >= r.last + 21600 FROM r JOIN c ON c.event_type = r.event_type AND c.rn = r.rn + 1)
SELECT event_type, count(*) AS fired, round(max(last), 3) AS last FROM r WHERE fired GROUP BY 1""")
def stream_alerts(spark, sf_dir):
    hot = _events(spark, sf_dir).where("value > 60")
    out = st.run_to_end(st.cooldown_alerts(hot, "event_type", 21600), _folder(spark))
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("fired"), F.round(F.max("t"), 3).alias("last"))
