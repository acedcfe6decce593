"""Queries over the event stream, as batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalogue import query
from tessera.operators import events
from tessera.sources.tables import table

from .inputs import CLICKS, clicks, rounded

STEPS = ["view", "click", "signup", "purchase"]


@query("SELECT date_trunc('minute', ts) AS minute, count(*) AS n FROM events GROUP BY 1")
def events_per_minute(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.window("ts", "1 minute").start.alias("minute")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CLICKS} SELECT floor(ts / 3600)::BIGINT * 3600 AS window_start, count(*) AS n FROM clicks GROUP BY 1")
def tumbling_counts(spark, sf_dir):
    return events.tumbling_counts(clicks(spark, sf_dir), 3600)


@query(f"WITH {CLICKS}, w AS (SELECT unnest(generate_series(floor((ts - 3600) / 900)::BIGINT + 1, floor(ts / 900)::BIGINT)) AS k FROM clicks) SELECT k * 900 AS window_start, count(*) AS n FROM w GROUP BY 1")
def sliding_counts(spark, sf_dir):
    return events.sliding_counts(clicks(spark, sf_dir), 3600, 900)


@query(f"WITH {CLICKS} SELECT floor(ts / 86400)::BIGINT * 86400 AS window_start, event, round(avg(value), 6) AS mean FROM clicks GROUP BY 1, 2")
def tumbling_aggregate(spark, sf_dir):
    return rounded(events.tumbling_aggregate(clicks(spark, sf_dir), 86400, "value", "mean", key="event"), "mean")


_SESSIONS = f"""WITH {CLICKS}, gaps AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 1800 THEN 1 ELSE 0 END AS new FROM clicks),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session_id FROM gaps)"""


@query(f"{_SESSIONS} SELECT user_id, event_id, session_id FROM numbered")
def sessionize(spark, sf_dir):
    return events.sessionize(clicks(spark, sf_dir), 1800, user="user_id", tie="event_id").select("user_id", "event_id", "session_id")


@query("""WITH gaps AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM gaps)
SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM numbered GROUP BY user_id, s""")
def session_windows(spark, sf_dir):
    return events.session_windows(table(spark, sf_dir, "events"), "30 minutes", user="user_id")


def _reached(select: str) -> str:
    """The greedy path: each step's first time after the step before."""
    return f"""WITH {CLICKS}, s0 AS (SELECT user_id, min(ts) AS t FROM clicks WHERE event = 'view' GROUP BY 1),
s1 AS (SELECT c.user_id, min(c.ts) AS t FROM clicks c JOIN s0 USING (user_id) WHERE event = 'click' AND c.ts > s0.t GROUP BY 1),
s2 AS (SELECT c.user_id, min(c.ts) AS t FROM clicks c JOIN s1 USING (user_id) WHERE event = 'signup' AND c.ts > s1.t GROUP BY 1),
s3 AS (SELECT c.user_id, min(c.ts) AS t FROM clicks c JOIN s2 USING (user_id) WHERE event = 'purchase' AND c.ts > s2.t GROUP BY 1) {select}"""


@query(_reached("SELECT 0 AS step, 'view' AS name, count(*) AS users FROM s0 UNION ALL SELECT 1, 'click', count(*) FROM s1 UNION ALL SELECT 2, 'signup', count(*) FROM s2 UNION ALL SELECT 3, 'purchase', count(*) FROM s3"))
def funnel(spark, sf_dir):
    return events.funnel(clicks(spark, sf_dir), STEPS, user="user_id")


@query(_reached("SELECT 'view' AS from_step, 'click' AS to_step, round(median(s1.t - s0.t), 3) AS median_s FROM s0 JOIN s1 USING (user_id) UNION ALL SELECT 'click', 'signup', round(median(s2.t - s1.t), 3) FROM s1 JOIN s2 USING (user_id) UNION ALL SELECT 'signup', 'purchase', round(median(s3.t - s2.t), 3) FROM s2 JOIN s3 USING (user_id)"))
def funnel_time_to_convert(spark, sf_dir):
    return rounded(events.funnel_time_to_convert(clicks(spark, sf_dir), STEPS, user="user_id"), "median_s", digits=3)


@query(f"""WITH {CLICKS}, a AS (SELECT DISTINCT user_id, floor(ts / 604800)::BIGINT AS p FROM clicks), spine AS (SELECT unnest(generate_series(min(p), max(p))) AS p FROM a)
SELECT spine.p AS period, count(a.user_id) AS users, count(b.user_id) AS retained, coalesce(round(count(b.user_id)::DOUBLE / nullif(count(a.user_id), 0), 6), 0) AS rate
FROM spine LEFT JOIN a ON a.p = spine.p LEFT JOIN a b ON b.user_id = a.user_id AND b.p = a.p + 1 GROUP BY 1""")
def retention(spark, sf_dir):
    return rounded(events.retention(clicks(spark, sf_dir), 604800, user="user_id"), "rate")


_TOP = "SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10"


@query(_TOP)
def heavy_hitters(spark, sf_dir):
    return events.heavy_hitters(table(spark, sf_dir, "events"), "user_id", 10)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 5")
def heavy_hitter_candidates(spark, sf_dir):
    return events.heavy_hitter_candidates(table(spark, sf_dir, "events"), "event_type", 5)


_LATE = f"WITH {CLICKS}, d AS (SELECT event_id, ts - CASE WHEN event_id % 13 = 0 THEN 600 ELSE 0 END AS ts FROM clicks), w AS (SELECT *, max(ts) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) - 120 AS watermark FROM d)"


def _late(spark, sf_dir):
    delayed = clicks(spark, sf_dir).select("event_id", (F.col("ts") - F.when(F.col("event_id") % 13 == 0, 600).otherwise(0)).alias("ts"))
    return events.reorder_within_lateness(delayed, 120, arrival="event_id")


@query(f"{_LATE} SELECT event_id, round(ts, 3) AS ts, round(watermark, 3) AS watermark FROM w WHERE ts >= watermark")
def reorder_within_lateness(spark, sf_dir):
    return rounded(_late(spark, sf_dir).where("not late").select("event_id", "ts", "watermark"), "ts", "watermark", digits=3)


@query(f"{_LATE} SELECT count(*) FILTER (ts < watermark) AS late, count(*) FILTER (ts <= watermark) AS at_or_below, count(*) AS n FROM w")
def late_event_count(spark, sf_dir):
    return _late(spark, sf_dir).agg(F.count_if("late").alias("late"), F.count_if(events.is_late(F.col("ts"), F.col("watermark"))).alias("at_or_below"), F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def dedupe_first(spark, sf_dir):
    return events.dedupe_first(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], ["event_id"])


@query("""WITH RECURSIVE c AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn, epoch_us(ts) / 1e6 AS t, event_id FROM events WHERE value > 60),
r AS (SELECT event_type, rn, event_id, t AS last, true AS fired FROM c WHERE rn = 1
UNION ALL SELECT c.event_type, c.rn, c.event_id, CASE WHEN c.t >= r.last + 21600 THEN c.t ELSE r.last END, c.t >= r.last + 21600 FROM r JOIN c ON c.event_type = r.event_type AND c.rn = r.rn + 1)
SELECT event_type AS event, event_id, fired FROM r""")
def alert_cooldown(spark, sf_dir):
    hot = clicks(spark, sf_dir).where("value > 60").select("event", "event_id", "ts")
    return events.alert_cooldown(hot, 21600, ["event"]).select("event", "event_id", "fired")
