"""Queries over time series: hourly bars of event values by type."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.catalogue import query
from tessera.functions import air
from tessera.operators import series
from tessera.sources.tables import table

from .inputs import DAYS, days, rounded

BARS = """bars AS (SELECT event_type AS k, date_trunc('hour', ts) AS bar_start, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*) AS volume FROM events GROUP BY 1, 2),
s AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY bar_start) AS i, close + 100 AS price FROM bars)"""
W = "PARTITION BY k ORDER BY bar_start"


def bars(spark, sf_dir):
    ticks = table(spark, sf_dir, "events").select(F.col("event_type").alias("k"), "ts", F.col("value").alias("price"), F.lit(1).cast("long").alias("size"), F.col("event_id").alias("seq"))
    return series.ohlcv_bars(ticks, "1 hour", "k")


def prices(spark, sf_dir):
    return bars(spark, sf_dir).select("k", "bar_start", "high", "low", "close", (F.col("close") + 100).alias("price"))


@query(f"WITH {BARS} SELECT k, bar_start, open, high, low, close, volume FROM bars")
def ohlcv_bars(spark, sf_dir):
    return bars(spark, sf_dir)


def _roll(n: int, f: str, v: str = "close") -> str:
    return f"CASE WHEN count(*) OVER ({W} ROWS {n - 1} PRECEDING) = {n} THEN {f}({v}) OVER ({W} ROWS {n - 1} PRECEDING) END"


@query(f"WITH {BARS} SELECT k, bar_start, round({_roll(10, 'avg')}, 6) AS sma FROM s")
def sma(spark, sf_dir):
    return rounded(series.sma(prices(spark, sf_dir), 10, "close", "k", "bar_start"), "sma").select("k", "bar_start", "sma")


@query(f"WITH {BARS} SELECT k, bar_start, round({_roll(10, 'stddev_pop')}, 6) AS vol FROM s")
def rolling_vol(spark, sf_dir):
    return rounded(series.rolling_vol(prices(spark, sf_dir), 10, "close", "k", "bar_start"), "vol").select("k", "bar_start", "vol")


@query(f"WITH {BARS}, b AS (SELECT k, bar_start, {_roll(20, 'avg')} AS m, {_roll(20, 'stddev_pop')} AS d FROM s) SELECT k, bar_start, round(m, 5) AS mid, round(m + 2 * d, 5) AS upper, round(m - 2 * d, 5) AS lower FROM b")
def bollinger(spark, sf_dir):
    return rounded(series.bollinger(prices(spark, sf_dir), 20, 2.0, "close", "k", "bar_start"), "mid", "upper", "lower", digits=5).select("k", "bar_start", "mid", "upper", "lower")


@query(f"WITH {BARS} SELECT k, bar_start, round(greatest(high - low, abs(high - lag(close) OVER ({W})), abs(low - lag(close) OVER ({W}))), 6) AS true_range FROM s")
def true_range(spark, sf_dir):
    return rounded(series.true_range(prices(spark, sf_dir), "k", "bar_start"), "true_range").select("k", "bar_start", "true_range")


@query(f"WITH {BARS} SELECT k, bar_start, lag(close, 1) OVER ({W}) AS lag1, lag(close, 2) OVER ({W}) AS lag2, lag(close, 3) OVER ({W}) AS lag3 FROM s")
def lag_features(spark, sf_dir):
    return series.lag_features(prices(spark, sf_dir), "close", "k", "bar_start").select("k", "bar_start", "lag1", "lag2", "lag3")


@query(f"""WITH {DAYS}, f AS (SELECT station, date, precip, avg(precip) OVER w7 AS r7, count(*) OVER w7 AS c7, lag(tmean, 3) OVER w AS l3, lead(precip) OVER w AS nxt, sin(2 * pi() * dayofyear(date) / 365.25) AS sn
FROM days WINDOW w AS (PARTITION BY station ORDER BY date), w7 AS (PARTITION BY station ORDER BY date ROWS 6 PRECEDING))
SELECT station, CAST(date AS VARCHAR) AS date, round(r7, 6) AS precip_roll7, round(l3, 6) AS tmean_lag3, round(sn, 6) AS doy_sin, nxt AS precip_tomorrow, CAST(nxt >= 1.0 AS INTEGER) AS rain_tomorrow FROM f WHERE c7 = 7 AND nxt IS NOT NULL""")
def rolling_features(spark, sf_dir):
    out = series.weather_features(days(spark, sf_dir))
    return rounded(out, "precip_roll7", "tmean_lag3", "doy_sin").select("station", F.col("date").cast("string").alias("date"), "precip_roll7", "tmean_lag3", "doy_sin", "precip_tomorrow", "rain_tomorrow")


@query(f"WITH {DAYS} SELECT station, CAST(date AS VARCHAR) AS date, row_number() OVER (PARTITION BY station ORDER BY date) <= floor(count(*) OVER (PARTITION BY station) * 0.8) AS is_train FROM days")
def time_split(spark, sf_dir):
    return series.time_split(days(spark, sf_dir).select("station", "date"), "date", "station").withColumn("date", F.col("date").cast("string"))


_GAPPY = f"{BARS}, g AS (SELECT k, bar_start AS ts FROM s WHERE i % 9 <> 0 UNION ALL SELECT k, bar_start FROM s WHERE i % 40 = 1)"


def _gappy(spark, sf_dir):
    numbered = prices(spark, sf_dir).withColumn("i", F.row_number().over(Window.partitionBy("k").orderBy("bar_start"))).select("k", F.col("bar_start").alias("ts"), "i")
    return numbered.where("i % 9 <> 0").drop("i").unionByName(numbered.where("i % 40 = 1").drop("i"))


@query(f"WITH {_GAPPY}, grid AS (SELECT k, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM g GROUP BY 1) SELECT k, ts FROM grid ANTI JOIN g USING (k, ts)")
def find_gaps(spark, sf_dir):
    return series.find_gaps(_gappy(spark, sf_dir), "1 hour", "k")


@query(f"WITH {_GAPPY} SELECT k, ts FROM g GROUP BY 1, 2 HAVING count(*) > 1")
def find_duplicates(spark, sf_dir):
    return series.find_duplicates(_gappy(spark, sf_dir), "k")


@query(f"""WITH {_GAPPY}, o AS (SELECT k, ts, count(*) AS n FROM g GROUP BY 1, 2), e AS (SELECT k, sum(n)::BIGINT AS n_bars, count(*) AS t, count(*) FILTER (n > 1) AS n_duplicates, min(ts) AS start, max(ts) AS "end" FROM o GROUP BY 1)
SELECT k, n_bars, (epoch("end" - start) / 3600)::BIGINT + 1 - t AS n_gaps, n_duplicates, round(t / ((epoch("end" - start) / 3600)::BIGINT + 1), 6) AS coverage, start, "end" FROM e""")
def integrity_summary(spark, sf_dir):
    return rounded(series.integrity_summary(_gappy(spark, sf_dir), 3600, "k"), "coverage")


_BACK = f"""{BARS}, sig AS (SELECT *, CASE WHEN price > lag(price, 3) OVER ({W}) THEN 1.0::DOUBLE ELSE 0 END AS signal, coalesce(price / lag(price) OVER ({W}) - 1, 0) AS ret FROM s),
p AS (SELECT *, lag(signal, 1, 0) OVER ({W}) AS position FROM sig), t AS (SELECT *, abs(position - lag(position, 1, 0) OVER ({W})) AS turn FROM p)"""


def _signals(spark, sf_dir):
    w = Window.partitionBy("k").orderBy("bar_start")
    return prices(spark, sf_dir).withColumn("signal", F.when(F.col("price") > F.lag("price", 3).over(w), 1.0).otherwise(0.0)).select("k", "bar_start", "price", "signal")


_EQUITY = f"{_BACK}, n AS (SELECT *, position * ret - turn * 15 / 1e4 AS net FROM t), e AS (SELECT *, product(1 + net) OVER ({W} ROWS UNBOUNDED PRECEDING) AS equity FROM n)"


@query(f"WITH {_EQUITY} SELECT k, bar_start, position, round(ret, 6) AS ret, round(net, 6) + 0 AS net, round(ln(equity), 6) + 0 AS log_equity FROM e")
def equity_curve(spark, sf_dir):
    out = series.backtest(_signals(spark, sf_dir), "k", "bar_start", fee_bps=10, slippage_bps=5).withColumn("log_equity", F.ln("equity"))
    return rounded(out, "ret", "net", "log_equity").select("k", "bar_start", "position", "ret", "net", "log_equity")


_PERF = f"""{_EQUITY}, d AS (SELECT *, 1 - equity / max(equity) OVER ({W} ROWS UNBOUNDED PRECEDING) AS dd FROM e),
a AS (SELECT k, count(*) AS n, arg_min(equity, bar_start) AS e0, arg_max(equity, bar_start) AS e1, avg(net) AS m, stddev_pop(net) AS sd, sqrt(avg(pow(least(net, 0), 2))) AS down, max(dd) AS mdd, avg((net > 0)::INT) AS wr, avg(turn) AS tn, avg((position <> 0)::INT) AS ex FROM d GROUP BY 1)"""


def _performance(spark, sf_dir):
    return series.performance(series.backtest(_signals(spark, sf_dir), "k", "bar_start", fee_bps=10, slippage_bps=5), "k", "bar_start")


for _name, _sql in {
    "total_return": "e1 / e0 - 1",
    "sharpe": "sqrt(252) * m / sd",
    "sortino": "sqrt(252) * m / down",
    "calmar": "(pow(e1 / e0, 252.0 / (n - 1)) - 1) / mdd",
    "max_drawdown": "mdd",
    "win_rate": "wr",
    "turnover": "tn",
    "exposure": "ex",
}.items():
    query(f"WITH {_PERF} SELECT k, round({_sql}, 5) AS {_name} FROM a", _name)(lambda spark, sf_dir, c=_name: rounded(_performance(spark, sf_dir).select("k", c), c, digits=5))


@query(f"""WITH {_BACK}, g AS (SELECT * FROM (VALUES (0.0::DOUBLE), (10)) f(fee_bps), (VALUES (0.0::DOUBLE), (5)) l(slippage_bps)),
n AS (SELECT k, bar_start, fee_bps, slippage_bps, ln(1 + position * ret - turn * (fee_bps + slippage_bps) / 1e4) AS l FROM t, g),
c AS (SELECT k, fee_bps, slippage_bps, sum(l) AS total, arg_min(l, bar_start) AS first FROM n GROUP BY 1, 2, 3) SELECT k, fee_bps, slippage_bps, round(exp(total - first) - 1, 5) AS total_return FROM c""")
def sensitivity_sweep(spark, sf_dir):
    return rounded(series.sensitivity_sweep(_signals(spark, sf_dir), "k", "bar_start", [0.0, 10.0], [0.0, 5.0]), "total_return", digits=5)


@query("SELECT i AS fold, i * 30 AS train_start, i * 30 + 120 AS train_end, i * 30 + 120 AS test_start, i * 30 + 150 AS test_end FROM range((365 - 150) // 30 + 1) t(i)")
def walk_forward_splits(spark, sf_dir):
    return series.walk_forward_splits(spark, 365, 120, 30)


@query(f"WITH {BARS} SELECT k, bar_start, coalesce(count(close) OVER w >= 2 AND close > avg(close) OVER w + 2 * stddev_pop(close) OVER w, false) AS spike FROM s WINDOW w AS ({W} ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)")
def spike_flags(spark, sf_dir):
    return series.spike_flags(prices(spark, sf_dir), 2.0, "close", "k", "bar_start").select("k", "bar_start", "spike")


def _recursive(start: str, step: str, out: str, first: int = 1) -> str:
    return f"WITH RECURSIVE {BARS}, r AS (SELECT k, i, bar_start, {start} FROM s WHERE i = {first} UNION ALL SELECT s.k, s.i, s.bar_start, {step} FROM r JOIN s ON s.k = r.k AND s.i = r.i + 1) SELECT k, bar_start, {out} FROM r"


@query(_recursive("price AS e", "s.price * 2 / 11.0::DOUBLE + r.e * 9 / 11.0::DOUBLE", "round(e, 6) AS ema"))
def ema(spark, sf_dir):
    return rounded(series.ema(prices(spark, sf_dir), 10, "price", "k", "bar_start"), "ema").select("k", "bar_start", "ema")


@query(_recursive(
    "price AS f, price AS g, 0.0::DOUBLE AS m", "s.price * 2 / 13.0::DOUBLE + r.f * 11 / 13.0::DOUBLE, s.price * 2 / 27.0::DOUBLE + r.g * 25 / 27.0::DOUBLE, ((s.price * 2 / 13.0::DOUBLE + r.f * 11 / 13.0::DOUBLE) - (s.price * 2 / 27.0::DOUBLE + r.g * 25 / 27.0::DOUBLE)) * 0.2::DOUBLE + r.m * 0.8::DOUBLE",
    "round(f - g, 5) AS macd, round(m, 5) AS macd_signal, round(f - g - m, 5) AS macd_hist",
))
def macd(spark, sf_dir):
    return rounded(series.macd(prices(spark, sf_dir), "price", "k", "bar_start"), "macd", "macd_signal", "macd_hist", digits=5).select("k", "bar_start", "macd", "macd_signal", "macd_hist")


@query(_recursive("high - low AS a", "greatest(s.high - s.low, abs(s.high - (SELECT close FROM s q WHERE q.k = s.k AND q.i = s.i - 1)), abs(s.low - (SELECT close FROM s q WHERE q.k = s.k AND q.i = s.i - 1))) / 14 + r.a * 13 / 14", "round(a, 5) AS atr").replace("(SELECT close FROM s q WHERE q.k = s.k AND q.i = s.i - 1)", "s.before").replace("close + 100 AS price FROM bars", "close + 100 AS price, lag(close) OVER (PARTITION BY k ORDER BY bar_start) AS before FROM bars"))
def atr(spark, sf_dir):
    return rounded(series.atr(prices(spark, sf_dir), "k", "bar_start"), "atr", digits=5).select("k", "bar_start", "atr")


@query(f"""WITH RECURSIVE {BARS}, d AS (SELECT k, i, bar_start, price - lag(price) OVER ({W}) AS m FROM s),
r AS (SELECT k, i, bar_start, greatest(m, 0) AS g, greatest(-m, 0) AS l FROM d WHERE i = 2 UNION ALL SELECT d.k, d.i, d.bar_start, greatest(d.m, 0) / 14 + r.g * 13 / 14, greatest(-d.m, 0) / 14 + r.l * 13 / 14 FROM r JOIN d ON d.k = r.k AND d.i = r.i + 1)
SELECT k, bar_start, round(CASE WHEN l > 0 THEN 100 - 100 / (1 + g / l) WHEN g > 0 THEN 100 ELSE 50 END, 5) AS rsi FROM r""")
def rsi(spark, sf_dir):
    out = series.rsi(prices(spark, sf_dir), "price", "k", "bar_start").where(F.col("rsi").isNotNull() & ~F.isnan("rsi"))
    return rounded(out, "rsi", digits=5).select("k", "bar_start", "rsi")


def _aqi_sql(table_: tuple, c: str) -> str:
    cases = " ".join(f"WHEN {c} >= {low} AND {c} <= {high} THEN floor({(last - first) / (high - low)!r}::DOUBLE * ({c} - {low}) + {first} + 0.5)" for low, high, first, last in table_)
    return f"CAST(CASE {cases} END AS INTEGER)"


_AIR = "scaled AS (SELECT event_id, event_type, ts, CASE WHEN event_id % 7 = 0 THEN value * 5 ELSE value END AS v FROM events), air AS (SELECT event_id, event_type, ts, v AS pm25, v * 1.3 AS pm10, floor(v * 10 + 1e-9) / 10.0::DOUBLE AS c25, floor(v * 1.3 + 1e-9) AS c10 FROM scaled)"


def _air(spark, sf_dir):
    """Event values as concentrations, every seventh five times as high: some are in the top band, some off the scale."""
    v = F.when(F.col("event_id") % 7 == 0, F.col("value") * 5).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", "event_type", "ts", v.alias("pm25"), (v * 1.3).alias("pm10"))


@query(f"WITH {_AIR} SELECT event_id, {_aqi_sql(air.PM25, 'c25')} AS aqi FROM air")
def pm25_aqi(spark, sf_dir):
    return _air(spark, sf_dir).select("event_id", air.pm25_to_aqi(F.col("pm25")).alias("aqi"))


@query(f"WITH {_AIR} SELECT event_id, {_aqi_sql(air.PM10, 'c10')} AS aqi FROM air")
def pm10_aqi(spark, sf_dir):
    return _air(spark, sf_dir).select("event_id", air.pm10_to_aqi(F.col("pm10")).alias("aqi"))


_CATEGORY = "CASE " + " ".join(f"WHEN aqi >= {low} THEN '{name}'" for low, name in reversed(air.CATEGORIES)) + " END"


@query(f"WITH {_AIR}, s AS (SELECT event_id, pm25, pm10, {_aqi_sql(air.PM25, 'c25')} AS a, {_aqi_sql(air.PM10, 'c10')} AS b FROM air), q AS (SELECT event_id, CASE WHEN (pm25 IS NULL OR a IS NOT NULL) AND (pm10 IS NULL OR b IS NOT NULL) THEN greatest(a, b) END AS aqi FROM s) SELECT {_CATEGORY} AS category, aqi >= 101 AS alert, count(*) AS n FROM q GROUP BY 1, 2")
def aqi_category(spark, sf_dir):
    aqi = _air(spark, sf_dir).select(air.aqi_from_pollutants(F.col("pm25"), F.col("pm10")).alias("aqi"))
    return aqi.groupBy(air.aqi_category(F.col("aqi")).alias("category"), (F.col("aqi") >= 101).alias("alert")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_AIR}, h AS (SELECT event_type, date_trunc('hour', ts) AS hour, floor(round(avg(pm25), 6) * 10 + 1e-9) / 10.0::DOUBLE AS c25 FROM air GROUP BY 1, 2) SELECT event_type, hour, {_aqi_sql(air.PM25, 'c25')} AS aqi FROM h")
def hourly_aqi(spark, sf_dir):
    hours = _air(spark, sf_dir).groupBy("event_type", F.window("ts", "1 hour").start.alias("hour")).agg(F.round(F.avg("pm25"), 6).alias("pm25"))
    return hours.select("event_type", "hour", air.pm25_to_aqi(F.col("pm25")).alias("aqi"))
