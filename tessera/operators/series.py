"""Time-series operators: bars, rolling windows, integrity, returns, and smoothing that depends on its own past.

Everything is per ``key`` (a symbol, a station): a key's rows are ordered in one task, keys run side by side.
Operators without a key take one series as one key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ordered(key: str, order: str):
    return Window.partitionBy(key).orderBy(order)


def ohlcv_bars(ticks: DataFrame, width: str, key: str, ts: str = "ts", price: str = "price", size: str = "size", tie: str = "seq") -> DataFrame:
    """Left-closed bars; first and last by (time, tie), so one pass of partial aggregation and no sort."""
    at = F.struct(ts, tie)
    bars = ticks.groupBy(key, F.window(ts, width).alias("w")).agg(F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.sum(size).alias("volume"))
    return bars.select(key, F.col("w.start").alias("bar_start"), "open", "high", "low", "close", "volume")


def rolling(df: DataFrame, n: int, value: str, key: str, order: str, how: Callable[[str], Column] = F.avg) -> Column:
    """``how`` over the last n rows, null before there are n."""
    w = _ordered(key, order).rowsBetween(-(n - 1), 0)
    return F.when(F.count(value).over(w) == n, how(value).over(w))


def sma(df: DataFrame, n: int, value: str, key: str, order: str) -> DataFrame:
    return df.withColumn("sma", rolling(df, n, value, key, order))


def rolling_vol(df: DataFrame, n: int, value: str, key: str, order: str, ddof: int = 0) -> DataFrame:
    return df.withColumn("vol", rolling(df, n, value, key, order, F.stddev_samp if ddof else F.stddev_pop))


def bollinger(df: DataFrame, n: int, k: float, value: str, key: str, order: str) -> DataFrame:
    mid, spread = rolling(df, n, value, key, order), rolling(df, n, value, key, order, F.stddev_pop)
    return df.withColumns({"mid": mid, "upper": mid + k * spread, "lower": mid - k * spread})


def true_range(df: DataFrame, key: str, order: str, high: str = "high", low: str = "low", close: str = "close") -> DataFrame:
    before = F.lag(close).over(_ordered(key, order))
    return df.withColumn("true_range", F.greatest(F.col(high) - F.col(low), F.abs(F.col(high) - before), F.abs(F.col(low) - before)))


def lag_features(df: DataFrame, value: str, key: str, order: str, lags: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    w = _ordered(key, order)
    return df.withColumns({f"lag{k}": F.lag(value, k).over(w) for k in lags})


def weather_features(df: DataFrame, key: str = "station", date: str = "date", precip: str = "precip", tmean: str = "tmean") -> DataFrame:
    """Lags, rolling means, season and tomorrow's rain per station; rows that lack any of them go."""
    w = _ordered(key, date)
    angle = 2 * F.pi() * F.dayofyear(date) / 365.25
    columns = {f"{c}_lag{k}": F.lag(c, k).over(w) for c in (precip, tmean) for k in (1, 2, 3)}
    columns |= {f"{c}_roll{n}": rolling(df, n, c, key, date) for c in (precip, tmean) for n in (3, 7)}
    columns |= {"doy_sin": F.sin(angle), "doy_cos": F.cos(angle), "precip_tomorrow": F.lead(precip).over(w)}
    out = df.withColumns(columns).withColumn("rain_tomorrow", (F.col("precip_tomorrow") >= 1.0).cast("int"))
    return out.na.drop(subset=[*columns, "rain_tomorrow"])


def time_split(df: DataFrame, order: str, key: str, fraction: float = 0.8) -> DataFrame:
    """Rows with ``is_train``: the first int(n * fraction) of each key in time order."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    return df.withColumn("is_train", F.row_number().over(_ordered(key, order)) <= F.floor(n * fraction))


def find_gaps(df: DataFrame, step: str, key: str, ts: str = "ts") -> DataFrame:
    """(key, ts) at the step's grid between a key's first and last time that have no row."""
    grid = df.groupBy(key).agg(F.min(ts).alias("a"), F.max(ts).alias("b")).select(key, F.explode(F.sequence("a", "b", F.expr(f"interval {step}"))).alias(ts))
    return grid.join(df.select(key, ts), [key, ts], "left_anti")


def find_duplicates(df: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    return df.groupBy(key, ts).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key, ts)


def integrity_summary(df: DataFrame, step_s: int, key: str, ts: str = "ts") -> DataFrame:
    """Bars, gaps, duplicates and coverage of each key's grid, by one aggregation."""
    once = df.groupBy(key, ts).agg(F.count(F.lit(1)).alias("n"))
    out = once.groupBy(key).agg(F.sum("n").alias("n_bars"), F.count(F.lit(1)).alias("_times"), F.count_if(F.col("n") > 1).alias("n_duplicates"), F.min(ts).alias("start"), F.max(ts).alias("end"))
    expected = F.floor((F.unix_timestamp(F.col("end").cast("timestamp")) - F.unix_timestamp(F.col("start").cast("timestamp"))) / step_s) + 1
    return out.select(key, "n_bars", (expected - F.col("_times")).alias("n_gaps"), "n_duplicates", (F.col("_times") / expected).alias("coverage"), "start", "end")


def backtest(df: DataFrame, key: str, order: str, price: str = "price", signal: str = "signal", fee_bps: float = 0.0, slippage_bps: float = 0.0) -> DataFrame:
    """Rows with position, ret, cost, net and equity. The position is the signal of the row before.

    Equity is a running product, taken as the exponential of summed logarithms with signs and zeros kept apart.
    """
    w = _ordered(key, order)
    moved = df.withColumn("position", F.lag(signal, 1, 0.0).over(w))
    moved = moved.withColumn("ret", F.coalesce(F.col(price) / F.lag(price).over(w) - 1, F.lit(0.0)))
    moved = moved.withColumn("cost", F.abs(F.col("position") - F.lag("position", 1, 0.0).over(w)) * ((fee_bps + slippage_bps) / 1e4))
    moved = moved.withColumn("net", F.col("position") * F.col("ret") - F.col("cost"))
    return moved.withColumn("equity", running_product(1 + F.col("net"), w))


def running_product(factor: Column, window) -> Column:
    upto = window.rowsBetween(Window.unboundedPreceding, 0)
    size = F.exp(F.sum(F.ln(F.when(factor != 0, F.abs(factor)))).over(upto))
    sign = F.when(F.sum(F.when(factor < 0, 1).otherwise(0)).over(upto) % 2 == 1, -1.0).otherwise(1.0)
    return F.when(F.max(F.when(factor == 0, 1).otherwise(0)).over(upto) == 1, 0.0).otherwise(F.coalesce(size, F.lit(1.0)) * sign)


def performance(df: DataFrame, key: str, order: str, periods: float = 252.0) -> DataFrame:
    """Per key of a backtest: total_return, sharpe, sortino, calmar, max_drawdown, win_rate, turnover, exposure.

    A ratio over a zero deviation is 0 for Sharpe; for Sortino and Calmar it is 0 with no gain and infinite with one.
    """
    w = _ordered(key, order)
    peak = F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = df.withColumns({"_dd": 1 - F.col("equity") / peak, "_turn": F.abs(F.col("position") - F.lag("position", 1, 0.0).over(w)), "_down": F.pow(F.least("net", F.lit(0.0)), 2)})
    a = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.min_by("equity", order).alias("e0"), F.max_by("equity", order).alias("e1"), F.avg("net").alias("m"), F.stddev_pop("net").alias("sd"), F.sqrt(F.avg("_down")).alias("dd"),
        F.max("_dd").alias("max_drawdown"), F.avg((F.col("net") > 0).cast("double")).alias("win_rate"), F.avg("_turn").alias("turnover"), F.avg((F.col("position") != 0).cast("double")).alias("exposure"),
    )
    infinite = lambda x: F.when(x > 0, float("inf")).when(x < 0, float("-inf")).otherwise(0.0)
    growth = F.pow(F.greatest(F.col("e1") / F.col("e0"), F.lit(0.0)), F.lit(periods) / F.greatest(F.col("n") - 1, F.lit(1))) - 1
    return a.select(
        key, (F.col("e1") / F.col("e0") - 1).alias("total_return"), F.when((F.col("n") >= 2) & (F.col("sd") > 0), F.sqrt(F.lit(periods)) * F.col("m") / F.col("sd")).otherwise(0.0).alias("sharpe"),
        F.when(F.col("dd") > 0, F.sqrt(F.lit(periods)) * F.col("m") / F.col("dd")).otherwise(infinite(F.col("m"))).alias("sortino"),
        F.when(F.col("max_drawdown") > 0, growth / F.col("max_drawdown")).otherwise(infinite(growth)).alias("calmar"), "max_drawdown", "win_rate", "turnover", "exposure",
    )


def sensitivity_sweep(df: DataFrame, key: str, order: str, fees: list[float], slippages: list[float], price: str = "price", signal: str = "signal") -> DataFrame:
    """Total return of the backtest for every fee and slippage: the costs are linear, so the grid is a small array a row, not a join."""
    w = _ordered(key, order)
    rows = backtest(df, key, order, price, signal, 1.0, 0.0).select(key, order, "position", "ret", "cost")
    grid = F.array(*[F.struct(F.lit(f).alias("fee_bps"), F.lit(s).alias("slippage_bps")) for f in fees for s in slippages])
    cells = rows.select(key, order, F.inline(F.transform(grid, lambda g: F.struct(g["fee_bps"].alias("fee_bps"), g["slippage_bps"].alias("slippage_bps"), (F.col("position") * F.col("ret") - F.col("cost") * (g["fee_bps"] + g["slippage_bps"])).alias("net")))))
    w = Window.partitionBy(key, "fee_bps", "slippage_bps").orderBy(order)
    return cells.withColumn("equity", running_product(1 + F.col("net"), w)).groupBy(key, "fee_bps", "slippage_bps").agg((F.max_by("equity", order) / F.min_by("equity", order) - 1).alias("total_return"))


def walk_forward_splits(spark, n: int, train: int, test: int, step: int | None = None) -> DataFrame:
    """(fold, train_start, train_end, test_start, test_end) index ranges, ends exclusive."""
    if min(train, test, step or test) <= 0:
        raise ValueError("sizes must be positive")
    folds = max(0, (n - train - test) // (step or test) + 1)
    start = F.col("id") * (step or test)
    return spark.range(folds).select(F.col("id").alias("fold"), start.alias("train_start"), (start + train).alias("train_end"), (start + train).alias("test_start"), (start + train + test).alias("test_end"))


def spike_flags(df: DataFrame, z: float, value: str, key: str, order: str, lookback: int = 24) -> DataFrame:
    """Rows with ``spike``: value above mean + z deviations of the rows before, of which there must be two."""
    w = _ordered(key, order).rowsBetween(-lookback, -1)
    return df.withColumn("spike", F.coalesce((F.count(value).over(w) >= 2) & (F.col(value) > F.avg(value).over(w) + z * F.stddev_pop(value).over(w)), F.lit(False)))


def _per_series(df: DataFrame, key: str, order: str, columns: list[str], compute: Callable) -> DataFrame:
    """Grouped map with Arrow for recursions: ``compute`` turns a series in time order into arrays by column name."""
    import pandas as pd

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable").reset_index(drop=True)
        return rows.assign(**compute(rows))

    schema = df.withColumns({c: F.lit(0.0) for c in columns}).schema
    for c in columns:
        schema[c].nullable = True
    return df.groupBy(key).applyInPandas(run, schema)


def ewm(values, alpha: float, adjust: bool = False):
    """Exponentially weighted mean seeded by the first value; ``adjust`` divides by the weights so far."""
    import pandas as pd

    return pd.Series(values).ewm(alpha=alpha, adjust=adjust).mean().to_numpy()


def ema(df: DataFrame, n: int, value: str, key: str, order: str, adjust: bool = False) -> DataFrame:
    return _per_series(df, key, order, ["ema"], lambda r: {"ema": ewm(r[value], 2 / (n + 1), adjust)})


def macd(df: DataFrame, value: str, key: str, order: str, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    if not 0 < fast < slow:
        raise ValueError("fast must be positive and below slow")

    def compute(r):
        line = ewm(r[value], 2 / (fast + 1)) - ewm(r[value], 2 / (slow + 1))
        mark = ewm(line, 2 / (signal + 1))
        return {"macd": line, "macd_signal": mark, "macd_hist": line - mark}

    return _per_series(df, key, order, ["macd", "macd_signal", "macd_hist"], compute)


def rsi(df: DataFrame, value: str, key: str, order: str, n: int = 14) -> DataFrame:
    """Wilder's index; 100 without losses, 50 without any change, null on the first row."""
    import numpy as np

    def compute(r):
        moves = np.diff(r[value].to_numpy(float))
        gain, loss = (ewm(np.maximum(s * moves, 0), 1 / n) for s in (1, -1))
        with np.errstate(divide="ignore", invalid="ignore"):
            out = np.where(loss > 0, 100 - 100 / (1 + gain / loss), np.where(gain > 0, 100.0, 50.0))
        return {"rsi": np.concatenate([[np.nan], out])}

    return _per_series(df, key, order, ["rsi"], compute)


def atr(df: DataFrame, key: str, order: str, n: int = 14) -> DataFrame:
    return _per_series(true_range(df, key, order), key, order, ["atr"], lambda r: {"atr": ewm(r["true_range"], 1 / n)})
