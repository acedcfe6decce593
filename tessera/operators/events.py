"""Event-time operators on batches: windows, sessions, funnels, retention, heavy hitters, lateness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seconds(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1e6


def window_start(ts: Column, width_s: float) -> Column:
    return F.floor(ts / width_s) * width_s


def tumbling_counts(df: DataFrame, width_s: float, ts: str = "ts") -> DataFrame:
    """Events per [k * width, (k + 1) * width) in seconds; only windows that have some."""
    if width_s <= 0:
        raise ValueError("the window must be positive")
    return df.groupBy(window_start(F.col(ts), width_s).alias("window_start")).agg(F.count(F.lit(1)).alias("n"))


def sliding_counts(df: DataFrame, width_s: int, slide_s: int, ts: str = "ts") -> DataFrame:
    """Events per overlapping window whose start is a multiple of the slide."""
    if not 0 < slide_s <= width_s:
        raise ValueError("the slide must be positive and at most the window")
    last = F.floor(F.col(ts) / slide_s)
    first = F.floor((F.col(ts) - width_s) / slide_s) + 1
    starts = F.explode(F.sequence(first, last)).alias("k")
    return df.select(starts).groupBy((F.col("k") * slide_s).alias("window_start")).agg(F.count(F.lit(1)).alias("n"))


def tumbling_aggregate(df: DataFrame, width_s: float, value: str, agg: str = "mean", ts: str = "ts", key: str = "station") -> DataFrame:
    how = {"mean": F.avg, "max": F.max, "min": F.min, "count": F.count}[agg]
    rows = df.where(F.col(value).isNotNull())
    return rows.groupBy(window_start(F.col(ts), width_s).alias("window_start"), key).agg(how(value).alias(agg))


def sessionize(df: DataFrame, gap_s: float, user: str = "user", ts: str = "ts", tie: str | None = None) -> DataFrame:
    """Rows with session_id per user from 0: a new session after more than ``gap_s`` seconds."""
    w = Window.partitionBy(user).orderBy(ts, *([tie] if tie else []))
    new = F.when(F.col(ts) - F.lag(ts).over(w) > gap_s, 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("session_id", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def session_windows(df: DataFrame, gap: str, user: str = "user", ts: str = "ts") -> DataFrame:
    """Per user and session: first and last event and the number of events. Works on streams with a watermark."""
    return df.groupBy(user, F.session_window(ts, gap)).agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count(F.lit(1)).alias("n")).drop("session_window")


def _in_order(df: DataFrame, user: str, event: str, ts: str, steps: list[str]) -> DataFrame:
    """(user, events in time order) of the steps' events only: other events cannot move a funnel."""
    some = df.where(F.col(event).isin(steps))
    return some.groupBy(user).agg(F.array_sort(F.collect_list(F.struct(F.col(ts).alias("t"), F.col(event).alias("e")))).alias("events"))


def funnel(df: DataFrame, steps: list[str], user: str = "user", event: str = "event", ts: str = "ts") -> DataFrame:
    """Users that reach each prefix of ``steps`` in order, other events in between allowed."""
    names = F.array(*[F.lit(s) for s in steps])
    depth = F.aggregate("events", F.lit(0), lambda d, x: F.when(x["e"] == F.get(names, d), d + 1).otherwise(d))
    users = _in_order(df, user, event, ts, steps).select(depth.alias("depth"))
    reached = users.agg(*[F.count_if(F.col("depth") > i).alias(str(i)) for i in range(len(steps))])
    rows = [F.struct(F.lit(i).alias("step"), F.lit(s).alias("name"), F.col(str(i)).alias("users")) for i, s in enumerate(steps)]
    return reached.select(F.inline(F.array(*rows)))


def funnel_time_to_convert(df: DataFrame, steps: list[str], user: str = "user", event: str = "event", ts: str = "ts") -> DataFrame:
    """Median seconds of each transition along the greedy path; null where nobody makes it."""
    names = F.array(*[F.lit(s) for s in steps])
    times = F.aggregate("events", F.array().cast("array<double>"), lambda got, x: F.when(x["e"] == F.get(names, F.size(got)), F.array_append(got, x["t"].cast("double"))).otherwise(got))
    users = _in_order(df, user, event, ts, steps).select(times.alias("t"))
    medians = users.agg(*[F.median(F.get("t", i + 1) - F.get("t", i)).alias(str(i)) for i in range(len(steps) - 1)])
    rows = [F.struct(F.lit(a).alias("from_step"), F.lit(b).alias("to_step"), F.col(str(i)).alias("median_s")) for i, (a, b) in enumerate(zip(steps, steps[1:], strict=False))]
    return medians.select(F.inline(F.array(*rows)))


def retention(df: DataFrame, period_s: float, user: str = "user", ts: str = "ts") -> DataFrame:
    """For every period of the span: share of its users active in the next one; 0 for a period without users."""
    active = df.select(F.col(user).alias("u"), F.floor(F.col(ts) / period_s).alias("p")).distinct()
    back = active.select("u", (F.col("p") - 1).alias("p"), F.lit(1).alias("again"))
    shares = active.join(back, ["u", "p"], "left").groupBy("p").agg(F.count(F.lit(1)).alias("users"), F.count("again").alias("retained"))
    spine = active.agg(F.min("p").alias("a"), F.max("p").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("p"))
    users, retained = (F.coalesce(c, F.lit(0).cast("long")) for c in ("users", "retained"))
    return spine.join(shares, "p", "left").select(F.col("p").alias("period"), users.alias("users"), retained.alias("retained"), F.coalesce(F.try_divide(retained.cast("double"), users), F.lit(0.0)).alias("rate"))


def heavy_hitters(df: DataFrame, key: str, k: int) -> DataFrame:
    """The k most frequent keys with exact counts, ties by key. Partial counts make one row a key and task."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key).limit(k)


def heavy_hitter_candidates(df: DataFrame, key: str, k: int, counters: int | None = None) -> DataFrame:
    """Bounded-memory form of ``heavy_hitters`` over keys that are not null: Misra-Gries counters per task, then an exact count of the candidates.

    A key that no task kept has occurred at most as often as the tasks took off their counters. Where the last of the
    top k is not above that, all keys are counted after all, so the result is exact.
    """
    from tessera.runtime import checkpoint

    df = df.where(F.col(key).isNotNull())
    size = counters or max(2 * k, k + 8)

    def shrink(counts: dict) -> tuple[dict, int]:
        if len(counts) <= size:
            return counts, 0
        cut = sorted(counts.values(), reverse=True)[size]
        return {x: n - cut for x, n in counts.items() if n > cut}, cut

    def summarise(batches):
        import pandas as pd

        counts, lost = {}, 0
        for batch in batches:
            for x, n in batch[key].value_counts().items():
                counts[x] = counts.get(x, 0) + int(n)
            counts, cut = shrink(counts)
            lost += cut
        yield pd.DataFrame({"key": pd.Series([*counts, None], dtype=object), "lost": [0] * len(counts) + [lost]})

    kind = df.schema[key].dataType.simpleString()
    found = checkpoint(df.select(key).mapInPandas(summarise, f"key {kind}, lost long"))
    candidates = found.where("key is not null").select(F.col("key").alias(key)).distinct()
    top = checkpoint(heavy_hitters(df.join(candidates, key, "left_semi"), key, k))
    rows, last = top.agg(F.count(F.lit(1)), F.min("n")).first()
    lost = found.agg(F.coalesce(F.sum("lost"), F.lit(0))).first()[0]
    return top if not lost or (rows == k and last > lost) else heavy_hitters(df, key, k)


def reorder_within_lateness(df: DataFrame, lateness_s: float, arrival: str, ts: str = "ts", key: str | None = None) -> DataFrame:
    """Rows with ``watermark`` (largest time so far in arrival order, less the lateness) and ``late`` (time below it).

    Without a key the running maximum is over the whole stream: it is taken per arrival block first and
    carried on by the blocks' maxima, so no task gets all rows.
    """
    if key:
        top = F.max(ts).over(Window.partitionBy(key).orderBy(arrival).rowsBetween(Window.unboundedPreceding, 0))
        return df.withColumn("watermark", top - lateness_s).withColumn("late", F.col(ts) < F.col("watermark"))
    blocks = df.withColumn("_block", F.floor(F.col(arrival) / 100_000))
    before = blocks.groupBy("_block").agg(F.max(ts).alias("_top")).withColumn("_before", F.max("_top").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))).drop("_top")
    own = F.max(ts).over(Window.partitionBy("_block").orderBy(arrival).rowsBetween(Window.unboundedPreceding, 0))
    rows = blocks.withColumn("_own", own).join(before, "_block")
    return rows.withColumn("watermark", F.greatest("_own", "_before") - lateness_s).withColumn("late", F.col(ts) < F.col("watermark")).drop("_block", "_own", "_before")


def is_late(ts: Column, watermark: Column) -> Column:
    return ts <= watermark


def dedupe_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``, without a sort: the smallest struct of the order columns and the rest."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    first = F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("_r")
    return df.groupBy(*keys).agg(first).select(*keys, "_r.*").select(*df.columns)


def alert_cooldown(df: DataFrame, cooldown_s: float, keys: list[str], ts: str = "ts") -> DataFrame:
    """Candidate alerts with ``fired``: the first of each key, then each one at least ``cooldown_s`` after the last that fired."""
    import pandas as pd

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(ts, kind="stable")
        last, fired = None, []
        for t in rows[ts]:
            hit = last is None or t >= last + cooldown_s
            last = t if hit else last
            fired.append(hit)
        return rows.assign(fired=fired)

    return df.groupBy(*keys).applyInPandas(run, df.withColumn("fired", F.lit(True)).schema)
