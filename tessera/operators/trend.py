"""Trends and breaks per series ``key, t, y``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _pairs(df: DataFrame, key: str) -> DataFrame:
    """Pairs of a series' points, later after earlier, made inside one row a series: series are short, their number is what grows."""
    points = df.where("y is not null").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("t", "y"))).alias("p"))
    each = points.select(key, "p", F.posexplode("p").alias("i", "a"))
    return each.select(key, "a", F.explode(F.slice("p", F.col("i") + 2, F.size("p"))).alias("b"))


def theil_sen(df: DataFrame, key: str) -> DataFrame:
    """Median slope of all pairs of points at different times."""
    slope = F.try_divide(F.col("b.y") - F.col("a.y"), (F.col("b.t") - F.col("a.t")).cast("double"))
    return _pairs(df, key).groupBy(key).agg(F.median(slope).alias("slope"))


def mann_kendall(df: DataFrame, key: str, alpha: float = 0.05) -> DataFrame:
    """(key, s, z, p, trend): tie-corrected, normal approximation; under three points no trend."""
    s = _pairs(df, key).groupBy(key).agg(F.sum(F.signum(F.col("b.y") - F.col("a.y"))).cast("long").alias("s"))
    ties = df.where("y is not null").groupBy(key, "y").agg(F.count(F.lit(1)).alias("c")).groupBy(key).agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1) * (2 * F.col("c") + 5)).alias("tie"))
    out = ties.join(s, key, "left").withColumn("s", F.coalesce("s", F.lit(0).cast("long")))
    var = (F.col("n") * (F.col("n") - 1) * (2 * F.col("n") + 5) - F.col("tie")) / 18
    z = F.when((F.col("n") >= 3) & (var > 0), (F.col("s") - F.signum(F.col("s").cast("double"))) / F.sqrt(var)).otherwise(0.0)
    # complementary error function, rational approximation with an error below 1.2e-7
    x = F.abs(F.col("z")) / F.sqrt(F.lit(2.0))
    u = 1 / (1 + 0.5 * x)
    poly = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368):
        poly = poly * u + c
    p = F.least(u * F.exp(-x * x - 1.26551223 + u * poly), F.lit(1.0))
    out = out.withColumn("z", z).withColumn("p", p)
    return out.select(key, "s", "z", "p", F.when(F.col("p") >= alpha, "none").when(F.col("s") > 0, "increasing").when(F.col("s") < 0, "decreasing").otherwise("none").alias("trend"))


def cusum_breakpoint(df: DataFrame, key: str, min_segment: int = 3, threshold: float = 1.0) -> DataFrame:
    """(key, break_index, score, magnitude): place of the largest absolute scaled CUSUM, mean after less mean before; nothing under the threshold."""
    w, every = Window.partitionBy(key).orderBy("t"), Window.partitionBy(key)
    rows = df.select(key, "t", "y", (F.row_number().over(w) - 1).alias("i"), F.count(F.lit(1)).over(every).alias("n"), F.avg("y").over(every).alias("m"), F.stddev_pop("y").over(every).alias("sd"))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("c", F.sum(F.coalesce(F.col("y") - F.col("m"), F.lit(0.0))).over(upto) / (F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0) * F.sqrt("n")))
    inside = rows.where((F.col("i") >= min_segment - 1) & (F.col("i") < F.col("n") - min_segment))
    best = inside.groupBy(key).agg(F.min_by(F.struct("i", F.abs("c").alias("score")), F.struct(-F.round(F.abs("c"), 12), "i")).alias("b")).select(key, F.col("b.i").alias("bi"), F.col("b.score").alias("score"))
    sides = rows.join(best, key).groupBy(key, "bi", "score").agg((F.avg(F.when(F.col("i") > F.col("bi"), F.col("y"))) - F.avg(F.when(F.col("i") <= F.col("bi"), F.col("y")))).alias("magnitude"))
    return sides.where(F.col("score") >= threshold).select(key, F.col("bi").alias("break_index"), "score", "magnitude")


def recovery_time(df: DataFrame, breaks: DataFrame, key: str, tolerance: float) -> DataFrame:
    """(key, recovery): first offset after the break whose value is within ``tolerance`` of the mean up to the break; null if none."""
    rows = df.withColumn("i", F.row_number().over(Window.partitionBy(key).orderBy("t")) - 1).join(breaks.select(key, "break_index"), key)
    before = F.avg(F.when(F.col("i") <= F.col("break_index"), F.col("y"))).over(Window.partitionBy(key))
    near = rows.withColumn("m", before).where((F.col("i") > F.col("break_index")) & (F.abs(F.col("y") - F.col("m")) <= tolerance))
    return breaks.select(key).join(near.groupBy(key).agg(F.min(F.col("i") - F.col("break_index")).alias("recovery")), key, "left")


def harmonic_fit(df: DataFrame, key: str, period: float = 365.25, harmonics: int = 2) -> DataFrame:
    """(key, intercept, slope, amplitude, phase, rmse): least squares on a line and the first harmonics; too short a series gives nulls."""
    import numpy as np
    import pandas as pd

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.dropna(subset=["y"]).sort_values("t")
        t, y = rows["t"].to_numpy(float), rows["y"].to_numpy(float)
        out = {key: rows[key].iloc[0] if len(rows) else None}
        if len(t) < 2 + 2 * harmonics:
            return pd.DataFrame([out | dict.fromkeys(("intercept", "slope", "amplitude", "phase", "rmse"))])
        waves = [f(2 * np.pi * k * t / period) for k in range(1, harmonics + 1) for f in (np.cos, np.sin)]
        x = np.column_stack([np.ones_like(t), t, *waves])
        b = np.linalg.lstsq(x, y, rcond=None)[0]
        return pd.DataFrame([out | {"intercept": b[0], "slope": b[1], "amplitude": np.hypot(b[2], b[3]), "phase": np.arctan2(b[3], b[2]), "rmse": np.sqrt(np.mean((y - np.einsum("ij,j->i", x, b)) ** 2))}])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, "t", "y").groupBy(key).applyInPandas(run, f"{key} {kind}, intercept double, slope double, amplitude double, phase double, rmse double")


def binary_segmentation(df: DataFrame, key: str, max_breaks: int = 3, threshold: float = 1.0, min_segment: int = 3) -> DataFrame:
    """(key, break_index, score): the strongest CUSUM break of any segment first, then those of its parts, up to ``max_breaks``."""
    import heapq

    import numpy as np
    import pandas as pd

    def best(y, a, b):
        n, part = b - a, y[a:b]
        if n < 2 * min_segment:
            return None
        sd = part.std()
        c = np.abs(np.cumsum(part - part.mean())) / ((sd if sd > 0 else 1.0) * np.sqrt(n))
        c = c[min_segment - 1 : n - min_segment]
        if not len(c) or c.max() < threshold:
            return None
        i = int(np.argmax(c))
        return (-float(c[i]), a + i + min_segment - 1, a, b)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.dropna(subset=["y"]).sort_values("t")
        y = rows["y"].to_numpy(float)
        waiting, out = [x for x in [best(y, 0, len(y))] if x], []
        while waiting and len(out) < max_breaks:
            score, i, a, b = heapq.heappop(waiting)
            out.append((rows[key].iloc[0], i, -score))
            for part in (best(y, a, i + 1), best(y, i + 1, b)):
                if part:
                    heapq.heappush(waiting, part)
        return pd.DataFrame(out, columns=[key, "break_index", "score"])

    return df.select(key, "t", "y").groupBy(key).applyInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, break_index int, score double")


def pelt(df: DataFrame, key: str, penalty: float = 3.0, min_segment: int = 2, jump: int = 5) -> DataFrame:
    """(key, break_index, magnitude, score) of the segmentation with the least squared error plus ``penalty`` a break, by pruned exact search.

    Breaks lie at multiples of ``jump``. A gap counts as the series' mean. break_index is the last point before a
    break, magnitude the step between the segments' means, score its size. A series is worked on in one task.
    """
    import numpy as np
    import pandas as pd

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        y = rows.sort_values("t")["y"].to_numpy(float)
        n, out = len(y), []
        if np.isfinite(y).any():
            y = np.where(np.isfinite(y), y, y[np.isfinite(y)].mean())
            one, two = np.concatenate(([0.0], np.cumsum(y))), np.concatenate(([0.0], np.cumsum(y * y)))
            best, came, open_ = {0: -penalty}, {}, [0]
            for end in [e for e in range(jump, n, jump) if e >= min_segment] + [n]:
                starts = np.array([s for s in open_ if end - s >= min_segment])
                if not len(starts):
                    continue
                cost = two[end] - two[starts] - (one[end] - one[starts]) ** 2 / (end - starts) + np.array([best[s] for s in starts])
                k = int(np.argmin(cost))
                best[end], came[end] = float(cost[k]) + penalty, int(starts[k])
                gone = set(starts[cost > best[end]].tolist())  # can never begin the last segment of a better split
                open_ = [s for s in open_ if s not in gone] + [end]
            breaks, at = [], n
            while at in came and came[at]:
                at = came[at]
                breaks.append(at)
            edges = [0, *breaks[::-1], n]
            for a, b, c in zip(edges, edges[1:], edges[2:], strict=False):
                step = y[b:c].mean() - y[a:b].mean()
                out.append((rows[key].iloc[0], b - 1, step, abs(step)))
        return pd.DataFrame(out, columns=[key, "break_index", "magnitude", "score"])

    return df.select(key, "t", "y").groupBy(key).applyInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, break_index int, magnitude double, score double")
