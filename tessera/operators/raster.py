"""Raster operators on pixel tables ``y, x[, t], bands``: masks, composites, change, thresholds, objects, tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.ordered import numbered

from . import graph

# Scene classes to mask, and burn severity limits.
SCL_INVALID = (3, 8, 9, 10, 11)
SEVERITY = (0.10, 0.27, 0.44, 0.66)


def scl_mask(df: DataFrame, bands: list[str], scl: str = "scl", invalid: tuple[int, ...] = SCL_INVALID) -> DataFrame:
    """Bands as null where the scene class is invalid; unchanged without such a column."""
    return df if scl not in df.columns else df.withColumns({b: F.when(~F.coalesce(F.col(scl).isin(*invalid), F.lit(False)), F.col(b)) for b in bands})


def reflectance(dn: Column) -> Column:
    return F.greatest(dn * 1e-4 - 0.1, F.lit(0.0))


def to_db(x: Column) -> Column:
    return 10 * F.log10(F.when(x > 0, x))


def temporal_composite(df: DataFrame, value: str, how: str = "median") -> DataFrame:
    return df.groupBy("y", "x").agg({"median": F.median, "mean": F.avg}[how](value).alias(value))


def index_timeseries(df: DataFrame, value: str, t: str = "t") -> DataFrame:
    return df.groupBy(t).agg(F.avg(value).alias(value))


def baseline(df: DataFrame, value: str) -> DataFrame:
    return df.groupBy("y", "x").agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def zscore_anomaly(target: DataFrame, base: DataFrame, value: str, threshold: float = 2.0) -> DataFrame:
    """Pixels with z and class: 1 above the threshold, -1 below its negative, 0 else; null z where the deviation is 0."""
    z = F.try_divide(F.col(value) - F.col("mean"), F.col("std"))
    return target.join(base, ["y", "x"]).select("y", "x", z.alias("z"), F.when(z > threshold, 1).when(z < -threshold, -1).otherwise(0).alias("class"))


def robust_zscore(target: DataFrame, base: DataFrame, value: str) -> DataFrame:
    mid = base.groupBy("y", "x").agg(F.median(value).alias("med"))
    mad = base.join(mid, ["y", "x"]).groupBy("y", "x").agg(F.first("med").alias("med"), F.median(F.abs(F.col(value) - F.col("med"))).alias("mad"))
    return target.join(mad, ["y", "x"]).select("y", "x", F.try_divide(F.col(value) - F.col("med"), 1.4826 * F.col("mad")).alias("z"))


def change(before: DataFrame, after: DataFrame, value: str) -> DataFrame:
    return before.select("y", "x", F.col(value).alias("_b")).join(after.select("y", "x", F.col(value).alias("_a")), ["y", "x"]).select("y", "x", (F.col("_a") - F.col("_b")).alias("delta"))


def classify_change(delta: Column, loss: float, gain: float) -> Column:
    return F.when(delta <= loss, -1).when(delta >= gain, 1).otherwise(0)


def hectares(pixels: Column, size_m: float) -> Column:
    return pixels * (size_m * size_m / 1e4)


def change_stats(df: DataFrame, cls: str, size_m: float) -> DataFrame:
    loss, gain = F.count_if(F.col(cls) == -1), F.count_if(F.col(cls) == 1)
    return df.agg(loss.alias("loss_px"), gain.alias("gain_px"), hectares(loss, size_m).alias("loss_ha"), hectares(gain, size_m).alias("gain_ha"), F.coalesce(F.try_divide((loss + gain).cast("double"), F.count(F.lit(1)).cast("double")), F.lit(0.0)).alias("changed_fraction"))


def burn_severity(dnbr: Column) -> Column:
    out = F.lit(0)
    for i, limit in enumerate(SEVERITY):
        out = F.when(dnbr >= limit, i + 1).otherwise(out)
    return out


def severity_stats(df: DataFrame, cls: str, size_m: float) -> DataFrame:
    spine = df.sparkSession.range(len(SEVERITY) + 1).select(F.col("id").cast("int").alias("severity"))
    return spine.join(df.groupBy(F.col(cls).alias("severity")).agg(F.count(F.lit(1)).alias("n")), "severity", "left").select("severity", hectares(F.coalesce("n", F.lit(0)), size_m).alias("hectares"))


def water_mask(value: Column, threshold: float, below: bool = True) -> Column:
    return F.coalesce(value < threshold if below else value > threshold, F.lit(False))


def flood_extent(pre: DataFrame, post: DataFrame, water: str = "water") -> DataFrame:
    both = pre.select("y", "x", F.col(water).alias("_a")).join(post.select("y", "x", F.col(water).alias("_b")), ["y", "x"])
    return both.select("y", "x", (~F.col("_a") & F.col("_b")).alias("flooded"), (F.col("_a") & F.col("_b")).alias("permanent"), (F.col("_a") & ~F.col("_b")).alias("receded"))


def flood_stats(df: DataFrame, size_m: float) -> DataFrame:
    kinds = [hectares(F.count_if(c), size_m).alias(f"{c}_ha") for c in ("flooded", "permanent", "receded")]
    return df.agg(*kinds, F.coalesce(F.try_divide(F.count_if("flooded").cast("double"), F.count(F.lit(1)).cast("double")), F.lit(0.0)).alias("flooded_fraction"))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, center, n) between minimum and maximum; the last bin is closed. Empty bins are there; one value makes one bin."""
    lim = F.broadcast(df.where(F.col(value).isNotNull()).agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi")))  # one row
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0)
    n = df.where(F.col(value).isNotNull()).crossJoin(lim).groupBy(place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).crossJoin(lim).where("hi is not null").where((F.col("hi") > F.col("lo")) | (F.col("bin") == 0))
    return spine.join(n, "bin", "left").select("bin", (F.col("lo") + width * (F.col("bin") + 0.5)).alias("center"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def otsu_threshold(df: DataFrame, value: str, bins: int = 256) -> DataFrame:
    """(threshold): centre of the first bin whose upper edge splits the histogram with the largest variance between the sides."""
    h = histogram(df, value, bins)
    upto, total = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    w0, s0 = F.sum("n").over(upto), F.sum(F.col("n") * F.col("center")).over(upto)
    n, s = F.sum("n").over(total), F.sum(F.col("n") * F.col("center")).over(total)
    between = F.coalesce(w0 * (n - w0) * F.pow(F.try_divide(s0, w0) - F.try_divide(s - s0, n - w0), 2), F.lit(0.0))
    return h.select("bin", "center", F.round(between / (n * n), 12).alias("v")).agg(F.min_by("center", F.struct(-F.col("v"), "bin")).alias("threshold"))


def histogram_modes(df: DataFrame, value: str, bins: int = 256) -> DataFrame:
    """(threshold, low_mode, high_mode): fullest bins at and below, and above the Otsu threshold."""
    h = histogram(df, value, bins).crossJoin(F.broadcast(otsu_threshold(df, value, bins)))
    top = lambda side: F.min_by("center", F.when(side, F.struct(-F.col("n"), "bin")))
    return h.agg(F.first("threshold").alias("threshold"), top(F.col("center") <= F.col("threshold")).alias("low_mode"), top(F.col("center") > F.col("threshold")).alias("high_mode"))


def label_components(mask: DataFrame, width: int, diagonal: bool = False) -> DataFrame:
    """(y, x, label) of mask pixels: connected objects, numbered from 1 in scan order of their first pixel."""
    cells = mask.select((F.col("y") * width + F.col("x")).alias("id"), "y", "x").distinct()
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])
    moves = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in steps])
    ahead = cells.select(F.col("id").alias("src"), F.explode(moves).alias("m"), "y", "x").select("src", (F.col("y") + F.col("m.dy")).alias("y"), (F.col("x") + F.col("m.dx")).alias("x"))
    links = ahead.join(cells.select(F.col("id").alias("dst"), "y", "x"), ["y", "x"]).select("src", "dst")
    c = graph.connected_components(links)
    labelled = cells.join(c, "id", "left").select("y", "x", F.coalesce("component", "id").alias("root"))
    numbers = numbered(labelled.select("root").distinct(), ["root"], "label", first=1).withColumn("label", F.col("label").cast("int"))
    return labelled.join(numbers, "root").select("y", "x", "label")


def region_props(labelled: DataFrame) -> DataFrame:
    rows = labelled.where("label <> 0")
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("area_px"), F.min("y").alias("min_y"), F.min("x").alias("min_x"), F.max("y").alias("max_y"), F.max("x").alias("max_x"), F.avg("y").alias("cy"), F.avg("x").alias("cx"))


def filter_by_area(props: DataFrame, least: int | None = None, most: int | None = None) -> DataFrame:
    if least is not None and most is not None and least > most:
        raise ValueError("the least area is above the most")
    out = props if least is None else props.where(F.col("area_px") >= least)
    return out if most is None else out.where(F.col("area_px") <= most)


def mask_iou(a: DataFrame, b: DataFrame) -> DataFrame:
    """Of two pixel sets ``y, x``; 1 if both are empty."""
    both = a.select("y", "x", F.lit(1).alias("a")).join(b.select("y", "x", F.lit(1).alias("b")), ["y", "x"], "full_outer")
    return both.agg(F.coalesce(F.try_divide(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).cast("double"), F.count(F.lit(1)).cast("double")), F.lit(1.0)).alias("iou"))


def index_stats(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.min(value).alias("min"), F.avg(value).alias("mean"), F.max(value).alias("max"), F.coalesce(F.try_divide(F.count(value).cast("double"), F.count(F.lit(1)).cast("double")), F.lit(0.0)).alias("valid_fraction"))


def percentile_stretch(df: DataFrame, value: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    return df.agg(F.percentile(value, F.lit(low)).alias("low"), F.percentile(value, F.lit(high)).alias("high"))


def downsample(df: DataFrame, height: int, width: int, largest: int) -> DataFrame:
    step = -(-max(height, width) // largest)
    return df.where((F.col("y") % step == 0) & (F.col("x") % step == 0))


def normalize(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest((value - low) / (high - low), F.lit(0.0)), F.lit(1.0))


def tile_grid(spark: SparkSession, height: int, width: int, tile: int, stride: int | None = None, drop_partial: bool = True) -> DataFrame:
    """(y, x) origins of tiles; without ``drop_partial`` a last tile is moved back to the edge to cover the rest."""

    def starts(n: int) -> list[int]:
        out = list(range(0, max(0, n - tile) + 1, stride or tile))
        return out if drop_partial or out[-1] + tile >= n else [*out, n - tile]

    axis = lambda n, c: spark.range(1).select(F.explode(F.array(*[F.lit(s) for s in starts(n)])).alias(c))
    if drop_partial and (height < tile or width < tile):
        return spark.createDataFrame([], "y int, x int")
    return axis(height, "y").crossJoin(F.broadcast(axis(width, "x")))


def stitch(tiles: DataFrame) -> DataFrame:
    """Average of overlapping tiles ``ty, tx, dy, dx, value`` at each pixel."""
    return tiles.groupBy((F.col("ty") + F.col("dy")).alias("y"), (F.col("tx") + F.col("dx")).alias("x")).agg(F.avg("value").alias("value"))


def spatial_agreement(df: DataFrame, window_days: int = 30, magnitude: float = -0.1) -> DataFrame:
    """Rates of detections inside and outside an event: ``detected, magnitude, in_event, event_date``."""
    hit = F.coalesce((F.abs(F.date_diff("detected", "event_date")) <= window_days) & (F.col("magnitude") <= magnitude), F.lit(False))
    rate = lambda side: F.coalesce(F.try_divide(F.count_if(hit & side).cast("double"), F.count_if(side).cast("double")), F.lit(0.0))
    return df.agg(rate(F.col("in_event")).alias("detection_rate"), rate(~F.col("in_event")).alias("false_alarm_rate"))


def period_composite(df: DataFrame, value: str, days: int, t: str = "t") -> DataFrame:
    """Per pixel and period of ``days`` days since 1970: the median of what is valid."""
    period = F.floor(F.unix_date(t) / days)
    return df.groupBy("y", "x", F.date_from_unix_date((period * days).cast("int")).alias("period_start")).agg(F.median(value).alias(value))


def normalize_per_band(df: DataFrame, stats: dict[str, tuple[float, float]], eps: float = 1e-6) -> DataFrame:
    return df.withColumns({b: (F.col(b) - m) / (s + eps) for b, (m, s) in stats.items()})


def band_features(df: DataFrame, bands: list[str], by: str) -> DataFrame:
    """Per patch the array mean, deviation, mean, deviation, ... of its bands."""
    return df.groupBy(by).agg(F.array(*[f(b) for b in bands for f in (F.avg, F.stddev_pop)]).alias("features"))


def count_objects(labelled: DataFrame) -> DataFrame:
    return labelled.agg(F.count_distinct(F.when(F.col("label") != 0, F.col("label"))).alias("objects"))


def rasterize_event(cells: DataFrame, ring: Column, size: float = 1.0) -> DataFrame:
    """Pixels ``y, x`` with ``event``: whether their centre lies in the ring (array of structs x, y), given in units of pixels of ``size``."""
    from tessera.operators.spatial import contains

    return cells.withColumn("event", contains((F.col("x") + 0.5) * size, (F.col("y") + 0.5) * size, ring))


def change_inputs(df: DataFrame, value: str, before: tuple[str, str], after: tuple[str, str], t: str = "t") -> DataFrame:
    """(y, x, before, after, delta): median composites of two periods (both days included) where both have a valid pixel."""
    at = lambda days: F.median(F.when(F.col(t).between(F.lit(days[0]).cast("date"), F.lit(days[1]).cast("date")), F.col(value)))
    both = df.groupBy("y", "x").agg(at(before).alias("before"), at(after).alias("after")).where("before is not null and after is not null")
    return both.withColumn("delta", F.col("after") - F.col("before"))
