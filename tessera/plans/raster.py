"""Queries over pixel tables: indices, composites, change, thresholds, objects, tiles; and trends per series."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.catalogue import query
from tessera.functions import spectral
from tessera.operators import raster, trend

from .inputs import DAYS, PIXELS, days, pixels, rounded

# the indices' formulas in SQL, independent of the Spark expressions
_ND = "({0} - ({1})) / nullif({0} + ({1}), 0)"
_SQL = {
    "ndvi": _ND.format("nir", "red"), "savi": "1.5 * (nir - red) / nullif(nir + red + 0.5, 0)", "evi2": "2.5 * (nir - red) / nullif(nir + 2.4 * red + 1, 0)", "evi": "2.5 * (nir - red) / nullif(nir + 6 * red - 7.5 * blue + 1, 0)",
    "msavi": "CASE WHEN pow(2 * nir + 1, 2) - 8 * (nir - red) >= 0 THEN (2 * nir + 1 - sqrt(abs(pow(2 * nir + 1, 2) - 8 * (nir - red)))) / 2 END", "gndvi": _ND.format("nir", "green"), "arvi": _ND.format("nir", "2 * red - blue"), "ndre": _ND.format("nir", "rededge"),
    "vari": "(green - red) / nullif(green + red - blue, 0)", "rvi": "nir / nullif(red, 0)", "dvi": "nir - red", "ci_green": "nir / nullif(green, 0) - 1", "ci_rededge": "nir / nullif(rededge, 0) - 1",
    "mcari": "((rededge - red) - 0.2 * (rededge - green)) * (rededge / nullif(red, 0))", "tcari": "3 * ((rededge - red) - 0.2 * (rededge - green) * (rededge / nullif(red, 0)))", "lai": "3.618 * (2.5 * (nir - red) / nullif(nir + 6 * red - 7.5 * blue + 1, 0)) - 0.118",
    "ndwi": _ND.format("green", "nir"), "ndmi": _ND.format("nir", "swir1"), "mndwi": _ND.format("green", "swir1"), "awei": "4 * (green - swir1) - (0.25 * nir + 2.75 * swir2)", "ndii": _ND.format("nir", "swir1"), "bsi": _ND.format("(swir1 + red)", "nir + blue"),
    "salinity_index": "CASE WHEN green * red >= 0 THEN sqrt(abs(green * red)) END", "iron_oxide": "red / nullif(blue, 0)", "clay_minerals": "swir1 / nullif(swir2, 0)", "ferrous_minerals": "swir1 / nullif(nir, 0)", "ndbi": _ND.format("swir1", "nir"), "ui": _ND.format("swir2", "nir"),
    "ibi": _ND.format("(" + _ND.format("swir1", "nir") + ")", "((1.5 * (nir - red) / nullif(nir + red + 0.5, 0)) + (" + _ND.format("green", "swir1") + ")) / 2"), "ndsi": _ND.format("green", "swir1"), "ndgi": _ND.format("green", "red"), "nbr": _ND.format("nir", "swir2"), "nbr2": _ND.format("swir1", "swir2"),
    "bai": "1 / nullif(pow(0.1 - red, 2) + pow(0.06 - nir, 2), 0)",
}


def _bands() -> dict:
    return {b: F.col(b) for b in ("nir", "red", "green", "blue", "rededge", "swir1", "swir2")}


@query(f"WITH {PIXELS} SELECT t::VARCHAR AS t, " + ", ".join(f"round(median({sql}), 9) + 0 AS {name}" for name, sql in _SQL.items()) + " FROM pixels GROUP BY 1")
def spectral_indices(spark, sf_dir):
    """All indices in one projection, told as each day's medians."""
    px = pixels(spark, sf_dir)
    out = px.select("t", *[spectral.compute_index(n, _bands()).alias(n) for n in spectral.list_indices()])
    return out.groupBy(F.col("t").cast("string").alias("t")).agg(*[F.round(F.median(n), 9).alias(n) for n in spectral.list_indices()])


_NDVI = f"{PIXELS}, px AS (SELECT y, x, t, {_SQL['ndvi']} AS ndvi, {_SQL['nbr']} AS nbr, scl FROM pixels)"


def _ndvi(spark, sf_dir):
    return pixels(spark, sf_dir).select("y", "x", "t", spectral.compute_index("ndvi", _bands()).alias("ndvi"), spectral.compute_index("NBR", _bands()).alias("nbr"), "scl")


@query(f"WITH {_NDVI} SELECT scl, count(*) AS n, count(CASE WHEN scl NOT IN (3, 8, 9, 10, 11) THEN ndvi END) AS valid FROM px GROUP BY 1")
def scl_mask(spark, sf_dir):
    return raster.scl_mask(_ndvi(spark, sf_dir), ["ndvi"]).groupBy("scl").agg(F.count(F.lit(1)).alias("n"), F.count("ndvi").alias("valid"))


@query(f"WITH {_NDVI} SELECT y, x, round(median(ndvi), 5) AS ndvi FROM px GROUP BY 1, 2")
def temporal_composite(spark, sf_dir):
    return rounded(raster.temporal_composite(_ndvi(spark, sf_dir), "ndvi"), "ndvi", digits=5)


@query(f"WITH {_NDVI} SELECT t::VARCHAR AS t, round(avg(ndvi), 5) AS ndvi FROM px GROUP BY 1")
def index_timeseries(spark, sf_dir):
    return rounded(raster.index_timeseries(_ndvi(spark, sf_dir), "ndvi"), "ndvi", digits=5).withColumn("t", F.col("t").cast("string"))


_PERIODS = f"{_NDVI}, old AS (SELECT y, x, median(ndvi) AS ndvi, median(nbr) AS nbr FROM px WHERE t < DATE '1998-06-01' GROUP BY 1, 2), young AS (SELECT y, x, median(ndvi) AS ndvi, median(nbr) AS nbr FROM px WHERE t >= DATE '1998-06-01' GROUP BY 1, 2)"


def _periods(spark, sf_dir, value="ndvi"):
    px, cut = _ndvi(spark, sf_dir), F.lit("1998-06-01").cast("date")
    return raster.temporal_composite(px.where(F.col("t") < cut), value), raster.temporal_composite(px.where(F.col("t") >= cut), value)


@query(f"WITH {_PERIODS}, b AS (SELECT y, x, avg(ndvi) AS m, stddev_pop(ndvi) AS s FROM px WHERE t < DATE '1998-06-01' GROUP BY 1, 2), z AS (SELECT y, x, (ndvi - m) / nullif(s, 0) AS z FROM young JOIN b USING (y, x)) SELECT y, x, round(z, 4) AS z, CASE WHEN round(z, 9) > 1 THEN 1 WHEN round(z, 9) < -1 THEN -1 ELSE 0 END AS class FROM z")
def zscore_anomaly(spark, sf_dir):
    px, cut = _ndvi(spark, sf_dir), F.lit("1998-06-01").cast("date")
    return rounded(raster.zscore_anomaly(_periods(spark, sf_dir)[1], raster.baseline(px.where(F.col("t") < cut), "ndvi"), "ndvi", 1.0), "z", digits=4)


@query(f"WITH {_PERIODS}, m AS (SELECT y, x, median(ndvi) AS med FROM px WHERE t < DATE '1998-06-01' GROUP BY 1, 2), d AS (SELECT y, x, any_value(med) AS med, median(abs(ndvi - med)) AS mad FROM px JOIN m USING (y, x) WHERE t < DATE '1998-06-01' GROUP BY 1, 2) SELECT y, x, round((ndvi - med) / nullif(1.4826 * mad, 0), 4) AS z FROM young JOIN d USING (y, x)")
def robust_zscore(spark, sf_dir):
    px, cut = _ndvi(spark, sf_dir), F.lit("1998-06-01").cast("date")
    return rounded(raster.robust_zscore(_periods(spark, sf_dir)[1], px.where(F.col("t") < cut), "ndvi"), "z", digits=4)


_CHANGE = f"{_PERIODS}, c AS (SELECT y, x, young.ndvi - old.ndvi AS delta, old.nbr - young.nbr AS dnbr FROM old JOIN young USING (y, x))"


def _change(spark, sf_dir):
    return raster.change(*_periods(spark, sf_dir), "ndvi")


@query(f"WITH {_CHANGE} SELECT CASE WHEN round(delta, 9) <= -0.1 THEN -1 WHEN round(delta, 9) >= 0.1 THEN 1 ELSE 0 END AS class, count(*) AS n FROM c GROUP BY 1")
def change_classes(spark, sf_dir):
    return _change(spark, sf_dir).groupBy(raster.classify_change(F.round("delta", 9), -0.1, 0.1).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_CHANGE} SELECT count(*) FILTER (round(delta, 9) <= -0.1) AS loss_px, count(*) FILTER (round(delta, 9) >= 0.1) AS gain_px, round(count(*) FILTER (round(delta, 9) <= -0.1) / 100, 4) AS loss_ha, round(count(*) FILTER (round(delta, 9) >= 0.1) / 100, 4) AS gain_ha, round(count(*) FILTER (abs(round(delta, 9)) >= 0.1) / count(*), 6) AS changed_fraction FROM c")
def change_stats(spark, sf_dir):
    classed = _change(spark, sf_dir).withColumn("class", raster.classify_change(F.round("delta", 9), -0.1, 0.1))
    return rounded(rounded(raster.change_stats(classed, "class", 10), "loss_ha", "gain_ha", digits=4), "changed_fraction")


@query(f"WITH {_CHANGE}, s AS (SELECT CASE WHEN d >= 0.66 THEN 4 WHEN d >= 0.44 THEN 3 WHEN d >= 0.27 THEN 2 WHEN d >= 0.1 THEN 1 ELSE 0 END AS severity FROM (SELECT round(dnbr, 9) AS d FROM c)) SELECT k::INTEGER AS severity, round(count(severity) / 100, 4) AS hectares FROM range(5) t(k) LEFT JOIN s ON severity = k GROUP BY 1")
def burn_severity(spark, sf_dir):
    old, young = _periods(spark, sf_dir, "nbr")
    classed = raster.change(young, old, "nbr").select(raster.burn_severity(F.round("delta", 9)).alias("class"))
    return rounded(raster.severity_stats(classed, "class", 10), "hectares", digits=4)


_FLOOD = f"{_PERIODS}, f AS (SELECT y, x, coalesce(round(old.ndvi, 9) < 0.6, false) AS a, coalesce(round(young.ndvi, 9) < 0.6, false) AS b FROM old JOIN young USING (y, x))"


def _flood(spark, sf_dir):
    wet = lambda df: df.select("y", "x", raster.water_mask(F.round("ndvi", 9), 0.6).alias("water"))
    old, young = _periods(spark, sf_dir)
    return raster.flood_extent(wet(old), wet(young))


@query(f"WITH {_FLOOD} SELECT y, x, NOT a AND b AS flooded, a AND b AS permanent, a AND NOT b AS receded FROM f")
def flood_extent(spark, sf_dir):
    return _flood(spark, sf_dir)


@query(f"WITH {_FLOOD} SELECT round(count(*) FILTER (NOT a AND b) / 100, 4) AS flooded_ha, round(count(*) FILTER (a AND b) / 100, 4) AS permanent_ha, round(count(*) FILTER (a AND NOT b) / 100, 4) AS receded_ha, round(count(*) FILTER (NOT a AND b) / count(*), 6) AS flooded_fraction FROM f")
def flood_stats(spark, sf_dir):
    return rounded(rounded(raster.flood_stats(_flood(spark, sf_dir), 10), "flooded_ha", "permanent_ha", "receded_ha", digits=4), "flooded_fraction")


_HIST = f"{PIXELS}, l AS (SELECT min(nir) AS lo, max(nir) AS hi FROM pixels), h AS (SELECT least(floor((nir - lo) / ((hi - lo) / 64)), 63)::INTEGER AS bin, count(*) AS n FROM pixels, l GROUP BY 1), hist AS (SELECT k::INTEGER AS bin, lo + (hi - lo) / 64 * (k + 0.5) AS center, coalesce(n, 0) AS n FROM range(64) t(k) CROSS JOIN l LEFT JOIN h ON h.bin = k)"
_OTSU = f"{_HIST}, cum AS (SELECT bin, center, n, sum(n) OVER w AS w0, sum(n * center) OVER w AS s0, sum(n) OVER () AS nn, sum(n * center) OVER () AS ss FROM hist WINDOW w AS (ORDER BY bin ROWS UNBOUNDED PRECEDING)), v AS (SELECT *, round(coalesce(w0 * (nn - w0) * pow(s0 / nullif(w0, 0) - (ss - s0) / nullif(nn - w0, 0), 2), 0) / (nn * nn), 12) AS v FROM cum), otsu AS (SELECT arg_min(center, (-v, bin)) AS threshold FROM v)"


@query(f"WITH {_HIST} SELECT bin, round(center, 6) AS center, n FROM hist")
def histogram(spark, sf_dir):
    return rounded(raster.histogram(pixels(spark, sf_dir), "nir", 64), "center")


@query(f"WITH {_OTSU} SELECT round(threshold, 6) AS threshold FROM otsu")
def otsu_threshold(spark, sf_dir):
    return rounded(raster.otsu_threshold(pixels(spark, sf_dir), "nir", 64), "threshold")


@query(f"WITH {_OTSU} SELECT round(any_value(threshold), 6) AS threshold, round(arg_min(center, CASE WHEN center <= threshold THEN (-n, bin) END), 6) AS low_mode, round(arg_min(center, CASE WHEN center > threshold THEN (-n, bin) END), 6) AS high_mode FROM hist, otsu")
def histogram_modes(spark, sf_dir):
    return rounded(raster.histogram_modes(pixels(spark, sf_dir), "nir", 64), "threshold", "low_mode", "high_mode")


_MASK = f"{PIXELS}, mask AS (SELECT y, x, y * 100 + x AS id FROM pixels GROUP BY 1, 2 HAVING avg(nir) > 0.45)"
_LABELS = f"{_MASK}, e AS (SELECT a.id AS i, b.id AS j FROM mask a JOIN mask b ON abs(a.y - b.y) + abs(a.x - b.x) = 1), r(id, root) AS (SELECT id, id FROM mask UNION SELECT e.j, r.root FROM r JOIN e ON e.i = r.id), roots AS (SELECT id, min(root) AS root FROM r GROUP BY 1), labels AS (SELECT id // 100 AS y, id % 100 AS x, dense_rank() OVER (ORDER BY root)::INTEGER AS label FROM roots)"


def _mask(spark, sf_dir):
    return pixels(spark, sf_dir).groupBy("y", "x").agg(F.avg("nir").alias("m")).where("m > 0.45").select("y", "x")


@query(f"WITH RECURSIVE {_LABELS} SELECT y, x, label FROM labels")
def label_components(spark, sf_dir):
    return raster.label_components(_mask(spark, sf_dir), 100)


@query(f"WITH RECURSIVE {_LABELS} SELECT label, count(*) AS area_px, min(y) AS min_y, min(x) AS min_x, max(y) AS max_y, max(x) AS max_x, round(avg(y), 5) AS cy, round(avg(x), 5) AS cx FROM labels GROUP BY 1 HAVING count(*) >= 2")
def region_props(spark, sf_dir):
    props = raster.filter_by_area(raster.region_props(raster.label_components(_mask(spark, sf_dir), 100)), least=2)
    return rounded(props, "cy", "cx", digits=5)


@query(f"WITH {_MASK}, b AS (SELECT y, x FROM pixels GROUP BY 1, 2 HAVING max(red) > 0.09) SELECT round((SELECT count(*) FROM mask JOIN b USING (y, x)) / (SELECT count(*) FROM (SELECT y, x FROM mask UNION SELECT y, x FROM b)), 6) AS iou")
def mask_iou(spark, sf_dir):
    other = pixels(spark, sf_dir).groupBy("y", "x").agg(F.max("red").alias("m")).where("m > 0.09").select("y", "x")
    return rounded(raster.mask_iou(_mask(spark, sf_dir), other), "iou")


@query(f"WITH {_NDVI} SELECT round(min(v), 6) AS min, round(avg(v), 6) AS mean, round(max(v), 6) AS max, round(count(v) / count(*), 6) AS valid_fraction, round(quantile_cont(v, 0.02), 6) AS low, round(quantile_cont(v, 0.98), 6) AS high FROM (SELECT CASE WHEN scl NOT IN (3, 8, 9, 10, 11) THEN ndvi END AS v FROM px)")
def index_stats(spark, sf_dir):
    masked = raster.scl_mask(_ndvi(spark, sf_dir), ["ndvi"])
    out = raster.index_stats(masked, "ndvi").crossJoin(raster.percentile_stretch(masked, "ndvi"))  # one row each
    return rounded(out, "min", "mean", "max", "valid_fraction", "low", "high")


@query("WITH a AS (SELECT unnest([0, 48, 96, 144, 192, 236])::INTEGER AS y), b AS (SELECT unnest([0, 48, 96, 136])::INTEGER AS x) SELECT y, x FROM a, b")
def tile_grid(spark, sf_dir):
    return raster.tile_grid(spark, 300, 200, 64, 48, drop_partial=False)


@query(f"WITH {PIXELS}, t AS (SELECT y, x, nir, ty FROM pixels, (VALUES (0), (50), (100), (136)) v(ty) WHERE y >= ty AND y < ty + 64) SELECT y, x, round(avg(nir), 9) AS value FROM t GROUP BY 1, 2")
def stitch(spark, sf_dir):
    starts = F.explode(F.filter(F.array(*[F.lit(s).cast("long") for s in (0, 50, 100, 136)]), lambda s: (F.col("y") >= s) & (F.col("y") < s + 64))).alias("ty")
    tiles = pixels(spark, sf_dir).select("y", "x", "nir", starts).select("ty", F.lit(0).alias("tx"), (F.col("y") - F.col("ty")).alias("dy"), F.col("x").alias("dx"), F.col("nir").alias("value"))
    return rounded(raster.stitch(tiles), "value", digits=9)


@query(f"WITH {PIXELS} SELECT count(*) AS n, round(sum(least(greatest((nir - 0.1) / (0.6 - 0.1), 0), 1)), 7) AS total, round(avg(CASE WHEN red > 0.05 THEN 10 * log10(red) END), 5) AS db FROM pixels WHERE y % 4 = 0 AND x % 4 = 0")
def downsample(spark, sf_dir):
    small = raster.downsample(pixels(spark, sf_dir), 200, 72, 64)
    return small.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(raster.normalize(F.col("nir"), 0.1, 0.6)), 7).alias("total"), F.round(F.avg(raster.to_db(F.when(F.col("red") > 0.05, F.col("red")))), 5).alias("db"))


_SERIES = f"{DAYS}, s AS (SELECT station AS k, (date - DATE '2024-01-01') AS t, round(tmean + CASE WHEN day(date) > 15 THEN 25 ELSE 0 END, 4) AS y FROM days)"


def _series(spark, sf_dir):
    return days(spark, sf_dir).select(F.col("station").alias("k"), F.date_diff("date", F.lit("2024-01-01").cast("date")).alias("t"), F.round(F.col("tmean") + F.when(F.day("date") > 15, 25).otherwise(0), 4).alias("y"))


@query(f"WITH {_SERIES} SELECT a.k, round(median((b.y - a.y) / (b.t - a.t)), 6) AS slope FROM s a JOIN s b ON a.k = b.k AND a.t < b.t GROUP BY 1")
def theil_sen(spark, sf_dir):
    return rounded(trend.theil_sen(_series(spark, sf_dir), "k"), "slope")


@query(f"WITH {_SERIES} SELECT a.k, sum(sign(b.y - a.y))::BIGINT AS s FROM s a JOIN s b ON a.k = b.k AND a.t < b.t GROUP BY 1")
def mann_kendall_s(spark, sf_dir):
    return trend.mann_kendall(_series(spark, sf_dir), "k").select("k", "s")


_CUSUM = f"{_SERIES}, r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY k) AS n, avg(y) OVER (PARTITION BY k) AS m, stddev_pop(y) OVER (PARTITION BY k) AS sd FROM s), c AS (SELECT *, abs(sum(y - m) OVER (PARTITION BY k ORDER BY t ROWS UNBOUNDED PRECEDING) / (sd * sqrt(n))) AS c FROM r), b AS (SELECT k, arg_min(i, (-round(c, 12), i)) AS bi, max(c) AS score FROM c WHERE i >= 2 AND i < n - 3 GROUP BY 1), g AS (SELECT k, bi, score, avg(y) FILTER (i > bi) - avg(y) FILTER (i <= bi) AS magnitude, avg(y) FILTER (i <= bi) AS before FROM r JOIN b USING (k) GROUP BY 1, 2, 3)"


@query(f"WITH {_CUSUM} SELECT k, bi::INTEGER AS break_index, round(score, 5) AS score, round(magnitude, 5) AS magnitude FROM g WHERE score >= 1")
def cusum_breakpoint(spark, sf_dir):
    return rounded(trend.cusum_breakpoint(_series(spark, sf_dir), "k"), "score", "magnitude", digits=5)


@query(f"WITH {_CUSUM} SELECT g.k, min(i - bi)::INTEGER AS recovery FROM g LEFT JOIN r ON r.k = g.k AND i > bi AND abs(y - before) <= 20 WHERE score >= 1 GROUP BY 1")
def recovery_time(spark, sf_dir):
    s = _series(spark, sf_dir)
    return trend.recovery_time(s, trend.cusum_breakpoint(s, "k"), "k", 20.0)


@query()
def harmonic_fit(spark, sf_dir):
    return rounded(trend.harmonic_fit(_series(spark, sf_dir), "k", period=7.0), "intercept", "slope", "amplitude", "phase", "rmse", digits=4)


@query()
def binseg(spark, sf_dir):
    return rounded(trend.binary_segmentation(_series(spark, sf_dir), "k"), "score", digits=4)


@query(f"WITH {_CUSUM}, d AS (SELECT k, DATE '2024-01-01' + bi::INT AS detected, -abs(magnitude) AS magnitude, k < 'p' AS in_event FROM g WHERE score >= 1) SELECT round(coalesce(count(*) FILTER (in_event AND abs(detected - DATE '2024-01-20') <= 7 AND magnitude <= -0.1) / nullif(count(*) FILTER (in_event), 0), 0), 6) AS detection_rate, round(coalesce(count(*) FILTER (NOT in_event AND abs(detected - DATE '2024-01-20') <= 7 AND magnitude <= -0.1) / nullif(count(*) FILTER (NOT in_event), 0), 0), 6) AS false_alarm_rate FROM d")
def spatial_agreement(spark, sf_dir):
    b = trend.cusum_breakpoint(_series(spark, sf_dir), "k")
    found = b.select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("break_index").cast("int")).alias("detected"), (-F.abs("magnitude")).alias("magnitude"), (F.col("k") < "p").alias("in_event"), F.lit("2024-01-20").cast("date").alias("event_date"))
    return rounded(raster.spatial_agreement(found, 7), "detection_rate", "false_alarm_rate")


@query(f"WITH {_NDVI} SELECT y, x, (DATE '1970-01-01' + ((t - DATE '1970-01-01') // 64 * 64)::INTEGER)::VARCHAR AS period_start, round(median(ndvi), 6) AS ndvi FROM px GROUP BY 1, 2, (t - DATE '1970-01-01') // 64")
def period_composite(spark, sf_dir):
    out = raster.period_composite(_ndvi(spark, sf_dir), "ndvi", 64)
    return rounded(out, "ndvi").withColumn("period_start", F.col("period_start").cast("string"))


@query(f"WITH {PIXELS} SELECT x, round(avg((nir - 0.3) / (0.2 + 1e-6)), 6) AS nir_mean, round(stddev_pop((nir - 0.3) / (0.2 + 1e-6)), 6) AS nir_std FROM pixels GROUP BY 1")
def band_features(spark, sf_dir):
    scaled = raster.normalize_per_band(pixels(spark, sf_dir), {"nir": (0.3, 0.2)})
    return raster.band_features(scaled, ["nir"], "x").select("x", F.round(F.col("features")[0], 6).alias("nir_mean"), F.round(F.col("features")[1], 6).alias("nir_std"))


@query(f"WITH RECURSIVE {_LABELS} SELECT count(DISTINCT label) AS objects FROM labels")
def count_objects(spark, sf_dir):
    return raster.count_objects(raster.label_components(_mask(spark, sf_dir), 100))


@query(f"WITH {PIXELS}, c AS (SELECT DISTINCT y, x FROM pixels) SELECT y, x, x + 0.5 > 10.2 AND x + 0.5 < 40.1 AND y + 0.5 > 20.7 AND y + 0.5 < 90.3 AS event FROM c")
def rasterize_event(spark, sf_dir):
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((10.2, 20.7), (40.1, 20.7), (40.1, 90.3), (10.2, 90.3))])
    return raster.rasterize_event(pixels(spark, sf_dir).select("y", "x").distinct(), ring)


@query(f"WITH {_NDVI}, c AS (SELECT y, x, median(ndvi) FILTER (t BETWEEN DATE '1995-01-01' AND DATE '1995-12-31') AS before, median(ndvi) FILTER (t BETWEEN DATE '1997-01-01' AND DATE '1997-12-31') AS after FROM px GROUP BY 1, 2) SELECT y, x, round(before, 6) AS before, round(after, 6) AS after, round(after - before, 6) AS delta FROM c WHERE before IS NOT NULL AND after IS NOT NULL")
def change_inputs(spark, sf_dir):
    return rounded(raster.change_inputs(_ndvi(spark, sf_dir), "ndvi", ("1995-01-01", "1995-12-31"), ("1997-01-01", "1997-12-31")), "before", "after", "delta")


@query()
def pelt(spark, sf_dir):
    return rounded(trend.pelt(_series(spark, sf_dir), "k", penalty=500.0), "magnitude", "score", digits=4)
