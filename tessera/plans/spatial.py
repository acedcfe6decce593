"""Queries for spatial statistics on a grid of parts, and for access of customers to suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalogue import query
from tessera.functions import geo
from tessera.operators import metrics, spatial
from tessera.sources.tables import table

from .inputs import PLACES, facilities, places, rounded

GRID = """grid AS (SELECT p_partkey AS id, (p_partkey - 1) // 25 AS row, (p_partkey - 1) % 25 AS col, p_retailprice + p_size * 10 AS x, p_size::DOUBLE AS v, (p_size > 25)::INT AS b FROM part),
w AS (SELECT a.id AS i, b.id AS j, 1.0::DOUBLE AS w FROM grid a JOIN grid b ON abs(a.row - b.row) + abs(a.col - b.col) = 1),
rs AS (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w FROM w), z AS (SELECT id, x - avg(x) OVER () AS z, var_pop(x) OVER () AS m2, count(*) OVER () AS n FROM grid)"""


def grid(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr("p_partkey as id", "(p_partkey - 1) div 25 as row", "(p_partkey - 1) % 25 as col", "p_retailprice + p_size * 10 as x", "cast(p_size as double) as v", "int(p_size > 25) as b")


def _both(spark, sf_dir):
    g = grid(spark, sf_dir)
    return g.select("id", "x"), spatial.rook_weights(g)


@query(f"WITH {GRID} SELECT i, j, round(w, 6) AS w FROM rs")
def rook_weights(spark, sf_dir):
    return rounded(spatial.row_standardize(spatial.rook_weights(grid(spark, sf_dir))), "w")


@query(f"WITH {GRID}, d AS (SELECT id, count(j) AS k FROM grid LEFT JOIN w ON i = id GROUP BY 1) SELECT count(*) AS n, count(*) FILTER (k = 0) AS islands, round(avg(k), 6) AS mean_neighbours, min(k) AS min_neighbours, max(k) AS max_neighbours, round(100 * sum(k) / (count(*) * count(*)), 6) AS pct_nonzero FROM d")
def weights_diagnostics(spark, sf_dir):
    g = grid(spark, sf_dir)
    return rounded(spatial.weights_diagnostics(spatial.rook_weights(g), g.select("id")), "mean_neighbours", "pct_nonzero")


@query(f"WITH {GRID} SELECT round(sum(w * a.z * b.z) / (sum(w) * any_value(a.m2)), 6) AS moran_i, round(-1 / (any_value(a.n) - 1), 6) AS expected FROM w JOIN z a ON a.id = i JOIN z b ON b.id = j")
def moran_i(spark, sf_dir):
    return rounded(spatial.moran_i(*_both(spark, sf_dir)), "moran_i", "expected")


@query(f"WITH {GRID} SELECT round((any_value(a.n) - 1) * sum(w * pow(a.z - b.z, 2)) / (2 * sum(w) * any_value(a.n) * any_value(a.m2)), 6) AS geary_c FROM w JOIN z a ON a.id = i JOIN z b ON b.id = j")
def geary_c(spark, sf_dir):
    return rounded(spatial.geary_c(*_both(spark, sf_dir)), "geary_c")


_LOCAL = f"{GRID}, l AS (SELECT i, any_value(a.z) AS z, any_value(a.m2) AS m2, sum(w * b.z) AS lag FROM rs JOIN z a ON a.id = i JOIN z b ON b.id = j GROUP BY 1)"


@query(f"WITH {_LOCAL} SELECT id, round(coalesce(z * lag / m2, 0), 5) AS local_i FROM grid LEFT JOIN l ON i = id")
def local_moran(spark, sf_dir):
    return rounded(spatial.local_moran(*_both(spark, sf_dir)).select("id", "local_i"), "local_i", digits=5)


@query(f"WITH {_LOCAL} SELECT id, CASE WHEN z > 0 AND lag > 0 THEN 'HH' WHEN z < 0 AND lag < 0 THEN 'LL' WHEN z < 0 AND lag > 0 THEN 'LH' WHEN z > 0 AND lag < 0 THEN 'HL' ELSE '00' END AS quadrant FROM grid LEFT JOIN l ON i = id")
def lisa_quadrants(spark, sf_dir):
    return spatial.local_moran(*_both(spark, sf_dir)).select("id", "quadrant")


@query(f"WITH {_LOCAL} SELECT round(regr_slope(lag, z), 6) AS slope FROM l")
def moran_scatter_slope(spark, sf_dir):
    return rounded(spatial.moran_scatter_slope(*_both(spark, sf_dir)), "slope")


@query(f"WITH {GRID}, s AS (SELECT i, j, w FROM w UNION ALL SELECT id, id, 1 FROM grid), a AS (SELECT s.i AS id, sum(w * x) AS wx, sum(w) AS sw, sum(w * w) AS sw2 FROM s JOIN grid g ON g.id = s.j GROUP BY 1), m AS (SELECT avg(x) AS m, stddev_pop(x) AS sd, count(*) AS n FROM grid) SELECT id, round((wx - m * sw) / (sd * sqrt((n * sw2 - sw * sw) / (n - 1))), 5) AS g_star FROM a, m")
def getis_ord(spark, sf_dir):
    return rounded(spatial.getis_ord(*_both(spark, sf_dir)), "g_star", digits=5)


@query(f"WITH {GRID} SELECT sum(CASE WHEN a.b + c.b = 2 THEN w / 2 ELSE 0 END) AS bb, sum(CASE WHEN a.b + c.b = 0 THEN w / 2 ELSE 0 END) AS ww, sum(CASE WHEN a.b + c.b = 1 THEN w / 2 ELSE 0 END) AS bw FROM w JOIN grid a ON a.id = i JOIN grid c ON c.id = j")
def join_counts(spark, sf_dir):
    g = grid(spark, sf_dir)
    return spatial.join_counts(g.select("id", F.col("b").alias("x")), spatial.rook_weights(g))


@query(f"WITH {GRID}, q AS (SELECT id, (x - avg(x) OVER ()) / stddev_pop(x) OVER () AS zx, (v - avg(v) OVER ()) / stddev_pop(v) OVER () AS zv FROM grid) SELECT round(sum(w * a.zx * b.zv) / sum(w), 6) AS bivariate_moran FROM w JOIN q a ON a.id = i JOIN q b ON b.id = j")
def bivariate_moran(spark, sf_dir):
    g = grid(spark, sf_dir)
    return rounded(spatial.bivariate_moran(g.select("id", "x"), g.select("id", F.col("v").alias("x")), spatial.rook_weights(g)), "bivariate_moran")


@query()
def permutation_moran(spark, sf_dir):
    return rounded(spatial.permutation_moran(*_both(spark, sf_dir), permutations=49), "moran_i", "p_value")


def _hav(a: str, b: str) -> str:
    h = f"pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2)"
    return f"12742.0::DOUBLE * atan2(sqrt({h}), sqrt(1 - ({h})))"


_NEAR = f"{PLACES}, d AS (SELECT place_id, facility_id, {_hav('p', 'f')} AS km FROM places p, facilities f), near AS (SELECT place_id, arg_min(facility_id, (round(km, 7), facility_id)) AS nearest_id, min(km) AS nearest_km FROM d GROUP BY 1), n AS (SELECT * FROM near JOIN places USING (place_id))"


def _near(spark, sf_dir):
    return spatial.nearest_facility(places(spark, sf_dir), facilities(spark, sf_dir), "place_id", "facility_id")


@query(f"WITH {_NEAR} SELECT place_id, round(nearest_km, 5) AS nearest_km FROM n")
def haversine_nearest(spark, sf_dir):
    return rounded(_near(spark, sf_dir).select("place_id", "nearest_km"), "nearest_km", digits=5)


_COVER = "sum(population) AS total, sum(CASE WHEN nearest_km <= 25 THEN population ELSE 0 END) AS within_25, sum(CASE WHEN nearest_km <= 75 THEN population ELSE 0 END) AS within_75"
_SHARES = "total, within_25, within_75, round(within_25 / total, 6) AS share_25, round(within_75 / total, 6) AS share_75, round((total - within_75) / total, 6) AS share_beyond"
_ROUND = ("share_25", "share_75", "share_beyond")


@query(f"WITH {_NEAR}, c AS (SELECT {_COVER} FROM n) SELECT {_SHARES} FROM c")
def coverage_stats(spark, sf_dir):
    return rounded(spatial.coverage(_near(spark, sf_dir), [25, 75], "nearest_km", "population"), *_ROUND)


@query(f"WITH {_NEAR}, c AS (SELECT admin, {_COVER} FROM n GROUP BY 1) SELECT admin, {_SHARES} FROM c")
def summarise_by_admin(spark, sf_dir):
    return rounded(spatial.coverage(_near(spark, sf_dir), [25, 75], "nearest_km", "population", by="admin"), *_ROUND)


@query(f"WITH {_NEAR}, c AS (SELECT {_COVER} FROM n) SELECT {_SHARES} FROM c")
def admin_rollup(spark, sf_dir):
    return rounded(spatial.roll_up(spatial.coverage(_near(spark, sf_dir), [25, 75], "nearest_km", "population", by="admin"), [25, 75]), *_ROUND)


@query(f"WITH {_NEAR} SELECT CASE WHEN place_id % 20 = 0 THEN 'unreachable' WHEN nearest_km <= 25 THEN '0-25' WHEN nearest_km <= 75 THEN '25-75' ELSE '>75' END AS band, sum(population) AS population FROM n GROUP BY 1")
def coverage_bands(spark, sf_dir):
    some = _near(spark, sf_dir).withColumn("nearest_km", F.when(F.col("place_id") % 20 != 0, F.col("nearest_km")))
    return spatial.coverage_bands(some, [25, 75], "nearest_km", "population")


@query(f"WITH {_NEAR} SELECT CASE WHEN nearest_km <= 10 THEN '0-10 km' WHEN nearest_km <= 50 THEN '10-50 km' ELSE '50+ km' END AS band, count(*) AS n FROM n GROUP BY 1")
def distance_bins(spark, sf_dir):
    return _near(spark, sf_dir).groupBy(geo.distance_band(F.col("nearest_km"), [10, 50]).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_NEAR} SELECT place_id, round(nearest_km, 5) AS nearest_km FROM n ORDER BY nearest_km DESC NULLS LAST, place_id LIMIT 10")
def farthest_places(spark, sf_dir):
    return rounded(spatial.farthest(_near(spark, sf_dir).select("place_id", "nearest_km"), "nearest_km", 10, "place_id"), "nearest_km", digits=5)


@query(f"WITH {_NEAR} SELECT nearest_id, sum(population) AS load FROM n GROUP BY 1")
def facility_load(spark, sf_dir):
    return spatial.facility_load(_near(spark, sf_dir), "nearest_id", "population")


@query(f"WITH {_NEAR}, c AS (SELECT place_id, facility_id FROM d WHERE km <= 150), r AS (SELECT facility_id, coalesce(any_value(capacity) / sum(population), 0) AS ratio FROM facilities LEFT JOIN c USING (facility_id) LEFT JOIN places USING (place_id) GROUP BY 1), a AS (SELECT place_id, sum(ratio) AS access FROM c JOIN r USING (facility_id) GROUP BY 1) SELECT place_id, round(coalesce(access, 0), 8) AS access FROM places LEFT JOIN a USING (place_id)")
def two_step_catchment(spark, sf_dir):
    return rounded(spatial.catchment_access(places(spark, sf_dir), facilities(spark, sf_dir), 150, "place_id", "facility_id"), "access", digits=8)


@query(f"WITH {_NEAR}, o AS (SELECT round(nearest_km, 6) AS x, sum(population) AS w FROM n GROUP BY 1), cum AS (SELECT *, sum(w) OVER (ORDER BY x ROWS UNBOUNDED PRECEDING) AS cw FROM o) SELECT round(sum(w * x * (2 * cw - w)) / (sum(w) * sum(w * x)) - 1, 6) AS gini FROM cum")
def access_gini(spark, sf_dir):
    return rounded(metrics.gini(rounded(_near(spark, sf_dir), "nearest_km"), "nearest_km", "population"), "gini")


@query(f"WITH {PLACES}, d AS (SELECT a.facility_id AS i, b.facility_id AS j, {_hav('a', 'b')} AS km FROM facilities a, facilities b WHERE a.facility_id <> b.facility_id), r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(km, 7), j) AS r FROM d) SELECT i, j, 0.25::DOUBLE AS w FROM r WHERE r <= 4")
def knn_weights(spark, sf_dir):
    return spatial.knn_weights(facilities(spark, sf_dir), 4, "facility_id")


@query(f"WITH {PLACES}, d AS (SELECT a.facility_id AS i, b.facility_id AS j, {_hav('a', 'b')} AS km FROM facilities a, facilities b WHERE a.facility_id <> b.facility_id) SELECT i, count(*) AS neighbours, round(sum(km), 4) AS km FROM d WHERE km <= 200 GROUP BY 1")
def distance_band_weights(spark, sf_dir):
    f = facilities(spark, sf_dir)
    pairs = spatial.within_distance(f, f.select(F.col("facility_id").alias("j"), "lat", "lon"), 200, "facility_id", "j").where("facility_id <> j")
    return pairs.groupBy(F.col("facility_id").alias("i")).agg(F.count(F.lit(1)).alias("neighbours"), F.round(F.sum("km"), 4).alias("km"))


_BOX = "box AS (SELECT c_custkey AS id, c_custkey % 30 - 15.0::DOUBLE AS x0, c_custkey % 40 - 20.0::DOUBLE AS y0, c_custkey % 30 - 15.0::DOUBLE + (c_custkey % 9) / 10.0::DOUBLE AS x1, c_custkey % 40 - 20.0::DOUBLE + (c_custkey % 7 + 1) / 10.0::DOUBLE AS y1 FROM customer)"


def _boxes(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr("c_custkey as id", "c_custkey % 30 - 15D as x0", "c_custkey % 40 - 20D as y0", "c_custkey % 30 - 15D + (c_custkey % 9) / 10D as x1", "c_custkey % 40 - 20D + (c_custkey % 7 + 1) / 10D as y1")


_AREA = "110.574 * (y1 - y0) * 111.320 * cos(radians((y0 + y1) / 2)) * (x1 - x0)"


@query(f"WITH {_BOX} SELECT id, round({_AREA}, 3) AS area_km2, round((x0 + x1) / 2, 6) AS center_lon, round((x1 - x0) * cos(radians((y0 + y1) / 2)) / (y1 - y0), 5) AS aspect, CASE WHEN x1 > x0 THEN least(greatest(floor(log2(360 / nullif(x1 - x0, 0))), 0), 22) ELSE 22 END::INTEGER AS zoom, CASE WHEN x1 = x0 THEN 'empty' WHEN {_AREA} > 2000 THEN 'too large' ELSE 'ok' END AS verdict FROM box")
def bbox_area(spark, sf_dir):
    b = tuple(F.col(c) for c in ("x0", "y0", "x1", "y1"))
    return _boxes(spark, sf_dir).select("id", F.round(geo.bbox_area_km2(*b), 3).alias("area_km2"), F.round(geo.bbox_center(b[0], b[2]), 6).alias("center_lon"), F.round(geo.bbox_aspect_ratio(*b), 5).alias("aspect"), geo.suggest_zoom(b[0], b[2]).alias("zoom"), geo.validate_aoi(*b, 2000).alias("verdict"))


@query(f"WITH {PLACES} SELECT place_id, abs(lat) + abs(lon) < 6 AS inside FROM places WHERE abs(abs(lat) + abs(lon) - 6) > 1e-9")
def point_in_polygon(spark, sf_dir):
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((6.0, 0.0), (0.0, 6.0), (-6.0, 0.0), (0.0, -6.0))])
    p = places(spark, sf_dir).where(F.abs(F.abs("lat") + F.abs("lon") - 6) > 1e-9)
    return p.select("place_id", spatial.contains(F.col("lon"), F.col("lat"), ring).alias("inside"))


@query("SELECT lon, lat FROM (SELECT -6 + i * 0.7::DOUBLE AS lon FROM range(18) t(i)), (SELECT -6 + i * 0.7::DOUBLE AS lat FROM range(18) t(i)) WHERE abs(lat) + abs(lon) < 6")
def demand_grid(spark, sf_dir):
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((6.0, 0.0), (0.0, 6.0), (-6.0, 0.0), (0.0, -6.0))])
    return spatial.grid_points(spark, -6.0, -6.0, 6.0, 6.0, 0.7, ring)


@query(f"WITH {PLACES}, n AS (SELECT n_nationkey % 5 * 4.8::DOUBLE - 12 AS x0, n_nationkey // 5 * 3.2::DOUBLE - 8 AS y0, n_name AS area FROM nation WHERE n_nationkey % 6 <> 0) SELECT place_id, min(area) AS area FROM places LEFT JOIN n ON lon > x0 + 0.001 AND lon < x0 + 4.799 AND lat > y0 + 0.001 AND lat < y0 + 3.199 GROUP BY 1")
def join_admin(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").where("n_nationkey % 6 <> 0").select(F.col("n_name").alias("area"), F.expr("n_nationkey % 5 * 4.8D - 12").alias("x0"), F.expr("(n_nationkey div 5) * 3.2D - 8").alias("y0"))
    corner = lambda dx, dy: F.struct((F.col("x0") + dx).alias("x"), (F.col("y0") + dy).alias("y"))
    areas = nation.select("area", F.array(corner(0.001, 0.001), corner(4.799, 0.001), corner(4.799, 3.199), corner(0.001, 3.199)).alias("ring"))
    return spatial.join_areas(places(spark, sf_dir).select("place_id", "lon", "lat"), areas, "area").select("place_id", "area")


@query(f"WITH {GRID}, q AS (SELECT a.id AS i, b.id AS j FROM grid a JOIN grid b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND a.id <> b.id), d AS (SELECT 'rook' AS weights, id, count(j) AS k FROM grid LEFT JOIN w ON i = id GROUP BY 1, 2 UNION ALL SELECT 'queen', id, count(j) FROM grid LEFT JOIN q ON i = id GROUP BY 1, 2) SELECT weights, count(*) AS n, count(*) FILTER (k = 0) AS islands, round(avg(k), 6) AS mean_neighbours, min(k) AS min_neighbours, max(k) AS max_neighbours, round(100 * sum(k) / (count(*) * count(*)), 6) AS pct_nonzero FROM d GROUP BY 1")
def compare_weights(spark, sf_dir):
    g = grid(spark, sf_dir)
    out = spatial.compare_weights({"rook": spatial.rook_weights(g), "queen": spatial.rook_weights(g, queen=True)}, g.select("id"))
    return rounded(out, "mean_neighbours", "pct_nonzero")


@query()
def local_moran_permutation(spark, sf_dir):
    return rounded(spatial.permutation_local(*_both(spark, sf_dir), permutations=19), "local_i", "p_value")


@query(f"WITH {_NEAR} SELECT place_id, nearest_id AS node_id, round(nearest_km, 5) AS snap_km FROM n")
def snap_to_nodes(spark, sf_dir):
    nodes = facilities(spark, sf_dir).withColumnRenamed("facility_id", "node_id")
    return rounded(spatial.snap_to_nodes(places(spark, sf_dir), nodes, "place_id").select("place_id", "node_id", "snap_km"), "snap_km", digits=5)


@query(f"WITH {_NEAR} SELECT DISTINCT nearest_id AS id FROM n")
def source_nodes(spark, sf_dir):
    nodes = facilities(spark, sf_dir).withColumnRenamed("facility_id", "node_id")
    return spatial.source_nodes(spatial.snap_to_nodes(places(spark, sf_dir), nodes, "place_id"))


@query("WITH s AS (SELECT n_nationkey AS k, n_nationkey % 5 AS x, n_nationkey // 5 AS y FROM nation), p AS (SELECT a.k AS i, b.k AS j FROM s a JOIN s b ON a.k <> b.k AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1) SELECT i, j, round(1.0::DOUBLE / count(*) OVER (PARTITION BY i), 6) AS w FROM p")
def queen_contiguity(spark, sf_dir):
    """Nations as squares of a board."""
    n = table(spark, sf_dir, "nation").selectExpr("n_nationkey as k", "cast(n_nationkey % 5 as double) as x", "cast(n_nationkey div 5 as double) as y")
    corner = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    areas = n.select("k", F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1)).alias("ring"))
    return rounded(spatial.queen_contiguity(areas, "k"), "w")


@query()
def permutation_gi_star(spark, sf_dir):
    return rounded(spatial.permutation_gi_star(*_both(spark, sf_dir), permutations=49), "g_star", "p_value", digits=5)


@query(f"WITH {PLACES} SELECT place_id, round(lon - 0.5, 6) AS min_lon, round(lat - 0.25, 6) AS min_lat, round(lon + 1, 6) AS max_lon, round(lat + 0.5, 6) AS max_lat FROM places")
def bbox_of_geojson(spark, sf_dir):
    """A triangle round each place, as a bare geometry, a feature or a collection of features."""
    point = lambda dx, dy: F.concat(F.lit("["), (F.col("lon") + dx).cast("string"), F.lit(", "), (F.col("lat") + dy).cast("string"), F.lit("]"))
    ring = F.concat_ws(",", point(-0.5, 0), point(1, -0.25), point(0, 0.5), point(-0.5, 0))
    shape = F.concat(F.lit('{"type":"Polygon","coordinates":[['), ring, F.lit("]]}"))
    feature = F.concat(F.lit('{"type":"Feature","properties":{"at":[99,99]},"geometry":'), shape, F.lit("}"))
    many = F.concat(F.lit('{"type":"FeatureCollection","features":['), feature, F.lit("]}"))
    doc = F.when(F.col("place_id") % 3 == 0, shape).when(F.col("place_id") % 3 == 1, feature).otherwise(many)
    return rounded(places(spark, sf_dir).select("place_id", geo.bbox_of_geojson(doc).alias("b")).select("place_id", "b.*"), "min_lon", "min_lat", "max_lon", "max_lat")
