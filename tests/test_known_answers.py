"""Small inputs with answers worked out by hand, and invariants of what SQL cannot express."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.catalogue import QUERIES
from tessera.functions import air, geo, spectral
from tessera.functions import text as tx
from tessera.operators import dealt, events, graph, metrics, models, ordered, quality, raster, series, spatial, text, trend
from tessera.operators.layers import Model, build_models
from tessera.plans import graph as plans
from tessera.sources import sinks, tables


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_air_quality(spark):
    for conc, want in ((12.0, 50), (9.0, 38), (12.04, 50), (35.5, 101), (0.0, 0), (600.0, None)):
        assert value(spark, air.pm25_to_aqi(F.lit(conc))) == want
    for conc, want in ((250.5, 301), (300.0, 340), (350.4, 381), (500.4, 500), (500.5, None), (600.0, None), (-1.0, None)):
        assert value(spark, air.pm25_to_aqi(F.lit(conc))) == want
    for conc, want in ((425.0, 301), (450.0, 329), (504.0, 389), (604.0, 500), (605.0, None)):
        assert value(spark, air.pm10_to_aqi(F.lit(conc))) == want
    assert value(spark, air.aqi_from_pollutants(F.lit(600.0), F.lit(20.0))) is None
    assert value(spark, air.aqi_from_pollutants(F.lit(500.0), F.lit(20.0))) == 500
    assert value(spark, air.pm10_to_aqi(F.lit(54.0))) == 50
    assert value(spark, air.aqi_from_pollutants(F.lit(12.0), F.lit(None).cast("double"))) == 50
    assert value(spark, air.aqi_category(F.lit(101))) == "Unhealthy for Sensitive Groups"


def test_tumbling_aggregate(spark):
    df = spark.createDataFrame([(0.0, "A", 10.0), (1800.0, "A", 20.0), (3600.0, "A", 40.0), (10.0, "B", None)], "ts double, station string, pm25 double")
    got = {(r["window_start"], r["station"]): r["mean"] for r in events.tumbling_aggregate(df, 3600.0, "pm25").collect()}
    assert got == {(0.0, "A"): 15.0, (3600.0, "A"): 40.0}


def test_sessions_split_only_after_more_than_the_gap(spark):
    df = spark.createDataFrame([("u", 0.0), ("u", 1800.0), ("u", 3600.5)], "user string, ts double")
    assert [r["session_id"] for r in events.sessionize(df, 1800).orderBy("ts").collect()] == [0, 0, 1]


def test_funnel_is_greedy_and_in_order(spark):
    rows = [("a", 1, "view"), ("a", 2, "x"), ("a", 3, "click"), ("a", 4, "buy"), ("b", 1, "click"), ("b", 2, "view"), ("b", 3, "click"), ("c", 1, "view")]
    df = spark.createDataFrame(rows, "user string, ts int, event string")
    assert [r["users"] for r in events.funnel(df, ["view", "click", "buy"]).orderBy("step").collect()] == [3, 2, 1]


def test_retention_has_every_period(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 10.0), ("b", 0.0), ("a", 35.0)], "user string, ts double")
    assert [(r["period"], r["users"], r["rate"]) for r in events.retention(df, 10.0).orderBy("period").collect()] == [(0, 2, 0.5), (1, 1, 0.0), (2, 0, 0.0), (3, 1, 0.0)]


def test_reorder_by_key_equals_blocks(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") - F.col("id") % 7 * 40.0).cast("double").alias("ts"), F.lit("k").alias("k"))
    a = events.reorder_within_lateness(df, 100.0, "id").orderBy("id").select("watermark", "late").collect()
    assert a == events.reorder_within_lateness(df, 100.0, "id", key="k").orderBy("id").select("watermark", "late").collect()


def test_misra_gries_keeps_heavy_keys(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, -1).when(F.col("id") % 5 == 0, -2).otherwise(F.col("id")).alias("k"))
    assert [r["k"] for r in events.heavy_hitter_candidates(df, "k", 2).collect()] == [-1, -2]


def test_quality_suite(spark):
    df = spark.createDataFrame([(1, "a", 5.0), (1, "z", None), (None, None, 50.0)], "k int, s string, x double")
    tests = [quality.not_null("k"), quality.accepted_values("s", ["a"], severity="warn"), quality.accepted_range("x", 0, 10), quality.unique(df, "k"), quality.expression(F.col("x") < 100)]
    got = {r["test"]: r["failures"] for r in quality.run_suite(df, tests).collect()}
    assert got == {"not_null": 1, "accepted_values": 1, "accepted_range": 1, "unique": 2, "expression": 1}
    assert quality.suite_failed(quality.run_suite(df, tests))
    assert not quality.suite_failed(quality.run_suite(df, [quality.accepted_values("s", ["a"], severity="warn")]))
    with pytest.raises(ValueError):
        quality.run_suite(df, [quality.not_null("k", severity="bad")])
    with pytest.raises(ValueError):
        quality.accepted_range("x")


def test_layers_skip_what_depends_on_a_failure(spark):
    src = {"s": spark.range(3)}
    ms = [Model("a", lambda r: r["s"], ("s",), lambda d, _: [quality.expression(F.col("id") > 1)]), Model("b", lambda r: r["a"], ("a",)), Model("c", lambda r: r["s"], ("s",))]
    out = build_models(spark, src, ms)
    assert out.failed == ["a"] and out.skipped == ["b"] and "c" in out.frames
    assert set(build_models(spark, src, ms, select=["c"]).frames) == {"s", "c"}


def test_series_conventions(spark):
    df = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate([1, 2, 3, 4])], "k string, t int, x double")
    assert [r["sma"] for r in series.sma(df, 2, "x", "k", "t").orderBy("t").collect()] == [None, 1.5, 2.5, 3.5]
    flat = spark.createDataFrame([("k", i, 5.0) for i in range(4)], "k string, t int, x double")
    assert [r["rsi"] for r in series.rsi(flat, "x", "k", "t").orderBy("t").collect()][1:] == [50.0] * 3
    assert [r["rsi"] for r in series.rsi(df, "x", "k", "t").orderBy("t").collect()][1:] == [100.0] * 3
    with pytest.raises(ValueError):
        series.macd(df, "x", "k", "t", fast=5, slow=5)


def test_backtest_lags_the_signal_and_survives_ruin(spark):
    df = spark.createDataFrame([("k", 0, 100.0, 1.0), ("k", 1, 110.0, 1.0), ("k", 2, 99.0, 0.0)], "k string, t int, price double, signal double")
    got = series.backtest(df, "k", "t").orderBy("t").collect()
    assert [r["position"] for r in got] == [0.0, 1.0, 1.0]
    assert got[-1]["equity"] == pytest.approx(1.1 * 0.9)
    broke = spark.createDataFrame([("k", 0, 100.0, 1.0), ("k", 1, 0.0, 1.0), ("k", 2, 10.0, 1.0)], "k string, t int, price double, signal double").withColumn("price", F.greatest("price", F.lit(1e-300)))
    assert [r["equity"] for r in series.backtest(broke, "k", "t").orderBy("t").collect()][:2] == [1.0, 0.0]


def test_metrics_by_hand(spark):
    df = spark.createDataFrame(list(zip([1, 0, 1, 1, 0, 0, 0, 0], [1, 1, 1, 0, 0, 0, 0, 0], strict=True)), "y int, pred int")
    assert tuple(one(metrics.confusion_counts(df))) == (2, 1, 1, 4)
    m = one(metrics.precision_recall_f1(df))
    assert m["accuracy"] == 0.75 and m["precision"] == pytest.approx(2 / 3) and m["f1"] == pytest.approx(2 / 3)
    none = spark.createDataFrame([(1, 0), (0, 0)], "y int, pred int")
    assert one(metrics.precision_recall_f1(none))["precision"] == 0.0
    assert one(metrics.precision_recall_f1(none.where("y > 5"), empty=1.0))["iou"] == 1.0
    single = spark.createDataFrame([(1, 0.5)], "y int, score double")
    assert one(metrics.roc_auc(single))["auc"] == 0.5
    ranked = spark.createDataFrame([(0, 0.1), (1, 0.1), (1, 0.9)], "y int, score double")
    assert one(metrics.roc_auc(ranked))["auc"] == 0.75


def test_drift_by_hand(spark):
    a = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "v double")
    b = spark.createDataFrame([(2.0,), (2.0,), (3.0,), (5.0,)], "v double")
    assert one(metrics.ks(a, b, "v"))["ks"] == pytest.approx(0.25)
    assert one(metrics.ks(a, a, "v"))["ks"] == 0.0
    assert one(metrics.psi(a, a, "v"))["psi"] == pytest.approx(0.0)


def test_splits_partition_rows(spark):
    df = spark.range(60).select((F.col("id") % 3).alias("label"), "id")
    got = metrics.stratified_split(df, "label", "id").groupBy("label", "part").count().collect()
    assert {(r["label"], r["part"]): r["count"] for r in got} == {(c, p): n for c in range(3) for p, n in (("train", 12), ("val", 4), ("test", 4))}


def test_text_functions(spark):
    assert value(spark, tx.word_chunks(F.lit("a b c d e f g"), 3, 1)) == ["a b c", "c d e", "e f g"]
    assert value(spark, tx.word_chunks(F.lit("one two three four five six"), 2, 0)) == ["one two", "three four", "five six"]
    assert value(spark, tx.word_chunks(F.lit(""), 5, 2)) == []
    assert value(spark, tx.word_chunks(F.lit("just two"), 10, 3)) == ["just two"]
    assert value(spark, tx.normalize_text(F.lit("See [the Docs](http://x.y) NOW! é https://a.b/c"))) == "see the docs now é"
    assert value(spark, tx.mask_line(F.lit("Got  blk_-12 from 10.0.0.1:80 took 3.5 at 0xFF"))) == "Got <*> from <*> took <*> at <*>"
    score = value(spark, tx.lexicon_score(tx.tokenize(F.lit("not good")), {"good": 2.0}))
    assert score == pytest.approx(-2 / math.sqrt(4 + 15))
    assert value(spark, tx.slug(F.lit("Nkongsamba Évêché  2"))) == "nkongsamba_eveche_2"


def test_spectral(spark):
    bands = {b: F.lit(v) for b, v in {"nir": 0.5, "red": 0.1, "green": 0.2, "blue": 0.05, "rededge": 0.3, "swir1": 0.3, "swir2": 0.2}.items()}
    assert len(spectral.list_indices()) == 34
    assert value(spark, spectral.compute_index("NDVI", bands)) == pytest.approx(0.4 / 0.6)
    assert value(spark, spectral.compute_index("ndvi", {"nir": F.lit(0.0), "red": F.lit(0.0)})) is None
    with pytest.raises(KeyError):
        spectral.compute_index("nope", bands)
    assert sum(map(len, spectral.list_indices_by_category().values())) == 34


def test_geo(spark):
    assert value(spark, geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))) == pytest.approx(math.pi * 6371.0)
    assert value(spark, geo.suggest_zoom(F.lit(0.0), F.lit(0.0))) == 22
    assert value(spark, geo.distance_band(F.lit(5.0), [5.0, 25.0])) == "0-5 km"


def _clique(*nodes):
    return [(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1 :]]


def test_graph_by_hand(spark):
    e = spark.createDataFrame([*_clique(0, 1, 2, 3), *_clique(10, 11, 12), (3, 10), (20, 21)], "src long, dst long")
    assert {r["id"]: r["component"] for r in graph.connected_components(e).collect()} == {**dict.fromkeys([0, 1, 2, 3, 10, 11, 12], 0), 20: 20, 21: 20}
    assert one(graph.triangle_count(e))["triangles"] == 5
    assert {r["id"]: r["core"] for r in graph.k_core(e).collect()} == {0: 3, 1: 3, 2: 3, 3: 3, 10: 2, 11: 2, 12: 2, 20: 1, 21: 1}
    lpa = {r["id"]: r["community"] for r in graph.label_propagation(e).collect()}
    assert lpa[0] == lpa[1] == lpa[2] == 0 and lpa[20] == lpa[21] == 20
    assert {r["id"] for r in graph.strong_component_of(spark.createDataFrame([(0, 1), (1, 0), (1, 2)], "src long, dst long"), spark.createDataFrame([(0,)], "id long")).collect()} == {0, 1}


def test_pagerank_against_dense(spark):
    pairs = [(0, 1), (0, 2), (1, 2), (2, 0), (3, 2), (3, 3), (4, 0), (1, 5)]
    n, a = 6, np.zeros((6, 6))
    for s, d in pairs:
        if s != d:
            a[s, d] = 1
    out = a.sum(axis=1)
    r = np.full(n, 1 / n)
    for _ in range(200):
        share = np.where(out[:, None] > 0, a / np.maximum(out, 1)[:, None], 0)
        r = 0.85 * (share.T @ r + r[out == 0].sum() / n) + 0.15 / n
    got = {x["id"]: x["rank"] for x in graph.pagerank(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert np.allclose([got[i] for i in range(n)], r, atol=1e-7)


def test_betweenness_of_a_path_and_a_star(spark):
    path = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "src long, dst long")
    assert {r["id"]: r["betweenness"] for r in graph.betweenness(path).collect()} == {0: 0.0, 1: 2.0, 2: 2.0, 3: 0.0}
    star = spark.createDataFrame([(0, i) for i in range(1, 5)], "src long, dst long")
    assert {r["id"]: r["betweenness"] for r in graph.betweenness(star, normalised=True).collect()}[0] == pytest.approx(1.0)


def test_graph_queries_without_sql_take_the_whole_graph(spark, data):
    """Against brute force on every trading pair and chain of the smallest tables."""
    con = duckdb.connect()
    for name in ("lineitem", "orders", "customer", "supplier"):
        con.execute(f"create view {name} as select * from '{data}/{name}.parquet'")
    pairs = con.execute("SELECT DISTINCT l_suppkey + 1000, c_nationkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey").fetchall()
    last = con.execute("SELECT max(s_suppkey) FROM supplier").fetchone()[0]
    pairs += [(k + 1000, k + 1001) for (k,) in con.execute("SELECT s_suppkey FROM supplier").fetchall() if k % 4 and k < last]
    assert plans.edges(spark, data).count() == len(pairs)
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    core, left, k = {}, {v: set(x) for v, x in near.items()}, 0
    while left:
        gone = [v for v, x in left.items() if len(x) <= k]
        core |= dict.fromkeys(gone, k)
        left = {v: x - set(gone) for v, x in left.items() if v not in core}
        k += not gone
    assert {r["id"]: r["core"] for r in plans.k_core(spark, data).collect()} == core

    far, ways = {}, {}
    for s in near:
        far[s], ways[s], level = {s: 0}, {s: 1}, [s]
        while level:
            ahead = {w for v in level for w in near[v]} - far[s].keys()
            for w in ahead:
                ways[s][w] = sum(ways[s][v] for v in level if w in near[v])
            far[s] |= dict.fromkeys(ahead, far[s][level[0]] + 1)
            level = list(ahead)
    between = {v: sum(ways[s][v] * ways[v][t] / ways[s][t] for s in far[v] for t in far[v] if s < t and v not in (s, t) and far[s][v] + far[v][t] == far[s][t]) for v in near}
    got = {r["id"]: r["betweenness"] for r in plans.betweenness(spark, data).collect()}
    assert got == pytest.approx(between, abs=1e-4)
    largest = min((far[s] for s in near), key=lambda c: (-len(c), min(c)))
    assert {r["id"] for r in plans.largest_component(spark, data).collect()} == set(largest)


def test_nearest_source_refuses_negative_costs(spark):
    with pytest.raises(ValueError):
        graph.nearest_source(spark.createDataFrame([(0, 1, -1.0)], "src long, dst long, cost double"), spark.createDataFrame([(0,)], "id long"))


def test_pair_distances_near_the_pole_side(spark):
    rng = np.random.default_rng(3)
    pts = [(i, float(lat), float(lon)) for i, (lat, lon) in enumerate(zip(rng.uniform(-75, 75, 120), rng.uniform(-20, 20, 120), strict=True))]
    a = spark.createDataFrame(pts, "i long, lat double, lon double")
    got = {(r["i"], r["j"]) for r in spatial.within_distance(a, a.withColumnRenamed("i", "j"), 500, "i", "j").collect()}
    hav = lambda p, q: value_of(p, q)

    def value_of(p, q):
        la, lo, lb, lp = map(math.radians, (p[1], p[2], q[1], q[2]))
        h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
        return 2 * 6371.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    assert got == {(p[0], q[0]) for p in pts for q in pts if hav(p, q) <= 500}


def test_nearest_facility_when_far(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 60.0, 100.0)], "p long, lat double, lon double")
    f = spark.createDataFrame([(7, 0.5, 0.0), (8, 0.5, 0.0)], "f long, lat double, lon double")
    got = {r["p"]: (r["nearest_id"], round(r["nearest_km"])) for r in spatial.nearest_facility(p, f, "p", "f").collect()}
    assert got[1] == (7, 56) and got[2][0] == 7


def test_trend(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(10)] + [("b", i, 1.0) for i in range(10)], "k string, t int, y double")
    got = {r["k"]: r for r in trend.mann_kendall(df, "k").collect()}
    assert got["a"]["s"] == 45 and got["a"]["trend"] == "increasing" and got["b"]["trend"] == "none"
    z = got["a"]["z"]
    assert got["a"]["p"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), abs=1e-6)
    wave = spark.createDataFrame([("w", t, 2.0 + 0.1 * t + 3 * math.cos(2 * math.pi * t / 10)) for t in range(60)], "k string, t int, y double")
    fit = one(trend.harmonic_fit(wave, "k", period=10.0))
    assert fit["amplitude"] == pytest.approx(3.0) and fit["slope"] == pytest.approx(0.1) and fit["rmse"] < 1e-9
    step = spark.createDataFrame([("s", t, 0.0 if t < 20 else 5.0 if t < 40 else -5.0) for t in range(60)], "k string, t int, y double")
    assert {r["break_index"] for r in trend.binary_segmentation(step, "k").collect()} == {19, 39}


def test_raster_edges(spark):
    empty = spark.createDataFrame([], "y long, x long")
    assert one(raster.mask_iou(empty, empty))["iou"] == 1.0
    diag = spark.createDataFrame([(0, 0), (1, 1)], "y long, x long")
    assert [raster.label_components(diag, 10, d).select("label").distinct().count() for d in (False, True)] == [2, 1]
    assert [(r["y"], r["x"]) for r in raster.tile_grid(spark, 10, 4, 4).collect()] == [(0, 0), (4, 0)]


def test_models(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(200, 2)))]
    df = spark.createDataFrame(rows, "i long, a double, b double")
    x = np.array([r[1:] for r in rows])
    inv = np.linalg.inv(np.cov(x.T, bias=True))
    want = np.einsum("ij,jk,ik->i", x - x.mean(0), inv, x - x.mean(0))
    got = [r["distance"] for r in models.mahalanobis(df, ["a", "b"]).orderBy("i").collect()]
    assert np.allclose(got, want)
    assert max(r["error"] for r in models.pca_error(df, ["a", "b"], 2).collect()) < 1e-6
    ci = one(models.bootstrap_mean_ci(df, "a", "i", rounds=300))
    assert ci["low"] < ci["mean"] < ci["high"] and ci["high"] - ci["low"] == pytest.approx(4 * x[:, 0].std() / math.sqrt(200), rel=0.3)


def test_distances_cross_the_date_line_and_the_poles(spark):
    """All pairs against brute force, each once; a place at 179.9 E is nearest to a facility at 179.9 W."""
    rng = np.random.default_rng(11)
    at = lambda n: [(float(y), float(x)) for y, x in zip(np.concatenate((rng.uniform(-90, 90, n), rng.uniform(88, 90, n), rng.uniform(-5, 5, n))), np.concatenate((rng.uniform(-180, 180, 2 * n), rng.choice([-1, 1], n) * rng.uniform(178, 180, n))), strict=True)]
    left, right = at(40), at(40)
    frame = lambda rows, k: spark.createDataFrame([(i, y, x) for i, (y, x) in enumerate(rows)], f"{k} long, lat double, lon double")

    def far(p, q):
        (y, x), (v, u) = np.radians(p), np.radians(q)
        return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(math.sin((v - y) / 2) ** 2 + math.cos(y) * math.cos(v) * math.sin((u - x) / 2) ** 2)))

    for km in (150.0, 2_000.0, 15_000.0):
        got = sorted((r["p"], r["f"]) for r in spatial.within_distance(frame(left, "p"), frame(right, "f"), km, "p", "f").collect())
        assert got == [(i, j) for i, p in enumerate(left) for j, q in enumerate(right) if far(p, q) <= km]
    near = spatial.nearest_facility(frame([(0.0, 179.9)], "p"), frame([(0.0, 179.4), (0.0, -179.9)], "f"), "p", "f")
    assert one(near)["nearest_id"] == 1 and one(near)["nearest_km"] == pytest.approx(22.24, abs=0.01)


def test_cosine_topk_takes_queries_in_blocks(spark, monkeypatch):
    """Seven blocks of queries, a few scored at a time, against brute force; every vector occurs twice, so that ties count."""
    monkeypatch.setattr(text, "QUERY_BLOCK", 3)
    monkeypatch.setattr(text, "SCORES", 20)
    m = np.repeat(np.random.default_rng(3).normal(size=(10, 4)), 2, axis=0)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "i long, embedding array<double>")
    got = {(r["q"], r["rank"]): (r["i"], r["score"]) for r in text.cosine_topk(df.withColumnRenamed("i", "q"), df, 3, "q", "i").collect()}
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = u @ u.T
    for q in range(20):
        for rank, i in enumerate(sorted(range(20), key=lambda i: (-round(scores[q, i], 9), i))[:3], 1):
            assert got.pop((q, rank)) == (i, pytest.approx(scores[q, i]))
    assert not got
    assert text.cosine_topk(df.where("i < 0").withColumnRenamed("i", "q"), df, 3, "q", "i").collect() == []


def test_mmr_select_takes_every_twentieth_vector(spark, data):
    ids = {r[0] for r in tables.table(spark, data, "embeddings").where("vec_id % 20 = 0").select("vec_id").collect()}
    assert {r["q"] for r in QUERIES["mmr_select"](spark, data).select("q").distinct().collect()} == ids


def test_mmr_prefers_a_different_item(spark):
    pool = spark.createDataFrame([("q", 0, [1.0, 0.0], 0.9), ("q", 1, [1.0, 0.01], 0.89), ("q", 2, [0.0, 1.0], 0.5)], "q string, i int, v array<double>, rel double")
    assert [r["i"] for r in text.mmr(pool, 2, "q", "i", "v", "rel").orderBy("pick").collect()] == [0, 2]


def test_sources_round_trip(spark, tmp_path):
    (tmp_path / "edges.txt").write_text("# a comment\n1 2\n3\t4\nx y\n\n5 6\n")
    assert sorted(tuple(r) for r in tables.load_edges(spark, str(tmp_path / "edges.txt")).collect()) == [(1, 2), (3, 4), (5, 6)]
    (tmp_path / "a.md").write_text("intro\n# The Title \ntext")
    (tmp_path / "b.md").write_text("no heading")
    assert {(r["doc_id"], r["title"]) for r in tables.load_corpus(spark, str(tmp_path)).collect()} == {("a", "The Title"), ("b", "b")}
    (tmp_path / "t.tsv").write_text('id\tname\n1\t\\N\n2\ta "quoted\n')
    assert [tuple(r) for r in tables.load_raw_tsv(spark, str(tmp_path / "t.tsv")).collect()] == [("1", None), ("2", 'a "quoted')]
    assert tables.partition_relpath(2023, 1) == "year=2023/month=01"
    with pytest.raises(ValueError):
        tables.partition_relpath(2023, 13)
    geo_json = '{"features": [{"id": "f", "properties": {"name": "n"}, "geometry": {"type": "Point", "coordinates": [1.5, 2.5]}}, {"id": "g", "properties": {}, "geometry": {"type": "LineString", "coordinates": [[0, 0]]}}]}'
    assert [tuple(r) for r in tables.geojson_points(spark.createDataFrame([(geo_json,)], "value string")).collect()] == [("f", "n", 1.5, 2.5)]
    (tmp_path / "d.json").write_text('{"body": "hi", "created_utc": 0}\n{"created_utc": 5}\n')
    assert [r["text"] for r in tables.load_dumps(spark, [str(tmp_path / "d.json")]).collect()] == ["hi"]
    payload = '{"daily": {"time": ["2023-01-01", "2023-01-02"], "tmax": [1.5]}}'
    rows = spark.createDataFrame([(payload,)], "p string").select(F.explode(tables.parse_daily_payload(F.col("p"), ["tmax"])).alias("r")).select("r.*").collect()
    assert [tuple(r) for r in rows] == [("2023-01-01", 1.5), ("2023-01-02", None)]
    sinks.write_parquet(spark.range(3), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    runs = spark.createDataFrame([("a", 0.5), ("b", 0.9), ("c", None)], "run_id string, auc double")
    assert one(sinks.best_run(runs, "auc"))["run_id"] == "b"


def test_heavy_hitter_candidates_are_exact(spark):
    even = spark.range(0, 40_000, 1, 4).select((F.col("id") % 5000).cast("string").alias("key"))
    hot = even.unionByName(spark.range(3_000).select(F.lit("hot").alias("key")))
    for rows in (even, hot, hot.unionByName(spark.range(9).select(F.lit(None).cast("string").alias("key")))):
        for k in (1, 3, 10):
            want = events.heavy_hitters(rows.where("key is not null"), "key", k).collect()
            assert events.heavy_hitter_candidates(rows, "key", k).collect() == want and len(want) == k


def test_neighbours_of_points_without_coordinates(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 1.0), (3, None, 1.0), (4, 1.0, None), (5, float("nan"), 0.0)], "id long, lat double, lon double")
    assert sorted((r["i"], r["j"]) for r in spatial.knn_weights(points, 2, "id").collect()) == [(1, 2), (2, 1)]
    assert spatial.knn_weights(points.where("id > 1"), 2, "id").collect() == []


def test_running_totals_by_range(spark):
    rows = [((i * 7919) % 1009, i % 5 - 1.5) for i in range(1009)]
    df = spark.createDataFrame(rows, "k long, x double").repartition(7)
    got = {r["k"]: (r["upto"], r["n"]) for r in ordered.numbered(ordered.running(df, [F.desc("k")], {"upto": "x"}), [F.desc("k")], "n").collect()}
    total, want = 0.0, {}
    for n, (k, x) in enumerate(sorted(rows, reverse=True)):
        total += x
        want[k] = (pytest.approx(total), n)
    assert got == want
    assert ordered.numbered(df.where("k < 0"), ["k"], "n").collect() == []


def test_pelt_is_the_best_split(spark):
    rng = np.random.default_rng(4)
    y = np.concatenate([rng.normal(m, 0.3, n) for m, n in ((0, 23), (3, 17), (-2, 30))])
    got = sorted(r["break_index"] + 1 for r in trend.pelt(spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(y)], "k string, t int, y double"), "k", penalty=3.0, jump=1).collect())
    cost = lambda a, b: float(((y[a:b] - y[a:b].mean()) ** 2).sum())
    best = {0: (-3.0, [])}
    for end in range(2, len(y) + 1):
        best[end] = min((best[s][0] + cost(s, end) + 3.0, [*best[s][1], s] if s else []) for s in best if end - s >= 2)
    assert got == best[len(y)][1] and len(got) == 2


def test_biased_factors_beat_biases(spark):
    rng = np.random.default_rng(6)
    u, v, bu, bv = rng.normal(size=(40, 2)), rng.normal(size=(30, 2)), rng.normal(size=40), rng.normal(size=30)
    rows = [(i, j, float(3 + bu[i] + bv[j] + u[i] @ v[j])) for i in range(40) for j in range(30) if (i * 7 + j * 3) % 5]
    ratings = spark.createDataFrame(rows, "user int, item int, rating double")
    rmse = lambda df: math.sqrt(df.agg(F.avg((F.col("rating") - F.col("pred")) ** 2)).first()[0])
    fitted = rmse(models.predict_biased(ratings, *models.als_biased(ratings, rank=2, reg=0.05, iters=6)))
    plain = rmse(models.biases(ratings, 0.05).withColumn("pred", F.col("rating") - F.col("residual")))
    assert fitted < 0.5 * plain
    mu, users, items = models.als_biased(ratings, rank=2, iters=1)
    assert one(models.predict_biased(spark.createDataFrame([(-1, -1)], "user int, item int"), mu, users, items))["pred"] == pytest.approx(mu)


def test_hot_and_cold_spots(spark):
    cells = spark.createDataFrame([(y * 10 + x, y, x, 9.0 if y < 3 and x < 3 else -9.0 if y > 6 and x > 6 else float((y * 7 + x * 3) % 3)) for y in range(10) for x in range(10)], "id long, y long, x long, v double")
    w = spatial.rook_weights(cells.select("id", F.col("y").alias("row"), F.col("x").alias("col")), queen=True)
    values = cells.select("id", F.col("v").alias("x"))
    got = {r["id"]: r for r in spatial.permutation_gi_star(values, w, permutations=99).collect()}
    assert got[11]["label"] == "hot" and got[88]["label"] == "cold" and got[55]["label"] == "ns"
    assert all(0.01 <= r["p_value"] <= 1 for r in got.values())
    with pytest.raises(ValueError, match="no neighbour"):
        spatial.queen_contiguity(spark.createDataFrame([(1, [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)])], "k int, ring array<struct<x: double, y: double>>"), "k")


def test_bbox_of_no_coordinates(spark):
    assert value(spark, geo.bbox_of_geojson(F.lit('{"type":"FeatureCollection","features":[]}'))) is None
    got = value(spark, geo.bbox_of_geojson(F.lit('{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[1.5e1,-2]},{"type":"LineString","coordinates":[[3,4,9],[-5,6]]}]}')))
    assert tuple(got) == (-5.0, -2.0, 15.0, 6.0)


def spots_seen(monkeypatch, module):
    """The numbers of points that ``module`` takes pairs of."""
    seen, pairs = [], spatial.within_distance

    def counted(a, b, *rest):
        seen.append((a.count(), b.count()))
        return pairs(a, b, *rest)

    monkeypatch.setattr(module, "within_distance", counted)
    return seen


def test_catchments_take_pairs_of_spots(spark, monkeypatch):
    seen = spots_seen(monkeypatch, spatial)
    places = spark.createDataFrame([(i, float(i % 3), 0.0, 2.0) for i in range(300)] + [(300, None, 0.0, 5.0)], "p long, lat double, lon double, population double")
    sites = spark.createDataFrame([(i, float(i % 2), 0.0, 4.0 if i < 20 else None) for i in range(22)], "f long, lat double, lon double, capacity double")
    got = {r["p"]: r["access"] for r in spatial.catchment_access(places, sites, 150, "p", "f").collect()}
    assert seen == [(4, 2)]  # the spot without a latitude has no pairs
    north, south = 40 / 600, 40 / 400  # capacity at 1 over the people at 0, 1 and 2; at 0 over those at 0 and 1
    assert got == pytest.approx({i: (north + south, north + south, north)[i % 3] for i in range(300)} | {300: 0.0})
    pairs = spatial.within_distance(places, sites, 150, "p", "f")
    assert got == pytest.approx({r["p"]: r["access"] for r in spatial.two_step_catchment(pairs, places, sites, "p", "f").collect()})


def test_regressions_take_pairs_of_spots(spark, monkeypatch):
    seen = spots_seen(monkeypatch, models)
    rows = [(i, float(i % 6) / 2, float(i % 4), float(i % 7), float(i % 7) * (1 + i % 6) + i % 5) for i in range(360)]
    points = spark.createDataFrame([*rows, (360, 0.0, 0.0, 1.0, None), (361, None, 0.0, 1.0, 1.0)], "p long, lat double, lon double, x double, y double")
    got = {r["p"]: (r["intercept"], r["slope"]) for r in models.gwr(points, "p", 200.0).collect()}
    assert seen == [(13, 13)]  # 12, and one without a latitude
    at = np.radians(np.array([r[1:3] for r in rows]))
    x, y = np.array([r[3:] for r in rows]).T
    for i in (0, 1, 5, 16):
        h = np.sin((at[:, 0] - at[i, 0]) / 2) ** 2 + np.cos(at[:, 0]) * np.cos(at[i, 0]) * np.sin((at[:, 1] - at[i, 1]) / 2) ** 2
        km = 2 * 6371.0 * np.arctan2(np.sqrt(h), np.sqrt(1 - h))
        w = np.where(km < 200, (1 - (km / 200) ** 2) ** 2, 0)
        a = np.column_stack([np.ones_like(x), x])
        assert got[i] == pytest.approx(np.linalg.solve((a * w[:, None]).T @ a, (a * w[:, None]).T @ y))
    assert got[360] == got[0] and got.keys() == set(range(361))


def test_topics_keep_terms_out_of_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(5)
    dense = rng.poisson(0.4, (40, 300)) + (np.arange(300) % 40 == np.arange(40)[:, None])
    counts = spark.createDataFrame([(d, f"t{t}", int(n)) for d, row in enumerate(dense) for t, n in enumerate(row) if n], "d int, term string, n long")
    seen, collect = [], type(counts).collect
    monkeypatch.setattr(type(counts), "collect", lambda df: seen.append(collect(df)) or seen[-1])
    out = models.nmf_topics(counts, "d", 3, terms=None, iters=2)
    monkeypatch.undo()
    assert sum(map(len, seen)) <= 2 * 2  # a block of terms and the sums over documents, twice
    names = sorted((f"t{t}" for t in range(300)), key=lambda t: (-dense[:, int(t[1:])].sum(), t))
    v, h = dense[:, [int(t[1:]) for t in names]], np.random.default_rng(0).uniform(0.1, 1.0, (3, 300))
    for _ in range(2):
        w = np.ones((40, 3))
        for _ in range(5):
            w = w * (v @ h.T) / (w @ (h @ h.T))
        h = h * (w.T @ v) / (w.T @ w @ h)
    h /= h.sum(axis=1, keepdims=True)
    got = {(r["topic"], r["term"]): r["weight"] for r in out.collect()}
    assert got == pytest.approx({(k, t): h[k, i] for k in range(3) for i, t in enumerate(names)})
    some = models.nmf_topics(counts, "d", 3, terms=7, iters=1)
    assert {r["term"] for r in some.collect()} == set(names[:7])


def test_permutations_are_dealt_evenly():
    for n in (1, 2, 7, 1000):
        r = np.arange(n)
        assert (dealt.targets(r, n, 42, 0) == r).all()
        for p in range(1, 30):
            assert sorted(dealt.targets(r, n, 42, p)) == list(r)
    hits = np.zeros((6, 6))
    for p in range(1, 6001):
        hits[np.arange(6), dealt.targets(np.arange(6), 6, 42, p)] += 1
    assert ((hits / 1000 - 1) ** 2).sum() * 1000 < 60  # chi square of 25 degrees of freedom; 60 has a chance of 0.0001
    assert len({tuple(dealt.targets(np.arange(5), 5, 42, p)) for p in range(1, 3001)}) == 120


@pytest.fixture
def cells(spark, monkeypatch):
    """A 12 by 12 grid over several chunks: values, rook's weights and both as matrices."""
    monkeypatch.setattr(dealt, "CHUNK", 16)
    rows = [(y * 12 + x, y, x, float((y * 5 + x * x) % 11 + 3 * (y > 7))) for y in range(12) for x in range(12)]
    g = spark.createDataFrame(rows, "id long, row long, col long, x double")
    a = np.array([[float(abs(p[1] - q[1]) + abs(p[2] - q[2]) == 1) for q in rows] for p in rows])
    x = np.array([r[3] for r in rows])
    deals = [x]
    for p in range(1, 40):
        deals.append(np.empty_like(x))
        deals[-1][dealt.targets(np.arange(144), 144, 42, p)] = x
    return g.select("id", "x"), spatial.rook_weights(g), a, np.array(deals).T


def p_values(stat):
    return (np.minimum((stat[:, 1:] >= stat[:, :1] - 1e-12).sum(axis=1), (stat[:, 1:] <= stat[:, :1] + 1e-12).sum(axis=1)) + 1) / stat.shape[1]


def test_gi_star_by_permutation_against_matrices(cells):
    values, w, a, x = cells
    got = {r["id"]: r["p_value"] for r in spatial.permutation_gi_star(values, w, permutations=39).collect()}
    assert [got[i] for i in range(144)] == pytest.approx(p_values(a @ x))


def test_local_moran_by_permutation_against_matrices(cells):
    values, w, a, x = cells
    z = x - x[:, :1].mean()
    local = z[:, :1] * (a @ z) / a.sum(axis=1)[:, None]
    got = {r["id"]: r for r in spatial.permutation_local(values, w, permutations=39).collect()}
    assert [got[i]["local_i"] for i in range(144)] == pytest.approx(local[:, 0] / x[:, 0].var())
    assert [got[i]["p_value"] for i in range(144)] == pytest.approx(p_values(local))
    flat = values.withColumn("x", F.lit(1.5))
    assert {(r["local_i"], r["p_value"], r["label"]) for r in spatial.permutation_local(flat, w, permutations=9).collect()} == {(0.0, 1.0, "ns")}


def test_moran_by_permutation_against_matrices(cells):
    values, w, a, x = cells
    z = x - x[:, :1].mean()
    s = (z * (a @ z)).sum(axis=0)
    got = one(spatial.permutation_moran(values, w, permutations=39))
    assert got["moran_i"] == pytest.approx(s[0] / a.sum() / x[:, 0].var())
    assert got["p_value"] == pytest.approx(((s[1:] >= s[0]).sum() + 1) / 40)
    flat = one(spatial.permutation_moran(values.withColumn("x", F.lit(1.5)), w, permutations=9))
    assert tuple(flat) == (None, None)


def test_betweenness_side_by_side_and_by_tables(spark, monkeypatch):
    """Two parts, a chain and a loop; the tables are used only where the graph is too large to be sent."""
    rng = np.random.default_rng(8)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 60, (110, 2))] + [(i, i + 1) for i in range(100, 130)] + [(200, 200)]
    edges, some = spark.createDataFrame(pairs, "src long, dst long"), spark.createDataFrame([(i,) for i in (1, 5, 105, 999)], "id long")
    tables = {r["id"]: r["betweenness"] for r in graph.betweenness(edges, held=0).collect()}
    part = {r["id"]: r["betweenness"] for r in graph.betweenness(edges, sources=some, held=0).collect()}
    monkeypatch.setattr(graph, "_by_tables", None)
    assert {r["id"]: r["betweenness"] for r in graph.betweenness(edges).collect()} == pytest.approx(tables)
    assert {r["id"]: r["betweenness"] for r in graph.betweenness(edges, sources=some).collect()} == pytest.approx(part)
    assert tables[115] == 15 * 15 and tables[200] == 0
    near, start, owner = np.r_[1:60, np.zeros(59, int)].astype(np.int32), np.r_[0, 59:119], np.r_[np.zeros(59, int), 1:60].astype(np.int32)
    monkeypatch.setattr(graph, "_EDGES_AT_ONCE", 7)  # a star, whose sums are made in pieces
    assert graph._dependencies(near, start, owner, np.arange(60)).tolist() == [59 * 58.0] + [0.0] * 59


def test_tokens_row_by_row(spark):
    docs = spark.createDataFrame([(1, "b a b, B!"), (2, None), (3, ""), (4, "a")], "d long, text string")
    assert sorted(map(tuple, text.token_rows(docs, "d", "text").collect())) == sorted(map(tuple, text.token_table(docs, "d", "text").collect()))
    assert text.token_rows(docs.where("d = 2"), "d", "text").collect() == []
