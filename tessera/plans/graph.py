"""Queries over the whole graph of nations and suppliers, and of suppliers in chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalogue import query
from tessera.operators import graph
from tessera.sources.tables import table

from .inputs import rounded

# nodes: nations, and suppliers as 1000 + key; an edge where a supplier serves customers of a nation, and along the chains
EDGES = """sold AS (SELECT l_suppkey + 1000 AS src, c_nationkey::BIGINT AS dst, count(*) AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
edges AS (SELECT src, dst, 1.0::DOUBLE AS weight, c FROM sold UNION ALL SELECT s_suppkey + 1000, s_suppkey + 1001, 1.0, 1 FROM supplier WHERE s_suppkey % 4 <> 0 AND s_suppkey < (SELECT max(s_suppkey) FROM supplier)),
both_ AS (SELECT src, dst, max(weight) AS weight FROM (SELECT src, dst, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges) WHERE src <> dst GROUP BY 1, 2)"""


def edges(spark, sf_dir):
    """The pairs of supplier and nation that trade, and the chains of suppliers."""
    line = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    sold = line.groupBy((F.col("l_suppkey") + 1000).alias("src"), F.col("c_nationkey").cast("long").alias("dst")).agg(F.count(F.lit(1)).alias("c"))
    supplier = table(spark, sf_dir, "supplier")
    last = F.broadcast(supplier.agg(F.max("s_suppkey").alias("last")))
    chain = supplier.crossJoin(last).where("s_suppkey % 4 <> 0 and s_suppkey < last").selectExpr("s_suppkey + 1000 as src", "s_suppkey + 1001 as dst", "1L as c")
    return sold.unionByName(chain).select("src", "dst", F.lit(1.0).alias("weight"), "c")


@query(f"WITH {EDGES}, d AS (SELECT src, count(*) AS degree FROM both_ GROUP BY 1) SELECT count(*) AS n, (sum(degree) / 2)::BIGINT AS m, round(avg(degree), 6) AS mean_degree, max(degree) AS max_degree, min(degree) AS min_degree FROM d")
def degree_stats(spark, sf_dir):
    return rounded(graph.degree_stats(edges(spark, sf_dir)), "mean_degree")


@query(f"WITH {EDGES}, d AS (SELECT src, count(*) AS degree FROM both_ GROUP BY 1) SELECT degree, count(*) AS n FROM d GROUP BY 1")
def degree_histogram(spark, sf_dir):
    return graph.degree_histogram(edges(spark, sf_dir))


_REACH = f"{EDGES}, r(id, root) AS (SELECT DISTINCT src, src FROM both_ UNION SELECT p.dst, r.root FROM r JOIN both_ p ON p.src = r.id), comp AS (SELECT id, min(root) AS component FROM r GROUP BY 1)"


@query(f"WITH RECURSIVE {_REACH} SELECT id, component FROM comp")
def connected_components(spark, sf_dir):
    return graph.connected_components(edges(spark, sf_dir))


@query(f"WITH {EDGES}, u AS (SELECT src, dst FROM both_ WHERE src < dst) SELECT count(*) AS triangles FROM u x JOIN u y ON x.dst = y.src JOIN u z ON z.src = x.src AND z.dst = y.dst")
def triangle_count(spark, sf_dir):
    return graph.triangle_count(edges(spark, sf_dir))


@query(f"WITH {EDGES}, t AS (SELECT x.src, count(*) // 2 AS n FROM both_ x JOIN both_ y ON x.dst = y.src JOIN both_ z ON z.src = y.dst AND z.dst = x.src GROUP BY 1) SELECT id, coalesce(n, 0)::BIGINT AS triangles FROM (SELECT DISTINCT src AS id FROM both_) LEFT JOIN t ON t.src = id")
def per_node_triangles(spark, sf_dir):
    return graph.per_node_triangles(edges(spark, sf_dir))


@query(f"WITH {EDGES}, m AS (SELECT src % 6 AS a, dst % 6 AS b, weight FROM both_), p AS (SELECT a, sum(weight) AS d, sum(CASE WHEN a = b THEN weight ELSE 0 END) AS i FROM m GROUP BY 1) SELECT round(sum(i / t - pow(d / t, 2)), 6) AS modularity FROM p, (SELECT sum(d) AS t FROM p)")
def modularity(spark, sf_dir):
    e = edges(spark, sf_dir)
    return rounded(graph.modularity(e, graph.vertices(e).select("id", (F.col("id") % 6).alias("label"))), "modularity")


def _costs(spark, sf_dir):
    return graph.undirected(edges(spark, sf_dir)).selectExpr("src", "dst", "cast((src * 13 + dst * 13) % 17 + 1 as double) as cost")


_COSTS = f"{EDGES}, costs AS (SELECT src, dst, ((src * 13 + dst * 13) % 17 + 1)::DOUBLE AS cost FROM both_)"
#: Shortest paths as repeated relaxation of whole tables: after 12 rounds nothing changes on these graphs.
_ROUNDS = ", ".join(
    f"b{i} AS (SELECT id, min(b) AS b FROM (SELECT id, b FROM b{i - 1} UNION ALL SELECT dst, struct_pack(cost := b.cost + c.cost, source := b.source) FROM b{i - 1} JOIN costs c ON c.src = id) GROUP BY 1)" for i in range(1, 13)
)
_PATHS = f"{_COSTS}, b0 AS (SELECT DISTINCT src AS id, struct_pack(cost := 0.0::DOUBLE, source := src) AS b FROM costs WHERE src % 500 = 3), {_ROUNDS}"


@query(f"WITH {_PATHS} SELECT id, b.cost AS cost, b.source AS source FROM b12")
def nearest_source(spark, sf_dir):
    costs = _costs(spark, sf_dir)
    return graph.nearest_source(costs, graph.vertices(costs).where("id % 500 = 3"))


@query(f"WITH {_PATHS} SELECT id, round(b.cost / 60, 6) AS minutes FROM b12")
def shortest_times(spark, sf_dir):
    costs = _costs(spark, sf_dir)
    return graph.nearest_source(costs, graph.vertices(costs).where("id % 500 = 3")).select("id", F.round(F.col("cost") / 60, 6).alias("minutes"))


def _ranks(base: str, rounds: int = 30) -> str:
    """Power iteration unrolled: ``base`` is each node's share of a restart, and of what nodes without links lose."""
    steps = ", ".join(
        f"r{i} AS MATERIALIZED (SELECT b.id, 0.85 * (coalesce(s.inflow, 0) + l.lost * b.base) + 0.15 * b.base AS rank FROM base b LEFT JOIN (SELECT dst AS id, sum(share * rank) AS inflow FROM links JOIN r{i - 1} ON src = id GROUP BY 1) s USING (id), (SELECT coalesce(sum(rank), 0) AS lost FROM r{i - 1} WHERE id NOT IN (SELECT src FROM links)) l)"
        for i in range(1, rounds + 1)
    )
    return f"""{EDGES}, flow AS (SELECT src, dst, sum(weight) AS weight FROM edges WHERE src <> dst GROUP BY 1, 2),
links AS MATERIALIZED (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM flow), ids AS (SELECT DISTINCT src AS id FROM both_),
base AS MATERIALIZED ({base}), r0 AS MATERIALIZED (SELECT id, base AS rank FROM base), {steps} SELECT id, round(rank, 6) AS rank FROM r{rounds}"""


@query("WITH " + _ranks("SELECT id, 1.0::DOUBLE / count(*) OVER () AS base FROM ids"))
def pagerank(spark, sf_dir):
    return rounded(graph.pagerank(edges(spark, sf_dir), max_iter=30, tol=1e-12), "rank")


@query("WITH " + _ranks("SELECT id, CASE WHEN id < 3 THEN 1.0::DOUBLE / count(*) FILTER (id < 3) OVER () ELSE 0 END AS base FROM ids"))
def personalized_pagerank(spark, sf_dir):
    e = edges(spark, sf_dir)
    restart = graph.vertices(e).where("id < 3").select("id", F.lit(1.0).alias("weight"))
    return rounded(graph.pagerank(e, max_iter=30, tol=1e-12, restart=restart), "rank")


@query()
def label_propagation(spark, sf_dir):
    return graph.label_propagation(edges(spark, sf_dir))


@query()
def k_core(spark, sf_dir):
    return graph.k_core(edges(spark, sf_dir))


@query()
def betweenness(spark, sf_dir):
    return rounded(graph.betweenness(edges(spark, sf_dir)), "betweenness", digits=5)


@query()
def sample_subgraph(spark, sf_dir):
    return graph.sample_subgraph(edges(spark, sf_dir), 3, 50)


@query(f"WITH RECURSIVE {_REACH} SELECT id FROM comp WHERE component = (SELECT component FROM comp GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1)")
def largest_component(spark, sf_dir):
    return graph.largest_component(edges(spark, sf_dir))


_SPEED = "CASE kind WHEN 'motorway' THEN 100 WHEN 'residential' THEN 30 ELSE 50 END::DOUBLE"


@query(f"WITH {EDGES}, roads AS (SELECT CASE src % 3 WHEN 0 THEN 'motorway' WHEN 1 THEN 'residential' ELSE 'track' END AS kind, (src % 50 + dst % 50 + 1) * 100.0::DOUBLE AS m FROM edges) SELECT round(sum(m / ({_SPEED} / 3.6)), 4) AS total_time FROM roads")
def total_network_time(spark, sf_dir):
    kind = F.when(F.col("src") % 3 == 0, "motorway").when(F.col("src") % 3 == 1, "residential").otherwise("track")
    roads = edges(spark, sf_dir).select(kind.alias("highway"), F.expr("(src % 50 + dst % 50 + 1) * 100D").alias("length_m"))
    return rounded(graph.total_network_time(graph.edge_times(roads, {"motorway": 100.0, "residential": 30.0}, 50.0)), "total_time", digits=4)
