"""Graph operators on edge tables ``src, dst[, weight]``: joins and aggregations in checkpointed rounds.

The driver sees one scalar a round. Undirected operators take each edge in either direction, drop loops and
merge repeats; where weights differ the larger counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ordered import numbered
from tessera.runtime import checkpoint

#: Sources that go side by side, and edges summed at once, in ``betweenness``.
_SIDE_BY_SIDE, _EDGES_AT_ONCE = 32, 1 << 15


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge once, with ``weight``."""
    e = edges if "weight" in edges.columns else edges.withColumn("weight", F.lit(1.0))
    e = e.select("src", "dst", "weight").where("src <> dst")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    return undirected(edges).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def degree_stats(edges: DataFrame) -> DataFrame:
    a = degrees(edges).agg(F.count(F.lit(1)).alias("n"), (F.sum("degree") / 2).cast("long").alias("m"), F.avg("degree").alias("mean_degree"), F.max("degree").alias("max_degree"), F.min("degree").alias("min_degree"))
    return a


def degree_histogram(edges: DataFrame) -> DataFrame:
    return degrees(edges).groupBy("degree").agg(F.count(F.lit(1)).alias("n"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable. Alternates hanging neighbours on the smallest neighbour, first larger, then smaller ones."""
    mark = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        joined = both.join(least, "a")
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return checkpoint(out.where("a <> b").distinct())

    links = checkpoint(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).where("a <> b").distinct())
    before = mark(links)
    while before[0]:
        links = star(star(links, True), False)
        after = mark(links)
        if after == before:
            break
        before = after
    roots = links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return vertices(edges).join(roots, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def largest_component(edges: DataFrame) -> DataFrame:
    """Ids of the largest weak component, the smallest label of equals."""
    c = connected_components(edges)
    top = c.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return c.join(F.broadcast(top), "component", "left_semi").select("id")


def reachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Ids reachable from ``start(id)`` along directed edges."""
    seen = checkpoint(start.select("id").distinct())
    frontier = seen
    while not frontier.isEmpty():
        reached = edges.join(frontier, F.col("src") == F.col("id"), "left_semi").select(F.col("dst").alias("id")).distinct()
        frontier = checkpoint(reached.join(seen, "id", "left_anti"))
        seen = checkpoint(seen.union(frontier))
    return seen


def strong_component_of(edges: DataFrame, start: DataFrame) -> DataFrame:
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reachable(edges, start).join(reachable(back, start), "id", "left_semi")


def pagerank(edges: DataFrame, damping: float = 0.85, max_iter: int = 100, tol: float = 1e-9, restart: DataFrame | None = None) -> DataFrame:
    """(id, rank), summing to 1; weighted out-links, no loops, dangling mass to everyone (or by ``restart(id, weight)``)."""
    e = edges if "weight" in edges.columns else edges.withColumn("weight", F.lit(1.0))
    e = e.where("src <> dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    out = e.groupBy("src").agg(F.sum("weight").alias("total"))
    links = checkpoint(e.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")))
    ids = vertices(edges)
    n = ids.count()
    if not n:
        return ids.withColumn("rank", F.lit(0.0))
    if restart is None:
        base = ids.withColumn("base", F.lit(1.0 / n))
    else:
        total = restart.agg(F.sum("weight")).first()[0]
        base = ids.join(restart.select("id", (F.col("weight") / total).alias("base")), "id", "left").fillna(0.0, ["base"])
    base = checkpoint(base.join(out.select(F.col("src").alias("id"), F.lit(False).alias("dangling")), "id", "left").select("id", "base", F.coalesce("dangling", F.lit(True)).alias("dangling")))
    ranks = base.withColumn("rank", F.col("base"))
    lost = ranks.agg(F.sum(F.when(F.col("dangling"), F.col("rank")).otherwise(0.0))).first()[0]
    for _ in range(max_iter):
        sums = links.join(ranks.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("share") * F.col("rank")).alias("inflow"))
        new = damping * (F.coalesce("inflow", F.lit(0.0)) + lost * F.col("base")) + (1 - damping) * F.col("base")
        step = checkpoint(ranks.select("id", "base", "dangling", F.col("rank").alias("old")).join(sums, "id", "left").withColumn("rank", new).drop("inflow"))
        change, lost, mass = step.agg(F.sum(F.abs(F.col("rank") - F.col("old"))), F.sum(F.when(F.col("dangling"), F.col("rank")).otherwise(0.0)), F.sum("rank")).first()
        ranks = step.drop("old")
        if change < tol:
            break
    return ranks.select("id", (F.col("rank") / F.sum("rank").over(Window.partitionBy())).alias("rank")) if abs(mass - 1) > 1e-6 else ranks.select("id", "rank")


def label_propagation(edges: DataFrame, max_iter: int = 10) -> DataFrame:
    """(id, community): every node takes its heaviest neighbouring label, its own included with weight 1, ties to the smallest.

    All nodes move at once; a label is named by its smallest member in the end.
    """
    e = checkpoint(undirected(edges))
    labels = checkpoint(vertices(edges).withColumn("label", F.col("id")))
    for _ in range(max_iter):
        votes = e.join(labels.select(F.col("id").alias("dst"), "label"), "dst").select(F.col("src").alias("id"), "label", "weight").unionByName(labels.select("id", "label", F.lit(1.0).alias("weight")))
        best = votes.groupBy("id", "label").agg(F.sum("weight").alias("w")).groupBy("id").agg(F.min_by("label", F.struct(-F.col("w"), "label")).alias("label"))
        new = checkpoint(best)
        moved = new.join(labels.withColumnRenamed("label", "was"), "id").where("label <> was").isEmpty()
        labels = new
        if moved:
            break
    names = labels.groupBy("label").agg(F.min("id").alias("community"))
    return labels.join(names, "label").select("id", "community")


def triangles(edges: DataFrame) -> DataFrame:
    """Each triangle once as (a, b, c). Edges point from lower to higher degree, which bounds the pairs at a hub."""
    e = undirected(edges).where("src < dst").select("src", "dst")
    d = degrees(edges)
    order = lambda i, n: F.struct(F.col(n).alias("d"), F.col(i).alias("v"))
    both = e.join(d.select(F.col("id").alias("src"), F.col("degree").alias("ds")), "src").join(d.select(F.col("id").alias("dst"), F.col("degree").alias("dd")), "dst")
    up = order("src", "ds") < order("dst", "dd")
    directed = checkpoint(both.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("b"), F.when(up, order("dst", "dd")).otherwise(order("src", "ds")).alias("k")))
    wedge = directed.alias("x").join(directed.alias("y"), F.col("x.a") == F.col("y.a")).where(F.col("x.k") < F.col("y.k")).select(F.col("x.a").alias("a"), F.col("x.b").alias("b"), F.col("y.b").alias("c"))
    return wedge.join(directed.select(F.col("a").alias("b"), F.col("b").alias("c")), ["b", "c"], "left_semi").select("a", "b", "c")


def triangle_count(edges: DataFrame) -> DataFrame:
    return triangles(edges).agg(F.count(F.lit(1)).alias("triangles"))


def per_node_triangles(edges: DataFrame) -> DataFrame:
    counts = triangles(edges).select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return vertices(edges).join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0).cast("long")).alias("triangles"))


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Of ``labels(id, label)``; 0 for a graph without edges."""
    e = undirected(edges)
    side = lambda c: labels.select(F.col("id").alias(c), F.col("label").alias(f"l_{c}"))
    marked = e.join(side("src"), "src").join(side("dst"), "dst")
    per = marked.groupBy(F.col("l_src").alias("label")).agg(F.sum("weight").alias("degree"), F.sum(F.when(F.col("l_src") == F.col("l_dst"), F.col("weight")).otherwise(0.0)).alias("inside"))
    total = F.sum("degree").over(Window.partitionBy())
    return per.select((F.col("inside") / total - F.pow(F.col("degree") / total, 2)).alias("q")).agg(F.coalesce(F.sum("q"), F.lit(0.0)).alias("modularity"))


def k_core(edges: DataFrame) -> DataFrame:
    """(id, core): nodes under k are peeled until none is left, for k = 1, 2, ..."""
    e = checkpoint(undirected(edges).select("src", "dst"))
    done, k = None, 1
    left = checkpoint(vertices(edges))
    while not left.isEmpty():
        d = left.join(e.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("d")), "id", "left").fillna(0, ["d"])
        gone = checkpoint(d.where(F.col("d") < k).select("id"))
        if gone.isEmpty():
            k += 1
            continue
        part = gone.withColumn("core", F.lit(k - 1))
        done = checkpoint(part if done is None else done.unionByName(part))
        left = checkpoint(left.join(gone, "id", "left_anti"))
        e = checkpoint(e.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti"))
    return done if done is not None else vertices(edges).withColumn("core", F.lit(0))


def nearest_source(edges: DataFrame, sources: DataFrame, cost: str = "cost") -> DataFrame:
    """(id, cost, source) by relaxation from ``sources(id)`` along directed edges of non-negative cost; ties to the smallest source.

    Only nodes that got better in a round relax their edges in the next.
    """
    if not edges.where(F.col(cost) < 0).isEmpty():
        raise ValueError("negative cost")
    e = checkpoint(edges.select("src", "dst", F.col(cost).cast("double").alias("c")))
    best = checkpoint(sources.select("id", F.struct(F.lit(0.0).alias("cost"), F.col("id").alias("source")).alias("b")).distinct())
    frontier = best
    while not frontier.isEmpty():
        offers = e.join(frontier, F.col("src") == F.col("id")).groupBy(F.col("dst").alias("id")).agg(F.min(F.struct((F.col("b.cost") + F.col("c")).alias("cost"), F.col("b.source").alias("source"))).alias("o"))
        merged = checkpoint(best.join(offers, "id", "full_outer").select("id", F.coalesce(F.least("b", "o"), F.col("b"), F.col("o")).alias("b"), (F.col("b").isNull() | (F.col("o") < F.col("b"))).alias("_better")))
        frontier = merged.where("_better").select("id", "b")
        best = merged.select("id", "b")
    return best.select("id", "b.cost", "b.source")


def _sums_over(near: np.ndarray, start: np.ndarray, owner: np.ndarray, rows: np.ndarray, x: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of ``to`` that have neighbours among ``rows``, and the sums of these neighbours' ``x``."""
    degree = start[rows + 1] - start[rows]
    place = np.zeros(len(to), np.int32)
    place[rows] = np.arange(len(rows))
    if degree.sum() * 8 < len(near):  # along the rows' own edges
        ends = np.cumsum(degree)
        v, u = near[np.repeat(start[rows] - ends + degree, degree) + np.arange(degree.sum())], np.repeat(np.arange(len(rows)), degree)
        v, u = v[to[v]], u[to[v]]
        order = np.argsort(v, kind="stable")
        v, u = v[order], u[order]
    else:
        inside = np.zeros(len(to), bool)
        inside[rows] = True
        some = inside[near] & to[owner]
        v, u = owner[some], place[near[some]]
    first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]][: len(v)])
    nodes, out, of = v[first], np.zeros((len(first), x.shape[1])), np.cumsum(np.r_[False, v[1:] != v[:-1]][: len(v)])
    for a in range(0, len(v), _EDGES_AT_ONCE):
        part = of[a : a + _EDGES_AT_ONCE]
        s = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        out[part[s]] += np.add.reduceat(x[u[a : a + _EDGES_AT_ONCE]], s, axis=0)
    return nodes, out


def _dependencies(near: np.ndarray, start: np.ndarray, owner: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """Brandes' dependencies of every node, summed over different ``sources``, which go breadth first side by side.

    Neighbours of node v are ``near[start[v]:start[v + 1]]``.
    """
    n, side = len(start) - 1, np.arange(len(sources))
    far, sigma, delta = np.full((n, len(sources)), -1, np.int32), np.zeros((n, len(sources))), np.zeros((n, len(sources)))
    far[sources, side], sigma[sources, side] = 0, 1.0
    left, levels = (far < 0).any(axis=1), [np.sort(sources)]
    while left.any():
        rows = levels[-1]
        nodes, got = _sums_over(near, start, owner, rows, np.where(far[rows] == len(levels) - 1, sigma[rows], 0.0), left)
        new = (far[nodes] < 0) & (got > 0)
        some = new.any(axis=1)
        if not some.any():
            break
        nodes, got, new = nodes[some], got[some], new[some]
        far[nodes], sigma[nodes] = np.where(new, len(levels), far[nodes]), np.where(new, got, sigma[nodes])
        left[nodes] = (far[nodes] < 0).any(axis=1)
        levels.append(nodes)
    to = np.zeros(n, bool)
    for d in range(len(levels) - 1, 1, -1):
        rows, upper = levels[d], levels[d - 1]
        to[upper] = True
        here = far[rows] == d
        nodes, got = _sums_over(near, start, owner, rows, np.where(here, (1 + delta[rows]) / np.where(here, sigma[rows], 1.0), 0.0), to)
        delta[nodes] += np.where(far[nodes] == d - 1, sigma[nodes] * got, 0.0)
        to[upper] = False
    return delta.sum(axis=1)


def _by_source(edges: DataFrame, sources: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """(v, d): dependencies from graphs that every worker holds, as 8 bytes an edge and direction; sources are dealt to tasks."""
    spark = edges.sparkSession
    number = checkpoint(numbered(ids, ["id"], "r"))
    end = lambda c: number.select(F.col("id").alias(c), F.col("r").cast("int").alias(f"_{c}"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b[c].to_numpy().tobytes()]) for c in ("a", "b")], ["a", "b"])

    rows = edges.join(end("src"), "src").join(end("dst"), "dst").select(F.col("_src").alias("a"), F.col("_dst").alias("b")).mapInArrow(packed, "a binary, b binary").collect()
    a, b = (np.concatenate([np.zeros(0, np.int32), *[np.frombuffer(r[c], np.int32) for r in rows]]) for c in ("a", "b"))
    order = np.lexsort((b, a))
    shared = spark.sparkContext.broadcast((b[order], np.r_[0, np.cumsum(np.bincount(a, minlength=n))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, start = shared.value
        owner, total = np.repeat(np.arange(n, dtype=np.int32), np.diff(start)), np.zeros(n)
        for batch in batches:
            r = batch["r"].to_numpy()
            for k in range(0, len(r), _SIDE_BY_SIDE):
                total += _dependencies(near, start, owner, r[k : k + _SIDE_BY_SIDE])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["r", "d"])

    dealt = number.join(sources.select("id").distinct(), "id", "left_semi").select("r").repartition(4 * spark.sparkContext.defaultParallelism)
    total = dealt.mapInArrow(run, "r long, d double").groupBy("r").agg(F.sum("d").alias("d"))
    return number.join(total, "r").select(F.col("id").alias("v"), "d")


def _by_tables(e: DataFrame, sources: DataFrame) -> DataFrame:
    """(v, d): dependencies from breadth-first tables (source, node) forward and back, whose rows are sources times nodes."""
    level = sources.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(1.0).alias("sigma"))
    levels, seen = [checkpoint(level)], None
    while not levels[-1].isEmpty():
        seen = checkpoint(levels[-1].select("s", "v") if seen is None else seen.union(levels[-1].select("s", "v")))
        ahead = levels[-1].join(e, F.col("v") == F.col("src")).groupBy("s", F.col("dst").alias("v")).agg(F.sum("sigma").alias("sigma"))
        levels.append(checkpoint(ahead.join(seen, ["s", "v"], "left_anti")))
    delta, total = None, None
    for upper, lower in zip(reversed(levels[:-1]), [None, *reversed(levels[1:-1])], strict=False):
        if lower is None:
            delta = upper.withColumn("delta", F.lit(0.0))
        else:
            below = delta.select("s", F.col("v").alias("w"), (( 1 + F.col("delta")) / F.col("sigma")).alias("part"))
            got = below.join(e, F.col("w") == F.col("src")).groupBy("s", F.col("dst").alias("v")).agg(F.sum("part").alias("part"))
            delta = upper.join(got, ["s", "v"], "left").select("s", "v", "sigma", (F.col("sigma") * F.coalesce("part", F.lit(0.0))).alias("delta"))
        delta = checkpoint(delta)
        part = delta.where("s <> v").groupBy("v").agg(F.sum("delta").alias("d"))
        total = checkpoint(part if total is None else total.unionByName(part).groupBy("v").agg(F.sum("d").alias("d")))
    return total


def betweenness(edges: DataFrame, normalised: bool = False, sources: DataFrame | None = None, held: int = 1 << 22) -> DataFrame:
    """(id, betweenness) of an undirected, unweighted graph, from all nodes or from ``sources(id)``.

    Time goes with sources times edges. A graph of up to ``held`` edges, counted in both directions, is sent to the
    workers; a larger one stays in tables.
    """
    e = checkpoint(undirected(edges).select("src", "dst"))
    every = checkpoint(vertices(edges))
    n, begin = every.count(), sources or every
    total = _by_source(e, begin, every, n) if e.count() <= held else _by_tables(e, begin)
    scale = 0.5 * (2 / ((n - 1) * (n - 2)) if normalised and n > 2 else 1.0)
    return every.join(total, F.col("id") == F.col("v"), "left").select("id", (F.coalesce("d", F.lit(0.0)) * scale).alias("betweenness"))


def sample_subgraph(edges: DataFrame, seed_node, max_nodes: int = 200) -> DataFrame:
    """Edges among the first ``max_nodes`` nodes in breadth-first order from a node (smallest ids first within a level)."""
    e = checkpoint(undirected(edges).select("src", "dst"))
    kept = checkpoint(e.where(F.col("src") == seed_node).select(F.col("src").alias("id")).distinct())
    frontier, room = kept, max_nodes - 1
    while room > 0 and not frontier.isEmpty():
        ahead = e.join(frontier, F.col("src") == F.col("id"), "left_semi").select(F.col("dst").alias("id")).distinct().join(kept, "id", "left_anti")
        frontier = checkpoint(ahead.orderBy("id").limit(room))
        kept = checkpoint(kept.union(frontier))
        room = max_nodes - kept.count()
    inside = lambda c: kept.select(F.col("id").alias(c))
    return e.where("src < dst").join(inside("src"), "src", "left_semi").join(inside("dst"), "dst", "left_semi").select("src", "dst")


def edge_times(edges: DataFrame, speeds: dict[str, float], default: float, highway: str = "highway", length: str = "length_m") -> DataFrame:
    """Edges with speed_kph by road kind and travel_time in seconds."""
    table: Column = F.create_map(*[F.lit(x) for pair in speeds.items() for x in pair])
    speed = F.coalesce(F.element_at(table, F.col(highway)), F.lit(default))
    return edges.withColumn("speed_kph", speed).withColumn("travel_time", F.col(length) / (F.col("speed_kph") / 3.6))


def total_network_time(edges: DataFrame, time: str = "travel_time") -> DataFrame:
    """Seconds over all edges; edges without a time count nothing."""
    return edges.agg(F.coalesce(F.sum(time), F.lit(0.0)).alias("total_time"))
