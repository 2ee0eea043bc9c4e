"""Bounded breadth-first distances, neighbourhoods and the subgraphs they induce."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import packed
from graphloom.plans import cut, dealt, grow


def distances(roots: DataFrame, edges: DataFrame, keys: list[str], depth: int | None) -> DataFrame:
    """keys + (root, v, d): unweighted distances from every root over edges (keys, src, dst), up to depth or all. Roots that come
    with a column v begin there: a root with several rows is a set of vertices, and distances are from the nearest of them.

    The edges are dealt by their start once, so that a level moves only its own rows. A level joins the newest rows with the edges and keeps what neither of the last two levels has: in an undirected graph a
    neighbour of level k lies on level k-1, k or k+1, so no join with all earlier levels is needed."""
    key = [*keys, "root"]
    levels = {0: cut(roots.select(*keys, "root", F.col("v" if "v" in roots.columns else "root").alias("v"), F.lit(0).alias("d")).distinct())}
    edges = dealt(edges.select(*keys, "src", "dst"), *keys, "src")

    def step(newest: DataFrame, k: int) -> DataFrame:
        reached = newest.withColumnRenamed("v", "src").join(edges, [*keys, "src"]).select(*key, F.col("dst").alias("v")).distinct()
        recent = newest.select(*key, "v")
        if k > 1:
            recent = recent.unionByName(levels[k - 2].select(*key, "v"))
        levels[k - 1] = newest
        return reached.join(recent, [*key, "v"], "left_anti").withColumn("d", F.lit(k))

    return grow(levels[0], step, depth)


def graph_distances(g, depth: int | None, roots: DataFrame | None = None) -> DataFrame:
    """graph_id, root, v, d from every vertex, or from the given roots (graph_id, root) alone."""

    def joined(g) -> DataFrame:
        every = g.vertices.select("graph_id", F.col("vertex_id").alias("root"))
        return distances(every if roots is None else every.join(roots.select("graph_id", "root"), ["graph_id", "root"], "left_semi"), g.edges, ["graph_id"], depth)

    return g.by_parts(lambda rows: packed.distances(rows, depth, roots), joined)


def ring(dist: DataFrame, r: int, s: int) -> DataFrame:
    """graph_id, root, v with r <= d <= s; r = 0 gives the s-disk."""
    return dist.where(F.col("d").between(r, s)).select("graph_id", "root", "v", "d")


def induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, root, src, dst: edges with both ends among a root's nodes."""
    n = nodes.select("graph_id", "root", "v")
    half = n.withColumnRenamed("v", "src").join(edges, ["graph_id", "src"])
    return half.join(n.withColumnRenamed("v", "dst"), ["graph_id", "root", "dst"], "left_semi").select("graph_id", "root", "src", "dst")


def induced_rings(g, r: int, s: int, roots: DataFrame | None = None) -> DataFrame:
    """induced of the rings (r = 0: disks) of all vertices, or of the given roots."""
    return g.by_parts(lambda rows: packed.induced(rows, r, s, roots), lambda g: induced(ring(graph_distances(g, s, roots), r, s), g.edges))


def relabelled(nodes: DataFrame) -> DataFrame:
    """graph_id, root, v, new_id: 0.. in the order of v within a root's nodes."""
    w = Window.partitionBy("graph_id", "root").orderBy("v")
    return nodes.select("graph_id", "root", "v", (F.row_number().over(w) - 1).cast("long").alias("new_id"))


def induced_distances(nodes: DataFrame, edges: DataFrame, depth: int | None) -> DataFrame:
    """graph_id, root, u, v, d within the subgraph that each root's nodes induce."""
    own = cut(induced(nodes, edges).withColumnRenamed("root", "centre"))
    starts = nodes.select("graph_id", F.col("root").alias("centre"), F.col("v").alias("root"))
    d = distances(starts, own, ["graph_id", "centre"], depth)
    return d.select("graph_id", F.col("centre").alias("root"), F.col("root").alias("u"), "v", "d")


def diameters(g, dist: DataFrame) -> DataFrame:
    """graph_id, connected, diameter (null unless connected), from all distances."""
    reach = dist.groupBy("graph_id").agg(F.count("*").alias("pairs"), F.max("d").alias("far"))
    n = g.vertices.groupBy("graph_id").agg(F.count("*").alias("n"))
    whole = F.col("pairs") == F.col("n") * F.col("n")
    return n.join(reach, "graph_id").select("graph_id", whole.alias("connected"), F.when(whole, F.col("far")).alias("diameter"))


def graph_diameters(g) -> DataFrame:
    """diameters from distances within the graphs themselves."""
    return g.by_parts(packed.diameters, lambda g: diameters(g, graph_distances(g, None)))


def diameter_stats(by_graph: DataFrame) -> DataFrame:
    """One row over the rows of diameters: graphs, connected graphs, and of the connected ones' diameters the least, the greatest, their
    mean, and their sum over all graphs. The first three are null where no graph is connected."""
    d = F.col("diameter")
    return by_graph.agg(F.count("*").alias("num_graphs"), F.count(d).alias("num_connected"), F.min(d).alias("diameter_min"), F.max(d).alias("diameter_max"), F.avg(d).alias("avg_connected"), (F.sum(F.coalesce(d, F.lit(0))) / F.count("*")).alias("avg_all"))


def components(vertices: DataFrame, edges: DataFrame, key: str = "id") -> DataFrame:
    """(id, comp): least id reachable over symmetric (a, b), by least neighbours and pointer jumping."""
    labels = cut(vertices.select(F.col(key).alias("id"), F.col(key).alias("comp")))
    while True:
        near = edges.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
        joined = labels.join(near, "id", "left").select("id", "comp", F.least("comp", "near").alias("next"))
        jump = labels.select(F.col("id").alias("next"), F.col("comp").alias("far"))
        step = cut(joined.join(jump, "next", "left").select("id", "comp", F.least("next", "far").alias("next")))
        labels = step.select("id", F.col("next").alias("comp"))
        if step.where("comp <> next").isEmpty():
            return labels
