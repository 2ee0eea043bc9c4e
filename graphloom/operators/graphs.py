"""Collections of labelled graphs: three tables, their statistics and index lookups."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators import packed
from graphloom.plans import dealt, fresh_path, running


@dataclass
class Graphs:
    """vertices(graph_id, vertex_id, label), edges(graph_id, src, dst) in both directions, graphs(graph_id, y).

    lines are the vertices and edges in one table dealt by graph (packed.gathered), where a source has one, and classes (graph_id, y) may
    hold graphs without vertices. Settled graphs have packed rows, and in rest those that don't fit these."""

    vertices: DataFrame
    edges: DataFrame
    graphs: DataFrame
    lines: DataFrame | None = None
    classes: DataFrame | None = None
    rows: DataFrame | None = None
    rest: Graphs | None = None

    def by_parts(self, small: Callable[[DataFrame], DataFrame], other: Callable[[Graphs], DataFrame]) -> DataFrame:
        """What small makes of the packed rows and other of the graphs beside them."""
        if self.rows is None:
            return other(self)
        out = small(self.rows)
        return out if self.rest is None else out.unionByName(other(self.rest))


def symmetric(half: DataFrame) -> DataFrame:
    """Both directions of (graph_id, src, dst), without self-loops and repeats."""
    e = half.where("src <> dst").select("graph_id", F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e"))
    return e.select("graph_id", "e.src", "e.dst").distinct()


def undirected(edges: DataFrame) -> DataFrame:
    """One row an undirected edge, the smaller end first."""
    return edges.select("graph_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def unlabelled(g: Graphs) -> Graphs:
    return Graphs(g.vertices.withColumn("label", F.lit(0)), g.edges, g.graphs)


def where(g: Graphs, predicate) -> Graphs:
    """Only graphs that fulfil the predicate."""
    kept = g.graphs.where(predicate)
    ids = kept.select("graph_id")
    if g.lines is not None:
        classes = g.classes.where(predicate)
        ids = classes.select("graph_id")
        lines = g.lines.join(ids, "graph_id", "left_semi")
        return Graphs(g.vertices.join(ids, "graph_id", "left_semi"), g.edges.join(ids, "graph_id", "left_semi"), kept, lines, classes)
    return Graphs(g.vertices.join(ids, "graph_id", "left_semi"), g.edges.join(ids, "graph_id", "left_semi"), kept)


def sizes(g: Graphs) -> DataFrame:
    return g.vertices.groupBy("graph_id").agg(F.count("*").alias("size"))


def degrees(g: Graphs) -> DataFrame:
    d = g.edges.groupBy("graph_id", F.col("src").alias("vertex_id")).agg(F.count("*").alias("degree"))
    return g.vertices.select("graph_id", "vertex_id").join(d, ["graph_id", "vertex_id"], "left").fillna(0, ["degree"])


def alphabet(g: Graphs) -> DataFrame:
    """label: every label once."""
    return g.vertices.select("label").distinct()


def labels_by_graph(g: Graphs) -> DataFrame:
    return g.vertices.groupBy("graph_id").agg(F.count_distinct("label").alias("labels"))


def classes(g: Graphs) -> DataFrame:
    """y, first_graph, n of each class."""
    return g.graphs.groupBy("y").agg(F.min("graph_id").alias("first_graph"), F.count("*").alias("n"))


def properties(g: Graphs) -> DataFrame:
    """One row of totals and of average, least and most size and number of labels."""
    by = g.vertices.groupBy("graph_id").agg(F.count("*").alias("size"), F.count_distinct("label").alias("labels"))
    stats = [f(c).alias(f"{c}_{n}") for c in ("size", "labels") for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max))]
    one = by.agg(F.count("*").alias("num_graphs"), F.sum("size").alias("num_vertices"), *stats)
    return one.crossJoin(g.vertices.agg(F.count_distinct("label").alias("num_labels"))).crossJoin(g.graphs.agg(F.count_distinct("y").alias("num_classes")))


def offsets(g: Graphs, buckets: int = 64) -> DataFrame:
    """graph_id, size, start: vertices of all graphs with a smaller id. The prefix sum runs within id buckets, and
    over one row a bucket, so that no task sorts all graphs."""
    s = sizes(g)
    span = s.agg(F.min("graph_id").alias("lo"), F.max("graph_id").alias("hi"))
    s = s.crossJoin(F.broadcast(span)).withColumn("b", F.floor((F.col("graph_id") - F.col("lo")) * buckets / (F.col("hi") - F.col("lo") + 1)))
    before = s.groupBy("b").agg(F.sum("size").alias("n"))
    before = before.select("b", F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    own = Window.partitionBy("b").orderBy("graph_id").rowsBetween(Window.unboundedPreceding, -1)
    return s.join(F.broadcast(before), "b").select("graph_id", "size", (F.col("base") + F.coalesce(F.sum("size").over(own), F.lit(0))).alias("start"))


def dataset_index(g: Graphs) -> DataFrame:
    """graph_id, vertex_id, position in the graph, dataset_idx: its row in the whole dataset."""
    place = F.row_number().over(Window.partitionBy("graph_id").orderBy("vertex_id")) - 1
    return g.vertices.select("graph_id", "vertex_id", place.cast("long").alias("position")).join(offsets(g), "graph_id").select(
        "graph_id", "vertex_id", "position", (F.col("start") + F.col("position")).alias("dataset_idx")
    )


def database_index(g: Graphs, samples: DataFrame) -> DataFrame:
    """Rows of sampled graphs (graph_id, place) in sample order: graph_id, vertex_id, database_idx."""
    s = running(sizes(g).join(samples, "graph_id"), "place", "size", "start")
    place = F.row_number().over(Window.partitionBy("graph_id").orderBy("vertex_id")) - 1
    v = g.vertices.select("graph_id", "vertex_id", place.alias("position"))
    return v.join(s.select("graph_id", "start"), "graph_id").select("graph_id", "vertex_id", (F.col("start") + F.col("position")).cast("long").alias("database_idx"))


def mapped(g: Graphs, vertices=None, edges=None) -> Graphs:
    """Each graph after a map of its vertices and one of its edges (DataFrame to DataFrame with the same columns)."""
    return Graphs(vertices(g.vertices) if vertices else g.vertices, edges(g.edges) if edges else g.edges, g.graphs)


def settled(g: Graphs) -> Graphs:
    """The same graphs, computed once: a packed row a graph is written to the shared folder; vertices and edges of those that don't fit are
    checkpointed, dealt by graph and (start) vertex."""
    spark = g.vertices.sparkSession
    lines = g.lines
    if lines is None:
        nothing = F.lit(None).cast("long")
        v = g.vertices.select("graph_id", F.col("vertex_id").alias("src"), nothing.alias("dst"), "label", F.lit(True).alias("vertex"))
        e = g.edges.where("src < dst").select("graph_id", "src", "dst", F.lit(None).cast("int").alias("label"), F.lit(False).alias("vertex"))
        lines = v.unionByName(e)
    path = fresh_path(spark, "graphs")
    packed.gathered(lines).write.parquet(path)
    stored = spark.read.parquet(path)
    rows, other = stored.where("v IS NOT NULL"), stored.where("v IS NULL").select("graph_id")
    graphs = g.graphs if g.classes is None else g.classes.join(stored.select("graph_id"), "graph_id", "left_semi")
    if other.isEmpty():
        return Graphs(packed.vertices(rows), packed.edges(rows), graphs, rows=rows)
    of = other.withColumnRenamed("graph_id", "_id")
    v, e = (t.join(of, t.graph_id.eqNullSafe(of._id), "left_semi") for t in (g.vertices, g.edges))
    rest = Graphs(dealt(v, "graph_id", "vertex_id"), dealt(e, "graph_id", "src"), g.graphs)
    vertices, edges = packed.vertices(rows).unionByName(rest.vertices), packed.edges(rows).unionByName(rest.edges)
    return Graphs(vertices, edges, g.graphs, rows=rows, rest=rest)


def located(index: DataFrame, rows: DataFrame) -> DataFrame:
    """dataset_idx, graph_id, vertex_id of the given rows of the dataset (dataset_idx)."""
    return index.join(rows.select("dataset_idx"), "dataset_idx").select("dataset_idx", "graph_id", "vertex_id")


#: Skip lengths of the ten classes (fixed values).
SKIPS = (2, 3, 4, 5, 6, 9, 11, 12, 13, 16)


def circular_skip_links(spark: SparkSession, n: int = 41, skips=SKIPS) -> Graphs:
    """A cycle of n vertices with skip links for each class; all labels 0."""
    ids = spark.createDataFrame(list(enumerate(skips)), "graph_id long, skip long").crossJoin(spark.range(n).withColumnRenamed("id", "vertex_id"))
    half = ids.select("graph_id", F.col("vertex_id").alias("src"), F.explode(F.array((F.col("vertex_id") + 1) % n, (F.col("vertex_id") + F.col("skip")) % n)).alias("dst"))
    return Graphs(ids.select("graph_id", "vertex_id", F.lit(0).alias("label")), symmetric(half), ids.select("graph_id", F.col("graph_id").cast("int").alias("y")).distinct())
