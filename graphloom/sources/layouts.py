"""Collections of graphs in the file layouts that benchmarks are handed out in, read and written a line a row.

Both layouts tie their files together by line numbers. A line's number is the lines of all parts before its own, a prefix sum over a
row for each part, and its place there, so that numbering moves no lines and no task reads more than a part.

* Benchmark layout: `<name>_A.txt` (pairs of vertices from 1), `<name>_graph_indicator.txt` (the graph of each vertex), `<name>_graph_labels.txt`,
  `<name>_node_labels.txt` and, optionally, `<name>_node_attributes.txt`.
* Archive layout: flat rows of all graphs one after another in `raw/edge.csv.gz` (vertices from 0 in each graph, an edge once) and `raw/node-feat.csv.gz`, with
  `raw/num-node-list.csv.gz`, `raw/num-edge-list.csv.gz` and `raw/graph-label.csv.gz`, a line a graph, and `split/<scheme>/{train,valid,test}.csv.gz`.

Each of these may be a file or a folder of parts in the order of their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators.graphs import Graphs, dataset_index, symmetric, undirected
from graphloom.plans import cut

#: Rows of a bucket of a range join: so many intervals with rows of their own meet in one at most, and one more.
BUCKET = 256
#: Rows of the keys' ranges within which prefix sums run.
STRIDE = 65_536


def numbered_lines(spark: SparkSession, path: str, first: int = 1) -> DataFrame:
    """line (from `first`, in the order of parts and of lines in them), value. Empty lines at the end of a file have numbers too."""
    # a part is read by one task from its start to its end, so ids that grow within a task count a part's lines from its least id on
    rows = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    parts = rows.groupBy("file", "start").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a part
    parts = parts.select("file", "start", (before - F.col("first_id") + first).alias("shift"))
    return rows.join(parts, ["file", "start"]).select((F.col("id") + F.col("shift")).alias("line"), "value")


def prefix_sums(rows: DataFrame, key: str, value: str) -> DataFrame:
    """rows + start: the sum of `value` over all smaller keys (integers, each once). Sums run within STRIDE keys, and over a row for each."""
    part = F.floor(F.col(key) / STRIDE)
    rows = rows.withColumn("_part", part)
    base = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = rows.groupBy("_part").agg(F.sum(value).alias("_n")).select("_part", base.alias("_base"))
    own = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("start", own).join(parts, "_part").withColumn("start", F.col("start") + F.col("_base")).drop("_part", "_base")


def dealt_to(rows: DataFrame, place: str, intervals: DataFrame) -> DataFrame:
    """Each row with the other columns of the interval (start, n) that holds its place: a join on buckets of places, within which places are
    compared. Intervals don't overlap, so that the rows of a bucket are compared with BUCKET + 1 intervals at most."""
    bucket = F.explode(F.sequence(F.floor(F.col("start") / BUCKET), F.floor((F.col("start") + F.col("n") - 1) / BUCKET)))
    i = intervals.where("n > 0").withColumn("_bucket", bucket)
    both = rows.withColumn("_bucket", F.floor(F.col(place) / BUCKET)).join(i, "_bucket")
    return both.where((F.col(place) >= F.col("start")) & (F.col(place) < F.col("start") + F.col("n"))).drop("_bucket")


def _numbers(line: Column | str = "value") -> Column:
    return F.transform(F.split(F.trim(line), "\\s*,\\s*"), lambda s: s.cast("double"))


def _whole(value: Column) -> Column:
    return F.trim(value).cast("double").cast("long")


def _ranked(values: DataFrame, column: str) -> DataFrame:
    """column, rank: from 0 over the distinct values, which are classes and so few."""
    return values.select(column).distinct().select(column, (F.row_number().over(Window.orderBy(column)) - 1).cast("int").alias("rank"))


def read_benchmark(spark: SparkSession, path: str, name: str, attributes: bool = False) -> Graphs:
    """A collection in the benchmark layout. Vertices keep their numbers in the files, labels begin at 0, classes are 0.. in the order
    of their values; loops and repeated edges are left out. attributes: vertices also have `attributes`, an array of doubles."""
    file = lambda what: numbered_lines(spark, f"{path}/{name}_{what}.txt")
    of = file("graph_indicator").select(F.col("line").alias("vertex_id"), _whole(F.col("value")).alias("graph_id"))
    labels = file("node_labels").select(F.col("line").alias("vertex_id"), _whole(F.split("value", ",")[0]).alias("label"))
    least = labels.agg(F.min("label").alias("least"))
    vertices = of.join(labels, "vertex_id").crossJoin(F.broadcast(least)).select("graph_id", "vertex_id", (F.col("label") - F.col("least")).cast("int").alias("label"))
    if attributes:
        own = file("node_attributes").select(F.col("line").alias("vertex_id"), _numbers().alias("attributes"))
        vertices = vertices.join(own, "vertex_id").select("graph_id", "vertex_id", "label", "attributes")
    ends = F.split("value", ",")
    pairs = spark.read.text(f"{path}/{name}_A.txt").where("trim(value) <> ''").select(_whole(ends[0]).alias("src"), _whole(ends[1]).alias("dst"))
    edges = pairs.where("src <> dst").distinct().join(of.withColumnRenamed("vertex_id", "src"), "src").select("graph_id", "src", "dst")
    y = file("graph_labels").select(F.col("line").alias("graph_id"), _whole(F.col("value")).alias("class"))
    graphs = y.join(F.broadcast(_ranked(y, "class")), "class").select("graph_id", F.col("rank").alias("y"))
    return Graphs(vertices, edges, graphs)


def _lines(rows: DataFrame, order: list[str], path: str, compression: str = "none") -> None:
    """Writes the column value, sorted over all parts."""
    rows.orderBy(*order).select("value").write.option("compression", compression).text(path)


def _numbered_graphs(g: Graphs) -> DataFrame:
    """graph_id, y, number: from 0 in the order of graph_id."""
    ids = g.graphs.select("graph_id", "y").withColumn("one", F.lit(1).cast("long"))
    return prefix_sums(ids, "graph_id", "one").select("graph_id", "y", F.col("start").alias("number"))


def _ordered_rows(g: Graphs) -> DataFrame | None:
    """graph_id, y, number, start (vertices of the graphs before), n, labels, half (edges once, as places) of packed graphs, a row each: what
    files need is a sort of these rows by number. None where some graph isn't packed."""
    if g.rows is None or g.rest is not None:
        return None
    numbers = _numbered_graphs(g).join(g.rows.select("graph_id", F.size("v").cast("long").alias("n")), "graph_id")
    numbers = prefix_sums(numbers, "number", "n").select("graph_id", "y", "number", "start", "n")
    ids = F.transform("v", lambda x: x.vertex_id)
    place = lambda x: F.array_position("ids", x) - 1
    half = F.sort_array(F.transform("e", lambda x: F.struct(place(x.src).alias("src"), place(x.dst).alias("dst"))))
    own = g.rows.select("graph_id", ids.alias("ids"), F.transform("v", lambda x: x.label).alias("labels"), "e").select("graph_id", "labels", half.alias("half"))
    return cut(own.join(numbers, "graph_id"))


def _lists(rows: DataFrame, values: Column, path: str, compression: str = "none") -> None:
    """Writes the arrays `values` of rows of _ordered_rows(), a line an element."""
    rows.orderBy("number").select(F.explode(values).alias("value")).write.option("compression", compression).text(path)


def write_benchmark(g: Graphs, path: str, name: str) -> None:
    """Writes g in the benchmark layout: graphs and vertices are numbered from 1 in the order of their ids."""
    packed = _ordered_rows(g)
    if packed is not None:
        text = lambda x: x.cast("string")
        back = F.transform("half", lambda x: F.struct(x.dst.alias("src"), x.src.alias("dst")))
        line = lambda x: F.concat_ws(", ", text(F.col("start") + x.src + 1), text(F.col("start") + x.dst + 1))
        _lists(packed, F.array_repeat(text(F.col("number") + 1), F.col("n").cast("int")), f"{path}/{name}_graph_indicator.txt")
        _lists(packed, F.transform("labels", text), f"{path}/{name}_node_labels.txt")
        _lists(packed, F.array(text(F.col("y"))), f"{path}/{name}_graph_labels.txt")
        _lists(packed, F.transform(F.sort_array(F.concat("half", back)), line), f"{path}/{name}_A.txt")
        return
    index = dataset_index(g).select("graph_id", "vertex_id", (F.col("dataset_idx") + 1).alias("number"))
    number = _numbered_graphs(g)
    rows = index.join(g.vertices, ["graph_id", "vertex_id"]).join(number.select("graph_id", F.col("number").alias("g")), "graph_id")
    text = lambda c: F.col(c).cast("string").alias("value")
    _lines(rows.select((F.col("g") + 1).cast("string").alias("value"), "number"), ["number"], f"{path}/{name}_graph_indicator.txt")
    _lines(rows.select(text("label"), "number"), ["number"], f"{path}/{name}_node_labels.txt")
    _lines(number.select(text("y"), "number"), ["number"], f"{path}/{name}_graph_labels.txt")
    ends = g.edges
    for end in ("src", "dst"):
        ends = ends.join(index.select("graph_id", F.col("vertex_id").alias(end), F.col("number").alias(f"{end}_n")), ["graph_id", end])
    _lines(ends.select(F.concat_ws(", ", "src_n", "dst_n").alias("value"), "src_n", "dst_n"), ["src_n", "dst_n"], f"{path}/{name}_A.txt")


def read_archive(spark: SparkSession, path: str) -> Graphs:
    """A collection in the archive layout: graphs and their vertices are numbered from 0, a vertex's label is the first number of its
    row, edges are read in both directions."""
    file = lambda what: numbered_lines(spark, f"{path}/raw/{what}.csv.gz", first=0)
    counts = lambda what: prefix_sums(file(what).select(F.col("line").alias("graph_id"), _whole(F.col("value")).alias("n")), "graph_id", "n")
    nodes = dealt_to(file("node-feat"), "line", counts("num-node-list"))
    vertices = nodes.select("graph_id", (F.col("line") - F.col("start")).alias("vertex_id"), _whole(F.split("value", ",")[0]).cast("int").alias("label"))
    ends = F.split("value", ",")
    half = dealt_to(file("edge"), "line", counts("num-edge-list")).select("graph_id", _whole(ends[0]).alias("src"), _whole(ends[1]).alias("dst"))
    graphs = file("graph-label").select(F.col("line").alias("graph_id"), _whole(F.col("value")).cast("int").alias("y"))
    return Graphs(vertices, symmetric(half), graphs)


def write_archive(g: Graphs, path: str) -> None:
    """Writes g in the archive layout; graphs and, within each, vertices are numbered from 0 in the order of their ids."""
    packed = _ordered_rows(g)
    if packed is not None:
        text = lambda x: x.cast("string")
        for values, what in (
            (F.transform("labels", text), "node-feat"), (F.transform("half", lambda x: F.concat_ws(",", text(x.src), text(x.dst))), "edge"), (F.array(text(F.col("y"))), "graph-label"),
            (F.array(text(F.col("n"))), "num-node-list"), (F.array(text(F.size("half"))), "num-edge-list"),
        ):
            _lists(packed, values, f"{path}/raw/{what}.csv.gz", "gzip")
        return
    number = _numbered_graphs(g)
    places = dataset_index(g).select("graph_id", "vertex_id", "position")
    v = g.vertices.join(places, ["graph_id", "vertex_id"]).join(number.select("graph_id", "number"), "graph_id")
    text = lambda c: F.col(c).cast("string").alias("value")
    put = lambda rows, order, what: _lines(rows, order, f"{path}/raw/{what}.csv.gz", "gzip")
    put(v.select(text("label"), "number", "position"), ["number", "position"], "node-feat")
    half = undirected(g.edges)
    for end in ("src", "dst"):
        half = half.join(places.select("graph_id", F.col("vertex_id").alias(end), F.col("position").alias(f"{end}_p")), ["graph_id", end])
    e = half.join(number.select("graph_id", "number"), "graph_id")
    put(e.select(F.concat_ws(",", "src_p", "dst_p").alias("value"), "number", "src_p", "dst_p"), ["number", "src_p", "dst_p"], "edge")
    put(number.select(text("y"), "number"), ["number"], "graph-label")
    for rows, what in ((g.vertices, "num-node-list"), (half, "num-edge-list")):
        n = number.join(rows.groupBy("graph_id").agg(F.count("*").alias("n")), "graph_id", "left").select(F.coalesce("n", F.lit(0)).cast("string").alias("value"), "number")
        put(n, ["number"], what)


#: Names of the files of a split and the roles they hold (fixed values).
ROLES = {"train": "train", "valid": "val", "test": "test"}


def write_archive_splits(splits: DataFrame, path: str, scheme: str) -> None:
    """splits: role, graph_id as numbered in the archive."""
    for name, role in ROLES.items():
        _lines(splits.where(F.col("role") == role).select(F.col("graph_id").cast("string").alias("value"), "graph_id"), ["graph_id"], f"{path}/split/{scheme}/{name}.csv.gz", "gzip")


def read_archive_splits(spark: SparkSession, path: str, scheme: str) -> DataFrame:
    """fold (0), role, graph_id of the archive's fixed split."""
    out = None
    for name, role in ROLES.items():
        rows = spark.read.text(f"{path}/split/{scheme}/{name}.csv.gz").where("trim(value) <> ''").select(F.lit(0).alias("fold"), F.lit(role).alias("role"), _whole(F.col("value")).alias("graph_id"))
        out = rows if out is None else out.unionByName(rows)
    return out
