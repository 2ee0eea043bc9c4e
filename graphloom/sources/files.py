"""Files of the feature pipeline: sparse feature rows, matrices, configurations, results."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import l2_normalised
from graphloom.operators.graphs import Graphs


def write_svmlight(vectors: DataFrame, path: str) -> None:
    """(graph_id, vertex_id, features) as lines `0 0:graph_id 1:vertex_id slot:value ...`, slots from 2, zeros left out."""
    cells = F.filter(F.transform("features", lambda x, i: F.when(x != 0, F.concat_ws(":", (i + 2).cast("string"), x.cast("string")))), lambda s: s.isNotNull())
    line = F.concat_ws(" ", F.lit("0"), F.concat(F.lit("0:"), "graph_id"), F.concat(F.lit("1:"), "vertex_id"), F.concat_ws(" ", cells))
    vectors.select(F.rtrim(line).alias("value")).write.text(path)


def save_features(vectors: DataFrame, mask: DataFrame | None, path: str) -> DataFrame:
    """Writes feature rows under path/features, without the slots that the mask (slot, used) doesn't use, the mask beside them, and gives
    the metadata, which it writes too: num_samples, feature_dim, array_size (bytes of the numbers at eight each)."""
    from graphloom.operators.features import cropped

    own = vectors if mask is None else cropped(vectors, mask)
    write_svmlight(own, f"{path}/features")
    if mask is not None:
        mask.write.json(f"{path}/editmask")
    meta = own.agg(F.count("*").alias("num_samples"), F.coalesce(F.max(F.size("features")), F.lit(0)).cast("long").alias("feature_dim")).withColumn("array_size", F.expr("num_samples * (feature_dim + 2) * 8"))
    meta.write.json(f"{path}/metadata")
    return meta


def load_features(spark: SparkSession, path: str, normalise: bool = False, split: DataFrame | None = None) -> DataFrame:
    """The feature rows that save_features wrote; normalise: each over its length; split (graph_id): only rows of these graphs."""
    width = spark.read.schema("feature_dim long").json(f"{path}/metadata").first().feature_dim
    rows = read_svmlight(spark, f"{path}/features", width)
    if split is not None:
        rows = rows.join(split.select("graph_id").distinct(), "graph_id", "left_semi")
    return rows.withColumn("features", l2_normalised(F.col("features"))) if normalise else rows


def read_svmlight(spark: SparkSession, path: str, width: int) -> DataFrame:
    """graph_id, vertex_id, features array<double>; comment lines are skipped, indices start at 0."""
    lines = spark.read.text(path).where("value NOT LIKE '#%' AND trim(value) <> ''")
    pairs = F.transform(F.slice(F.split("value", " "), 2, 1_000_000_000), lambda s: F.struct(F.split(s, ":")[0].cast("int").alias("key"), F.split(s, ":")[1].cast("double").alias("value")))
    m = lines.select(F.map_from_entries(pairs).alias("m"))
    return m.select(
        F.coalesce(F.try_element_at("m", F.lit(0)), F.lit(0.0)).cast("long").alias("graph_id"),
        F.coalesce(F.try_element_at("m", F.lit(1)), F.lit(0.0)).cast("long").alias("vertex_id"),
        F.expr(f"transform(sequence(2, {width + 1}), i -> coalesce(try_element_at(m, i), 0D))").alias("features"),
    )


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """x array<double>: a row a line of numbers, # lines skipped."""
    lines = spark.read.text(path).where("value NOT LIKE '#%' AND trim(value) <> ''")
    return lines.select(F.transform(F.split(F.trim("value"), "\\s+"), lambda s: s.cast("double")).alias("x"))


def write_matrix(rows: DataFrame, path: str, column: str = "x") -> None:
    rows.select(F.concat_ws(" ", F.transform(column, lambda v: v.cast("string"))).alias("value")).write.text(path)


def read_json(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """One document a file, below path at any depth."""
    reader = spark.read.option("multiLine", True).option("recursiveFileLookup", True)
    return (reader.schema(schema) if schema else reader).json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def shortened(results: DataFrame, column: str | None = None) -> DataFrame:
    """Results without the subtrees of single splits and reruns, at the top or in a struct column."""
    if column is None:
        return results.drop("splits", "rerun")
    own = [f.name for f in results.schema[column].dataType.fields]
    gone = [n for n in ("splits", "rerun") if n in own]
    return results.withColumn(column, F.col(column).dropFields(*gone)) if gone else results


def write_centroids(centroids: DataFrame, path: str) -> DataFrame:
    """Writes centroids or medoids as a matrix, a row each by id, and gives their metadata: num_centroids, dims."""
    ordered = centroids.orderBy("cluster_id").coalesce(1)  # a model of k rows
    write_matrix(ordered.select(F.col("center").alias("x")), path)
    return centroids.agg(F.count("*").alias("num_centroids"), F.max(F.size("center")).cast("long").alias("dims"))


def read_centroids(spark: SparkSession, path: str) -> DataFrame:
    """cluster_id, center of a matrix written by write_centroids: a row's number is its id."""
    rows = [r.x for r in read_matrix(spark, path).collect()]
    return spark.createDataFrame(list(enumerate(rows)), "cluster_id int, center array<double>")


def write_labels(ids: DataFrame, path: str) -> None:
    """graph_id, vertex_id, cluster_id as lines of text."""
    ids.select(F.concat_ws(" ", "graph_id", "vertex_id", "cluster_id").alias("value")).write.text(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    part = F.split("value", " ")
    return spark.read.text(path).select(part[0].cast("long").alias("graph_id"), part[1].cast("long").alias("vertex_id"), part[2].cast("int").alias("cluster_id"))


def save_basis(spark: SparkSession, basis: np.ndarray, path: str) -> None:
    spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(basis)], "slot int, x array<double>").coalesce(1).write.parquet(path)


def load_basis(spark: SparkSession, path: str) -> np.ndarray:
    return np.array([r.x for r in spark.read.parquet(path).orderBy("slot").collect()])


def result_files(spark: SparkSession, path: str, pattern: str = "*_res.json") -> DataFrame:
    """file (its name), body of all result files below path whose name fits the pattern."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("wholetext", True).text(path)
    return rows.select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("body"))


def write_results(results: DataFrame, path: str) -> None:
    """(name, body): each body as a file <name>_res.json. Results are reports: a file each, written through Spark's file systems."""
    spark = results.sparkSession
    jvm = spark.sparkContext._jvm
    for r in results.toLocalIterator():
        at = jvm.org.apache.hadoop.fs.Path(f"{path}/{r.name}_res.json")
        out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
        out.write(bytearray(r.body.encode()))
        out.close()


def to_lists(g: Graphs) -> DataFrame:
    """One row a graph: graph_id, y, x (one label a vertex, vertices in order), edge_index (two lists of positions)."""
    v = g.vertices.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("vertex_id", "label"))).alias("v"))
    e = g.edges.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("src", "dst"))).alias("e"))
    d = v.join(e, "graph_id", "left").join(g.graphs, "graph_id").withColumn("e", F.coalesce("e", F.expr("CAST(array() AS array<struct<src: bigint, dst: bigint>>)")))
    ids = F.transform("v", lambda r: r.vertex_id)
    ends = [F.transform(F.transform("e", end), lambda v: F.array_position(ids, v) - 1) for end in (lambda r: r["src"], lambda r: r["dst"])]
    return d.select("graph_id", "y", F.transform("v", lambda r: r.label).alias("x"), F.array(*ends).alias("edge_index"))


def from_lists(rows: DataFrame) -> Graphs:
    """The graphs of such rows, vertices numbered from 0."""
    v = rows.select("graph_id", F.posexplode("x").alias("vertex_id", "label")).withColumn("vertex_id", F.col("vertex_id").cast("long"))
    e = rows.select("graph_id", F.explode(F.arrays_zip(F.col("edge_index")[0].alias("src"), F.col("edge_index")[1].alias("dst"))).alias("e")).select("graph_id", "e.src", "e.dst")
    return Graphs(v, e, rows.select("graph_id", "y"))


def read_graph_lists(spark: SparkSession, path: str) -> Graphs:
    """A collection kept as one row a graph, as to_lists makes them."""
    return from_lists(spark.read.parquet(path))


FIXED_SPLITS = "fold int, test array<bigint>, model_selection array<struct<train: array<bigint>, validation: array<bigint>>>"


def read_fixed_splits(spark: SparkSession, path: str) -> DataFrame:
    """fold, role, graph_id from JSON lines of fixed splits."""
    from graphloom.operators.experiments import fixed_splits

    return fixed_splits(spark.read.schema(FIXED_SPLITS).json(path))


def prox_h(name):
    """h of a dataset called <h>-Prox, null for other names."""
    return F.when(F.col(name).rlike("^\\d+-Prox$"), F.regexp_extract(name, "^(\\d+)-Prox$", 1).cast("int"))
