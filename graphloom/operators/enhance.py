"""Cluster ids for vertices: features are normalised, projected and assigned to centroids, and the id joins the vertex's row."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import l2_normalised
from graphloom.operators import clustering as cl


def prepared(features: DataFrame, basis: np.ndarray | None = None, normalise: bool = False) -> DataFrame:
    """id (graph_id, vertex_id), x: feature rows as the clustering sees them."""
    x = l2_normalised(F.col("features")) if normalise else F.col("features")
    rows = features.select(F.struct("graph_id", "vertex_id").alias("id"), x.alias("x"))
    return rows if basis is None else cl.projected(rows, basis)


def cluster_ids(features: DataFrame, centroids: DataFrame, basis: np.ndarray | None = None, normalise: bool = False) -> DataFrame:
    """graph_id, vertex_id, cluster_id: the nearest centroid or medoid, the lower id on ties."""
    return cl.assigned(prepared(features, basis, normalise), centroids).select("id.graph_id", "id.vertex_id", "cluster_id")


def enhanced(vertices: DataFrame, ids: DataFrame) -> DataFrame:
    """vertices with cluster_id; null for a vertex without a feature row."""
    return vertices.join(ids, ["graph_id", "vertex_id"], "left")


def augmented(states: DataFrame, ids: DataFrame) -> DataFrame:
    """States (graph_id, vertex_id, h) with the cluster id as one more component; -1 for a vertex without one."""
    both = states.join(ids, ["graph_id", "vertex_id"], "left")
    return both.select("graph_id", "vertex_id", F.concat("h", F.array(F.coalesce("cluster_id", F.lit(-1)).cast("double"))).alias("h"))


def cluster_map(ids: DataFrame) -> DataFrame:
    """graph_id, clusters: a map from vertex to cluster for each graph."""
    pairs = F.sort_array(F.collect_list(F.struct("vertex_id", "cluster_id")))
    return ids.groupBy("graph_id").agg(F.map_from_entries(pairs).alias("clusters"))


def distinct_rows(features: DataFrame, k: int, seed: int = 37) -> DataFrame:
    """cluster_id, center: k distinct feature rows in the order of a seeded hash, to begin a clustering with."""
    rows = features.select("features").distinct().orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.array_join(F.transform("features", lambda v: v.cast("string")), ","))), "features").limit(k).collect()
    return features.sparkSession.createDataFrame([(i, list(r.features)) for i, r in enumerate(rows)], "cluster_id int, center array<double>")


def clustered(features: DataFrame, k: int, dims: int = 0, least: int = 0, steps: int = 3, normalise: bool = False, fit_on: DataFrame | None = None, seed: int = 37):
    """(centroids, basis) of feature rows: projected to dims (0: not at all), k-means by Lloyd's steps from distinct rows, and the
    smallest cluster dropped until all have `least` rows. fit_on (graph_id): the graphs whose rows the clusters are fitted on."""
    rows, basis = projected(features, dims, normalise)
    own = rows if fit_on is None else rows.join(fit_on.select("graph_id").distinct(), rows.id.graph_id == F.col("graph_id"), "left_semi")
    return fitted(own, k, least, steps, seed), basis


def projected(features: DataFrame, dims: int = 0, normalise: bool = False):
    """(rows, basis): id (graph_id, vertex_id) and x of feature rows, projected to dims; as they are, and None, for 0 dims."""
    width = features.select(F.size("features")).first()[0]
    rows = prepared(features, None, normalise)
    basis = cl.svd_basis(rows, width, dims) if 0 < dims < width else None
    return prepared(features, basis, normalise), basis


def fitted(v: DataFrame, k: int, least: int = 0, steps: int = 3, seed: int = 37) -> DataFrame:
    """Centroids of rows (id, x) by clustered's steps."""
    centroids = cl.lloyd(v, distinct_rows(v.select(F.col("x").alias("features")), k, seed), steps)
    return cl.merged(v, centroids, least) if least else centroids
