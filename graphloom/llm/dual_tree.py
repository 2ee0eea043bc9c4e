"""Lloyd's clustering with two trees: a cover tree over each block of vectors and one over the centroids of a round.

Vectors become integers and are taken in blocks as the scan deals them; a block's cover tree is built once, in numpy, and stored as
one row: points in the order of the tree, so that a node is a range of them, and for each node its centre, its radius and its children.
A node of scale s covers its points within s; its children are centred on points over s/2 apart that cover them within s/2, the first on the node's own centre.

A round walks pairs (node of vectors, node of centroids), all pairs of a step at once. For every point under node P some centroid is
within d(P, c) + r(P), the least of these over P's pairs being its bound; a pair whose nodes are farther apart than that, d - r(P) - r(c) > bound, is pruned.
Of a node's pairs those with the wider centroid nodes are opened first, then the node itself. A node left with one centroid is assigned whole, by sums that
are differences of prefix sums; pairs of leaves are compared exactly in integers, ties to the smaller number. Bounds are doubles with a
margin, so they never decide a tie. Only sums and counts of centroids leave a task, once a task: vectors are never shuffled.

Kept are vectors of exactly DIMS components, none null or non-finite. Repeated rows count each; equal vectors share a leaf. A null
vec_id counts as empty text in the hash that chooses the first centroids, and rows whose hashes tie are taken by their vectors. With
fewer rows than K there are as many centroids as rows; an empty table gives no rows. Components of 2^27 and more in size are
compared in Python's integers; a distance or inertia beyond 63 bits is given as 2^63 - 1. Only vec_id and embedding are
read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import stored

DIMS, K, ROUNDS, SCALE = 64, 16, 3, 64
#: Vectors of a block, and of a leaf.
BLOCK, LEAF = 2048, 4
#: Components below this size have distances within 63 bits.
SAFE = 1 << 27
LARGEST = 2**63 - 1


def quantised(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id, x: array<long> of floor(scale * component) of the kept vectors."""
    v = vectors.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v")).where(F.size("v") == dims)
    whole = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.where(F.coalesce(whole, F.lit(False))).select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("x"))


@dataclass
class Tree:
    """A cover tree. Points stand in the tree's order; node i covers points start[i] to end[i] within radius[i] of point centre[i];
    its children are nodes first[i] to last[i], none for a leaf."""

    points: np.ndarray
    order: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def leaf(self, nodes: np.ndarray) -> np.ndarray:
        return self.first[nodes] == self.last[nodes]


def _away(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    d = x - centre
    return np.sqrt(np.einsum("ij,ij->i", d, d))


def cover_tree(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """The cover tree over the rows of points (integers), level by level, without recursion."""
    x = points.astype(np.float64)
    nodes: list[list] = []  # [centre row, radius, start, end, first, last], rows by their place in `order`
    order = np.arange(len(x))
    away = _away(x, x[0])
    nodes.append([0, float(away.max()), 0, len(x), 0, 0])
    at = 0
    while at < len(nodes):
        centre, radius, start, end, _, _ = nodes[at]
        if end - start > leaf and radius > 0:
            rows, scale = order[start:end], radius / 2
            near, far = np.full(len(rows), -1), np.full(len(rows), np.inf)
            centres, c = [], centre
            while True:  # the next centre is a row that no centre covers yet
                d = _away(x[rows], x[c])
                closer = d < far
                far[closer], near[closer] = d[closer], len(centres)
                centres.append(c)
                if far.max() <= scale:
                    break
                c = int(rows[far.argmax()])
            by = np.argsort(near, kind="stable")
            order[start:end] = rows[by]
            bounds = np.searchsorted(near[by], np.arange(len(centres) + 1))
            nodes[at][4:] = [len(nodes), len(nodes) + len(centres)]
            for j, c in enumerate(centres):
                a, b = int(bounds[j]), int(bounds[j + 1])
                nodes.append([c, float(far[by][a:b].max()), start + a, start + b, 0, 0])
        at += 1
    n = list(zip(*nodes, strict=True))
    place = np.empty(len(x), np.int64)
    place[order] = np.arange(len(x))
    return Tree(points[order], order, place[np.array(n[0], np.int64)], np.array(n[1]), *(np.array(k, np.int64) for k in n[2:]))


def _opened(tree: Tree, nodes: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Children of the nodes, the other side's node beside each, and the place of each one's parent."""
    n = tree.last[nodes] - tree.first[nodes]
    parent = np.repeat(np.arange(len(nodes)), n)
    child = tree.first[nodes][parent] + np.arange(len(parent)) - np.repeat(np.cumsum(n) - n, n)
    return child, other[parent], parent


def _top(x: np.ndarray) -> int:
    """The largest size of a component."""
    return max(int(x.max()), -int(x.min())) if x.size else 0


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of equally many rows; Python's integers where 63 bits could overflow."""
    if max(_top(a), _top(b)) >= SAFE:
        a, b = a.astype(object), b.astype(object)
    d = a - b
    return (d * d).sum(1)


def assign(tree: Tree, centroids: np.ndarray, ctree: Tree) -> tuple[np.ndarray, int, int]:
    """Cluster of each point in the tree's order; how many pairs of nodes were measured, and pairs of points compared."""
    x, cx = tree.points.astype(np.float64), ctree.points.astype(np.float64)
    out = np.full(len(x), -1, np.int64)
    p, c = np.zeros(1, np.int64), np.zeros(1, np.int64)
    bound = np.full(len(tree.centre), np.inf)
    met = compared = 0
    slack = 1e-13 * max(_top(tree.points), _top(centroids))  # components of 2^53 and more are rounded as doubles
    while len(p):
        d = np.concatenate([_away(x[tree.centre[p[i : i + 65536]]], cx[ctree.centre[c[i : i + 65536]]]) for i in range(0, len(p), 65536)])
        met += len(p)
        margin = 1e-9 * (1 + d) + slack
        np.minimum.at(bound, p, d + tree.radius[p] + margin)
        held = d - tree.radius[p] - ctree.radius[c] - margin <= bound[p]
        p, c = p[held], c[held]
        pairs = np.bincount(p, minlength=len(bound))
        cleaf, pleaf = ctree.leaf(c), tree.leaf(p)
        single = (pairs[p] == 1) & cleaf & (ctree.end[c] - ctree.start[c] == 1)
        for node, of in zip(p[single].tolist(), c[single].tolist(), strict=True):
            out[tree.start[node] : tree.end[node]] = ctree.order[ctree.start[of]]
        p, c, cleaf, pleaf = p[~single], c[~single], cleaf[~single], pleaf[~single]
        wide = np.zeros(len(bound), bool)
        wide[p[~cleaf & (pleaf | (ctree.radius[c] >= tree.radius[p]))]] = True
        opens_c = wide[p] & ~cleaf
        opens_p = ~wide[p] & ~pleaf
        both = ~wide[p] & pleaf & cleaf
        compared += _leaves(tree, ctree, centroids, p[both], c[both], out)
        child_c, with_p, _ = _opened(ctree, c[opens_c], p[opens_c])
        child_p, with_c, parent = _opened(tree, p[opens_p], c[opens_p])
        bound[child_p] = bound[p[opens_p][parent]]
        stay = wide[p] & cleaf
        p, c = np.concatenate([p[stay], with_p, child_p]), np.concatenate([c[stay], child_c, with_c])
    return out, met, compared


def _leaves(tree: Tree, ctree: Tree, centroids: np.ndarray, p: np.ndarray, c: np.ndarray, out: np.ndarray) -> int:
    """Compares the points of leaves with all centroids of the leaves that are left for them."""
    if not len(p):
        return 0
    n = (tree.end[p] - tree.start[p]) * (ctree.end[c] - ctree.start[c])
    pair = np.repeat(np.arange(len(p)), n)
    k = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
    wide = (ctree.end[c] - ctree.start[c])[pair]
    point, number = tree.start[p][pair] + k // wide, ctree.order[ctree.start[c][pair] + k % wide]
    d = squared(tree.points[point], centroids[number])
    by = np.lexsort((number, d, point))
    first = by[np.flatnonzero(np.diff(point[by], prepend=-1))]
    out[point[first]] = number[first]
    return len(pair)


_FIELDS = (("centre", np.int64), ("radius", np.float64), ("start", np.int64), ("end", np.int64), ("first", np.int64), ("last", np.int64))
_SCHEMA = pa.schema([("ids", pa.list_(pa.int64())), ("points", pa.binary()), *((f, pa.binary()) for f, _ in _FIELDS)])


def trees(rows: DataFrame, dims: int = DIMS, block: int = BLOCK) -> DataFrame:
    """One row a block: ids and points in the order of its cover tree, and the tree. A block is of one partition of rows."""

    def run(batches):
        def built(ids, x):
            x = np.concatenate(x)
            t = cover_tree(x)
            ids = pa.concat_arrays(ids).take(pa.array(t.order))
            return pa.RecordBatch.from_arrays([pa.array([ids.to_pylist()], pa.list_(pa.int64())), *(pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in (t.points, *(getattr(t, f).astype(k) for f, k in _FIELDS)))], schema=_SCHEMA)

        ids, x, n = [], [], 0
        for whole in batches:
            at = 0
            while at < whole.num_rows:
                b = whole.slice(at, block - n)
                at += b.num_rows
                n += b.num_rows
                ids.append(b.column("vec_id").cast(pa.int64()))
                x.append(b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
                if n == block:
                    yield built(ids, x)
                    ids, x, n = [], [], 0
        if n:
            yield built(ids, x)

    return rows.mapInArrow(run, "ids array<long>, points binary, " + ", ".join(f"{f} binary" for f, _ in _FIELDS))


def _loaded(batch: pa.RecordBatch, i: int, dims: int) -> tuple[list, Tree]:
    points = np.frombuffer(batch.column("points")[i].as_py(), np.int64).reshape(-1, dims)
    return batch.column("ids")[i].as_py(), Tree(points, np.arange(len(points)), *(np.frombuffer(batch.column(f)[i].as_py(), k) for f, k in _FIELDS))


class Lloyd:
    """Blocks with their trees, stored, and rounds over them. `met` and `compared`: pairs of nodes and of points measured in all rounds."""

    def __init__(self, vectors: DataFrame, k: int = K, dims: int = DIMS) -> None:
        rows = quantised(vectors, dims)
        self.dims, self.met, self.compared = dims, 0, 0
        key = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
        self.centroids = np.array([r.x for r in rows.orderBy(key, "x").limit(k).collect()], np.int64).reshape(-1, dims)
        self.blocks = stored(trees(rows, dims), "cover-trees")

    def round(self) -> None:
        """Assigns every vector and moves the centroids."""
        centroids, dims = self.centroids, self.dims

        def run(batches):
            ctree, exact = cover_tree(centroids, leaf=1), _top(centroids) < SAFE
            sums, counts, met, compared = [[0] * dims for _ in centroids], [0] * len(centroids), 0, 0
            for b in batches:
                for i in range(b.num_rows):
                    _, t = _loaded(b, i, dims)
                    own, m, n = assign(t, centroids, ctree)
                    met, compared = met + m, compared + n
                    whole = exact and _top(t.points) < SAFE
                    for c in np.unique(own).tolist():
                        x = t.points[own == c]
                        add = (x if whole else x.astype(object)).sum(0).tolist()
                        sums[c], counts[c] = [int(a) + int(b) for a, b in zip(sums[c], add, strict=True)], counts[c] + len(x)
            rows = [(c, counts[c], [str(v) for v in sums[c]], met * (c == 0), compared * (c == 0)) for c in range(len(centroids))]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.list_(pa.string()), pa.int64(), pa.int64()), strict=True)], names=["cluster", "n", "sums", "met", "compared"])

        part = self.blocks.mapInArrow(run, "cluster int, n long, sums array<string>, met long, compared long")
        total = [F.sum(F.col("sums")[j].cast("decimal(38,0)")).alias(f"s{j}") for j in range(dims)]
        for r in part.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("met").alias("met"), F.sum("compared").alias("compared"), *total).collect():
            self.met, self.compared = self.met + r.met, self.compared + r.compared
            if r.n:
                self.centroids[r.cluster] = [int(r[f"s{j}"]) // r.n for j in range(dims)]

    def assigned(self) -> DataFrame:
        """vec_id, cluster, distance by the centroids as they are."""
        centroids, dims = self.centroids, self.dims

        def run(batches):
            ctree = cover_tree(centroids, leaf=1) if len(centroids) else None  # without centroids there are no blocks
            for b in batches:
                for i in range(b.num_rows):
                    ids, t = _loaded(b, i, dims)
                    own = assign(t, centroids, ctree)[0]
                    d = [min(int(v), LARGEST) for v in squared(t.points, centroids[own])]
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(own.astype(np.int32)), pa.array(d, pa.int64())], names=["vec_id", "cluster", "distance"])

        return self.blocks.mapInArrow(run, "vec_id long, cluster int, distance long")


def lloyd(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 after the rounds."""
    spark, job = vectors.sparkSession, Lloyd(vectors, k, dims)
    if len(job.centroids):
        for _ in range(rounds):
            job.round()
    rows = stored(job.assigned(), "assigned")
    inertia = {r.cluster: int(r.d) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    total = min(sum(inertia.values()), LARGEST)
    own = [(c, min(d, LARGEST), total, hashlib.sha256(",".join(str(int(v)) for v in job.centroids[c]).encode()).hexdigest()) for c, d in sorted(inertia.items())]
    table = spark.createDataFrame(own, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    return lloyd(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
