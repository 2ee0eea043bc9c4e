"""Geometric features of small graphs: the theta number, an orthonormal representation, cones around random vertex subsets.

theta is the least t for which t I + sum of y_ij (E_ij + E_ji) over the edges - J is positive semidefinite. That slack matrix Z gives
unit vectors with orthogonal images for vertices that aren't adjacent: a factor of Z with a common first coordinate 1, over sqrt(t).

A component is solved whole, in one task, in time cubic in its vertices for each step: meant for graphs of up to some hundreds of
vertices such as disks and rings. Many graphs run in parallel, a row each, and a component is renumbered by its shape first: what a worker
has solved once it finds again, whatever ids a copy of it has. Vertices without edges are part of their graph.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from hashlib import md5
from math import comb, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators import paths
from graphloom.plans import cut

TOLERANCE = 1e-6
#: Bytes of solved components that a worker remembers.
KEPT = 64 << 20
#: Renumberings and cone values that it remembers.
ENTRIES = 1 << 16


def components(n: int, edges: np.ndarray) -> np.ndarray:
    """The least vertex reachable from each."""
    low = np.arange(n)
    while len(edges):
        near = low.copy()
        np.minimum.at(near, edges[:, 0], low[edges[:, 1]])
        np.minimum.at(near, edges[:, 1], low[edges[:, 0]])
        near = near[near]
        if (near == low).all():
            break
        low = near
    return low


def theta_number(n: int, edges: np.ndarray, steps: int = 3_000, tol: float = TOLERANCE) -> tuple[float, np.ndarray]:
    """theta and its slack matrix, for edges (i, j) given once each, i != j; 1 for a single vertex.

    Components are solved apart: theta is their sum, and (Z + J) / theta has theirs as blocks."""
    of = components(n, edges)
    theta, gram = 0.0, np.zeros((n, n))
    for c in np.unique(of):
        own = np.flatnonzero(of == c)
        t, z = _connected(len(own), np.searchsorted(own, edges[of[edges[:, 0]] == c]), steps, tol)
        theta += t
        gram[np.ix_(own, own)] = (z + 1) / t
    return theta, theta * gram - 1


def _connected(n: int, edges: np.ndarray, steps: int, tol: float) -> tuple[float, np.ndarray]:
    """theta_number of a connected graph. Alternates between the multipliers and a projection on semidefinite matrices (augmented Lagrangian of the dual); the result is
    shifted until it is feasible, so theta is never too low."""
    if n <= 1:
        return 1.0, np.zeros((n, n))
    i, j = (edges[:, 0], edges[:, 1]) if len(edges) else (np.zeros(0, int),) * 2
    z, x, sigma = np.zeros((n, n)), np.eye(n) / n, 1.0 / n

    def slack(t: float, y: np.ndarray) -> np.ndarray:
        m = t * np.eye(n) - 1.0
        m[i, j] += y
        m[j, i] += y
        return m

    for step in range(steps):
        sum_ = z + 1.0
        t = (np.trace(sum_) + (np.trace(x) - 1) / sigma) / n
        y = sum_[i, j] + x[i, j] / sigma
        m = slack(t, y)
        w, v = np.linalg.eigh(m - x / sigma)
        up = w > 0
        z = (v[:, up] * w[up]) @ v[:, up].T
        x = -sigma * (v[:, ~up] * w[~up]) @ v[:, ~up].T
        primal = max(abs(np.trace(x) - 1), 2 * np.abs(x[i, j]).max(initial=0))
        dual = np.abs(z - m).max() / n
        if max(primal, dual) < tol:
            break
        if step % 25 == 24:  # keep both residuals alike
            sigma *= 1.5 if primal < dual / 3 else 1 / 1.5 if dual < primal / 3 else 1.0
    t += max(0.0, -float(np.linalg.eigvalsh(m)[0]))
    return float(t), slack(t, y)


class Memory:
    """What a worker has computed, by key; the oldest entries go when the sizes of all pass `most`."""

    def __init__(self, most: int) -> None:
        self.of, self.most, self.size = OrderedDict(), most, 0

    def get(self, key, make, size=lambda x: 1):
        if key in self.of:
            self.of.move_to_end(key)
            return self.of[key]
        x = self.of[key] = make()
        self.size += size(x)
        while self.size > self.most and len(self.of) > 1:
            self.size -= size(self.of.popitem(last=False)[1])
        return x


_SHAPES, _SOLVED, _CONES = Memory(ENTRIES), Memory(KEPT), Memory(ENTRIES)


def shape(n: int, edges: np.ndarray) -> tuple[bytes, list[int]]:
    """A connected graph's edges after renumbering, as bytes, and the new number of each vertex.

    Vertices are ranked by their degrees and, again and again, their neighbours' ranks; numbers are then given outwards from a vertex of the
    least rank. Paths and most trees get the same bytes whatever their numbers were; a graph that gets others is only solved once more."""
    near = [[] for _ in range(n)]
    for a, b in edges.tolist():
        near[a].append(b)
        near[b].append(a)
    rank, kinds = [len(x) for x in near], 0
    while True:
        key = [(rank[i], *sorted([rank[j] for j in near[i]])) for i in range(n)]
        place = {k: i for i, k in enumerate(sorted(set(key)))}
        rank = [place[k] for k in key]
        if len(place) == kinds:
            break
        kinds = len(place)
    first = min(range(n), key=rank.__getitem__)
    number, queue = {first: 0}, [first]
    for i in queue:
        for j in sorted(near[i], key=rank.__getitem__):
            if j not in number:
                number[j] = len(queue)
                queue.append(j)
    pairs = sorted([(min(x, y), max(x, y)) for x, y in ((number[a], number[b]) for a, b in edges.tolist())])
    return np.array(pairs, np.int64).tobytes(), [number[i] for i in range(n)]


def _solved(n: int, edges: bytes) -> tuple[float, np.ndarray]:
    """theta_number of a connected graph, for edges as bytes."""
    return _SOLVED.get((n, edges), lambda: _connected(n, np.frombuffer(edges, np.int64).reshape(-1, 2), 3_000, TOLERANCE), lambda x: x[1].nbytes + len(edges) + 256)


def _part_cone(n: int, edges: bytes, places: tuple[int, ...]) -> float:
    """The cone value of some vertices of a connected graph."""

    def value():
        u = representation(*_solved(n, edges))
        return cone(u[list(places)])

    return 1.0 if len(places) == 1 else _CONES.get((n, edges, places), value)


def is_semidefinite(m: np.ndarray, tol: float = 1e-9) -> bool:
    return len(m) == 0 or bool(np.linalg.eigvalsh(m)[0] >= -tol * max(1.0, np.abs(m).max()))


def representation(theta: float, z: np.ndarray, dim: int | None = None) -> np.ndarray:
    """Unit vectors as rows, padded with zeros to dim columns; rows of vertices that aren't adjacent are orthogonal."""
    w, v = np.linalg.eigh(z)
    u = np.hstack([np.ones((len(z), 1)), v * np.sqrt(np.maximum(w, 0))]) / sqrt(theta)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    return u if dim is None or dim <= u.shape[1] else np.pad(u, ((0, 0), (0, dim - u.shape[1])))


def ball_through(points: np.ndarray) -> tuple[np.ndarray, float]:
    """The smallest ball with all points on its surface: its centre lies in their affine hull."""
    d = points[1:] - points[0]
    c = points[0] + d.T @ np.linalg.lstsq(2 * d @ d.T, (d * d).sum(axis=1), rcond=None)[0] if len(d) else points[0]
    return c, float(np.linalg.norm(points[0] - c))


def enclosing_ball(points: np.ndarray, tol: float = 1e-9) -> tuple[np.ndarray, float]:
    """The least ball around the rows. A point outside the ball of those before it lies on the surface; it moves to the front."""

    def around(inner: list[np.ndarray], surface: list[np.ndarray]) -> tuple[np.ndarray, float]:
        ball = ball_through(np.array(surface)) if surface else (inner[0], 0.0)
        if len(surface) > points.shape[1]:
            return ball
        for k in range(len(inner)):
            if np.linalg.norm(inner[k] - ball[0]) > ball[1] + tol:
                ball = around(inner[:k], [*surface, inner[k]])
                inner = [inner[k], *inner[:k], *inner[k + 1 :]]
        return ball

    return around(list(points), [])


def cone(u: np.ndarray) -> float:
    """max 1 / (c u)^2 over unit rows u, c the direction of their enclosing ball's centre."""
    c, _ = enclosing_ball(u)
    return float((1 / (u @ (c / np.linalg.norm(c))) ** 2).max())


def sample_counts(sizes: range, n: int, samples: int) -> dict[int, int]:
    """Subsets to draw of each size, in proportion to how many there are; what rounding leaves goes to the largest sizes first."""
    fit = [d for d in sizes if 0 < d <= n]
    total = sum(comb(n, d) for d in fit)
    out = {d: samples * comb(n, d) // total for d in fit}
    for d in sorted(fit, reverse=True)[: samples - sum(out.values())]:
        out[d] += 1
    return out


def drawn(total: int, want: int, salt: str) -> list[int]:
    """`want` distinct numbers below total, every such set equally likely over the salts: number j, from total - want on, is
    (the first 15 hexadecimal digits of md5 of "salt:j") mod (j + 1), or j itself where that was taken. All where there are no more."""
    taken: dict[int, None] = {}
    for j in range(max(0, total - want), total):
        x = int(md5(f"{salt}:{j}".encode()).hexdigest()[:15], 16) % (j + 1)
        taken[j if x in taken else x] = None
    return list(taken)


def unranked(place: int, d: int) -> list[int]:
    """The d-subset at this place of all, ordered by their largest members: place = comb(s0, 1) + comb(s1, 2) + ..., s ascending."""
    out = []
    for i in range(d, 0, -1):
        low, high = i - 1, i
        while comb(high, i) <= place:
            low, high = high, 2 * high
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if comb(mid, i) <= place else (low, mid)
        place -= comb(low, i)
        out.append(low)
    return out[::-1]


def random_subsets(n: int, sizes: range, samples: int, salt: str) -> dict[int, list[list[int]]]:
    """For each size the distinct subsets of 0 .. n - 1 to take, by their places, so that none is made that isn't taken."""
    return {d: [unranked(p, d) for p in drawn(comb(n, d), want, f"{salt}:{d}")] for d, want in sample_counts(sizes, n, samples).items()}


def cone_features(u: np.ndarray, sizes: range, samples: int, salt: str) -> list[float]:
    """For each size the mean cone value over distinct random subsets; all subsets where fewer exist; 0 where none is drawn."""
    subsets = random_subsets(len(u), sizes, samples, salt)
    return [float(np.mean([cone(u[s]) for s in sorted(subsets[d])])) if subsets.get(d) else 0.0 for d in sizes]


def _sizes(vertices: DataFrame, keys: list[str]) -> DataFrame:
    return vertices.where("vertex_id IS NOT NULL").groupBy(*keys).agg(F.count_distinct("vertex_id").alias("n"))


def subset_counts(vertices: DataFrame, sizes: range, samples: int, keys: tuple[str, ...] = ("graph_id",)) -> DataFrame:
    """keys, d, samples: how many subsets of d vertices to draw from each graph."""
    return _drawn(vertices, keys, "d long, samples long", lambda n, key: sample_counts(sizes, n, samples).items())


def subsets(vertices: DataFrame, sizes: range, samples: int, seed: int = 0, keys: tuple[str, ...] = ("graph_id",)) -> DataFrame:
    """keys, d, subset: the subsets that `features` draws, as places in the order of a graph's vertex ids."""

    def rows(n, key):
        of = random_subsets(n, sizes, samples, _salt(seed, key))
        return [(d, s) for d, some in of.items() for s in some]

    return _drawn(vertices, keys, "d long, subset array<long>", rows)


def _salt(seed: int, key) -> str:
    return ":".join(map(str, [seed, *map(int, key)]))


def _drawn(vertices: DataFrame, keys: tuple[str, ...], kinds: str, rows) -> DataFrame:
    """keys and rows(n, key) for each graph of n vertices; keys are integers."""
    names = [*keys, *[x.split()[0] for x in kinds.split(", ")]]

    def run(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame([(*key, *r) for *key, n in b.itertuples(index=False) for r in rows(int(n), key)], columns=names)

    types = ", ".join(f"{k} {vertices.schema[k].dataType.simpleString()}" for k in keys)
    return _sizes(vertices, list(keys)).mapInPandas(run, f"{types}, {kinds}")


def lists(vertices: DataFrame, edges: DataFrame, keys: tuple[str, ...] = ("graph_id",)) -> DataFrame:
    """keys, ids, ends: a row for each graph, its vertices and its edges (pairs of ids)."""
    own = vertices.select(*keys, "vertex_id", F.lit(None).cast("struct<src: long, dst: long>").alias("end")).where("vertex_id IS NOT NULL")
    end = F.struct(F.least("src", "dst").cast("long").alias("src"), F.greatest("src", "dst").cast("long").alias("dst"))
    half = edges.where("src <> dst").select(*keys, F.lit(None).cast("long").alias("vertex_id"), end.alias("end"))
    # few rows are much work here: adaptive execution would merge partitions by their bytes, which a stated number forbids
    parts = int(vertices.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = own.unionByName(half).repartition(parts, *keys).groupBy(*keys)
    return rows.agg(F.sort_array(F.collect_set("vertex_id")).alias("ids"), F.collect_set("end").alias("ends")).where(F.size("ids") > 0)


def graph_lists(g) -> DataFrame:
    """lists() of whole graphs; packed rows (packed.gathered) stay where they are."""
    return g.by_parts(lambda rows: rows.select("graph_id", F.transform("v", lambda x: x.vertex_id).alias("ids"), F.col("e").alias("ends")), lambda rest: lists(rest.vertices, rest.edges))


def neighbour_lists(g, ring: bool = False) -> DataFrame:
    """lists() by graph_id and root of the 1-disk around the first vertex of each graph, or of its neighbours alone."""

    def small(rows: DataFrame) -> DataFrame:
        # the first vertex is the smaller end of all its edges
        root = F.col("v")[0].vertex_id
        near = F.sort_array(F.transform(F.filter("e", lambda x: x.src == root), lambda x: x.dst))
        d = rows.select("graph_id", root.alias("root"), (near if ring else F.concat(F.array(root), near)).alias("ids"), "e").where(F.size("ids") > 0)
        return d.select("graph_id", "root", "ids", F.filter("e", lambda x: F.array_contains("ids", x.src) & F.array_contains("ids", x.dst)).alias("ends"))

    def other(rest) -> DataFrame:
        first = rest.vertices.groupBy("graph_id").agg(F.min("vertex_id").alias("root"))
        nodes = cut(paths.ring(paths.graph_distances(rest, 1, first), int(ring), 1))
        return lists(nodes.select("graph_id", "root", F.col("v").alias("vertex_id")), paths.induced(nodes, rest.edges), ("graph_id", "root"))

    return g.by_parts(small, other)


def matched(ends: Column | str = "ends") -> Column:
    """Whether no vertex has two edges."""
    own = F.concat(F.transform(ends, lambda x: x.src), F.transform(ends, lambda x: x.dst))
    return F.size(F.array_distinct(own)) == F.size(own)


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, list[tuple[int, bytes, list[int]]]]]:
    """For each graph of a batch of lists(): its vertices, the part of each and its number there, and the parts of two vertices or more, as
    (vertices, renumbered edges)."""
    v, e = batch.column("ids"), batch.column("ends")
    n, m = v.value_lengths().to_numpy(zero_copy_only=False), e.value_lengths().to_numpy(zero_copy_only=False)
    ids, ends = v.flatten().to_numpy(zero_copy_only=False), e.flatten()
    a, b = (ends.field(f).to_numpy(zero_copy_only=False) for f in ("src", "dst"))
    known, place = np.unique(ids, return_inverse=True)
    key, of = np.repeat(np.arange(len(n)), n) * max(1, len(known)) + place, np.repeat(np.arange(len(n)), m)  # ascending
    at, good = [], np.ones(len(of), bool)
    for x in (a, b):
        p = np.minimum(np.searchsorted(known, x), max(0, len(known) - 1))
        k = of * max(1, len(known)) + p
        i = np.minimum(np.searchsorted(key, k), max(0, len(key) - 1))
        good &= (known[p] == x) & (key[i] == k) if len(key) else False
        at.append(i)
    edges = np.column_stack(at)[good]
    low = components(len(key), edges)
    # vertices by part, parts in the order of their least vertices; a part's edges together, in its vertices' order
    order = np.argsort(low, kind="stable")
    first, size = np.unique(low, return_counts=True)
    start = np.cumsum(size) - size
    number, part = np.empty(len(low), np.int64), np.empty(len(low), np.int64)
    part[order] = np.repeat(np.arange(len(first)), size)
    number[order] = np.arange(len(low)) - np.repeat(start, size)
    edges = edges[np.lexsort((edges[:, 1], edges[:, 0], part[edges[:, 0]]))]
    local = number[edges]
    cuts = np.searchsorted(part[edges[:, 0]], np.arange(len(first) + 1))
    begin = np.concatenate([[0], np.cumsum(n)])
    parts_at = np.searchsorted(first, begin)
    for g in range(len(n)):
        found = []
        for p in range(parts_at[g], parts_at[g + 1]):
            k = int(size[p])
            if k > 1:
                own = local[cuts[p] : cuts[p + 1]]
                found.append((k, *_SHAPES.get((k, own.tobytes()), lambda k=k, own=own: shape(k, own))))
            else:
                found.append((1, b"", [0]))
        rows = slice(begin[g], begin[g + 1])
        yield part[rows] - parts_at[g], number[rows], found


def _mapped(rows: DataFrame, keys: tuple[str, ...], last: str, kind: pa.DataType, f) -> DataFrame:
    """keys, n and f(key values, parts) of each row of lists()."""
    names = [*keys, "n", last.split()[0]]

    def run(batches):
        for batch in batches:
            own = [batch.column(k) for k in keys]
            key = list(zip(*(c.to_pylist() for c in own), strict=True))
            n = batch.column("ids").value_lengths().cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*own, n, pa.array([f(k, *x) for k, x in zip(key, _parts(batch), strict=True)], kind)], names=names)

    types = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.select(*keys, "ids", "ends").mapInArrow(run, f"{types}, n long, {last}")


def thetas(rows: DataFrame, keys: tuple[str, ...] = ("graph_id",)) -> DataFrame:
    """keys, n, theta of rows of lists(): the sum over a graph's parts."""
    return _mapped(rows, keys, "theta double", pa.float64(), lambda key, part, number, found: float(sum([_solved(k, e)[0] if k > 1 else 1.0 for k, e, _ in found])))


def cones(rows: DataFrame, sizes: range, samples: int, seed: int = 0, keys: tuple[str, ...] = ("graph_id",)) -> DataFrame:
    """keys, n, features of rows of lists(): a mean cone value for each subset size. The draws depend on seed and integer keys alone.

    Vectors of different parts are orthogonal, and the point of a hull next to the origin, the ball's centre, has them apart: a subset's cone
    value is the sum of its parts' own."""

    def value(subset, part, number, found) -> float:
        own: dict[int, list[int]] = {}
        for i in subset:
            p = int(part[i])
            own.setdefault(p, []).append(found[p][2][number[i]])
        return sum([_part_cone(*found[p][:2], tuple(sorted(at))) for p, at in own.items()])

    def row(key, part, number, found):
        drawn_ = random_subsets(len(part), sizes, samples, _salt(seed, key))
        return [float(np.mean([value(s, part, number, found) for s in sorted(drawn_[d])])) if drawn_.get(d) else 0.0 for d in sizes]

    return _mapped(rows, keys, "features array<double>", pa.list_(pa.float64()), row)


def theta_numbers(vertices: DataFrame, edges: DataFrame, keys: tuple[str, ...] = ("graph_id",)) -> DataFrame:
    """keys, n, theta. Edges with an end that isn't a vertex, loops and repeats count for nothing."""
    return thetas(lists(vertices, edges, keys), keys)


def features(vertices: DataFrame, edges: DataFrame, sizes: range, samples: int, seed: int = 0, keys: tuple[str, ...] = ("graph_id",)) -> DataFrame:
    """keys, n, features: see cones."""
    return cones(lists(vertices, edges, keys), sizes, samples, seed, keys)
