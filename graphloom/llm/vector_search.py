"""Exact top-k inner products by a pivot-distance index.

Vectors get one more component, sqrt(M - |x|^2) with M the largest squared norm, so that the largest inner product is the
least Euclidean distance. Each vector is keyed by its nearest pivot and its distance to it; runs of equal pivot and
neighbouring distance (annuli) become index blocks that know the range of their rows' distances to every pivot.

By the triangle inequality an annulus whose distances to pivot p lie in [low, high] is no nearer to query q than
max(d(q,p) - high, low - d(q,p), 0), for each p; the largest of these is its bound. A query's annuli are taken in the order of their
bound, in three rounds: the first, the next eight, all others. Each round leaves a query a k-th score to beat, and a pair of query and
annulus is visited only while the bound can reach it; the search stops when no pair is left. Annuli are bounded by pages of a bounded
number, so that none of their tables is held whole, and an order holds within a page. Queries are packed into blocks, of which a visit
sends only the queries concerned. Scores are exact: integers in doubles below 2^53, in 64-bit integers above. Ties go to the smaller
vec_id, and only hits that come before the k-th by (score, vec_id) leave a task, so copies of one vector don't multiply. The index
covers every row; only the pivots come from a bounded sample.

Vectors that are null or hold null or non-finite components take no part, nor do rows without a vec_id; empty vectors have score 0
with all; a shorter vector is filled up with zeros. A row is known by a number of its own: rows that repeat a vec_id are queries and
candidates each, and a query leaves out only its own row. An empty table, or one without usable vectors, gives no rows. Only vec_id
and embedding are read, so other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import partitions_for, stored

SCALE, K, EVERY = 64, 20, 20
#: Bounded sample for the pivots, their number, and the rows of an index block and a query block.
SAMPLE, PIVOTS, BLOCK, QUERIES = 4096, 32, 512, 256
#: A query's annuli that each round may visit, by their place in the order of bounds; annuli of a page; parts that the queries of an
#: annulus or a page are dealt to.
ROUNDS, PAGE, PARTS = ((0, 1), (1, 9), (9, None)), 1024, 8


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, x: array<long> of floor(scale * component), for vectors whose components all are finite."""
    v = vectors.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    whole = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.where(whole & F.col("vec_id").isNotNull()).select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("x"))


def matrix(lists, width: int) -> np.ndarray:
    out = np.zeros((len(lists), width), np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def choose_pivots(sample: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Far-apart rows of the sample: each next pivot is the row farthest from those chosen."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    chosen, far = [0], ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    x = x.astype(np.float64)
    return np.column_stack([x, np.sqrt(np.maximum(0.0, most - (x * x).sum(1)))])


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (x * x).sum(1)[:, None] - 2 * x @ pivots.T + (pivots * pivots).sum(1)))


def _unpack(data: bytes, width: int, kind: str) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(-1, width).astype(np.int64)


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products; doubles where they are exact."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if top < 2**53:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    return q @ x.T


class Index:
    """The stored index: blocks(block, pivot, low, high, ids, own, rows), low and high as doubles for each pivot, and of the last search
    the visits made and the pairs of query and annulus that there were."""

    def __init__(self, vectors: DataFrame) -> None:
        rows = stored(quantised(vectors).withColumn("own", F.monotonically_increasing_id()), "quantised")
        self.rows, self.visits, self.pairs = rows, 0, 0
        largest = F.max(F.coalesce(F.array_max(F.transform("x", F.abs)), F.lit(0))).alias("top")
        size = rows.agg(F.max(F.size("x")).alias("w"), F.max(F.aggregate("x", F.lit(0.0), lambda a, x: a + x.cast("double") * x)).alias("m"), largest).first()
        self.width, self.most = max(1, size.w or 0), float(size.m or 0.0)
        self.kind = next((k for k in ("<i2", "<i4") if 0 <= (size.top or 0) <= np.iinfo(k).max), "<i8")
        width, most, kind = self.width, self.most, self.kind
        sample = rows.orderBy(F.xxhash64("vec_id", "own")).limit(SAMPLE).toPandas()
        self.pivots = pivots = choose_pivots(lifted(matrix(sample["x"].tolist(), width), most))

        def keyed(batches):
            for b in batches:
                x = matrix(b.column("x").to_pylist(), width)
                d = distances(lifted(x, most), pivots)
                near = d.argmin(1)
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_id"), b.column("own"), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near]), pa.array([r.astype(kind).tobytes() for r in x], pa.binary())],
                    names=["vec_id", "own", "pivot", "dist", "row"],
                )

        keyed_rows = rows.mapInArrow(keyed, "vec_id long, own long, pivot int, dist double, row binary")
        self.parts = partitions_for(rows, 32)
        self.keyed = stored(self._sorted(keyed_rows), "keyed")
        self.blocks = stored(self._blocks(self.keyed, BLOCK), "index")

    def _sorted(self, rows: DataFrame) -> DataFrame:
        order = ("pivot", "dist", "vec_id", "own")
        return rows.repartitionByRange(self.parts, *order).sortWithinPartitions(*order)

    def search(self, queries: DataFrame, k: int = K) -> DataFrame:
        """query_id, rank, vec_id, score. queries: (vec_id) ids of indexed rows."""
        own = self.keyed.join(queries.distinct(), "vec_id", "left_semi")
        q = stored(self._blocks(self._sorted(own), QUERIES), "queries").withColumnRenamed("block", "q")
        best, n_blocks = None, self.blocks.count()
        self.visits, self.pairs = 0, n_blocks * (q.agg(F.sum(F.size("ids"))).first()[0] or 0)
        pages = -(-n_blocks // PAGE)
        for first, upto in ROUNDS:
            beats = self._beats(q, best, k)
            todo = self._near(q, beats, pages, first, upto)
            made = todo.agg(F.sum("n")).first()[0]
            if not made:
                break
            self.visits += made
            hits = self._visit(q, beats, todo, k)
            best = stored(self._top(hits if best is None else best.drop("rank").unionByName(hits), k), "best")
        ids = q.select("q", F.posexplode("ids").alias("at", "query_id"))
        if best is None:
            return ids.select("query_id", F.lit(1).alias("rank"), F.col("query_id").alias("vec_id"), F.lit(0).cast("long").alias("score")).limit(0)
        return best.join(ids, ["q", "at"]).select("query_id", "rank", "vec_id", "score")

    @staticmethod
    def _beats(q: DataFrame, best: DataFrame | None, k: int) -> DataFrame:
        """q, beat: for each query of a block that has them, its place, k-th score and that one's vec_id."""
        empty = "CAST(array() AS array<struct<at: int, score: bigint, vec_id: bigint>>)"
        if best is None:
            return q.select("q", F.expr(empty).alias("beat"))
        kth = best.where(F.col("rank") == k).groupBy("q").agg(F.collect_list(F.struct("at", "score", "vec_id")).alias("beat"))
        return stored(q.select("q").join(kth, "q", "left").select("q", F.coalesce("beat", F.expr(empty)).alias("beat")), "beats")

    def _near(self, q: DataFrame, beats: DataFrame, pages: int, first: int, upto: int | None) -> DataFrame:
        """(q, block, places, n): the annuli at places first to upto of a query's order that its bounds don't rule out, with the places
        of these n queries in their block.

        A page of annuli is sent once for each part of the query blocks and held by the task while they pass."""
        pivots, most, dims, kind = self.pivots, self.most, self.width, self.kind
        no, both = F.lit(None), ["page", "part", "q", "block", "low", "high", "rows", "beat"]
        page = F.pmod(F.xxhash64("block"), F.lit(max(1, pages))).cast("int")
        of = self.blocks.select(page.alias("page"), F.explode(F.expr(f"sequence(0, {PARTS - 1})")).alias("part"), no.cast("long").alias("q"), "block", "low", "high", no.cast("binary").alias("rows"), no.cast(beats.schema["beat"].dataType).alias("beat"))
        asked = q.join(beats, "q").select(F.explode(F.expr(f"sequence(0, {max(0, pages - 1)})")).alias("page"), F.pmod("q", F.lit(PARTS)).cast("int").alias("part"), "q", no.cast("long").alias("block"), no.cast("binary").alias("low"), no.cast("binary").alias("high"), "rows", "beat")
        rows = of.select(both).unionByName(asked.select(both)).repartition(self.parts, "page", "part").sortWithinPartitions("page", "part", F.asc_nulls_first("q"), "block")

        def bound(d, low, high):
            out = np.zeros((len(d), len(low)))
            for j in range(d.shape[1]):
                np.maximum(out, low[:, j] - d[:, j, None], out=out)
                np.maximum(out, d[:, j, None] - high[:, j], out=out)
            return out

        def open_(r, low, high):
            """Which annuli each query of the block still has to visit in this round."""
            x = _unpack(r["rows"], dims, kind).astype(np.float64)
            norm = (x * x).sum(1)
            reach = np.full(len(x), np.inf)
            slack = 1e-6 * (1.0 + np.sqrt(norm + most))
            for e in r["beat"]:
                i = e["at"]
                reach[i] = np.sqrt(max(0.0, norm[i] + most - 2.0 * e["score"])) * (1 + 1e-9) + slack[i]
            b = bound(distances(np.column_stack([x, np.zeros(len(x))]), pivots), low, high)
            take = np.zeros(b.shape, bool)
            np.put_along_axis(take, np.argsort(b, axis=1, kind="stable")[:, first:upto], True, axis=1)
            return take & (b <= reach[:, None])

        def run(batches):
            held, page, table = [], None, None
            for b in batches:
                out = []
                for r in b.to_pylist():
                    if r["q"] is None:
                        if page != (r["page"], r["part"]):
                            held, page = [], (r["page"], r["part"])
                        held.append((r["block"], r["low"], r["high"]))
                        table = None
                    elif page == (r["page"], r["part"]):
                        if table is None:
                            table = [np.frombuffer(b"".join(h[i] for h in held), np.float64).reshape(len(held), -1) for i in (1, 2)]
                        take = open_(r, *table)
                        for j in np.flatnonzero(take.any(0)):
                            at = np.flatnonzero(take[:, j])
                            out.append((r["q"], held[j][0], at.astype("<i4").tobytes(), len(at)))
                columns = zip(*out, strict=True) if out else ([], [], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.int64()), strict=True)], names=["q", "block", "places", "n"])

        return stored(rows.mapInArrow(run, "q long, block long, places binary, n long"), "visits")

    def _visit(self, q: DataFrame, beats: DataFrame, todo: DataFrame, k: int) -> DataFrame:
        """q, at, vec_id, score: for each query and annulus the hits, k at most, that come before the query's k-th so far.

        A block is sent once for each part of the query blocks that visit it and held by the task while they pass."""
        width, kind = self.width, self.kind
        size = width * np.dtype(kind).itemsize
        todo = todo.withColumn("part", F.pmod("q", F.lit(PARTS)))
        no, columns = F.lit(None), ["block", "part", "q", "places", "own", "rows", "beat"]
        index = self.blocks.join(todo.select("block", "part").distinct(), "block").select("block", "part", no.cast("long").alias("q"), no.cast("binary").alias("places"), "own", "rows", no.cast(beats.schema["beat"].dataType).alias("beat"), "ids")
        asked = todo.join(q.select("q", "own", "rows"), "q").join(beats, "q").select(columns)

        def concerned(batches):
            """Leaves of a block the queries that visit."""
            for b in batches:
                places, own, rows, beat = [np.frombuffer(p.as_py(), "<i4") for p in b.column("places")], [], [], []
                for at, o, r, e in zip(places, b.column("own"), b.column("rows"), b.column("beat"), strict=True):
                    o, r, some = o.as_py(), memoryview(r.as_py()), set(at.tolist())
                    own.append([o[i] for i in at])
                    rows.append(b"".join(r[i * size : (i + 1) * size] for i in at))
                    beat.append([x for x in e.as_py() if x["at"] in some])
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns[:4]), *(pa.array(x, b.schema.field(c).type) for x, c in ((own, "own"), (rows, "rows"), (beat, "beat")))], names=columns)

        asked = asked.mapInArrow(concerned, asked.schema).withColumn("ids", no.cast("array<bigint>"))
        n = max(partitions_for(self.rows, 8), self.parts)
        both = index.unionByName(asked).repartition(n, "block", "part").sortWithinPartitions("block", "part", F.asc_nulls_first("q"))

        def found(r, ids, own, x):
            at = np.frombuffer(r["places"], "<i4").tolist()
            s = scores(_unpack(r["rows"], width, kind), x)
            beat = {e["at"]: (e["score"], e["vec_id"]) for e in r["beat"]}
            none = (np.iinfo(np.int64).min, np.iinfo(np.int64).max)
            for place, me, row in zip(at, r["own"], s, strict=True):
                least, first = beat.get(place, none)
                take = np.flatnonzero((row > least) | ((row == least) & (ids < first)))
                take = take[own[take] != me]
                if len(take) > k:
                    level = np.partition(row[take], len(take) - k)[len(take) - k]
                    take = take[row[take] >= level]
                take = take[np.lexsort((ids[take], -row[take]))[:k]]
                yield from zip([r["q"]] * len(take), [place] * len(take), ids[take].tolist(), row[take].tolist(), strict=True)

        def run(batches):
            ids = own = x = None
            for b in batches:
                rows = []
                for j in range(b.num_rows):
                    r = b.slice(j, 1).to_pylist()[0]
                    if r["q"] is None:
                        ids, own, x = np.array(r["ids"], np.int64), np.array(r["own"], np.int64), _unpack(r["rows"], width, kind)
                    else:
                        rows += found(r, ids, own, x)
                columns = zip(*rows, strict=True) if rows else ([], [], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["q", "at", "vec_id", "score"])

        return both.mapInArrow(run, "q long, at int, vec_id long, score long")

    def _blocks(self, keyed: DataFrame, size: int) -> DataFrame:
        """Packs sorted rows of one pivot, at most so many, into one row. Block numbers hold the task's partition."""
        schema = pa.schema([("block", pa.int64()), ("pivot", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("ids", pa.list_(pa.int64())), ("own", pa.list_(pa.int64())), ("rows", pa.binary())])
        pivots, most, width, kind = self.pivots, self.most, self.width, self.kind

        def run(batches):
            from pyspark import TaskContext

            number, held = TaskContext.get().partitionId() << 32, []

            def block():
                nonlocal number, held
                number += 1
                rows = b"".join(r["row"] for r in held)
                d = distances(lifted(_unpack(rows, width, kind), most), pivots)
                one = {"block": number, "pivot": held[0]["pivot"], "low": d.min(0).tobytes(), "high": d.max(0).tobytes(), "ids": [r["vec_id"] for r in held], "own": [r["own"] for r in held], "rows": rows}
                held = []
                return pa.RecordBatch.from_pylist([one], schema=schema)

            for b in batches:
                for r in b.to_pylist():
                    if held and (held[0]["pivot"] != r["pivot"] or len(held) >= size):
                        yield block()
                    held.append(r)
            if held:
                yield block()

        return keyed.mapInArrow(run, "block long, pivot int, low binary, high binary, ids array<long>, own array<long>, rows binary")

    @staticmethod
    def _top(hits: DataFrame, k: int) -> DataFrame:
        order = Window.partitionBy("q", "at").orderBy(F.desc("score"), "vec_id")
        return hits.select("q", "at", "vec_id", "score", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    return Index(vectors).search(queries, k)


def op2_top_k(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.where(F.col("vec_id") % EVERY == 0).select("vec_id"))
