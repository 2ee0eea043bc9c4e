"""Near-duplicate groups by b-bit MinHash.

1. A map over whole texts makes, for each document, the set of hashed 5-word shingles, its size and digest, 160 minima,
   32 band keys of 5 minima each, and the low 4 bits of every minimum packed into ten longs.
2. Documents with equal sets form a class, found by digest; only one row of each class goes on. Copies are never paired.
3. Classes that share a band key are candidates. Instead of all pairs of a bucket, each round pairs its members with one
   pivot of the bucket. The packed signatures give the collision-corrected similarity by bit counts; pairs far below the
   threshold go, the rest are confirmed on the full sets. A member of the pivot's component needs no more links to it, so
   the next rounds look only at buckets that still hold several components, under another pivot.
4. After the last round, buckets that still hold several components are swept: their members are compared on the full sets in
   pieces of bounded size, and of the links found only those that join components are returned. No candidate is dropped. At
   similarity 0.85 a pair shares no band with probability (1 - 0.85^5)^32, about 7e-9; at 0.8 about 3e-6.
5. Components are the least document id reachable over confirmed links.

Shingles are compared as 64-bit hashes. Texts without words link with nothing; with fewer than five words the whole sequence is
the one shingle. A null doc_id takes part like any other row, but can't name a component others can reach by id: its
component_id is the least id of its class or component, null if there is none, and it is kept only in that last case, and
there only if its class leads the component. Classes are numbered by themselves, so they need no id. Rows that repeat a doc_id
with another text link as versions of one document, and each version is searched with its own set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import mix, slices, stored, words_of

WORDS, BANDS, ROWS, BITS = 5, 32, 5, 4
HASHES = BANDS * ROWS
#: Confirmed if 100 * intersection >= percent * union; this is op3_near_dedup's.
PERCENT = 85
#: Pairs whose estimate is this much under the threshold (over six standard errors) aren't confirmed.
SLACK = 0.2
#: Rounds of pivots before the sweep; members of a bucket, and their shingles, in half a piece of it; columns of a block of indicators.
ROUNDS, CHUNK, SHINGLES, COLUMNS = 2, 384, 2_000_000, 8192

_rng = np.random.Generator(np.random.PCG64(20240229))
_A = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)
_PLACE = _rng.integers(1, 2**63, WORDS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashed shingles of all texts in order, repeats included)."""
    offsets, words = words_of(texts)
    coded = words.dictionary_encode()
    own = np.fromiter((xxhash.xxh3_64_intdigest(w.as_buffer()) for w in coded.dictionary), np.uint64, len(coded.dictionary))
    flat = own[coded.indices.to_numpy()] if len(words) else np.empty(0, np.uint64)
    n = len(flat)
    many = max(0, n - WORDS + 1)
    rolled = np.zeros(many, np.uint64)
    for j in range(WORDS):
        rolled += flat[j : j + many] * _PLACE[j]
    counts = np.diff(offsets)
    sizes = np.where(counts >= WORDS, counts - WORDS + 1, (counts > 0).astype(counts.dtype))
    out_at = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(int(out_at[-1]), np.uint64)
    whole = np.repeat(counts >= WORDS, sizes)
    place = np.arange(len(out)) - np.repeat(out_at[:-1], sizes) + np.repeat(offsets[:-1], sizes)
    out[whole] = rolled[place[whole]]
    for i in np.flatnonzero((counts > 0) & (counts < WORDS)):
        part = flat[offsets[i] : offsets[i + 1]]
        out[out_at[i]] = np.append(part * _PLACE[: len(part)], _PLACE[WORDS:] * np.uint64(len(part))).sum(dtype=np.uint64)
    return out_at, mix(out)


def minima(at: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The minima of each non-empty set under every hash function, one row a set."""
    starts = at[:-1][np.diff(at) > 0]
    out = np.empty((len(starts), HASHES), np.uint64)
    buffer = np.empty_like(hashes)
    for k in range(HASHES if len(starts) else 0):
        np.multiply(hashes, _A[k], out=buffer)
        np.add(buffer, _B[k], out=buffer)
        out[:, k] = np.minimum.reduceat(buffer, starts)
    return out


def packed(low: np.ndarray) -> np.ndarray:
    """The low BITS bits of (scrambled) minima, 16 to a long."""
    low = (mix(low) & np.uint64((1 << BITS) - 1)).reshape(len(low), HASHES * BITS // 64, 64 // BITS)
    return (low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64).view(np.int64)


def band_keys(low: np.ndarray) -> np.ndarray:
    keys = np.empty((len(low), BANDS), np.uint64)
    for b in range(BANDS):
        acc = np.full(len(low), b + 1, np.uint64)
        for k in range(b * ROWS, (b + 1) * ROWS):
            acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + low[:, k])
        keys[:, b] = acc
    return keys.view(np.int64)


def _lists(matrix: np.ndarray, full: np.ndarray) -> pa.Array:
    """A list for each row of full: the matrix's next row, or an empty list."""
    width = matrix.shape[1]
    offsets = np.concatenate([[0], np.cumsum(full * width)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.reshape(-1)))


def _sketch(batches):
    for batch in batches:
        for part in slices(batch, "text", 1_500_000):
            at, hashes = shingles(part.column("text"))
            sizes, digests = [], []
            for i in range(part.num_rows):
                own = np.unique(hashes[at[i] : at[i + 1]])
                sizes.append(len(own))
                digests.append(xxhash.xxh3_128_digest(own.tobytes()))
            low, full = minima(at, hashes), np.diff(at) > 0
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("row"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), _lists(band_keys(low), full), _lists(packed(low), full)],
                names=["doc_id", "row", "n_shingles", "digest", "bands", "sig"],
            )


def _sets(batches):
    for batch in batches:
        for part in slices(batch, "text", 4_000_000):
            at, hashes = shingles(part.column("text"))
            own = [np.unique(hashes[at[i] : at[i + 1]]).view(np.int64) for i in range(part.num_rows)]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*own, np.empty(0, np.int64)])))],
                names=["id", "shingles"],
            )


#: Similarity estimate of sig and other_sig: equal nibbles by bit counts, freed of the 1 in 16 that collide by chance.
ESTIMATE = f"""((1 - aggregate(transform(zip_with(sig, other_sig, (x, y) -> x ^ y),
    x -> x | shiftrightunsigned(x, 1) | shiftrightunsigned(x, 2) | shiftrightunsigned(x, 3)),
    0, (a, x) -> a + bit_count(x & 1229782938247303441)) / {HASHES}D) - {2.0**-BITS}D) / {1 - 2.0**-BITS}D"""


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, comp): the least id reachable over links (a, b), by least neighbours and pointer jumping."""
    both = stored(links.selectExpr("a", "b").union(links.selectExpr("b", "a")).distinct(), "links")
    labels = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("comp")).select(F.col("a").alias("id"), "comp"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        joined = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", "comp", F.least("comp", "near").alias("next"))
        jump = labels.select(F.col("id").alias("next"), F.col("comp").alias("far"))
        step = stored(joined.join(jump, "next", "left").select("id", "comp", F.least("next", F.coalesce("far", "next")).alias("next")), "labels")
        labels = step.select("id", F.col("next").alias("comp"))
        if step.where("comp <> next").isEmpty():
            break
    return nodes.join(labels, "id", "left").select("id", F.coalesce("comp", "id").alias("comp"))


class Search:
    """The rounds over buckets of one collection of class representatives."""

    def __init__(self, reps: DataFrame, rows: DataFrame, percent: int = PERCENT) -> None:
        self.percent = percent
        keys = reps.select("id", "n_shingles", F.explode("bands").alias("key"))
        shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
        self.keys = stored(keys.join(shared, "key", "left_semi"), "buckets")
        self.nodes = self.keys.select("id").distinct()
        self.sig = stored(reps.join(self.nodes, "id", "left_semi").select("id", "n_shingles", "sig"), "signatures")
        texts = rows.join(reps.select("id", "row").join(self.nodes, "id", "left_semi"), "row").select("id", "text")
        self.sets = stored(texts.mapInArrow(_sets, "id long, shingles array<long>"), "sets")

    def likely(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that the packed signatures and sizes let pass, with their estimate."""
        a = self.sig.select(F.col("id").alias("a"), F.col("n_shingles").alias("n_a"), "sig")
        b = self.sig.select(F.col("id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("sig").alias("other_sig"))
        both = pairs.join(a, "a").join(b, "b").where(f"100 * least(n_a, n_b) >= {self.percent} * greatest(n_a, n_b)")
        return both.withColumn("estimate", F.expr(ESTIMATE)).where(f"estimate >= {self.percent / 100 - SLACK}").select("a", "b", "estimate")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs with linked, which the full sets decide."""
        a = self.sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
        b = self.sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
        both = pairs.select("a", "b").join(a, "a").join(b, "b").withColumn("both", F.size(F.array_intersect("x", "y")))
        linked = F.expr(f"100 * both >= {self.percent} * (size(x) + size(y) - both)")
        return both.groupBy("a", "b").agg(F.max(linked).alias("linked"))

    def run(self) -> DataFrame:
        tested = links = None
        comps = self.nodes.withColumn("comp", F.col("id"))
        for k in range(ROUNDS):
            rows = self.keys.join(comps, "id")
            order = F.struct(F.lit(0) if k == 0 else F.xxhash64("id", F.lit(k)), "id")
            open_ = rows.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.min_by(F.struct("id", "comp"), order).alias("pivot"))
            open_ = open_.where("least <> most").select("key", F.col("pivot.id").alias("pivot"), F.col("pivot.comp").alias("pivot_comp"))
            pairs = rows.join(open_, "key").where("comp <> pivot_comp").selectExpr("least(id, pivot) a", "greatest(id, pivot) b", "id").distinct()
            if tested is not None:
                pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
            hopeful = self.likely(pairs.select("a", "b").distinct())
            # for each member its best pivot of this round; the sweep takes care of the others where they still matter
            best = pairs.join(hopeful, ["a", "b"]).groupBy("id").agg(F.max_by(F.struct("a", "b"), F.struct("estimate", "a", "b")).alias("p"))
            new = stored(self.confirmed(best.select("p.a", "p.b").distinct()), "confirmed")
            tested = new if tested is None else tested.unionByName(new)
            links = tested.where("linked").select("a", "b")
            comps = stored(components(self.nodes, links), "components")
        more = stored(self.sweep(comps).distinct(), "swept")
        return stored(components(self.nodes, links.unionByName(more)), "components")

    def sweep(self, comps: DataFrame) -> DataFrame:
        """Links (a, b) that join the components which still meet in a bucket: all its pairs are compared on the full sets,
        about 2 * CHUNK members or 2 * SHINGLES shingles of them at a time, and only links that join components leave a task."""
        rows = self.keys.join(comps, "id")
        open_ = rows.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.count("*").alias("n"), F.sum("n_shingles").alias("all")).where("least <> most")
        rows = rows.join(open_.selectExpr("key", f"CAST(least(n, ceil(greatest(n / {CHUNK}, all / {SHINGLES}))) AS INT) AS m"), "key").withColumn("c", F.expr("CAST(pmod(xxhash64(id), m) AS INT)"))
        dealt = rows.select("key", "id", "comp", F.explode(F.expr("transform(sequence(0, m - 1), j -> struct(least(c, j) AS i, greatest(c, j) AS j))")).alias("p"))
        full = dealt.select("key", "p.i", "p.j", "id", "comp").join(self.sets, "id")
        percent = self.percent

        def joined(table: pa.Table) -> pa.Table:
            return _joined(table, percent)

        return full.groupBy("key", "i", "j").applyInArrow(joined, "a long, b long")


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sets of hashes, by products of indicator matrices in blocks of columns."""
    n = len(sets)
    which = np.repeat(np.arange(n), [len(x) for x in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    column, which = (np.cumsum(shared) - 1)[column][shared[column]], which[shared[column]]
    out = np.zeros((n, n), np.int64)
    order = np.argsort(column, kind="stable")
    column, which = column[order], which[order]
    for low in range(0, int(shared.sum()), COLUMNS):
        part = slice(*np.searchsorted(column, [low, low + COLUMNS]))
        block = np.zeros((n, COLUMNS), np.float32)
        block[which[part], column[part] - low] = 1
        out += (block @ block.T).astype(np.int64)
    return out


def _joined(table: pa.Table, percent: int) -> pa.Table:
    ids, comp = table.column("id").to_pylist(), table.column("comp").to_pylist()
    found = []
    if len(set(comp)) > 1:
        sets = [np.asarray(x.values) for x in table.column("shingles")]
        both, size = intersections(sets), np.array([len(x) for x in sets])
        _, own = np.unique(comp, return_inverse=True)
        linked = (100 * both >= percent * (size[:, None] + size[None, :] - both)) & (own[:, None] < own[None, :])
        root = list(range(int(own.max()) + 1))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for i, j in np.argwhere(linked):
            x, y = find(int(own[i])), find(int(own[j]))
            if x != y:
                root[y] = x
                found.append((ids[i], ids[j]))
    return pa.table([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])


def row_key(key: Column, text: Column) -> Column:
    """A 128-bit digest of id and text: what tells rows apart where ids are null or repeat. Rows that are alike share it."""
    marked = lambda c: F.coalesce(F.concat(F.lit("+"), c), F.lit("-"))  # noqa: E731  null and empty differ
    return F.unhex(F.md5(F.concat(marked(key.cast("long").cast("string")), F.lit(":"), marked(text)).cast("binary")))


def versions(sketch: DataFrame, of_class: DataFrame) -> DataFrame:
    """(component, whole): components joined where an id has texts in several of them."""
    repeated = sketch.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("digest").alias("first"), F.max("digest").alias("last")).where("first <> last")
    pairs = sketch.join(repeated.select("doc_id", "first"), "doc_id").where("n_shingles > 0 AND digest <> first").select("first", "digest").distinct()
    own = of_class.select("digest", "component")
    links = pairs.join(own.select(F.col("digest").alias("first"), F.col("component").alias("a")), "first").join(own.withColumnRenamed("component", "b"), "digest")
    links = stored(links.where("a <> b").select("a", "b").distinct(), "versions")
    nodes = links.select(F.col("a").alias("id")).union(links.select("b")).distinct()
    return components(nodes, links).select(F.col("id").alias("component"), F.col("comp").alias("whole"))


def grouped(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """doc_id, row (its row_key), n_shingles, component (a number of its own, null without words), component_id, kept for each row of docs."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), row_key(F.col(key), F.col(text)).alias("row"))
    sketch = stored(rows.mapInArrow(_sketch, "doc_id long, row binary, n_shingles long, digest binary, bands array<long>, sig array<long>"), "sketch")
    # equal sets have equal bands and signatures; a copy with an id stands for the class where there is one
    of_set = [F.any_value(c).alias(c) for c in ("n_shingles", "bands", "sig")]
    stands = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("stands")
    classes = sketch.where("n_shingles > 0").groupBy("digest").agg(stands, *of_set).select("digest", "stands.doc_id", "stands.row", "n_shingles", "bands", "sig")
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    if not sketch.groupBy("row").count().where("count > 1").isEmpty():
        rows = rows.dropDuplicates(["row"])
    comps = Search(classes, rows, percent).run()
    of_class = classes.join(comps, "id", "left").select("digest", "doc_id", "row", F.coalesce("comp", "id").alias("component"))
    of_class = of_class.join(versions(sketch, of_class), "component", "left").withColumn("component", F.coalesce("whole", "component")).drop("whole")
    named = of_class.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.min("row").alias("first"))
    # stored, so that both sides of the join below are plain exchanges and the rows of a class with very many copies are split
    of_class = stored(of_class.join(named, "component").select("digest", "component", "component_id", (F.col("row") == F.col("first")).alias("leads")), "of-class")
    own = sketch.select("doc_id", "row", "n_shingles", "digest")
    out = own.where("n_shingles > 0").join(of_class, "digest", "left")
    kept = F.col("component_id").eqNullSafe(F.col("doc_id")) & (F.col("doc_id").isNotNull() | F.col("leads"))
    worded = out.select("doc_id", "row", "n_shingles", "component", "component_id", kept.alias("kept"))
    # texts without words would all meet at one digest; they have no class to look up
    return worded.unionByName(own.where("n_shingles = 0").select("doc_id", "row", "n_shingles", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept")))


def group(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs."""
    return grouped(docs, text, key, percent).select("doc_id", "n_shingles", "component_id", "kept")


def op3_near_dedup(spark, sf_dir: str) -> DataFrame:
    return group(spark.read.parquet(f"{sf_dir}/documents.parquet"))
