"""The Katz model of order two over packed keys, for corpora whose tokens are too many to shuffle one by one.

The corpus is cut into chunks of whole documents with about CHUNK tokens. A chunk is one stored row: its distinct word hashes, its
tokens as numbers of these, its documents. It sends its distinct keys, in ascending order, to buckets of the key space as
byte planes of their differences, and gets back the counts in the same order; a bucket is a fixed share of the stored chunks. Counts
are kept in tables partitioned by order. Discounts and back-off are those of katz.py:

1. words: each chunk learns its words' train counts; sums over buckets give N, V and Good-Turing's counts of counts.
2. grams: each chunk learns its grams' train counts; one chunk is named the owner of each gram.
3. histories: an owner adds what its seen grams lose by discounting and their lower-order probabilities to their histories;
   each history's alpha is the sum of the first over its total and over one minus the sum of the second.
4. texts: a token is scored by its gram where that is seen, else by alpha times the lower order. Only tokens that need something of
   their history beyond its count wait for step 4; the others are summed in step 3.

Each row is scored by itself, rows that repeat a doc_id too. Null and empty texts are one end token; a null doc_id is kept. An empty
table gives no rows. A chunk holds one document at least, so a document of more than CHUNK tokens is a chunk of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import fold, lower_ascii, mix, plan_bytes, stored
from graphloom.llm.katz import CUT, discounts_of

CHUNK, BUCKET_MB, LEAST_BUCKETS = 1_500_000, 1.0, 64
_FIELDS = "chunk long, bucket int, kind int, a binary, b binary, c binary, stats array<long>"
_TEXTS, _WORDS, _GRAMS, _HISTORIES = 0, 1, 2, 3
_START, _END = np.uint64(0x243F6A8885A308D3), "\x02 "  # no word holds a space; the start is only ever a history


def pack(x: np.ndarray) -> bytes:
    """The numbers' bytes, all first ones before all second ones, compressed, behind their length."""
    x = np.ascontiguousarray(x)
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unpack(data: bytes, kind=np.uint64) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    if not size:
        return np.zeros(0, kind)
    raw = np.frombuffer(pa.decompress(data[8:], size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def _runs(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """The runs of ascending keys that share a bucket; buckets cut the key space into equal parts."""
    of = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    at = np.flatnonzero(np.diff(of, prepend=np.uint64(buckets)))
    for i, j in zip(at, [*at[1:], len(of)], strict=False):
        yield int(of[i]), slice(i, j)


def _rows(schema: pa.Schema, rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist([{n: r.get(n) for n in schema.names} for r in rows], schema=schema)


def _cut(schema: pa.Schema, end: int, most: int):
    """Arrow batches of doc_id, held, w to one row a chunk."""

    def row(number: int, ids: list, held: list, words: list, sizes: list) -> pa.Table:
        sizes, held = np.concatenate(sizes), np.concatenate(held)
        tokens = np.insert(np.concatenate(words), np.cumsum(sizes), end).view(np.uint64)
        distinct, of, n = np.unique(tokens, return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        docs = ((sizes + 1).astype(np.uint64) << np.uint64(1)) | held.astype(np.uint64)
        return _rows(schema, [{"chunk": number, "bucket": -1, "kind": _TEXTS, "a": pack(distinct[order]), "b": pack(rank[of]), "c": pack(docs), "ids": [x for part in ids for x in part.to_pylist()]}])

    def run(batches):
        from pyspark import TaskContext

        number, got, total = TaskContext.get().partitionId() << 24, ([], [], [], []), 0
        for batch in batches:
            w = batch.column(2)
            ends = w.offsets.to_numpy()
            values, base = w.values.to_numpy(zero_copy_only=False), 0
            while base < batch.num_rows:
                upto = int(np.searchsorted(ends, ends[base] + max(0, most - total), "right")) - 1
                upto = min(max(upto, base + (not total)), batch.num_rows)
                if upto > base:
                    for part, x in zip(got, (batch.column(0)[base:upto], batch.column(1)[base:upto].to_numpy(zero_copy_only=False), values[ends[base] : ends[upto]], np.diff(ends[base : upto + 1])), strict=True):
                        part.append(x)
                    total += int(ends[upto] - ends[base]) + upto - base
                if upto < batch.num_rows or total >= most:
                    yield from row(number, *got).to_batches()
                    number, got, total = number + 1, ([], [], [], []), 0
                base = upto
        if got[0]:
            yield from row(number, *got).to_batches()

    return run


class _Chunk:
    """One chunk in memory: words, and for each token its word t, its history h (the last number: start), its doc, train."""

    def __init__(self, a: bytes, b: bytes, c: bytes) -> None:
        self.words, self.t = unpack(a), unpack(b, np.uint32).astype(np.int64)
        docs = unpack(c)
        self.sizes, self.held = (docs >> np.uint64(1)).astype(np.int64), (docs & np.uint64(1)).astype(bool)
        self.h = np.concatenate([[0], self.t[:-1]])
        self.h[np.cumsum(self.sizes) - self.sizes] = len(self.words)
        self.keys = np.append(self.words, _START)

    def train(self) -> np.ndarray:
        return np.repeat(~self.held, self.sizes)

    def grams(self) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(mix(self.keys)[self.h] * np.uint64(3) + self.words[self.t])


def _send(schema: pa.Schema, kind: int, buckets: int):
    """Chunks to rows of ascending keys and their train counts, by bucket."""

    def run(batches):
        for batch in batches:
            for r in batch.select(["chunk", "a", "b", "c"]).to_pylist():
                x = _Chunk(r["a"], r["b"], r["c"])
                if kind == _WORDS:
                    order = np.argsort(x.words)
                    keys, n = x.words[order], np.bincount(x.t[x.train()], minlength=len(x.words))[order]
                else:
                    keys, of = np.unique(x.grams(), return_inverse=True)
                    n = np.bincount(of[x.train()], minlength=len(keys))
                rows = [{"chunk": r["chunk"], "bucket": k, "kind": kind, "a": pack_sorted(keys[s]), "b": pack(n[s].astype(np.uint64))} for k, s in _runs(keys, buckets)]
                yield from _rows(schema, rows).to_batches()

    return run


def _merge(schema: pa.Schema, kind: int, cut: int):
    """A bucket's rows to the summed counts, doubled, plus one for the owner, in each chunk's order, and one row of sums."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["chunk", "bucket", "a", "b"]).to_pylist()
        parts = [unpack_sorted(r["a"]) for r in rows]
        keys, first, of = np.unique(np.concatenate(parts), return_index=True, return_inverse=True)
        n = np.zeros(len(keys), np.int64)
        np.add.at(n, of, np.concatenate([unpack(r["b"]) for r in rows]).astype(np.int64))
        back = n[of].astype(np.uint64) << np.uint64(1)
        back[first] |= np.uint64(1)
        ends = np.cumsum([len(x) for x in parts])
        out = [{"chunk": r["chunk"], "bucket": r["bucket"], "kind": kind, "a": pack(back[e - len(x) : e])} for r, x, e in zip(rows, parts, ends, strict=True)]
        few = np.bincount(n[n <= cut + 1], minlength=cut + 2)
        out.append({"chunk": -1, "kind": kind, "stats": [int(n.sum()), int((n > 0).sum()), *map(int, few[1:])]})
        return _rows(schema, out)

    return run


def _discounted(n: np.ndarray, d: dict[int, float]) -> np.ndarray:
    """Counts times their discounts."""
    out = n.astype(np.float64)
    for r, x in d.items():
        out[n == r] = r * x
    return out


def _returned(rows: list[dict], kind: int, column: str, number=np.uint64) -> np.ndarray:
    """What the buckets sent back to a chunk, in the order of its ascending keys."""
    parts = sorted((r["bucket"], r[column]) for r in rows if r["kind"] == kind)
    return np.concatenate([np.zeros(0, number), *[unpack(x, number) for _, x in parts]])


def _weigh(schema: pa.Schema, buckets: int, d1: dict, d2: dict, scale: float, unknown: float, n: int, v: int, end: int):
    """A chunk with its counts to what its owned grams add to their histories, by bucket, and one row of the texts' sums so far."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        own = next(r for r in rows if r["kind"] == _TEXTS)
        x = _Chunk(own["a"], own["b"], own["c"])
        c1 = np.empty(len(x.words), np.int64)
        c1[np.argsort(x.words)] = (_returned(rows, _WORDS, "a") >> np.uint64(1)).astype(np.int64)
        p1 = np.where(c1 > 0, _discounted(c1, d1) * scale, unknown)
        total = np.append(c1, c1[x.words == np.int64(end).view(np.uint64)])  # as many starts as ends
        _, first, of = np.unique(x.grams(), return_index=True, return_inverse=True)
        back = _returned(rows, _GRAMS, "a")
        c2, h, w = (back >> np.uint64(1)).astype(np.int64), x.h[first], x.t[first]
        seen, kept = c2 > 0, _discounted(c2, d2)
        owned, size = seen & (back & np.uint64(1)).astype(bool), len(x.keys)
        lost = np.bincount(h[owned], (c2 - kept)[owned], size)
        taken = np.bincount(h[owned], p1[w[owned]], size)
        full = np.bincount(h[seen], (c2 - kept)[seen], size) <= 0  # none of the grams here is discounted: perhaps none anywhere
        gram = np.where(seen, np.log10(np.where(seen, kept, 1.0)) - np.log10(np.maximum(total[h], 1)), np.log10(p1[w]))
        waits = ~seen | full[h]
        # texts
        doc = np.repeat(np.arange(len(x.sizes)), x.sizes)
        sums = lambda values: np.bincount(doc, values, len(x.sizes))
        base = np.log10((c1 + 0.5) / (n + 0.5 * (v + 1)))
        texts = np.concatenate([x.sizes, sums(c1[x.t] > 0), sums(base[x.t]), sums(gram[of]), x.held]).astype(np.float64)
        # histories, ascending
        wanted = np.zeros(size, bool)
        wanted[h[waits]] = True
        there = np.zeros(size, bool)
        there[h[owned]] = True
        order = np.argsort(x.keys)
        order = order[(there | wanted)[order]]
        place = np.cumsum(wanted[order]) - 1
        at = np.zeros(size, np.int64)
        at[order] = place
        later = waits[of]
        tokens = (at[x.h[later]] << 1) | ~seen[of[later]]
        out = [{"chunk": own["chunk"], "bucket": -1, "kind": _TEXTS, "a": pack(np.bincount(doc[later], minlength=len(x.sizes)).astype(np.uint32)), "b": pack(tokens.astype(np.uint32)), "c": pack(texts), "ids": own["ids"]}]
        keys = x.keys[order]
        for k, s in _runs(keys, buckets):
            i = order[s]
            out.append({"chunk": own["chunk"], "bucket": k, "kind": _HISTORIES, "a": pack_sorted(keys[s]), "b": pack((total[i].astype(np.uint64) << np.uint64(1)) | wanted[i]), "c": pack(np.concatenate([lost[i], taken[i]]))})
        return _rows(schema, out)

    return run


def _back_off(schema: pa.Schema):
    """A bucket's histories to log10 alpha, and log10 of what a seen gram's probability changes by where nothing was left, for each chunk."""

    def run(table: pa.Table) -> pa.Table:
        if table.column("kind")[0].as_py() == _TEXTS:
            return table
        rows = table.select(["chunk", "bucket", "a", "b", "c"]).to_pylist()
        parts = [unpack_sorted(r["a"]) for r in rows]
        flags, sums = [unpack(r["b"]) for r in rows], [unpack(r["c"], np.float64).reshape(2, -1) for r in rows]
        keys, of = np.unique(np.concatenate(parts), return_inverse=True)
        lost, taken = (np.bincount(of, np.concatenate([x[k] for x in sums]), len(keys)) for k in (0, 1))
        total = np.zeros(len(keys))
        total[of] = np.concatenate(flags) >> np.uint64(1)
        left = lost > 1e-9 * total
        whole = np.where(left, total, total + 1)
        alpha = np.where(left, lost, 1.0) / whole / np.maximum(1 - taken, 1e-12)
        alpha[total == 0] = 1.0
        fix, out, start = np.log10(np.maximum(total, 1) / np.maximum(whole, 1)), [], 0
        for r, x, f in zip(rows, parts, flags, strict=True):
            i = of[start : start + len(x)][(f & np.uint64(1)).astype(bool)]
            out.append({"chunk": r["chunk"], "bucket": r["bucket"], "kind": _HISTORIES, "a": pack(np.log10(alpha)[i]), "b": pack(fix[i])})
            start += len(x)
        return _rows(schema, out)

    return run


def _finish(schema: pa.Schema):
    """A chunk's sums and histories to one row a text."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        own = next(r for r in rows if r["kind"] == _TEXTS)
        sizes, known, base, score, held = unpack(own["c"], np.float64).reshape(5, -1)
        alpha, fix = (_returned(rows, _HISTORIES, k, np.float64) for k in "ab")
        tokens, doc = unpack(own["b"], np.uint32), np.repeat(np.arange(len(sizes)), unpack(own["a"], np.uint32))
        at = tokens >> np.uint32(1)
        score = score + np.bincount(doc, np.where(tokens & np.uint32(1), alpha[at], fix[at]), len(sizes))
        columns = [pa.array(own["ids"], schema.field(0).type), *map(pa.array, (held > 0, sizes.astype(np.int64), known.astype(np.int64), base, score))]
        return pa.Table.from_arrays(columns, schema=schema)

    return run


def score(docs: DataFrame, held_out, cut: int = CUT, chunk: int = CHUNK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. held_out: which ids the model doesn't learn from."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    words = F.filter(F.split(lower_ascii(F.coalesce("text", F.lit(""))), "[\\x20\\x09-\\x0D]+"), lambda x: x != "")
    held = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    rows = docs.select("doc_id", held.alias("held"), F.transform(words, lambda x: F.xxhash64(x)).alias("w"))
    end = spark.range(1).select(F.xxhash64(F.lit(_END))).first()[0]
    plain = spark.createDataFrame([], _FIELDS).schema
    carried = spark.createDataFrame([], f"{_FIELDS}, ids array<{docs.schema['doc_id'].dataType.simpleString()}>").schema
    small, large = to_arrow_schema(plain), to_arrow_schema(carried)

    chunks = stored(rows.mapInArrow(_cut(large, end, chunk), carried), "katz-chunks")
    buckets = max(LEAST_BUCKETS, math.ceil(plan_bytes(chunks) / (BUCKET_MB * 1e6)))
    counts, sums = [], []
    for kind in (_WORDS, _GRAMS):
        sent = chunks.mapInArrow(_send(small, kind, buckets), plain)
        counts.append(stored(sent.groupBy("bucket").applyInArrow(_merge(small, kind, cut), plain), f"katz-counts-{kind}", ["kind"]))
        sums.append([x or 0 for x in counts[-1].where("chunk = -1").agg(*[F.sum(F.get("stats", F.lit(i))) for i in range(cut + 3)]).first()])
    (n, v, *few), d1, d2 = sums[0], *[discounts_of(dict(enumerate(s[2:], 1)), cut) for s in sums]
    n_cut = sum(r * few[r - 1] for r in range(1, cut + 1))
    mass = n - n_cut + sum(r * d1[r] * few[r - 1] for r in range(1, cut + 1))
    unknown = max(1.0 - mass / max(1, n), 0.5 / (max(1, n) + 0.5 * (v + 1)))
    scale = (1.0 - unknown) / mass if mass else 0.0

    to_chunks = chunks
    for c in counts:
        to_chunks = to_chunks.unionByName(c.where("chunk >= 0"), allowMissingColumns=True)
    weighed = to_chunks.groupBy("chunk").applyInArrow(_weigh(large, buckets, d1, d2, scale, unknown, n, v, end), carried)
    place = F.when(F.col("kind") == _TEXTS, -1 - F.col("chunk")).otherwise(F.col("bucket")).alias("place")
    backed = weighed.groupBy(place).applyInArrow(_back_off(large), carried)
    result = docs.select("doc_id").limit(0).selectExpr("doc_id", "false AS held_out", "0L AS n_tokens", "0L AS n_known", "0D AS base_score", "0D AS score").schema
    out = backed.groupBy("chunk").applyInArrow(_finish(to_arrow_schema(result)), result)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op1_katz(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), lambda c: fold(c) == 1)
