"""Byte-level BPE by a hierarchical-bitmap rank queue.

Each merge rank has a bucket of linked-list positions. A two-level bitmap tells which buckets hold any: find-first-set on
the summary, then on one word, gives the least rank in constant time, whatever the length of the pre-token. Entries that a
later merge has made stale stay in their bucket and are skipped when they come up. Pre-tokens of n bytes in all cost O(n log n)
at worst (the log is the order within a bucket), where a rescan of all pairs after each merge would cost O(n^2) of a long one. The
new pre-tokens of a batch go through one queue together.

The texts are only mapped: no shuffle, and memory is bounded by the slice of texts in hand and a cache of fixed size. A text is
never cut up, so the longest text bounds a slice from below. Null texts count as empty: no ids, and the digests of nothing. Rows are
coded one by one, rows that repeat an id or have none too; an empty table gives no rows. Of the table only the two named columns are
read, so others may have any name.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm.common import slices
from graphloom.llm.pretokens import Cutter, coded, joined

#: Pre-tokens kept with their ids, and the longest that is kept. The bound is on memory only.
CACHE_ENTRIES, CACHE_BYTES = 400_000, 64


class Merges:
    """The merge rules of a vocabulary: rank of the join of two ids, and of two bytes."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks, self.size = ranks, max(ranks.values(), default=0) + 1
        self.id_of = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        self.pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    self.pairs[a * self.size + b] = rank
        ids = self.id_of.tolist()
        self.first = np.array([self.pairs.get(a * self.size + b, -1) for a in ids for b in ids], np.int64)

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each pre-token, as 32-bit numbers: the pair of least rank is merged, leftmost first, until no pair has a rank.

        One queue serves all the pre-tokens, whose ends no pair crosses: the least rank of all is the least of its own pre-token, so
        each is merged in its own order. buckets[rank] holds positions, words[rank >> 6] has a bit for each bucket that holds any,
        summary a bit for each word that isn't zero. A bucket is worked off from left to right; where a merge makes a pair of
        lower rank, that goes first and the rest of the bucket waits. It is all written out here, as a call for each push would
        cost more than the push."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        data = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        n, stops = len(data), np.cumsum(sizes)
        if not n:
            return [b""] * len(pieces)
        last = stops[sizes > 0] - 1
        token = self.id_of[data]
        if (token < 0).any():
            raise ValueError("the vocabulary lacks a byte")
        ranks = np.full(n, -1, np.int64)
        ranks[:-1] = self.first[data[:-1] * 256 + data[1:]]
        ranks[last] = -1
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[last] = -1
        before[np.append(0, last[:-1] + 1)] = -1
        at = np.flatnonzero(ranks >= 0)
        at = at[np.argsort(ranks[at], kind="stable")]
        distinct, begin = np.unique(ranks[at], return_index=True)
        buckets = dict(zip(distinct.tolist(), (x.tolist() for x in np.split(at, begin[1:])), strict=False)) if len(at) else {}
        summary, words = 0, {}
        for r in buckets:
            words[r >> 6] = words.get(r >> 6, 0) | 1 << (r & 63)
            summary |= 1 << (r >> 6)
        token, pair, after, before = token.tolist(), ranks.tolist(), after.tolist(), before.tolist()
        joined_rank, size, in_bucket = self.pairs.get, self.size, buckets.get
        while summary:
            w = (summary & -summary).bit_length() - 1
            bits = words[w]
            rank = (w << 6) + (bits & -bits).bit_length() - 1
            bucket = buckets.pop(rank)
            words[w] = bits = bits & (bits - 1)
            if not bits:
                summary &= summary - 1
            bucket.sort()
            for done, i in enumerate(bucket):
                if pair[i] != rank:  # stale
                    continue
                j = after[i]
                k = after[i] = after[j]
                token[i], token[j], pair[j] = rank, -1, -1
                least = rank
                if k >= 0:
                    before[k] = i
                    pair[i] = r = joined_rank(rank * size + token[k], -1)
                    if r >= 0:
                        if (held := in_bucket(r)) is not None:
                            held.append(i)
                        else:
                            buckets[r], v = [i], r >> 6
                            words[v] = words.get(v, 0) | 1 << (r & 63)
                            summary |= 1 << v
                            least = r if r < least else least
                else:
                    pair[i] = -1
                h = before[i]
                if h >= 0:
                    pair[h] = r = joined_rank(token[h] * size + rank, -1)
                    if r >= 0:
                        if (held := in_bucket(r)) is not None:
                            held.append(h)
                        else:
                            buckets[r], v = [h], r >> 6
                            words[v] = words.get(v, 0) | 1 << (r & 63)
                            summary |= 1 << v
                            least = r if r < least else least
                if least < rank:
                    if done + 1 < len(bucket):
                        buckets[rank] = bucket[done + 1 :]
                        words[w] |= 1 << (rank & 63)
                        summary |= 1 << w
                    break
        token = np.array(token, np.int64)
        left = token >= 0
        ends = np.concatenate([[0], np.cumsum(left)])[np.concatenate([[0], stops])].tolist()
        ids = token[left].astype("<i4").tobytes()
        return [ids[4 * a : 4 * b] for a, b in zip(ends, ends[1:], strict=False)]


class Codec(dict):
    """Encodes whole texts and decodes ids. blob: the text of a rank file (token in base64, space, rank).

    As a mapping it holds of a pre-token (bytes) the ids, as 32-bit numbers. Pre-tokens seen lately are kept in two generations: when
    the younger is full it becomes the older, so frequent ones stay. A batch asks once for each of its distinct pre-tokens."""

    def __init__(self, blob: bytes, pattern: str) -> None:
        super().__init__()
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, blob.splitlines()) if a}
        of = {i: b for b, i in self.ranks.items()}
        every = range(max(of, default=-1) + 1)
        self.bytes_of = pa.array([of.get(i, b"") for i in every], pa.large_binary())
        self.decimal = pa.array([b" %d" % i for i in every], pa.large_binary())
        self.merges = Merges(self.ranks)
        self.cutter = Cutter(pattern)
        self.older: dict[bytes, bytes] = {}

    def learn(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each of the distinct pre-tokens; the new ones are merged together."""
        own, older = self.get, self.older.get
        out = [own(p) or older(p) for p in pieces]
        missing = [j for j, e in enumerate(out) if e is None]
        new = [pieces[j] for j in missing]
        whole = [self.ranks.get(p) for p in new]
        made = iter(self.merges.encode([p for p, r in zip(new, whole, strict=True) if r is None]))
        for j, r in zip(missing, whole, strict=True):
            out[j] = next(made) if r is None else r.to_bytes(4, "little")
        if len(self) + len(missing) > CACHE_ENTRIES:
            self.older = dict(self)
            self.clear()
            missing = range(len(pieces))
        self.update((pieces[j], out[j]) for j in missing if len(pieces[j]) <= CACHE_BYTES)
        return out

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of all texts one after another."""
        at, pieces = self.cutter.cut(texts)
        codes, entries = coded(pieces, self.learn)
        offsets, data = joined(pa.array(entries, pa.large_binary()), codes)
        return offsets[at] // 4, np.frombuffer(data, "<i4")[: offsets[-1] // 4]

    def written(self, ends: np.ndarray, ids: np.ndarray) -> list[memoryview]:
        """The ids of each text in decimal, with a space between two."""
        return [x[1:] for x in self._of_each(self.decimal, ends, ids)]

    def decoded(self, ends: np.ndarray, ids: np.ndarray) -> list[memoryview]:
        """The bytes that the ids of each text stand for."""
        return self._of_each(self.bytes_of, ends, ids)

    @staticmethod
    def _of_each(parts: pa.Array, ends: np.ndarray, ids: np.ndarray) -> list[memoryview]:
        offsets, data = joined(parts, ids)
        cuts = offsets[ends].tolist()
        return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


_codecs: dict[tuple[int, str], Codec] = {}


def codec(blob: bytes, pattern: str) -> Codec:
    """One codec for each worker process and vocabulary."""
    key = (hash(blob), pattern)
    if key not in _codecs:
        _codecs[key] = Codec(blob, pattern)
    return _codecs[key]


def encode_table(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, ids (list of int), decoded (binary) for each row. vocabulary: path of the rank file, read on the driver and
    broadcast (a file of fixed size, under 1 MB)."""
    blob = _broadcast_file(docs, vocabulary)

    def run(batches):
        c = codec(blob.value, pattern)
        for batch in batches:
            for part in slices(batch, "text"):
                ends, ids = c.ids(part.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, pa.array([bytes(x) for x in c.decoded(ends, ids)], pa.binary())], names=["doc_id", "ids", "decoded"])

    rows = docs.selectExpr(f"`{key}` AS doc_id", f"`{text}` AS text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded binary")


def digest_table(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """As encode_table, but with digests made beside the ids, so that ids need not leave the worker."""
    blob = _broadcast_file(docs, vocabulary)

    def run(batches):
        c = codec(blob.value, pattern)
        for batch in batches:
            for part in slices(batch, "text"):
                ends, ids = c.ids(part.column("text"))
                hexed = [pa.array([hashlib.sha256(x).hexdigest() for x in of(ends, ids)], pa.string()) for of in (c.written, c.decoded)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(ends)), *hexed],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    rows = docs.selectExpr(f"`{key}` AS doc_id", f"`{text}` AS text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _broadcast_file(docs: DataFrame, path: str):
    with open(path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digest_table(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
