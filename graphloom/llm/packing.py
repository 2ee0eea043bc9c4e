"""Order-preserving packing by dynamic programming.

The ids of a partition's documents, each closed by one id, form one stream. Window cuts are chosen at document ends
(free) or sentence ends (a small penalty); only stretches without either get forced places (a large one). With
cost(i, j) = window - (j - i) the best predecessor within a window is the least f(i) + i, which a monotone queue keeps
in constant time for each place; windows whose length is a power of two need no padding and are tried besides.

The scan's own partitions are packed as they stand: no shuffle, and a rerun of a task gives the same rows. The stream is
solved in runs of bounded length whose last window stays open for the next run, so memory doesn't grow with the input.
Null texts count as empty and still get their closing id; nothing is cut off or dropped. A document of any length is held whole by its
task. Rows that repeat a doc_id, or have none, are documents of their own, told apart by sequence and offset. An empty table gives no
rows. Only the two named columns are read, so others may have any name.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from graphloom.llm.common import slices
from graphloom.llm.pretokens import Cutter, coded, joined

WINDOW = 1024
#: Penalties, in ids of padding: for a window as such, for a cut at a sentence end and for one inside a sentence.
PER_WINDOW, SENTENCE, FORCED = 1, 2, 64
#: Ids in a run, pre-tokens in the cache and the longest kept there: bounds on memory only.
RUN, CACHE_ENTRIES, CACHE_BYTES = 1 << 18, 400_000, 64


def places(ends_sentence: np.ndarray, doc_ends: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Possible cuts after which a window may begin, ascending, and the penalty of each. 0 and the end are among them."""
    n = len(ends_sentence)
    penalty = np.full(n + 1, -1, np.int32)
    penalty[1:][ends_sentence] = SENTENCE
    penalty[doc_ends] = 0
    penalty[0] = penalty[n] = 0
    at = np.flatnonzero(penalty >= 0)
    gaps = np.diff(at)
    for i in np.flatnonzero(gaps > window // 2):  # half a window, so that what precedes the stretch can be filled up
        penalty[at[i] + window // 2 : at[i + 1] : window // 2] = FORCED
    at = np.flatnonzero(penalty >= 0)
    return at, penalty[at]


def cuts(at: np.ndarray, penalty: np.ndarray, window: int = WINDOW, open_end: bool = False) -> list[int]:
    """The places of least total padding and penalty. open_end: the last window isn't padded yet."""
    places_, costs = at.tolist(), penalty.tolist()
    n = len(places_)
    best, came = [0.0] * n, [-1] * n
    ends, earlier = _exact(at, window)
    queue: deque[int] = deque([0])
    keys = [0.0] * n  # best[i] + place of i
    for j in range(1, n):
        p = places_[j]
        low = p - window
        while places_[queue[0]] < low:
            queue.popleft()
        i = queue[0]
        value = keys[i] + window - p
        if open_end and j == n - 1:
            value = keys[i] - p + 0.5 * (p - places_[i])
        for h in earlier[ends[j] : ends[j + 1]]:
            if best[h] < value:
                value, i = best[h], h
        value += PER_WINDOW + costs[j]
        best[j], came[j] = value, i
        key = keys[j] = value + p
        while queue and keys[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    out, j = [], n - 1
    while j >= 0:
        out.append(places_[j])
        j = came[j]
    return out[::-1]


def _exact(at: np.ndarray, window: int) -> tuple[list[int], list[int]]:
    """(ends, earlier): place j lies a power of two, under a window, after each of the places earlier[ends[j]:ends[j + 1]]."""
    late, early = [], []
    for k in range((window - 1).bit_length()):
        h = np.searchsorted(at, at - (1 << k))
        found = np.flatnonzero(at[h] == at - (1 << k))
        late.append(found)
        early.append(h[found])
    late, early = np.concatenate(late), np.concatenate(early)
    order = np.argsort(late, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(late, minlength=len(at)))]).tolist(), early[order].tolist()


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself where printable, else the next free one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Ids(dict):
    """Ids of whole texts by the tokenizers library's model: each distinct match of the pre-token pattern is given to it and
    kept, packed, in two generations as the younger fills up. The file's added tokens are looked for first, as the library does."""

    def __init__(self, blob: str, pattern: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(blob)
        self.tokenize = self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.added = {t.content.encode(): array("I", [i]).tobytes() for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.cutter = Cutter(pattern, tuple(x.decode() for x in self.added))
        self.older: dict[bytes, bytes] = {}
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.rstrip("\"')")[-1:] in (".", "!", "?", "Ċ")

    def __missing__(self, piece: bytes) -> bytes:
        ids = self.older.get(piece) or self.added.get(piece)
        if ids is None:
            ids = array("I", [t.id for t in self.tokenize(piece.decode("latin-1").translate(self.letters))]).tobytes()
            if len(piece) > CACHE_BYTES:
                return ids
        if len(self) >= CACHE_ENTRIES:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids

    def of(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        at, pieces = self.cutter.cut(texts)
        codes, entries = coded(pieces, lambda found: [self[x] for x in found])
        offsets, data = joined(pa.array(entries, pa.large_binary()), codes)
        ids, cuts = np.frombuffer(data, np.uint32)[: offsets[-1] // 4], (offsets[at] // 4).tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


_ids: dict[int, Ids] = {}


def ids_for(blob: str, pattern: str) -> Ids:
    key = hash((blob, pattern))
    if key not in _ids:
        _ids[key] = Ids(blob, pattern)
    return _ids[key]


def pack_stream(docs, ends: np.ndarray, first: int, closing: int = 0, window: int = WINDOW, run: int = RUN):
    """docs: (doc_id, ids) in order. Yields (doc_id, start, length, ids, doc_tokens, sequence_id, offset) for each piece."""
    held: list[tuple] = []  # (doc_id, all its ids, from where)
    total, sequence = 0, first

    def solve(last: bool):
        nonlocal held, total, sequence
        stream = np.concatenate([ids[s:] for _, ids, s in held])
        doc_ends = np.cumsum([len(ids) - s for _, ids, s in held])
        at, penalty = places(ends[stream], doc_ends, window)
        chosen = cuts(at, penalty, window, open_end=not last)
        if not last:
            chosen = chosen[:-1]
        k, begun, pieces = 0, 0, []
        for a, b in zip(chosen, chosen[1:], strict=False):
            while k < len(held) and begun < b:
                doc_id, ids, s = held[k]
                upto = min(b, int(doc_ends[k]))
                n = upto - begun
                pieces.append((doc_id, s, n, ids[s : s + n], len(ids), sequence, begun - a))
                if upto == doc_ends[k]:
                    k += 1
                else:
                    held[k] = (doc_id, ids, s + n)
                begun = upto
            sequence += 1
        held = held[k:]
        total = sum(len(ids) - s for _, ids, s in held)
        return pieces

    for doc_id, ids in docs:
        held.append((doc_id, np.append(ids, np.uint32(closing)), 0))
        total += len(ids) + 1
        if total >= run:
            yield from solve(False)
    if held:
        yield from solve(True)


def pack(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", key: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """One row for each piece, with its ids: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    sequence_id is the task's partition in its upper bits and a running number below. vocabulary: path of a tokenizers
    file, read on the driver and broadcast (a file of fixed size, under 2 MB)."""
    return _packed(docs, vocabulary, pattern, text, key, window, "ids array<long>", lambda ids: ids.tolist())


def pack_digests(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", key: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """As pack, with the CRC-32 of each piece's ids (little-endian unsigned 32-bit) in their place."""
    return _packed(docs, vocabulary, pattern, text, key, window, "ids_crc32 long", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()))


def _packed(docs, vocabulary, pattern, text, key, window, column, value) -> DataFrame:
    with open(vocabulary, encoding="utf-8") as f:
        blob = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.selectExpr(f"`{key}` AS doc_id", f"`{text}` AS text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, {column}, doc_tokens long, sequence_id long, offset long"
    name, of = column.split()
    arrow = [pa.int64() if kind == "bigint" else None, pa.int64(), pa.int64(), pa.list_(pa.int64()) if of != "long" else pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    names = ["doc_id", "start", "length", name, "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        ids = ids_for(blob.value, pattern)

        def stream():
            for batch in batches:
                for part in slices(batch, "text"):
                    yield from zip(part.column("doc_id").to_pylist(), ids.of(part.column("text")), strict=True)

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow, strict=True)], names=names)

        out = []
        for doc_id, start, n, own, total, sequence, offset in pack_stream(stream(), ids.ends, TaskContext.get().partitionId() << 40, window=window):
            out.append((doc_id, start, n, value(own), total, sequence, offset))
            if len(out) >= 10_000:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    return rows.mapInArrow(run, schema)


def op7_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_digests(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
