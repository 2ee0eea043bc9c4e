"""Pre-tokens of whole batches of texts, found on arrays of code points.

The pattern of the byte-level vocabularies says: a contraction, or a run of letters, of digits or of other signs, each with the one
space before it, or white space. A run ends where the class of the code point changes, so one pass over the classes of a batch draws
all borders; white space before a run is cut before its last code point, and contractions move a few borders. Other patterns are
matched text by text. Equal pre-tokens are then coded once a batch, so what a pre-token gives is looked up once for each distinct one.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The pattern whose borders are drawn on arrays, and its contractions (fixed values).
RUNS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHORT, LONG = "stmd", ("re", "ve", "ll")
_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3
_table: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """The class of every code point."""
    if not _table:
        import regex

        table = np.full(0x110000, _OTHER, np.uint8)
        points = [*range(0xD800), *range(0xE000, 0x110000)]
        every, of = "".join(map(chr, points)), np.array(points)
        for kind, pattern in ((_SPACE, r"\s+"), (_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+")):
            for m in regex.finditer(pattern, every):
                table[of[m.start() : m.end()]] = kind
        _table.append(table)
    return _table[0]


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(byte offsets from 0, bytes) of an array of texts, null as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return np.zeros(1, np.int64), np.empty(0, np.uint8)
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return ends - ends[0], data


class Cutter:
    """Cuts texts into pre-tokens. whole: strings that are a pre-token of their own wherever they occur, looked for first."""

    def __init__(self, pattern: str, whole: tuple[str, ...] = ()) -> None:
        self.whole = re.compile(b"|".join(re.escape(w.encode()) for w in sorted(whole, key=len, reverse=True))) if whole else None
        self.pattern = None
        if pattern != RUNS:
            import regex

            self.pattern = regex.compile(pattern)

    def cut(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """(at, pieces): text i has the pieces at[i] to at[i + 1], as bytes."""
        ends, data = _buffers(texts)
        raw = data.tobytes()
        apart = [(m.start(), m.end()) for m in self.whole.finditer(raw)] if self.whole else []
        if apart:  # not across two texts
            of = np.searchsorted(ends, [x for pair in apart for x in (pair[0], pair[1] - 1)], "right").reshape(-1, 2)
            apart = [p for p, (a, b) in zip(apart, of, strict=True) if a == b]
        if self.pattern is not None:
            return self._matched(ends, raw, apart)
        starts = self._borders(ends, raw, apart)
        offsets = np.append(starts, len(raw)).astype(np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
        return np.searchsorted(starts, ends), pieces

    def _matched(self, ends: np.ndarray, raw: bytes, apart: list) -> tuple[np.ndarray, pa.Array]:
        pieces, at, k = [], [0], 0
        for a, b in zip(ends.tolist(), ends.tolist()[1:], strict=False):
            while a < b:
                upto = apart[k][0] if k < len(apart) and apart[k][0] < b else b
                pieces += [x.group().encode() for x in self.pattern.finditer(raw[a:upto].decode())]
                if upto < b:
                    pieces.append(raw[slice(*apart[k])])
                    upto, k = apart[k][1], k + 1
                a = upto
            at.append(len(pieces))
        return np.array(at), pa.array(pieces, pa.large_binary())

    @staticmethod
    def _borders(ends: np.ndarray, raw: bytes, apart: list) -> np.ndarray:
        """The bytes at which a pre-token begins, ascending."""
        if not raw:
            return np.zeros(0, np.int64)
        points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        n, ascii_only = len(points), len(points) == len(raw)
        kind = _classes()[points]
        if not ascii_only:
            begins = np.cumsum(1 + (points >= 0x80).view(np.uint8) + (points >= 0x800) + (points >= 0x10000), dtype=np.int64)
            begins = np.concatenate([[0], begins])
        place = (lambda b: b) if ascii_only else (lambda b: np.searchsorted(begins, b))
        edges = np.unique(np.concatenate([ends[:-1], np.array(apart, np.int64).ravel()]))
        edges = place(edges)
        fresh = np.zeros(n + 1, bool)  # a text or a whole string begins, or one ends: nothing reaches across
        fresh[edges] = True
        fresh[n] = True
        start = np.empty(n, bool)
        start[0] = True
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        start |= fresh[:-1]
        space = kind == _SPACE
        # the last of some white space before a run: a border, and if it is the plain space the run has none of its own
        last = np.flatnonzero(space[:-1] & ~space[1:] & ~fresh[1:-1])
        start[last] = True
        start[last[points[last] == 0x20] + 1] = False
        quotes = np.flatnonzero(start & (points == 0x27))
        if len(quotes):
            padded = np.concatenate([points, np.zeros(3, np.uint32)])
            closed = np.concatenate([fresh, np.ones(3, bool)])
            one = quotes[~closed[quotes + 1] & np.isin(padded[quotes + 1], [ord(c) for c in SHORT])]
            rest = quotes[~closed[quotes + 1] & ~closed[quotes + 2]]
            two = rest[np.isin((padded[rest + 1].astype(np.int64) << 32) | padded[rest + 2], [ord(a) << 32 | ord(b) for a, b in LONG])]
            start[one + 1] = False
            start[two + 1] = False
            for after in (one + 2, two + 3):
                start[after[after < n]] = True
        for a, b in apart:
            a, b = int(place(a)), int(place(b))
            start[a] = True
            start[a + 1 : b] = False
        found = np.flatnonzero(start)
        return found if ascii_only else begins[found]


def coded(pieces: pa.Array, of: Callable[[list[bytes]], list]) -> tuple[np.ndarray, list]:
    """(codes, entries): entry codes[j] is what `of` gives for piece j; it is called with the distinct pieces."""
    d = pieces.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False), of(d.dictionary.to_pylist())


def joined(parts: pa.Array, codes: np.ndarray) -> tuple[np.ndarray, memoryview]:
    """(offsets, bytes) of the parts that the codes name, one after another."""
    if not len(codes):
        return np.zeros(1, np.int64), memoryview(b"")
    out = parts.take(pa.array(codes))
    return np.frombuffer(out.buffers()[1], np.int64)[: len(codes) + 1], memoryview(out.buffers()[2] or b"")
