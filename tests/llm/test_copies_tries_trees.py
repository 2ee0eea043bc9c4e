"""Exact duplicates, prefix tries and dual-tree clustering against brute force on awkward tables (their SQL is in test_llm.py)."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import dual_tree, exact_dedup, prefix_trie

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# exact duplicates

LONG = "The quick brown fox. " * 3000
TEXTS = [
    (1, None), (2, ""), (3, " "), (4, "Ärger ÀB"), (5, "ärger ÀB"), (6, "Ärger Àb"), (7, LONG), (8, LONG.upper()), (9, LONG + "x"), (10, LONG[:-1]), (11, "x" * 32), (12, "X" * 32), (13, "x" * 33), (14, "x" * 31),
    (7, LONG), (None, "alone"), (None, "both"), (None, "both"), (20, "mixed ids"), (None, "MIXED ids"), (21, "same id"), (21, "same id"), (21, "Same ID"), (21, "another"), (22, "\x00\x00"), (23, "\x00"), (24, "x" * 128), (25, "x" * 128), (26, "x" * 160),
]


def _copies(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[(t or "").translate(LOW)].append(i)
    top = {t: max((i for i in ids if i is not None), default=None) for t, ids in by.items()}
    return sorted(repr((i, top[n], len(by[n]), hashlib.sha256(n.encode()).hexdigest())) for i, t in rows for n in [(t or "").translate(LOW)])


@pytest.mark.parametrize("first, wider, few", [(32, 4, 64_000_000), (1, 4, 0), (7, 3, 0)])
def test_exact_dedup_equals_brute_force(spark, monkeypatch, first, wider, few):
    monkeypatch.setattr(exact_dedup, "BROADCAST", few)
    classes = exact_dedup.classes
    monkeypatch.setattr(exact_dedup, "classes", lambda d: classes(d, first, wider))
    docs = spark.createDataFrame([(i, t, 0, 1) for i, t in TEXTS], "doc_id long, text string, `group` int, row int").repartition(3)
    rows = exact_dedup.exact_dedup(docs).collect()
    assert sorted(repr((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in rows) == _copies(TEXTS)
    kept = [r for r in rows if r.kept]
    assert len(kept) == len({r.text_sha256 for r in rows}) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_exact_dedup_of_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_dedup(empty).collect() == []


def test_exact_dedup_of_a_hot_group(spark):
    """Half of all rows are one text; its row with the largest id stays."""
    rows = [(i, LONG[:5000] if i % 2 else f"{LONG[:4000]}{i}") for i in range(600)]
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    assert all(got[i].group_size == (300 if i % 2 else 1) and got[i].kept == (i == 599 or i % 2 == 0) for i in range(600))


# prefix tries


def _trie(rows):
    """Nodes by brute force; rows (conv_id, turn, role, text) without ties in turn."""
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, r or "", x or ""))
    turns = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}
    members, full = defaultdict(list), {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = turns.get(c - c % 100, [])[:h] + turns[c][h:]
        for d in range(len(full[c]) + 1):
            members[tuple(full[c][:d])].append(c)
    kids, leaves, saved, out = defaultdict(list), {}, {}, []
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    for k, m in sorted(members.items(), key=lambda e: -len(e[0])):
        leaves[k] = sum(leaves[q] for q in kids[k]) or 1
        saved[k] = sum(saved[q] for q in kids[k]) + ((len(m) - 1) * len(k[-1][1]) if k else 0)
        ends = ",".join(str(c) for c in sorted(m) if len(full[c]) == len(k))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def _nodes(spark, rows, **kw):
    turns = spark.createDataFrame([(*r, 0, "y") for r in rows], "conv_id long, turn long, role string, text string, n int, up string").repartition(4)
    return sorted((tuple(r) for r in prefix_trie.nodes(turns, **kw).collect()), key=lambda r: r[:2])


def _talks():
    """A hot first turn, a hot conversation, a long one, copies, nulls, and some that their family leaves without turns."""
    rng = np.random.default_rng(3)
    rows = [(c, t, "user" if t % 2 else None, f"é{t}" if t < 2 else f"says {rng.integers(3)}") for c in range(100, 330) for t in range(int(rng.integers(1, 7)))]
    rows += [(c, t, "system", f"same {t}") for c in range(1000, 1060) for t in range(4)]
    rows += [(2000, t, "r", "deep" if t else None) for t in range(400)] + [(2001, t, "r", "deep" if t else None) for t in range(390)]
    rows += [(c, None, "a", "null turn first") for c in range(200, 230)]
    rows += [(c, 0, None, None) for c in range(5001, 5040)] + [(None, 1, "user", "no conversation"), (-150, 1, "u", "below"), (-100, 1, "u", "zero"), (-100, 2, "u", "zero")]
    return rows


@pytest.mark.parametrize("kw", [{}, {"least": 4, "most": 12}, {"least": 1, "most": 1}])
def test_trie_equals_brute_force(spark, kw):
    rows = _talks()
    assert _nodes(spark, rows, **kw) == _trie(rows)


def test_trie_of_repeats_ties_and_no_rows(spark):
    assert _nodes(spark, [(None, 1, "u", "x")]) == []
    # repeated rows are turns each; equal turn numbers are ordered alike wherever they stand
    rows = [(c, 1, "u", x) for c in (0, 100, 200) for x in ("b", "a", "a")]
    got = _nodes(spark, rows)
    assert [(r[1], r[3]) for r in got if r[3] > 1][:1] == [(0, 3)] and {r[1] for r in got} == {0, 1, 2, 3}
    only = _nodes(spark, [(6, 1, "u", "x")])
    assert only == _trie([(6, 1, "u", "x")])


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=5), min_size=1, max_size=12, unique_by=tuple))
def test_build_gives_the_totals_of_a_trie(sequences):
    cell = lambda k: bytes([k]) * prefix_trie.DIGEST + (k + 1).to_bytes(8, "big")
    rows = [(b"".join(map(cell, s)), 10 + i, 1 + i % 3, f"e{i}") for i, s in enumerate(sequences)]
    out = {(r[0], r[1]): r for r in prefix_trie.build(rows, 0)}
    prefixes = {tuple(s[:d]) for s in sequences for d in range(len(s) + 1)}
    assert len(out) == len(prefixes)
    for p in prefixes:
        under = [(i, s) for i, s in enumerate(sequences) if tuple(s[: len(p)]) == p]
        r = out[(min(10 + i for i, _ in under), len(p))]
        below = [q for q in prefixes if q[: len(p)] == p]
        weight = lambda q: sum(1 + i % 3 for i, s in enumerate(sequences) if tuple(s[: len(q)]) == q)
        assert r[3] == weight(p) and r[4] == len({q[: len(p) + 1] for q in below if len(q) > len(p)})
        assert r[5] == sum(not any(o[: len(q)] == q and len(o) > len(q) for o in prefixes) for q in below)
        assert r[6] == sum((weight(q) - 1) * (q[-1] + 1) for q in below if q)


# dual-tree clustering


def _points(kind, n, rng):
    if kind == "spread":
        return rng.integers(-80, 80, (n, 8))
    if kind == "clustered":
        return rng.integers(-900, 900, (6, 8))[rng.integers(0, 6, n)] + rng.integers(-9, 9, (n, 8))
    if kind == "copies":
        return rng.integers(-2, 2, (3, 8))[rng.integers(0, 3, n)]
    return rng.integers(-(2**62), 2**62, (n, 8))  # huge


@pytest.mark.parametrize("kind", ["spread", "clustered", "copies", "huge"])
@pytest.mark.parametrize("n, k", [(1, 1), (7, 3), (600, 16)])
def test_dual_tree_assigns_as_brute_force(kind, n, k):
    rng = np.random.default_rng(n)
    x = _points(kind, n, rng).astype(np.int64)
    centroids = x[rng.integers(0, n, k)].copy()
    tree = dual_tree.cover_tree(x)
    # the tree covers: every node's points lie within its radius, children partition it
    for i in range(len(tree.centre)):
        own = tree.points[tree.start[i] : tree.end[i]].astype(np.float64)
        assert (np.linalg.norm(own - tree.points[tree.centre[i]], axis=1) <= tree.radius[i] * (1 + 1e-9) + 1e-6).all()
        if tree.first[i] < tree.last[i]:
            kids = range(tree.first[i], tree.last[i])
            assert [tree.start[i], *(tree.end[j] for j in kids)] == [*(tree.start[j] for j in kids), tree.end[i]]
    own, met, _ = dual_tree.assign(tree, centroids, dual_tree.cover_tree(centroids, leaf=1))
    d = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, c, strict=True)) for c in centroids] for p in tree.points]
    assert own.tolist() == [min(range(k), key=lambda c: (row[c], c)) for row in d]
    if kind in ("clustered", "copies") and n == 600:
        assert met < n * k / 2  # pruned


def _lloyd(vectors, k, rounds, dims):
    kept = [(i, [int(np.floor(64.0 * v)) for v in x]) for i, x in vectors if x is not None and len(x) == dims and all(v is not None and np.isfinite(v) for v in x)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [x for _, x in order[:k]]
    away = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    nearest = lambda x: min(range(len(centroids)), key=lambda c: (away(x, centroids[c]), c))
    for _ in range(rounds):
        own = [nearest(x) for _, x in kept]
        for c in range(len(centroids)):
            mine = [x for (_, x), o in zip(kept, own, strict=True) if o == c]
            if mine:
                centroids[c] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    rows = [(i, c, away(x, centroids[c])) for i, x in kept for c in [nearest(x)]]
    total = sum(r[2] for r in rows)
    return sorted(repr((i, c, d, sum(r[2] for r in rows if r[1] == c), total, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest())) for i, c, d in rows)


@pytest.mark.parametrize("n", [0, 5, 300])
def test_lloyd_equals_brute_force(spark, n):
    rng = np.random.default_rng(n)
    vectors = [(i, [float(v) for v in rng.normal(size=4) + 3 * (i % 3)]) for i in range(n)]
    if n:
        vectors += [(900, None), (901, [1.0, None, 0.0, 0.0]), (902, [float("nan"), 0.0, 0.0, 0.0]), (903, [float("inf")] * 4), (904, [1.0]), (905, []), (None, [0.5] * 4), (1, [0.25] * 4), (1, [0.25] * 4)]
        vectors += [(1000 + i, [2.0, 2.0, 2.0, 2.0]) for i in range(n)]  # half of all vectors are one
    df = spark.createDataFrame([(i, x, 1, 2) for i, x in vectors], "vec_id long, embedding array<double>, x int, cluster int").repartition(3)
    got = dual_tree.lloyd(df, dims=4)
    assert sorted(repr(tuple(r)) for r in got.collect()) == _lloyd(vectors, 16, 3, 4)


def test_lloyd_of_clusters_measures_few_pairs(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(16, 8)) * 30
    df = spark.createDataFrame([(i, [float(v) for v in centres[i % 16] + rng.normal(size=8) * 0.1]) for i in range(2000)], "vec_id long, embedding array<double>")
    job = dual_tree.Lloyd(df, dims=8)
    job.round()
    assert job.met < 2000 * 16 / 4
