"""Closed forms of the theta number, its representation, enclosing balls and sample counts."""

from collections import Counter
from itertools import combinations
from math import comb, sqrt

import numpy as np
import pytest

from graphloom.operators import lovasz as lo

CYCLE = lambda n: np.array([(i, (i + 1) % n) for i in range(n)])
COMPLETE = lambda n: np.array([(i, j) for i in range(n) for j in range(i)])
NONE = np.zeros((0, 2), int)


@pytest.mark.parametrize("n, edges, want", [(1, NONE, 1), (4, COMPLETE(4), 1), (4, NONE, 4), (5, CYCLE(5), sqrt(5)), (7, CYCLE(7), 7 * np.cos(np.pi / 7) / (1 + np.cos(np.pi / 7))), (6, CYCLE(6), 3), (9, np.array([(0, i) for i in range(1, 9)]), 8)])
def test_theta_and_representation(n, edges, want):
    theta, z = lo.theta_number(n, edges)
    assert theta == pytest.approx(want, abs=1e-4)
    if n > 1:
        assert lo.is_semidefinite(z, 1e-6)
        u = lo.representation(theta, z, 20)
        assert u.shape == (n, 20) and np.allclose((u * u).sum(axis=1), 1)
        assert lo.cone(u) <= theta + 1e-3
        g = u @ u.T
        g[tuple(edges.T)] = g[tuple(edges.T[::-1])] = 0
        assert np.abs(g - np.diag(np.diag(g))).max() < 1e-4


def test_enclosing_balls():
    columns = np.array([(1, 2, 3, 4), (1, 3, 3, 4), (4, 4, 4, 4)], float)
    c, r = lo.ball_through(columns)
    assert np.allclose(np.linalg.norm(columns - c, axis=1), r)
    rng = np.random.default_rng(1)
    for n, d in ((1, 3), (2, 3), (30, 2), (12, 6), (4, 9)):
        p = rng.normal(size=(n, d))
        c, r = lo.enclosing_ball(np.vstack([p, p[:1]]))
        assert (np.linalg.norm(p - c, axis=1) <= r + 1e-8).all()
        near = lambda x: np.linalg.norm(p - x, axis=1).max()  # noqa: B023, E731
        assert all(near(c + e) >= r - 1e-8 for e in rng.normal(size=(200, d)) * 0.05)


def test_sample_counts_and_features():
    assert lo.sample_counts(range(2, 5), 4, 12) == {2: 6, 3: 4, 4: 2}
    assert lo.sample_counts(range(2, 5), 1, 12) == {}
    u = lo.representation(*lo.theta_number(5, CYCLE(5)))
    out = lo.cone_features(u, range(1, 7), 31, "7")
    assert out[0] == pytest.approx(1) and out[5] == 0 and out == lo.cone_features(u, range(1, 7), 31, "7")
    assert out[4] == pytest.approx(lo.cone(u))


def test_subsets_by_place():
    for d in range(1, 5):
        every = [lo.unranked(p, d) for p in range(comb(7, d))]
        assert sorted(every) == sorted(map(list, combinations(range(7), d)))
    assert lo.unranked(comb(10**6, 3) - 1, 3) == [10**6 - 3, 10**6 - 2, 10**6 - 1]
    assert sorted(lo.drawn(5, 9, "s")) == list(range(5)) and lo.drawn(5, 0, "s") == [] and lo.drawn(0, 3, "s") == []
    seen = Counter(tuple(sorted(lo.drawn(6, 3, str(i)))) for i in range(20_000))
    assert len(seen) == comb(6, 3) and all(abs(c - 1000) < 160 for c in seen.values())  # five standard deviations


def test_graphs_with_isolated_vertices_loops_and_stray_edges(spark):
    v = spark.createDataFrame([(0, i) for i in range(10, 15)] + [(1, 3), (2, 1), (2, 2), (2, 2), (3, None)], "graph_id long, vertex_id long")
    e = spark.createDataFrame([(0, 10 + i, 10 + (i + 1) % 5) for i in range(5)] + [(1, 3, 3), (2, 1, 9), (4, 1, 2)], "graph_id long, src long, dst long")
    got = {r.graph_id: (r.n, round(r.theta, 4)) for r in lo.theta_numbers(v, e).collect()}
    assert got == {0: (5, 2.2361), 1: (1, 1.0), 2: (2, 2.0)}
    f = {r.graph_id: r.features for r in lo.features(v, e, range(1, 3), 4).collect()}
    assert f[1] == [1.0, 0.0] and f[2] == pytest.approx([1.0, 2.0], abs=1e-4)
    drawn = lo.subsets(v, range(1, 3), 4).collect()
    assert sorted(r.subset for r in drawn if r.graph_id == 2) == [[0], [0, 1], [1]] and {r.graph_id for r in drawn} == {0, 1, 2}
    assert {(r.d, r.samples) for r in lo.subset_counts(v, range(1, 3), 4).where("graph_id = 0").collect()} == {(1, 1), (2, 3)}
    disks = v.where("graph_id = 0").selectExpr("graph_id", "vertex_id % 2 AS root", "vertex_id")
    rings = lo.theta_numbers(disks, e.selectExpr("graph_id", "src % 2 AS root", "src", "dst"), keys=("graph_id", "root"))
    assert {(r.root, r.n, round(r.theta, 4)) for r in rings.collect()} == {(0, 3, 2.0), (1, 2, 2.0)}
    assert lo.theta_numbers(v.limit(0), e.limit(0)).count() == 0


def test_a_shape_is_solved_once_whatever_its_ids():
    rng = np.random.default_rng(3)
    for edges in (np.array([(i, i + 1) for i in range(8)]), np.array([(0, 1), (1, 2), (2, 3), (1, 4), (4, 5), (5, 6)])):
        n = edges.max() + 1
        forms = set()
        for _ in range(20):
            p = rng.permutation(n)
            form, number = lo.shape(n, p[edges])
            assert sorted(number) == list(range(n))
            own = np.sort(np.array(number)[p[edges]], axis=1)
            assert sorted(map(tuple, own.tolist())) == list(map(tuple, np.frombuffer(form, np.int64).reshape(-1, 2).tolist()))
            forms.add(form)
        assert len(forms) == 1


def test_memory_forgets_the_oldest():
    m, made = lo.Memory(3), []
    for k in (1, 2, 3, 1, 4, 1, 2):
        m.get(k, lambda k=k: made.append(k) or k)
    assert made == [1, 2, 3, 4, 2] and m.size == 3


def test_parts_have_the_whole_graphs_values(spark):
    """Sums over parts are what the whole graph's representation gives, without a shuffle once graphs are settled."""
    from graphloom.operators import graphs as gr
    from graphloom.operators import packed

    half = [(0, 1), (1, 2), (2, 3), (3, 4), (4, 0), (6, 5), (5, 7), (9, 8)]
    ids = [3, 11, 40, 2, 7, 90, 5, 6, 70, 1, 33]
    v = spark.createDataFrame([(g, i, 0) for g in (4, 5) for i in ids], "graph_id long, vertex_id long, label int")
    e = spark.createDataFrame([(g, ids[a], ids[b]) for g in (4, 5) for a, b in half], "graph_id long, src long, dst long")
    place = {x: i for i, x in enumerate(sorted(ids))}
    theta, z = lo.theta_number(len(ids), np.array([(place[ids[a]], place[ids[b]]) for a, b in half]))
    u = lo.representation(theta, z)
    plain = gr.Graphs(v, gr.symmetric(e), v.select("graph_id", v.label.alias("y")).distinct())
    for limit in (1024, 3):
        before, packed.LIMIT = packed.LIMIT, limit
        g = gr.settled(plain)
        packed.LIMIT = before
        rows = lo.graph_lists(g)
        for r in lo.cones(rows, range(1, 5), 40, 7).collect():
            assert r.n == 11 and r.features == pytest.approx(lo.cone_features(u, range(1, 5), 40, f"7:{r.graph_id}"), abs=1e-6)
        assert [r.theta for r in lo.thetas(rows).collect()] == pytest.approx([theta] * 2, abs=1e-6)
        got = {(r.graph_id, r.root): (r.ids, len(r.ends)) for r in lo.neighbour_lists(g).collect()}
        assert got == {(4, 1): ([1, 70], 1), (5, 1): ([1, 70], 1)}
        assert [r.ids for r in lo.neighbour_lists(g, ring=True).collect()] == [[70], [70]]
        if limit == 1024:
            assert all("Exchange" not in x._jdf.queryExecution().executedPlan().toString() for x in (rows, lo.neighbour_lists(g)))
