"""Golden outputs, closed forms and laws of the graph operators, on toy graphs with the degenerate cases."""

from itertools import combinations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom import queries
from graphloom.operators import clustering as cl
from graphloom.operators import experiments as ex
from graphloom.operators import features as ft
from graphloom.operators import graphs as gr
from graphloom.operators import learning as le
from graphloom.operators import paths as pa
from graphloom.plans import running
from graphloom.sources import files

HALF = [(0, 0, 1), (0, 0, 2), (0, 2, 3), (0, 2, 4), (1, 0, 1), (1, 0, 2), (1, 0, 3), (1, 1, 2)]


def graphs(spark, half, vertices, labels=None):
    v = spark.createDataFrame([(g, i, (labels or {}).get((g, i), 0)) for g, i in vertices], "graph_id long, vertex_id long, label int")
    e = gr.symmetric(spark.createDataFrame(half, "graph_id long, src long, dst long"))
    return gr.Graphs(v, e, v.select("graph_id").distinct().withColumn("y", F.col("graph_id").cast("int")))


@pytest.fixture(scope="module")
def toy(spark):
    return graphs(spark, HALF, [(0, i) for i in range(5)] + [(1, i) for i in range(4)])


def test_vertex_histograms_match_the_golden_rows(toy):
    # columns: other vertices at distance 0, 1, 2, 3, 4 (fixed values)
    golden = {
        (0, 0): (0, 2, 2, 0, 0), (0, 1): (0, 1, 1, 2, 0), (0, 2): (0, 3, 1, 0, 0), (0, 3): (0, 1, 2, 1, 0), (0, 4): (0, 1, 2, 1, 0),
        (1, 0): (0, 3, 0, 0, 0), (1, 1): (0, 2, 1, 0, 0), (1, 2): (0, 2, 1, 0, 0), (1, 3): (0, 1, 2, 0, 0),
    }
    long = ft.vertex_counts(toy, pa.graph_distances(toy, None))
    rows = ft.dense(long, ["graph_id", "vertex_id"], F.col("d"), 5).collect()
    assert {(r.graph_id, r.vertex_id): tuple(map(int, r.features)) for r in rows} == golden


def test_degenerate_graphs(spark):
    g = graphs(spark, [(0, 1, 2), (0, 3, 3)], [(0, 1), (0, 2), (0, 3), (1, 7)])
    assert g.edges.count() == 2  # the self-loop went
    d = pa.graph_distances(g, None)
    assert d.count() == 6
    assert {(r.graph_id, r.connected, r.diameter) for r in pa.diameters(g, d).collect()} == {(0, False, None), (1, True, 0)}
    counts = {(r.vertex_id, r.d): r.cnt for r in ft.vertex_counts(g, d).collect()}
    assert counts == {(1, 1): 1, (1, -1): 1, (2, 1): 1, (2, -1): 1, (3, -1): 2}
    assert pa.ring(d, 1, 2).where("root = 3").isEmpty()
    assert gr.degrees(g).where("degree = 0").count() == 2


def test_disk_and_ring_laws(toy):
    d2 = pa.graph_distances(toy, 2)
    assert pa.ring(d2, 0, 2).exceptAll(pa.ring(d2, 0, 1)).exceptAll(pa.ring(d2, 2, 2)).isEmpty()
    pairs = ft.disk_sp(toy, 1).groupBy("graph_id", "root").agg(F.sum("cnt").alias("n"))
    sizes = pa.graph_distances(toy, 1).groupBy("graph_id", "root").agg(F.count("*").alias("m"))
    assert pairs.join(sizes, ["graph_id", "root"]).where("n <> m * (m - 1) / 2").isEmpty()


def test_skip_link_graphs_have_one_colour(spark):
    g = gr.circular_skip_links(spark, 11, (2, 3))
    assert gr.degrees(g).select("degree").distinct().collect()[0].degree == 4
    assert ft.wl1(g, 2).where("round = 2").select("colour").distinct().count() == 1


def test_pair_colours_tell_an_edge(spark):
    with_edge, without = graphs(spark, [(0, 0, 1)], [(0, 0), (0, 1)]), graphs(spark, [(9, 0, 1)], [(0, 0), (0, 1)])
    a, b = ({(r.colour, r.n) for r in ft.wl2(x, 1, 2).groupBy("colour").agg(F.count("*").alias("n")).collect()} for x in (with_edge, without))
    assert a != b


def test_offsets_and_indices(toy):
    assert {(r.graph_id, r["size"], r.start) for r in gr.offsets(toy, 2).collect()} == {(0, 5, 0), (1, 4, 5)}
    assert sorted(r.dataset_idx for r in gr.dataset_index(toy).collect()) == list(range(9))


def test_split_laws(spark):
    g = spark.range(103).select(F.col("id").alias("graph_id"), (F.col("id") % 4).cast("int").alias("y"))
    for s in (None, "y"):
        rows = ex.kfold(g, 5, stratify=s).collect()
        test = {f: {r.graph_id for r in rows if r.fold == f and r.role == "test"} for f in range(5)}
        val = [r.graph_id for r in rows if r.role == "val"]
        assert len({frozenset(t) for t in test.values()}) == 1 and len(val) == len(set(val)) == 103 - len(test[0])


def test_choices(spark):
    assert ex.best(spark.createDataFrame([(0, 0.0), (1, 0.0)], "experiment_idx int, acc double"), "acc").isEmpty()
    assert ex.best(spark.createDataFrame([(0, 0.1), (2, 0.5), (1, 0.5)], "experiment_idx int, acc double"), "acc").first().experiment_idx == 1
    runs = spark.createDataFrame([(0, e, x) for e, x in enumerate([3.0, 2.0, 2.0, 2.5, 1.0])], "k int, epoch int, val_loss double")
    assert ex.early_stop(runs, ["k"], 2).first().asDict() == {"k": 0, "last_epoch": 3, "best_epoch": 1, "best_loss": 2.0}
    auc = ex.roc_auc(spark.createDataFrame([(0.1, 0), (0.4, 1), (0.4, 0), (0.9, 1)], "score double, y int")).first().auc
    assert auc == pytest.approx(0.875)


def test_clusters(spark):
    v = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [10.0, 0.0]), (3, [5.5, 0.0])], "id long, x array<double>")
    c = spark.createDataFrame([(0, [0.0, 0.0]), (1, [11.0, 0.0]), (2, [99.0, 0.0])], "cluster_id int, center array<double>")
    assert {r.id: r.cluster_id for r in cl.assigned(v, c).collect()} == {0: 0, 1: 0, 2: 1, 3: 0}  # a tie goes to the lower id
    assert {r.cluster_id for r in cl.merged(v, c, 1).collect()} == {0, 1}
    assert cl.normalised(v).where("id = 0").first().x == [0.0, 0.0]
    assert cl.optics_order(v, 2).count() == 4
    assert cl.clique(v, 2, 0.4).where("size = 1").count() >= 2


def test_messages(toy):
    h = toy.vertices.select("graph_id", "vertex_id", F.array(F.lit(1.0)).alias("h"))
    assert {(r.graph_id, r.vertex_id): r.h[0] for r in le.gin_sum(h, toy.edges).collect()}[(0, 2)] == 4.0
    assert {r.graph_id: r.h[0] for r in le.pooled(h).collect()} == {0: 5.0, 1: 4.0}


def test_files(spark, tmp_path):
    v = spark.createDataFrame([(0, 3, [0.0, 1.5, 0.0]), (2, 0, [0.0, 0.0, 0.0])], "graph_id long, vertex_id long, features array<double>")
    files.write_svmlight(v, str(tmp_path / "f"))
    assert sorted(files.read_svmlight(spark, str(tmp_path / "f"), 3).collect()) == sorted(v.collect())
    m = spark.createDataFrame([([1.0, -2.5],)], "x array<double>")
    files.write_matrix(m, str(tmp_path / "m"))
    assert files.read_matrix(spark, str(tmp_path / "m")).collect() == m.collect()


def test_clarans_searches_until_enough_proposals_fail(spark):
    rows = [(i, [float(100 * (i % 6)), float(i // 6) / 50]) for i in range(120)]
    v = spark.createDataFrame(rows, "id long, x array<double>")
    medoids = cl.clarans(v, 6, 12).collect()  # 12 proposals in all leave a group out
    assert sorted(round(r.center[0] / 100) for r in medoids) == list(range(6))
    few = spark.createDataFrame(rows[:3], "id long, x array<double>")
    assert len(cl.clarans(few, 3, 5).collect()) == 3
    assert cl.clarans(v.limit(0), 3, 5).count() == 0
    assert len(cl.clarans(spark.createDataFrame(rows[:1] * 4, "id long, x array<double>"), 2, 3).collect()) == 2


def test_medoid_table_keeps_the_two_nearest_across_swaps(spark):
    rng = np.random.default_rng(5)
    points = rng.integers(0, 6, (150, 2)).astype(float)  # many ties and repeated points
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(points)], "id long, x array<double>")
    table = cl.MedoidTable(v, {m: points[m].tolist() for m in range(5)})
    for step in range(7):
        out, new = int(rng.integers(5)), points[rng.integers(150)].tolist()
        before, [delta] = table.cost, table.deltas([(out, new)])
        table.swap(out, new)
        fresh = cl.two_nearest(v, spark.createDataFrame(list(table.medoids.items()), "cluster_id int, center array<double>"))
        columns = ["id", "m1", "d1", "m2", "d2"]
        assert sorted(table.near.select(columns).collect()) == sorted(fresh.select(columns).collect()), step
        assert table.cost == pytest.approx(before + delta)
    single = cl.MedoidTable(v, {0: points[0].tolist()})
    single.swap(0, points[1].tolist())
    assert single.cost == pytest.approx(np.linalg.norm(points - points[1], axis=1).sum())


def test_class_representatives_with_equal_vectors(spark):
    v = spark.createDataFrame([(1, 5, [1.0, 0.0]), (1, 6, [2.0, 2.0]), (2, 1, [1.0, 0.0]), (3, 1, [1.0, 1.0]), (4, 1, [1.0, 0.0]), (9, 1, [1.0, 1.0])], "graph_id long, vertex_id long, features array<double>")
    y = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (4, 3), (9, 0)], "graph_id long, y int")
    got = {tuple(r) for r in ft.equal_representatives(v, y).collect()}
    assert got == {(0, 1, 1, 2), (0, 1, 3, 4), (1, 2, 3, 4)}


def test_clique_query_goes_on_past_two_dimensions(spark, monkeypatch):
    rows = [(i, [0.1, 0.1, 0.1] if i % 10 else [1.0, 1.0, 1.0]) for i in range(40)]
    monkeypatch.setattr(queries, "vectors", lambda *_: spark.createDataFrame(rows, "id long, x array<double>"))
    assert {r["size"] for r in queries.clique_clusters(spark, "").collect()} == {1, 2, 3}


def test_colour_alphabet_is_shared_and_dense(spark):
    colours = [f"{(i * 2654435761) % 2**32:08x}" for i in range(300)]
    rows = [(g, r, c, 1 + (g + i) % 3) for g in range(4) for r in range(2) for i, c in enumerate(colours) if (i + g + r) % 3]
    counts = spark.createDataFrame(rows, "graph_id long, round int, colour string, cnt long")
    alphabet = ft.colour_alphabet(counts)
    want = {(r, c): i for r in range(2) for i, c in enumerate(sorted({c for _, q, c, _ in rows if q == r}))}
    assert {(a.round, a.colour): a.slot for a in alphabet.collect()} == want
    vectors = ft.dense_counts(ft.colour_slots(counts, alphabet), len(colours)).collect()
    assert len(vectors) == 8 and all(sum(v.features) == sum(n for g, r, _, n in rows if (g, r) == (v.graph_id, v.round)) for v in vectors)
    late = spark.createDataFrame([(9, 0, colours[1], 2), (9, 0, "zz", 5), (8, 0, "zz", 1)], counts.schema)
    [new] = ft.colour_slots(late, alphabet).collect()
    assert (new.graph_id, new.slots, new.counts) == (9, [want[0, colours[1]]], [2])
    assert ft.colour_alphabet(counts.limit(0)).count() == 0


def test_running_sums_over_ranges(spark):
    rng = np.random.default_rng(2)
    rows = [(int(o), int(x)) for o, x in zip(rng.permutation(500), rng.integers(0, 9, 500), strict=True)]
    got = {r.o: r.s for r in running(spark.createDataFrame(rows, "o long, x long").repartition(3), "o", "x", "s").collect()}
    total = 0
    for o, x in sorted(rows):
        assert got[o] == total
        total += x
    assert running(spark.createDataFrame([], "o long, x long"), "o", "x", "s").count() == 0


def test_units_hold_what_brute_force_counts(spark, monkeypatch):
    """Points of units of two and three dimensions are counted by bits: no row for each pair of a point and a unit is shuffled."""
    rng = np.random.default_rng(3)
    cells = [(i, f, int(rng.integers(0, 2))) for i in range(150) for f in range(4) if (i + f) % 7]
    b, least = spark.createDataFrame(cells, "id long, f int, bin int").localCheckpoint(), 12
    monkeypatch.setattr(cl, "UNITS", 5)
    has = {}
    for i, f, x in cells:
        has.setdefault(i, set()).add((f, x))
    units = cl.dense_units(b, least)
    for size in (2, 3):
        units = cl.next_units(b, units, size, least).localCheckpoint()
        got = {tuple(tuple(x) for x in r.unit): r.cnt for r in units.collect()}
        every = [tuple(zip(fs, xs)) for fs in combinations(range(4), size) for xs in product(range(2), repeat=size)]
        want = {u: sum(set(u) <= own for own in has.values()) for u in every}
        assert got == {u: n for u, n in want.items() if n > least} and got
    assert "Join" not in cl.next_units(b, cl.dense_units(b, least), 2, least)._jdf.queryExecution().executedPlan().toString()


def test_many_parts_are_not_sent_to_all_tasks(spark):
    """Parts beyond a bound are met by shuffles, whatever the size of their compressed file, and the packed graphs stay the same."""
    from graphloom.sources.driver_tables import customer_graphs

    d = "/root/testdata/sf0.001"
    bounded, free = (customer_graphs(spark, d, sent) for sent in (1, None))
    broadcast = lambda df: df._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin")
    assert broadcast(free.lines) > broadcast(bounded.lines)
    a, b = (sorted(map(repr, gr.settled(g).edges.collect())) for g in (bounded, free))
    assert a == b and a
