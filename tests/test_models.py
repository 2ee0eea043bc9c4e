"""Gradients, training, clusters of reachability plots and the experiment driver, against brute force and closed forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom import configs
from graphloom.operators import clustering as cl
from graphloom.operators import enhance, models, pipelines
from graphloom.operators import experiments as ex
from graphloom.operators import graphs as gr


@pytest.mark.parametrize("model", ["gin", "gcn"])
def test_gradients_equal_differences(model):
    rng = np.random.default_rng(1)
    graphs = [(rng.normal(size=(n, 3)), rng.integers(0, 2, n), np.array([(i, (i + 1) % n) for i in range(n)] + [((i + 1) % n, i) for i in range(n)])) for n in (4, 5, 3)]
    batch, y = models.batch_of(graphs, model), np.array([0, 1, 1])
    net = models.Net(model, 3, 4, 2, 2, 2, 5)
    before = {k: v.copy() for k, v in net.p.items()}
    net.step(batch, y, 1e-3)
    first = {k: m / 0.1 for k, m in net.m.items()}  # the first moment after one step is a tenth of the gradient
    net.p = before
    for key, g in first.items():
        at = tuple(int(rng.integers(0, n)) for n in g.shape)
        losses = []
        for d in (1e-5, -1e-5):
            net.p = {k: v.copy() for k, v in before.items()}
            net.p[key][at] += d
            losses.append(models.cross_entropy(net.run(batch)[0], y)[0])
        assert g[at] == pytest.approx((losses[0] - losses[1]) / 2e-5, abs=1e-5)


def test_training_learns_and_stops(spark):
    # stars against cycles: a sum over neighbours tells them apart
    half = [(g, 0 if g % 2 else i, i + 1 if g % 2 else (i + 1) % 5) for g in range(24) for i in range(5 if not g % 2 else 4)]
    e = gr.symmetric(spark.createDataFrame(half, "graph_id long, src long, dst long"))
    v = spark.range(24).select(F.col("id").alias("graph_id"), F.explode(F.expr("sequence(0L, 4L)")).alias("vertex_id")).withColumn("label", F.lit(0))
    g = gr.Graphs(v, e, spark.range(24).select(F.col("id").alias("graph_id"), (F.col("id") % 2).cast("int").alias("y")))
    s = pipelines.Settings(folds=2, epochs=[300], patience=300, channels=[16], lr=[0.01], batch=[16])
    best, _ = pipelines.run(g, "classical", 1, s)
    assert best.first().val_mean > 0.9
    short = pipelines.classical(g, 1, pipelines.Settings(folds=2, epochs=[40], patience=1, lr=[0.0], batch=[8]))
    assert {r.n for r in short.groupBy("fold").agg(F.count("*").alias("n")).collect()} == {2}  # nothing improves after the first epoch


def test_forward_equals_numpy(spark):
    g = pipelines.toy_graphs(spark)
    h = g.vertices.select("graph_id", "vertex_id", F.array((F.col("vertex_id") % 2).cast("double"), F.lit(1.0)).alias("h"))
    w, b = [[0.5, -1.0], [1.0, 0.25]], [0.0, 0.5]
    for model, layer in (("gin", ((w, b), (w, b))), ("gcn", w)):
        got = {r.graph_id: r.pools for r in models.forward(h, g.edges, [layer], model).collect()}
        for i, edges in enumerate(pipelines.TOY):
            n = 1 + max(max(e) for e in edges)
            x = np.array([[j % 2, 1.0] for j in range(n)])
            both = np.array([p for a, c in edges for p in ((a, c), (c, a))])
            _, a, _, _, _ = models.batch_of([(x, np.zeros(n, int), both)], model)
            m = np.array(w)
            out = np.maximum((np.maximum(a @ x @ m.T + b, 0)) @ m.T + b, 0) if model == "gin" else np.maximum(a @ (x @ m.T), 0)
            assert got[i] == pytest.approx(out.sum(0).tolist())


def test_steep_clusters_find_the_valleys():
    r = np.array([np.inf, 0.1, 0.1, 0.1, 0.1, 5.0, 0.2, 0.2, 0.2, 0.2, np.inf])
    found = cl.steep_clusters(r, 3, 0.05)
    assert (0, 4) in found and (5, 9) in found and (0, 9) in found
    assert cl.steep_clusters(np.array([np.inf, 1.0, 1.0, np.inf]), 3, 0.05) == {(0, 2)}


def test_clusters_end_at_points_reached_from_within():
    shorter = 0
    for seed in range(40):
        rng = np.random.default_rng(seed)
        r = np.concatenate([[np.inf], rng.choice([0.1, 0.2, 0.5, 1.0, np.inf], 40), [np.inf]])
        before = np.array([-1 if np.isinf(r[i]) else int(rng.integers(0, i)) for i in range(41)])  # nothing reaches some points
        plain, found = cl.steep_clusters(r, 3, 0.05), cl.steep_clusters(r, 3, 0.05, before)
        assert all(r[s] > r[e] or s <= before[e] < e for s, e in found)
        assert all(e - s >= 2 and any(s == a and e <= b for a, b in plain) for s, e in found)
        within = {(s, e) for s, e in plain if r[s] > r[e] or before[e] >= s}
        assert within <= found
        shorter += len(plain - found)
        assert cl.steep_clusters(r, 3, 0.05, np.arange(-1, 40)) == plain  # each reached from the one before
    assert shorter
    r = np.array([np.inf, 0.1, 0.1, 0.1, 0.1, np.inf, np.inf, np.inf])
    assert cl.steep_clusters(r, 3, 0.05, np.array([-1, 0, 1, 2, 3, -1, -1])) == {(0, 4)}


def test_reachability_equals_the_definition(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.1, (12, 2)), rng.normal(5, 0.1, (12, 2))])
    v = spark.createDataFrame([(i, [float(a) for a in p]) for i, p in enumerate(x)], "id long, x array<double>")
    order = cl.optics_order(v, 4).toPandas().sort_values("ordering")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.sort(d, 1)[:, 3]
    done = []
    for row in order.itertuples():
        want = min((max(core[p], d[p, row.id]) for p in done), default=np.inf)
        assert row.reachability == pytest.approx(want) and row.core == pytest.approx(core[row.id])
        source = done[row.before] if row.before >= 0 else None  # places are in the order of the rows
        assert (source is None) == (not done) and (source is None or max(core[source], d[source, row.id]) == pytest.approx(want))
        done.append(row.id)
    clusters = cl.optics_clusters(cl.optics_order(v, 4), 4).collect()
    assert {(0, 11), (12, 23)} <= {(r.start, r.end) for r in clusters}


def test_enhancement_handles_missing_and_tied_rows(spark):
    f = spark.createDataFrame([(0, 0, [1.0, 0.0]), (0, 1, [0.0, 0.0])], "graph_id long, vertex_id long, features array<double>")
    c = spark.createDataFrame([(0, [2.0, 0.0]), (1, [0.0, 0.0])], "cluster_id int, center array<double>")
    v = spark.createDataFrame([(0, 0, 5), (0, 1, 5), (0, 2, 5)], "graph_id long, vertex_id long, label int")
    ids = enhance.cluster_ids(f, c)
    assert {(r.vertex_id, r.cluster_id) for r in enhance.enhanced(v, ids).collect()} == {(0, 0), (1, 1), (2, None)}
    h = v.select("graph_id", "vertex_id", F.array(F.lit(1.0)).alias("h"))
    assert {(r.vertex_id, tuple(r.h)) for r in enhance.augmented(h, ids).collect()} == {(0, (1.0, 0.0)), (1, (1.0, 1.0)), (2, (1.0, -1.0))}


def test_configurations():
    for kind in ("experiment", "feature_gen"):
        assert configs.problems(configs.example(kind)) == []
    assert configs.problems({}) == ["type"]
    assert "prev_result_path" in configs.problems(configs.example("experiment") | {"mode": "clustering"})
    with pytest.raises(ValueError):
        configs.checked(configs.example("feature_gen") | {"general": {"seed": "x"}})


def test_ranks_need_no_big_sort(spark):
    rows = spark.range(500).select(F.col("id").alias("graph_id"), (F.col("id") % 3).alias("y")).withColumn("place", F.md5(F.col("graph_id").cast("string")))
    got = ex.ranked(rows, ["y"], "place", "graph_id").toPandas()
    want = rows.toPandas().sort_values(["y", "place"])
    want["rn"] = want.groupby("y").cumcount()
    both = got.merge(want, on="graph_id", suffixes=("", "_w"))
    assert (both["rn"] == both["rn_w"]).all() and set(got["n"]) == {166, 167}
