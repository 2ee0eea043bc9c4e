"""Batch norm, several tasks, learnt colours and data-parallel steps, against differences, one group, and closed forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom import configs, plans
from graphloom.operators import enhance, models, parallel, pipelines
from graphloom.operators import experiments as ex
from graphloom.operators import graphs as gr


def _cycle(rng, n, clusters=2):
    pairs = [(i, (i + 1) % n) for i in range(n)] + [((i + 1) % n, i) for i in range(n)]
    return rng.normal(size=(n, 3)), rng.integers(0, clusters, n), np.array(pairs)


@pytest.mark.parametrize("norm, colours, tasks", [(True, None, False), (False, (2, 3), False), (True, (1, 4), True), (False, None, True)])
@pytest.mark.parametrize("model", ["gin", "gcn"])
def test_gradients_equal_differences(model, norm, colours, tasks):
    rng = np.random.default_rng(2)
    batch = models.batch_of([_cycle(rng, n) for n in (4, 5, 3)], model)
    y = np.array([[1, np.nan], [0, 1], [np.nan, np.nan]]) if tasks else np.array([0, 1, 1])
    net = models.Net(model, 3, 4, 2, 2, 2, 5, norm, colours)
    for k in net.p:
        net.p[k] = net.p[k] + rng.normal(size=net.p[k].shape) * 0.2
    loss, weight, into, stats = net.gradients(batch, y)
    assert set(into) == set(net.p) and weight == (3 if not tasks else 3) and (stats is None) == (not norm)
    for key, g in into.items():
        for at in [tuple(int(rng.integers(0, n)) for n in g.shape) for _ in range(3)]:
            losses = []
            for d in (1e-6, -1e-6):
                net.p[key][at] += d
                losses.append(models.loss_of(net.run(batch, training=True)[0], y)[0])
                net.p[key][at] -= d
            assert g[at] == pytest.approx((losses[0] - losses[1]) / 2e-6, abs=2e-4, rel=1e-4), key


def test_batch_norm_keeps_running_statistics():
    rng = np.random.default_rng(0)
    batch = models.batch_of([_cycle(rng, 6), _cycle(rng, 5)], "gin")
    net = models.Net("gin", 3, 4, 1, 2, 2, 5, norm=True)
    _, _, _, (n, mean, var) = net.gradients(batch, np.array([0, 1]))
    net.step(batch, np.array([0, 1]), 0.0)
    assert n == 11 and net.mean[0] == pytest.approx(0.1 * mean[0]) and net.var[0] == pytest.approx(0.9 + 0.1 * var[0])
    for _ in range(400):
        net.step(batch, np.array([0, 1]), 0.0)
    # with settled statistics (up to the n / (n - 1) of variances) a later run gives what training gave
    net.var = net.var * 10 / 11
    assert net.run(batch)[0] == pytest.approx(net.run(batch, training=True)[0], rel=1e-6)


def test_learnt_colours_start_as_the_relational_form(spark):
    g = pipelines.toy_graphs(spark)
    v = g.vertices.withColumn("cluster_id", (F.col("vertex_id") % 2).cast("int"))
    net = models.Net("gin", 1, 4, 1, 2, 2, 1, colours=(2, 3))
    net.p["alpha"] = np.array([[0.5, -1.0], [2.0, 0.25]])
    gamma, alpha = {c: net.p["gamma"][c].tolist() for c in (0, 1)}, {(a, b): float(net.p["alpha"][b, a]) for a in (0, 1) for b in (0, 1)}
    g.vertices = v
    want = {(r.graph_id, r.vertex_id): r.h for r in models.vertex_edge_states(g, gamma, alpha, 2).collect()}
    for i, edges in enumerate(pipelines.TOY):
        n = 1 + max(max(e) for e in edges)
        both = np.array([p for a, c in edges for p in ((a, c), (c, a))])
        _, a, of, _, _ = models.batch_of([(np.zeros((n, 1)), np.arange(n) % 2, both)], "gin")
        h, _ = net._coloured(a, of, a.edges)
        for j in range(n):
            assert h[j] == pytest.approx(want[(i, j)])


def test_several_tasks_with_missing_labels(spark):
    z, y = np.array([[0.5, -2.0], [30.0, 0.0], [-1.0, 4.0]]), np.array([[1, np.nan], [0, 1], [np.nan, np.nan]])
    loss, n, grad = models.loss_of(z, y)
    p = 1 / (1 + np.exp(-z))
    cells = [-np.log(p[0, 0]), 30.0, -np.log(p[1, 1])]
    assert n == 3 and loss == pytest.approx(sum(cells)) and (grad[2] == 0).all() and grad[0, 1] == 0 and grad[1, 1] == pytest.approx(p[1, 1] - 1)
    rows = spark.createDataFrame([([float(v) for v in a], [None if np.isnan(v) else float(v) for v in b]) for a, b in zip(z, y)], "logits array<double>, y array<double>")
    r = models.multi_task_loss(rows).first()
    assert r.loss == pytest.approx(loss / 3) and r.n_labelled == 3
    assert models.multi_task_loss(rows.limit(0)).first().n_labelled == 0
    assert models.areas(np.array([[0.1], [0.4], [0.4], [0.8]]), np.array([[0], [0], [1], [1]])) == pytest.approx(0.875)
    assert np.isnan(models.areas(z, np.full((3, 2), np.nan)))


def _rows(spark, tasks=False):
    rng = np.random.default_rng(4)
    out = []
    for i in range(40):
        x, of, e = _cycle(rng, 3 + i % 4)
        e = e[: len(e) - 2 * (i % 2)] if i % 2 else e
        out.append((i, ([float(i % 2), None if i % 3 else 1.0 - i % 2] if tasks else i % 2), x.tolist(), of.tolist(), e[:, 0].tolist(), e[:, 1].tolist()))
    y = "array<double>" if tasks else "int"
    rows = spark.createDataFrame(out, f"graph_id long, y {y}, x array<array<double>>, of array<int>, src array<long>, dst array<long>").repartition(3)
    splits = spark.range(40).select(F.lit(0).alias("fold"), F.when(F.col("id") % 5 == 0, "val").when(F.col("id") % 5 == 1, "test").otherwise("train").alias("role"), F.col("id").alias("graph_id"))
    return rows, splits


@pytest.mark.parametrize("flat", [16, 1])
@pytest.mark.parametrize("model, colours, tasks", [("gin", None, False), ("gcn", (1, 3), False), ("gin", None, True)])
def test_parallel_steps_equal_one_group(spark, monkeypatch, model, colours, tasks, flat):
    monkeypatch.setattr(plans, "FLAT", flat)
    rows, splits = _rows(spark, tasks)
    grid = ex.grid(spark, layers=[2], channels=[4], batch=[12], epochs=[5], lr=[0.01])
    one = models.train(rows, grid, splits, model, colours=colours).orderBy("epoch").collect()
    many = parallel.train(rows, grid, splits, model, colours=colours, share=9).orderBy("epoch").collect()
    assert len(one) == len(many) == 5
    for a, b in zip(one, many, strict=True):
        assert (a.train_loss, a.val_loss) == pytest.approx((b.train_loss, b.val_loss), abs=1e-6)
        assert tasks or (a.val_acc, a.test_acc) == (b.val_acc, b.test_acc)


def test_parallel_batch_norm_in_one_share_equals_one_group(spark):
    rows, splits = _rows(spark)
    grid = ex.grid(spark, layers=[1], channels=[4], batch=[40], epochs=[3], lr=[0.01])
    one = models.train(rows, grid, splits, norm=True).orderBy("epoch").collect()
    many = parallel.train(rows.coalesce(1), grid, splits, norm=True).orderBy("epoch").collect()
    assert [a.val_loss for a in one] == pytest.approx([b.val_loss for b in many], abs=1e-6)


def test_settings_of_configurations(spark):
    c = configs.example("experiment")
    c["general"]["use_batch_norm"], c["dataset"]["use_gpnn"] = True, True
    s = pipelines.settings_of(configs.checked(c))
    assert s.batch_norm and s.colours == (1, 8) and s.folds == 5 and s.layers == [3]
    assert not pipelines.settings_of(configs.example("experiment")).batch_norm


def test_no_graphs_give_no_logs(spark):
    rows, splits = _rows(spark)
    grid = ex.grid(spark, layers=[1], channels=[4], batch=[40], epochs=[3], lr=[0.01])
    assert parallel.train(rows.limit(0), grid, splits).count() == 0


def test_batches_are_dealt_alike_anywhere():
    ids = np.arange(1000)
    b = models.dealt_batches(ids, 7, 3, 1)
    assert (models.dealt_batches(ids[500:], 7, 3, 1) == b[500:]).all() and (models.dealt_batches(ids, 7, 3, 2) != b).any()
    assert np.bincount(b, minlength=7).min() > 90


def test_runs_keep_their_graphs_packed(spark):
    """A packed graph is the nested one, a task reads a batch's graphs from its file, and no run's shuffle holds nested arrays."""
    rng = np.random.default_rng(4)
    graphs = []
    for i, n in enumerate((1, 3, 5, 2, 4, 6)):
        pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, n, (2 * n, 2)) if a != b})
        graphs.append((i, i % 2, rng.normal(size=(n, 2)).tolist(), rng.integers(0, 3, n).tolist(), [a for a, _ in pairs], [b for _, b in pairs]))
    rows = spark.createDataFrame(graphs, "graph_id long, y int, x array<array<double>>, of array<int>, src array<long>, dst array<long>")
    packed = models.packed_rows(rows).collect()
    data = models.Dataset()
    for r in sorted(packed, key=lambda r: r.graph_id):
        data.add([r.graph_id], [r.y], ["train"], [r.graph])
    data.settle()
    part = np.array([5, 0, 3])
    for j, (x, of, pairs) in zip(part, data.graphs(part), strict=True):
        _, _, h, c, src, dst = graphs[j]
        assert x.tolist() == h and of.tolist() == c and pairs.tolist() == [list(p) for p in zip(src, dst, strict=True)]
    assert data.vertices(np.array([0])) == 1 and data.vertices(part) > 1
    data.close()
    assert {r.graph_id: r.top for r in packed} == {g[0]: max(g[3]) for g in graphs}
    grid = spark.createDataFrame([(0, 1, 4, 2, 2, 0.01)], "experiment_idx int, layers int, channels int, batch int, epochs int, lr double")
    splits = spark.createDataFrame([(0, ("train", "train", "train", "val", "test", "train")[i], i) for i in range(6)], "fold int, role string, graph_id long")
    logs = models.train(rows, grid, splits, reruns=2)
    moved = [line for line in logs._jdf.queryExecution().executedPlan().toString().splitlines() if "array<array" in line]
    assert logs.count() == 4 and not moved


@pytest.mark.parametrize("augmented", [False, True])
def test_folds_of_clusters_are_trained_at_once(spark, monkeypatch, augmented):
    """A setting's folds are trained in one call, as each alone; the stages of a full experiment settle graphs once and train equal settings once."""
    v = [(i, j, (i * j) % 3) for i in range(24) for j in range(3 + i % 4)]
    e = [(i, j, j + 1) for i in range(24) for j in range(2 + i % 4)] + [(i, 0, 2) for i in range(0, 24, 3)]
    edges = gr.symmetric(spark.createDataFrame(e, "graph_id long, src long, dst long"))
    g = gr.Graphs(spark.createDataFrame(v, "graph_id long, vertex_id long, label int"), edges, spark.createDataFrame([(i, i % 2) for i in range(24)], "graph_id long, y int"))
    g, calls = gr.settled(g), {"train": 0, "settled": 0}
    features = pipelines.feature_rows(g, "disk", 3, k=1).where("vertex_id <> 2 OR graph_id <> 5")
    s = pipelines.Settings(folds=2, epochs=[2], patience=5, dims=[4], augmented=augmented)
    splits = ex.kfold(g.graphs, 2, seed=s.seed, stratify="y")
    grid = ex.grid(spark, layers=[1], channels=[8], batch=[32], epochs=[2], lr=[0.01])
    want, states = [], pipelines.one_hot(g, 3)
    for fold in range(2):
        own = splits.where(F.col("fold") == fold)
        centroids, basis = enhance.clustered(features, 3, 4, fit_on=own.where("role = 'train'"))
        ids = enhance.cluster_ids(features, centroids, basis)
        h = enhance.augmented(states, ids) if augmented else states.join(ids, ["graph_id", "vertex_id"], "left")
        want += models.train(models.nested(h, g.edges, g.graphs), grid, own, patience=5).orderBy("epoch").collect()
    for name, module in (("train", models), ("settled", gr)):
        real = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, _f=real, _n=name, **k: (calls.update({_n: calls[_n] + 1}), _f(*a, **k))[1])
    got = pipelines.clustered(g, features, 3, s).orderBy("fold", "epoch").collect()
    assert calls["train"] == 1 and len(got) == len(want) == 4
    for a, b in zip(got, want, strict=True):
        assert (a.fold, a.epoch) == (b.fold, b.epoch)
        assert [a.train_loss, a.val_loss, a.val_acc, a.test_acc] == pytest.approx([b.train_loss, b.val_loss, b.val_acc, b.test_acc], abs=1e-9)
    rows, _ = pipelines.run(g, "full", 3, s, features)
    assert rows.count() == 1 and calls == {"train": 3, "settled": 0}
