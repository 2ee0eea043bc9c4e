"""Training on graphs that stay where they are: weights go out each step, sums of gradients come back.

The graphs of a split are stored once. A step broadcasts the network, every task sums gradients over its graphs of the batch, in shares of
bounded size, and the sums of tasks are added by groups of about their square root before the driver adds what is left and steps. So no task
holds a dataset, a step shuffles a model's size for each task, and the driver holds a model and as many sums as groups. Steps give what models.train
gives for one group, but for batch norm: its statistics are those of a task's share of the batch, and running means are weighted by vertices.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import models
from graphloom.plans import cut, summed

#: Vertices of a share whose gradients a task computes at once (one graph at least).
SHARE = 20_000


class Trainer:
    """rows: of models.nested() with role. Every step is a job over the stored rows, which any lost executor's tasks can read again."""

    def __init__(self, rows: DataFrame, net: models.Net, batch: int, seed: int, share: int = SHARE) -> None:
        self.rows, self.net, self.seed, self.share = cut(rows), net, seed, share
        self.n = {r.role: r["count"] for r in self.rows.groupBy("role").count().collect()}
        self.n_batches = max(1, -(-self.n.get("train", 0) // batch))
        self.tasks = self.rows.rdd.getNumPartitions()

    def _shares(self, work) -> np.ndarray | None:
        """The sum over all shares of work(net, graphs, y); work picks rows first, by pick(ids, roles)."""
        spark, share = self.rows.sparkSession, self.share
        sent = spark.sparkContext.broadcast(pickle.dumps(self.net))
        pick, of = work

        def run(batches):
            net, total, held, size = pickle.loads(sent.value), None, [], 0

            def done():
                nonlocal total, held, size
                x = of(net, [g for g, _ in held], models.targets([y for _, y in held]))
                total, held, size = x if total is None else total + x, [], 0

            for b in batches:
                ids, roles = b.column("graph_id").to_numpy(), np.array(b.column("role").to_pylist(), object)
                for r in b.take(pa.array(np.flatnonzero(pick(ids, roles)))).to_pylist():
                    n = len(r["x"])
                    if held and size + n > share:
                        done()
                    held.append(((np.array(r["x"], float), np.array(r["of"], int), np.column_stack([r["src"], r["dst"]]).astype(int)), r["y"]))
                    size += n
            if held:
                done()
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

        try:
            return summed(self.rows.mapInArrow(run, "sums binary"), self.tasks)
        finally:
            sent.unpersist()

    def step(self, epoch: int, number: int, rate: float) -> tuple[float, int]:
        """One step of Adam on a batch of an epoch: its mean loss before it and its graphs."""
        seed, n_batches, model = self.seed, self.n_batches, self.net.model
        keys, layers = sorted(self.net.p), (self.net.mean.shape if self.net.norm else (0, 0))

        def pick(ids, roles):
            return (roles == "train") & (models.dealt_batches(ids, n_batches, seed, epoch) == number)

        def of(net, graphs, y):
            loss, weight, into, stats = net.gradients(models.batch_of(graphs, model), y)
            n = sum(len(g[0]) for g in graphs)
            tail = [] if stats is None else [(stats[1] * n).ravel(), (stats[2] * n).ravel()]
            return np.concatenate([[loss, weight, len(graphs), n], *(into[k].ravel() for k in keys), *tail])

        total = self._shares((pick, of))
        if total is None or total[3] <= 1 or total[1] == 0:
            return 0.0, 0
        loss, weight, graphs, vertices = total[:4]
        at, into = 4, {}
        for k in keys:
            p = self.net.p[k]
            into[k] = total[at : at + p.size].reshape(p.shape) / weight
            at += p.size
        size = layers[0] * layers[1]
        stats = (vertices, total[at : at + size].reshape(layers) / vertices, total[at + size :].reshape(layers) / vertices) if self.net.norm else None
        self.net.update(into, rate, stats)
        return loss / weight, int(graphs)

    def measured(self) -> dict[str, tuple[float, float]]:
        """role: (mean loss, share of right predictions) of the validation and test graphs."""
        model, roles = self.net.model, ("val", "test")
        out = {}
        for role in roles:

            def of(net, graphs, y):
                logits = net.run(models.batch_of(graphs, model))[0]
                return np.array([*models.loss_of(logits, y)[:2], *models.hits_of(logits, y)], float)

            total = self._shares((lambda ids, own, role=role: own == role, of))
            out[role] = (total[0] / total[1], total[2] / total[3]) if total is not None and total[1] else (np.nan, np.nan)
        return out


def train(rows: DataFrame, grid: DataFrame, splits: DataFrame, model: str = "gin", reruns: int = 1, patience: int = 100, seed: int = 37, norm: bool = False, colours: tuple[int, int] | None = None, share: int = SHARE) -> DataFrame:
    """models.train, run after run, each over all tasks; val_acc and test_acc of tasks are shares of right cells."""
    spark, shape, out = rows.sparkSession, models._shape(rows).first(), []
    width = rows.select(F.size(F.col("x")[0]).alias("w")).first()
    if width is None:
        return spark.createDataFrame([], models.LOG)
    points, folds = grid.collect(), sorted(r.fold for r in splits.select("fold").distinct().collect())
    for fold in folds:
        own = rows.join(splits.where(F.col("fold") == fold).select("graph_id", "role"), "graph_id")
        for point in points:
            for rerun in range(reruns):
                net = models.Net(model, width.w, int(point.channels), int(point.layers), shape.n_classes, shape.n_clusters, seed + rerun, norm, colours)
                job = Trainer(own, net, int(point.batch), seed + rerun, share)
                best, since = np.inf, 0
                for epoch in range(int(point.epochs)):
                    losses, seen = 0.0, 0
                    for i in range(job.n_batches):
                        loss, n = job.step(epoch, i, float(point.lr))
                        losses, seen = losses + loss * n, seen + n
                    m = job.measured()
                    out.append((int(point.experiment_idx), int(fold), rerun, epoch, float(losses / max(1, seen)), float(m["val"][0]), float(m["val"][1]), float(m["test"][1])))
                    best, since = (m["val"][0], 0) if m["val"][0] < best else (best, since + 1)
                    if since >= patience:
                        break
    return spark.createDataFrame(out, models.LOG)
