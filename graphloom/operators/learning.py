"""Message passing in relational form, with fixed weights, and training of small models in groups."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import dot
from graphloom.plans import cut


def vector_sum(df: DataFrame, keys: list[str], column: str = "h") -> DataFrame:
    """Component-wise sum of an array column by key, map-side combined."""
    cells = df.select(*keys, F.posexplode(column).alias("f", "x")).groupBy(*keys, "f").agg(F.sum("x").alias("x"))
    return cells.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("f", "x"))), lambda s: s.x).alias(column))


def gin_sum(h: DataFrame, edges: DataFrame, eps: float = 0.0) -> DataFrame:
    """(graph_id, vertex_id, h): the neighbours' sum plus (1 + eps) times the own row."""
    own = h.select("graph_id", "vertex_id", F.transform("h", lambda x: x * (1 + eps)).alias("h"))
    near = h.withColumnRenamed("vertex_id", "src").join(edges, ["graph_id", "src"]).select("graph_id", F.col("dst").alias("vertex_id"), "h")
    return vector_sum(own.unionByName(near), ["graph_id", "vertex_id"])


def gcn_sum(h: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows of D^-1/2 (A + I) D^-1/2 H, degrees with the self-loop."""
    deg = edges.groupBy("graph_id", F.col("src").alias("vertex_id")).agg((F.count("*") + 1).alias("deg"))
    d = h.join(deg, ["graph_id", "vertex_id"], "left").select("graph_id", "vertex_id", "h", F.coalesce("deg", F.lit(1)).alias("deg"))
    scaled = d.select("graph_id", "vertex_id", F.transform("h", lambda x: x / F.sqrt("deg")).alias("h"))
    near = scaled.withColumnRenamed("vertex_id", "src").join(edges, ["graph_id", "src"]).select("graph_id", F.col("dst").alias("vertex_id"), "h")
    total = vector_sum(scaled.unionByName(near), ["graph_id", "vertex_id"])
    return total.join(d.select("graph_id", "vertex_id", "deg"), ["graph_id", "vertex_id"]).select("graph_id", "vertex_id", F.transform("h", lambda x: x / F.sqrt("deg")).alias("h"))


def pooled(h: DataFrame) -> DataFrame:
    return vector_sum(h, ["graph_id"])


def affine(x: Column, weights, bias) -> Column:
    """W x + b, weights as rows."""
    return F.array(*[dot(x, F.array(*[F.lit(float(w)) for w in row])) + float(b) for row, b in zip(weights, bias, strict=True)])


def relu(x: Column) -> Column:
    return F.transform(x, lambda v: F.greatest(v, F.lit(0.0)))


def chained_forward(h: DataFrame, edges: DataFrame, layers: list, model: str = "gin", eps: float = 0.0) -> DataFrame:
    """graph_id, pools: sum-pooled states of every layer. layers: MLPs ((W, b), ..) for gin, matrices for gcn.

    States are columns of numbers and each vertex carries those of the layers before; a state is checkpointed before the next layer, which
    takes it twice, for a vertex and for its neighbours."""
    ids, width = ["graph_id", "vertex_id"], len(layers[0][0][0][0] if model == "gin" else layers[0][0])
    state = h.select(*ids, *[F.col("h")[i].alias(f"h{i}") for i in range(width)], F.lit(1).cast("long").alias("deg"))
    if model == "gcn":
        deg = edges.groupBy("graph_id", F.col("src").alias("vertex_id")).agg((F.count("*") + 1).alias("_deg"))
        state = state.join(deg, ids, "left").withColumn("deg", F.coalesce("_deg", "deg")).drop("_deg")
    pools: list[str] = []

    def times(rows: DataFrame, n: int, weights, bias, name: str, act) -> DataFrame:
        out = []
        for row, b in zip(weights, bias, strict=True):
            total = F.lit(0.0)
            for i in range(n):
                total = total + F.col(f"h{i}") * float(row[i])
            out.append(act(total + float(b)))
        return rows.select(*ids, "deg", *pools, *[x.alias(f"{name}{i}") for i, x in enumerate(out)])

    positive = lambda x: F.greatest(x, F.lit(0.0))
    for k, layer in enumerate(layers):
        if model == "gcn":
            state, width = times(state, width, layer, [0.0] * len(layer), "h", lambda x: x / F.sqrt("deg")), len(layer)
        names = [f"h{i}" for i in range(width)]
        own = state if model == "gcn" else state.withColumns({c: F.col(c) * (1 + eps) for c in names})
        near = state.select("graph_id", F.col("vertex_id").alias("src"), *names).join(edges, ["graph_id", "src"])
        near = near.select("graph_id", F.col("dst").alias("vertex_id"), *names, F.lit(0).cast("long").alias("deg"), *[F.lit(0.0).alias(p) for p in pools])
        state = own.unionByName(near).groupBy(*ids).agg(*[F.sum(c).alias(c) for c in (*names, *pools, "deg")])
        if model == "gcn":
            state = state.where("deg > 0").withColumns({c: positive(F.col(c) / F.sqrt("deg")) for c in names})
        else:
            for weights, bias in layer:
                state, width = times(state, width, weights, bias, "h", positive), len(weights)
            state = state.withColumn("deg", F.lit(1).cast("long"))
        new = {f"p{k}_{i}": F.col(f"h{i}") for i in range(width)}
        state = state.withColumns(new)
        pools += list(new)
        if k + 1 < len(layers):
            state = cut(state)
    return state.groupBy("graph_id").agg(*[F.sum(p).alias(p) for p in pools]).select("graph_id", F.array(*pools).alias("pools"))


def gin_forward(h: DataFrame, edges: DataFrame, layers, eps: float = 0.0) -> DataFrame:
    """graph_id, pools: sum-pooled states of every layer one after another. layers: a dict of MLPs by cluster id for each
    layer, or one MLP; an MLP is ((W1, b1), (W2, b2)). With clusters, h has cluster_id and all rows are updated at once."""
    if not any(isinstance(m, dict) for m in layers):
        return chained_forward(h, edges, layers, "gin", eps)
    by_cluster = "cluster_id" in h.columns
    ids = h.select("graph_id", "vertex_id", *(["cluster_id"] if by_cluster else []))
    state, pools = h.select("graph_id", "vertex_id", "h"), None
    for k, mlp in enumerate(layers):
        summed = gin_sum(state, edges, eps)

        def apply(m):
            return relu(affine(relu(affine(F.col("h"), *m[0])), *m[1]))

        if isinstance(mlp, dict):
            value = F.lit(None).cast("array<double>")
            for c, m in mlp.items():
                value = F.when(F.col("cluster_id") == c, apply(m)).otherwise(value)
            state = summed.join(ids, ["graph_id", "vertex_id"]).select("graph_id", "vertex_id", value.alias("h"))
        else:
            state = summed.select("graph_id", "vertex_id", apply(mlp).alias("h"))
        p = pooled(state).withColumnRenamed("h", f"p{k}")
        pools = p if pools is None else pools.join(p, "graph_id")
    return pools.select("graph_id", F.concat(*[f"p{k}" for k in range(len(layers))]).alias("pools"))


def train_grid(rows: DataFrame, grid: DataFrame) -> DataFrame:
    """Epoch logs of softmax models on pooled features, one group a grid point and fold.

    rows: fold, role, features, y. grid: experiment_idx, lr, epochs. Each group gets the fold's rows once."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        part = {r: (np.array(q["features"].tolist(), float), q["y"].to_numpy(int)) for r, q in pdf.groupby("role")}
        k, lr, epochs = int(pdf["y"].max()) + 1, float(pdf["lr"].iloc[0]), int(pdf["epochs"].iloc[0])
        x, y = part["train"]
        mean, sd = x.mean(0), x.std(0) + 1e-9
        w, out = np.zeros((x.shape[1] + 1, k)), []

        def logits(x):
            return np.column_stack([(x - mean) / sd, np.ones(len(x))]) @ w

        def measure(x, y):
            z = logits(x)
            z = z - z.max(1, keepdims=True)
            p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
            return p, -np.log(p[np.arange(len(y)), y] + 1e-12).mean(), (p.argmax(1) == y).mean()

        for e in range(epochs):
            p, loss, _ = measure(x, y)
            p[np.arange(len(y)), y] -= 1
            w -= lr * np.column_stack([(x - mean) / sd, np.ones(len(x))]).T @ p / len(x)
            val, test = (measure(*part[r])[1:] if r in part else (np.nan, np.nan) for r in ("val", "test"))
            out.append((int(pdf["experiment_idx"].iloc[0]), int(pdf["fold"].iloc[0]), e, loss, val[0], val[1], test[1]))
        return pd.DataFrame(out, columns=["experiment_idx", "fold", "epoch", "train_loss", "val_loss", "val_acc", "test_acc"])

    schema = "experiment_idx int, fold int, epoch int, train_loss double, val_loss double, val_acc double, test_acc double"
    return rows.crossJoin(F.broadcast(grid)).groupBy("experiment_idx", "fold").applyInPandas(run, schema)
