"""Configurations of feature generation and experiments: examples, checks, and the grid of all variants."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names and defaults that configuration files hold (fixed values).
DATASETS = ("NCI1", "ENZYMES", "PROTEINS", "DD", "COLLAB", "ogbg-molhiv", "ogbg-ppa", "CSL")
PROXIMITIES = (1, 3, 5, 8, 10)
MODES = ("classical", "clustering", "enhanced", "full")
EXPERIMENT_GENERAL = {"seed": 37, "num_workers": 0, "num_reruns": 3, "max_patience": 100, "use_batch_norm": False, "num_k_fold": 5, "k_fold_test_ratio": 0.3, "mbk_batch_size": 2048, "mbk_num_init": 3, "mbk_max_no_improvement": 10, "mbk_max_iter": 500}
FEATURE_GENERAL = {"seed": 37, "num_processes": 8, "graph_chunksize": 64, "vertex_chunksize": 512, "vector_buffer_size": 16384, "num_lo_gen": 1}
EXPERIMENT_DATASET = {"dataset_str": "NCI1", "base_model": "gin", "use_gpnn": False, "use_augmented_gnn": False, "feature_type": "sp", "lo_feature_idx": 0, "k": [1], "r": [], "s": [], "is_vertex_sp_feature": False, "normalize_vertex_features": False}
HYPERPARAMETERS = {"num_clusters": [3], "pca_dims": [0], "min_cluster_size": [50], "num_layers": [3], "num_hidden_channels": [32], "num_batch_sizes": [32], "num_epochs": [100], "lrs": [0.01], "num_gpnn_layer": [1], "gpnn_channels": [8]}
SP = {"k": [1], "r": [], "s": [], "gen_vertex_sp_features": False}
LO = {"size_smallest_subgraph": 2, "size_largest_subgraph": 4, "num_subgraph_samples": 50, "k": [], "r": [], "s": []}


def example(kind: str) -> dict:
    """A valid configuration of the kind: experiment or feature_gen."""
    if kind == "feature_gen":
        return {"type": kind, "general": dict(FEATURE_GENERAL), "dataset": {"dataset_str": "NCI1", "sp": dict(SP), "lo": dict(LO), "re_gen_properties": True}}
    return {"type": "experiment", "mode": "classical", "title": "example", "prev_result_path": "", "general": dict(EXPERIMENT_GENERAL), "dataset": dict(EXPERIMENT_DATASET), "hyperparameters": dict(HYPERPARAMETERS)}


def _whole(least: int):
    return lambda x: isinstance(x, int) and not isinstance(x, bool) and x >= least


def _list(least: float, kind: tuple = (int, float), empty: bool = False):
    return lambda x: isinstance(x, list) and (empty or x) and all(isinstance(e, kind) and not isinstance(e, bool) and e >= least for e in x)


def _flag(x) -> bool:
    return isinstance(x, bool)


def _dataset(x) -> bool:
    h = re.fullmatch(r"(\d+)-Prox", x) if isinstance(x, str) else None
    return isinstance(x, str) and (x in DATASETS or bool(h and int(h[1]) in PROXIMITIES))


_RINGS = {"k": _list(1, int, True), "r": _list(0, int, True), "s": _list(0, int, True)}
CHECKS: dict[str, dict] = {
    "experiment.general": {k: _whole(0) for k in ("seed", "num_workers")}
    | {k: _whole(1) for k in ("num_reruns", "max_patience", "num_k_fold", "mbk_batch_size", "mbk_num_init", "mbk_max_no_improvement", "mbk_max_iter")}
    | {"use_batch_norm": _flag, "k_fold_test_ratio": lambda x: isinstance(x, float) and 0 < x < 1},
    "experiment.dataset": {k: _flag for k in ("use_gpnn", "use_augmented_gnn", "is_vertex_sp_feature", "normalize_vertex_features")}
    | {"dataset_str": _dataset, "base_model": lambda x: x in ("gin", "gcn"), "feature_type": lambda x: x in ("sp", "lo"), "lo_feature_idx": _whole(0)}
    | _RINGS,
    "experiment.hyperparameters": {k: _list(1, int) for k in HYPERPARAMETERS if k not in ("pca_dims", "lrs", "min_cluster_size")}
    | {"pca_dims": _list(0, int), "min_cluster_size": _list(0, int), "lrs": lambda x: _list(0)(x) and all(e > 0 for e in x)},
    "feature_gen.general": {"seed": _whole(0)} | {k: _whole(1) for k in FEATURE_GENERAL if k != "seed"},
    "feature_gen.dataset": {"dataset_str": _dataset, "sp": lambda x: isinstance(x, dict), "lo": lambda x: isinstance(x, dict), "re_gen_properties": _flag},
    "feature_gen.sp": _RINGS | {"gen_vertex_sp_features": _flag},
    "feature_gen.lo": _RINGS | {k: _whole(1) for k in ("size_smallest_subgraph", "size_largest_subgraph", "num_subgraph_samples")},
}


def problems(config: dict) -> list[str]:
    """What is wrong with a configuration, as section.key; empty for a valid one. Sections that are missing, unknown keys and values of
    a wrong type or range are wrong; r and s must be equally long with r <= s."""
    kind, out = config.get("type"), []
    if kind not in ("experiment", "feature_gen"):
        return ["type"]
    if kind == "experiment":
        if config.get("mode", "full") not in MODES:
            out.append("mode")
        if config.get("mode") in ("clustering", "enhanced") and not (isinstance(config.get("prev_result_path"), str) and config["prev_result_path"]):
            out.append("prev_result_path")
    parts = {name.split(".")[1]: checks for name, checks in CHECKS.items() if name.startswith(kind + ".")}
    for part, checks in parts.items():
        values = config.get("dataset", {}).get(part, {}) if part in ("sp", "lo") else config.get(part)
        if not isinstance(values, dict):
            out.append(part)
            continue
        out += [f"{part}.{k}" for k, v in values.items() if k not in checks or not checks[k](v)]
        r, s = values.get("r") or [], values.get("s") or []
        if "r" in checks and isinstance(r, list) and isinstance(s, list) and (len(r) != len(s) or any(a > b for a, b in zip(r, s, strict=False))):
            out.append(f"{part}.r-s")
    if kind == "experiment" and isinstance(d := config.get("dataset"), dict):
        if d.get("use_gpnn") and d.get("use_augmented_gnn"):
            out.append("dataset.use_gpnn")
        if not (d.get("k") or d.get("r") or d.get("is_vertex_sp_feature")):
            out.append("dataset.k")
        out += [f"dataset.{k}" for k in ("dataset_str", "base_model") if k not in d]
    return sorted(set(out))


def checked(config: dict) -> dict:
    if found := problems(config):
        raise ValueError(f"configuration: {', '.join(found)}")
    return config


def variants(dataset: str, models=("gin", "gcn"), features=("k1", "r0_s2", "vsp"), clusters=(3, 5)) -> list[dict]:
    """A configuration for every model, batch norm and, beyond the classical mode, feature, normalising and number of clusters."""
    out = []
    for model in models:
        for bn in (False, True):
            base = example("experiment")
            base["general"]["use_batch_norm"] = bn
            base["dataset"] |= {"dataset_str": dataset, "base_model": model}
            end = "_bn" if bn else ""
            out.append(base | {"title": f"{dataset}_classical_{model}{end}"})
            for feature in features:
                ring = re.fullmatch(r"r(\d+)_s(\d+)", feature)
                own = {"k": [int(feature[1:])] if feature[0] == "k" else [], "r": [int(ring[1])] if ring else [], "s": [int(ring[2])] if ring else [], "is_vertex_sp_feature": feature == "vsp"}
                for norm in (False, True):
                    for mode in ("clustering", "enhanced"):
                        for c in clusters:
                            title = f"{dataset}_{mode}_{model}_{feature}_c{c}{'_norm' if norm else ''}{end}"
                            out.append(base | {"mode": mode, "title": title, "prev_result_path": f"{dataset}_classical_{model}{end}", "dataset": base["dataset"] | own | {"normalize_vertex_features": norm}, "hyperparameters": base["hyperparameters"] | {"num_clusters": [c]}})
    return out


def write(spark: SparkSession, configs: list[dict], path: str) -> None:
    """One JSON document a line."""
    spark.createDataFrame([(json.dumps(c, sort_keys=True),) for c in configs], "value string").write.text(path)


def queue(spark: SparkSession, path: str) -> DataFrame:
    """place, type, title, body of all configurations below path: feature generation first, then experiments by title."""
    from pyspark.sql import Window

    rows = spark.read.option("recursiveFileLookup", True).text(path)
    rows = rows.select(F.get_json_object("value", "$.type").alias("type"), F.coalesce(F.get_json_object("value", "$.title"), F.lit("")).alias("title"), F.col("value").alias("body"))
    order = Window.orderBy(F.col("type") != "feature_gen", "title", "body")  # configurations are few
    return rows.select((F.row_number().over(order) - 1).alias("place"), "type", "title", "body")
