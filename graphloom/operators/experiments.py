"""Splits, parameter grids, choices of the best, early stopping, metrics and the result table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.plans import running


def _order(seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("graph_id").cast("string")))


def ranked(rows: DataFrame, part: list[str], place: str, key: str) -> DataFrame:
    """rows with rn, the rank from 0 by (place, key) within part, and n, the size of part. place is a hexadecimal hash: its first two
    digits are buckets whose sizes are summed up apart, so that no task sorts a whole part."""
    rows = rows.withColumn("bucket", F.substring(place, 1, 2))
    sizes = rows.groupBy(*part, "bucket").agg(F.count("*").alias("m"))
    all_ = Window.partitionBy(*part)  # 256 rows a part
    sizes = sizes.withColumn("n", F.sum("m").over(all_)).withColumn("before", F.coalesce(F.sum("m").over(all_.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = Window.partitionBy(*part, "bucket").orderBy(place, key)
    found = rows.withColumn("own", F.row_number().over(own)).join(sizes.drop("m"), [*part, "bucket"])
    return found.withColumn("rn", F.col("before") + F.col("own") - 1).drop("bucket", "before", "own", place)


def kfold(graphs: DataFrame, folds: int, test_tenths: int = 3, seed: int = 37, stratify: str | None = None) -> DataFrame:
    """fold, role, graph_id. Test is floor(tenths * n / 10) of all (or of each class), alike in every fold; the rest is dealt into
    folds of floor(n' / folds), the remainder to the last fold, or with classes to the fold of the class's rank."""
    part = [stratify] if stratify else []
    d = ranked(graphs.select("graph_id", *part).withColumn("place", _order(seed)), part, "place", "graph_id")
    d = d.withColumn("n_test", F.floor(F.col("n") * test_tenths / 10))
    home = F.lit(folds - 1)
    if stratify:
        ranks = graphs.select(stratify).distinct().withColumn("home", ((F.row_number().over(Window.orderBy(stratify)) - 1) % folds).cast("int"))
        d, home = d.join(F.broadcast(ranks), stratify), F.col("home")
    per = F.floor((F.col("n") - F.col("n_test")) / folds)
    own = F.when(per > 0, F.floor((F.col("rn") - F.col("n_test")) / F.greatest(per, F.lit(1)))).otherwise(folds)
    d = d.withColumn("own", F.when(own >= folds, home).otherwise(own).cast("int"))
    role = F.when(F.col("rn") < F.col("n_test"), "test").when(F.col("own") == F.col("fold"), "val").otherwise("train")
    return d.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).select("fold", role.alias("role"), "graph_id")


def fixed_splits(nested: DataFrame) -> DataFrame:
    """fold, role, graph_id from rows (fold, test, model_selection[{train, validation}])."""
    roles = F.map_from_arrays(F.array(*[F.lit(r) for r in ("test", "train", "val")]), F.array("test", F.col("model_selection")[0].train, F.col("model_selection")[0].validation))
    return nested.select("fold", F.explode(roles).alias("role", "ids")).select("fold", "role", F.explode("ids").alias("graph_id"))


def grid(spark: SparkSession, **lists) -> DataFrame:
    """All combinations, numbered in nesting order (the last list varies fastest)."""
    rows = [()]
    for values in lists.values():
        rows = [(*r, v) for r in rows for v in values]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ["experiment_idx", *lists]).withColumn("experiment_idx", F.col("experiment_idx").cast("int"))


def best(results: DataFrame, metric: str) -> DataFrame:
    """The row with the greatest metric over 0, the first experiment on ties; none if all are 0."""
    return results.where(F.col(metric) > 0).orderBy(F.desc(metric), "experiment_idx").limit(1)


def best_epoch_by_metric(runs: DataFrame, keys: list[str], metric: str = "val_acc") -> DataFrame:
    """keys, best_epoch, best: the first epoch with the greatest metric."""
    return runs.groupBy(*keys).agg(F.max_by("epoch", F.struct(metric, F.negative("epoch"))).alias("best_epoch"), F.max(metric).alias("best"))


def best_epoch(runs: DataFrame, keys: list[str], loss: str = "val_loss") -> DataFrame:
    return runs.groupBy(*keys).agg(F.min_by("epoch", F.struct(loss, "epoch")).alias("best_epoch"), F.min(loss).alias("best_loss"))


def early_stop(runs: DataFrame, keys: list[str], patience: int, loss: str = "val_loss") -> DataFrame:
    """keys, last_epoch, best_epoch, best_loss: an epoch improves if its loss is under all before; training ends with the
    patience-th epoch in a row that doesn't."""
    w = Window.partitionBy(*keys).orderBy("epoch")
    before = F.min(loss).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = runs.withColumn("improves", before.isNull() | (F.col(loss) < before))
    d = d.withColumn("since", F.col("epoch") - F.max(F.when(F.col("improves"), F.col("epoch"))).over(w))
    stop = d.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("since") >= patience, F.col("epoch"))), F.max("epoch")).alias("last_epoch"))
    seen = d.join(stop, keys).where("epoch <= last_epoch")
    return seen.groupBy(*keys, "last_epoch").agg(F.min_by("epoch", F.struct(loss, "epoch")).alias("best_epoch"), F.min(loss).alias("best_loss"))


def mean_std(runs: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """Mean and sample deviation (0 for one run)."""
    return runs.groupBy(*keys).agg(F.avg(metric).alias("mean"), F.coalesce(F.stddev_samp(metric), F.lit(0.0)).alias("std"))


def time_summary(times: DataFrame) -> DataFrame:
    """event, measured (count of non-negative), mean_seconds, complete: whether all samples were measured."""
    good = F.when(F.col("seconds") >= 0, F.col("seconds"))
    return times.groupBy("event").agg(F.count(good).alias("measured"), F.avg(good).alias("mean_seconds"), (F.count(good) == F.count("*")).alias("complete"))


def time_extent(times: DataFrame, keys: list[str]) -> DataFrame:
    """keys, tasks, least, most and mean seconds, and their sum."""
    s = F.col("seconds")
    return times.groupBy(*keys).agg(F.count("*").alias("tasks"), F.min(s).alias("least"), F.max(s).alias("most"), F.avg(s).alias("mean"), F.sum(s).alias("total"))


def time_maps(times: DataFrame, keys: list[str]) -> DataFrame:
    """keys, events: a map from event to seconds, the last of an event that repeats."""
    last = times.groupBy(*keys, "event").agg(F.max_by("seconds", "place").alias("seconds"))
    return last.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("event", "seconds")))).alias("events"))


def mean_of_means(times: DataFrame, outer: str, inner: str) -> DataFrame:
    """outer, mean: the mean of the inner groups' mean seconds."""
    return times.groupBy(outer, inner).agg(F.avg("seconds").alias("m")).groupBy(outer).agg(F.avg("m").alias("mean"))


def extract(results: DataFrame, column: str, **paths_) -> DataFrame:
    """Columns by JSON path out of a column of JSON text, as numbers."""
    return results.select("*", *[F.get_json_object(column, path).cast("double").alias(name) for name, path in paths_.items()])


def usable_batches(batches: DataFrame) -> DataFrame:
    """Batches of more than one vertex and more than one graph."""
    return batches.where("n_vertices > 1 AND n_graphs > 1")


def chained(later: DataFrame, earlier: DataFrame, path: str = "prev_result_path") -> DataFrame:
    """later's rows with the best settings of the result that their path names (earlier: path, best); null where it is missing."""
    return later.join(earlier.select(F.col("path").alias(path), "best"), path, "left")


def named_results(files: DataFrame, parameters: DataFrame) -> DataFrame:
    """Result files (file, body) joined with the parameter grid (name, ...) that their file names begin with."""
    own = files.withColumn("name", F.regexp_extract("file", "([^/]*)_res\\.json$", 1))
    return own.join(parameters, "name")


def result_name(dataset: Column, mode: Column, model: Column, norm: Column) -> Column:
    """The title of an experiment: its parts with underscores between, and bn at the end with batch norm."""
    return F.concat_ws("_", dataset, mode, model, F.when(norm, F.lit("bn")))


def accuracy(rows: DataFrame) -> DataFrame:
    """Share of pred = y over rows with a label (null and NaN aren't)."""
    y = F.col("y").cast("double")
    return rows.where(y.isNotNull() & ~F.isnan(y)).agg(F.avg((F.col("pred") == y).cast("double")).alias("accuracy"))


def roc_auc(rows: DataFrame) -> DataFrame:
    """Area under the curve of (score, y) by rank sums; ties count half. Rows are first summed by score."""
    by = rows.groupBy("score").agg(F.sum((F.col("y") == 1).cast("long")).alias("pos"), F.sum((F.col("y") == 0).cast("long")).alias("neg"))
    won = running(by, "score", "neg", "below").withColumn("won", F.col("pos") * (F.col("below") + F.col("neg") / 2))
    return won.agg((F.sum("won") / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def weighted_loss(batches: DataFrame) -> DataFrame:
    """The mean loss of batches (n_graphs, loss) by their sizes. Losses are summed as decimals of twelve digits, in any order alike."""
    total = F.sum((F.col("n_graphs") * F.col("loss")).cast("decimal(38,12)")).cast("double")
    return batches.agg((total / F.sum("n_graphs")).alias("loss"))


def result_table(results: DataFrame) -> DataFrame:
    """row, column, cell, best: of each cell the layer with the greatest validation mean (over 0), its test mean and deviation in
    per cent with one decimal (half up), and whether it is the best of its row (ties too)."""
    d = results.where("val_mean > 0").groupBy("row", "column").agg(F.max_by(F.struct("test_mean", "test_std"), F.struct("val_mean", F.negative("layer"))).alias("t"))
    pct = lambda c: F.format_string("%.1f", F.round((c * 100).cast("decimal(20,8)"), 1).cast("double"))
    top = F.rank().over(Window.partitionBy("row").orderBy(F.desc("t.test_mean"))) == 1
    return d.select("row", "column", F.concat_ws(" ± ", pct(F.col("t.test_mean")), pct(F.col("t.test_std"))).alias("cell"), top.alias("best"))


def latex(table: DataFrame, columns: list[str]) -> DataFrame:
    """line: one LaTeX row for each table row, the best cells in bold, missing ones a dash."""
    cell = F.when(F.col("best"), F.concat(F.lit("\\textbf{"), "cell", F.lit("}"))).otherwise(F.col("cell"))
    wide = table.groupBy("row").pivot("column", columns).agg(F.first(cell))
    return wide.select("row", F.concat(F.concat_ws(" & ", "row", *[F.coalesce(F.col(f"`{c}`"), F.lit("-")) for c in columns]), F.lit(" \\\\")).alias("line"))
