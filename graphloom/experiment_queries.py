"""Queries of files, models, enhancement and experiments, and the SQL that gives the same rows."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom import configs
from graphloom.functions import dot, rounded
from graphloom.operators import clustering as cl
from graphloom.operators import enhance, models, parallel, pipelines
from graphloom.operators import experiments as ex
from graphloom.operators import features as ft
from graphloom.operators import graphs as gr
from graphloom.operators import learning as le
from graphloom.operators import lovasz as lo
from graphloom.operators import paths as pa
from graphloom.plans import cut, fresh_path, reuse
from graphloom.queries import _C, _CELLS, _D2, _NEAR, _SLOTS, _V, _WL, GRAPHS, SQL, _disk_vectors, _first_centroids, _mlp, _sql, _states, bfs, inner_bfs, query
from graphloom.sources import files, layouts
from graphloom.sources.driver_tables import SENT, customer_graphs, vectors


def _settled(spark, d: str) -> gr.Graphs:
    return gr.settled(customer_graphs(spark, d))


# file layouts of benchmarks -------------------------------------------------------------------------------------------------

_NUMBERS = """gn AS (SELECT graph_id, y, row_number() OVER (ORDER BY graph_id) - 1 AS g FROM graphs),
    vn AS (SELECT graph_id, vertex_id, label, g, y, row_number() OVER (ORDER BY graph_id, vertex_id) AS n, row_number() OVER (PARTITION BY graph_id ORDER BY vertex_id) - 1 AS p FROM vertices JOIN gn USING (graph_id))"""


def _benchmark(spark, d: str) -> gr.Graphs:
    path = fresh_path(spark, "benchmark")
    layouts.write_benchmark(_settled(spark, d), path, "orders")
    return layouts.read_benchmark(spark, path, "orders")


def _archive(spark, d: str) -> gr.Graphs:
    path = fresh_path(spark, "archive")
    layouts.write_archive(gr.settled(customer_graphs(spark, d, SENT)), path)
    return layouts.read_archive(spark, path)


@query(_sql(GRAPHS, _NUMBERS, select="SELECT a.g + 1 AS graph_id, a.n AS src, b.n AS dst FROM edges e JOIN vn a ON a.graph_id = e.graph_id AND a.vertex_id = src JOIN vn b ON b.graph_id = e.graph_id AND b.vertex_id = dst"))
def benchmark_edges(spark, d: str) -> DataFrame:
    """The edges of the order graphs, written as a benchmark's text files and read back by line numbers."""
    return _benchmark(spark, d).edges


@query(_sql(GRAPHS, _NUMBERS, select="SELECT g + 1 AS graph_id, n AS vertex_id, label, y FROM vn"))
def benchmark_vertices(spark, d: str) -> DataFrame:
    g = _benchmark(spark, d)
    return g.vertices.join(g.graphs, "graph_id")


@query(_sql(GRAPHS, _NUMBERS, select="SELECT a.g AS graph_id, a.p AS src, b.p AS dst FROM edges e JOIN vn a ON a.graph_id = e.graph_id AND a.vertex_id = src JOIN vn b ON b.graph_id = e.graph_id AND b.vertex_id = dst"))
def archive_edges(spark, d: str) -> DataFrame:
    """The edges of the order graphs, written as flat files with counts by graph and dealt to their graphs again."""
    return _archive(spark, d).edges


@query(_sql(GRAPHS, _NUMBERS, select="SELECT g AS graph_id, p AS vertex_id, label, y FROM vn"))
def archive_vertices(spark, d: str) -> DataFrame:
    g = _archive(spark, d)
    return g.vertices.join(g.graphs, "graph_id")


@query(_sql(GRAPHS, _NUMBERS, select="SELECT 0 AS fold, CASE WHEN g % 10 < 8 THEN 'train' WHEN g % 10 = 8 THEN 'val' ELSE 'test' END AS role, g AS graph_id FROM gn"))
def archive_splits(spark, d: str) -> DataFrame:
    """The fixed split of an archive over all its graphs."""
    path = fresh_path(spark, "archive")
    g = _settled(spark, d)
    layouts.write_archive(g, path)
    place = F.col("graph_id") % 10
    layouts.write_archive_splits(layouts.read_archive(spark, path).graphs.select("graph_id", F.when(place < 8, "train").when(place == 8, "val").otherwise("test").alias("role")), path, "place")
    return layouts.read_archive_splits(spark, path, "place")


@query(SQL["graph_properties"])
def reused_properties(spark, d: str) -> DataFrame:
    """The properties of the graphs as a second run finds them in the store, where it must not compute them again."""
    store, inputs = fresh_path(spark, "store"), [f"{d}/{t}.parquet" for t in ("lineitem", "orders", "part", "customer")]
    kept = {c: F.round(c, 6) for c in ("size_avg", "labels_avg")}
    reuse.stage(spark, store, "properties", inputs, {"round": 6}, lambda: gr.properties(customer_graphs(spark, d)).withColumns(kept))

    def again() -> DataFrame:
        raise RuntimeError("the stored stage wasn't found")

    return reuse.stage(spark, store, "properties", inputs, {"round": 6}, again)


# sources and sinks --------------------------------------------------------------------------------------------------------


@query(_sql(GRAPHS, "n AS (SELECT graph_id, vertex_id, row_number() OVER (PARTITION BY graph_id ORDER BY vertex_id) - 1 AS place FROM vertices)",
    select="SELECT e.graph_id, a.place AS src, b.place AS dst FROM edges e JOIN n a ON a.graph_id = e.graph_id AND a.vertex_id = src JOIN n b ON b.graph_id = e.graph_id AND b.vertex_id = dst"))
def graph_list_scan(spark, d: str) -> DataFrame:
    """Edges of graphs written as one row each and read back."""
    path = fresh_path(spark, "lists")
    files.to_lists(customer_graphs(spark, d)).write.parquet(path)
    return files.read_graph_lists(spark, path).edges


@query(_sql(GRAPHS, select="SELECT f.fold::INT AS fold, CASE WHEN graph_id % 10 < 2 THEN 'test' WHEN graph_id % 3 = f.fold THEN 'val' ELSE 'train' END AS role, graph_id FROM graphs, range(3) f(fold)"))
def fixed_splits(spark, d: str) -> DataFrame:
    """Splits kept as nested JSON, read back as rows."""
    g = customer_graphs(spark, d).graphs.select("graph_id").withColumn("fold", F.explode(F.array(*map(F.lit, range(3)))))
    role = F.when(F.col("graph_id") % 10 < 2, "test").when(F.col("graph_id") % 3 == F.col("fold"), "validation").otherwise("train")
    by = g.groupBy("fold").agg(*[F.collect_list(F.when(role == r, F.col("graph_id"))).alias(r) for r in ("test", "train", "validation")])
    path = fresh_path(spark, "splits")
    by.select("fold", "test", F.array(F.struct("train", "validation")).alias("model_selection")).write.json(path)
    return files.read_fixed_splits(spark, path)


@query("""WITH s AS (SELECT i - 1 AS graph_id, s FROM (SELECT unnest([2, 3, 4, 5, 6, 9, 11, 12, 13, 16]) s, generate_subscripts([2, 3, 4, 5, 6, 9, 11, 12, 13, 16], 1) i)),
    h AS (SELECT graph_id, v.v AS a, (v.v + unnest([1, s])) % 41 AS b FROM s, range(41) v(v))
    SELECT graph_id, a AS src, b AS dst FROM h UNION SELECT graph_id, b, a FROM h""")
def skip_link_graphs(spark, d: str) -> DataFrame:
    return gr.circular_skip_links(spark).edges


@query("""WITH RECURSIVE s AS (SELECT i - 1 AS graph_id, s FROM (SELECT unnest([2, 3, 4, 5, 6, 9, 11, 12, 13, 16]) s, generate_subscripts([2, 3, 4, 5, 6, 9, 11, 12, 13, 16], 1) i)),
    half AS (SELECT graph_id, v.v AS a, (v.v + unnest([1, s])) % 41 AS b FROM s, range(41) v(v)), edges AS (SELECT graph_id, a AS src, b AS dst FROM half UNION SELECT graph_id, b, a FROM half),
    vertices AS (SELECT graph_id, v.v AS vertex_id FROM s, range(41) v(v)), """ + bfs(None) + """,
    c AS (SELECT graph_id, root, d, count(*) n FROM dist WHERE d > 0 GROUP BY ALL), f AS (SELECT graph_id, root, string_agg(d || ':' || n, ' ' ORDER BY d) f FROM c GROUP BY 1, 2),
    k AS (SELECT f, min(graph_id) AS same_as FROM f GROUP BY 1) SELECT graph_id, count(DISTINCT f) AS kinds, min(same_as) AS same_as, 1::BIGINT AS wl_colours FROM f JOIN k USING (f) GROUP BY 1""")
def skip_link_classes(spark, d: str) -> DataFrame:
    """For each skip-link graph: kinds of distance vectors, the least graph that shares one, and 1-WL colours over all graphs. One colour
    tells no graph from another, so only vectors could."""
    g = gr.settled(gr.circular_skip_links(spark))
    counts = ft.vertex_counts(g, pa.graph_distances(g, None)).where("d > 0")
    f = counts.groupBy("graph_id", "vertex_id").agg(F.array_sort(F.collect_list(F.struct("d", "cnt"))).alias("features"))
    same = f.groupBy("features").agg(F.min("graph_id").alias("same_as"))
    colours = ft.wl1(g, 2).where("round = 2").agg(F.count_distinct("colour").alias("wl_colours"))
    return f.join(same, "features").groupBy("graph_id").agg(F.count_distinct("features").alias("kinds"), F.min("same_as").alias("same_as")).crossJoin(colours)


_SAVED = _SLOTS.format("""SELECT graph_id, root AS vertex_id, round(sqrt(sum(cnt * cnt)) / max(len), 6) AS length, count(*) AS cells, (SELECT count(DISTINCT slot) FROM s) AS feature_dim
    FROM (SELECT *, sqrt(sum(cnt * cnt) OVER (PARTITION BY graph_id, root)) AS len FROM s) JOIN graphs USING (graph_id) WHERE y = 1 GROUP BY 1, 2""")


@query(_SAVED)
def saved_features(spark, d: str) -> DataFrame:
    """1-disk vectors, cropped and written as sparse text, read back over their length for the graphs of class 1."""
    v, path = cut(_disk_vectors(spark, d).withColumnRenamed("root", "vertex_id")), fresh_path(spark, "features")
    meta = files.save_features(v, ft.editmask(v), path)
    rows = files.load_features(spark, path, True, customer_graphs(spark, d).graphs.where("y = 1"))
    x = F.col("features")
    rows = rows.select("graph_id", "vertex_id", F.round(F.sqrt(dot(x, x)), 6).alias("length"), F.size(F.filter(x, lambda e: e != 0)).cast("long").alias("cells"))
    return rows.crossJoin(F.broadcast(meta.select("feature_dim")))


@query(_sql(GRAPHS, """by_graph AS (SELECT graph_id, count(*) size, count(DISTINCT label) labels FROM vertices GROUP BY 1)""",
    select="SELECT count(*) AS num_graphs, sum(size)::BIGINT AS num_vertices, min(size) AS size_min, max(labels) AS labels_max FROM by_graph"))
def reloaded_properties(spark, d: str) -> DataFrame:
    """Properties written as JSON and taken from there instead of the graphs."""
    path = fresh_path(spark, "properties")
    files.write_json(gr.properties(customer_graphs(spark, d)), path)
    kinds = "num_graphs long, num_vertices long, size_min long, labels_max long"
    return files.read_json(spark, path, kinds)


@query(f"""WITH {_V}, {_C}, {_NEAR} SELECT id AS graph_id, 0::BIGINT AS vertex_id, cluster_id, 8::BIGINT AS num_centroids FROM a WHERE rn = 1""")
def saved_clustering(spark, d: str) -> DataFrame:
    """Centroids and labels written as text and read back."""
    v, path = vectors(spark, d), fresh_path(spark, "clustering")
    meta = files.write_centroids(_first_centroids(v), f"{path}/centroids")
    ids = cl.assigned(v, files.read_centroids(spark, f"{path}/centroids")).select(F.col("id").alias("graph_id"), F.lit(0).cast("long").alias("vertex_id"), "cluster_id")
    files.write_labels(ids, f"{path}/labels")
    return files.read_labels(spark, f"{path}/labels").crossJoin(F.broadcast(meta.select("num_centroids")))


def _result_rows(spark, d: str) -> DataFrame:
    """Nations stand for experiments: name, body of a result with subtrees of splits."""
    s = spark.read.parquet(f"{d}/supplier.parquet").groupBy("s_nationkey").agg(F.round(F.avg("s_acctbal") / 10000, 4).alias("mean"), F.round(F.max("s_acctbal") / 10000, 4).alias("top"), F.count("*").alias("n"))
    body = F.to_json(F.struct(F.struct(F.struct("mean").alias("val"), F.struct(F.col("top").alias("mean")).alias("test")).alias("res"), F.struct(F.col("n").alias("a")).alias("splits")))
    return s.select(F.format_string("DS_classical_m%d", "s_nationkey").alias("name"), body.alias("body"))


_RESULTS = "r AS (SELECT s_nationkey, round(avg(s_acctbal) / 10000, 4) AS val, round(max(s_acctbal) / 10000, 4) AS test FROM supplier GROUP BY 1)"


@query(f"WITH {_RESULTS} SELECT 'DS_classical_m' || s_nationkey || '_res.json' AS file, s_nationkey::INT AS m, val, test FROM r WHERE s_nationkey % 2 = 0")
def result_metrics(spark, d: str) -> DataFrame:
    """Result files found by name, joined with the grid their names tell, and metrics taken out by path."""
    path = fresh_path(spark, "results")
    files.write_results(_result_rows(spark, d), path)
    grid = spark.range(0, 25, 2).select(F.col("id").cast("int").alias("m"), F.format_string("DS_classical_m%d", "id").alias("name"))
    rows = ex.named_results(files.result_files(spark, path), grid)
    return ex.extract(rows, "body", val="$.res.val.mean", test="$.res.test.mean").select("file", "m", "val", "test")


@query(f"WITH {_RESULTS} SELECT 'DS_classical_m' || s_nationkey AS name, '{{\"res\":{{\"val\":' || 'x' || '}}}}' AS body, ['res'] AS fields FROM r".replace("'{\"res\":{\"val\":' || 'x' || '}}' AS body, ", ""))
def shortened_results(spark, d: str) -> DataFrame:
    """Results without their splits: the names of the fields that remain."""
    kind = "struct<res: struct<val: struct<mean: double>, test: struct<mean: double>>, splits: struct<a: bigint>>"
    rows = _result_rows(spark, d).select("name", F.from_json("body", kind).alias("body"))
    return files.shortened(rows, "body").select("name", F.json_object_keys(F.to_json("body")).alias("fields"))


@query("""SELECT CASE WHEN i = 0 THEN 'feature_gen' ELSE 'experiment' END AS type, i::INT AS place, CASE WHEN i = 0 THEN '' ELSE 'e' || i END AS title FROM range(4) t(i)""")
def config_queue(spark, d: str) -> DataFrame:
    """Configurations of a folder in the order in which they are run."""
    path = fresh_path(spark, "configs")
    made = [configs.checked(configs.example("experiment") | {"title": f"e{i}"}) for i in (3, 1, 2)]
    configs.write(spark, [*made, configs.checked(configs.example("feature_gen"))], path)
    return configs.queue(spark, path).select("place", "type", "title")


@query("""WITH m AS (SELECT unnest(['gin', 'gcn']) AS model), b AS (SELECT unnest(['', '_bn']) AS bn), f AS (SELECT unnest(['k1', 'r0_s2', 'vsp']) AS f), n AS (SELECT unnest(['', '_norm']) AS n),
    o AS (SELECT unnest(['clustering', 'enhanced']) AS mode), c AS (SELECT unnest([3, 5]) AS c)
    SELECT 'CSL_classical_' || model || bn AS title, 'classical' AS mode, 0::BIGINT AS problems FROM m, b
    UNION ALL SELECT 'CSL_' || mode || '_' || model || '_' || f || '_c' || c || n || bn, mode, 0 FROM m, b, f, n, o, c""")
def config_grid(spark, d: str) -> DataFrame:
    """Every variant of a dataset, none of them with a problem."""
    made = configs.variants("CSL")
    return spark.createDataFrame([(c["title"], c["mode"], len(configs.problems(c))) for c in made], "title string, mode string, problems long")


_BROKEN = [
    ("general.seed", "general", {"seed": -1}), ("general.k_fold_test_ratio", "general", {"k_fold_test_ratio": 1.5}), ("general.nonsense", "general", {"nonsense": 1}), ("general.use_batch_norm", "general", {"use_batch_norm": 1}),
    ("dataset.dataset_str", "dataset", {"dataset_str": "2-Prox"}), ("", "dataset", {"dataset_str": "10-Prox"}), ("dataset.r-s", "dataset", {"r": [3], "s": [2]}), ("dataset.k", "dataset", {"k": []}), ("dataset.use_gpnn", "dataset", {"use_gpnn": True, "use_augmented_gnn": True}),
    ("hyperparameters.lrs", "hyperparameters", {"lrs": [0.1, 0]}), ("hyperparameters.num_layers", "hyperparameters", {"num_layers": []}),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}::INT, '{p}')" for i, (p, _, _) in enumerate(_BROKEN)) + ") t(i, problems)")
def config_checks(spark, d: str) -> DataFrame:
    rows = []
    for i, (_, part, values) in enumerate(_BROKEN):
        c = configs.example("experiment")
        c[part] = c[part] | values
        rows.append((i, ",".join(configs.problems(c))))
    return spark.createDataFrame(rows, "i int, problems string")


@query("""WITH c AS (SELECT c_mktsegment AS name, min(c_nationkey) AS best FROM customer GROUP BY 1) SELECT c_custkey AS id, best AS best FROM customer LEFT JOIN c ON name = c_mktsegment""")
def stage_chaining(spark, d: str) -> DataFrame:
    """Experiments with the best settings of the result that they name."""
    c = spark.read.parquet(f"{d}/customer.parquet")
    later = c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("prev_result_path"))
    earlier = c.groupBy(F.col("c_mktsegment").alias("path")).agg(F.min("c_nationkey").alias("best"))
    return ex.chained(later, earlier).select("id", "best")


@query("""SELECT c_custkey AS id, 'DS_' || c_mktsegment || '_m' || c_nationkey || CASE WHEN c_custkey % 2 = 0 THEN '_bn' ELSE '' END AS title FROM customer""")
def result_names(spark, d: str) -> DataFrame:
    c = spark.read.parquet(f"{d}/customer.parquet")
    return c.select(F.col("c_custkey").alias("id"), ex.result_name(F.lit("DS"), F.col("c_mktsegment"), F.concat(F.lit("m"), "c_nationkey"), F.col("c_custkey") % 2 == 0).alias("title"))


@query("""WITH r AS (SELECT l_returnflag AS row, l_linestatus AS col, round(avg(l_tax) * 100, 3) AS v FROM lineitem GROUP BY 1, 2)
    SELECT row || ' & ' || coalesce(max(CASE WHEN col = 'F' THEN v END)::VARCHAR, '-') || ' & ' || coalesce(max(CASE WHEN col = 'O' THEN v END)::VARCHAR, '-') || ' \\\\' AS line FROM r GROUP BY row""")
def latex_lines(spark, d: str) -> DataFrame:
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    t = li.groupBy(F.col("l_returnflag").alias("row"), F.col("l_linestatus").alias("column")).agg(F.round(F.avg("l_tax") * 100, 3).cast("string").alias("cell"), F.lit(False).alias("best"))
    return ex.latex(t, ["F", "O"]).select("line")


# graphs and features ----------------------------------------------------------------------------------------------------------


@query(_sql(GRAPHS, select="SELECT graph_id, vertex_id, 0::INT AS label FROM vertices"))
def unlabelled_vertices(spark, d: str) -> DataFrame:
    return gr.unlabelled(customer_graphs(spark, d)).vertices


@query(_sql(GRAPHS, select="SELECT graph_id, src, dst FROM edges JOIN graphs USING (graph_id) WHERE y < 2 AND (src + dst) % 2 = 0"))
def mapped_graphs(spark, d: str) -> DataFrame:
    """Graphs of two classes after a map of their edges."""
    return gr.mapped(gr.where(customer_graphs(spark, d), "y < 2"), edges=lambda e: e.where("(src + dst) % 2 = 0")).edges


@query(_sql(GRAPHS, "i AS (SELECT graph_id, vertex_id, row_number() OVER (ORDER BY graph_id, vertex_id) - 1 AS dataset_idx FROM vertices)", select="SELECT * FROM i WHERE dataset_idx % 5 = 0"))
def dataset_lookup(spark, d: str) -> DataFrame:
    """The vertices at given places of the dataset."""
    g = gr.settled(customer_graphs(spark, d))
    return gr.located(gr.dataset_index(g), spark.range(0, g.vertices.count(), 5).withColumnRenamed("id", "dataset_idx"))


@query(_sql(GRAPHS, select="SELECT fold::INT AS fold, list(graph_id ORDER BY graph_id) AS ids FROM graphs, range(2) f(fold) WHERE graph_id % 2 = fold GROUP BY 1"))
def sorted_split(spark, d: str) -> DataFrame:
    g = customer_graphs(spark, d).graphs
    return g.groupBy((F.col("graph_id") % 2).cast("int").alias("fold")).agg(F.sort_array(F.collect_list("graph_id")).alias("ids"))


@query("SELECT list(DISTINCT (p_size % 3)::INT ORDER BY (p_size % 3)::INT) AS labels FROM part")
def sorted_alphabet(spark, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet").select((F.col("p_size") % 3).cast("int").alias("label")).distinct()
    return p.agg(F.sort_array(F.collect_list("label")).alias("labels"))


@query("SELECT r::INT AS r, s::INT AS s FROM range(4) a(r), range(1, 5) b(s) WHERE s >= r")
def ring_grid(spark, d: str) -> DataFrame:
    return ex.grid(spark, r=list(range(4)), s=list(range(1, 5))).where("s >= r").select(F.col("r").cast("int").alias("r"), F.col("s").cast("int").alias("s"))


@query("""SELECT l_orderkey AS batch, count(*) AS n_vertices, count(DISTINCT l_suppkey) AS n_graphs FROM lineitem GROUP BY 1 HAVING count(*) > 1 AND count(DISTINCT l_suppkey) > 1""")
def usable_batches(spark, d: str) -> DataFrame:
    b = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("batch")).agg(F.count("*").alias("n_vertices"), F.count_distinct("l_suppkey").alias("n_graphs"))
    return ex.usable_batches(b)


@query("SELECT avg((o_orderkey % 2 = o_custkey % 2)::INT)::DOUBLE AS accuracy FROM orders WHERE o_orderkey % 4 > 1")
def accuracy_of_labelled(spark, d: str) -> DataFrame:
    """Rows whose label is null or not a number don't count."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    y = F.when(F.col("o_orderkey") % 4 == 0, F.lit(None).cast("double")).when(F.col("o_orderkey") % 4 == 1, F.lit(float("nan"))).otherwise((F.col("o_custkey") % 2).cast("double"))
    return ex.accuracy(o.select((F.col("o_orderkey") % 2).cast("double").alias("pred"), y.alias("y")))


@query(_WL.format(", n AS (SELECT graph_id, round, colour, count(*) AS cnt FROM wl GROUP BY ALL) SELECT graph_id, round::INT AS round, colour, round(cnt / sqrt(sum(cnt * cnt) OVER (PARTITION BY graph_id, round)), 6) AS value FROM n"))
def wl1_normalised(spark, d: str) -> DataFrame:
    n = ft.wl1_normalised(_settled(spark, d), 2)
    return n.select("graph_id", "round", "colour", F.round("value", 6).alias("value"))


@query(_WL.format(", n AS (SELECT graph_id, colour, count(*) AS cnt FROM wl WHERE round = 1 GROUP BY ALL) SELECT graph_id, list(cnt ORDER BY cnt DESC) AS frequencies FROM n GROUP BY 1"))
def colour_frequencies(spark, d: str) -> DataFrame:
    return ft.frequencies(ft.wl1_histogram(_settled(spark, d), 1).where("round = 1"), ["graph_id"])


def _sub_wl2(nodes: str) -> str:
    return _sql(GRAPHS, bfs(2), f"n AS ({nodes})", """types AS (SELECT a.graph_id, a.root, a.v v1, b.v v2, (6 * x.label + 2 * y.label + (e.src IS NOT NULL)::INT)::INT AS type FROM n a JOIN n b ON a.graph_id = b.graph_id AND a.root = b.root
        JOIN vertices x ON x.graph_id = a.graph_id AND x.vertex_id = a.v JOIN vertices y ON y.graph_id = b.graph_id AND y.vertex_id = b.v LEFT JOIN edges e ON e.graph_id = a.graph_id AND e.src = a.v AND e.dst = b.v)""",
        "c AS (SELECT graph_id, root, v1, v2, md5(type::VARCHAR) AS colour FROM types)", "r AS (SELECT graph_id, root, v1, md5(string_agg(colour, ',' ORDER BY colour)) AS x FROM c GROUP BY 1, 2, 3)",
        "k AS (SELECT graph_id, root, v2, md5(string_agg(colour, ',' ORDER BY colour)) AS x FROM c GROUP BY 1, 2, 3)",
        "w AS (SELECT graph_id, root, md5(colour || '|' || r.x || '|' || k.x) AS colour FROM c JOIN r USING (graph_id, root, v1) JOIN k USING (graph_id, root, v2))",
        select="SELECT graph_id, root, colour, count(*) AS cnt FROM w GROUP BY ALL")


@query(_sub_wl2("SELECT graph_id, root, v FROM dist WHERE d <= 1"))
def kdisk_wl2(spark, d: str) -> DataFrame:
    """Pair colours of all 1-disks."""
    return ft.ring_wl2(_settled(spark, d), 0, 1, 3)


@query(_sub_wl2("SELECT graph_id, root, v FROM dist WHERE d BETWEEN 1 AND 2"))
def ring_wl2(spark, d: str) -> DataFrame:
    """Pair colours of all rings at distance 1 to 2."""
    return ft.ring_wl2(_settled(spark, d), 1, 2, 3)


_LABELS = "f AS (SELECT graph_id, count(*) FILTER (label = 0) a, count(*) FILTER (label = 1) b, count(*) FILTER (label = 2) c FROM vertices GROUP BY 1)"


def _label_vectors(g: gr.Graphs) -> DataFrame:
    counts = g.vertices.groupBy("graph_id", "label").agg(F.count("*").alias("cnt"))
    return ft.dense(counts, ["graph_id"], F.col("label"), 3, g.vertices.select("graph_id").distinct())


@query(_sql(GRAPHS, _LABELS, select="SELECT graph_id, min(graph_id) OVER w AS unique_id, count(*) OVER w AS copies FROM f WINDOW w AS (PARTITION BY a, b, c)"))
def unique_vectors(spark, d: str) -> DataFrame:
    return ft.unique_vectors(_label_vectors(customer_graphs(spark, d)))


@query("""SELECT * FROM (VALUES (0, 0, 0, 2, 2, 0, 0), (0, 1, 0, 1, 1, 2, 0), (0, 2, 0, 3, 1, 0, 0), (0, 3, 0, 1, 2, 1, 0), (0, 4, 0, 1, 2, 1, 0), (1, 0, 0, 3, 0, 0, 0), (1, 1, 0, 2, 1, 0, 0),
    (1, 2, 0, 2, 1, 0, 0), (1, 3, 0, 1, 2, 0, 0)) t(g, v, a, b, c, d, e)""".replace("SELECT *", "SELECT g::BIGINT AS graph_id, v::BIGINT AS vertex_id, [a, b, c, d, e]::DOUBLE[] AS features, "
    "CASE WHEN (g, v) = (0, 4) THEN 3 WHEN (g, v) = (1, 2) THEN 1 ELSE v END::BIGINT AS same_as"))  # fmt: skip
def demo_vectors(spark, d: str) -> DataFrame:
    """Vectors of the toy graphs (fixed values in the SQL) and the vertex that each equals."""
    return pipelines.demo(spark).select("graph_id", "vertex_id", "features", F.col("unique_id.v").alias("same_as"))


@query()
def demo_pipeline(spark, d: str) -> DataFrame:
    return pipelines.demo(spark).select("graph_id", "vertex_id", F.round("x1", 4).alias("x1"), F.round("x2", 4).alias("x2"), "cluster_id")


# vectors ----------------------------------------------------------------------------------------------------------------------


@query(f"WITH {_V} SELECT id, round(list_sum(list_transform(x, lambda e: e * e)), 4) AS energy FROM v")
def svd_energy(spark, d: str) -> DataFrame:
    """Squared lengths after a projection on all singular vectors: a rotation keeps them."""
    v = vectors(spark, d)
    path = fresh_path(spark, "basis")
    files.save_basis(spark, cl.svd_basis(v, 64, 64), path)
    p = cl.projected(v, files.load_basis(spark, path))
    return p.select("id", F.round(dot(F.col("x"), F.col("x")), 4).alias("energy"))


@query("SELECT 1.0::DOUBLE AS total, true AS falling")
def variance_ratios(spark, d: str) -> DataFrame:
    """Ratios of all components sum to one; those of an uncentred basis fall in energy."""
    v = vectors(spark, d)
    basis = cl.svd_basis(v, 64, 64)
    energy = [r.e for r in cl.projected(v, basis).select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.sum(F.col("x") * F.col("x")).alias("e")).orderBy("i").collect()]
    falls = all(a >= b - 1e-9 * abs(a) for a, b in zip(energy, energy[1:], strict=False))
    return cl.explained_variance(v, basis).agg(F.round(F.sum("ratio"), 6).alias("total")).withColumn("falling", F.lit(falls))


@query()
def plane_coordinates(spark, d: str) -> DataFrame:
    v = vectors(spark, d)
    return cl.drawn(v, _first_centroids(v), 64).select("id", F.round("x1", 4).alias("x1"), F.round("x2", 4).alias("x2"), "cluster_id")


@query(f"WITH {_V} SELECT 8::BIGINT AS clusters, count(*) AS points, true AS settled FROM v")
def kmeans_fit(spark, d: str) -> DataFrame:
    """k-means fitted: its clusters, their points, and whether no further step improves the cost by a thousandth."""
    v = vectors(spark, d)
    c = cl.lloyd(v, cl.kmeans(v, 8), 5)
    cost = [cl.inertia(cl.assigned(v, x)).first().inertia for x in (c, cl.lloyd(v, c, 1))]
    return cl.cluster_sizes(cl.assigned(v, c), c).agg(F.count("*").alias("clusters"), F.sum("cnt").alias("points")).withColumn("settled", F.lit(cost[1] >= 0.999 * cost[0]))


def _merge_sql(k: int = 8) -> str:
    """Every step drops the smallest cluster that is under a tenth of the rows."""
    steps = ["c0 AS (SELECT * FROM c)"]
    for i in range(k - 1):
        d2 = _D2.replace("c.center", f"c{i}.center")
        steps.append(f"a{i} AS (SELECT id, arg_min(cluster_id, ({d2}, cluster_id)) AS cluster_id FROM v, c{i} GROUP BY id)")
        steps.append(f"n{i} AS (SELECT c{i}.cluster_id, count(a{i}.id) AS cnt FROM c{i} LEFT JOIN a{i} USING (cluster_id) GROUP BY 1)")
        steps.append(f"s{i} AS (SELECT cluster_id FROM n{i} WHERE cnt < (SELECT count(*) // 10 FROM v) ORDER BY cnt, cluster_id LIMIT 1)")
        steps.append(f"c{i + 1} AS (SELECT * FROM c{i} WHERE cluster_id NOT IN (SELECT cluster_id FROM s{i}))")
    d2 = _D2.replace("c.center", f"c{k - 1}.center")
    return f"WITH {_V}, {_C}, " + ", ".join(steps) + f" SELECT cluster_id, count(id) AS cnt FROM c{k - 1} LEFT JOIN (SELECT id, arg_min(cluster_id, ({d2}, cluster_id)) AS cluster_id FROM v, c{k - 1} GROUP BY id) USING (cluster_id) GROUP BY 1"


SQL["min_cluster_merge"] = _merge_sql()


@query()
def optics_clusters(spark, d: str) -> DataFrame:
    v = vectors(spark, d)
    return cl.optics_clusters(cl.optics_order(v, 5), 5)


_PAIRS = f"{_CELLS}, t AS (SELECT 0.25 * count(*) n FROM v), u AS (SELECT f, bin, count(*) AS cnt FROM bins GROUP BY 1, 2 HAVING count(*) > (SELECT n FROM t)), h AS (SELECT id, f, bin FROM bins JOIN u USING (f, bin))"


@query(f"""WITH {_PAIRS} SELECT a.f AS f1, a.bin AS bin1, b.f AS f2, b.bin AS bin2, count(*) AS cnt FROM h a JOIN h b ON a.id = b.id AND a.f < b.f GROUP BY 1, 2, 3, 4 HAVING count(*) > (SELECT n FROM t)""")
def clique_pairs(spark, d: str) -> DataFrame:
    """Units of two dimensions that hold a quarter of the rows."""
    v = vectors(spark, d)
    b, least = cut(cl.bins(cl.min_max(v), 4)), 0.25 * v.count()
    u = F.col("unit")
    return cl.next_units(b, cl.dense_units(b, least), 2, least).select(u[0].f.alias("f1"), u[0].bin.alias("bin1"), u[1].f.alias("f2"), u[1].bin.alias("bin2"), "cnt")


_FOUR = _CELLS.replace("FROM embeddings)", "FROM embeddings), w4 AS (SELECT 1)").replace("unnest(range(len(x)))::INT AS f, unnest(x) AS w", "unnest(range(5))::INT AS f, unnest(x[1:5]) AS w")


@query(f"""WITH {_FOUR}, n AS (SELECT id, max(CASE WHEN f = 0 THEN bin END) a, max(CASE WHEN f = 1 THEN bin END) b, max(CASE WHEN f = 2 THEN bin END) c, max(CASE WHEN f = 3 THEN bin END) d, max(CASE WHEN f = 4 THEN bin END) e FROM bins GROUP BY 1),
    g AS (SELECT (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT + (d IS NOT NULL)::INT + (e IS NOT NULL)::INT AS size, count(*) AS cnt FROM n GROUP BY CUBE (a, b, c, d, e) HAVING count(*) > 0.1 * (SELECT count(*) FROM v))
    SELECT size, count(*) AS units, sum(cnt)::BIGINT AS points FROM g WHERE size > 0 GROUP BY 1""")
def clique_levels(spark, d: str) -> DataFrame:
    """Units that hold a tenth of the rows by number of dimensions, over the first five columns."""
    v = vectors(spark, d).withColumn("x", F.slice("x", 1, 5))
    return cl.clique(v, 4, 0.1).groupBy("size").agg(F.count("*").alias("units"), F.sum("cnt").alias("points"))


@query(f"""WITH RECURSIVE {_CELLS}, t AS (SELECT 0.1 * count(*) n FROM v), u AS (SELECT f, bin, count(*) AS cnt FROM bins GROUP BY 1, 2 HAVING count(*) > (SELECT n FROM t)), h AS (SELECT id, f, bin FROM bins JOIN u USING (f, bin)),
    p AS (SELECT a.f AS f1, a.bin AS b1, b.f AS f2, b.bin AS b2, count(*) AS cnt FROM h a JOIN h b ON a.id = b.id AND a.f < b.f GROUP BY 1, 2, 3, 4 HAVING count(*) > (SELECT n FROM t)),
    n AS (SELECT f AS f1, bin AS b1, -1 AS f2, -1 AS b2, cnt FROM u UNION ALL FROM p),
    r AS (SELECT f1, f2, b1, b2, b1 AS m1, b2 AS m2 FROM n UNION SELECT n.f1, n.f2, n.b1, n.b2, r.m1, r.m2 FROM r JOIN n ON n.f1 = r.f1 AND n.f2 = r.f2 AND abs(n.b1 - r.b1) + abs(n.b2 - r.b2) = 1),
    c AS (SELECT f1, f2, b1, b2, min([m1, m2]) AS m FROM r GROUP BY 1, 2, 3, 4)
    SELECT f1, f2, m[1] AS bin1, m[2] AS bin2, count(*) AS units, sum(cnt)::BIGINT AS points FROM c JOIN n USING (f1, f2, b1, b2) GROUP BY 1, 2, 3, 4""")
def clique_components(spark, d: str) -> DataFrame:
    """Clusters of units of one and two dimensions (f2 and bin2 of the former are -1) that hold a tenth of the rows, by their least unit."""
    units = cl.clique(vectors(spark, d), 4, 0.1, 2)
    by = units.groupBy("size", "cluster").agg(F.min("unit").alias("least"), F.count("*").alias("units"), F.sum("cnt").alias("points"))
    part = lambda i, x: F.coalesce(F.get("least", F.lit(i))[x], F.lit(-1))
    return by.select(part(0, "f").alias("f1"), part(1, "f").alias("f2"), part(0, "bin").alias("bin1"), part(1, "bin").alias("bin2"), "units", "points")


# cluster ids and networks -----------------------------------------------------------------------------------------------------


def _full_disks(g: gr.Graphs) -> DataFrame:
    return pipelines.feature_rows(g, "disk", 3, k=1)


_DISKS = (GRAPHS, bfs(1), inner_bfs("SELECT graph_id, root, v FROM dist", None), "cells AS (SELECT graph_id, root, (l1 * 3 + l2) * 4 + d + 1 AS slot, count(*)::DOUBLE AS cnt FROM pairs GROUP BY ALL)",
    "ce(cluster_id, slot, w) AS (VALUES (1, 1, 1.0), (1, 2, 1.0), (2, 2, 2.0), (2, 7, 1.0), (3, 18, 2.0), (3, 6, 2.0))",
    "lens AS (SELECT graph_id, root, sum(cnt * cnt) s FROM cells GROUP BY 1, 2)", "cen AS (SELECT k::INT AS cluster_id, coalesce(sum(w * w), 0) s FROM range(4) r(k) LEFT JOIN ce ON cluster_id = k GROUP BY 1)",
    "mix AS (SELECT graph_id, root, cluster_id, sum(cnt * w) m FROM cells JOIN ce USING (slot) GROUP BY 1, 2, 3)",
    "far AS (SELECT v.graph_id, v.vertex_id, v.label, cen.cluster_id, coalesce(lens.s, 0) + cen.s - 2 * coalesce(m, 0) AS d2 FROM vertices v CROSS JOIN cen LEFT JOIN lens ON lens.graph_id = v.graph_id AND lens.root = v.vertex_id "
    "LEFT JOIN mix ON mix.graph_id = v.graph_id AND mix.root = v.vertex_id AND mix.cluster_id = cen.cluster_id)",
    "en AS (SELECT graph_id, vertex_id, any_value(label) AS label, arg_min(cluster_id, (d2, cluster_id)) AS cluster_id FROM far GROUP BY 1, 2)")


def _fixed_centroids(spark) -> DataFrame:
    cells = {0: {}, 1: {1: 1.0, 2: 1.0}, 2: {2: 2.0, 7: 1.0}, 3: {18: 2.0, 6: 2.0}}
    return spark.createDataFrame([(c, [x.get(i, 0.0) for i in range(36)]) for c, x in cells.items()], "cluster_id int, center array<double>")


def _enhanced(spark, d: str):
    g = _settled(spark, d)
    ids = cut(enhance.cluster_ids(_full_disks(g), _fixed_centroids(spark)))
    return g, ids


@query(_sql(*_DISKS, select="SELECT graph_id, vertex_id, label, cluster_id FROM en"))
def enhanced_vertices(spark, d: str) -> DataFrame:
    """Vertices with the cluster of their 1-disk."""
    g, ids = _enhanced(spark, d)
    return enhance.enhanced(g.vertices, ids)


@query(_sql(*_DISKS, select="SELECT graph_id, string_agg(vertex_id || ':' || cluster_id, ' ' ORDER BY vertex_id) AS clusters FROM en GROUP BY 1"))
def cluster_maps(spark, d: str) -> DataFrame:
    m = enhance.cluster_map(_enhanced(spark, d)[1])
    return m.select("graph_id", F.array_join(F.transform(F.map_entries("clusters"), lambda e: F.concat_ws(":", e.key, e.value)), " ").alias("clusters"))


def _terms(names: list[str], row, bias: float) -> str:
    return " + ".join([*[f"({float(w)!r}) * {n}" for n, w in zip(names, row, strict=True)], f"({float(bias)!r})"])


def _columns(names: list[str], weights, bias, relu: bool) -> list[str]:
    out = [_terms(names, row, b) for row, b in zip(weights, bias, strict=True)]
    return [f"greatest({x}, 0)" for x in out] if relu else out


def _net_sql(layers: list, model: str, pool=None, vertices: str = "vertices") -> list[str]:
    """CTEs of a forward pass over s0 (graph_id, vertex_id, cluster_id, h0..): p<k> are the pooled states of layer k."""
    parts = []
    for k, layer in enumerate(layers):
        by = layer if isinstance(layer, dict) else {None: layer}
        first = next(iter(by.values()))
        width = len(first[0][0][0]) if model == "gin" else len(first[0])
        names = [f"h{i}" for i in range(width)]
        if model == "gin":
            total = ", ".join(f"sum(h{i}) AS h{i}" for i in range(width))
            own = ", ".join(names)
            parts.append(f"t{k} AS (SELECT graph_id, vertex_id, any_value(cluster_id) AS cluster_id, {total} FROM (SELECT graph_id, vertex_id, cluster_id, {own} FROM s{k} UNION ALL SELECT e.graph_id, e.dst, NULL, {own} FROM s{k} JOIN edges e ON s{k}.graph_id = e.graph_id AND s{k}.vertex_id = e.src) GROUP BY 1, 2)")
            inner = {c: _columns(names, *m[0], True) for c, m in by.items()}
            hidden = [f"z{i}" for i in range(len(next(iter(inner.values()))))]

            def case(of: dict, i: int) -> str:
                return of[None][i] if None in of else "CASE cluster_id " + " ".join(f"WHEN {c} THEN {x[i]}" for c, x in of.items()) + " END"

            parts.append(f"m{k} AS (SELECT graph_id, vertex_id, cluster_id, {', '.join(f'{case(inner, i)} AS z{i}' for i in range(len(hidden)))} FROM t{k})")
            outer = {c: _columns(hidden, *m[1], True) for c, m in by.items()}
            n = len(next(iter(outer.values())))
            parts.append(f"s{k + 1} AS (SELECT graph_id, vertex_id, cluster_id, {', '.join(f'{case(outer, i)} AS h{i}' for i in range(n))} FROM m{k})")
        else:
            inner = {c: _columns(names, m, [0.0] * len(m), False) for c, m in by.items()}
            n = len(next(iter(inner.values())))
            pick = [inner[None][i] if None in inner else "CASE cluster_id " + " ".join(f"WHEN {c} THEN {x[i]}" for c, x in inner.items()) + " END" for i in range(n)]
            parts.append(f"g{k} AS (SELECT graph_id, vertex_id, cluster_id, deg, {', '.join(f'({x}) / sqrt(deg) AS h{i}' for i, x in enumerate(pick))} FROM s{k} JOIN deg USING (graph_id, vertex_id))")
            own = ", ".join(f"h{i}" for i in range(n))
            parts.append(f"t{k} AS (SELECT graph_id, vertex_id, any_value(cluster_id) AS cluster_id, {', '.join(f'sum(h{i}) AS h{i}' for i in range(n))} FROM (SELECT graph_id, vertex_id, cluster_id, {own} FROM g{k} UNION ALL SELECT e.graph_id, e.dst, NULL, {own} FROM g{k} JOIN edges e ON g{k}.graph_id = e.graph_id AND g{k}.vertex_id = e.src) GROUP BY 1, 2)")
            parts.append(f"s{k + 1} AS (SELECT graph_id, vertex_id, cluster_id, {', '.join(f'greatest(h{i} / sqrt(deg), 0) AS h{i}' for i in range(n))} FROM t{k} JOIN deg USING (graph_id, vertex_id))")
        parts.append(f"p{k} AS (SELECT graph_id, {', '.join(f'sum(h{i}) AS q{i}' for i in range(n))} FROM s{k + 1} GROUP BY 1)")
    return parts


def _pools(counts: list[int]) -> str:
    cells, f = [], 0
    for k, n in enumerate(counts):
        for i in range(n):
            cells.append(f"SELECT graph_id, {f}::INT AS f, round(q{i}, 6) AS x FROM p{k}")
            f += 1
    return " UNION ALL ".join(cells)


_DEG = "deg AS (SELECT v.graph_id, vertex_id, 1 + count(e.dst) AS deg FROM vertices v LEFT JOIN edges e ON v.graph_id = e.graph_id AND vertex_id = src GROUP BY 1, 2)"
_S0 = "s0 AS (SELECT graph_id, vertex_id, label AS cluster_id, (label = 0)::INT::DOUBLE AS h0, (label = 1)::INT::DOUBLE AS h1, (label = 2)::INT::DOUBLE AS h2 FROM vertices)"
_GCN = [_mlp(1)[0][0], _mlp(2)[0][0]]
_GIN = [_mlp(1), _mlp(2)]


def _pool_rows(p: DataFrame) -> DataFrame:
    return p.select("graph_id", F.posexplode("pools").alias("f", "x")).withColumn("x", F.round("x", 6))


@query(_sql(GRAPHS, _S0, *_net_sql(_GIN, "gin"), select=_pools([3, 3])))
def gin_network(spark, d: str) -> DataFrame:
    g = _settled(spark, d)
    return _pool_rows(models.forward(_states(g), g.edges, _GIN))


@query(_sql(GRAPHS, _S0, *_net_sql([{c: _mlp(c) for c in range(3)}], "gin"), select=_pools([3])))
def gin_network_by_cluster(spark, d: str) -> DataFrame:
    g = _settled(spark, d)
    return _pool_rows(models.forward_by_label(g, 3, [{c: _mlp(c) for c in range(3)}]))


@query(_sql(GRAPHS, _DEG, _S0, *_net_sql(_GCN, "gcn"), select=_pools([3, 3])))
def gcn_forward(spark, d: str) -> DataFrame:
    g = _settled(spark, d)
    return _pool_rows(models.forward(_states(g), g.edges, _GCN, "gcn"))


@query(_sql(GRAPHS, _DEG, _S0, *_net_sql([{c: _mlp(c)[0][0] for c in range(3)}], "gcn"), select=_pools([3])))
def gcn_forward_partitioned(spark, d: str) -> DataFrame:
    g = _settled(spark, d)
    return _pool_rows(models.forward_by_label(g, 3, [{c: _mlp(c)[0][0] for c in range(3)}], "gcn"))


_NORM = ([0.5, 1.0, -0.5], [1.0, 4.0, 0.25], [1.0, 0.5, 2.0], [0.0, 0.1, -0.1])


@query(_sql(GRAPHS, _S0, *_net_sql([_mlp(1)], "gin")[:2], "l0 AS (SELECT graph_id, " + ", ".join(f"greatest((({x}) - ({m!r})) / sqrt({v!r} + 1e-5) * ({w!r}) + ({b!r}), 0) AS h{i}" for i, (x, m, v, w, b) in enumerate(zip(_columns(["z0", "z1", "z2"], *_mlp(1)[1], False), *_NORM, strict=True))) + " FROM m0)",
    "p0 AS (SELECT graph_id, sum(h0) AS q0, sum(h1) AS q1, sum(h2) AS q2 FROM l0 GROUP BY 1)", "y AS (SELECT graph_id, " + ", ".join(f"{x} AS y{i}" for i, x in enumerate(_columns(["q0", "q1", "q2"], *_mlp(3)[0], True))) + " FROM p0)",
    "o AS (SELECT graph_id, " + ", ".join(f"{x} AS o{i}" for i, x in enumerate(_columns(["y0", "y1", "y2"], *_mlp(4)[0], False))) + " FROM y)",
    select="SELECT graph_id, round(o0, 5) AS o0, round(o1, 5) AS o1, round(o2, 5) AS o2 FROM o"))
def gin_readout(spark, d: str) -> DataFrame:
    """Logits of a network with a norm layer and a readout MLP."""
    g = _settled(spark, d)
    r = models.readout(models.forward(_states(g), g.edges, [_mlp(1)], norms=[_NORM]), (_mlp(3)[0], _mlp(4)[0]))
    return r.select("graph_id", *[F.round(F.col("logits")[i], 5).alias(f"o{i}") for i in range(3)])


_AUG = [([[0.5, -0.25, 0.125, 0.5], [0.25, 0.5, -0.5, 0.25]], [0.0, 0.125]), ([[1.0, -0.5], [0.5, 0.25]], [0.0, 0.0])]


@query(_sql(*_DISKS, "s0 AS (SELECT graph_id, vertex_id, 0 AS cluster_id, (label = 0)::INT::DOUBLE AS h0, (label = 1)::INT::DOUBLE AS h1, (label = 2)::INT::DOUBLE AS h2, en.cluster_id::DOUBLE AS h3 FROM en)", *_net_sql([tuple(_AUG)], "gin"), select=_pools([2])))
def augmented_network(spark, d: str) -> DataFrame:
    """A network over labels and the cluster id as one more feature."""
    g, ids = _enhanced(spark, d)
    return _pool_rows(models.forward(enhance.augmented(_states(g), ids), g.edges, [tuple(_AUG)]))


@query(_sql(GRAPHS, """s0 AS (SELECT graph_id, vertex_id, label, CASE label WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE -0.25 END AS h0, CASE label WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 ELSE 0.5 END AS h1 FROM vertices)""",
    "w AS (SELECT e.*, CASE WHEN a.label = 0 AND b.label = 1 THEN 0.5 WHEN a.label = 2 AND b.label = 2 THEN -1.0 ELSE 1.0 END AS w FROM edges e JOIN vertices a ON a.graph_id = e.graph_id AND a.vertex_id = dst JOIN vertices b ON b.graph_id = e.graph_id AND b.vertex_id = src)",
    "n AS (SELECT graph_id, vertex_id, h0, h1 FROM s0 UNION ALL SELECT w.graph_id, dst, h0 * w, h1 * w FROM s0 JOIN w ON s0.graph_id = w.graph_id AND s0.vertex_id = src)",
    select="SELECT graph_id, vertex_id, round(greatest(sum(h0), 0), 6)::DOUBLE AS h0, round(greatest(sum(h1), 0), 6)::DOUBLE AS h1 FROM n GROUP BY 1, 2"))
def vertex_edge_colours(spark, d: str) -> DataFrame:
    """One round of class-wise vertex and edge colours, labels as clusters."""
    g = _settled(spark, d)
    g = gr.Graphs(g.vertices.withColumn("cluster_id", F.col("label")), g.edges, g.graphs)
    s = models.vertex_edge_states(g, {0: [1.0, 0.0], 1: [0.5, 1.0], 2: [-0.25, 0.5]}, {(0, 1): 0.5, (2, 2): -1.0}, 1)
    return s.select("graph_id", "vertex_id", *[F.round(F.col("h")[i], 6).alias(f"h{i}") for i in range(2)])


@query("SELECT * FROM (VALUES ('0', 24::BIGINT, 96::BIGINT), ('1', 72, 288), ('pool', 24, 96), ('total', 120, 480)) t(layer, numbers, bytes)")
def parameter_counts(spark, d: str) -> DataFrame:
    """Numbers and bytes of the layers of a network, one of them with three clusters."""
    return spark.createDataFrame(models.parameters([_mlp(1), {c: _mlp(c) for c in range(3)}], _mlp(4)), "layer string, numbers long, bytes long")


def _settings(**more) -> pipelines.Settings:
    return pipelines.Settings(folds=2, epochs=[3], patience=2, **more)


@query()
def train_networks(spark, d: str) -> DataFrame:
    """Epoch logs of networks on one-hot labels."""
    g = _settled(spark, d)
    return pipelines.classical(g, 3, _settings(layers=[1, 2], reruns=2))


@query()
def full_experiment(spark, d: str) -> DataFrame:
    """Classical, clustering and enhanced stages on the classes 0 and 1, each with the best of the one before."""
    g = gr.settled(gr.where(customer_graphs(spark, d), "y < 2"))
    return pipelines.run(g, "full", 3, _settings(clusters=[3], dims=[4]), _full_disks(g))[0]


# training where the graphs are ---------------------------------------------------------------------------------------------------

#: A network as training begins with: one GIN layer of three channels, a readout to five classes or three tasks.
_FIRST, _FIRST_TASKS = models.Net("gin", 3, 3, 1, 5, 1, 11), models.Net("gin", 3, 3, 1, 3, 1, 11)


def _rows_of(w, b) -> tuple[list, list]:
    return np.asarray(w).T.tolist(), np.asarray(b).tolist()


def _logits_sql(net: models.Net) -> tuple[str, ...]:
    """CTEs of the logits z0, z1, .. of each graph by the net's weights as they are."""
    p = net.p
    layer = (_rows_of(p["w0"][0], p["b0"][0]), _rows_of(p["v0"][0], p["c0"][0]))
    hidden, out = _columns(["q0", "q1", "q2"], *_rows_of(p["r"], p["rb"]), True), _columns(["y0", "y1", "y2"], *_rows_of(p["o"], p["ob"]), False)
    named = lambda xs, n: ", ".join(f"{x} AS {n}{i}" for i, x in enumerate(xs))
    return (
        _S0, *_net_sql([layer], "gin"), "qs AS (SELECT graph_id, sum(h0) AS q0, sum(h1) AS q1, sum(h2) AS q2 FROM s1 GROUP BY 1)",
        f"ys AS (SELECT graph_id, {named(hidden, 'y')} FROM qs)", f"zs AS (SELECT graph_id, {named(out, 'z')} FROM ys)",
    )


def _nested(g: gr.Graphs, y=None) -> DataFrame:
    graphs = g.graphs if y is None else g.graphs.withColumn("y", y)
    role = F.when(F.col("graph_id") % 2 == 0, "val").otherwise("test")
    return models.nested(pipelines.one_hot(g, 3), g.edges, graphs).withColumn("role", role)


_Z = [f"z{i}" for i in range(5)]


@query(_sql(GRAPHS, *_logits_sql(_FIRST), f"e AS (SELECT graph_id % 2 AS odd, greatest({', '.join(_Z)}) AS top, ln({' + '.join(f'exp({z} - greatest({", ".join(_Z)}))' for z in _Z)}) AS rest, [{', '.join(_Z)}] AS z, y FROM zs JOIN graphs USING (graph_id))",
    select="SELECT CASE odd WHEN 0 THEN 'val' ELSE 'test' END AS role, round(avg(top + rest - z[y + 1]), 6) AS loss, round(avg((list_position(z, top) - 1 = y)::INT), 6) AS accuracy FROM e GROUP BY 1"))
def parallel_losses(spark, d: str) -> DataFrame:
    """Loss and accuracy of the network that training begins with, by data-parallel passes over all graphs."""
    job = parallel.Trainer(_nested(_settled(spark, d)), models.Net("gin", 3, 3, 1, 5, 1, 11), 64, 11)
    return spark.createDataFrame([(k, round(float(a), 6), round(float(b), 6)) for k, (a, b) in job.measured().items()], "role string, loss double, accuracy double")


_TASKS = "CASE WHEN (graph_id + {t}) % 3 <> 0 THEN ((graph_id + {t}) % 2)::DOUBLE END"


@query(_sql(GRAPHS, *_logits_sql(_FIRST_TASKS), "cells AS (" + " UNION ALL ".join(f"SELECT z{t} AS z, {_TASKS.format(t=t)} AS y FROM zs" for t in range(3)) + ")",
    select="SELECT round(avg(ln(1 + exp(-abs(z))) + greatest(z, 0) - z * y), 6) AS loss, count(*) AS n_labelled FROM cells WHERE y IS NOT NULL"))
def multi_task_losses(spark, d: str) -> DataFrame:
    """The logistic loss of three tasks with missing labels by fixed weights."""
    g = _settled(spark, d)
    p = _FIRST_TASKS.p
    layer = (_rows_of(p["w0"][0], p["b0"][0]), _rows_of(p["v0"][0], p["c0"][0]))
    logits = models.readout(models.forward(_states(g), g.edges, [layer]), (_rows_of(p["r"], p["rb"]), _rows_of(p["o"], p["ob"])))
    y = F.array(*[F.when((F.col("graph_id") + t) % 3 != 0, ((F.col("graph_id") + t) % 2).cast("double")) for t in range(3)])
    return models.multi_task_loss(logits.select("logits", y.alias("y"))).select(F.round("loss", 6).alias("loss"), "n_labelled")


@query()
def parallel_training(spark, d: str) -> DataFrame:
    """Epoch logs of data-parallel training with batch norm over all graphs."""
    g = _settled(spark, d)
    return pipelines.classical(g, 3, pipelines.Settings(folds=2, epochs=[2], batch=[100_000], batch_norm=True, parallel=True))


SQL["gin_forward"], SQL["gin_forward_partitioned"] = SQL["gin_network"], SQL["gin_network_by_cluster"]

# logs -------------------------------------------------------------------------------------------------------------------------

_T = "t AS (SELECT event_type AS event, user_id, event_id, round(value, 3) AS seconds FROM events)"


def _times(spark, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(F.col("event_type").alias("event"), "user_id", F.col("event_id").alias("place"), F.round("value", 3).alias("seconds"))


@query(f"WITH {_T} SELECT event, count(*) AS tasks, min(seconds) AS least, max(seconds) AS most, round(avg(seconds), 6) AS mean, round(sum(seconds), 3) AS total FROM t GROUP BY 1")
def task_times(spark, d: str) -> DataFrame:
    return ex.time_extent(_times(spark, d), ["event"]).withColumns({"mean": F.round("mean", 6), "total": F.round("total", 3)})


@query(f"WITH {_T}, l AS (SELECT user_id, event, arg_max(seconds, event_id) AS s FROM t GROUP BY 1, 2) SELECT user_id, count(*) AS n, round(sum(s), 3) AS total, min(event) AS first FROM l GROUP BY 1")
def time_maps(spark, d: str) -> DataFrame:
    m = ex.time_maps(_times(spark, d), ["user_id"])
    total = F.aggregate(F.map_values("events"), F.lit(0.0), lambda a, x: a + x)
    return m.select("user_id", F.size("events").cast("long").alias("n"), F.round(total, 3).alias("total"), F.array_min(F.map_keys("events")).alias("first"))


@query(f"WITH {_T}, m AS (SELECT event, user_id, avg(seconds) m FROM t GROUP BY 1, 2) SELECT event, round(avg(m), 6) AS mean FROM m GROUP BY 1")
def mean_of_means(spark, d: str) -> DataFrame:
    return ex.mean_of_means(_times(spark, d), "event", "user_id").withColumn("mean", F.round("mean", 6))


@query(f"WITH {_T} SELECT user_id, arg_max(event_id, (seconds, -event_id)) AS best_epoch, max(seconds) AS best FROM t GROUP BY 1")
def best_epoch_by_metric(spark, d: str) -> DataFrame:
    return ex.best_epoch_by_metric(_times(spark, d).withColumnRenamed("place", "epoch").withColumnRenamed("seconds", "val_acc"), ["user_id"])


# geometric features -----------------------------------------------------------------------------------------------------------


@query("SELECT * FROM (VALUES ('complete', 4::BIGINT, 1.0::DOUBLE, true), ('empty', 4, 4.0, true), ('pentagon', 5, 2.2361, true), ('single', 1, 1.0, true)) t(name, n, theta, semidefinite)")
def theta_closed_forms(spark, d: str) -> DataFrame:
    """Theta numbers that are known, and whether the slack matrix is semidefinite."""
    import numpy as np

    known = {"complete": (4, [(i, j) for i in range(4) for j in range(i)]), "empty": (4, []), "pentagon": (5, [(i, (i + 1) % 5) for i in range(5)]), "single": (1, [])}
    names = list(known)
    v = spark.createDataFrame([(i, x) for i, k in enumerate(names) for x in range(known[k][0])], "graph_id long, vertex_id long")
    e = spark.createDataFrame([(i, a, b) for i, k in enumerate(names) for a, b in known[k][1]], "graph_id long, src long, dst long")
    good = {k: lo.is_semidefinite(lo.theta_number(n, np.array(x, np.int64).reshape(-1, 2))[1], 1e-6) for k, (n, x) in known.items()}
    rows = spark.createDataFrame([(i, k, good[k]) for i, k in enumerate(names)], "graph_id long, name string, semidefinite boolean")
    return lo.theta_numbers(v, e).join(rows, "graph_id").select("name", "n", F.round("theta", 4).alias("theta"), "semidefinite")


@query(f"WITH {_V} SELECT a.id, round(sqrt({_D2.replace('v.x', 'a.x').replace('c.center', 'b.x')}) / 2, 5) AS radius, 0.0::DOUBLE AS off FROM v a JOIN v b ON b.id = a.id + 1 WHERE a.id % 2 = 0")
def enclosing_balls(spark, d: str) -> DataFrame:
    """The least ball around each even id's vector and the next one's: half their distance, its centre their middle."""
    import numpy as np

    def run(pdf):
        import pandas as pd

        x = np.array(pdf.sort_values("id")["x"].tolist())
        c, r = lo.enclosing_ball(x)
        return pd.DataFrame([(int(pdf["id"].min()), r, float(np.abs(c - x.mean(0)).max()))], columns=["id", "radius", "off"])

    v = vectors(spark, d).withColumn("pair", F.floor(F.col("id") / 2))
    both = v.groupBy("pair").agg(F.count("*").alias("n")).where("n = 2").select("pair")
    out = v.join(both, "pair").select("pair", "id", "x").groupBy("pair").applyInPandas(run, "id long, radius double, off double")
    return out.select("id", F.round("radius", 5).alias("radius"), F.abs(F.round("off", 5)).alias("off"))


@query("""WITH n AS (SELECT unnest(range(1, 31))::BIGINT AS n), c AS (SELECT n, d::BIGINT AS d, CASE d WHEN 1 THEN n WHEN 2 THEN n * (n - 1) // 2 ELSE n * (n - 1) * (n - 2) // 6 END AS c FROM n, range(1, 4) r(d) WHERE d <= n),
    f AS (SELECT n, d, (50 * c // sum(c) OVER (PARTITION BY n))::BIGINT AS k, row_number() OVER (PARTITION BY n ORDER BY d DESC) AS i FROM c)
    SELECT n, d, (k + (i <= 50 - sum(k) OVER (PARTITION BY n))::BIGINT)::BIGINT AS samples FROM f""")
def subset_counts(spark, d: str) -> DataFrame:
    """Subsets to draw of each size from graphs of up to thirty vertices."""
    rows = [(n, k, s) for n in range(1, 31) for k, s in lo.sample_counts(range(1, 4), n, 50).items()]
    return spark.createDataFrame(rows, "n long, d long, samples long")


@query(_sql(GRAPHS, "first AS (SELECT graph_id, min(vertex_id) AS root FROM vertices GROUP BY 1)", "near AS (SELECT f.graph_id, root, e.dst AS v FROM first f JOIN edges e ON e.graph_id = f.graph_id AND e.src = root)",
    "deg AS (SELECT n.graph_id, n.root, n.v, count(m.v) AS deg FROM near n JOIN edges e ON e.graph_id = n.graph_id AND e.src = n.v LEFT JOIN near m ON m.graph_id = e.graph_id AND m.v = e.dst GROUP BY ALL)",
    "t AS (SELECT graph_id, root, count(*) AS n, CASE WHEN max(deg) <= 1 THEN count(*) - sum(deg) / 2 END::DOUBLE AS theta FROM deg GROUP BY ALL)",
    select="SELECT graph_id, root, 'ring' AS kind, n, theta FROM t UNION ALL SELECT f.graph_id, f.root, 'disk', coalesce(n, 0) + 1, CASE WHEN n IS NULL THEN 1 ELSE theta END FROM first f LEFT JOIN t USING (graph_id)"))
def neighbour_theta(spark, d: str) -> DataFrame:
    """Theta numbers of the 1-disk and the 1-1-ring around the first vertex of each graph. A vertex joined to all others leaves the number
    as it is; where no neighbour has two others beside it, the number counts the neighbours less their edges, and is given."""
    g, keys = _settled(spark, d), ("graph_id", "root")
    rings = lo.neighbour_lists(g, ring=True)
    out = [lo.thetas(x, keys).withColumn("kind", F.lit(kind)) for kind, x in (("disk", lo.neighbour_lists(g)), ("ring", rings))]
    crossed = rings.where(~lo.matched()).select(*keys, F.lit(True).alias("crossed"))
    given = F.when(F.col("crossed").isNull(), F.round("theta", 3))
    return out[0].unionByName(out[1]).join(crossed, list(keys), "left").select(*keys, "kind", "n", given.alias("theta"))


@query()
def kdisk_theta(spark, d: str) -> DataFrame:
    """Theta numbers of the 1-disks around the first vertex of each graph."""
    return lo.thetas(lo.neighbour_lists(_settled(spark, d)), ("graph_id", "root")).withColumn("theta", F.round("theta", 4))


@query()
def kdisk_cones(spark, d: str) -> DataFrame:
    """Cone features of the 1-disks around the first vertex of each graph, twice with other draws."""
    rows = lo.neighbour_lists(_settled(spark, d))
    runs = [lo.cones(rows, range(2, 4), 8, seed, ("graph_id", "root")).withColumn("repetition", F.lit(seed)) for seed in range(2)]
    return runs[0].unionByName(runs[1]).select("graph_id", "root", "repetition", "n", rounded(F.col("features"), 6).alias("features"))
