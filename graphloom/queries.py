"""Queries over the driver's tables, by operator, and the SQL that gives the same rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import l2_normalised, one_hot_label, rounded
from graphloom.operators import clustering as cl
from graphloom.operators import experiments as ex
from graphloom.operators import features as ft
from graphloom.operators import graphs as gr
from graphloom.operators import learning as le
from graphloom.operators import lovasz as lo
from graphloom.operators import models, pipelines
from graphloom.operators import paths as pa
from graphloom.plans import cut, running
from graphloom.sources import files
from graphloom.sources.driver_tables import customer_graphs, vectors

GRAPHS = """li AS (SELECT o_custkey g, l_orderkey o, l_partkey p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) rn
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    half AS (SELECT DISTINCT a.g, a.p x, b.p y FROM li a JOIN li b ON a.o = b.o AND b.rn = a.rn + 1 AND a.p <> b.p),
    edges AS (SELECT g graph_id, x src, y dst FROM half UNION SELECT g, y, x FROM half),
    vertices AS (SELECT DISTINCT g graph_id, p vertex_id, (p_size % 3)::INT AS label FROM li JOIN part ON p = p_partkey),
    graphs AS (SELECT c_custkey graph_id, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::INT AS y FROM customer
        WHERE true QUALIFY c_custkey IN (SELECT graph_id FROM vertices))"""


def bfs(depth: int | None) -> str:
    """Distances up to depth, or all: a key is reached once, so the recursion ends by itself."""
    near = f" AND w.d < {depth}" if depth is not None else ""
    return f"""dist(graph_id, root, v, d) USING KEY (graph_id, root, v) AS (SELECT graph_id, vertex_id, vertex_id, 0 FROM vertices
        UNION SELECT w.graph_id, w.root, e.dst, min(w.d) + 1 FROM dist w JOIN edges e ON w.graph_id = e.graph_id AND w.v = e.src{near}
        WHERE NOT EXISTS (FROM recurring.dist r WHERE r.graph_id = w.graph_id AND r.root = w.root AND r.v = e.dst) GROUP BY ALL)"""


def inner_bfs(nodes: str, depth: int | None) -> str:
    near = f" AND w.d < {depth}" if depth is not None else ""
    return f"""nodes AS ({nodes}),
    own AS (SELECT a.graph_id, a.root, e.src, e.dst FROM nodes a JOIN edges e ON a.graph_id = e.graph_id AND a.v = e.src
        JOIN nodes b ON b.graph_id = a.graph_id AND b.root = a.root AND b.v = e.dst),
    idist(graph_id, root, u, v, d) USING KEY (graph_id, root, u, v) AS (SELECT graph_id, root, v, v, 0 FROM nodes UNION SELECT w.graph_id, w.root, w.u, e.dst, min(w.d) + 1
        FROM idist w JOIN own e ON w.graph_id = e.graph_id AND w.root = e.root AND w.v = e.src{near}
        WHERE NOT EXISTS (FROM recurring.idist r WHERE r.graph_id = w.graph_id AND r.root = w.root AND r.u = w.u AND r.v = e.dst) GROUP BY ALL),
    pairs AS (SELECT a.graph_id, a.root, least(x.label, y.label) l1, greatest(x.label, y.label) l2, coalesce(i.d, -1)::INT d
        FROM nodes a JOIN nodes b ON a.graph_id = b.graph_id AND a.root = b.root AND a.v > b.v
        JOIN vertices x ON x.graph_id = a.graph_id AND x.vertex_id = a.v JOIN vertices y ON y.graph_id = b.graph_id AND y.vertex_id = b.v
        LEFT JOIN idist i ON i.graph_id = a.graph_id AND i.root = a.root AND i.u = a.v AND i.v = b.v)"""


def _sql(*ctes: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n    ".join(ctes) + "\n" + select


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# graphs ---------------------------------------------------------------------------------------------------------------


@query(_sql(GRAPHS, select="SELECT graph_id, count(*) AS size FROM vertices GROUP BY 1"))
def graph_sizes(spark, d: str) -> DataFrame:
    return gr.sizes(customer_graphs(spark, d))


@query(_sql(GRAPHS, """by_graph AS (SELECT graph_id, count(*) size, count(DISTINCT label) labels FROM vertices GROUP BY 1)""", select="""
    SELECT count(*) AS num_graphs, sum(size)::BIGINT AS num_vertices, round(avg(size), 6) AS size_avg, min(size) AS size_min, max(size) AS size_max,
      round(avg(labels), 6) AS labels_avg, min(labels) AS labels_min, max(labels) AS labels_max,
      (SELECT count(DISTINCT label) FROM vertices) AS num_labels, (SELECT count(DISTINCT y) FROM graphs) AS num_classes FROM by_graph"""))
def graph_properties(spark, d: str) -> DataFrame:
    p = gr.properties(customer_graphs(spark, d))
    return p.withColumns({c: F.round(c, 6) for c in ("size_avg", "labels_avg")})


@query(_sql(GRAPHS, select="SELECT DISTINCT label FROM vertices"))
def label_alphabet(spark, d: str) -> DataFrame:
    return gr.alphabet(customer_graphs(spark, d))


@query(_sql(GRAPHS, select="SELECT graph_id, count(DISTINCT label) AS labels FROM vertices GROUP BY 1"))
def labels_per_graph(spark, d: str) -> DataFrame:
    return gr.labels_by_graph(customer_graphs(spark, d))


@query(_sql(GRAPHS, select="SELECT y, min(graph_id) AS first_graph, count(*) AS n FROM graphs GROUP BY 1"))
def classes(spark, d: str) -> DataFrame:
    return gr.classes(customer_graphs(spark, d))


@query(_sql(GRAPHS, select="SELECT graph_id, src, dst FROM edges"))
def edge_symmetrize(spark, d: str) -> DataFrame:
    return customer_graphs(spark, d).edges


@query(_sql(GRAPHS, select="SELECT DISTINCT graph_id, least(src, dst) AS src, greatest(src, dst) AS dst FROM edges"))
def undirected_edges(spark, d: str) -> DataFrame:
    return gr.undirected(customer_graphs(spark, d).edges)


@query(_sql(GRAPHS, """deg AS (SELECT v.graph_id, vertex_id, count(e.dst) degree FROM vertices v LEFT JOIN edges e ON v.graph_id = e.graph_id AND vertex_id = src GROUP BY 1, 2)""",
    select="SELECT degree, count(*) AS n FROM deg GROUP BY 1"))
def degree_distribution(spark, d: str) -> DataFrame:
    return gr.degrees(customer_graphs(spark, d)).groupBy("degree").agg(F.count("*").alias("n"))


@query(_sql(GRAPHS, select="""SELECT graph_id, vertex_id, row_number() OVER (PARTITION BY graph_id ORDER BY vertex_id) - 1 AS position,
    row_number() OVER (ORDER BY graph_id, vertex_id) - 1 AS dataset_idx FROM vertices"""))
def dataset_idx(spark, d: str) -> DataFrame:
    return gr.dataset_index(customer_graphs(spark, d))


@query(_sql(GRAPHS, "s AS (SELECT graph_id, row_number() OVER (ORDER BY graph_id DESC) place FROM graphs WHERE y = 0)",
    select="SELECT graph_id, vertex_id, row_number() OVER (ORDER BY place, vertex_id) - 1 AS database_idx FROM vertices JOIN s USING (graph_id)"))
def index_lookup(spark, d: str) -> DataFrame:
    g = customer_graphs(spark, d)
    chosen = g.graphs.where("y = 0").select("graph_id", F.negate("graph_id").alias("place"), F.lit(1).alias("one"))
    return gr.database_index(g, running(chosen, "place", "one", "n").select("graph_id", (F.col("n") + 1).alias("place")))


@query(_sql(GRAPHS, select="SELECT graph_id, vertex_id, label FROM vertices JOIN graphs USING (graph_id) WHERE y = 1"))
def split_rows(spark, d: str) -> DataFrame:
    return gr.where(customer_graphs(spark, d), "y = 1").vertices


@query(_sql(GRAPHS, select="SELECT graph_id, vertex_id, label FROM vertices"))
def one_hot_labels(spark, d: str) -> DataFrame:
    hot = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: (i == F.col("label")).cast("int"))
    return customer_graphs(spark, d).vertices.withColumn("hot", hot).select("graph_id", "vertex_id", one_hot_label(F.col("hot")).alias("label"))


# distances and subgraphs ------------------------------------------------------------------------------------------------


@query(_sql(GRAPHS, bfs(3), select="SELECT graph_id, root, v, d FROM dist"))
def bfs_distances(spark, d: str) -> DataFrame:
    return pa.graph_distances(gr.settled(customer_graphs(spark, d)), 3)


@query(_sql(GRAPHS, bfs(2), select="SELECT graph_id, root, v, row_number() OVER (PARTITION BY graph_id, root ORDER BY v) - 1 AS new_id FROM dist"))
def induced_k_disk_nodes(spark, d: str) -> DataFrame:
    return pa.relabelled(pa.graph_distances(gr.settled(customer_graphs(spark, d)), 2))


@query(_sql(GRAPHS, bfs(2), select="""SELECT a.graph_id, a.root, src, dst FROM dist a JOIN edges e ON a.graph_id = e.graph_id AND a.v = src
    JOIN dist b ON b.graph_id = a.graph_id AND b.root = a.root AND b.v = dst"""))
def induced_k_disk_edges(spark, d: str) -> DataFrame:
    return pa.induced_rings(gr.settled(customer_graphs(spark, d)), 0, 2)


@query(_sql(GRAPHS, bfs(3), select="SELECT graph_id, root, v, d FROM dist WHERE d BETWEEN 2 AND 3"))
def ring_nodes(spark, d: str) -> DataFrame:
    return pa.ring(pa.graph_distances(gr.settled(customer_graphs(spark, d)), 3), 2, 3)


@query(_sql(GRAPHS, bfs(3), "n AS (SELECT * FROM dist WHERE d BETWEEN 2 AND 3)", select="""SELECT a.graph_id, a.root, src, dst FROM n a
    JOIN edges e ON a.graph_id = e.graph_id AND a.v = src JOIN n b ON b.graph_id = a.graph_id AND b.root = a.root AND b.v = dst"""))
def ring_edges(spark, d: str) -> DataFrame:
    return pa.induced_rings(gr.settled(customer_graphs(spark, d)), 2, 3)


_DIAMETERS = """far AS (SELECT graph_id, count(*) pairs, max(d) far FROM dist GROUP BY 1), size AS (SELECT graph_id, count(*) n FROM vertices GROUP BY 1),
    di AS (SELECT graph_id, pairs = n * n AS connected, CASE WHEN pairs = n * n THEN far END::INT AS diameter FROM far JOIN size USING (graph_id))"""


@query(_sql(GRAPHS, bfs(None), _DIAMETERS, select="SELECT graph_id, connected, coalesce(diameter, -1)::INT AS diameter FROM di"))
def graph_diameter(spark, d: str) -> DataFrame:
    return pa.graph_diameters(gr.settled(customer_graphs(spark, d))).fillna(-1, ["diameter"])


@query(_sql(GRAPHS, bfs(None), _DIAMETERS, select="""SELECT count(*) AS num_graphs, count(diameter) AS num_connected, min(diameter) AS diameter_min, max(diameter) AS diameter_max,
    round(avg(diameter), 6) AS avg_connected, round(sum(coalesce(diameter, 0)) / count(*), 6) AS avg_all FROM di"""))
def diameter_stats(spark, d: str) -> DataFrame:
    return pa.diameter_stats(pa.graph_diameters(gr.settled(customer_graphs(spark, d)))).withColumns({c: F.round(c, 6) for c in ("avg_connected", "avg_all")})


@query(_sql(GRAPHS, "ends AS (SELECT DISTINCT graph_id, 0::BIGINT AS root, vertex_id v FROM vertices WHERE label = 0)",
    """w(graph_id, root, v, d) USING KEY (graph_id, root, v) AS (SELECT graph_id, root, v, 0 FROM ends UNION SELECT w.graph_id, w.root, e.dst, min(w.d) + 1 FROM w JOIN edges e ON w.graph_id = e.graph_id AND w.v = e.src
        WHERE NOT EXISTS (FROM recurring.w r WHERE r.graph_id = w.graph_id AND r.root = w.root AND r.v = e.dst) GROUP BY ALL)""", select="SELECT graph_id, v, d FROM w WHERE d BETWEEN 1 AND 2"))
def multi_root_ring(spark, d: str) -> DataFrame:
    """Vertices one or two steps from the nearest vertex of label 0."""
    g = gr.settled(customer_graphs(spark, d))
    starts = g.vertices.where("label = 0").select("graph_id", F.lit(0).cast("long").alias("root"), F.col("vertex_id").alias("v"))
    return pa.ring(pa.distances(starts, g.edges, ["graph_id"], 2), 1, 2).select("graph_id", "v", "d")


# shortest-path features -----------------------------------------------------------------------------------------------


_VERTEX_SP = """c AS (SELECT a.graph_id, a.vertex_id, b.label, coalesce(x.d, -1)::INT d FROM vertices a JOIN vertices b ON a.graph_id = b.graph_id AND a.vertex_id <> b.vertex_id
    LEFT JOIN dist x ON x.graph_id = a.graph_id AND x.root = a.vertex_id AND x.v = b.vertex_id)"""


@query(_sql(GRAPHS, bfs(None), _VERTEX_SP, select="SELECT graph_id, vertex_id, label, d, count(*) AS cnt FROM c GROUP BY ALL"))
def vertex_sp_long(spark, d: str) -> DataFrame:
    return ft.vertex_sp(gr.settled(customer_graphs(spark, d)))


@query(_sql(GRAPHS, bfs(None), _VERTEX_SP, select="SELECT graph_id, vertex_id, (label * 21 + greatest(d, 0))::INT AS slot, count(*)::DOUBLE AS value FROM c WHERE d <= 20 GROUP BY ALL"))
def vertex_sp_vector(spark, d: str) -> DataFrame:
    """The cells that aren't 0 of vectors over three labels and distances up to 20."""
    v = ft.vertex_sp_vectors(gr.settled(customer_graphs(spark, d)), 3, 20)
    return v.select("graph_id", "vertex_id", F.posexplode("features").alias("slot", "value")).where("value <> 0")


@query(_sql(GRAPHS, bfs(None), _VERTEX_SP, "r AS (SELECT graph_id, min(vertex_id) vertex_id FROM vertices GROUP BY 1)",
    select="SELECT graph_id, vertex_id, (label * 21 + greatest(d, 0))::INT AS slot, count(*)::DOUBLE AS value FROM c JOIN r USING (graph_id, vertex_id) WHERE d <= 20 GROUP BY ALL"))
def single_vertex_sp(spark, d: str) -> DataFrame:
    """As vertex_sp_vector, on the fly for the first vertex of each graph."""
    g = gr.settled(customer_graphs(spark, d))
    first = g.vertices.groupBy("graph_id").agg(F.min("vertex_id").alias("root"))
    return ft.vertex_sp_vectors(g, 3, 20, first).select("graph_id", "vertex_id", F.posexplode("features").alias("slot", "value")).where("value <> 0")


@query(_sql(GRAPHS, bfs(None), _VERTEX_SP, select="SELECT graph_id, vertex_id, (label * 4 + greatest(d, 0))::INT AS slot, count(*)::DOUBLE AS value FROM c WHERE d <= 3 GROUP BY ALL"))
def vertex_vectors(spark, d: str) -> DataFrame:
    """Cells of the driver's vertex features up to distance 3, below the longest distances of the graphs."""
    v = pipelines.feature_rows(gr.settled(customer_graphs(spark, d)), "vertex", 3, most=3)
    return v.select("graph_id", "vertex_id", F.posexplode("features").alias("slot", "value")).where("value <> 0")


@query(_sql(GRAPHS, bfs(1), inner_bfs("SELECT graph_id, root, v FROM dist WHERE d = 1", None), select="SELECT graph_id, root AS vertex_id, ((l1 * 3 + l2) * 3 + d + 1)::INT AS slot, count(*)::DOUBLE AS value FROM pairs WHERE d <= 1 GROUP BY ALL"))
def ring_vectors(spark, d: str) -> DataFrame:
    """Cells of the driver's features of the rings at distance 1, with slots for induced distances up to 1 only."""
    v = pipelines.feature_rows(gr.settled(customer_graphs(spark, d)), "ring", 3, r=1, s=1, most=1)
    return v.select("graph_id", "vertex_id", F.posexplode("features").alias("slot", "value")).where("value <> 0")


@query(_sql(GRAPHS, bfs(2), inner_bfs("SELECT graph_id, root, v FROM dist JOIN (SELECT graph_id, min(vertex_id) root FROM vertices GROUP BY 1) USING (graph_id, root)", None), select="SELECT graph_id, root, l1, l2, d, count(*) AS cnt FROM pairs GROUP BY ALL"))
def single_kdisk_sp(spark, d: str) -> DataFrame:
    """As kdisk_sp_long, on the fly for the first vertex of each graph."""
    g = gr.settled(customer_graphs(spark, d))
    return ft.disk_sp(g, 2, g.vertices.groupBy("graph_id").agg(F.min("vertex_id").alias("root")))


@query(_sql(GRAPHS, bfs(2), inner_bfs("SELECT graph_id, root, v FROM dist", None), select="SELECT graph_id, root, l1, l2, d, count(*) AS cnt FROM pairs GROUP BY ALL"))
def kdisk_sp_long(spark, d: str) -> DataFrame:
    return ft.disk_sp(gr.settled(customer_graphs(spark, d)), 2)


@query(_sql(GRAPHS, bfs(2), inner_bfs("SELECT graph_id, root, v FROM dist WHERE d >= 1", None), select="""SELECT graph_id, root, l1, l2, d, count(*) AS cnt FROM pairs GROUP BY ALL
    UNION ALL SELECT graph_id, vertex_id, -1, -1, -1, 0 FROM vertices WHERE (graph_id, vertex_id) NOT IN (SELECT graph_id, root FROM pairs)"""))
def ring_sp_long(spark, d: str) -> DataFrame:
    """Rings without a pair, empty ones too, have a row of -1 with cnt 0."""
    g = gr.settled(customer_graphs(spark, d))
    return ft.without_pairs(g, ft.ring_sp(g, 1, 2))



def _disk_vectors(spark, d: str, k: int = 1) -> DataFrame:
    width = 2 * k + 3  # distances -1, 0 .. 2k + 1
    return ft.ring_vectors(gr.settled(customer_graphs(spark, d)), 0, k, 3, width - 2, width, 2 * k, all_=False)


_SLOTS = _sql(GRAPHS, bfs(1), inner_bfs("SELECT graph_id, root, v FROM dist", None), "s AS (SELECT graph_id, root, (l1 * 3 + l2) * 5 + d + 1 AS slot, count(*) AS cnt FROM pairs GROUP BY ALL)", select="{}")


@query(_SLOTS.format("SELECT graph_id, root, slot::INT AS slot, cnt::DOUBLE AS value FROM s"))
def kdisk_sp_vector(spark, d: str) -> DataFrame:
    cells = _disk_vectors(spark, d).select("graph_id", "root", F.posexplode("features").alias("slot", "value"))
    return cells.where("value <> 0")


@query(_SLOTS.format("SELECT i::INT AS slot, i IN (SELECT slot FROM s) AS used FROM range(45) t(i)"))
def editmask(spark, d: str) -> DataFrame:
    return ft.editmask(_disk_vectors(spark, d))


@query(_SLOTS.format("SELECT graph_id, root, sum(cnt)::DOUBLE AS total, (SELECT count(DISTINCT slot) FROM s) AS width FROM s GROUP BY 1, 2"))
def cropped_vectors(spark, d: str) -> DataFrame:
    v = _disk_vectors(spark, d)
    total = F.aggregate("features", F.lit(0.0), lambda s, x: s + x)
    return ft.cropped(v, ft.editmask(v)).select("graph_id", "root", total.alias("total"), F.size("features").cast("long").alias("width"))


# colours ----------------------------------------------------------------------------------------------------------------

_WL = _sql(GRAPHS, "w0 AS (SELECT graph_id, vertex_id, md5(label::VARCHAR) AS colour FROM vertices)", *[
    f"""w{k} AS (SELECT a.graph_id, a.vertex_id, md5(any_value(a.colour) || '|' || coalesce(string_agg(b.colour, ',' ORDER BY b.colour), '')) AS colour
        FROM w{k - 1} a LEFT JOIN edges e ON a.graph_id = e.graph_id AND a.vertex_id = e.src LEFT JOIN w{k - 1} b ON b.graph_id = e.graph_id AND b.vertex_id = e.dst GROUP BY 1, 2)""" for k in (1, 2)],
    "wl AS (SELECT *, 0 AS round FROM w0 UNION ALL SELECT *, 1 FROM w1 UNION ALL SELECT *, 2 FROM w2)", select="{}")


@query(_WL.format("SELECT graph_id, vertex_id, round::INT AS round, colour FROM wl"))
def wl1_colors(spark, d: str) -> DataFrame:
    return ft.wl1(gr.settled(customer_graphs(spark, d)), 2)


@query(_WL.format("SELECT graph_id, round::INT AS round, colour, count(*) AS cnt FROM wl GROUP BY ALL"))
def wl1_histogram(spark, d: str) -> DataFrame:
    return ft.wl1_histogram(gr.settled(customer_graphs(spark, d)), 2)


_TYPES = """types AS (SELECT a.graph_id, a.vertex_id v1, b.vertex_id v2, (6 * a.label + 2 * b.label + (e.src IS NOT NULL)::INT)::INT AS type
    FROM vertices a JOIN vertices b ON a.graph_id = b.graph_id LEFT JOIN edges e ON e.graph_id = a.graph_id AND e.src = a.vertex_id AND e.dst = b.vertex_id)"""


@query(_sql(GRAPHS, _TYPES, select="SELECT * FROM types"))
def wl2_atomic_types(spark, d: str) -> DataFrame:
    return ft.atomic_types(gr.settled(customer_graphs(spark, d)), 3)


@query(_sql(GRAPHS, _TYPES, "c AS (SELECT graph_id, v1, v2, md5(type::VARCHAR) AS colour FROM types)",
    "r AS (SELECT graph_id, v1, md5(string_agg(colour, ',' ORDER BY colour)) AS x FROM c GROUP BY 1, 2)",
    "k AS (SELECT graph_id, v2, md5(string_agg(colour, ',' ORDER BY colour)) AS x FROM c GROUP BY 1, 2)",
    "n AS (SELECT graph_id, md5(colour || '|' || r.x || '|' || k.x) AS colour FROM c JOIN r USING (graph_id, v1) JOIN k USING (graph_id, v2))",
    select="SELECT graph_id, colour, count(*) AS cnt FROM n GROUP BY ALL"))
def wl2_colors(spark, d: str) -> DataFrame:
    return ft.wl2_histogram(gr.settled(customer_graphs(spark, d)), 3)


# splits, grids, choices -------------------------------------------------------------------------------------------------


def _fold_sql(part: str, home: str) -> str:
    return _sql(GRAPHS, f"""r AS (SELECT graph_id, y, row_number() OVER (PARTITION BY {part} ORDER BY md5('37|' || graph_id), graph_id) - 1 rn, count(*) OVER (PARTITION BY {part}) n FROM graphs)""",
        "t AS (SELECT *, n * 3 // 10 AS n_test FROM r)", f"""o AS (SELECT *, CASE WHEN (n - n_test) // 5 > 0 AND (rn - n_test) // ((n - n_test) // 5) < 5
            THEN (rn - n_test) // ((n - n_test) // 5) ELSE {home} END AS own FROM t)""",
        select="""SELECT fold::INT AS fold, CASE WHEN rn < n_test THEN 'test' WHEN own = fold THEN 'val' ELSE 'train' END AS role, graph_id
            FROM o, range(5) f(fold)""")  # fmt: skip


@query(_fold_sql("1", "4"))
def kfold_split(spark, d: str) -> DataFrame:
    return ex.kfold(customer_graphs(spark, d).graphs, 5)


@query(_fold_sql("y", "(y % 5)"))
def stratified_kfold_split(spark, d: str) -> DataFrame:
    return ex.kfold(customer_graphs(spark, d).graphs, 5, stratify="y")


@query("""SELECT (row_number() OVER (ORDER BY layers, channels, lr DESC) - 1)::INT AS experiment_idx, layers::BIGINT AS layers, channels::BIGINT AS channels, lr::DOUBLE AS lr
    FROM (VALUES (1), (2), (3)) a(layers), (VALUES (32), (64)) b(channels), (VALUES (0.01), (0.001)) c(lr)""")
def hyperparameter_grid(spark, d: str) -> DataFrame:
    return ex.grid(spark, layers=[1, 2, 3], channels=[32, 64], lr=[0.01, 0.001])


def _results(spark, d: str) -> DataFrame:
    """Runs by experiment: suppliers of a nation stand for reruns, their balances for metrics."""
    s = spark.read.parquet(f"{d}/supplier.parquet")
    return s.select(F.col("s_nationkey").cast("int").alias("experiment_idx"), F.col("s_suppkey").alias("rerun"), (F.col("s_acctbal") / 10000).alias("acc"))


@query("""WITH m AS (SELECT s_nationkey::INT AS experiment_idx, round(avg(s_acctbal / 10000), 6) AS mean FROM supplier GROUP BY 1)
    SELECT * FROM m WHERE mean > 0 ORDER BY mean DESC, experiment_idx LIMIT 1""")
def grid_best(spark, d: str) -> DataFrame:
    m = ex.mean_std(_results(spark, d), ["experiment_idx"], "acc").select("experiment_idx", F.round("mean", 6).alias("mean"))
    return ex.best(m, "mean")


@query("""SELECT s_nationkey::INT AS experiment_idx, round(avg(s_acctbal / 10000), 6) AS mean, round(coalesce(stddev_samp(s_acctbal / 10000), 0), 6) AS std FROM supplier GROUP BY 1""")
def rerun_stats(spark, d: str) -> DataFrame:
    return ex.mean_std(_results(spark, d), ["experiment_idx"], "acc").withColumns({c: F.round(c, 6) for c in ("mean", "std")})


_RUNS = """runs AS (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS epoch, round(value, 3) AS val_loss FROM events)"""


def _runs(spark, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("user_id", (F.row_number().over(w) - 1).alias("epoch"), F.round("value", 3).alias("val_loss"))


@query(f"""WITH {_RUNS}, i AS (SELECT *, coalesce(val_loss < min(val_loss) OVER (PARTITION BY user_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improves FROM runs),
    s AS (SELECT *, epoch - max(CASE WHEN improves THEN epoch END) OVER (PARTITION BY user_id ORDER BY epoch) AS since FROM i),
    l AS (SELECT user_id, coalesce(min(CASE WHEN since >= 5 THEN epoch END), max(epoch))::INT AS last_epoch FROM s GROUP BY 1)
    SELECT user_id, last_epoch, arg_min(epoch, (val_loss, epoch)) AS best_epoch, min(val_loss) AS best_loss FROM s JOIN l USING (user_id) WHERE epoch <= last_epoch GROUP BY 1, 2""")
def early_stopping(spark, d: str) -> DataFrame:
    return ex.early_stop(_runs(spark, d), ["user_id"], 5)


@query(f"""WITH {_RUNS} SELECT user_id, arg_min(epoch, (val_loss, epoch)) AS best_epoch, min(val_loss) AS best_loss FROM runs GROUP BY 1""")
def best_epoch(spark, d: str) -> DataFrame:
    return ex.best_epoch(_runs(spark, d), ["user_id"])


@query("""SELECT event_type AS event, count(*) FILTER (value >= 0) AS measured, round(avg(value) FILTER (value >= 0), 6) AS mean_seconds, count(*) FILTER (value >= 0) = count(*) AS complete FROM events GROUP BY 1""")
def time_summary(spark, d: str) -> DataFrame:
    t = ex.time_summary(spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("event"), F.col("value").alias("seconds")))
    return t.withColumn("mean_seconds", F.round("mean_seconds", 6))


def _cells(spark, d: str) -> DataFrame:
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    by = li.groupBy(F.col("l_returnflag").alias("row"), F.col("l_linestatus").alias("column"), F.col("l_linenumber").alias("layer"))
    return by.agg(F.round(F.avg("l_discount"), 4).alias("val_mean"), F.round(F.avg("l_tax"), 4).alias("test_mean"), F.round(F.stddev_samp("l_tax"), 4).alias("test_std"))


_TABLE = """c AS (SELECT l_returnflag AS row, l_linestatus AS column_, l_linenumber AS layer, round(avg(l_discount), 4) v, round(avg(l_tax), 4) m, round(stddev_samp(l_tax), 4) s FROM lineitem GROUP BY 1, 2, 3),
    b AS (SELECT row, column_, arg_max(m, (v, -layer)) m, arg_max(s, (v, -layer)) s FROM c WHERE v > 0 GROUP BY 1, 2)"""


@query(f"""WITH {_TABLE} SELECT row, column_ AS "column", format('{{:.1f}}', round((m * 100)::DECIMAL(20, 8), 1)::DOUBLE) || ' ± ' || format('{{:.1f}}', round((s * 100)::DECIMAL(20, 8), 1)::DOUBLE) AS cell,
    rank() OVER (PARTITION BY row ORDER BY m DESC) = 1 AS best FROM b""")
def result_table(spark, d: str) -> DataFrame:
    return ex.result_table(_cells(spark, d))


@query(f"""WITH {_TABLE} SELECT row, column_ AS "column" FROM b QUALIFY rank() OVER (PARTITION BY row ORDER BY m DESC) = 1""")
def best_columns(spark, d: str) -> DataFrame:
    return ex.result_table(_cells(spark, d)).where("best").select("row", "column")


@query("""SELECT avg((l_linenumber % 2 = l_partkey % 2)::INT)::DOUBLE AS accuracy FROM lineitem""")
def accuracy(spark, d: str) -> DataFrame:
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return ex.accuracy(li.select((F.col("l_linenumber") % 2).alias("pred"), (F.col("l_partkey") % 2).alias("y")))


@query("""WITH s AS (SELECT l_quantity AS score, (l_returnflag = 'R')::INT AS y FROM lineitem), b AS (SELECT score, sum(y) pos, sum(1 - y) neg FROM s GROUP BY 1),
    w AS (SELECT *, pos * (coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + neg / 2) won FROM b)
    SELECT round(sum(won) / (sum(pos)::DOUBLE * sum(neg)), 6) AS auc FROM w""")
def roc_auc(spark, d: str) -> DataFrame:
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return ex.roc_auc(li.select(F.col("l_quantity").alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("y"))).select(F.round("auc", 6).alias("auc"))


@query("""WITH b AS (SELECT l_orderkey, count(*) n, avg(l_discount) loss FROM lineitem GROUP BY 1) SELECT sum((n * loss)::DECIMAL(38, 12))::DOUBLE / sum(n) AS loss FROM b""")
def weighted_loss(spark, d: str) -> DataFrame:
    b = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey").agg(F.count("*").alias("n_graphs"), F.avg("l_discount").alias("loss"))
    return ex.weighted_loss(b)


@query("""SELECT i || '-Prox' AS name, i::INT AS h FROM (VALUES (1), (3), (5), (8), (10)) t(i) UNION ALL SELECT 'CSL', 0""")
def dataset_names(spark, d: str) -> DataFrame:
    names = spark.createDataFrame([(n,) for n in ("1-Prox", "3-Prox", "5-Prox", "8-Prox", "10-Prox", "CSL")], "name string")
    return names.select("name", F.coalesce(files.prox_h("name"), F.lit(0)).alias("h"))


# vectors ----------------------------------------------------------------------------------------------------------------

_V = "v AS (SELECT vec_id AS id, list_transform(embedding, lambda e: e::DOUBLE) AS x, label FROM embeddings)"
_D2 = "list_sum(list_transform(list_zip(v.x, c.center), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_C = "c AS (SELECT (row_number() OVER (ORDER BY id) - 1)::INT AS cluster_id, x AS center FROM v ORDER BY id LIMIT 8)"
_NEAR = f"a AS (SELECT id, v.x, cluster_id, {_D2} AS dist2, row_number() OVER (PARTITION BY id ORDER BY {_D2}, cluster_id) AS rn FROM v, c)"


def _first_centroids(v: DataFrame, k: int = 8) -> DataFrame:
    """The first k vectors by id."""
    rows = v.orderBy("id").limit(k).collect()
    return v.sparkSession.createDataFrame([(i, list(r.x)) for i, r in enumerate(rows)], "cluster_id int, center array<double>")


def _batch_steps(steps: int) -> str:
    """CTEs c0.. of eight centres after each batch of ids that leave the same rest by four."""
    out = [_C.replace("c AS (SELECT (row_number() OVER (ORDER BY id) - 1)::INT AS cluster_id, x AS center", "c0 AS (SELECT (row_number() OVER (ORDER BY id) - 1)::INT AS cluster_id, x AS center, 0 AS n")]
    for s in range(steps):
        out.append(f"a{s} AS (SELECT id, v.x, cluster_id, row_number() OVER (PARTITION BY id ORDER BY {_D2}, cluster_id) AS rn FROM v, c{s} c WHERE id % 4 = {s})")
        out.append(f"e{s} AS (SELECT cluster_id, i, sum(w) AS s, count(*) AS b FROM (SELECT cluster_id, unnest(x) AS w, generate_subscripts(x, 1) AS i FROM a{s} WHERE rn = 1) GROUP BY 1, 2)")
        out.append(f"""c{s + 1} AS (SELECT c.cluster_id, list(w + (coalesce(s, 0) - coalesce(b, 0) * w) / greatest(n + coalesce(b, 0), 1) ORDER BY c.i) AS center, max(n + coalesce(b, 0)) AS n
            FROM (SELECT cluster_id, n, unnest(center) AS w, generate_subscripts(center, 1) AS i FROM c{s}) c LEFT JOIN e{s} e ON e.cluster_id = c.cluster_id AND e.i = c.i GROUP BY 1)""")
    return ", ".join(out)


@query(f"WITH {_V}, {_batch_steps(4)}, r AS (SELECT cluster_id, n::BIGINT AS n, unnest(range(64))::INT AS f, unnest(center) AS x FROM c4) SELECT cluster_id, n, f, round(x, 6) AS x FROM r")
def minibatch_steps(spark, d: str) -> DataFrame:
    """Eight centres after four batches that hold every vector once."""
    v = vectors(spark, d)
    centers, counts = np.array([r.center for r in _first_centroids(v).orderBy("cluster_id").collect()]), np.zeros(8)
    for s in range(4):
        centers, counts, _, _ = cl.minibatch_step(v.where(F.col("id") % 4 == s), centers, counts)
    rows = [(c, int(counts[c]), f, float(x)) for c in range(8) for f, x in enumerate(centers[c])]
    return spark.createDataFrame(rows, "cluster_id int, n long, f int, x double").withColumn("x", F.round("x", 6))


@query(f"""WITH {_V}, n AS (SELECT id, x, sqrt(list_sum(list_transform(x, lambda e: e * e))) AS l FROM v)
    SELECT id, round(list_sum(list_transform(x, lambda e: abs(e) / l)), 6) AS l1, round(list_max(list_transform(x, lambda e: e / l)), 6) AS top FROM n""")
def l2_normalize(spark, d: str) -> DataFrame:
    v = vectors(spark, d).select("id", l2_normalised(F.col("x")).alias("x"))
    return v.select("id", F.round(F.aggregate("x", F.lit(0.0), lambda s, e: s + F.abs(e)), 6).alias("l1"), F.round(F.array_max("x"), 6).alias("top"))


@query(f"""WITH {_V}, e AS (SELECT id, unnest(range(len(x)))::INT AS i, unnest(x) AS w FROM v)
    SELECT a.i, b.i AS j, round(sum(a.w * b.w), 6) AS s FROM e a JOIN e b ON a.id = b.id GROUP BY 1, 2""")
def svd_gram(spark, d: str) -> DataFrame:
    m = cl.gram(vectors(spark, d), 64)
    return spark.createDataFrame([(i, j, float(m[i, j])) for i in range(64) for j in range(64)], "i int, j int, s double").withColumn("s", F.round("s", 6) + 0.0)


@query()
def svd_projection(spark, d: str) -> DataFrame:
    v = vectors(spark, d)
    return cl.projected(v, cl.svd_basis(v, 64, 8)).select("id", rounded(F.col("x"), 4).alias("x"))


@query()
def explained_variance(spark, d: str) -> DataFrame:
    v = vectors(spark, d)
    return cl.explained_variance(v, cl.svd_basis(v, 64, 8))


@query(f"""WITH {_V}, {_C}, {_NEAR} SELECT id, cluster_id, round(dist2, 6) AS dist2 FROM a WHERE rn = 1""")
def kmeans_assign(spark, d: str) -> DataFrame:
    v = vectors(spark, d)
    return cl.assigned(v, _first_centroids(v)).select("id", "cluster_id", F.round("dist2", 6).alias("dist2"))


@query(f"""WITH {_V}, {_C}, {_NEAR}, e AS (SELECT cluster_id, unnest(range(len(x)))::INT AS f, unnest(x) AS w FROM a WHERE rn = 1)
    SELECT cluster_id, f, round(avg(w), 6) AS x FROM e GROUP BY 1, 2""")
def kmeans_lloyd(spark, d: str) -> DataFrame:
    v = vectors(spark, d)
    return cl.lloyd(v, _first_centroids(v), 1).select("cluster_id", F.posexplode("center").alias("f", "x")).withColumn("x", F.round("x", 6))


@query(f"""WITH {_V}, {_C}, {_NEAR} SELECT round(sum(dist2), 4) AS inertia, round(sum(sqrt(dist2)), 4) AS cost FROM a WHERE rn = 1""")
def inertia(spark, d: str) -> DataFrame:
    v = vectors(spark, d)
    a = cl.assigned(v, _first_centroids(v))
    return cl.inertia(a).crossJoin(cl.inertia(a, squared=False).withColumnRenamed("inertia", "cost")).select(F.round("inertia", 4).alias("inertia"), F.round("cost", 4).alias("cost"))


@query(f"""WITH {_V}, {_C}, {_NEAR}, n AS (SELECT c.cluster_id, count(a.id) AS cnt FROM c LEFT JOIN a ON a.cluster_id = c.cluster_id AND rn = 1 GROUP BY 1) SELECT * FROM n""")
def cluster_sizes(spark, d: str) -> DataFrame:
    v = vectors(spark, d)
    c = _first_centroids(v)
    return cl.cluster_sizes(cl.assigned(v, c), c)


@query()
def min_cluster_merge(spark, d: str) -> DataFrame:
    v = vectors(spark, d)
    c = cl.merged(v, _first_centroids(v), v.count() // 10)
    return cl.cluster_sizes(cl.assigned(v, c), c)


@query(f"""WITH {_V}, {_C}, {_NEAR} SELECT id, max(cluster_id) FILTER (rn = 1) AS m1, round(max(sqrt(dist2)) FILTER (rn = 1), 6) AS d1,
    max(cluster_id) FILTER (rn = 2) AS m2, round(max(sqrt(dist2)) FILTER (rn = 2), 6) AS d2 FROM a WHERE rn <= 2 GROUP BY 1""")
def medoid_assign(spark, d: str) -> DataFrame:
    v = vectors(spark, d)
    return cl.two_nearest(v, _first_centroids(v)).select("id", "m1", F.round("d1", 6).alias("d1"), "m2", F.round("d2", 6).alias("d2"))


@query(f"""WITH {_V}, {_C}, {_NEAR}, p AS (SELECT x AS center FROM v ORDER BY id LIMIT 1 OFFSET 8),
    n AS (SELECT v.id, v.x, max(cluster_id) FILTER (rn = 1) m1, max(sqrt(dist2)) FILTER (rn = 1) d1, max(sqrt(dist2)) FILTER (rn = 2) d2 FROM a JOIN v USING (id) GROUP BY 1, 2),
    q AS (SELECT m1, d1, d2, sqrt({_D2.replace("v.x", "n.x")}) AS e FROM n, p c)
    SELECT round(sum(CASE WHEN m1 = 3 THEN least(e, d2) - d1 ELSE least(e - d1, 0) END), 5) AS delta FROM q""")
def clarans_cost(spark, d: str) -> DataFrame:
    v = vectors(spark, d)
    new = v.orderBy("id").offset(8).limit(1).first().x
    near = cl.two_nearest(v, _first_centroids(v))
    return cl.swap_cost(near, 3, F.array(*[F.lit(float(e)) for e in new])).select(F.round("delta", 5).alias("delta"))


@query(f"""WITH RECURSIVE {_V}, p AS MATERIALIZED (SELECT 18 * r + i - 1 AS place, x FROM (
        SELECT r, x, row_number() OVER (PARTITION BY r ORDER BY md5('37:0:' || r || ':' || id), id) AS i FROM v, range(60) q(r)) WHERE i <= 18),
    s AS (SELECT 8 AS place, 0 AS t, 0 AS failed, (SELECT list(x ORDER BY place) FROM p WHERE place < 8) AS centers
    UNION ALL SELECT place + 1, t + fresh::INT, CASE WHEN delta < -1e-12 THEN 0 ELSE failed + fresh::INT END, CASE WHEN delta < -1e-12 THEN swapped ELSE centers END FROM (
        SELECT place, t, failed, centers, swapped, fresh, sum(CASE WHEN fresh THEN list_min(list_transform(swapped, lambda c: list_distance(c, v.x))) - list_min(list_transform(centers, lambda c: list_distance(c, v.x))) ELSE 0 END) AS delta
        FROM (SELECT s.*, NOT list_contains(centers, p.x) AS fresh, list_transform(range(8), lambda m: CASE WHEN m = (37 + t) % 8 THEN p.x ELSE centers[m + 1] END) AS swapped
            FROM s JOIN p ON p.place = s.place WHERE failed < 10), v GROUP BY ALL))
    SELECT m::INT AS cluster_id, list_transform(centers[m + 1], lambda e: round(e, 6)) AS center FROM (FROM s ORDER BY place DESC LIMIT 1), range(8) r(m)""")
def clarans_medoids(spark, d: str) -> DataFrame:
    return cl.clarans(vectors(spark, d), 8, 10).select("cluster_id", rounded(F.col("center"), 6).alias("center"))


_CELLS = f"""{_V}, e AS (SELECT id, unnest(range(len(x)))::INT AS f, unnest(x) AS w FROM v), s AS (SELECT f, min(w) lo, max(w) hi FROM e GROUP BY 1),
    m AS (SELECT id, f, (w - (lo - 1e-5)) / (hi - (lo - 1e-5) + 1e-5) AS x FROM e JOIN s USING (f)), b AS (SELECT id, f, ((x * 4) % 4)::DOUBLE AS q FROM m), bins AS (SELECT id, f, floor(q)::INT AS bin FROM b)"""


@query(f"WITH {_CELLS} SELECT id, f, round(x, 6) AS x FROM m")
def minmax_normalize(spark, d: str) -> DataFrame:
    return cl.min_max(vectors(spark, d)).withColumn("x", F.round("x", 6))


@query(f"WITH {_CELLS} SELECT id, f, bin FROM bins")
def clique_bins(spark, d: str) -> DataFrame:
    return cl.bins(cl.min_max(vectors(spark, d)), 4)


_UNITS = f"{_CELLS}, u AS (SELECT f, bin, count(*) AS cnt FROM bins GROUP BY 1, 2 HAVING count(*) > 0.4 * (SELECT count(*) FROM v))"


@query(f"WITH {_UNITS} SELECT f, bin, cnt FROM u")
def clique_dense_1d(spark, d: str) -> DataFrame:
    v = vectors(spark, d)
    return cl.dense_units(cl.bins(cl.min_max(v), 4), 0.4 * v.count()).select("unit.f", "unit.bin", "cnt").select(F.col("f")[0].alias("f"), F.col("bin")[0].alias("bin"), "cnt")


@query(f"""WITH {_UNITS}, h AS (SELECT id, f, bin FROM bins JOIN u USING (f, bin))
    SELECT a.f AS f1, a.bin AS bin1, b.f AS f2, b.bin AS bin2, count(*) AS cnt FROM h a JOIN h b ON a.id = b.id AND a.f < b.f GROUP BY 1, 2, 3, 4 HAVING count(*) > 0.4 * (SELECT count(*) FROM v)""")
def clique_dense_2d(spark, d: str) -> DataFrame:
    v = vectors(spark, d)
    b, least = cl.bins(cl.min_max(v), 4), 0.4 * v.count()
    u = F.col("unit")
    return cl.next_units(b, cl.dense_units(b, least), 2, least).select(u[0].f.alias("f1"), u[0].bin.alias("bin1"), u[1].f.alias("f2"), u[1].bin.alias("bin2"), "cnt")


@query()
def clique_clusters(spark, d: str) -> DataFrame:
    return cl.clique(vectors(spark, d), 4, 0.4).groupBy("size", "cluster").agg(F.count("*").alias("units"), F.sum("cnt").alias("points"))


# message passing ----------------------------------------------------------------------------------------------------------

_H = "h AS (SELECT graph_id, vertex_id, label, unnest([0, 1, 2])::INT AS f FROM vertices), x AS (SELECT graph_id, vertex_id, f, (f = label)::INT::DOUBLE AS x FROM h)"


def _states(g) -> DataFrame:
    hot = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: (i == F.col("label")).cast("double"))
    return g.vertices.select("graph_id", "vertex_id", hot.alias("h"))


def _long(h: DataFrame, keys: list[str], column: str = "h") -> DataFrame:
    return h.select(*keys, F.posexplode(column).alias("f", "x")).withColumn("x", F.round("x", 6))


@query(_sql(GRAPHS, _H, """s AS (SELECT graph_id, vertex_id, f, 1.5 * x AS x FROM x UNION ALL SELECT e.graph_id, e.dst, f, x FROM x JOIN edges e ON x.graph_id = e.graph_id AND x.vertex_id = e.src)""",
    select="SELECT graph_id, vertex_id, f, round(sum(x), 6) AS x FROM s GROUP BY 1, 2, 3"))
def gin_sum(spark, d: str) -> DataFrame:
    g = customer_graphs(spark, d)
    return _long(le.gin_sum(_states(g), g.edges, 0.5), ["graph_id", "vertex_id"])


@query(_sql(GRAPHS, _H, "g AS (SELECT v.graph_id, vertex_id, 1 + count(e.dst) AS deg FROM vertices v LEFT JOIN edges e ON v.graph_id = e.graph_id AND vertex_id = src GROUP BY 1, 2)",
    "y AS (SELECT graph_id, vertex_id, f, x / sqrt(deg) AS x FROM x JOIN g USING (graph_id, vertex_id))",
    "s AS (SELECT * FROM y UNION ALL SELECT e.graph_id, e.dst, f, x FROM y JOIN edges e ON y.graph_id = e.graph_id AND y.vertex_id = e.src)",
    select="SELECT graph_id, vertex_id, f, round(sum(x) / sqrt(any_value(deg)), 6) AS x FROM s JOIN g USING (graph_id, vertex_id) GROUP BY 1, 2, 3"))
def gcn_norm_sum(spark, d: str) -> DataFrame:
    g = customer_graphs(spark, d)
    return _long(le.gcn_sum(_states(g), g.edges), ["graph_id", "vertex_id"])


@query(_sql(GRAPHS, _H, select="SELECT graph_id, f, sum(x) AS x FROM x GROUP BY 1, 2"))
def graph_sum_pool(spark, d: str) -> DataFrame:
    return _long(le.pooled(_states(customer_graphs(spark, d))), ["graph_id"])


def _mlp(seed: int):
    """Fixed small weights."""
    def w(i: int, j: int) -> float:
        return ((7 * i + 5 * j + 3 * seed) % 11 - 4) / 16

    layer = [[w(i, j) for j in range(3)] for i in range(3)], [0.125 * (i - 1) for i in range(3)]
    return layer, layer


@query()
def gin_forward(spark, d: str) -> DataFrame:
    g = gr.settled(customer_graphs(spark, d))
    return _long(le.gin_forward(_states(g), g.edges, [_mlp(1), _mlp(2)]), ["graph_id"], "pools")


@query()
def gin_forward_partitioned(spark, d: str) -> DataFrame:
    g = gr.settled(customer_graphs(spark, d))
    return _long(models.forward_by_label(g, 3, [{c: _mlp(c) for c in range(3)}]), ["graph_id"], "pools")


@query()
def train_models(spark, d: str) -> DataFrame:
    g = gr.settled(customer_graphs(spark, d))
    x = models.forward_by_label(g, 3, [None]).withColumnRenamed("pools", "features")
    rows = ex.kfold(g.graphs, 3).join(x, "graph_id").join(g.graphs, "graph_id").select("fold", "role", "features", "y")
    return le.train_grid(rows, ex.grid(spark, lr=[0.1, 0.5], epochs=[20]))


@query(_sql(GRAPHS, bfs(1), "n AS (SELECT graph_id, root, count(*) c FROM dist GROUP BY 1, 2)", select="SELECT a.graph_id, count(*) AS n, count(DISTINCT c) AS kinds FROM n a GROUP BY 1"))
def vector_equality_pairs(spark, d: str) -> DataFrame:
    """Kinds of equal neighbourhood sizes by graph, as the SQL fixes them; class_vector_pairs compares vectors."""
    n = pa.graph_distances(gr.settled(customer_graphs(spark, d)), 1).groupBy("graph_id", "root").agg(F.count("*").alias("c"))
    return n.groupBy("graph_id").agg(F.count("*").alias("n"), F.count_distinct("c").alias("kinds"))


@query(_sql(GRAPHS, "reps AS (SELECT y, min(graph_id) graph_id FROM graphs GROUP BY 1)", "roots AS (SELECT y, graph_id, min(vertex_id) root FROM reps JOIN vertices USING (graph_id) GROUP BY 1, 2)",
    "near AS (SELECT y, graph_id, label FROM roots JOIN edges USING (graph_id) JOIN vertices v USING (graph_id) WHERE src = root AND v.vertex_id = dst AND dst <> root)",
    "f AS (SELECT r.y, r.graph_id, count(*) FILTER (label = 0) x, count(*) FILTER (label = 1) y1, count(*) FILTER (label = 2) z FROM roots r LEFT JOIN near n ON r.graph_id = n.graph_id GROUP BY 1, 2)",
    select="SELECT a.y AS class_a, a.graph_id AS graph_a, b.y AS class_b, b.graph_id AS graph_b FROM f a JOIN f b ON a.y < b.y AND a.x = b.x AND a.y1 = b.y1 AND a.z = b.z"))
def class_vector_pairs(spark, d: str) -> DataFrame:
    """Pairs of classes whose representatives have equal counts of neighbours by label."""
    g = customer_graphs(spark, d)
    first = g.graphs.groupBy("y").agg(F.min("graph_id").alias("graph_id")).select("graph_id")
    g = gr.Graphs(*(t.join(F.broadcast(first), "graph_id", "left_semi") for t in (g.vertices, g.edges, g.graphs)))
    counts = ft.vertex_counts(g, pa.graph_distances(g, 1)).withColumn("cnt", F.when(F.col("d") == 1, F.col("cnt")).otherwise(0)).groupBy("graph_id", "vertex_id", "label").agg(F.sum("cnt").alias("cnt"))
    found = ft.dense(counts, ["graph_id", "vertex_id"], F.col("label"), 3)
    none = F.array(*[F.lit(0.0)] * 3)
    v = g.vertices.select("graph_id", "vertex_id").join(found, ["graph_id", "vertex_id"], "left").withColumn("features", F.coalesce("features", none))
    return ft.equal_representatives(v, g.graphs)


# geometric features ----------------------------------------------------------------------------------------------------


@query()
def theta_numbers(spark, d: str) -> DataFrame:
    g = gr.settled(customer_graphs(spark, d))
    return lo.thetas(lo.graph_lists(g)).withColumn("theta", F.round("theta", 4))


@query()
def cone_features(spark, d: str) -> DataFrame:
    g = gr.settled(customer_graphs(spark, d))
    return lo.cones(lo.graph_lists(g), range(2, 5), 12)


@query(_sql(GRAPHS, """n AS (SELECT graph_id, count(*) n FROM vertices GROUP BY 1), d AS (SELECT graph_id, n, unnest([1, 2, 3]) d FROM n),
    c AS (SELECT graph_id, d, CASE d WHEN 1 THEN n WHEN 2 THEN n * (n - 1) // 2 ELSE n * (n - 1) * (n - 2) // 6 END c FROM d WHERE d <= n),
    f AS (SELECT graph_id, d, (100 * c // sum(c) OVER (PARTITION BY graph_id))::BIGINT k, row_number() OVER (PARTITION BY graph_id ORDER BY d DESC) i FROM c)""", select="""
    SELECT graph_id, d, k + (i <= 100 - sum(k) OVER (PARTITION BY graph_id))::BIGINT AS samples FROM f"""))
def cone_sample_counts(spark, d: str) -> DataFrame:
    """Subsets of one to three vertices to draw from each graph, of 100 in all."""
    return lo.subset_counts(customer_graphs(spark, d).vertices, range(1, 4), 100)


@query(_sql(GRAPHS, "n AS (SELECT graph_id, count(*) n FROM vertices GROUP BY 1), d AS (SELECT graph_id, n, unnest([2, 3]) d FROM n)",
    "c AS (SELECT graph_id, n, d, CASE d WHEN 2 THEN n * (n - 1) // 2 ELSE n * (n - 1) * (n - 2) // 6 END c FROM d WHERE d <= n)",
    "f AS (SELECT *, (12 * c // sum(c) OVER (PARTITION BY graph_id))::BIGINT k, row_number() OVER (PARTITION BY graph_id ORDER BY d DESC) i FROM c)",
    "w AS (SELECT *, least(c, k + (i <= 12 - sum(k) OVER (PARTITION BY graph_id))::BIGINT) AS want FROM f)",
    """r AS (SELECT graph_id, d, unnest(list_reduce(list_transform(range(c - want, c), lambda j: [j]), lambda taken, j: list_append(taken, CASE WHEN list_contains(taken,
            ('0x' || substr(md5('0:' || graph_id || ':' || d || ':' || j[1]), 1, 15))::BIGINT % (j[1] + 1)) THEN j[1] ELSE ('0x' || substr(md5('0:' || graph_id || ':' || d || ':' || j[1]), 1, 15))::BIGINT % (j[1] + 1) END),
            []::BIGINT[])) AS place FROM w)""",
    "m AS (SELECT max(n) AS m FROM n)", "pairs AS (SELECT 2 AS d, a + b * (b - 1) // 2 AS place, [a, b] AS subset FROM m, range(m) x(a), range(m) y(b) WHERE a < b)",
    "triples AS (SELECT 3 AS d, p.place + c * (c - 1) * (c - 2) // 6 AS place, list_append(subset, c) AS subset FROM m, pairs p, range(m) z(c) WHERE c > subset[2])",
    select="SELECT graph_id, r.d::BIGINT AS d, subset FROM r JOIN (FROM pairs UNION ALL FROM triples) t ON t.d = r.d AND t.place = r.place"))
def cone_subsets(spark, d: str) -> DataFrame:
    """The subsets that cone features of each graph draw, as places of its vertices in the order of their ids."""
    return lo.subsets(customer_graphs(spark, d).vertices, range(2, 4), 12)


@query(_WL.format(""", n AS (SELECT graph_id, colour, count(*) AS cnt FROM wl WHERE round = 1 GROUP BY ALL), a AS (SELECT colour, row_number() OVER (ORDER BY colour) AS slot FROM (SELECT DISTINCT colour FROM n)),
    g AS (SELECT graph_id, map_from_entries(list((slot, cnt))) AS m FROM n JOIN a USING (colour) GROUP BY 1)
    SELECT graph_id, list_transform(range(1, (SELECT count(*) FROM a) + 1), lambda i: coalesce(m[i], 0)::DOUBLE) AS features FROM g"""))
def wl1_vectors(spark, d: str) -> DataFrame:
    """Counts of the colours of round 1 over the alphabet of all graphs' colours."""
    counts = cut(ft.wl1_histogram(gr.settled(customer_graphs(spark, d)), 1).where("round = 1"))
    alphabet = ft.colour_alphabet(counts)
    return ft.dense_counts(ft.colour_slots(counts, alphabet), alphabet.count()).select("graph_id", "features")


@query(_WL.format(""", n AS (SELECT graph_id, round, colour, count(*) AS cnt FROM wl GROUP BY ALL), a AS (SELECT round, colour, row_number() OVER (PARTITION BY round ORDER BY colour) - 1 AS slot FROM (SELECT DISTINCT round, colour FROM n))
    SELECT graph_id, round::INT AS round, list(slot ORDER BY slot) AS slots, list(cnt ORDER BY slot) AS counts FROM n JOIN a USING (round, colour) GROUP BY 1, 2"""))
def wl1_slots(spark, d: str) -> DataFrame:
    """Counts of the colours of rounds 0 to 2, each round with its own alphabet, as slots and counts."""
    counts = cut(ft.wl1_histogram(gr.settled(customer_graphs(spark, d)), 2))
    return ft.colour_slots(counts, ft.colour_alphabet(counts)).select("graph_id", "round", "slots", "counts")
