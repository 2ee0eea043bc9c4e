"""Graph and vector views over the order tables: a graph for each customer, its vertices the parts ordered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators.graphs import Graphs, symmetric


#: Lines of orders that a task takes: the number of tasks grows with the table.
LINES = 250_000
#: Rows of parts that may be sent to all tasks, of about 80 bytes each in the driver, where a source is read with bounded memory of the driver.
SENT = 500_000


def customer_graphs(spark: SparkSession, sf_dir: str, sent: int | None = None) -> Graphs:
    """Edges between the parts of consecutive lines of an order; label p_size % 3; class the rank of the market segment.

    Lines meet their orders by order and are then dealt by customer; what follows by graph needs no other exchange. sent: where there are more
    parts, lines are dealt to these; else Spark goes by the size of the compressed file, and the driver holds a table many times as large."""
    table = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    lineitem = table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lineitem.count() // LINES))
    orders = table("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("graph_id"))
    li = lineitem.repartition(tasks, "l_orderkey").join(orders.repartition(tasks, "l_orderkey"), "l_orderkey")
    follows = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    li = li.select("graph_id", F.col("l_partkey").alias("src"), follows.alias("dst"))
    part = table("part").select(F.col("p_partkey").alias("vertex_id"), (F.col("p_size") % 3).cast("int").alias("label"))
    if sent is not None and part.count() > sent:
        part = part.hint("merge")
    known = part.select(F.col("vertex_id").alias("src"), "label", F.lit(True).alias("vertex"))
    lines = li.join(known, "src", "left").withColumn("vertex", F.coalesce("vertex", F.lit(False))).repartition(tasks, "graph_id")
    li = li.repartition(tasks, "graph_id")
    edges = symmetric(li.where("dst IS NOT NULL").select("graph_id", "src", "dst"))
    vertices = li.select("graph_id", F.col("src").alias("vertex_id")).distinct().join(part, "vertex_id").select("graph_id", "vertex_id", "label")
    cust = table("customer").select(F.col("c_custkey").alias("graph_id"), F.col("c_mktsegment").alias("segment"))
    classes = cust.select("segment").distinct().withColumn("y", (F.row_number().over(Window.orderBy("segment")) - 1).cast("int"))
    classes = cust.join(F.broadcast(classes), "segment").select("graph_id", "y")
    graphs = classes.join(vertices.select("graph_id").distinct(), "graph_id", "left_semi")
    return Graphs(vertices, edges, graphs, lines, classes)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x array<double>, label."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("x"), "label")
