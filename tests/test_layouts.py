"""Line numbers over parts, range joins, the two file layouts, and stored stages."""

import gzip

import pytest
from pyspark.sql import functions as F

from graphloom.operators import graphs as gr
from graphloom.plans import reuse
from graphloom.sources import layouts


@pytest.fixture
def small_parts(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_lines_are_numbered_over_blocks_and_parts(spark, tmp_path, small_parts):
    lines = [f"row {i}" * (1 + i % 5) for i in range(300)]
    (tmp_path / "one.txt").write_text("\n".join(lines) + "\n")
    got = {r.line: r.value for r in layouts.numbered_lines(spark, str(tmp_path / "one.txt")).collect()}
    assert got == dict(enumerate(lines, 1))
    (tmp_path / "parts").mkdir()
    for k in range(3):
        (tmp_path / "parts" / f"part-{k}.txt").write_text("".join(x + "\n" for x in lines[100 * k : 100 * k + 100]))
    got = {r.line: r.value for r in layouts.numbered_lines(spark, str(tmp_path / "parts"), first=0).collect()}
    assert got == dict(enumerate(lines))


def test_rows_are_dealt_to_intervals(spark):
    sizes = [0, 3, 0, 1000, 1, 0, 255, 256, 257, 0]
    counts = spark.createDataFrame(list(enumerate(sizes)), "graph_id long, n long")
    intervals = layouts.prefix_sums(counts, "graph_id", "n")
    want, start = [], 0
    for g, n in enumerate(sizes):
        want += [(p, g, start) for p in range(start, start + n)]
        start += n
    assert [r.start for r in intervals.orderBy("graph_id").collect()] == [sum(sizes[:g]) for g in range(len(sizes))]
    rows = layouts.dealt_to(spark.range(sum(sizes) + 5).withColumnRenamed("id", "place"), "place", intervals)
    assert sorted((r.place, r.graph_id, r.start) for r in rows.collect()) == want


def test_a_benchmark_as_handed_out(spark, tmp_path):
    put = lambda what, text: (tmp_path / f"T_{what}.txt").write_text(text)
    put("A", "1, 2\n2, 1\n2, 3\n3, 2\n3, 3\n2, 3\n4, 5\n5, 4\n")
    put("graph_indicator", "1\n1\n1\n2\n2\n")
    put("graph_labels", "7\n-1\n")
    put("node_labels", "3\n4\n3\n5\n3\n")
    put("node_attributes", "1.5, 2\n0,0\n1, 1\n2, 2\n-3.25, 1e2\n")
    g = layouts.read_benchmark(spark, str(tmp_path), "T", attributes=True)
    assert sorted(map(tuple, g.edges.collect())) == [(1, 1, 2), (1, 2, 1), (1, 2, 3), (1, 3, 2), (2, 4, 5), (2, 5, 4)]
    assert sorted((r.graph_id, r.vertex_id, r.label, tuple(r.attributes)) for r in g.vertices.collect()) == [(1, 1, 0, (1.5, 2.0)), (1, 2, 1, (0.0, 0.0)), (1, 3, 0, (1.0, 1.0)), (2, 4, 2, (2.0, 2.0)), (2, 5, 0, (-3.25, 100.0))]
    assert sorted(map(tuple, g.graphs.collect())) == [(1, 1), (2, 0)]


def test_an_archive_as_handed_out(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "split" / "scaffold").mkdir(parents=True)
    put = lambda what, text: gzip.open(tmp_path / f"{what}.csv.gz", "wt").write(text)
    put("raw/num-node-list", "3\n1\n2\n")
    put("raw/num-edge-list", "2\n0\n1\n")
    put("raw/edge", "0,1\n1,2\n0,1\n")
    put("raw/node-feat", "5,0\n6,1\n5,0\n7,0\n5,1\n6,0\n")
    put("raw/graph-label", "1\n0\n1\n")
    for name, ids in (("train", "0\n"), ("valid", "2\n"), ("test", "1\n")):
        put(f"split/scaffold/{name}", ids)
    g = layouts.read_archive(spark, str(tmp_path))
    assert sorted(map(tuple, g.edges.collect())) == [(0, 0, 1), (0, 1, 0), (0, 1, 2), (0, 2, 1), (2, 0, 1), (2, 1, 0)]
    assert sorted(map(tuple, g.vertices.collect())) == [(0, 0, 5), (0, 1, 6), (0, 2, 5), (1, 0, 7), (2, 0, 5), (2, 1, 6)]
    assert sorted(map(tuple, layouts.read_archive_splits(spark, str(tmp_path), "scaffold").collect())) == [(0, "test", 1), (0, "train", 0), (0, "val", 2)]


def test_layouts_keep_graphs_without_edges(spark, tmp_path):
    v = spark.createDataFrame([(4, 9, 2), (4, 7, 0), (6, 1, 1), (9, 5, 0), (9, 6, 0)], "graph_id long, vertex_id long, label int")
    e = gr.symmetric(spark.createDataFrame([(4, 7, 9), (9, 5, 6)], "graph_id long, src long, dst long"))
    g = gr.Graphs(v, e, spark.createDataFrame([(4, 1), (6, 0), (9, 1)], "graph_id long, y int"))
    layouts.write_archive(g, str(tmp_path / "archive"))
    back = layouts.read_archive(spark, str(tmp_path / "archive"))
    assert sorted(map(tuple, back.vertices.collect())) == [(0, 0, 0), (0, 1, 2), (1, 0, 1), (2, 0, 0), (2, 1, 0)]
    assert sorted(map(tuple, back.edges.collect())) == [(0, 0, 1), (0, 1, 0), (2, 0, 1), (2, 1, 0)]
    layouts.write_benchmark(g, str(tmp_path / "benchmark"), "T")
    back = layouts.read_benchmark(spark, str(tmp_path / "benchmark"), "T")
    assert sorted(map(tuple, back.vertices.collect())) == [(1, 1, 0), (1, 2, 2), (2, 3, 1), (3, 4, 0), (3, 5, 0)]
    assert sorted(map(tuple, back.edges.collect())) == [(1, 1, 2), (1, 2, 1), (3, 4, 5), (3, 5, 4)]
    assert sorted(map(tuple, back.graphs.collect())) == [(1, 1), (2, 0), (3, 1)]


def test_a_stage_is_computed_once(spark, tmp_path):
    source, store, made = str(tmp_path / "in"), str(tmp_path / "store"), []
    spark.range(10).write.parquet(source)

    def run(parameters, fresh=False):
        def make():
            made.append(parameters["add"])
            return spark.read.parquet(source).select((F.col("id") + parameters["add"]).alias("x"))

        return sorted(r.x for r in reuse.stage(spark, store, "added", [source], parameters, make, fresh).collect())

    assert run({"add": 1}) == run({"add": 1}) == list(range(1, 11)) and made == [1]
    assert run({"add": 2}) == list(range(2, 12)) and made == [1, 2]
    assert run({"add": 1}, fresh=True) == list(range(1, 11)) and made == [1, 2, 1]
    spark.range(10, 12).write.mode("append").parquet(source)
    assert run({"add": 1}) == list(range(1, 13)) and made == [1, 2, 1, 1]
    assert not [p for p in (tmp_path / "store").iterdir() if p.name.startswith("_aside")]


def test_a_failed_stage_leaves_nothing_under_its_key(spark, tmp_path):
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    spark.range(3).write.parquet(source)
    fails = lambda: spark.range(3).select(F.raise_error(F.lit("lost")).alias("x"))
    with pytest.raises(Exception, match="lost"):
        reuse.stage(spark, store, "s", [source], {}, fails).count()
    assert reuse.stage(spark, store, "s", [source], {}, lambda: spark.range(3).withColumnRenamed("id", "x")).count() == 3


def test_packed_graphs_write_the_same_lines(spark, tmp_path):
    """Files of packed graphs hold what the joins write, and no vertex is numbered by a window over all of them."""
    ids = {4: [7, 3, 12, 5], 9: [1], 11: [30, 20, 10]}
    v = spark.createDataFrame([(g, x, x % 3) for g, xs in ids.items() for x in xs], "graph_id long, vertex_id long, label int")
    e = spark.createDataFrame([(4, 3, 7), (4, 12, 3), (4, 5, 12), (11, 10, 30)], "graph_id long, src long, dst long")
    plain = gr.Graphs(v, gr.symmetric(e), spark.createDataFrame([(4, 1), (9, 0), (11, 2)], "graph_id long, y int"))
    settled = gr.settled(plain)
    assert settled.rest is None and layouts._ordered_rows(plain) is None and layouts._ordered_rows(settled).count() == 3
    read = lambda p: [x for f in sorted(p.glob("part-*")) for x in (gzip.open(f, "rt") if f.suffix == ".gz" else open(f)).read().split("\n")[:-1]]  # noqa: E731, SIM115
    for name, g in (("plain", plain), ("settled", settled)):
        layouts.write_benchmark(g, str(tmp_path / name), "T")
        layouts.write_archive(g, str(tmp_path / name))
    files = [f"T_{x}.txt" for x in ("A", "graph_indicator", "graph_labels", "node_labels")] + [f"raw/{x}.csv.gz" for x in ("edge", "node-feat", "num-node-list", "num-edge-list", "graph-label")]
    for f in files:
        assert read(tmp_path / "plain" / f) == read(tmp_path / "settled" / f) != [], f
