"""Shortest-path histograms, dense vectors and Weisfeiler-Leman colours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import packed, paths
from graphloom.plans import cut


def pair_counts(g, nodes: DataFrame, dist: DataFrame) -> DataFrame:
    """graph_id, root, l1, l2, d, cnt: pairs of a root's nodes by sorted labels and induced distance, -1 if unreachable.

    Unreachable pairs are counted as all pairs of a label pair less the reached ones, so they are never enumerated."""
    label = g.vertices.select("graph_id", "vertex_id", "label")
    a, b = label.select("graph_id", F.col("vertex_id").alias("u"), F.col("label").alias("la")), label.select("graph_id", F.col("vertex_id").alias("v"), F.col("label").alias("lb"))
    near = dist.where("u > v").join(a, ["graph_id", "u"]).join(b, ["graph_id", "v"])
    reached = near.groupBy("graph_id", "root", F.least("la", "lb").alias("l1"), F.greatest("la", "lb").alias("l2"), "d").agg(F.count("*").alias("cnt"))
    per = nodes.join(b, ["graph_id", "v"]).groupBy("graph_id", "root", "lb").agg(F.count("*").alias("n"))
    x, y = per.withColumnsRenamed({"lb": "l1", "n": "n1"}), per.withColumnsRenamed({"lb": "l2", "n": "n2"})
    every = x.join(y, ["graph_id", "root"]).where("l1 <= l2").select("graph_id", "root", "l1", "l2", F.expr("IF(l1 = l2, n1 * (n1 - 1) DIV 2, n1 * n2)").alias("all"))
    reached = cut(reached)
    found = reached.groupBy("graph_id", "root", "l1", "l2").agg(F.sum("cnt").alias("found"))
    rest = every.join(found, ["graph_id", "root", "l1", "l2"], "left").select("graph_id", "root", "l1", "l2", F.lit(-1).alias("d"), (F.col("all") - F.coalesce("found", F.lit(0))).alias("cnt"))
    return reached.unionByName(rest.where("cnt > 0"))


def vertex_counts(g, dist: DataFrame) -> DataFrame:
    """graph_id, vertex_id, label, d, cnt: other vertices by label and distance, d = -1 for those not reached."""
    label = g.vertices.select("graph_id", F.col("vertex_id").alias("v"), "label")
    reached = cut(dist.where("root <> v").join(label, ["graph_id", "v"]).groupBy("graph_id", F.col("root").alias("vertex_id"), "label", "d").agg(F.count("*").alias("cnt")))
    per = g.vertices.groupBy("graph_id", "label").agg(F.count("*").alias("n"))
    found = reached.groupBy("graph_id", "vertex_id", "label").agg(F.sum("cnt").alias("found"))
    own = g.vertices.select("graph_id", "vertex_id", F.col("label").alias("own"))
    rest = own.join(per, "graph_id").join(found, ["graph_id", "vertex_id", "label"], "left")
    left = F.col("n") - F.coalesce("found", F.lit(0)) - (F.col("own") == F.col("label")).cast("long")
    rest = rest.select("graph_id", "vertex_id", "label", F.lit(-1).alias("d"), left.alias("cnt"))
    return reached.unionByName(rest.where("cnt > 0"))


def dense(counts: DataFrame, ids: list[str], slot, width: int, every: DataFrame | None = None) -> DataFrame:
    """ids + features array<double>: slot is the expression of the place of a count; places out of range are dropped. Rows of
    `every` (ids) without any count get zeros."""
    s = counts.withColumn("slot", slot.cast("int")).where(F.col("slot").between(0, width - 1))
    m = s.groupBy(*ids).agg(F.map_from_entries(F.collect_list(F.struct("slot", F.col("cnt").cast("double")))).alias("m"))
    if every is not None:
        m = every.select(*ids).join(m, ids, "left").withColumn("m", F.coalesce("m", F.expr("CAST(map() AS map<int, double>)")))
    return m.select(*ids, F.expr(f"transform(sequence(0, {width - 1}), i -> coalesce(try_element_at(m, i), 0D))").alias("features"))


def equal_representatives(vectors: DataFrame, graphs: DataFrame) -> DataFrame:
    """class_a, graph_a, class_b, graph_b: classes whose representatives, the first vertex of the first graph, have equal vectors.

    vectors: graph_id, vertex_id, features; graphs: graph_id, y. There is one row a class, so pairs are few."""
    first = F.struct("graph_id", "vertex_id", "features")
    r = cut(vectors.join(graphs.select("graph_id", "y"), "graph_id").groupBy("y").agg(F.min(first).alias("r")).select("y", "r.graph_id", "r.features"))
    a, b = (r.select(F.col("y").alias(f"class_{s}"), F.col("graph_id").alias(f"graph_{s}"), "features") for s in "ab")
    return a.join(b, "features").where("class_a < class_b").select("class_a", "graph_a", "class_b", "graph_b")


def editmask(vectors: DataFrame) -> DataFrame:
    """slot, used: whether any row has a value there."""
    return vectors.select(F.posexplode("features").alias("slot", "x")).groupBy("slot").agg(F.max((F.col("x") != 0).cast("int")).cast("boolean").alias("used"))


def cropped(vectors: DataFrame, mask: DataFrame) -> DataFrame:
    """Vectors with only the used slots. The mask has one row a slot, as few as a vector is wide."""
    used = sorted(r.slot for r in mask.where("used").collect())
    return vectors.withColumn("features", F.array(*[F.get("features", F.lit(i)) for i in used]) if used else F.array().cast("array<double>"))


def wl1(g, rounds: int) -> DataFrame:
    """graph_id, vertex_id, round, colour: md5 of the own colour and the sorted colours of the neighbours."""
    return g.by_parts(lambda rows: packed.colours(rows, rounds), lambda g: _joined_wl1(g, rounds))


def _joined_wl1(g, rounds: int) -> DataFrame:
    colours = cut(g.vertices.select("graph_id", "vertex_id", F.md5(F.col("label").cast("string")).alias("colour")))
    out = colours.withColumn("round", F.lit(0))
    for k in range(1, rounds + 1):
        near = g.edges.join(colours.withColumnRenamed("vertex_id", "dst"), ["graph_id", "dst"]).groupBy("graph_id", F.col("src").alias("vertex_id"))
        near = near.agg(F.array_join(F.array_sort(F.collect_list("colour")), ",").alias("near"))
        both = colours.join(near, ["graph_id", "vertex_id"], "left")
        colours = cut(both.select("graph_id", "vertex_id", F.md5(F.concat_ws("|", "colour", F.coalesce("near", F.lit("")))).alias("colour")))
        out = out.unionByName(colours.withColumn("round", F.lit(k)))
    return out


def histogram(colours: DataFrame) -> DataFrame:
    return colours.groupBy("graph_id", "round", "colour").agg(F.count("*").alias("cnt"))


def wl1_histogram(g, rounds: int) -> DataFrame:
    """histogram of wl1; a packed graph's is counted where it lies."""
    return g.by_parts(lambda rows: packed.colour_counts(rows, rounds).drop("squares"), lambda g: histogram(_joined_wl1(g, rounds)))


def wl1_normalised(g, rounds: int) -> DataFrame:
    """graph_id, round, colour, value: normalised_histogram of wl1 by graph and round."""
    keys = ["graph_id", "round", "colour"]

    def small(rows):
        return packed.colour_counts(rows, rounds).select(*keys, (F.col("cnt") / F.sqrt("squares")).alias("value"))

    return g.by_parts(small, lambda g: normalised_histogram(histogram(_joined_wl1(g, rounds)), keys[:2]).select(*keys, "value"))


#: Buckets of colours, by their first three hexadecimal digits, for which sums of sizes are taken.
DIGITS = 3


def colour_alphabet(counts: DataFrame) -> DataFrame:
    """round, colour, slot: the place of each distinct colour among its round's, in order, from 0; one alphabet for all graphs.

    Colours are digests, so their first digits deal them evenly: places are taken within buckets, beside sums over at most 16^DIGITS
    sizes a round, and no task sorts an alphabet."""
    one = counts.select("round", "colour").distinct().withColumn("bucket", F.substring("colour", 1, DIGITS))
    sizes = one.groupBy("round", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("round").orderBy("bucket")) - F.col("n")
    starts = sizes.select("round", "bucket", before.alias("start"))
    place = F.row_number().over(Window.partitionBy("round", "bucket").orderBy("colour")) - 1
    return one.withColumn("place", place).join(starts, ["round", "bucket"]).select("round", "colour", (F.col("start") + F.col("place")).alias("slot"))


def colour_slots(counts: DataFrame, alphabet: DataFrame, keys: tuple[str, ...] = ("graph_id",)) -> DataFrame:
    """keys, round, slots, counts: a histogram's colours as places of the alphabet, ascending. Colours outside it are left out, as for
    graphs that came after it was made; a graph with none of its colours has no row."""
    of = F.sort_array(F.collect_list(F.struct("slot", "cnt")))
    rows = counts.join(alphabet, ["round", "colour"]).groupBy(*keys, "round").agg(of.alias("s"))
    return rows.select(*keys, "round", F.transform("s", lambda s: s.slot).alias("slots"), F.transform("s", lambda s: s.cnt).alias("counts"))


def dense_counts(slots: DataFrame, width: int) -> DataFrame:
    """slots' rows with `features`: an array of so many doubles, one a place of the alphabet."""
    cells = F.map_from_arrays("slots", "counts")
    features = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long")), lambda i: F.coalesce(F.try_element_at("cells", i), F.lit(0)).cast("double"))
    return slots.withColumn("cells", cells).withColumn("features", features if width else F.array().cast("array<double>")).drop("cells", "slots", "counts")


def normalised_histogram(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Counts over the length of their key's vector of counts."""
    length = counts.groupBy(*keys).agg(F.sqrt(F.sum(F.col("cnt") * F.col("cnt"))).alias("length"))
    return counts.join(length, keys).withColumn("value", F.col("cnt") / F.col("length")).drop("length")


def frequencies(counts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, frequencies: the counts of a key's colours, largest first."""
    return counts.groupBy(*keys).agg(F.sort_array(F.collect_list("cnt"), False).alias("frequencies"))


def atomic_types(g, labels: int) -> DataFrame:
    """graph_id, v1, v2, type of every ordered pair of a graph: 2 * labels * l1 + 2 * l2 + (1 if adjacent)."""
    return g.by_parts(lambda rows: packed.pair_types(rows, labels), lambda g: pair_types(g.vertices, g.edges, labels, ["graph_id"]))


def pair_types(vertices: DataFrame, edges: DataFrame, labels: int, keys: list[str]) -> DataFrame:
    """atomic_types of the graphs that the keys tell apart: vertices (keys, vertex_id, label), edges (keys, src, dst)."""
    a = vertices.select(*keys, F.col("vertex_id").alias("v1"), F.col("label").alias("l1"))
    b = vertices.select(*keys, F.col("vertex_id").alias("v2"), F.col("label").alias("l2"))
    e = edges.select(*keys, F.col("src").alias("v1"), F.col("dst").alias("v2"), F.lit(1).alias("edge"))
    kind = 2 * labels * F.col("l1") + 2 * F.col("l2") + F.coalesce("edge", F.lit(0))
    return a.join(b, keys).join(e, [*keys, "v1", "v2"], "left").select(*keys, "v1", "v2", kind.cast("int").alias("type"))


def wl2(g, labels: int, rounds: int) -> DataFrame:
    """graph_id, v1, v2, colour of pairs after some rounds."""
    return pair_colours(atomic_types(g, labels), rounds, ["graph_id"])


def pair_colours(types: DataFrame, rounds: int, keys: list[str]) -> DataFrame:
    """keys, v1, v2, colour: md5 of the own colour and of the sorted colours in v1's row and v2's column. Rows and columns are
    gathered once a vertex, not once a pair."""
    c = cut(types.select(*keys, "v1", "v2", F.md5(F.col("type").cast("string")).alias("colour")))
    for _ in range(rounds):
        gathered = F.md5(F.array_join(F.array_sort(F.collect_list("colour")), ","))
        row, column = c.groupBy(*keys, "v1").agg(gathered.alias("row")), c.groupBy(*keys, "v2").agg(gathered.alias("column"))
        c = cut(c.join(row, [*keys, "v1"]).join(column, [*keys, "v2"]).select(*keys, "v1", "v2", F.md5(F.concat_ws("|", "colour", "row", "column")).alias("colour")))
    return c


def subgraph_wl2(g, nodes: DataFrame, labels: int, rounds: int) -> DataFrame:
    """graph_id, root, colour, cnt: how often each pair colour occurs in the subgraph that a root's nodes induce."""
    keys = ["graph_id", "root"]
    nodes = cut(nodes.select("graph_id", "root", "v"))
    own = nodes.join(g.vertices.withColumnRenamed("vertex_id", "v"), ["graph_id", "v"]).select(*keys, F.col("v").alias("vertex_id"), "label")
    colours = pair_colours(pair_types(own, paths.induced(nodes, g.edges), labels, keys), rounds, keys)
    return colours.groupBy(*keys, "colour").agg(F.count("*").alias("cnt"))


def ring_wl2(g, r: int, s: int, labels: int) -> DataFrame:
    """subgraph_wl2 after one round of the rings (r = 0: disks) of all vertices."""
    return g.by_parts(lambda rows: packed.pair_colours(rows, labels, (r, s)), lambda g: subgraph_wl2(g, paths.ring(paths.graph_distances(g, s), r, s), labels, 1))


def wl2_histogram(g, labels: int) -> DataFrame:
    """graph_id, colour, cnt of a graph's pairs after one round."""
    return g.by_parts(
        lambda rows: packed.pair_colours(rows, labels, None).drop("root"),
        lambda g: wl2(g, labels, 1).groupBy("graph_id", "colour").agg(F.count("*").alias("cnt")),
    )


def unique_vectors(vectors: DataFrame, key: str = "graph_id", column: str = "features") -> DataFrame:
    """key, unique_id (the least key with an equal vector), copies: how many rows have it."""
    same = vectors.groupBy(column).agg(F.min(key).alias("unique_id"), F.count("*").alias("copies"))
    return vectors.join(same, column).select(key, "unique_id", "copies")


def without_pairs(g, counts: DataFrame) -> DataFrame:
    """counts and, for each vertex whose subgraph is empty or has one vertex only, a row of -1 with cnt 0."""
    none = F.lit(-1)
    rest = g.vertices.select("graph_id", F.col("vertex_id").alias("root")).join(counts.select("graph_id", "root"), ["graph_id", "root"], "left_anti")
    kind = counts.schema
    return counts.unionByName(rest.select("graph_id", "root", *[none.cast(kind[c].dataType).alias(c) for c in ("l1", "l2", "d")], F.lit(0).cast("long").alias("cnt")))


def ring_cells(g, r: int, s: int, depth: int | None = None, roots: DataFrame | None = None) -> DataFrame:
    """graph_id, root, cells: pair_counts of the rings of vertices at distance r to s (r = 0: disks), a list (l1, l2, d, cnt) a root."""

    def joined(g) -> DataFrame:
        nodes = cut(paths.ring(paths.graph_distances(g, s, roots), r, s))
        counts = pair_counts(g, nodes, paths.induced_distances(nodes, g.edges, depth))
        return counts.groupBy("graph_id", "root").agg(F.collect_list(F.struct("l1", "l2", "d", "cnt")).alias("cells"))

    return g.by_parts(lambda rows: packed.pair_cells(rows, r, s, depth, roots), joined)


def disk_sp(g, k: int, roots: DataFrame | None = None) -> DataFrame:
    """pair_counts of the k-disks of all vertices, or of the given roots (graph_id, root)."""
    return ring_sp(g, 0, k, 2 * k, roots)


def ring_sp(g, r: int, s: int, depth: int | None = None, roots: DataFrame | None = None) -> DataFrame:
    """pair_counts of the rings of vertices at distance r to s."""
    return ring_cells(g, r, s, depth, roots).select("graph_id", "root", F.inline("cells"))


def vertex_cells(g, roots: DataFrame | None = None) -> DataFrame:
    """graph_id, vertex_id, cells: vertex_counts over all distances, a list (label, d, cnt) for each vertex, or each of the roots."""

    def joined(g) -> DataFrame:
        every = g.vertices.select("graph_id", "vertex_id")
        if roots is not None:
            every = every.join(roots.select("graph_id", F.col("root").alias("vertex_id")).distinct(), ["graph_id", "vertex_id"], "left_semi")
        counts = vertex_counts(g, paths.graph_distances(g, None, roots)).groupBy("graph_id", "vertex_id").agg(F.collect_list(F.struct("label", "d", "cnt")).alias("cells"))
        none = F.array().cast("array<struct<label: int, d: int, cnt: long>>")
        return every.join(counts, ["graph_id", "vertex_id"], "left").withColumn("cells", F.coalesce("cells", none))

    return g.by_parts(lambda rows: packed.vertex_cells(rows, roots), joined)


def vertex_sp(g) -> DataFrame:
    """vertex_counts over all distances."""
    return vertex_cells(g).select("graph_id", "vertex_id", F.inline("cells"))


def vertex_sp_vectors(g, labels: int, most: int, roots: DataFrame | None = None) -> DataFrame:
    """graph_id, vertex_id, features: counts of other vertices by (label, distance), distances -1 and 1 to `most`. Greater distances have
    no slot and aren't counted; a vertex that counts nothing has zeros."""
    ids, width = ["graph_id", "vertex_id"], labels * (most + 1)

    def joined(g) -> DataFrame:
        cells = vertex_cells(g, roots)
        counts = cells.select(*ids, F.inline("cells")).where(F.col("d") <= most)
        return dense(counts, ids, F.col("label") * (most + 1) + F.greatest("d", F.lit(0)), width, cells)

    return g.by_parts(lambda rows: packed.vertex_cells(rows, roots, (lambda label, d: (label * (most + 1) + d * (d > 0)) * (d <= most) - (d > most), width)), joined)


def ring_vectors(g, r: int, s: int, labels: int, most: int, width: int, depth: int | None = None, all_: bool = True) -> DataFrame:
    """graph_id, root, features: pair_counts of the rings at distance r to s of all vertices, at slots of (l1, l2, distance), `width` a pair
    of labels for distances from -1 on. Those over `most` aren't counted; roots that count nothing have zeros, or no row unless all_."""
    ids, slots = ["graph_id", "root"], labels * labels * width

    def joined(g) -> DataFrame:
        every = g.vertices.select("graph_id", F.col("vertex_id").alias("root"))
        counts = ring_sp(g, r, s, depth).where(F.col("d") <= most)
        return dense(counts, ids, (F.col("l1") * labels + F.col("l2")) * width + F.col("d") + 1, slots, every if all_ else None)

    def slot(l1, l2, d):
        return ((l1 * labels + l2) * width + d + 1) * (d <= most) - (d > most)

    return g.by_parts(lambda rows: packed.pair_cells(rows, r, s, depth, None, (slot, slots), all_), joined)
