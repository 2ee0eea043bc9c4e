"""Exact duplicates by distributed radix partitioning from the most significant bytes.

Normalised texts (A-Z lower-cased, UTF-8 bytes) start in one group. A level splits every group by its members' next bytes: a text
whose bytes no other member shares is alone and leaves with its row's own columns only; a group whose texts have ended holds copies; all others go on.
A level's digit is FIRST bytes wide at the start and WIDER times the level before later, so that the levels are logarithmic in the
longest shared prefix, and a level moves rows that still have partners, not the corpus. Groups are equal bytes throughout: no digest
decides anything (text_sha256 is output).

The counts of a level are pre-aggregated in the map tasks and stored; only groups of two or more are kept. Rows find their group by a
join on (group, bytes): a broadcast of the groups while they have BROADCAST bytes at most, as summed, otherwise a shuffle whose hot groups AQE splits.
A group of copies never meets in one task: its size and its largest id are aggregates.

Null texts count as empty, and all empty texts are copies of each other. Of rows that tie in the largest doc_id exactly one stays;
null ids come before all others, and where a group has no other its keep_id is null. Every row comes back, repeated ones too. An empty table gives
no rows. Only doc_id and text are read, so other columns may have any name. The documents are read twice, so they must be
the same rows each time, as those of a stored table are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import lower_ascii, stored

#: Bytes of the first digit, how many times wider each further one is, and bytes of groups that are broadcast at most, with
#: about so many for each besides its digit.
FIRST, WIDER, BROADCAST, BESIDES = 32, 4, 64_000_000, 240


def normalised(text: Column) -> Column:
    """A-Z lower-cased, null as empty; texts of ASCII alone take the built-in function, which does the same to them and is faster."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(lower_ascii(text))


def _bytes(data: Column, start: int, n: int | None = None) -> Column:
    return F.substring(data, start, n if n is not None else 2**31 - 1 - start)


def _groups(active: DataFrame) -> tuple[DataFrame, bool]:
    """(group, digit, ended, to) of all groups of two or more that a level splits off, and whether they are few."""
    n = active.groupBy("group", "digit", "ended").agg(F.count("*").alias("n")).where("n > 1")
    found = stored(n.select("group", "digit", "ended", F.monotonically_increasing_id().alias("to")), "radix-groups")
    size = found.agg(F.sum(F.length("digit") + BESIDES)).first()[0] or 0
    return found, size <= BROADCAST


def _split(active: DataFrame, found: DataFrame, few: bool, level: int, width: int) -> DataFrame:
    """Each row with the group that it goes to (`to`, null: alone); rows that go on have their next digit."""
    joined = active.join(F.broadcast(found) if few else found, ["group", "digit", "ended"], "left")
    goes_on = F.col("to").isNotNull() & ~F.col("ended")
    rest = F.when(goes_on, F.col("rest"))
    return stored(
        joined.select(
            "row", "doc_id", "sha", F.lit(level).alias("level"), F.col("to").alias("group"), goes_on.alias("goes_on"), _bytes(rest, 1, width).alias("digit"), _bytes(rest, 1 + width).alias("rest")
        ).withColumn("ended", F.length("rest") == 0),
        "radix-split",
    )


def classes(docs: DataFrame, first: int = FIRST, wider: int = WIDER) -> DataFrame:
    """Per row: row (a number of its own), doc_id, sha, level and group (null where the text is alone)."""
    none = F.lit(0).cast("long").alias("group")
    # bytes of a prefix need only the prefix lower-cased
    head = lambda text: _bytes(normalised(F.substring(text, 1, first)).cast("binary"), 1, first)
    ended = F.coalesce(F.octet_length("text"), F.lit(0)) <= first
    found, few = _groups(docs.select(none, head(F.col("text")).alias("digit"), ended.alias("ended")))
    whole = docs.select("doc_id", normalised(F.col("text")).cast("binary").alias("data"))
    rows = whole.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2("data", 256).alias("sha"), none, _bytes(F.col("data"), 1, first).alias("digit"), _bytes(F.col("data"), 1 + first).alias("rest"), (F.length("data") <= first).alias("ended")
    )
    level, width, out = 0, first * (wider - 1), None
    active = rows
    while True:
        split = _split(active, found, few, level, width)
        settled = split.where("NOT goes_on").select("row", "doc_id", "sha", "level", "group")
        out = settled if out is None else out.unionByName(settled)
        active = split.where("goes_on").select("row", "doc_id", "sha", "group", "digit", "rest", "ended")
        if active.isEmpty():
            return out
        found, few = _groups(active)
        level, width = level + 1, width * wider


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of docs (doc_id, text)."""
    rows = classes(docs.select("doc_id", "text"))
    alone = rows.where("group IS NULL").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    copies = rows.where("group IS NOT NULL")
    stats = stored(copies.groupBy("level", "group").agg(F.max(F.struct("doc_id", "row")).alias("top"), F.count("*").alias("group_size")), "radix-stats")
    of = copies.join(stats, ["level", "group"]).select("doc_id", F.col("top.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("top.row")).alias("kept"), F.col("sha").alias("text_sha256"))
    return alone.unionByName(of)


def op11_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
