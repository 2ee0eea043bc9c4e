"""Prefix tries of conversations whose subtries are built where they fit and split further where they don't.

A turn becomes a cell of 24 bytes: 16 of the SHA-256 of its length-prefixed role and its text, and 8 for the code points of the text.
A conversation is its cells in a row, so its prefixes are prefixes of bytes, and equal conversations are equal bytes. Texts leave the plan at the first projection.

1. Rebuild: cells are gathered by conversation; a conversation takes the first cells of the one that its hundred starts with, five at most.
2. Equal conversations become one, with their number and the digest of their ids. Their ids are dealt by ranges of
   (conversation, id), joined to runs of text in each range, and the runs of a conversation pass through its digest in order: memory stays bounded however many there are.
3. Conversations are dealt by the digest of their first turn. A group over `limit` turns, which is twice a task's share, is oversized: its least and largest
   members show the turns that all share, which become a chain of nodes, and its members are dealt again by the turn after those. This repeats
   until no group is oversized; a group of one very long conversation is all chain.
4. Groups that fit are built inside applyInPandas, by buckets of a hash: nodes are dictionaries of children, totals come in postorder
   from an explicit stack. Chains take their totals from the tops of the groups below them, the deepest round first.

Rows without a conv_id take no part. Turns of equal number (null: before all) are ordered by their cells; repeated rows are turns
each. A null role or text counts as empty. conv_ids below zero belong to conv_id - conv_id % 100 with the sign of the dividend. An empty
table has no conversations and gives no rows. A conversation is one binary value on the way, so it may have up to about 80 million turns.
Only conv_id, turn, role and text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import stored

#: Bytes of a cell and of the digest in it; conversations that share the first turns of one, and turns shared at most, plus one.
CELL, DIGEST, FAMILY, HEADS = 24, 16, 100, 6
#: Turns of a group that is built in one task: at least, and at most. Ids that a run of text holds.
LEAST, MOST, RUN = 64, 200_000, 4096
EMPTY = hashlib.sha256(b"").hexdigest()


def cells(turns: DataFrame) -> DataFrame:
    """conv_id, turns: binary, the cells of the conversation's turns in order."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    cell = F.concat(F.substring(digest, 1, 2 * DIGEST), F.lpad(F.lower(F.hex(F.char_length(text).cast("long"))), 2 * (CELL - DIGEST), "0"))
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", cell.alias("cell")).alias("t"))
    lists = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return lists.select("conv_id", F.unhex(F.array_join(F.transform("t", lambda t: t.cell), "")).alias("turns"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, turns of every conversation with its family's first turns in place of its own."""
    own = stored(cells(turns), "conversations")
    heads = own.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("family"), F.substring("turns", 1, CELL * (HEADS - 1)).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    own = own.withColumn("family", F.col("conv_id") - F.col("conv_id") % FAMILY).withColumn("h", h * CELL)
    both = own.join(heads, "family", "left")
    head = F.expr("substring(coalesce(head, X''), 1, h)")
    return both.select("conv_id", F.concat(head, F.expr(f"substring(turns, h + 1, {2**31 - 1} - h)")).alias("turns"))


def distinct(conversations: DataFrame) -> DataFrame:
    """turns, conv_id (the smallest), n, ends_sha256 of the ids, of each different conversation."""
    named = conversations.select(F.substring(F.unhex(F.sha2("turns", 256)), 1, DIGEST).alias("name"), "conv_id", "turns")
    ranges = named.repartitionByRange("name", "conv_id").sortWithinPartitions("name", "conv_id")

    def runs(batches):
        schema = pa.schema([("name", pa.binary()), ("turns", pa.binary()), ("conv_id", pa.int64()), ("n", pa.int64()), ("ids", pa.string())])
        name, turns, ids = None, None, []

        def run():
            return pa.RecordBatch.from_pylist([{"name": name, "turns": turns, "conv_id": ids[0], "n": len(ids), "ids": ",".join(map(str, ids))}], schema=schema)

        for b in batches:
            for m, c, t in zip(b.column("name").to_pylist(), b.column("conv_id").to_pylist(), b.column("turns"), strict=True):
                if ids and (m != name or len(ids) >= RUN):
                    yield run()
                    ids = []
                if not ids:
                    name, turns = m, t.as_py()
                ids.append(c)
        if ids:
            yield run()

    parts = ranges.mapInArrow(runs, "name binary, turns binary, conv_id long, n long, ids string")
    width = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = parts.repartition(width, "name").sortWithinPartitions("name", "conv_id")

    def joined(batches):
        schema = pa.schema([("turns", pa.binary()), ("conv_id", pa.int64()), ("n", pa.int64()), ("ends_sha256", pa.string())])
        held = None  # name, turns, least id, number, digest so far
        out = lambda: {"turns": held[1], "conv_id": held[2], "n": held[3], "ends_sha256": held[4].hexdigest()}
        for b in batches:
            done = []
            for r in b.to_pylist():
                if held and held[0] == r["name"]:
                    held[3] += r["n"]
                    held[4].update(b"," + r["ids"].encode())
                else:
                    if held:
                        done.append(out())
                    held = [r["name"], r["turns"], r["conv_id"], r["n"], hashlib.sha256(r["ids"].encode())]
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
        if held:
            yield pa.RecordBatch.from_pylist([out()], schema=schema)

    return dealt.mapInArrow(joined, "turns binary, conv_id long, n long, ends_sha256 string")


NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def build(rows, base: int) -> list[tuple]:
    """Nodes from depth `base` on of conversations (turns, conv_id, n, ends_sha256) that share their first `base` turns: tuples as NODE
    without the top's parent. The top comes last."""
    top = {"kids": {}, "conv": None, "n": 0, "len": 0, "ends": EMPTY, "depth": base}
    if base:
        top["len"] = int.from_bytes(rows[0][0][CELL * base - (CELL - DIGEST) : CELL * base], "big")
    for turns, conv, n, ends in rows:
        node, at = top, CELL * base
        while True:
            node["n"] += n
            node["conv"] = conv if node["conv"] is None else min(conv, node["conv"])
            if at >= len(turns):
                node["ends"] = ends
                break
            cell = turns[at : at + CELL]
            at += CELL
            kid = node["kids"].get(cell)
            if kid is None:
                kid = node["kids"][cell] = {"kids": {}, "conv": None, "n": 0, "len": int.from_bytes(cell[DIGEST:], "big"), "ends": EMPTY, "depth": node["depth"] + 1}
            node = kid
    out, stack = [], [(top, None, iter(top["kids"].values()))]
    totals = {id(top): [0, 0]}  # leaves and saved tokens below
    while stack:
        node, up, kids = stack[-1]
        kid = next(kids, None)
        if kid is not None:
            totals[id(kid)] = [0, 0]
            stack.append((kid, node, iter(kid["kids"].values())))
            continue
        stack.pop()
        leaves, saved = totals.pop(id(node))
        leaves, saved = leaves or 1, saved + (node["n"] - 1) * node["len"] * (node["depth"] > 0)
        out.append((node["conv"], node["depth"], up and up["conv"], node["n"], len(node["kids"]), leaves, saved, node["ends"]))
        if up is not None:
            t = totals[id(up)]
            t[0], t[1] = t[0] + leaves, t[1] + saved
    return out


def tries(groups: DataFrame, buckets: int) -> DataFrame:
    """Nodes of groups (key, up, parent, base, turns, conv_id, n, ends_sha256) that share their first `base` turns, each group within a
    bucket; `up`: the key above, on a group's top only."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in frame.groupby("key", sort=False):
            base, up, parent = int(g["base"].iloc[0]), g["up"].iloc[0], int(g["parent"].iloc[0])
            nodes = build(list(zip(g["turns"], g["conv_id"].tolist(), g["n"].tolist(), g["ends_sha256"], strict=True)), base)
            out += [(None, *n) for n in nodes[:-1]]
            out.append((up, *nodes[-1][:2], parent, *nodes[-1][3:]))
        done = pd.DataFrame(out, columns=["up", *(c.split()[0] for c in NODE.split(", "))], dtype=object)
        return done.astype({c: "Int64" for c in done.columns if c not in ("up", "ends_sha256")})

    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets))
    return groups.withColumn("bucket", bucket).groupBy("bucket").applyInPandas(run, f"up binary, {NODE}")


def nodes(turns: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """All nodes of the trie of the rebuilt conversations."""
    width = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(distinct(rebuilt(turns)), "distinct")
    size = F.octet_length("turns") / CELL + 1
    total = int(rows.agg(F.sum(size)).first()[0] or 0)
    limit = max(least, min(most, -(-2 * total // width)))
    none = F.lit(None)
    active = rows.select(F.unhex(F.lit("00")).alias("key"), none.cast("binary").alias("up"), none.cast("long").alias("parent"), F.lit(0).alias("base"), *rows.columns)
    large, fits, chains = stored(_chains(active), "chains"), [], []
    while not large.isEmpty():
        chains.append(large)
        over = F.broadcast(large.select("key", F.col("conv_id").alias("top_conv"), "shared"))
        members = active.select("key", *rows.columns).join(over, "key").where(F.octet_length("turns") > F.col("shared") * CELL)
        step = F.expr(f"substring(turns, shared * {CELL} + 1, {CELL})")
        key = F.substring(F.unhex(F.sha2(F.concat("key", step), 256)), 1, DIGEST)
        active = stored(members.select(key.alias("key"), F.col("key").alias("up"), F.col("top_conv").alias("parent"), (F.col("shared") + 1).alias("base"), *rows.columns), "split")
        # at most total / limit groups are oversized, so they may be broadcast
        big = stored(active.groupBy("key").agg(F.sum(size - F.col("base")).alias("size")).where(F.col("size") > limit).select("key"), "oversized")
        fits.append(active.join(F.broadcast(big), "key", "left_anti"))
        large = stored(_chains(active.join(F.broadcast(big), "key")), "chains")
    if not fits:
        fits.append(active)
    small = fits[0]
    for f in fits[1:]:
        small = small.unionByName(f)
    built = stored(tries(small, max(width, -(-total // most))), "tries")
    out, tops = built, built.where("up IS NOT NULL").select("up", "n_leaves", "saved_tokens")
    for large in reversed(chains):
        done = stored(_resolved(large, tops), "resolved")
        out = out.unionByName(done)
        tops = tops.unionByName(done.where("up IS NOT NULL").select("up", "n_leaves", "saved_tokens"))
    return out.drop("up")


def _chains(groups: DataFrame) -> DataFrame:
    """For each group what all its members share: the turns up to `shared`, and the digest of the ids that end there."""
    stats = groups.groupBy("key", "up", "parent", "base").agg(F.min(F.struct("turns", "ends_sha256")).alias("lo"), F.max("turns").alias("high"), F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"))

    def shared(batches):
        for b in batches:
            out = []
            for a, z in zip(b.column("low"), b.column("high"), strict=True):
                a, z = a.as_py(), z.as_py()
                low, high = 0, min(len(a), len(z)) // CELL
                while low < high:  # by halves: prefixes are equal up to a place and not beyond it
                    mid = (low + high + 1) // 2
                    low, high = (mid, high) if a[: mid * CELL] == z[: mid * CELL] else (low, mid - 1)
                out.append(low)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int32())], names=[*b.schema.names, "shared"])

    flat = stats.select("key", "up", "parent", "base", "conv_id", "n_convs", F.col("lo.turns").alias("low"), "high", F.col("lo.ends_sha256").alias("low_ends"))
    found = flat.mapInArrow(shared, "key binary, up binary, parent long, base int, conv_id long, n_convs long, low binary, high binary, low_ends string, shared int")
    ends = F.when(F.octet_length("low") == F.col("shared") * CELL, F.col("low_ends")).otherwise(EMPTY)
    return found.select("key", "up", "parent", "base", "conv_id", "n_convs", "shared", F.expr(f"substring(low, 1, shared * {CELL})").alias("turns"), ends.alias("ends_sha256"))


def _resolved(chains: DataFrame, tops: DataFrame) -> DataFrame:
    """up (on a chain's first node) and NODE for all nodes of the chains, with totals from the tops of the groups below."""
    below = tops.groupBy(F.col("up").alias("key")).agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    both = chains.join(below, "key", "left").fillna(0, ["kids", "saved"]).fillna(1, ["leaves"])
    names = ["up", *(c.split()[0] for c in NODE.split(", "))]

    def expanded(batches):
        for b in batches:
            for r in b.to_pylist():
                base, n = r["base"], r["shared"] - r["base"] + 1
                lens = np.frombuffer(r["turns"], np.uint8).reshape(-1, CELL)[max(0, base - 1) :, DIGEST:].copy().view(">i8").ravel().astype(np.int64)
                own = (r["n_convs"] - 1) * (lens if base else np.concatenate([[0], lens]))
                saved = np.cumsum(own[::-1])[::-1] + r["saved"]
                for i in range(0, n, 65536):
                    d = np.arange(i, min(n, i + 65536))
                    last = d == n - 1
                    same = lambda v: np.full(len(d), v)  # noqa: B023, E731
                    ups, parents = [None] * len(d), [r["conv_id"]] * len(d)
                    if i == 0:
                        ups[0], parents[0] = r["up"], r["parent"]
                    columns = [pa.array(ups, pa.binary()), pa.array(same(r["conv_id"])), pa.array(base + d), pa.array(parents, pa.int64()), pa.array(same(r["n_convs"])), pa.array(np.where(last, r["kids"], 1)), pa.array(same(r["leaves"])), pa.array(saved[d])]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(np.where(last, r["ends_sha256"], EMPTY).tolist(), pa.string())], names=names)

    return both.mapInArrow(expanded, f"up binary, {NODE}")


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return nodes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
