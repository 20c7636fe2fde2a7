"""Sharding by a hierarchical weighted hash tree.

A row descends from the root to a region, from there to a rack and to a shard. At each
node every child draws ``-ln(u) / weight`` with ``u`` hashed from the row's key and the
child's name, and the smallest draw wins, so a child wins in proportion to its weight.
A draw depends on nothing but key, child and weight: where a weight changes, rows move
only between that child and its siblings, and inside subtrees that kept their weights
nothing moves. A shard that opens a region of its own takes rows only into itself.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunloom.llm.ordinals import bucket_count, with_ordinals


@dataclass(frozen=True)
class Node:
    name: str
    weight: float
    children: tuple[Node, ...] = ()
    shard: int | None = None


def region(name: str, racks: Sequence[Sequence[int]], weight: float = 1.0) -> Node:
    """A region of racks of shards; a node weighs as much as its shards."""
    nodes = []
    for i, shards in enumerate(racks):
        leaves = tuple(Node(f"{name}/{i}/{s}", weight, shard=s) for s in shards)
        nodes.append(Node(f"{name}/{i}", weight * len(leaves), leaves))
    return Node(name, sum(n.weight for n in nodes), tuple(nodes))


def even_tree(shards: int, per_rack: int = 5, per_region: int = 10) -> Node:
    """Shards 0, 1, ... filled into racks and regions in order; a shard that does not fill a
    rack opens a region of its own, so a tree for one more shard only adds a region."""
    full = shards // per_region * per_region
    regions = [
        region(f"r{first // per_region}", [range(at, at + per_rack) for at in range(first, first + per_region, per_rack)])
        for first in range(0, full, per_region)
    ]
    regions += [region(f"x{s}", [[s]]) for s in range(full, shards)]
    return Node("root", float(shards), tuple(regions))


def draw(key: Column, child: Node, seed: int) -> Column:
    """52 bits of an MD5 as a number in (0, 1), and from it an exponential draw."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{child.name}:"), key)), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / F.lit(float(1 << 52))) / F.lit(child.weight)


def chosen(key: Column, node: Node, seed: int) -> Column:
    """Name of the child that wins at a node; equal draws go to the first by name."""
    if len(node.children) == 1:
        return F.lit(node.children[0].name)
    return F.least(*(F.struct(draw(key, c, seed).alias("d"), F.lit(c.name).alias("n")) for c in node.children))["n"]


def descend(df: DataFrame, key: str, tree: Node, seed: int, prefix: str = "") -> DataFrame:
    """Add ``<prefix>region``, ``<prefix>rack`` and ``<prefix>shard`` (int).

    Each level is drawn only among the children of the node chosen above.
    """
    k = F.col(key)

    def by_node(parent: str, nodes: Sequence[Node]) -> Column:
        out = None
        for n in nodes:
            cond, value = F.col(parent) == n.name, chosen(k, n, seed)
            out = F.when(cond, value) if out is None else out.when(cond, value)
        return out

    racks = [r for g in tree.children for r in g.children]
    df = df.withColumn(f"{prefix}region", chosen(k, tree, seed))
    df = df.withColumn(f"{prefix}rack", by_node(f"{prefix}region", tree.children))
    df = df.withColumn("_leaf", by_node(f"{prefix}rack", racks))
    return df.withColumn(f"{prefix}shard", F.element_at(F.split("_leaf", "/"), -1).cast("int")).drop("_leaf")


def shard_documents(docs: DataFrame, shards: int = 40, seed: int = 11) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, region, rack.

    The law is ``key``: doc_id and the number of shards decide. A null doc_id hashes as
    an empty key; rows with one doc_id share a shard. Null text counts as no bytes and
    has the checksum of none (0). Slots follow a hash of the key, then doc_id, checksum
    and size; which of two equal rows comes first is left open.
    """
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.select("doc_id", (F.length(text) + 16).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"))
    rows = rows.withColumn("_key", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = descend(descend(rows, "_key", even_tree(shards), seed), "_key", even_tree(shards + 1), seed, "_grown_")
    rows = rows.withColumn("_place", F.md5(F.concat(F.lit(f"{seed}/"), F.col("_key")))).drop("_key")
    per_shard = bucket_count(docs.count()) // 8 + 1
    bucket = F.floor(F.conv(F.substring("_place", 1, 8), 16, 10).cast("long") / F.lit((1 << 32) // per_shard))
    numbered = with_ordinals(rows, ["shard"], bucket, [F.col("_place"), F.col("doc_id"), F.col("text_crc32"), F.col("size")], "slot")
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", F.col("_grown_shard").alias("grown_shard"), "region", "rack")
