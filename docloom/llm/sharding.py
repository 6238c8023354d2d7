"""Sharding by a hierarchical weighted hash tree: region, rack, shard."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

#: Rows of a shard are ranked in this many segments, so that no shard is ranked in one task.
SEGMENTS = 256


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: int = 1


def uniform_tree(shards: int, per_rack: int = 4, racks_per_region: int = 2) -> list[Leaf]:
    """``shards`` leaves of weight 1, filled rack by rack and region by region.

    A shard that opens a new region moves rows only into itself; one added to a region that
    stands already also re-deals the rows that its heavier region draws, within that region.
    """
    per_region = per_rack * racks_per_region
    return [Leaf(s // per_region, s // per_rack, s) for s in range(shards)]


def draw(key: Column, node: Column, weight: Column) -> Column:
    """ln(u) / weight with u in (0, 1) from a hash of key and node; the largest draw wins.

    A child of weight w wins with probability w / total, and a change of its weight moves
    only rows that it wins or loses.
    """
    u = (F.conv(F.substring(F.md5(F.concat(key, F.lit("|"), node)), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return F.log(u) / weight


def _level(key: Column, children: dict[str, dict[str, int]], parent: Column) -> Column:
    """The name of the child of ``parent`` with the largest draw."""
    pairs = []
    for name, kids in children.items():
        pairs += [F.lit(name), F.array(*[F.struct(F.lit(k).alias("name"), F.lit(float(w)).alias("weight")) for k, w in kids.items()])]
    drawn = F.transform(F.element_at(F.create_map(*pairs), parent), lambda c: F.struct(draw(key, c["name"], c["weight"]).alias("d"), c["name"].alias("name")))
    return F.array_max(drawn)["name"]


def tree_shard(key: Column, tree: list[Leaf]) -> Column:
    """The shard that the tree deals ``key`` (a string) to, in three draws."""
    root: dict[str, dict[str, int]] = {"": {}}
    racks: dict[str, dict[str, int]] = {}
    shards: dict[str, dict[str, int]] = {}
    for leaf in tree:
        if leaf.weight <= 0:
            continue
        region, rack, shard = f"region {leaf.region}", f"rack {leaf.rack}", f"shard {leaf.shard}"
        root[""][region] = root[""].get(region, 0) + leaf.weight
        racks.setdefault(region, {})[rack] = racks.get(region, {}).get(rack, 0) + leaf.weight
        shards.setdefault(rack, {})[shard] = leaf.weight
    if not root[""]:
        raise ValueError("the tree has no shard of positive weight")
    chosen = _level(key, shards, _level(key, racks, _level(key, root, F.lit(""))))
    return F.substring_index(chosen, " ", -1).cast("int")


def shard_documents(docs: DataFrame, tree: list[Leaf], grown: list[Leaf] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deals documents to the leaves of ``tree`` under the law ``key``: the id decides alone.

    Returns id, size (UTF-8 bytes + 16), text_crc32, law, shard, slot (gapless in each shard),
    grown_shard (the shard under the tree ``grown``; null without one) and segment. A null
    text has size 16 and the crc32 of no bytes, 0; a null id is dealt as the empty string.
    Repeated rows are dealt alike and get slots of their own. An empty table gives no rows.
    """
    key, text = F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    digest = F.md5(F.concat(key, F.lit("|"), F.md5(text)))
    dealt = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        tree_shard(key, tree).alias("shard"),
        (tree_shard(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        F.conv(F.substring(digest, 1, 2), 16, 10).cast("int").alias("segment"),
    )
    dealt = stored(dealt, "shards")
    # Counts of shard x segment pairs: 256 rows a shard at most, whatever the input.
    counts = dealt.groupBy("shard", "segment").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("shard", "segment", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard", "segment").orderBy("doc_id", "size", "text_crc32")
    ranked = dealt.withColumn("within", F.row_number().over(within))
    return ranked.join(F.broadcast(bases), ["shard", "segment"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", (F.col("base") + F.col("within") - 1).cast("long").alias("slot"), "grown_shard", "segment"
    )
