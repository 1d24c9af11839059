"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

A document descends the tree by its id: at each level every child draws a number from the hash of the id and the
child's name, divided by the child's weight (``-ln(u) / weight``), and the least draw takes the document. A child thus gets
its weight's share, and a draw depends on nothing but id, name and weight. So where a weight changes, documents move
only into or out of the subtrees on that path; elsewhere every draw stays as it was. A document that enters a subtree
descends it anew, so a shard that is to take documents only into itself is added as a region of its own (``grown``).

Only ids, sizes and checksums are dealt; texts stay where they are read. Slots come from one range partitioning by
shard and id: a row's place in its partition plus the rows of its shard in the partitions before, so a shard is spread over
as many tasks as it needs, however many rows one id has.

Cases: a null id is hashed as the empty text; a null text has size 1 and checksum 0; rows of equal id go to one shard, as the id
decides, each with a slot of its own; an empty table gives no rows; other columns are not read, and in written files
they stay as they are (the folder column takes another name if theirs is ``shard``).
"""

from __future__ import annotations

from collections import defaultdict
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickline.llm.common import stored

#: Rows of a range partition, and the most partitions (the table of their counts is broadcast: some 20,000 rows).
RANGE_ROWS, MOST_RANGES = 20_000, 20_000


class Leaf(NamedTuple):
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def even_tree(shards: int, racks: int = 2, a_rack: int = 2) -> list[Leaf]:
    """Shards of weight one, ``a_rack`` to a rack and ``racks`` to a region."""
    return [Leaf(f"r{s // (a_rack * racks)}", f"k{s // a_rack % racks}", s) for s in range(shards)]


def grown(tree: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard, in a region of its own: documents move into that shard only."""
    n = 1 + max((x.shard for x in tree), default=-1)
    return [*tree, Leaf(f"r+{n}", "k0", n, weight)]


def children(tree: list[Leaf]) -> dict[str, list[tuple[str, float]]]:
    """Each inner node's children with their weights (the sum of what hangs below); the root is ''. Weights of zero take nothing."""
    own: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
    if len({x.shard for x in tree}) < len(tree) or any(x.weight < 0 for x in tree):
        raise ValueError("shards must differ, and weights must not be negative")
    for x in tree:
        path = ["", f"{x.region}", f"{x.region}/{x.rack}", f"{x.region}/{x.rack}/{x.shard}"]
        for parent, child in zip(path, path[1:], strict=False):
            own[parent][child] += x.weight
    out = {p: sorted((c, w) for c, w in kids.items() if w > 0) for p, kids in own.items()}
    if not out.get(""):
        raise ValueError("a tree needs a shard of positive weight")
    return {p: kids for p, kids in out.items() if kids}


def draw(key: Column, node: Column) -> Column:
    """A number between 0 and 1 from 52 bits of the MD5 of node and key."""
    bits = F.conv(F.substring(F.md5(F.concat(node, F.lit("|"), key).cast("binary")), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 52)


def shard_of(doc_id: str, tree: list[Leaf]) -> Column:
    """The shard of a document: three draws, each among the children of the node reached."""
    kids = children(tree)
    table = F.create_map(*[x for p, own in kids.items() for x in (F.lit(p), F.array(*[F.struct(F.lit(c).alias("name"), F.lit(w).alias("weight")) for c, w in own]))])
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    node = F.lit("")
    for _ in range(3):
        draws = F.transform(table[node], lambda c: F.struct((-F.log(draw(key, c["name"])) / c["weight"]).alias("d"), c["name"].alias("name")))
        node = F.array_min(draws)["name"]
    return F.element_at(F.split(node, "/"), -1).cast("int")


def with_slots(rows: DataFrame, shard: str, order: list[str]) -> DataFrame:
    """Adds ``slot``: each shard's rows counted from 0 without gaps, in the given order (ties as they come)."""
    n = min(MOST_RANGES, rows.count() // RANGE_ROWS + 1)
    keys = [shard, *order]
    # rows that tie in all keys are told apart by where they were read, so that they too spread over partitions
    dealt = rows.withColumn("at", F.monotonically_increasing_id()).repartitionByRange(n, *keys, "at").sortWithinPartitions(*keys, "at")
    dealt = stored(dealt.drop("at").withColumn("at", F.monotonically_increasing_id()), "slots")
    part = F.shiftright("at", 33)
    bases = dealt.groupBy(shard, part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy(shard).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = bases.select(shard, "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("base"))
    # at most a row for each range and shard boundary
    return dealt.withColumn("part", part).join(F.broadcast(bases), [shard, "part"]).withColumn("slot", F.col("at") + F.col("base")).drop("at", "part", "base")


def sharded(docs: DataFrame, tree: list[Leaf] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, and the shard once the tree has one more."""
    tree = even_tree(8) if tree is None else tree
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), shard_of("doc_id", tree).alias("shard"), shard_of("doc_id", grown(tree)).alias("grown_shard"))
    own = with_slots(own, "shard", ["doc_id", "text_crc32", "size"])
    return own.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, tree: list[Leaf] | None = None) -> str:
    """Whole documents as Parquet in a folder for each shard, by id within a file; returns the folder column's name."""
    tree = even_tree(8) if tree is None else tree
    name = next(c for c in ("shard", *(f"shard_{i}" for i in range(len(docs.columns) + 1))) if c not in docs.columns)
    n = min(MOST_RANGES, docs.count() // RANGE_ROWS + len(tree))
    own = docs.withColumns({name: shard_of("doc_id", tree), "_at_": F.monotonically_increasing_id()})
    own.repartitionByRange(n, name, "doc_id", "_at_").sortWithinPartitions(name, "doc_id").drop("_at_").write.partitionBy(name).parquet(path)
    return name


def moves(docs: DataFrame, before: list[Leaf], after: list[Leaf]) -> DataFrame:
    """How many documents go from which shard to which when the tree changes."""
    own = docs.select(shard_of("doc_id", before).alias("from_shard"), shard_of("doc_id", after).alias("to_shard")).filter("from_shard <> to_shard")
    return own.groupBy("from_shard", "to_shard").agg(F.count("*").alias("documents"))
