"""Sharding by a hierarchical weighted hash tree.

The tree has regions, racks and shards; a leaf has a weight and an inner node the sum of its
leaves'. A document descends from the root: at each node every child draws -ln(u) / weight, with u
in (0, 1) from a hash of the id and the child's name, and the lowest draw wins, so a child gets its
share of the weights. When weights change, draws of other children stay what they were: documents
move only into a subtree that has grown or out of one that has shrunk. A new shard comes as a
region of its own, so that no inner node above the others changes and it takes rows only into
itself.

A null id has draws of its own like any value. Documents with equal ids share a shard whatever
their texts. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelode.llm.common import Scratch

BLOCKS = 1024


@dataclass(frozen=True)
class Node:
    """A region, rack or shard; a shard has a number and no children."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int | None = None
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def tree(shards: int, regions: int = 2, racks: int = 2, first: int = 8) -> Node:
    """Shards 0 to shards - 1 of weight 1: the first ones dealt in turn to the racks of the regions, later ones grown().

    So there is one layout for each count from ``first`` on, and each further shard takes rows only into itself.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    if shards > first:
        return grown(tree(shards - 1, regions, racks, first), shards - 1)
    leaves = [Node(f"shard{i}", (), i) for i in range(shards)]
    at = [[leaves[i] for i in range(shards) if i % (regions * racks) == k] for k in range(regions * racks)]
    tops = [
        Node(f"region{r}", tuple(Node(f"rack{r}.{k}", tuple(at[r * racks + k])) for k in range(racks) if at[r * racks + k]))
        for r in range(regions)
    ]
    return Node("root", tuple(t for t in tops if t.children))


def grown(root: Node, shard: int, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a new region and rack."""
    leaf = Node(f"shard{shard}", (), shard, weight)
    return Node(root.name, (*root.children, Node(f"region+{shard}", (Node(f"rack+{shard}", (leaf,)),))))


def shard_of(key: Column, node: Node) -> Column:
    """The shard that a key descends to."""
    if not node.children:
        return F.lit(node.shard)

    def draw(child: Node) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(child.name)), 11)
        return -F.log((bits + 0.5) / float(1 << 53)) / F.lit(float(child.weight))

    if len(node.children) == 1:
        return shard_of(key, node.children[0])
    # an array of structs has its least element by draw, then by place
    won = F.array_min(F.array(*[F.struct(draw(c).alias("draw"), F.lit(i).alias("place")) for i, c in enumerate(node.children)]))["place"]
    out = F.when(won == 0, shard_of(key, node.children[0]))
    for i, c in enumerate(node.children[1:], 1):
        out = out.when(won == i, shard_of(key, c))
    return out


def place(docs: DataFrame, root: Node, next_root: Node | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and grown_shard (null without next_root) of every document.

    size is the text's UTF-8 bytes plus 1. Slots count from 0 in each shard without a gap, by block
    of the id's hash, then id, checksum and size: a window runs over each of 1024 blocks a shard,
    and one over the blocks' counts, never over a whole shard.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        shard_of(key, root).cast("int").alias("shard"),
        (shard_of(key, next_root) if next_root else F.lit(None)).cast("int").alias("grown_shard"),
        F.pmod(F.xxhash64(key, F.lit("block")), F.lit(BLOCKS)).cast("int").alias("block"),
    )
    rows = Scratch(docs.sparkSession, "sharding").save(rows, "rows")
    counts = rows.groupBy("shard", "block").count()
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "block").orderBy(F.col("doc_id").asc_nulls_last(), "text_crc32", "size")
    return (
        rows.withColumn("at", F.row_number().over(inside) - 1)
        .join(starts, ["shard", "block"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("at")).cast("long").alias("slot"), "grown_shard")
    )
