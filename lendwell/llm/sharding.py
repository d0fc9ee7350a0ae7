"""Sharding by a hierarchical weighted hash tree."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendwell.llm.common import key_text, numbered, unit_draw

#: Shards that are dealt over the regions; later ones grow.
BASE = 8


@dataclass(frozen=True)
class Node:
    """A region, rack or shard. A shard has a number and a weight of its own;
    every other node weighs what its children weigh together."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int | None = None
    own: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own


def tree(shards: int, regions: int = 2, racks: int = 2, base: int = BASE) -> Node:
    """`shards` equal shards: `base` at most below `regions` x `racks`, dealt in order, the others grown one by one."""
    if shards > base:
        return grown(tree(shards - 1, regions, racks, base), shards - 1)
    cells: list[list[list[Node]]] = [[[] for _ in range(racks)] for _ in range(regions)]
    for k in range(shards):
        at = k * regions * racks // shards
        cells[at // racks][at % racks].append(Node(f"shard{k}", shard=k))
    return Node(
        "root",
        tuple(
            Node(f"region{i}", tuple(Node(f"region{i}.rack{j}", tuple(c)) for j, c in enumerate(region) if c))
            for i, region in enumerate(cells)
            if any(region)
        ),
    )


def grown(root: Node, shard: int, weight: float = 1.0) -> Node:
    """`root` with one more shard in a region and rack of its own.

    No old node changes its weight, so no row moves between old shards: the new
    branch draws rows from all of them into itself.
    """
    leaf = Node(f"shard{shard}", shard=shard, own=weight)
    name = f"region+{shard}"
    return Node(root.name, (*root.children, Node(name, (Node(f"{name}.rack0", (leaf,)),))))


def place(key: Column, node: Node, seed: str = "shard") -> Column:
    """The shard number of `key`: at every level the child with the largest
    ln(u) / weight wins, u being drawn from the key and the child's name.

    A child's draw does not depend on its siblings, so a changed weight moves
    rows into or out of that child only, and below it the same holds again.
    """
    if node.shard is not None:
        return F.lit(node.shard)
    if len(node.children) == 1:
        return place(key, node.children[0], seed)
    draws = [F.log(unit_draw(seed, c.name, key)) / F.lit(c.weight) for c in node.children]
    best = F.greatest(*draws)
    out = place(key, node.children[-1], seed)
    for child, draw in list(zip(node.children, draws, strict=True))[-2::-1]:
        out = F.when(draw == best, place(key, child, seed)).otherwise(out)
    return out


def shards_of(node: Node) -> list[int]:
    """The numbers of the shards below `node`."""
    return [node.shard] if node.shard is not None else [s for c in node.children for s in shards_of(c)]


def shard_documents(
    docs: DataFrame, shards: int = BASE, seed: str = "shard", root: Node | None = None, weight: float = 1.0
) -> DataFrame:
    """Shard, slot and the shard after growth of every document.

    `root`, if given, is the tree to place by, else it is `tree(shards)`; the
    growth is `grown` by one shard of `weight`. From `BASE` shards on,
    `grown_shard` is the `shard` of a call with one shard more.

    The law is `key`: doc_id and the tree decide, whatever the other documents
    are. Returns doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Null doc_id: placed as the key "null". Null text: size 1, checksum of the
    empty text. Repeated rows: each has a slot of its own. Empty table: empty
    result. Further columns are ignored.
    """
    root = root or tree(shards)
    more = grown(root, max(shards_of(root)) + 1, weight)
    text = F.coalesce(F.col("text"), F.lit(""))
    key = key_text(F.col("doc_id"))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        place(key, root, seed).cast("int").alias("shard"),
        place(key, more, seed).cast("int").alias("grown_shard"),
    )
    by = [F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    return numbered(rows, "shard", by, "slot").select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
