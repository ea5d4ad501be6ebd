"""Sharding by a hierarchical weighted hash tree: region, rack and shard are chosen by weighted hash draws.

At each level every child draws -ln(u) / weight, u being a hash of the child's name and the key; the least draw
wins. A child's share follows its weight, and a change of weights moves keys only into or out of the children whose
weights change. A shard that joins comes as a region of its own, so that keys move only into it.

Edge cases: a null key hashes as the word null; a null text has 0 bytes and the crc of no bytes; rows with equal keys
go to one shard, each with a slot of its own, in the order of their texts' crc and size; an empty table gives an empty
table; long texts are read whole; columns of any name may stand beside, and are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Node:
    name: str
    weight: float
    children: tuple[Node, ...] = ()
    shard: int = -1

    @property
    def total(self) -> float:
        return sum(c.total for c in self.children) if self.children else self.weight


@dataclass(frozen=True)
class HashTree:
    """Three levels of nodes; only leaves have weights of their own."""

    root: Node

    @staticmethod
    def uniform(shards: int, shards_per_rack: int = 4, racks_per_region: int = 3) -> HashTree:
        racks = [
            Node(f"rack{r}", 0, tuple(Node(f"shard{s}", 1.0, (), s) for s in range(r * shards_per_rack, min(shards, (r + 1) * shards_per_rack))))
            for r in range(-(-shards // shards_per_rack))
        ]
        regions = [Node(f"region{g // racks_per_region}", 0, tuple(racks[g : g + racks_per_region])) for g in range(0, len(racks), racks_per_region)]
        return HashTree(Node("root", 0, tuple(regions)))

    def grown(self, weight: float = 1.0) -> HashTree:
        """One more shard, in a region of its own: no other subtree's weight changes."""
        new = self.count
        leaf = Node(f"shard{new}", weight, (), new)
        return HashTree(Node("root", 0, (*self.root.children, Node(f"region-of-{new}", 0, (Node(f"rack-of-{new}", 0, (leaf,)),)))))

    @property
    def leaves(self) -> list[Node]:
        def walk(n: Node):
            yield from ([n] if not n.children else (x for c in n.children for x in walk(c)))

        return list(walk(self.root))

    @property
    def count(self) -> int:
        return len(self.leaves)

    def shard(self, key: Column, seed: str = "shard") -> Column:
        """The shard of a string key."""

        def descend(n: Node) -> Column:
            if not n.children:
                return F.lit(n.shard)
            if len(n.children) == 1:
                return descend(n.children[0])
            picked = F.array_min(F.array(*[F.struct(draw(key, seed, c).alias("draw"), F.lit(i).alias("child")) for i, c in enumerate(n.children)]))["child"]
            if not n.children[0].children:
                return F.element_at(F.array(*[F.lit(c.shard) for c in n.children]), picked + 1)
            out = descend(n.children[-1])
            for i, c in list(enumerate(n.children))[-2::-1]:
                out = F.when(picked == i, descend(c)).otherwise(out)
            return out

        return descend(self.root).cast("int")

    def shard_sql(self, key: str, seed: str = "shard") -> str:
        """The same choice in DuckDB SQL."""

        def descend(n: Node) -> str:
            if not n.children:
                return str(n.shard)
            if len(n.children) == 1:
                return descend(n.children[0])
            draws = ", ".join(f"{{'draw': -ln((('0x' || substr(md5('{seed}|{c.name}|' || {key}), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE) / {c.total!r}::DOUBLE, 'child': {i}}}" for i, c in enumerate(n.children))
            cases = " ".join(f"WHEN {i} THEN {descend(c)}" for i, c in enumerate(n.children))
            return f"CASE list_sort([{draws}])[1].child {cases} END"

        return f"({descend(self.root)})::INTEGER"


def draw(key: Column, seed: str, node: Node) -> Column:
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}|{node.name}|"), key).cast("binary")), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))
    return -F.log(u) / F.lit(float(node.total))


def key_text(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit("null"))


def assign_shards(docs: DataFrame, tree: HashTree, key: str = "doc_id", text: str = "text", cell: int = 50_000) -> DataFrame:
    """(key, size, text_crc32, shard, slot, grown_shard) of every row.

    Slots count from 0 without gaps in each shard, ordered by the md5 of the key. They come from counts by shard and
    leading digits, as many as give cells of about `cell` rows, and a rank within those, so that no shard is ever sorted
    as a whole. The table of counts has one row for some `cell` rows and is joined by a shuffle once it exceeds 100,000.
    """
    rows_each = docs.count() / max(tree.count, 1)
    slot_digits = next(d for d in range(1, 16) if rows_each / 16**d <= cell)
    name = key_text(F.col(key))
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(key),
        (F.octet_length(data) + F.lit(8)).cast("long").alias("size"),
        F.crc32(data).cast("long").alias("text_crc32"),
        tree.shard(name).alias("shard"),
        tree.grown().shard(name).alias("grown_shard"),
        F.md5(name.cast("binary")).alias("_order"),
    ).withColumn("_cell", F.substring("_order", 1, slot_digits))
    counts = rows.groupBy("shard", "_cell").count()
    before = counts.select("shard", "_cell", (F.sum("count").over(Window.partitionBy("shard").orderBy("_cell")) - F.col("count")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("shard", "_cell").orderBy("_order", key, "text_crc32", "size")) - 1
    return rows.withColumn("_within", within).join(F.broadcast(before) if tree.count * 16**slot_digits <= 100_000 else before, ["shard", "_cell"]).select(key, "size", "text_crc32", "shard", (F.col("_before") + F.col("_within")).cast("long").alias("slot"), "grown_shard")
