"""Sharding with a hierarchical weighted hash tree.

A tree has regions, racks and shards. A row descends level by level: every child of the
node it stands at draws ``-ln(u) / weight`` with u from a hash of the row's key and the
child's name, and the least draw wins. A child wins with a chance in proportion to its
weight, and its draw depends on nothing but key, name and weight. So if one weight
changes, rows move only into or out of the subtrees on the path to that node.

A new shard is added as a region of its own. Only its draw is new at the root, so rows
move into the new shard and nowhere else.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import gapless_rank


@dataclass(frozen=True)
class Node:
    """A region, a rack (with children) or a shard (without)."""

    name: str
    weight: float = 1.0
    children: tuple[Node, ...] = field(default=())

    @property
    def load(self) -> float:
        """A subtree weighs what its shards weigh together."""
        return sum(c.load for c in self.children) if self.children else self.weight


@dataclass(frozen=True)
class HashTree:
    regions: tuple[Node, ...]

    @classmethod
    def balanced(cls, regions: int, racks: int, shards: int) -> HashTree:
        """regions x racks x shards leaves of weight 1."""
        return cls(
            tuple(
                Node(
                    f"r{i}",
                    children=tuple(
                        Node(f"r{i}/k{j}", children=tuple(Node(f"r{i}/k{j}/s{k}") for k in range(shards)))
                        for j in range(racks)
                    ),
                )
                for i in range(regions)
            )
        )

    def shards(self) -> list[str]:
        """Names of the shards; a shard's number is its place in this list."""
        return [s.name for r in self.regions for k in r.children for s in k.children]

    def grown(self, weight: float = 1.0) -> HashTree:
        """The tree with one more shard, numbered after all others."""
        r = f"r{len(self.regions)}"
        new = Node(r, children=(Node(f"{r}/k0", children=(Node(f"{r}/k0/s0", weight),)),))
        return HashTree((*self.regions, new))

    def reweighted(self, shard: str, weight: float) -> HashTree:
        """The tree with another weight of one shard."""

        def visit(n: Node) -> Node:
            if n.children:
                return Node(n.name, n.weight, tuple(visit(c) for c in n.children))
            return Node(n.name, weight if n.name == shard else n.weight)

        return HashTree(tuple(visit(r) for r in self.regions))

    def shard_of(self, key: Column) -> Column:
        """The number of the shard of a key, as a column expression.

        A null key counts as the text "null".
        """
        nodes: list[Node] = [Node("", children=self.regions)]
        kids: list[list[int]] = []
        i = 0
        while i < len(nodes):
            kids.append(list(range(len(nodes), len(nodes) + len(nodes[i].children))))
            nodes.extend(nodes[i].children)
            i += 1
        order = {name: n for n, name in enumerate(self.shards())}
        names = F.array(*[F.lit(n.name) for n in nodes])
        loads = F.array(*[F.lit(float(n.load)) for n in nodes])
        lists = F.array(*[F.array(*[F.lit(c) for c in k]).cast("array<int>") for k in kids])
        numbers = F.array(*[F.lit(order.get(n.name, -1)) for n in nodes])
        text = F.coalesce(key.cast("string"), F.lit("null"))

        def draw(c: Column) -> Column:
            bits = F.conv(F.substring(F.md5(F.concat(text, F.lit("|"), F.element_at(names, c + 1))), 1, 8), 16, 10)
            return -F.log((bits.cast("double") + 0.5) / 4294967296.0) / F.element_at(loads, c + 1)

        at: Column = F.lit(0)
        for _ in range(3):
            draws = F.transform(F.element_at(lists, at + 1), lambda c: F.struct(draw(c).alias("d"), c.alias("c")))
            at = F.array_min(draws)["c"]
        return F.element_at(numbers, at + 1)


def place(df: DataFrame, tree: HashTree, key: str = "doc_id", out: str = "shard") -> DataFrame:
    """Add the shard of every row. One scan, no shuffle."""
    return df.withColumn(out, tree.shard_of(F.col(key)))


def write_shards(df: DataFrame, tree: HashTree, path: str, key: str = "doc_id", parts: int = 8) -> None:
    """Write the rows as Parquet, one folder a shard, each in ``parts`` files."""
    placed = place(df, tree, key, "shard").withColumn("__part", F.pmod(F.xxhash64(key), F.lit(parts)))
    placed.repartition("shard", "__part").drop("__part").write.partitionBy("shard").parquet(path)


def shard_report(docs: DataFrame, tree: HashTree, slot_parts: int = 256) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document.

    Null texts have no bytes and the checksum of the empty text; a null id is placed as
    the key "null" and returned as null. Repeated rows are placed alike and get slots of
    their own. Other columns of the input are left out. An empty table gives no rows.
    Slots come from :func:`gapless_rank`, with at most (shards x ``slot_parts``) shifts.
    """
    light = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("text_crc32"),
    )
    placed = place(light, tree, "doc_id", "shard")
    ranked = gapless_rank(placed, "shard", ["doc_id", "size", "text_crc32"], "slot", slot_parts)
    return ranked.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        tree.grown().shard_of(F.col("doc_id")).cast("int").alias("grown_shard"),
    )
