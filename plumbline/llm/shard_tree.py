"""Sharding by a hierarchical weighted hash tree.

Regions hold racks and racks hold shards. A document descends from the root:
at each level every child makes a weighted hash draw and the smallest
``-ln(u) / weight`` wins, so a child gets its weight's share of the documents.
A child's draw depends on the document, the child's name and its weight only:
a change of weights moves documents at levels where a weight changed, into or
out of those subtrees, and nowhere else.

A shard that is added opens a region of its own. No weight of another subtree
changes, so the new shard takes documents only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import cut

#: Bytes that a document takes besides its text.
OVERHEAD = 16
#: Rows of one bucket in which slots are numbered together, on average over all shards.
BUCKET_ROWS = 50_000


@dataclass(frozen=True)
class Node:
    """A region, rack or shard: its name, and its children or its shard's number and weight."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int = -1
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight

    @property
    def shards(self) -> list[int]:
        return [s for c in self.children for s in c.shards] if self.children else [self.shard]


def build_tree(n_shards: int, regions: int = 5, racks: int = 2, weights: list[float] | None = None) -> Node:
    """A tree of ``n_shards`` shards dealt evenly over racks and regions; ``weights`` are the shards'."""
    if n_shards < 1:
        raise ValueError("a tree needs a shard")
    cells = [(r, k) for r in range(regions) for k in range(racks)]
    held: dict[tuple[int, int], list[Node]] = {}
    for s in range(n_shards):
        cell = cells[s * len(cells) // n_shards]
        held.setdefault(cell, []).append(Node(f"shard{s}", shard=s, own_weight=weights[s] if weights else 1.0))
    out = []
    for r in range(regions):
        own = tuple(Node(f"region{r}/rack{k}", tuple(held[r, k])) for k in range(racks) if (r, k) in held)
        if own:
            out.append(Node(f"region{r}", own))
    return Node("root", tuple(out))


def add_shard(tree: Node, weight: float = 1.0) -> Node:
    """``tree`` with one more shard, numbered next, in a region of its own."""
    s = max(tree.shards) + 1
    leaf = Node(f"shard{s}", shard=s, own_weight=weight)
    return Node(tree.name, (*tree.children, Node(f"grown{s}", (Node(f"grown{s}/rack0", (leaf,)),))))


def _depth(node: Node) -> int:
    return 1 + max(map(_depth, node.children)) if node.children else 0


def _table(root: Node) -> Column:
    """Literal map from the name of each region and rack to its children: name, place and weight."""
    inner, todo = [], [root]
    while todo:
        node = todo.pop(0)
        if node.children:
            inner.append(node)
            todo += node.children
    children = [F.array(*[F.struct(F.lit(c.name).alias("name"), F.lit(k).alias("place"), F.lit(c.weight).alias("weight")) for k, c in enumerate(n.children)]) for n in inner]
    return F.map_from_arrays(F.array(*[F.lit(n.name) for n in inner]), F.array(*children))


def descend(docs: DataFrame, key: Column, root: Node, name: str) -> DataFrame:
    """``docs`` with the shard that ``key`` reaches from ``root`` as ``name``; ties go to the first child.

    A level is one expression over the children of the node reached: the
    smallest -ln(u) / weight, with u in (0, 1) from 52 bits of the hash of key
    and child.
    """
    at, tree = f"_{name}", _table(root)
    docs = docs.withColumn(at, F.lit(root.name))

    def draw(child: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, child["name"]), 12).cast("double")
        return F.struct((-F.log((bits + F.lit(0.5)) / F.lit(float(2**52))) / child["weight"]).alias("draw"), child["place"].alias("place"), child["name"].alias("name"))

    for _ in range(_depth(root)):
        children = F.try_element_at(tree, F.col(at))
        docs = docs.withColumn(at, F.coalesce(F.array_min(F.transform(children, draw))["name"], F.col(at)))
    return docs.withColumn(name, F.substring_index(F.col(at), "shard", -1).cast("int")).drop(at)


def assign(docs: DataFrame, tree: Node, grown: Node | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, size, text_crc32, law ``key``, shard and grown_shard (where ``grown`` leads).

    Null texts have no bytes (crc32 of the empty string). A null id is a key
    like any other. Equal ids share a shard. Other columns are ignored.
    """
    key, text = F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    rows = descend(rows, key, tree, "shard")
    return descend(rows, key, grown, "grown_shard") if grown else rows.withColumn("grown_shard", F.lit(None).cast("int"))


def with_slots(rows: DataFrame, id_col: str = "doc_id", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``rows`` with ``slot``: their place in their shard, from 0 without gaps.

    The rows, without texts, are cut off first, so ``docs`` is read once. Equal
    rows are counted together; a shard's distinct rows are dealt into buckets by
    the hash of their id and content, numbered within a bucket by running counts
    and moved by the sizes of the buckets before. Runs of equal rows are
    written out again in pieces of ``bucket_rows``. So no task sees a whole shard
    or all copies of a row. An empty table gives no rows.
    """
    names = rows.columns
    counted = cut(rows.groupBy(*names).agg(F.count("*").alias("n")))
    total, most = counted.agg(F.sum("n"), F.max("n")).first()
    buckets = max(1, -(-(total or 0) // bucket_rows))
    placed = counted.withColumn("bucket", F.pmod(F.xxhash64(id_col, "text_crc32"), F.lit(buckets)))
    ahead = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = placed.groupBy("shard", "bucket").agg(F.sum("n").alias("n"))
    starts = sizes.select("shard", "bucket", ahead(Window.partitionBy("shard").orderBy("bucket")).alias("before"))
    first = ahead(Window.partitionBy("shard", "bucket").orderBy(F.col(id_col), "text_crc32", "size"))
    runs = placed.withColumn("at", first).join(starts, ["shard", "bucket"]).withColumn("at", F.col("at") + F.col("before"))
    pieces = runs.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / bucket_rows))))
    if (most or 0) > bucket_rows:
        pieces = pieces.repartition(F.col("shard"), F.col("bucket"), F.col("piece"))
    low = F.col("piece") * bucket_rows
    each = F.explode(F.sequence(low, F.least(low + bucket_rows, F.col("n")) - 1))
    return pieces.withColumn("copy", each).withColumn("slot", F.col("at") + F.col("copy")).select(*names, "slot")
