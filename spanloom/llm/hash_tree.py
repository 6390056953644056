"""Hierarchical weighted hash tree: region, rack and shard are drawn level by level.

Every node of a level gets a straw for a key, ``-ln(u) / weight`` with ``u`` a hash of key and
node name; the shortest straw wins and the descent goes on below it. A straw depends on its own
node only, so when the weight of one subtree grows, keys move only into it, and when it shrinks,
only out of it; the rest of the tree keeps its keys.

Growing by one shard adds a region of its own (one rack, one shard). No other straw changes, so
keys move into the new shard and nowhere else.

Edge cases: a null key is the empty key; a null text has no bytes; rows with equal keys share a
shard and get different slots; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import gapless, unsigned_crc32

#: region -> rack -> shard -> weight
Tree = dict[str, dict[str, dict[int, float]]]

SCALE = 2.0**52


def even_tree(shards: int = 16, per_rack: int = 4, racks: int = 2) -> Tree:
    """Shards of weight 1, ``per_rack`` to a rack and ``racks`` racks to a region."""
    tree: Tree = {}
    for s in range(shards):
        rack = s // per_rack
        tree.setdefault(f"g{rack // racks}", {}).setdefault(f"k{rack}", {})[s] = 1.0
    return tree


def grow(tree: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, in a region of its own."""
    new = 1 + max(s for racks in tree.values() for shards in racks.values() for s in shards)
    return {**tree, f"g+{new}": {f"k+{new}": {new: weight}}}


def draw(key: Column, node: str) -> Column:
    """52 bits of an MD5 as an integer."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit("/" + node))), 1, 13), 16, 10).cast("long")


def _shortest(key: Column, nodes: list[tuple[str, float, int]]) -> Column:
    """The number of the node with the shortest straw; each node is (name, weight, number)."""
    if len(nodes) == 1:
        return F.lit(nodes[0][2])
    unit = lambda n: (draw(key, n) + F.lit(0.5)) / F.lit(SCALE)
    straws = [F.struct((-F.log(unit(n)) / F.lit(float(w))).alias("s"), F.lit(i).alias("i")) for n, w, i in nodes]
    return F.least(*straws)["i"]


def _below(parent: Column, children: dict[int, list[tuple[str, float, int]]], key: Column) -> Column:
    """The draw among the children of the node that ``parent`` names."""
    branches = [F.when(parent == i, _shortest(key, nodes)) for i, nodes in children.items()]
    return F.coalesce(*branches)


def with_shard(df: DataFrame, key: str, tree: Tree, out: str) -> DataFrame:
    """Add the shard that the tree draws for a string column; each level is a column of its own."""
    top, racks_of, shards_of, rack_no = [], {}, {}, 0
    for g, (region, racks) in enumerate(tree.items()):
        top.append((region, sum(sum(shards.values()) for shards in racks.values()), g))
        racks_of[g] = []
        for rack, shards in racks.items():
            racks_of[g].append((rack, sum(shards.values()), rack_no))
            shards_of[rack_no] = [(f"s{s}", w, s) for s, w in shards.items()]
            rack_no += 1
    k = F.col(key)
    drawn = df.withColumn("_region", _shortest(k, top))
    drawn = drawn.withColumn("_rack", _below(F.col("_region"), racks_of, k))
    drawn = drawn.withColumn(out, _below(F.col("_rack"), shards_of, k).cast("int"))
    return drawn.drop("_region", "_rack")


def place(docs: DataFrame, tree: Tree | None = None, id_col: str = "doc_id", text_col: str = "text", rows_per_bucket: int = 50_000) -> DataFrame:
    """Shard, slot in the shard and the shard after growing by one, for every document.

    Slots follow the hash order of the keys. They come from counts of buckets (a power of two
    of them, about ``rows_per_bucket`` rows each), so no task ever sorts a whole shard.
    """
    tree = tree or even_tree()
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.count()
    bits = max(0, min(40, (max(1, rows // rows_per_bucket) - 1).bit_length()))
    text = F.coalesce(F.col(text_col), F.lit(""))
    placed = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        unsigned_crc32(F.col(text_col)).alias("text_crc32"),
        draw(key, "slot").alias("_h"),
        key.alias("_k"),
    )
    placed = with_shard(with_shard(placed, "_k", tree, "shard"), "_k", grow(tree), "grown_shard").drop("_k")
    numbered = gapless(placed, ["shard"], F.shiftright("_h", 52 - bits), ["_h", "doc_id", "size", "text_crc32"], "slot")
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
