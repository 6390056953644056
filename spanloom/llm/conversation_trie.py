"""Conversation prefix trie: chained digests of every prefix, grouped into nodes, with subtree sums.

A turn's digest covers role and text; the digest of a prefix chains the digests of its turns. Chains
are computed in blocks of ``BLOCK`` turns that are chained in turn, so no task holds a whole
conversation. Every prefix is one row; (depth, digest) makes a node, whose owner is its smallest
conversation. A conversation owns the lower end of its own path, so the nodes fall into one chain
for each owner. For subtree sums a chain goes to all chains above it, at the depth where its
conversation's path leaves them: those are the owners on its path, so there are never more such rows
than prefixes (each node to each of its ancestors would be quadratic in the length of a
conversation). Suffix sums along a chain finish the job, in blocks of depth as well.

The ids that end at a node are joined in ranges of ``IDS`` ids, and the ranges stream in order
through one running hash, so a node where very many conversations end needs no long list.

Only digests and lengths move; a first turn or a conversation that very many share is combined
before each exchange, and the look-up of owners is a join that Spark splits.

Edge cases: turns are ordered by number, nulls first, those of one number by digest; null roles and
texts are empty ones; rows without a conversation id belong to none; repeated rows are repeated
turns; without conversations there is no root and no row; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanloom.llm.common import Scratch, materialize, ranked

BLOCK = 1024
IDS = 256
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _root() -> Column:
    """The digest of no turns."""
    return F.unhex(F.lit(""))


def _digest(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def turn_digest() -> Column:
    """SHA-256 of a turn; the role's length keeps (role, text) apart from other splits."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return _digest(F.concat_ws(":", F.length(role).cast("string"), F.concat(role, text)).cast("binary"))


def chained(turns: DataFrame, key: list[str], longest: int, block: int = BLOCK) -> DataFrame:
    """(key, d, len, digest, above) of rows (key, d, len, t): the digest after each turn and the one
    before it. ``d`` counts from 1 without gaps; ``longest`` is the largest."""
    cut = turns.withColumn("_b", F.floor((F.col("d") - 1) / block).cast("long")).groupBy(*key, "_b")
    rows = cut.agg(F.sort_array(F.collect_list(F.struct("d", "len", "t"))).alias("_rows"))
    grow = lambda s, r: F.struct(_digest(s["last"], r["t"]).alias("last"))
    step = lambda s, r: F.concat(s, F.array(grow(F.struct(F.coalesce(F.try_element_at(s, F.lit(-1)), _root()).alias("last")), r)["last"]))
    local = rows.withColumn("_own", F.aggregate("_rows", F.array().cast("array<binary>"), step))
    if longest <= block:
        local = local.withColumns({"_before": F.lit(None).cast("binary"), "_above": _root()})
    else:
        ends = local.select(*key, (F.col("_b") + 1).alias("d"), F.lit(0).alias("len"), F.element_at("_own", -1).alias("t"))
        upper = chained(ends, key, -(-longest // block), block).select(*key, F.col("d").alias("_b"), F.col("digest").alias("_before"))
        local = local.join(upper, [*key, "_b"], "left")
        last = local.select(*key, (F.col("_b") + 1).alias("_b"), _whole(F.element_at("_own", -1)).alias("_above"))
        local = local.join(last, [*key, "_b"], "left").withColumn("_above", F.coalesce("_above", _root()))
    own = F.transform("_own", lambda x: _whole(x))
    pairs = F.arrays_zip(F.col("_rows").alias("r"), own.alias("digest"), F.concat(F.array("_above"), own).alias("above"))
    flat = local.select(*key, F.explode(pairs).alias("p")).where("p.r IS NOT NULL")
    return flat.select(*key, F.col("p.r.d").alias("d"), F.col("p.r.len").alias("len"), "p.digest", "p.above")


def _whole(own: Column) -> Column:
    """A digest of the whole prefix from one of its block and that of the blocks before."""
    return F.when(F.col("_before").isNull(), own).otherwise(_digest(F.col("_before"), own))


def rebuilt(turns: DataFrame, store) -> tuple[DataFrame, DataFrame]:
    """The contract's conversations: (conv_id, d, len, t) and (conv_id, n), the number of turns."""
    slim = turns.where("conv_id IS NOT NULL").select("conv_id", "turn", turn_digest().alias("t"), F.length(F.coalesce("text", F.lit(""))).alias("len"))
    placed = store(ranked(slim, ["conv_id"], ["turn", "t"], "k", store), "turns")
    counts = placed.groupBy("conv_id").agg(F.max("k").alias("own"))
    heads = placed.where("k <= 5").select(F.col("conv_id").alias("base"), "k", "t", "len")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    convs = counts.select("conv_id", "own", (F.col("conv_id") - F.col("conv_id") % 100).alias("base"), h.alias("h"))
    convs = convs.join(heads.groupBy("base").agg(F.max("k").alias("_most")), "base", "left")
    taken = F.least("h", F.coalesce("_most", F.lit(0)))
    convs = store(convs.select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.lit(0), F.col("own") - F.col("h"))).alias("n")), "convs")
    first = convs.join(heads, "base").where("k <= h").select("conv_id", F.col("k").alias("d"), "len", "t")
    rest = placed.join(convs, "conv_id").where("k > h").select("conv_id", (F.col("k") - F.col("h") + F.col("taken")).alias("d"), "len", "t")
    return first.unionByName(rest), convs.select("conv_id", "n")


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a node from its ranges of ids, which come one after another in order."""
    node, running = None, None
    for batch in batches:
        done: list[tuple] = []
        for *key, ids in zip(*(c.to_pylist() for c in batch.columns[:2]), batch.column(3).to_pylist(), strict=True):
            if key != node:
                if node is not None:
                    done.append((*node, running.hexdigest()))
                node, running = key, hashlib.sha256(ids.encode())
            else:
                running.update(b"," + ids.encode())
        if done:
            yield _ended(done)
    if node is not None:
        yield _ended([(*node, running.hexdigest())])


def _ended(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["d", "digest", "ends_sha256"])


def ends(last: DataFrame) -> DataFrame:
    """(d, digest, ends_sha256) of rows (conv_id, d, digest): who ends where."""
    some = last.groupBy("d", "digest", F.floor(F.col("conv_id") / IDS).alias("part")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    text = some.select(F.col("d").cast("long").alias("d"), "digest", "part", F.concat_ws(",", F.col("ids").cast("array<string>")).alias("ids"))
    return text.repartition("d", "digest").sortWithinPartitions("d", "digest", "part").mapInArrow(_hashes, "d long, digest binary, ends_sha256 string")


def suffix_sums(rows: DataFrame, key: str, at: str, values: list[str], block: int = BLOCK) -> DataFrame:
    """``rows`` with each value replaced by its sum over the rows of the key from ``at`` on, in blocks."""
    cut = rows.withColumn("_b", F.floor(F.col(at) / block).cast("long"))
    after = W.partitionBy(key).orderBy(F.desc("_b")).rowsBetween(W.unboundedPreceding, -1)
    whole = cut.groupBy(key, "_b").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    later = whole.select(key, "_b", *[F.coalesce(F.sum(f"_{v}").over(after), F.lit(0)).alias(f"_{v}") for v in values])
    inside = W.partitionBy(key, "_b").orderBy(F.desc(at))
    own = cut.withColumns({v: F.sum(v).over(inside) for v in values})
    return own.join(later, [key, "_b"]).withColumns({v: F.col(v) + F.col(f"_{v}") for v in values}).select(*rows.columns)


def trie(turns: DataFrame, convs: DataFrame, store, block: int = BLOCK) -> DataFrame:
    """All nodes of conversations (conv_id, d, len, t) and their numbers of turns (conv_id, n)."""
    longest = convs.agg(F.max("n")).first()[0] or 0
    paths = store(chained(turns, ["conv_id"], longest, block), "paths")
    shape = [F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")]
    root = convs.agg(*shape).where("n_convs > 0").select(F.lit(0).cast("long").alias("d"), _root().alias("digest"), F.lit(None).cast("binary").alias("above"), "conv_id", "n_convs", F.lit(0).alias("len"))
    below = paths.groupBy("d", "digest").agg(F.min("above").alias("above"), *shape, F.min("len").alias("len"))
    nodes = store(below.unionByName(root), "nodes")
    parents = nodes.select((F.col("d") + 1).alias("d"), F.col("digest").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    children = nodes.where("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("above").alias("digest")).agg(F.count(F.lit(1)).alias("n_children"))
    last = paths.join(convs, "conv_id").where("d = n").select("conv_id", "d", "digest")
    last = last.unionByName(convs.where("n = 0").select("conv_id", F.lit(0).cast("long").alias("d"), _root().alias("digest")))
    full = nodes.join(parents, ["d", "above"], "left").join(children, ["d", "digest"], "left").join(ends(last), ["d", "digest"], "left")
    full = store(
        full.select(
            "conv_id", F.col("d").cast("long").alias("depth"), "digest", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
            F.col("n_children").isNull().cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("len")).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
        ),
        "full-nodes",
    )
    sums = ["n_leaves", "saved_tokens"]
    totals = full.groupBy("conv_id").agg(*[F.sum(v).alias(v) for v in sums])
    owners = nodes.select("d", "digest", F.col("conv_id").alias("owner"))
    tops = convs.select("conv_id", F.lit(0).cast("long").alias("d"), _root().alias("digest"))
    met = paths.select("conv_id", "d", "digest").unionByName(tops).join(owners, ["d", "digest"])
    leaves = met.where("conv_id <> owner").groupBy("conv_id", "owner").agg(F.max("d").alias("depth"))
    hung = leaves.join(totals, "conv_id").groupBy(F.col("owner").alias("conv_id"), "depth").agg(*[F.sum(v).alias(f"hung_{v}") for v in sums])
    points = full.join(hung, ["conv_id", "depth"], "left").withColumns({v: F.col(v) + F.coalesce(f"hung_{v}", F.lit(0)) for v in sums}).select(*full.columns)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", *sums]
    return suffix_sums(points, "conv_id", "depth", sums, block).select(*[F.col(c).cast("long").alias(c) for c in names], "ends_sha256")


def prefix_trie(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """The contract's query: conversations rebuilt from the first turns of their hundred, and their trie."""
    scratch = Scratch()
    done = materialize(trie(*rebuilt(turns, scratch), scratch, block), "trie")
    scratch.drop()
    return done
