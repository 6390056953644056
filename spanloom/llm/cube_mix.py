"""Mixing sources to target weights by cube-method balanced sampling.

Every source gets a target number of words; its documents are all taken ``floor(r)`` times,
``r = target / size``, and a balanced sample of them once more with inclusion probability
``r - floor(r)``. The flight phase of the cube method moves three fractional probabilities at a
time along the null space of the two constraints (documents, words) until one of them reaches 0
or 1, so both totals of a source stay exact. It runs in blocks of some thousand documents of one
source; each block leaves at most two fractional documents, which the next level gathers into
blocks again, until one block for each source is left. Only its last two or three documents are
rounded: the landing, by the combination whose totals are nearest.

Blocks depend on ids and counts only, and random draws are hashes of the ids, so reruns and
other cluster sizes give the same mix. A block is a run of sorted rows of at most ``block`` rows,
worked off as a stream, whatever the size of its source.

Edge cases: null texts have size 0; null sources are one source, after all others; sources
whose target is 0 give 0; sizes may repeat, rows may repeat (they are drawn in sorted order);
an empty table gives an empty mix; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanloom.llm.common import WORD, materialize

ROWS = "src long, block long, h long, doc_id long, size long, p double, base long, taken long"


def targets(sizes: DataFrame, share: float = 1.5, limit: float = 2.0, weights: tuple[float, ...] = (3.0, 1.0, 2.0)) -> DataFrame:
    """One row a source: src (its rank), source, source_size, docs, target.

    Targets are ``min(limit * size, level * weight)``: the level at which they add up to
    ``share`` of all sizes is found with running sums over the sources in the order in which they
    reach their limit. The rows here are sources, counted beforehand.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    src = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("src", src.cast("long"))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("src") % len(weights) + 1).cast("int"))
    per = per.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(limit))
    by_cap = W.orderBy(F.col("cap") / F.col("w"), "src")
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_w = F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    levelled = per.withColumn("lv", left / open_w).withColumn("fits", F.col("cap") / F.col("w") >= F.col("lv"))
    level = F.min(F.when(F.col("fits"), F.struct((F.col("cap") / F.col("w")).alias("o"), "src", "lv"))).over(whole)["lv"]
    return levelled.withColumn("level", level).select(
        "src", "source", "source_size", "docs",
        F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("w"))).alias("target"),
    )


def _land(units: list[list]) -> None:
    """Round the last fractional units of a source: of all roundings, the nearest totals."""
    docs, words = sum(u[5] for u in units), sum(u[5] * u[4] for u in units)
    best = min(
        product((0.0, 1.0), repeat=len(units)),
        key=lambda c: (abs(sum(x * u[4] for x, u in zip(c, units, strict=True)) - words), abs(sum(c) - docs), c),
    )
    for u, x in zip(units, best, strict=True):
        u[5] = x


def flight(units: Iterator[list], done) -> list[list]:
    """Move fractional probabilities (item 5) of units with sizes (item 4) until at most two
    are left; hash draws (item 2) choose the direction. Settled units go to ``done``."""
    live: list[list] = []
    for u in units:
        if u[5] <= 1e-9 or u[5] >= 1 - 1e-9:
            u[5] = round(u[5])
            done(u)
            continue
        live.append(u)
        while len(live) == 3:
            a, b, c = live
            v = (b[4] - c[4], c[4] - a[4], a[4] - b[4])  # orthogonal to (1, 1, 1) and to the sizes
            if v == (0, 0, 0):
                v = (1, -1, 0)
            up = min((1 - x[5]) / k if k > 0 else -x[5] / k for x, k in zip(live, v, strict=True) if k)
            down = min(x[5] / k if k > 0 else (x[5] - 1) / k for x, k in zip(live, v, strict=True) if k)
            coin = ((a[2] ^ (b[2] * 3) ^ (c[2] * 7)) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) / 2.0**64
            step = up if coin * (up + down) < down else -down
            rest = []
            for x, k in zip(live, v, strict=True):
                x[5] += step * k
                if x[5] <= 1e-9 or x[5] >= 1 - 1e-9:
                    x[5] = float(round(x[5]))
                    done(x)
                else:
                    rest.append(x)
            live = rest
    return live


def _fly(block: int, last: bool):
    names = [f.strip().split()[0] for f in ROWS.split(",")]
    types = [pa.float64() if n == "p" else pa.int64() for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = []

        def settle(u: list) -> None:
            u[7] = u[4] * (u[6] + int(u[5]))
            out.append(u)

        def emit() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [[] for _ in names]
            made = pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)
            out.clear()
            return made

        def finish(group: list[list]) -> None:
            left = flight(iter(group), settle)
            if last:
                _land(left)
                for u in left:
                    settle(u)
            else:
                out.extend(left)  # taken stays null: still open

        group: list[list] = []
        for b in batches:
            for u in map(list, zip(*(b.column(n).to_pylist() for n in names), strict=True)):
                if group and (u[0] != group[0][0] or u[1] != group[0][1] or (len(group) >= block and not last)):
                    finish(group)
                    group = []
                    if len(out) >= 20_000:
                        yield emit()
                group.append(u)
        if group:
            finish(group)
        yield emit()

    return run


def _block_of(docs: Column, size: int, h: Column) -> Column:
    return F.pmod(h, F.greatest(F.lit(1), F.ceil(docs / F.lit(size)))).cast("long")


def mix(docs: DataFrame, share: float = 1.5, limit: float = 2.0, weights: tuple[float, ...] = (3.0, 1.0, 2.0), block: int = 4096, seed: int = 7) -> DataFrame:
    """doc_id, size, source, source_size, target, taken for every document."""
    sizes = materialize(
        docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("t")), "mix-sizes"
    )
    goal = materialize(targets(sizes, share, limit, weights), "mix-targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = sizes.alias("d").join(goal.alias("g"), F.col("d.source").eqNullSafe(F.col("g.source")))
    h = F.xxhash64(F.lit(seed), "d.doc_id", "d.size", "d.t")  # null or repeated ids still spread over blocks
    level = rows.select(
        "src", _block_of(F.col("docs"), block // 2, h).alias("block"), h.alias("h"), F.col("d.doc_id").cast("long").alias("doc_id"), "size",
        (ratio - F.floor(ratio)).alias("p"), F.floor(ratio).cast("long").alias("base"), F.lit(None).cast("long").alias("taken"),
    )
    blocks = goal.agg(F.max(F.ceil(F.col("docs") / (block // 2)))).first()[0] or 1
    found, depth = None, 0
    while True:
        last = blocks <= 1
        dealt = level.repartition("src", "block").sortWithinPartitions("src", "block", "h", "doc_id", "size")
        flown = materialize(dealt.mapInArrow(_fly(block, last), ROWS), f"mix-level{depth}")
        closed = flown.where("taken is not null")
        found = closed if found is None else found.unionByName(closed)
        if last:
            break
        shrink = block // 4
        blocks, depth = -(-blocks // shrink), depth + 1
        level = flown.where("taken is null").withColumn("block", F.floor(F.col("block") / F.lit(shrink)).cast("long"))
    return found.alias("f").join(goal.alias("g"), "src").select("doc_id", "size", "source", "source_size", "target", "taken")


def taken_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it: 0, 1 or 2 times.

    Documents without words are taken no time. Rows that share an id and a source are alike for
    the mix; what it takes of them is dealt to them in the order of their texts.
    """
    mixed = mix(docs, **options).where("size > 0").select("doc_id", "source", "size", (F.col("taken") / F.col("size")).cast("int").alias("times"))
    alike = W.partitionBy("doc_id", "source", "size")
    dealt = mixed.withColumn("i", F.row_number().over(alike.orderBy("times"))).where("times > 0").alias("m")
    # whole rows travel as one column, so that no name of theirs can clash
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", size.alias("size"), F.xxhash64("text").alias("h")).where("size > 0")
    rows = rows.withColumn("i", F.row_number().over(W.partitionBy("doc_id", "source", "size").orderBy("h"))).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & F.col("d.source").eqNullSafe(F.col("m.source")) & (F.col("d.size") == F.col("m.size")) & (F.col("d.i") == F.col("m.i"))
    taken = rows.join(dealt, same).select("d.row", F.explode(F.sequence(F.lit(1), F.col("m.times"))).alias("copy"))
    return taken.select("row.*")
