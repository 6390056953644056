"""What differs between annotations: label diffs, regressions, segmentation errors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanloom.functions.assignment import assign
from spanloom.functions.segment import Seg
from spanloom.operators import annotation as an
from spanloom.operators import metrics as me
from spanloom.operators import timeline as tl
from spanloom.session import checkpoint_dir

CELL = ("uri", "start", "end")


def diff(reference: DataFrame, hypothesis: DataFrame, correct: bool = True, bins: float | None = None) -> DataFrame:
    """One row for each pair of labels in a piece: kind, ref, hyp.

    Equal labels pair up by occurrence; what is left on both sides is aligned in label order.
    """
    counts = me.cell_labels(reference, hypothesis, bins)
    same = counts.where(F.least("r", "h") > 0).select(*CELL, F.explode(F.sequence(F.lit(1).cast("long"), F.least("r", "h"))).alias("_k"), "label")
    rows = same.select(*CELL, F.lit("correct").alias("kind"), F.col("label").alias("ref"), F.col("label").alias("hyp"))

    def rest(own: str, other: str, name: str) -> DataFrame:
        n = F.col(own) - F.least("r", "h")
        left = counts.where(n > 0).select(*CELL, F.col("label").alias(name), F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("_k"))
        return left.withColumn("k", F.row_number().over(W.partitionBy(*CELL).orderBy(name, "_k"))).drop("_k")

    odd = rest("r", "h", "ref").join(rest("h", "r", "hyp"), [*CELL, "k"], "full_outer")
    kind = F.when(F.col("hyp").isNull(), "miss").when(F.col("ref").isNull(), "false alarm").otherwise("confusion")
    wrong = odd.select(*CELL, kind.alias("kind"), "ref", "hyp")
    return rows.unionByName(wrong) if correct else wrong


def diff_durations(reference: DataFrame, hypothesis: DataFrame, bins: float | None = None) -> DataFrame:
    return diff(reference, hypothesis, bins=bins).groupBy("uri", "kind").agg(F.sum(F.col("end") - F.col("start")).alias("duration"))


_VERDICT = {(True, True): "both_correct", (True, False): "regression", (False, True): "improvement", (False, False): "both_incorrect"}


@lru_cache(maxsize=50_000)
def _match(old: tuple[tuple, ...], new: tuple[tuple, ...]) -> list[tuple[str, str]]:
    """(verdict, reference label) of one piece; rows are (kind, ref, hyp), matched by how alike
    they are: 2 if the outcome is the same for the same reference, 1 if half of it, else 0.

    Most pieces repeat the rows of others, so outcomes are kept, up to a bound."""
    out, used_old, used_new = [], set(), set()
    if old and new:
        alike = np.array([[(o[1] == n[1]) * ((o[0] == n[0]) + (o[2] == n[2])) for n in new] for o in old], dtype=float)
        for i, j in assign(alike + 1e-3):
            used_old.add(i)
            used_new.add(j)
            out.append((_VERDICT[(old[i][0] == "correct", new[j][0] == "correct")], old[i][1] or new[j][1]))
    out += [("improvement", o[1]) for i, o in enumerate(old) if i not in used_old and o[0] != "correct"]
    out += [("regression", n[1]) for j, n in enumerate(new) if j not in used_new and n[0] != "correct"]
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of pieces -> verdicts; one piece is in memory at a time."""
    names, piece, sides = ["uri", "start", "end", "label", "ref"], None, {"old": [], "new": []}
    kinds = [pa.string(), pa.float64(), pa.float64(), pa.string(), pa.string()]
    rows: list[tuple] = []
    for b in batches:
        for uri, start, end, kind, ref, hyp, side in zip(*(b.column(c).to_pylist() for c in ("uri", "start", "end", "kind", "ref", "hyp", "side")), strict=True):
            if piece != (uri, start, end):
                if piece is not None:
                    rows += [(*piece, *x) for x in _match(tuple(sides["old"]), tuple(sides["new"]))]
                piece, sides = (uri, start, end), {"old": [], "new": []}
            sides[side].append((kind, ref, hyp))
        yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)
        rows = []
    if piece is not None:
        rows = [(*piece, *x) for x in _match(tuple(sides["old"]), tuple(sides["new"]))]
        yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def regression(reference: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """regression / improvement / both_correct / both_incorrect over time, smoothed.

    Pieces are dealt by (uri, bounds) and streamed in sorted order; a piece has as many rows as
    labels run at once.
    """
    checkpoint_dir(reference.sparkSession)
    smoothed, sides = an.smooth(reference).checkpoint(), []
    for name, hyp in (("old", old), ("new", new)):
        sides.append(diff(smoothed, an.smooth(hyp)).withColumn("side", F.lit(name)))
    both = sides[0].unionByName(sides[1]).checkpoint()  # read by the pieces and by what runs in them
    pieces = tl.cells(both)
    met = tl.overlap_join(pieces, both).select("uri", F.col("a_start").alias("start"), F.col("a_end").alias("end"), *[F.col(f"b_{c}").alias(c) for c in ("kind", "ref", "hyp", "side")])
    dealt = met.repartition(*CELL).sortWithinPartitions(*CELL, "side", "kind", "ref", "hyp")
    return an.smooth(dealt.mapInArrow(_compare, "uri string, start double, end double, label string, ref string"))


def segmentation_errors(reference: DataFrame, hypothesis: DataFrame) -> DataFrame:
    """Islands of 'over', 'under', 'frontier' and 'correct' segmentation."""

    def split(a: DataFrame, b: DataFrame) -> DataFrame:
        both = Seg.of("a_").intersection(Seg.of("b_"))
        met = tl.overlap_join(tl.timeline(a), tl.timeline(b)).select("uri", "a_start", "a_end", both.start.alias("start"), both.end.alias("end"))
        n = F.row_number().over(W.partitionBy("uri", "a_start", "a_end").orderBy(F.desc(F.col("end") - F.col("start")), F.desc("start")))
        return tl.islands(met.withColumn("_n", n).where("_n > 1"))

    over, under = split(reference, hypothesis), split(hypothesis, reference)
    frame = tl.extent(tl.union(reference, hypothesis))
    frontier = tl.crop(over, under)
    only = lambda x, y: tl.crop(x, tl.gaps(y, frame)).unionByName(x.join(y.select("uri").distinct(), "uri", "left_anti"))
    wrong = tl.union(over, under)
    right = tl.gaps(wrong, frame)
    parts = {"frontier": frontier, "over": only(over, under), "under": only(under, over), "correct": right}
    rows = [tl.islands(df).withColumn("label", F.lit(k)) for k, df in parts.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
