"""Evaluation: additive components for each uri, rates from sums of components.

All matching is closed form: inside an elementary piece two label multisets agree on
sum(least(counts)), so nothing is solved piece by piece.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanloom.functions.segment import Seg
from spanloom.operators import annotation as an
from spanloom.operators import mapping as mp
from spanloom.operators import matrix as mx
from spanloom.operators import tagging as tg
from spanloom.operators import timeline as tl

CELL = ("uri", "start", "end")


def ratio(top: Column, bottom: Column, both_zero: float, bottom_zero: float | None) -> Column:
    """top / bottom with stated values where bottom is 0 (null: no value)."""
    other = F.lit(bottom_zero).cast("double") if bottom_zero is not None else F.lit(None).cast("double")
    return F.when(bottom != 0, top / bottom).when(top == 0, F.lit(both_zero)).otherwise(other)


def totals(parts: DataFrame, components: list[str]) -> DataFrame:
    """Components for each uri and, as uri '/all', their sums."""
    rolled = parts.rollup("uri").agg(*[F.sum(c).alias(c) for c in components], F.grouping("uri").alias("_g"))
    return rolled.withColumn("uri", F.when(F.col("_g") == 1, F.lit("/all")).otherwise(F.col("uri"))).drop("_g")


def _sides(reference: DataFrame, hypothesis: DataFrame) -> DataFrame:
    flag = lambda df: df.select(*CELL, "label", (F.col("is_unknown") if "is_unknown" in df.columns else F.lit(False)).alias("unknown"))
    return flag(reference).withColumn("ref", F.lit(1)).unionByName(flag(hypothesis).withColumn("ref", F.lit(0)))


def cell_labels(reference: DataFrame, hypothesis: DataFrame, bins: float | None = None) -> DataFrame:
    """(cell, label key, r, h): how often a label runs on each side of every elementary piece.

    One join of pieces with the rows of both sides; unknown labels are pooled under one key.
    """
    sides = _sides(reference, hypothesis)
    pieces = tl.cells(sides)
    met = tl.overlap_join(pieces, sides, bins=bins)
    key = F.when(F.col("b_unknown"), F.lit("\u0000unknown")).otherwise(F.col("b_label"))
    return met.groupBy("uri", F.col("a_start").alias("start"), F.col("a_end").alias("end"), key.alias("label")).agg(
        F.sum("b_ref").alias("r"), F.sum(1 - F.col("b_ref")).alias("h")
    )


def detection(reference: DataFrame, hypothesis: DataFrame, bins: float | None = None) -> DataFrame:
    """uri, miss, false_alarm, total, rate: by numbers of distinct labels."""
    per = cell_labels(reference, hypothesis, bins).groupBy(*CELL).agg(F.count_if(F.col("r") > 0).alias("nr"), F.count_if(F.col("h") > 0).alias("nh"))
    d = F.col("end") - F.col("start")
    parts = per.groupBy("uri").agg(
        F.sum(d * F.greatest(F.lit(0), F.col("nr") - F.col("nh"))).alias("miss"),
        F.sum(d * F.greatest(F.lit(0), F.col("nh") - F.col("nr"))).alias("false_alarm"),
        F.sum(d * F.col("nr")).alias("total"),
    )
    out = totals(parts, ["miss", "false_alarm", "total"])
    return out.withColumn("rate", ratio(F.col("miss") + F.col("false_alarm"), F.col("total"), 0.0, 1.0))


IDENTIFICATION = ["correct", "confusion", "miss", "false_alarm", "total", "retrieved"]


def identification_parts(reference: DataFrame, hypothesis: DataFrame, bins: float | None = None) -> DataFrame:
    per = cell_labels(reference, hypothesis, bins).groupBy(*CELL).agg(
        F.sum(F.least("r", "h")).alias("c"), F.sum("r").alias("nr"), F.sum("h").alias("nh")
    )
    d = F.col("end") - F.col("start")
    return per.groupBy("uri").agg(
        F.sum(d * F.col("c")).alias("correct"),
        F.sum(d * (F.least("nr", "nh") - F.col("c"))).alias("confusion"),
        F.sum(d * F.greatest(F.lit(0), F.col("nr") - F.col("nh"))).alias("miss"),
        F.sum(d * F.greatest(F.lit(0), F.col("nh") - F.col("nr"))).alias("false_alarm"),
        F.sum(d * F.col("nr")).alias("total"),
        F.sum(d * F.col("nh")).alias("retrieved"),
    )


def identification(
    reference: DataFrame, hypothesis: DataFrame, unknown: bool = True, confusion: float = 1.0, miss: float = 1.0, false_alarm: float = 1.0, bins: float | None = None
) -> DataFrame:
    """Components and the weighted error rate; ``unknown=False`` leaves anonymous rows out."""
    if not unknown:
        reference, hypothesis = _known(reference), _known(hypothesis)
    out = totals(identification_parts(reference, hypothesis, bins), IDENTIFICATION)
    errors = confusion * F.col("confusion") + miss * F.col("miss") + false_alarm * F.col("false_alarm")
    return out.withColumn("rate", ratio(errors, F.col("total"), 0.0, 1.0))


def _known(df: DataFrame) -> DataFrame:
    return df.where(~F.col("is_unknown")) if "is_unknown" in df.columns else df


def identification_quality(reference: DataFrame, hypothesis: DataFrame) -> DataFrame:
    """Precision and recall over known labels, and their f-measure."""
    out = totals(identification_parts(_known(reference), _known(hypothesis)), IDENTIFICATION)
    p, r = ratio(F.col("correct"), F.col("retrieved"), 1.0, None), ratio(F.col("correct"), F.col("total"), 1.0, None)
    return out.select("uri", "correct", "retrieved", F.col("total").alias("relevant"), p.alias("precision"), r.alias("recall")).withColumn("f_measure", f_measure(F.col("precision"), F.col("recall")))


def f_measure(p: Column, r: Column, beta: float = 1.0) -> Column:
    bottom = beta * beta * p + r
    return F.when(bottom > 0, (1 + beta * beta) * p * r / bottom).otherwise(F.lit(0.0))


def diarization(reference: DataFrame, hypothesis: DataFrame, **weights) -> DataFrame:
    """Identification error after the best one-to-one relabelling of the hypothesis."""
    return identification(reference, mp.translated(hypothesis, mp.hungarian_mapper(hypothesis, reference)), **weights)


def purity(reference: DataFrame, hypothesis: DataFrame, detection_error: bool = True, per_cluster: bool = False) -> DataFrame:
    """Share of the hypothesis' clusters that their main reference labels cover."""
    if not detection_error:
        shared = tl.crop(tl.islands(reference), tl.islands(hypothesis))
        reference, hypothesis = an.crop(reference, shared), an.crop(hypothesis, shared)
    best = mx.cooccurrence(hypothesis, reference).groupBy("uri", F.col("row").alias("label")).agg(F.max("value").alias("best"))
    long = an.label_durations(hypothesis).join(best, ["uri", "label"], "left").withColumn("best", F.coalesce("best", F.lit(0.0)))
    if per_cluster:
        parts = long.groupBy("uri").agg(F.sum(F.col("best") / F.col("duration")).alias("correct"), F.count(F.lit(1)).cast("double").alias("total"))
    else:
        parts = long.groupBy("uri").agg(F.sum("best").alias("correct"), F.sum("duration").alias("total"))
    return totals(parts, ["correct", "total"]).withColumn("rate", ratio(F.col("correct"), F.col("total"), 1.0, None))


def coverage(reference: DataFrame, hypothesis: DataFrame, **options) -> DataFrame:
    return purity(hypothesis, reference, **options)


def homogeneity(reference: DataFrame, hypothesis: DataFrame) -> DataFrame:
    """1 - H(reference | hypothesis) / H(reference) from shared time."""
    k = mx.cooccurrence(reference, hypothesis)
    rows = k.groupBy("uri", "row").agg(F.sum("value").alias("p"))
    cols = W.partitionBy("uri", "col")
    total = W.partitionBy("uri")
    p = rows.withColumn("t", F.sum("p").over(total)).where("p > 0").groupBy("uri").agg((-F.sum(F.col("p") / F.col("t") * F.log(F.col("p") / F.col("t")))).alias("entropy"))
    c = k.withColumns({"h": F.sum("value").over(cols), "t": F.sum("value").over(total)}).where("value > 0")
    cross = c.groupBy("uri").agg((-F.sum(F.col("value") / F.col("t") * F.log(F.col("value") / F.col("h")))).alias("cross_entropy"))
    return p.join(cross, "uri").withColumn(
        "rate", F.when(F.col("entropy") != 0, 1 - F.col("cross_entropy") / F.col("entropy")).when(F.col("cross_entropy") == 0, 1.0).otherwise(0.0)
    )


def completeness(reference: DataFrame, hypothesis: DataFrame) -> DataFrame:
    return homogeneity(hypothesis, reference)


def segmentation_coverage(reference: DataFrame, hypothesis: DataFrame) -> DataFrame:
    """Time of the largest common part of each reference segment that meets the hypothesis."""
    both = Seg.of("a_").intersection(Seg.of("b_"))
    met = tl.overlap_join(tl.timeline(reference), tl.timeline(hypothesis))
    best = met.groupBy("uri", "a_start", "a_end").agg(F.max(both.end - both.start).alias("best"))
    parts = best.groupBy("uri").agg(F.sum("best").alias("correct"), F.sum(F.col("a_end") - F.col("a_start")).alias("total"))
    return totals(parts, ["correct", "total"]).withColumn("rate", ratio(F.col("correct"), F.col("total"), 1.0, None))


def segmentation_purity(reference: DataFrame, hypothesis: DataFrame) -> DataFrame:
    return segmentation_coverage(hypothesis, reference)


def _probe_runs(reference: DataFrame, hypothesis: DataFrame, step: float) -> DataFrame:
    """(uri, n, r0, r1, h0, h1): runs of n probes on which the ranks of the first segments at i and
    at i + k stay the same on both sides; -1 stands for no segment.

    A probe's first segment is the one of lowest rank that holds it, so what a segment holds beyond
    the ends of all before it is one run of probes. Runs come from bounds, by windows: the work
    follows the number of segments, whatever the step.
    """
    ref, hyp = tl.timeline(reference), tl.timeline(hypothesis)
    k = tl.duration(hyp).join(hyp.groupBy("uri").agg(F.count(F.lit(1)).alias("c")), "uri").select("uri", (F.col("duration") / F.col("c") / 2).alias("k"))
    ends = tl.extent(ref).join(k, "uri").where(F.col("start") < F.col("end") - F.col("k"))
    ends = ends.select("uri", "k", F.col("start").alias("t0"), F.ceil((F.col("end") - F.col("k") - F.col("start")) / step).cast("long").alias("m"))
    sides = tl.ranked(ref).withColumn("f", F.lit("r")).unionByName(tl.ranked(hyp).withColumn("f", F.lit("h")))
    shifts = F.array(F.struct(F.lit("0").alias("at"), F.lit(0.0).alias("by")), F.struct(F.lit("1").alias("at"), F.col("k").alias("by")))
    rows = sides.join(ends, "uri").withColumn("x", F.explode(shifts)).select("uri", "rank", "start", "end", "t0", "m", F.concat("f", "x.at").alias("f"), F.col("x.by").alias("by"))
    time = lambda j: F.col("t0") + j * step + F.col("by")
    rows = rows.withColumns({"lo": F.ceil((F.col("start") - F.col("by") - F.col("t0")) / step).cast("long"), "hi": F.floor((F.col("end") - F.col("by") - F.col("t0")) / step).cast("long")})
    # a quotient may be off by one: the bounds are set by the times themselves
    lo = F.when(time(F.col("lo") - 1) >= F.col("start"), F.col("lo") - 1).when(time(F.col("lo")) < F.col("start"), F.col("lo") + 1).otherwise(F.col("lo"))
    hi = F.when(time(F.col("hi") + 1) <= F.col("end"), F.col("hi") + 1).when(time(F.col("hi")) > F.col("end"), F.col("hi") - 1).otherwise(F.col("hi"))
    rows = rows.withColumns({"lo": F.greatest(lo, F.lit(0)), "hi": F.least(hi, F.col("m") - 1)})
    before = F.max("hi").over(W.partitionBy("uri", "f").orderBy("rank").rowsBetween(W.unboundedPreceding, -1))
    own = rows.withColumn("lo", F.greatest("lo", F.coalesce(before, F.lit(-1)) + 1)).where("lo <= hi")
    both = F.array(F.struct(F.col("lo").alias("j"), F.col("rank").cast("long").alias("v")), F.struct((F.col("hi") + 1).alias("j"), F.lit(-1).cast("long").alias("v")))
    events = own.select("uri", "f", F.explode(both).alias("e")).select("uri", "e.j", "f", "e.v")
    marks = ends.select("uri", F.explode(F.array(F.lit(0).cast("long"), F.col("m"))).alias("j"), F.lit("").alias("f"), F.lit(-1).cast("long").alias("v")).unionByName(events)
    names = ("r0", "r1", "h0", "h1")
    # where one run ends and the next begins, the rank beats the end
    cuts = marks.groupBy("uri", "j").agg(*[F.max(F.when(F.col("f") == n, F.col("v"))).alias(n) for n in names])
    order = W.partitionBy("uri").orderBy("j")
    held = lambda n: F.coalesce(F.last(n, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)), F.lit(-1))
    return cuts.select("uri", (F.lead("j").over(order) - F.col("j")).alias("n"), *[held(n).alias(n) for n in names]).where("n IS NOT NULL")


def _share(runs: DataFrame, agree: Column) -> DataFrame:
    return runs.groupBy("uri").agg((F.sum(F.when(agree, F.col("n")).otherwise(0)) / F.sum("n")).alias("rate"))


def pk(reference: DataFrame, hypothesis: DataFrame, step: float = 1.0) -> DataFrame:
    """Share of probes on which both sides agree whether i and i + k are in one segment."""
    same = lambda s: F.col(f"{s}0") == F.col(f"{s}1")
    return _share(_probe_runs(reference, hypothesis, step), same("r") == same("h"))


def windowdiff(reference: DataFrame, hypothesis: DataFrame, step: float = 1.0) -> DataFrame:
    """Share of probes on which both sides cross as many boundaries."""
    return _share(_probe_runs(reference, hypothesis, step), F.col("r1") - F.col("r0") == F.col("h1") - F.col("h0"))


def is_anonymous(label: Column, unknown: Column | None = None) -> Column:
    """The prefixes of anonymous labels."""
    named = label.startswith("Inconnu_") | label.startswith("speaker")
    return named if unknown is None else named | unknown


GLOBAL_PARTS = ["ref_name", "ref_anon", "hyp_name", "hyp_anon", "correct_name", "correct_anon", "name_name", "name_anon", "anon_name", "miss_name", "miss_anon", "fa_name", "fa_anon"]


def global_error(reference: DataFrame, hypothesis: DataFrame, frames: DataFrame, confusion: float = 1.0, anonymous: bool = False) -> DataFrame:
    """Estimated global error rate on annotated frames: sets of names matched greedily."""

    def sets(df: DataFrame, side: str) -> DataFrame:
        tagged = tg.argmax_timeline(df, frames)
        anon = is_anonymous(F.col("label"))
        return tagged.groupBy(*CELL).agg(
            F.collect_set(F.when(~anon, F.col("label"))).alias(f"{side}_set"), F.count_distinct(F.when(anon, F.col("label"))).alias(f"{side}_anon")
        )

    rows = tl.timeline(frames).join(sets(reference, "ref"), list(CELL), "left").join(sets(hypothesis, "hyp"), list(CELL), "left")
    for s in ("ref", "hyp"):
        rows = rows.withColumns({f"{s}_set": F.coalesce(f"{s}_set", F.array().cast("array<string>")), f"{s}_anon": F.coalesce(f"{s}_anon", F.lit(0)) if anonymous else F.lit(0)})
    rows = rows.withColumns({"ref_name": F.size("ref_set"), "hyp_name": F.size("hyp_set"), "correct_name": F.size(F.array_intersect("ref_set", "hyp_set")), "correct_anon": F.least("ref_anon", "hyp_anon")})
    rows = rows.withColumns({"rn": F.col("ref_name") - F.col("correct_name"), "hn": F.col("hyp_name") - F.col("correct_name"), "ra": F.col("ref_anon") - F.col("correct_anon"), "ha": F.col("hyp_anon") - F.col("correct_anon")})

    def pair(df: DataFrame, out: str, a: str, b: str) -> DataFrame:
        df = df.withColumn(out, F.least(a, b))
        return df.withColumns({a: F.col(a) - F.col(out), b: F.col(b) - F.col(out)})

    rows = pair(pair(pair(rows, "name_name", "rn", "hn"), "name_anon", "rn", "ha"), "anon_name", "ra", "hn")
    rows = rows.withColumns({"miss_name": F.col("rn"), "miss_anon": F.col("ra"), "fa_name": F.col("hn"), "fa_anon": F.col("ha")})
    out = totals(rows, GLOBAL_PARTS)
    total = F.col("ref_name") + F.col("ref_anon")
    errors = confusion * (F.col("name_name") + F.col("name_anon") + F.col("anon_name")) + F.col("miss_name") + F.col("miss_anon") + F.col("fa_name") + F.col("fa_anon")
    p, r = ratio(F.col("correct_name"), F.col("hyp_name"), 1.0, 1.0), ratio(F.col("correct_name"), F.col("ref_name"), 1.0, 1.0)
    return out.withColumns({"rate": ratio(errors, total, 0.0, 1.0), "precision": p, "recall": r}).withColumn("f_measure", f_measure(F.col("precision"), F.col("recall")))


def t_quantile(q: float, df: int) -> float:
    """Student t quantile by bisection on a numeric integral of the density."""
    from math import lgamma, pi, sqrt

    c = np.exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi)

    def cdf(x: float) -> float:
        u = np.linspace(0.0, x, 4001)
        y = c * (1 + u * u / df) ** (-(df + 1) / 2)
        return 0.5 + float(((y[1:] + y[:-1]) / 2 * np.diff(u)).sum())

    lo, hi = 0.0, 1e3
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < q else (lo, mid)
    return (lo + hi) / 2


def confidence_interval(rates: DataFrame, alpha: float = 0.9) -> tuple[float, float, float]:
    """Mean of the rates of all uris and the bounds of its interval."""
    m, s, n = rates.where("uri <> '/all' AND rate IS NOT NULL").agg(F.avg("rate"), F.stddev_samp("rate"), F.count("rate")).first()
    if not n or n < 2:
        return (m, m, m)
    half = t_quantile(0.5 + alpha / 2, n - 1) * s / np.sqrt(n)
    return (m, m - half, m + half)


def wilcoxon(pairs: DataFrame) -> float:
    """Two-sided p-value (normal approximation) of paired differences in columns a and b.

    Equal differences are counted first; their mean ranks come from running counts, so one row a
    distinct difference is ordered, and five sums reach the driver.
    """
    from math import erf, sqrt

    d = F.col("a") - F.col("b")
    sizes = pairs.where(d != 0).groupBy(F.abs(d).alias("size")).agg(F.count(F.lit(1)).alias("c"), F.count_if(d > 0).alias("up"))
    before = F.coalesce(F.sum("c").over(W.orderBy("size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = sizes.withColumn("rank", before + (F.col("c") + 1) / 2)
    ties = F.sum(F.pow("c", F.lit(3)) - F.col("c"))
    n, up, down, tied = ranked.agg(F.sum("c"), F.sum(F.col("rank") * F.col("up")), F.sum(F.col("rank") * (F.col("c") - F.col("up"))), ties).first()
    if not n:
        return 1.0
    var = n * (n + 1) * (2 * n + 1) / 24 - tied / 48
    z = (min(up, down) - n * (n + 1) / 4) / sqrt(var)
    return float(1 + erf(z / sqrt(2))) if z < 0 else 1.0
