"""Scored interval relations in long form: (uri, start, end, track, label, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanloom.functions.segment import Seg
from spanloom.operators import annotation as an
from spanloom.operators import timeline as tl

TRACK = ("uri", "start", "end", "track")


def scores(df: DataFrame) -> DataFrame:
    """Mean of repeated (track, label) rows; NaN is no score."""
    known = df.where(F.col("score").isNotNull() & ~F.isnan("score"))
    return known.groupBy(*TRACK, "label").agg(F.avg("score").alias("score"))


def from_wide(df: DataFrame, names: list[str]) -> DataFrame:
    """Unpivot one column a label."""
    long = df.unpivot([F.col(c) for c in TRACK], [F.col(c) for c in names], "label", "score")
    return long.where(F.col("score").isNotNull() & ~F.isnan("score"))


def to_wide(df: DataFrame, names: list[str]) -> DataFrame:
    return df.groupBy(*TRACK).pivot("label", names).agg(F.avg("score"))


def track_scores(df: DataFrame) -> DataFrame:
    """One label -> score map a track."""
    pairs = F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "score"))))
    return df.groupBy(*TRACK).agg(pairs.alias("scores"))


def rank(df: DataFrame, invert: bool = False) -> DataFrame:
    """Rank of each label on its track, 0 the best (the lowest score if ``invert``)."""
    by = F.asc("score") if invert else F.desc("score")
    n = F.row_number().over(W.partitionBy(*TRACK).orderBy(by, "label")) - 1
    return df.where(~F.isnan("score")).withColumn("rank", n)


def nbest(df: DataFrame, n: int, invert: bool = False) -> DataFrame:
    return rank(df, invert).where(F.col("rank") < n).drop("rank")


def scan(df: DataFrame, reverse: bool = False) -> DataFrame:
    return df.orderBy(*[F.desc(c) if reverse else F.asc(c) for c in TRACK])


def crop(df: DataFrame, focus: DataFrame, mode: str = "strict") -> DataFrame:
    """Crop by the elementary pieces of the focus (they never overlap, unlike the focus itself)."""
    pieces = tl.cells(focus)
    if mode in ("strict", "loose"):
        return tl.crop(df, pieces, mode)
    if mode != "intersection":
        raise NotImplementedError(mode)
    both = Seg.of("a_").intersection(Seg.of("b_"))
    return tl.overlap_join(df, pieces).select(
        "uri", both.start.alias("start"), both.end.alias("end"), F.concat_ws("@", "a_track", F.format_string("%.3f", F.col("a_start")), F.format_string("%.3f", F.col("a_end"))).alias("track"),
        F.col("a_label").alias("label"), F.col("a_score").alias("score"),
    )


def subset(df: DataFrame, wanted: list[str], invert: bool = False) -> DataFrame:
    return an.subset(df, wanted, invert)


def to_annotation(df: DataFrame, threshold: float = float("-inf"), posterior: bool = False) -> DataFrame:
    """The best label of each track, or an unknown one below the threshold.

    In posterior mode, what the scores leave of 1 is the probability of an unknown label.
    """
    n = F.row_number().over(W.partitionBy(*TRACK).orderBy(F.desc("score"), "label"))
    total = F.sum("score").over(W.partitionBy(*TRACK))
    top = df.where(~F.isnan("score")).withColumns({"_n": n, "_total": total}).where("_n = 1")
    low = F.col("score") < F.lit(threshold)
    if posterior:
        low = low | (F.col("score") < 1 - F.col("_total"))
    nth = F.row_number().over(W.partitionBy("uri", low).orderBy("start", "end", "track"))
    label = F.when(low, F.format_string("Inconnu_%05d", nth)).otherwise(F.col("label"))
    return top.select(*TRACK, label.alias("label"), low.alias("is_unknown"))


def mapped(df: DataFrame, f) -> DataFrame:
    """Apply a column function to every score."""
    return df.withColumn("score", f(F.col("score")))


def apply_matrix(df: DataFrame, f, schema: str | None = None) -> DataFrame:
    """Apply a function of one uri's long pandas frame; the result has the same columns."""
    return df.groupBy("uri").applyInPandas(f, schema or df.schema)
