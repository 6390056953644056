"""Label transfer through time: onto timelines and between annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanloom.functions.segment import Seg
from spanloom.operators import annotation as an
from spanloom.operators import mapping as mp
from spanloom.operators import timeline as tl

SEG = ("uri", "start", "end")


def shaped(source: DataFrame, target: DataFrame, labelled: bool = True) -> None:
    """Columns that a tagger needs; every tagger asks for them."""
    for name, df, cols in (("source", source, (*SEG, "track", "label")), ("target", target, (*SEG, "track", "label") if labelled else SEG)):
        missing = [c for c in cols if c not in df.columns]
        if missing:
            raise ValueError(f"the {name} has no {', '.join(missing)}")


def check(source: DataFrame, target: DataFrame, labelled: bool = True) -> None:
    """What a tagger needs: an annotation as its source, a target with segments (and labels where
    the tagger replaces them), and no uri of the target that the source does not have. The last takes
    a job, so programs ask for it and single taggers do not."""
    shaped(source, target, labelled)
    alone = target.select("uri").distinct().join(source.select("uri").distinct(), "uri", "left_anti").limit(1).collect()
    if alone:
        raise ValueError(f"the source has no uri {alone[0]['uri']!r}")


def direct(source: DataFrame, target: DataFrame, prefix: str = "", bins: float | None = None) -> DataFrame:
    """Every target segment receives every overlapping (track, label)."""
    shaped(source, target, labelled=False)
    met = tl.overlap_join(tl.timeline(target), source, bins=bins).select("uri", F.col("a_start").alias("start"), F.col("a_end").alias("end"), F.col("b_track").alias("track"), F.col("b_label").alias("label"))
    return an._free_names(met, prefix)


def conservative(source: DataFrame, target: DataFrame, bins: float | None = None) -> DataFrame:
    """Overwrite labels of single-track segments that meet exactly one distinct label."""
    shaped(source, target)
    met = tl.overlap_join(tl.timeline(target), source, bins=bins)
    one = met.groupBy("uri", F.col("a_start").alias("start"), F.col("a_end").alias("end")).agg(F.min("b_label").alias("_lo"), F.max("b_label").alias("_hi")).where("_lo = _hi").select(*SEG, F.col("_lo").alias("_new"))
    alone = target.groupBy(*SEG).agg(F.count_distinct("track").alias("_tracks"))
    rows = target.join(alone, list(SEG)).join(one, list(SEG), "left")
    label = F.when((F.col("_tracks") == 1) & F.col("_new").isNotNull(), F.col("_new")).otherwise(F.col("label"))
    return rows.withColumn("label", label).select(*target.columns)


def _best_labels(source: DataFrame, target: DataFrame, bins: float | None = None) -> DataFrame:
    """(segment, label, k): labels by clipped duration, at most as many as one source segment has tracks."""
    segs = tl.timeline(target)
    tracks = source.groupBy(*SEG).agg(F.count_distinct("track").alias("tracks"))
    room = tl.overlap_join(segs, tracks, bins=bins).groupBy("uri", "a_start", "a_end").agg(F.max("b_tracks").alias("room"))
    met = tl.overlap_join(segs, source, bins=bins)
    both = Seg.of("a_").intersection(Seg.of("b_"))
    clipped = met.select("uri", "a_start", "a_end", F.col("b_label").alias("label"), both.start.alias("start"), both.end.alias("end"))
    long = tl.duration(clipped, ("uri", "a_start", "a_end", "label"))
    k = F.row_number().over(W.partitionBy("uri", "a_start", "a_end").orderBy(F.desc("duration"), "label"))
    best = long.where("duration > 0").withColumn("k", k).join(room, ["uri", "a_start", "a_end"]).where("k <= room")
    return best.select("uri", F.col("a_start").alias("start"), F.col("a_end").alias("end"), "label", "k")


def argmax_timeline(source: DataFrame, target: DataFrame, bins: float | None = None) -> DataFrame:
    """Each target segment gets its best labels as tracks 0, 1, ..."""
    shaped(source, target, labelled=False)
    best = _best_labels(source, target, bins)
    return best.select(*SEG, (F.col("k") - 1).cast("string").alias("track"), "label")


def argmax_annotation(source: DataFrame, target: DataFrame, bins: float | None = None) -> DataFrame:
    """The k-th track of each target segment gets the k-th best label; others keep theirs."""
    shaped(source, target)
    k = F.row_number().over(W.partitionBy(*SEG).orderBy("track"))
    best = _best_labels(source, target, bins).withColumnRenamed("label", "_new")
    rows = target.withColumn("k", k).join(best, [*SEG, "k"], "left")
    return rows.withColumn("label", F.coalesce("_new", "label")).select(*target.columns)


def by_mapping(source: DataFrame, target: DataFrame, mapper=mp.hungarian_mapper) -> DataFrame:
    """Map the target's labels onto the source's and translate; unmapped labels stay."""
    shaped(source, target)
    return mp.translated(target, mapper(target, source))
