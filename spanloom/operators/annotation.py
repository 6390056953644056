"""Labelled interval relations: (uri, start, end, track, label), optionally is_unknown.

One label for each (uri, start, end, track). Unknown labels are anonymous: equal to nothing but
themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanloom.functions.segment import Seg
from spanloom.operators import timeline as tl

KEY = ("uri", "start", "end", "track")
SCAN = ("start", "end", "track")


def annotation(df: DataFrame, order: Column | None = None) -> DataFrame:
    """Upsert rows in order: the last label of a key stays; empty segments go."""
    at = order if order is not None else F.col("label")
    last = W.partitionBy(*KEY).orderBy(at.desc())
    rows = df.where(Seg.of().filled()).withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    return rows


def upsert(df: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows of ``changes`` replace or join those of ``df``."""
    return df.join(changes.select(*KEY), list(KEY), "left_anti").unionByName(changes, allowMissingColumns=True)


def delete(df: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the segments (uri, start, end) or tracks (… track) listed in ``gone``."""
    return df.join(gone, [c for c in KEY if c in gone.columns], "left_anti")


def scan(df: DataFrame) -> DataFrame:
    return df.orderBy("uri", *SCAN)


def segments(df: DataFrame) -> DataFrame:
    return tl.timeline(df)


def count_segments(df: DataFrame) -> DataFrame:
    return df.groupBy("uri").agg(F.count_distinct("start", "end").alias("n"))


def _free_names(df: DataFrame, prefix: str) -> DataFrame:
    """Rename repeated tracks of a segment to prefix + N, keeping the first of each name."""
    nth = F.row_number().over(W.partitionBy("uri", "start", "end", "track").orderBy(*[c for c in ("label", "_src") if c in df.columns]))
    tagged = df.withColumn("_nth", nth)
    again = F.row_number().over(W.partitionBy("uri", "start", "end", F.col("_nth") > 1).orderBy("track", "_nth"))
    own = W.partitionBy("uri", "start", "end")
    taken = F.collect_set(F.when(F.col("_nth") == 1, F.col("track"))).over(own)
    tagged = tagged.withColumns({"_again": again, "_taken": taken})
    # the k-th renamed track gets the k-th free number; at most size(taken) numbers are in use
    numbers = F.filter(
        F.transform(F.sequence(F.lit(1), F.col("_again") + F.size("_taken")), lambda i: F.concat(F.lit(prefix), i.cast("string"))),
        lambda x: ~F.array_contains("_taken", x),
    )
    named = F.when(F.col("_nth") == 1, F.col("track")).otherwise(F.element_at(numbers, F.col("_again")))
    return tagged.withColumn("track", named).drop("_nth", "_again", "_taken")


def crop(df: DataFrame, focus: DataFrame, mode: str = "intersection", prefix: str = "") -> DataFrame:
    """Loose and strict keep whole rows; intersection clips a row by every focus segment it meets."""
    if mode in ("loose", "strict"):
        return tl.crop(df, focus, mode)
    if mode != "intersection":
        raise NotImplementedError(mode)
    both = Seg.of("a_").intersection(Seg.of("b_"))
    rest = [c for c in df.columns if c not in ("uri", "start", "end")]
    rows = tl.overlap_join(df, focus.select("uri", "start", "end")).select("uri", both.start.alias("start"), both.end.alias("end"), *[F.col(f"a_{c}").alias(c) for c in rest])
    return _free_names(rows, prefix)


def tracks_of(df: DataFrame, start: float, end: float) -> DataFrame:
    return df.where((F.col("start") == start) & (F.col("end") == end)).groupBy("uri").agg(F.sort_array(F.collect_set("track")).alias("tracks"))


def has_track(df: DataFrame, start: float, end: float, track: str) -> DataFrame:
    hit = (F.col("start") == start) & (F.col("end") == end) & (F.col("track") == track)
    return df.groupBy("uri").agg(F.bool_or(hit).alias("has_track"))


def track_by_name(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col("track") == name)


def retrack(df: DataFrame) -> DataFrame:
    n = F.row_number().over(W.partitionBy("uri").orderBy(*SCAN)) - 1
    return df.withColumn("track", n.cast("string"))


def labels(df: DataFrame, unknown: bool = True) -> DataFrame:
    rows = df if unknown or "is_unknown" not in df.columns else df.where(~F.col("is_unknown"))
    return rows.select("uri", "label").distinct()


def labels_of(df: DataFrame, unique: bool = True) -> DataFrame:
    """Labels on every exact segment, as a sorted set or list."""
    collect = F.collect_set if unique else F.collect_list
    return df.groupBy("uri", "start", "end").agg(F.sort_array(collect("label")).alias("labels"))


def subset(df: DataFrame, wanted: list[str], invert: bool = False) -> DataFrame:
    hit = F.col("label").isin(wanted)
    return df.where(~hit if invert else hit)


def label_timeline(df: DataFrame, label: str) -> DataFrame:
    return tl.timeline(df.where(F.col("label") == label))


def label_islands(df: DataFrame) -> DataFrame:
    return tl.islands(df, ("uri", "label"))


def label_durations(df: DataFrame) -> DataFrame:
    return tl.duration(df, ("uri", "label"))


def chart(df: DataFrame, percent: bool = False) -> DataFrame:
    """Covered duration of each label, longest first; as shares of the sum if ``percent``."""
    long = label_durations(df)
    if percent:
        long = long.withColumn("duration", F.col("duration") / F.sum("duration").over(W.partitionBy("uri")))
    return long.withColumn("rank", F.row_number().over(W.partitionBy("uri").orderBy(F.desc("duration"), "label")))


def argmax(df: DataFrame, focus: DataFrame | None = None, known_first: bool = False) -> DataFrame:
    """The label that covers most of the focus (or of everything); none if nothing is covered."""
    rows = df if focus is None else crop(df, focus)
    if "is_unknown" not in rows.columns:
        rows = rows.withColumn("is_unknown", F.lit(False))
    long = tl.duration(rows, ("uri", "label", "is_unknown"))
    if known_first:
        most = F.max("duration").over(W.partitionBy("uri"))
        long = long.withColumn("_w", F.when(F.col("is_unknown"), F.col("duration") - most).otherwise(F.col("duration")))
    else:
        long = long.withColumn("_w", F.col("duration"))
    n = F.row_number().over(W.partitionBy("uri").orderBy(F.desc("_w"), "label"))
    keep = long.withColumn("_n", n).where("_n = 1 AND duration > 0")
    return keep.select("uri", "label", "duration")


def translate(df: DataFrame, mapping: DataFrame, per_uri: bool = False) -> DataFrame:
    """Replace labels by ``mapping`` ([uri,] left, right); labels without a partner stay."""
    keys = ["uri", "left"] if per_uri else ["left"]
    table = mapping.select(*keys, "right")
    rows = df.withColumn("left", F.col("label")).join(table, keys, "left")
    return rows.withColumn("label", F.coalesce("right", "label")).select(*df.columns)


def translate_by(df: DataFrame, f) -> DataFrame:
    """Relabel with a column function."""
    return df.withColumn("label", f(F.col("label")))


def anonymize_labels(df: DataFrame) -> DataFrame:
    """Each label of a uri becomes one anonymous label, numbered in label order."""
    n = F.dense_rank().over(W.partitionBy("uri").orderBy("label"))
    return df.withColumns({"label": F.format_string("Inconnu_%05d", n), "is_unknown": F.lit(True)})


def anonymize_tracks(df: DataFrame) -> DataFrame:
    n = F.row_number().over(W.partitionBy("uri").orderBy(*SCAN, "label"))
    return df.withColumns({"label": F.format_string("Inconnu_%05d", n), "is_unknown": F.lit(True)})


def smooth(df: DataFrame) -> DataFrame:
    """Islands of each label; tracks numbered in label order."""
    n = F.row_number().over(W.partitionBy("uri").orderBy("label", "start")) - 1
    return label_islands(df).withColumn("track", n.cast("string")).select("uri", "start", "end", "track", "label")


def co_iter(a: DataFrame, b: DataFrame, bins: float | None = None) -> DataFrame:
    """All pairs of rows whose segments intersect."""
    return tl.overlap_join(a, b, bins=bins)


def to_json(df: DataFrame, modality: str = "") -> DataFrame:
    one = F.struct(F.struct("start", "end").alias("segment"), "track", "label")
    rows = df.groupBy("uri").agg(F.sort_array(F.collect_list(one)).alias("tracks"))
    return rows.select("uri", F.to_json(F.struct("uri", F.lit(modality).alias("modality"), "tracks")).alias("json"))
