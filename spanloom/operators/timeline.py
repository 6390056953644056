"""Unlabelled interval sets: (uri, start, end), and the interval joins everything else uses.

Functions take ``keys``, the columns that separate one timeline from the next; rows of other
keys never meet. ``bins`` (seconds) splits joins and islands of very large keys by time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanloom.functions.segment import EPS, Seg

URI = ("uri",)


def timeline(df: DataFrame, keys: tuple[str, ...] = URI) -> DataFrame:
    """The set of non-empty segments."""
    return df.select(*keys, "start", "end").where(Seg.of().filled()).distinct()


def union(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = URI) -> DataFrame:
    return timeline(a.select(*keys, "start", "end").unionByName(b.select(*keys, "start", "end")), keys)


def equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row, ``equal``: no row is in one of the sets alone."""
    side = lambda df, n: df.select(*a.columns, F.lit(n).cast("long").alias("_n"))
    odd = side(a, 1).unionByName(side(b, -1)).groupBy(*a.columns).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    return odd.agg((F.count(F.lit(1)) == 0).alias("equal"))


def covers(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = URI) -> DataFrame:
    """Per key of ``b``: whether all its segments are in ``a``."""
    cols = [*keys, "start", "end"]
    marked = b.select(*cols).join(a.select(*cols).distinct().withColumn("_in", F.lit(True)), cols, "left")
    return marked.groupBy(*keys).agg(F.every(F.coalesce("_in", F.lit(False))).alias("contained"))


def ranked(df: DataFrame, keys: tuple[str, ...] = URI) -> DataFrame:
    """Add ``rank`` from 0 in (start, end) order."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy("start", "end")) - 1)


def kth(df: DataFrame, k: int, keys: tuple[str, ...] = URI) -> DataFrame:
    """The k-th segment of each key; negative k counts from the end."""
    order = W.partitionBy(*keys)
    if k >= 0:
        n, wanted = F.row_number().over(order.orderBy("start", "end")), k + 1
    else:
        n, wanted = F.row_number().over(order.orderBy(F.desc("start"), F.desc("end"))), -k
    return df.withColumn("_n", n).where(F.col("_n") == wanted).drop("_n")


def index_of(df: DataFrame, start: float, end: float, keys: tuple[str, ...] = URI) -> DataFrame:
    return ranked(df, keys).where((F.col("start") == start) & (F.col("end") == end)).select(*keys, "rank")


def stab(df: DataFrame, t: float | Column) -> DataFrame:
    """Segments that hold a time, bounds included."""
    return df.where(Seg.of().overlaps(t if isinstance(t, Column) else F.lit(float(t))))


def probe(df: DataFrame, start: float, end: float) -> DataFrame:
    """Segments that intersect one query segment."""
    return df.where(Seg.of().intersects(Seg(F.lit(float(start)), F.lit(float(end)))))


def _renamed(df: DataFrame, prefix: str, keys: tuple[str, ...]) -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(prefix + c) for c in df.columns if c not in keys])


def overlap_join(
    a: DataFrame, b: DataFrame, keys: tuple[str, ...] = URI, how: str = "inner", extra: Column | None = None, bins: float | None = None
) -> DataFrame:
    """Pairs of rows of equal keys (null is a key) whose segments intersect, as a_* and b_*.

    With ``bins``, segments are cut at multiples of it, so that the rows of one large key meet
    in many tasks; a pair is kept in the bin where its intersection starts. The result is the same
    with any ``bins``, for inner, semi and anti joins; outer joins are not cut. ``bin_width``
    suggests a value.
    """
    x, y = _renamed(a, "a_", keys), _renamed(b, "b_", keys)
    meet = Seg.of("a_").intersects(Seg.of("b_"))
    if extra is not None:
        meet = meet & extra
    same = F.lit(True)
    for k in keys:
        same = F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) & same
    if bins is not None and how in ("left_semi", "left_anti"):
        # whether a row meets anything is found for distinct rows, by the cut inner join
        hits = overlap_join(a, b, keys, "inner", extra, bins).select(*keys, *[F.col(f"a_{c}").alias(c) for c in a.columns if c not in keys]).distinct()
        equal = F.lit(True)
        for c in a.columns:
            equal = F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) & equal
        return a.alias("x").join(hits.alias("y"), equal, how).select(*keys, *[c for c in a.columns if c not in keys])
    if bins is None or how != "inner":
        joined = x.alias("x").join(y.alias("y"), same & meet, how)
        if how in ("left_semi", "left_anti"):
            return joined.select(*keys, *[F.col(f"a_{c}").alias(c) for c in a.columns if c not in keys])
        return joined.select(*[F.col(f"x.{k}").alias(k) for k in keys], *[c for c in joined.columns if c not in keys])
    cut = lambda df, p: df.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(f"{p}start") / bins), F.floor(F.col(f"{p}end") / bins))))
    starts = F.floor(F.greatest("a_start", "b_start") / bins) == F.col("x._bin")
    joined = cut(x.where(Seg.of("a_").filled()), "a_").alias("x").join(cut(y.where(Seg.of("b_").filled()), "b_").alias("y"), same & (F.col("x._bin") == F.col("y._bin")) & meet & starts)
    return joined.select(*[F.col(f"x.{k}").alias(k) for k in keys], *[c for c in x.columns if c not in keys], *[c for c in y.columns if c not in keys])


def bin_width(df: DataFrame, rows: int = 50_000, keys: tuple[str, ...] = URI) -> float | None:
    """A width of time bins that leaves about ``rows`` rows of the largest key in one, None if no key
    has more than that; never less than the mean duration, so that few rows are cut."""
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.max("end") - F.min("start")).alias("span"), F.avg(F.col("end") - F.col("start")).alias("mean"))
    big = per.agg(F.max(F.struct("n", "span", "mean"))).first()[0]
    if big is None or big["n"] <= rows or not big["span"]:
        return None
    return max(big["span"] * rows / big["n"], big["mean"], EPS)


def crop(df: DataFrame, focus: DataFrame, mode: str = "intersection", keys: tuple[str, ...] = URI, bins: float | None = None) -> DataFrame:
    """Loose keeps what intersects the focus, strict what lies inside one focus segment,
    intersection the distinct common parts."""
    if mode == "loose":
        return overlap_join(df, focus, keys, "left_semi", bins=bins)
    if mode == "strict":
        return overlap_join(df, focus, keys, "left_semi", Seg.of("b_").contains(Seg.of("a_")), bins)
    if mode != "intersection":
        raise NotImplementedError(mode)
    both = Seg.of("a_").intersection(Seg.of("b_"))
    return overlap_join(df, focus, keys, bins=bins).select(*keys, both.start.alias("start"), both.end.alias("end")).distinct()


def crop_mapping(df: DataFrame, focus: DataFrame, keys: tuple[str, ...] = URI, bins: float | None = None) -> DataFrame:
    """Common parts with the array of segments they come from."""
    both = Seg.of("a_").intersection(Seg.of("b_"))
    rows = overlap_join(df, focus, keys, bins=bins).select(*keys, both.start.alias("start"), both.end.alias("end"), Seg.of("a_").struct().alias("o"))
    return rows.groupBy(*keys, "start", "end").agg(F.sort_array(F.collect_set("o")).alias("origin"))


def one_segment(df: DataFrame, start: float, end: float, keys: tuple[str, ...] = URI) -> DataFrame:
    """A focus of one segment for every key of ``df``."""
    return df.select(*keys).distinct().select(*keys, F.lit(float(start)).alias("start"), F.lit(float(end)).alias("end"))


def extent(df: DataFrame, keys: tuple[str, ...] = URI) -> DataFrame:
    """The hull of all segments; keys without segments have no row."""
    return timeline(df, keys).groupBy(*keys).agg(F.min("start").alias("start"), F.max("end").alias("end"))


def _merge(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    order = W.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    opened = df.withColumn("_new", F.when(before >= F.col("start") - EPS, 0).otherwise(1))
    numbered = opened.withColumn("_island", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def islands(df: DataFrame, keys: tuple[str, ...] = URI, bins: float | None = None) -> DataFrame:
    """Coverage: segments merged while gaps are within the tolerance.

    With ``bins``, segments merge within time bins first, so a large key's rows are spread and
    only the bins' islands meet in its window.
    """
    flat = df.select(*keys, "start", "end").where(Seg.of().filled())
    if bins is not None:
        flat = _merge(flat.withColumn("_bin", F.floor(F.col("start") / bins)), (*keys, "_bin")).drop("_bin")
    return _merge(flat, keys)


def duration(df: DataFrame, keys: tuple[str, ...] = URI) -> DataFrame:
    return islands(df, keys).groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("duration"))


def gaps(df: DataFrame, focus: DataFrame | None = None, keys: tuple[str, ...] = URI) -> DataFrame:
    """What the timeline leaves open of each island of the focus (its own extent by default)."""
    inside = islands(focus, keys) if focus is not None else extent(df, keys)
    frame = inside.select(*keys, F.col("start").alias("fs"), F.col("end").alias("fe"))
    named = frame.withColumns({"start": F.col("fs"), "end": F.col("fe")})
    both = Seg.of("a_").intersection(Seg.of("b_"))
    hit = overlap_join(islands(df, keys), named, keys).select(
        *keys, F.col("b_fs").alias("fs"), F.col("b_fe").alias("fe"), both.start.alias("start"), both.end.alias("end")
    )
    # each focus island also has a zero-length mark at its end, so the last gap is a lag like the others
    marks = frame.select(*keys, "fs", "fe", F.col("fe").alias("start"), F.col("fe").alias("end"))
    order = W.partitionBy(*keys, "fs", "fe").orderBy("start", "end")
    open_from = F.coalesce(F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1)), F.col("fs"))
    rows = hit.unionByName(marks).select(*keys, open_from.alias("s"), F.col("start").alias("e"))
    return rows.select(*keys, F.col("s").alias("start"), F.col("e").alias("end")).where(Seg.of().filled()).distinct()


def cells(df: DataFrame, keys: tuple[str, ...] = URI) -> DataFrame:
    """Elementary segmentation: pieces between consecutive boundaries that are covered.

    A sweep: +1 at starts, -1 at ends, summed for each instant before the one exchange; a piece
    is covered while the running sum is positive. No join.
    """
    flat = df.select(*keys, "start", "end").where(Seg.of().filled())
    events = flat.select(*keys, F.explode(F.array(F.struct(F.col("start").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end").alias("t"), F.lit(-1).alias("d")))).alias("e"))
    instants = events.groupBy(*keys, F.col("e.t").alias("t")).agg(F.sum("e.d").alias("d"))
    order = W.partitionBy(*keys).orderBy("t")
    swept = instants.select(
        *keys, F.col("t").alias("start"), F.lead("t").over(order).alias("end"), F.sum("d").over(order.rowsBetween(W.unboundedPreceding, 0)).alias("open")
    )
    return swept.where((F.col("open") > 0) & Seg.of().filled()).drop("open")


def mapped(df: DataFrame, start: Column, end: Column, keys: tuple[str, ...] = URI) -> DataFrame:
    """Apply expressions to all segments; the result is a set of non-empty ones again."""
    return timeline(df.select(*keys, start.alias("start"), end.alias("end")), keys)


def pairwise(df: DataFrame, keys: tuple[str, ...] = URI) -> DataFrame:
    """Each segment with the next one of its key (next_start, next_end); the last has none."""
    order = W.partitionBy(*keys).orderBy("start", "end")
    out = timeline(df, keys).withColumns({"next_start": F.lead("start").over(order), "next_end": F.lead("end").over(order)})
    return out.where("next_start IS NOT NULL")


def scan(df: DataFrame, keys: tuple[str, ...] = URI) -> DataFrame:
    """The set in (start, end) order, for reading one row after the other."""
    return timeline(df, keys).orderBy(*keys, "start", "end")


def empty(df: DataFrame) -> DataFrame:
    return df.limit(0)


def to_json(df: DataFrame, keys: tuple[str, ...] = URI) -> DataFrame:
    rows = timeline(df, keys).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("s"))
    return rows.select(*keys, F.to_json("s").alias("json"))


def describe(df: DataFrame, keys: tuple[str, ...] = URI) -> DataFrame:
    """Number of segments, extent and covered duration of every key."""
    base = timeline(df, keys)
    stats = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("start"), F.max("end").alias("end"))
    return stats.join(duration(base, keys), list(keys))
