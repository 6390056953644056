"""Line formats of annotations, scores and timelines, read and written as DataFrames.

A format is a record of field positions; one reader and one writer serve all of them. Columns
``start`` and ``end`` are seconds; formats that give a duration or frames say so.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanloom.functions.segment import Seg, SlidingWindow, parse_clock


@dataclass(frozen=True)
class TextFormat:
    name: str
    fields: tuple[str, ...]  # in order; None-like names start with "_"
    comment: str = "#"
    split: str = r"\s+"
    fixed: dict[str, str] = field(default_factory=dict)  # what the writer puts into unread fields
    window: SlidingWindow | None = None  # fields first, n are frames
    modality: str | None = None


#: The field orders and comment marks of the formats.
FORMATS = {
    f.name: f
    for f in (
        TextFormat("mdtm", ("uri", "_channel", "start", "duration", "modality", "_confidence", "_track", "label"), ";", fixed={"_channel": "1", "_confidence": "NA"}),
        TextFormat("ann", ("uri", "modality", "start", "duration", "track", "label")),
        TextFormat("seg", ("uri", "label", "_channel", "first", "n"), fixed={"_channel": "1"}, window=SlidingWindow(), modality="speaker"),
        TextFormat("repere", ("uri", "start", "end", "modality", "label"), ";"),
        TextFormat("repere_scores", ("uri", "start", "end", "modality", "label", "score"), ";"),
        TextFormat("ref", ("uri", "start", "end", "modality", "label"), ";"),
        TextFormat("etf0", ("uri", "_channel", "start", "duration", "modality", "track", "label", "score", "_flag"), ";", fixed={"_channel": "1"}),
        TextFormat("tvm", ("uri", "start", "duration", "track", "label", "score"), "\u0000", modality="head"),
        TextFormat("tvt", ("uri", "start", "duration", "row", "col", "value"), "\u0000"),
        TextFormat("uem", ("uri", "_channel", "start", "end"), ";;", fixed={"_channel": "1"}),
        TextFormat("idx", ("frame", "_type", "bytes", "seconds"), "\u0000"),
        TextFormat("lst", ("value",), "\u0000", split="\n"),
    )
}
NUMBERS = ("start", "end", "duration", "score", "value", "seconds", "first", "n", "frame", "bytes")


def custom(fields: dict[str, int], comment: str = "#", split: str = " ") -> TextFormat:
    """A format from column positions; ``end`` or ``duration`` is needed."""
    if "end" not in fields and "duration" not in fields:
        raise ValueError("either end or duration is needed")
    at = {i: n for n, i in fields.items()}
    return TextFormat("custom", tuple(at.get(i, f"_{i}") for i in range(max(at) + 1)), comment, split)


def by_extension(path: str) -> TextFormat:
    ext = path.rsplit(".", 1)[-1].lower()
    if ext not in FORMATS:
        raise ValueError(f"no reader for .{ext}")
    return FORMATS[ext]


def parse(lines: DataFrame, fmt: TextFormat, uri: str | None = None, modality: str | None = None) -> DataFrame:
    """Typed rows of a ``value`` column of lines."""
    text = lines.where((F.trim("value") != "") & ~F.trim("value").startswith(fmt.comment))
    if fmt.name == "lst":
        return text.select(F.trim("value").alias("value"))
    part = F.split(F.trim("value"), fmt.split)
    names = [n for n in fmt.fields if not n.startswith("_")]
    cast = lambda n, c: c.cast("double") if n in NUMBERS and not (fmt.name == "tvt" and n in ("row", "col")) else c
    rows = text.select(*[cast(n, F.try_element_at(part, F.lit(fmt.fields.index(n) + 1))).alias(n) for n in names])
    if "duration" in names:
        rows = rows.withColumn("end", F.col("start") + F.col("duration")).drop("duration")
    if fmt.window is not None:
        seg = fmt.window.to_segment(F.col("first").cast("long"), F.col("n").cast("long"))
        rows = rows.withColumns({"start": seg.start, "end": seg.end}).drop("first", "n")
    if "uri" not in names and uri is not None:
        rows = rows.withColumn("uri", F.lit(uri))
    if "modality" not in names and (modality or fmt.modality):
        rows = rows.withColumn("modality", F.lit(modality or fmt.modality))
    if "label" in names:
        if "track" not in names:
            n = F.row_number().over(W.partitionBy("uri", *(["modality"] if "modality" in rows.columns else [])).orderBy("start", "end", "label")) - 1
            if "score" in names:  # one track a segment
                n = F.dense_rank().over(W.partitionBy("uri").orderBy("start", "end")) - 1
            rows = rows.withColumn("track", n.cast("string"))
        rows = rows.withColumn("is_unknown", unknown_label(F.col("label")))
    return rows


def unknown_label(label: Column) -> Column:
    """What anonymous labels start with."""
    return label.startswith("Unknown") | label.startswith("Inconnu") | label.startswith("speaker#")


def read(spark: SparkSession, path: str, fmt: TextFormat | str | None = None, uri: str | None = None, modality: str | None = None) -> DataFrame:
    chosen = FORMATS[fmt] if isinstance(fmt, str) else fmt or by_extension(path)
    return parse(spark.read.text(path), chosen, uri, modality)


def select(df: DataFrame, uri: str | None = None, modality: str | None = None) -> DataFrame:
    if uri is not None:
        df = df.where(F.col("uri") == uri)
    return df if modality is None else df.where(F.col("modality") == modality)


def select_one(df: DataFrame, uri: str | None = None, modality: str | None = None) -> DataFrame:
    """As ``select``, but the rows must be of one uri and one modality: several are an error, none are
    an empty result. At most two distinct pairs are looked at."""
    rows = select(df, uri, modality)
    keys = [c for c in ("uri", "modality") if c in rows.columns]
    if len(rows.select(*keys).distinct().limit(2).collect()) > 1:
        raise ValueError(f"several {' and '.join(keys)} match; name one")
    return rows


def lines(df: DataFrame, fmt: TextFormat) -> DataFrame:
    """The ``value`` column that a file of this format holds."""
    if "score" in fmt.fields and "_flag" in fmt.fields:
        top = F.row_number().over(W.partitionBy("uri", "start", "end", "track").orderBy(F.desc("score"), "label")) == 1
        df = df.withColumn("_flag", F.when(top, "top_score").otherwise("-"))
    if fmt.window is not None:
        first, n = fmt.window.to_range(Seg.of())
        df = df.withColumns({"first": first, "n": n})
    out = []
    for name in fmt.fields:
        if name == "duration":
            out.append((F.col("end") - F.col("start")).cast("string"))
        elif name in ("first", "n"):
            out.append(F.col(name).cast("long").cast("string"))
        elif name in NUMBERS:
            out.append(F.col(name).cast("string"))
        elif name == "_track":
            out.append(F.col("track") if "track" in df.columns else F.lit("-"))
        elif name in df.columns:
            out.append(F.col(name).cast("string"))
        elif name == "modality":
            out.append(F.lit(fmt.modality or "speaker"))
        else:
            out.append(F.lit(fmt.fixed.get(name, "-")))
    return df.select("uri", *[c for c in ("start", "end") if c in df.columns], F.concat_ws(" ", *out).alias("value"))


def write(df: DataFrame, path: str, fmt: TextFormat | str, by_uri: bool = False, mode: str = "errorifexists") -> None:
    """Lines in (uri, start, end) order; one folder for each uri if ``by_uri``."""
    chosen = FORMATS[fmt] if isinstance(fmt, str) else fmt
    made = lines(df, chosen)
    order = [c for c in ("uri", "start", "end", "value") if c in made.columns]
    if by_uri:
        made.repartition("uri").sortWithinPartitions(*order).select("uri", "value").write.partitionBy("uri").mode(mode).text(path)
    else:
        made.orderBy(*order).select("value").write.mode(mode).text(path)


def matrix_of(tvt: DataFrame) -> DataFrame:
    return tvt.select("uri", "row", "col", "value")


def frame_times(idx: DataFrame) -> DataFrame:
    """([uri,] frame, start, end): non-decreasing frame times, half a median step around each.

    Files of several uris carry a uri column; each is one sequence of its own.
    """
    keys = [c for c in ("uri",) if c in idx.columns]
    order = W.partitionBy(*keys, F.lit(0)).orderBy("frame")
    mono = idx.select(*keys, F.col("frame").cast("long").alias("frame"), F.max("seconds").over(order.rowsBetween(W.unboundedPreceding, 0)).alias("t"))
    half = F.coalesce(F.median("d").over(W.partitionBy(*keys, F.lit(0))), F.lit(0.0)) / 2
    timed = mono.withColumn("d", F.lead("t").over(order) - F.col("t")).withColumn("h", half)
    return timed.select(*keys, "frame", (F.col("t") - F.col("h")).alias("start"), (F.col("t") + F.col("h")).alias("end"))


def read_srt(spark: SparkSession, path: str, uri: str) -> DataFrame:
    """Subtitle times."""
    arrow = r"^\s*([\d:]+[,.]\d+)\s*-->\s*([\d:]+[,.]\d+)"
    rows = spark.read.text(path).where(F.col("value").rlike(arrow))
    time = lambda g: parse_clock(F.regexp_extract("value", arrow, g))
    return rows.select(F.lit(uri).alias("uri"), time(1).alias("start"), time(2).alias("end"))


def read_track_list(spark: SparkSession, path: str) -> DataFrame:
    """(uri, track) of list files: a line that is not a number names a uri (with an extension of three
    letters), the numbers below it are its tracks. A file is read as one row."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("n", "line"))
    rows = text.select("file", "n", F.trim("line").alias("line")).where("line <> ''")
    name = F.when(~F.col("line").rlike("^[0-9]+$"), F.expr("left(line, length(line) - 4)"))
    owner = F.last(name, ignorenulls=True).over(W.partitionBy("file").orderBy("n"))
    return rows.withColumn("uri", owner).where(F.col("line").rlike("^[0-9]+$")).select("uri", F.col("line").alias("track"))


def template(path: str, **values: str) -> str:
    """Replace [URI]-like placeholders of a path."""
    for k, v in values.items():
        path = path.replace(f"[{k.upper()}]", v)
    return path


def pronounced(text: Column) -> Column:
    """Names marked as <pers=name> in a transcript."""
    return F.regexp_extract_all(text, F.lit(r"<pers=([^>]+)>"), 1)
