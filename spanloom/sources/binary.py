"""Binary features, matrices, XML annotations and audio headers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.segment import parse_clock

FRAMES = "uri string, frame long, vec array<double>"


def _files(spark: SparkSession, path: str) -> DataFrame:
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return spark.read.format("binaryFile").load(path).select(name.alias("uri"), "content")


def _frames(parse):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, content in zip(b.column("uri").to_pylist(), b.column("content"), strict=True):
                x = parse(content.as_py()).astype(float)
                for at in range(0, len(x), 10_000):  # some frames at a time
                    part = x[at : at + 10_000]
                    flat = pa.array(part.ravel())
                    stops = pa.array(np.arange(0, len(part) + 1) * x.shape[1], pa.int32())
                    yield pa.record_batch([pa.array([uri] * len(part)), pa.array(np.arange(at, at + len(part))), pa.ListArray.from_arrays(stops, flat)], names=["uri", "frame", "vec"])

    return run


def parse_plp(raw: bytes) -> np.ndarray:
    """int32 records, int32 dimension, int32 frames of each record, then float32 rows."""
    records, dim = np.frombuffer(raw, "<i4", 2)
    frames = int(np.frombuffer(raw, "<i4", int(records), 8).sum())
    return np.frombuffer(raw, "<f4", frames * int(dim), 8 + 4 * int(records)).reshape(frames, int(dim))


def read_plp(spark: SparkSession, path: str) -> DataFrame:
    return _files(spark, path).mapInArrow(_frames(parse_plp), FRAMES)


def read_raw(spark: SparkSession, path: str, dtype: str = "<f4", dimension: int = 1) -> DataFrame:
    """Rows of one fixed type and dimension."""
    return _files(spark, path).mapInArrow(_frames(lambda raw: np.frombuffer(raw, dtype).reshape(-1, dimension)), FRAMES)


def symmetric(matrix: DataFrame, how: str = "average") -> DataFrame:
    """A distance matrix and its transpose brought together."""
    both = matrix.select("uri", "row", "col", "value").unionByName(matrix.select("uri", F.col("col").alias("row"), F.col("row").alias("col"), "value"))
    return both.groupBy("uri", "row", "col").agg((F.avg if how == "average" else F.min)("value").alias("value"))


def wav_extents(spark: SparkSession, path: str) -> DataFrame:
    """(uri, start, end) of PCM files from their headers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io
        import wave

        for b in batches:
            ends = []
            for content in b.column("content"):
                with wave.open(io.BytesIO(content.as_py())) as w:
                    ends.append(w.getnframes() / w.getframerate())
            yield pa.record_batch([b.column("uri"), pa.array([0.0] * len(ends)), pa.array(ends)], names=["uri", "start", "end"])

    return _files(spark, path).mapInArrow(run, "uri string, start double, end double")


def read_trs(spark: SparkSession, path: str, uri: str) -> dict[str, DataFrame]:
    """Transcriptions: section status and speaker turns."""
    schema = "_startTime double, _endTime double, _type string"
    sections = spark.read.format("xml").option("rowTag", "Section").schema(schema).load(path)
    turns = spark.read.format("xml").option("rowTag", "Turn").schema("_startTime double, _endTime double, _speaker string").load(path)
    span = [F.lit(uri).alias("uri"), F.col("_startTime").alias("start"), F.col("_endTime").alias("end")]
    who = turns.select(*span, F.explode(F.split(F.trim("_speaker"), r"\s+")).alias("label")).where("label <> ''")
    return {"status": sections.select(*span, F.col("_type").alias("label")), "speaker": who}


def read_ttaf(spark: SparkSession, path: str, uri: str) -> DataFrame:
    """Timed text: paragraphs with their text and the colours of their spans."""
    rows = spark.read.format("xml").option("rowTag", "p").option("ignoreNamespace", "true").schema("_begin string, _end string, span array<struct<_VALUE:string,_color:string>>").load(path)
    time = lambda c: parse_clock(F.col(c))
    text = F.concat_ws(" ", F.transform("span", lambda s: s["_VALUE"]))
    return rows.select(F.lit(uri).alias("uri"), time("_begin").alias("start"), time("_end").alias("end"), text.alias("text"), F.transform("span", lambda s: s["_color"]).alias("colors"))


def read_xgtf(spark: SparkSession, path: str, uri: str, times: DataFrame) -> dict[str, DataFrame]:
    """Video ground truth: people seen (label from the NOM attribute) and annotated frames."""
    schema = "_name string, _framespan string, attribute array<struct<_name:string, `data:svalue`:struct<_value:string>, svalue:struct<_value:string>>>"
    rows = spark.read.format("xml").option("rowTag", "object").option("ignoreNamespace", "true").schema(schema).load(path)
    span = F.regexp_extract_all("_framespan", F.lit(r"(\d+):(\d+)"), 0)
    flat = rows.select("_name", "attribute", F.explode(span).alias("s")).select("_name", "attribute", F.substring_index("s", ":", 1).cast("long").alias("a"), F.substring_index("s", ":", -1).cast("long").alias("b"))
    at = lambda c, n: times.select(F.col("frame").alias(c), F.col(n))
    timed = flat.join(at("a", "start"), "a").join(at("b", "end"), "b")
    name = F.filter("attribute", lambda x: x["_name"] == "NOM")[0]
    label = F.coalesce(name["svalue"]["_value"], name["data:svalue"]["_value"])
    heads = timed.where("_name = 'PERSONNE'").select(F.lit(uri).alias("uri"), "start", "end", label.alias("label"))
    return {"head": heads.where("label IS NOT NULL"), "annotated": timed.select(F.lit(uri).alias("uri"), "start", "end").distinct()}


def from_face_tracks(tracks: DataFrame, hold: float = 0.04) -> DataFrame:
    """Face tracks (uri, track, first, last[, label]): instants are held for one frame."""
    end = F.when(F.col("first") >= F.col("last"), F.col("first") + hold).otherwise(F.col("last"))
    label = F.coalesce("label", "track") if "label" in tracks.columns else F.col("track")
    return tracks.select("uri", F.col("first").alias("start"), end.alias("end"), "track", label.alias("label"))


def catalog(spark: SparkSession, series: dict[str, tuple[list[int], str]], pattern: str) -> DataFrame:
    """(series, season, episode, language, path) of a dataset: episodes of each season, path pattern."""
    rows = [(s, i, n, lang) for s, (seasons, lang) in series.items() for i, n in enumerate(seasons, 1)]
    table = spark.createDataFrame(rows, "series string, season int, n int, language string")
    each = table.select("series", "season", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("episode"), "language")
    return each.withColumn("path", F.format_string(pattern, "series", "season", "episode"))
