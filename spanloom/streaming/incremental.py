"""Streaming counterparts: windowed label shares, islands, interval joins, additive metrics."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spanloom.functions.segment import EPS
from spanloom.operators import metrics as me


def window_durations(events: DataFrame, size: str, delay: str, time_col: str = "ts", seconds: str = "seconds") -> DataFrame:
    """Seconds of each (uri, label) in tumbling windows of the start time; append mode."""
    timed = events.withWatermark(time_col, delay)
    return timed.groupBy("uri", "label", F.window(time_col, size)).agg(F.sum(seconds).alias("seconds"), F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, gap: str, delay: str, time_col: str = "ts") -> DataFrame:
    """Islands of instants: a new one after a gap without events."""
    timed = events.withWatermark(time_col, delay)
    return timed.groupBy("uri", F.session_window(time_col, gap)).agg(F.count(F.lit(1)).alias("n")).select("uri", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def _islands(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State: open islands [start, end, ...]. Rows and timeouts alike give out what the watermark is past."""
    mark = state.getCurrentWatermarkMs() / 1000.0
    open_ = list(state.get[0]) if state.exists else []
    spans = [(open_[i], open_[i + 1]) for i in range(0, len(open_), 2)]
    for f in frames:
        spans += [(s, e) for s, e in zip(f["start"], f["end"], strict=True) if mark <= 0 or s >= mark]
    merged: list[list[float]] = []
    for s, e in sorted(spans):
        if merged and s - merged[-1][1] <= EPS:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    done = [m for m in merged if m[1] + EPS < mark]
    left = [m for m in merged if not m[1] + EPS < mark]
    if left:
        state.update(([x for m in left for x in m],))
        first = math.ceil((min(m[1] for m in left) + EPS) * 1000) + 1
        state.setTimeoutTimestamp(max(first, state.getCurrentWatermarkMs() + 1))
    elif state.exists:
        state.remove()
    if done:
        yield pd.DataFrame({"uri": key[0], "label": key[1], "start": [m[0] for m in done], "end": [m[1] for m in done]})


def islands(segments: DataFrame, delay: float) -> DataFrame:
    """Exact islands of (uri, label, start, end) that arrive at most ``delay`` seconds out of order.

    Starts are event time. An island is given out once the watermark, the latest start of any key
    less ``delay``, is past its end, by a timer where its key gets no more rows; then its state goes.
    Rows that start before the watermark are late and left out.
    """
    timed = segments.select("uri", "label", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))
    timed = timed.withColumn("at", F.timestamp_millis(F.floor(F.col("start") * 1000))).withWatermark("at", f"{int(delay * 1000)} milliseconds")
    return timed.groupBy("uri", "label").applyInPandasWithState(
        _islands, "uri string, label string, start double, end double", "open array<double>", "append", GroupStateTimeout.EventTimeTimeout
    )


def dedup(rows: DataFrame, delay: str, time_col: str = "ts") -> DataFrame:
    """First of each (uri, start, end, track) within the watermark."""
    return rows.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["uri", "start", "end", "track"])


def overlap(a: DataFrame, b: DataFrame, delay: str, longest: str) -> DataFrame:
    """Stream-stream overlap join of (uri, ts, till): bounded by the longest segment."""
    x = a.withWatermark("ts", delay).select(F.col("uri").alias("a_uri"), F.col("ts").alias("a_ts"), F.col("till").alias("a_till"), F.col("track").alias("a_track"))
    y = b.withWatermark("ts", delay).select(F.col("uri").alias("b_uri"), F.col("ts").alias("b_ts"), F.col("till").alias("b_till"), F.col("track").alias("b_track"))
    bound = F.expr(f"a_ts >= b_ts - INTERVAL {longest} AND a_ts <= b_ts + INTERVAL {longest}")
    return x.join(y, (F.col("a_uri") == F.col("b_uri")) & bound & (F.col("a_ts") < F.col("b_till")) & (F.col("b_ts") < F.col("a_till")))


def metric_sink(path: str):
    """foreachBatch: components of each batch's closed uris, written under the batch id.

    A batch that runs again overwrites its own folder, so totals count it once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        parts = me.identification_parts(batch.where("side = 'ref'"), batch.where("side = 'hyp'"))
        parts.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def metric_totals(parts: DataFrame) -> DataFrame:
    return me.totals(parts, me.IDENTIFICATION)
