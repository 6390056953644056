"""Frame features (uri, frame, vec) and what runs over them: crops, warping, change detection, models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanloom.functions.segment import EPS, Seg, SlidingWindow
from spanloom.functions.stats import Mixture, normal_quantile, viterbi
from spanloom.operators import timeline as tl


def segments(features: DataFrame, window: SlidingWindow) -> DataFrame:
    """Each frame with its window."""
    s = window.position(F.col("frame"))
    return features.withColumns({"start": s.start, "end": s.end}).where("start IS NOT NULL")


def describe(features: DataFrame, window: SlidingWindow) -> DataFrame:
    """Number of frames, dimension and extent of each uri."""
    rows = features.groupBy("uri").agg((F.max("frame") + 1).alias("frames"), F.max(F.size("vec")).alias("dimension"))
    s = window.to_segment(F.lit(0), F.col("frames"))
    return rows.withColumns({"start": s.start, "end": s.end})


def violations(features: DataFrame) -> DataFrame:
    """Rows with a value that is not finite or a dimension unlike the uri's."""
    bad = F.exists("vec", lambda x: F.isnan(x) | x.isNull() | (F.abs(x) == float("inf")))
    sized = features.withColumn("_most", F.max(F.size("vec")).over(W.partitionBy("uri")))
    return sized.where(bad | (F.size("vec") != F.col("_most"))).drop("_most")


def _spelled(features: DataFrame, focus: DataFrame, window: SlidingWindow) -> DataFrame:
    """(uri, position, frame, last) for each frame number of the focus islands, in order."""
    first, n = window.to_range(Seg.of())
    size = features.groupBy("uri").agg(F.max("frame").alias("last"))
    ranges = tl.islands(focus).select("uri", "start", first.alias("i0"), F.greatest(F.lit(0), n).alias("n"))
    before = W.partitionBy("uri").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.withColumn("p0", F.coalesce(F.sum("n").over(before), F.lit(0))).where("n > 0").join(size, "uri")
    j = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))
    return ranges.select("uri", "p0", "i0", "last", j.alias("j")).select("uri", (F.col("p0") + F.col("j")).alias("position"), (F.col("i0") + F.col("j")).alias("frame"), "last")


def crop(features: DataFrame, focus: DataFrame, window: SlidingWindow) -> DataFrame:
    """Frames of the focus islands. Their numbers are spelled out up to the uri's last frame, so frames
    are looked up by (uri, frame) and one long uri is spread over all tasks."""
    first, n = window.to_range(Seg.of())
    size = features.groupBy("uri").agg(F.max("frame").alias("last"))
    ranges = tl.islands(focus).select("uri", first.alias("i0"), n.alias("n")).join(size, "uri")
    ranges = ranges.withColumn("i1", F.least(F.col("i0") + F.col("n") - 1, F.col("last"))).where("i1 >= i0")
    numbers = ranges.select("uri", F.explode(F.sequence("i0", "i1")).alias("frame")).distinct()
    return features.join(numbers, ["uri", "frame"], "left_semi").select(*features.columns).distinct()


def gather(features: DataFrame, focus: DataFrame, window: SlidingWindow) -> DataFrame:
    """(uri, position, and what features hold): the frames of the focus islands one after another;
    numbers beyond the last frame repeat it."""
    wanted = _spelled(features, focus, window).select("uri", "position", F.least("frame", "last").alias("frame"))
    return wanted.join(features, ["uri", "frame"]).select("uri", "position", *[c for c in features.columns if c != "uri"])


def on_timeline(features: DataFrame, timeline: DataFrame) -> DataFrame:
    """Frames driven by a timeline: the i-th frame belongs to the i-th segment."""
    return features.join(tl.ranked(timeline).select("uri", F.col("rank").cast("long").alias("frame"), "start", "end"), ["uri", "frame"])


def _warp(width: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        x = np.stack(pdf["vec"].to_numpy())
        half, out = width // 2, np.empty_like(x, dtype=float)
        for i in range(len(x)):
            w = x[max(0, i - half) : i + half + 1]
            out[i] = normal_quantile(((w < x[i]).sum(axis=0) + 0.5) / len(w))
        return pd.DataFrame({"uri": pdf["uri"], "frame": pdf["frame"], "vec": list(out)})

    return run


def warp(features: DataFrame, width: int = 301, chunk: int = 20_000) -> DataFrame:
    """Normal quantile of each value's rank in the window around it, dimension by dimension.

    Frames are dealt in chunks with half a window of neighbours on both sides.
    """
    half = width // 2
    base = features.select("uri", "frame", F.col("vec").cast("array<double>").alias("vec"), F.floor(F.col("frame") / chunk).alias("c"))
    near = F.filter(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor((F.col("frame") + d * half) / chunk) == F.col("c") + d)
    spread = base.select("uri", "frame", "vec", F.explode(F.array_distinct(F.transform(near, lambda d: F.col("c") + d))).alias("c"))
    out = spread.groupBy("uri", "c").applyInPandas(lambda k, p: _warp(width)(p[["uri", "frame", "vec"]]).assign(c=k[1]), "uri string, frame long, vec array<double>, c long")
    return out.where(F.floor(F.col("frame") / chunk) == F.col("c")).drop("c")


def periodic(df: DataFrame, period: float) -> DataFrame:
    """Tiles of one length over the extent of each uri; the last may be shorter."""
    ends = tl.extent(df)
    n = F.greatest(F.lit(1), F.ceil((F.col("end") - F.col("start")) / period - EPS)).cast("long")
    cut = ends.select("uri", "end", "start", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("i"))
    return cut.select("uri", (F.col("start") + F.col("i") * period).alias("start"), F.least(F.col("start") + (F.col("i") + 1) * period, F.col("end")).alias("end"))


def divergence_curve(features: DataFrame, width: int, step: int = 1) -> DataFrame:
    """(uri, frame, y): Gaussian divergence of the ``width`` frames before and after each frame.

    Sliding sums of each dimension give means and variances on both sides.
    """
    flat = features.select("uri", "frame", F.posexplode("vec").alias("dim", "x"))
    order = W.partitionBy("uri", "dim").orderBy("frame")
    left, right = order.rowsBetween(-width, -1), order.rowsBetween(0, width - 1)
    stats = flat.select(
        "uri", "frame", "dim", F.avg("x").over(left).alias("ml"), F.avg("x").over(right).alias("mr"), F.var_pop("x").over(left).alias("vl"), F.var_pop("x").over(right).alias("vr"),
        F.count("x").over(left).alias("nl"), F.count("x").over(right).alias("nr"),
    )
    full = stats.where((F.col("nl") == width) & (F.col("nr") == width) & (F.col("frame") % step == 0))
    d = F.col("ml") - F.col("mr")
    return full.groupBy("uri", "frame").agg(F.sum(d * d / F.sqrt(F.col("vl") * F.col("vr"))).alias("y"))


def change_points(features: DataFrame, width: int = 50, step: int = 1, threshold: float = 0.0) -> DataFrame:
    """Segments of frames between strict local maxima of the divergence above the threshold."""
    order = W.partitionBy("uri").orderBy("frame")
    curve = divergence_curve(features, width, step).withColumns({"p": F.lag("y").over(order), "n": F.lead("y").over(order)})
    peaks = curve.where((F.col("y") > F.col("p")) & (F.col("y") > F.col("n")) & (F.col("y") > threshold)).select("uri", "frame")
    ends = features.groupBy("uri").agg(F.min("frame").alias("lo"), (F.max("frame") + 1).alias("hi"))
    cuts = peaks.unionByName(ends.select("uri", F.explode(F.array("lo", "hi")).alias("frame"))).distinct()
    return cuts.select("uri", F.col("frame").alias("first"), F.lead("frame").over(order).alias("stop")).where("stop IS NOT NULL")


def gaussians(features: DataFrame, by: list[str]) -> DataFrame:
    """Count, mean and variance of each dimension: mergeable, computed with partial aggregation."""
    flat = features.select(*by, F.posexplode("vec").alias("dim", "x"))
    return flat.groupBy(*by, "dim").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("var"))


MODELS = "label string, weight array<double>, mean array<double>, var array<double>"


def _models(spark: SparkSession, models: dict[str | None, Mixture]) -> DataFrame:
    rows = [(k, g.weight.tolist(), g.mean.ravel().tolist(), g.var.ravel().tolist()) for k, g in models.items()]
    return spark.createDataFrame(rows, MODELS)


def _em_step(features: DataFrame, model: Callable[[str | None], Mixture], **how) -> dict[str | None, Mixture]:
    """Each label's model after one EM step over all its frames: partial moments, added up by Spark."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for pdf in batches:
            for key, part in pdf.groupby("label", dropna=False):
                label = key if isinstance(key, str) else None
                found = np.concatenate([m.ravel() for m in model(label).moments(np.stack(part["vec"].to_numpy()).astype(float))])
                sums[label] = sums[label] + found if label in sums else found
        if sums:
            yield pd.DataFrame({"label": list(sums), "m": list(sums.values())})

    parts = features.where("size(vec) > 0").select(F.col("label").cast("string").alias("label"), "vec").mapInPandas(run, "label string, m array<double>")
    added = parts.select("label", F.posexplode("m").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("x"))
    out = {}
    for row in added.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("m")).collect():
        g, m = model(row["label"]), np.array([e["x"] for e in row["m"]])
        k, size = len(g.weight), g.mean.size
        out[row["label"]] = g.moved(m[:k], m[k : k + size].reshape(g.mean.shape), m[k + size :].reshape(g.mean.shape), g.mean, **how)
    return out


def train_mixtures(features: DataFrame, components: int = 4, steps: int = 10) -> DataFrame:
    """A mixture for each label from all its frames, grown by splitting; each EM step is a pass over the frames."""
    stats = gaussians(features, ["label"]).groupBy(F.col("label").cast("string").alias("label")).agg(F.sort_array(F.collect_list(F.struct("dim", "mean", "var"))).alias("g"))
    models = {r["label"]: Mixture(np.ones(1), np.array([[e["mean"] for e in r["g"]]]), np.maximum([[e["var"] for e in r["g"]]], 1e-4)) for r in stats.collect()}
    size = 1
    while models and size < components:
        models = {k: g.split(components) for k, g in models.items()}
        size = min(components, 2 * size)
        for _ in range(steps):
            models = _em_step(features, models.__getitem__)
    return _models(features.sparkSession, models)


def adapt_mixtures(features: DataFrame, background: Mixture, adapt: str = "m", relevance: float = 16.0) -> DataFrame:
    """A mixture for each label, moved from a background model by one EM step over all its frames."""
    return _models(features.sparkSession, _em_step(features, lambda _: background, adapt=adapt, relevance=relevance))


def collect_mixtures(models: DataFrame) -> dict[str, Mixture]:
    """Models are a few numbers for each label."""
    return {r["label"]: Mixture(np.array(w := r["weight"]), np.array(r["mean"]).reshape(len(w), -1), np.array(r["var"]).reshape(len(w), -1)) for r in models.collect()}


def frame_scores(features: DataFrame, models: dict[str, Mixture], background: Mixture | None = None) -> DataFrame:
    """Log-likelihood (ratio) of each frame under each label's model."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["vec"].to_numpy()).astype(float)
                base = background.score(x) if background is not None else 0.0
                for label, g in models.items():
                    yield pd.DataFrame({"uri": pdf["uri"], "frame": pdf["frame"], "label": label, "score": g.score(x) - base})

    return features.select("uri", "frame", "vec").mapInPandas(run, "uri string, frame long, label string, score double")


def track_scores(scores: DataFrame, tracks: DataFrame, window: SlidingWindow) -> DataFrame:
    """Mean frame score of each track and label."""
    first, n = window.to_range(Seg.of())
    ranges = tracks.select("uri", "start", "end", "track", first.alias("i0"), n.alias("n")).alias("t")
    inside = (F.col("s.uri") == F.col("t.uri")) & (F.col("s.frame") >= F.col("t.i0")) & (F.col("s.frame") < F.col("t.i0") + F.col("t.n"))
    rows = scores.alias("s").join(ranges, inside)
    return rows.groupBy("t.uri", "t.start", "t.end", "t.track", "s.label").agg(F.avg("s.score").alias("score"))


def posteriors(track_llr: DataFrame, priors: DataFrame | None = None, open_set: bool = True) -> DataFrame:
    """Bayes over the labels of a track; in an open set, an unknown label has ratio 1."""
    rows = track_llr
    if priors is not None:
        rows = rows.join(priors.select("label", "prior"), "label")
    else:
        each = W.partitionBy("uri", "start", "end", "track")
        rows = rows.withColumn("prior", 1.0 / (F.count(F.lit(1)).over(each) + (1 if open_set else 0)))
    each = W.partitionBy("uri", "start", "end", "track")
    log = F.col("score") + F.log("prior")
    rows = rows.withColumn("_log", log).withColumn("_top", F.greatest(F.max("_log").over(each), F.lit(0.0)))
    rest = F.greatest(F.lit(0.0), 1 - F.sum("prior").over(each)) * F.exp(-F.col("_top")) if open_set else F.lit(0.0)
    total = F.sum(F.exp(F.col("_log") - F.col("_top"))).over(each) + rest
    return rows.withColumn("score", F.exp(F.col("_log") - F.col("_top")) / total).drop("_log", "_top", "prior")


def _wide(pdf: pd.DataFrame, states: list[str]) -> pd.DataFrame:
    return pdf.pivot(index="frame", columns="label", values="score").sort_index().reindex(columns=states, fill_value=-1e6)


def fit_transitions(frame_llr: DataFrame, rounds: int = 10) -> tuple[list[str], np.ndarray, np.ndarray]:
    """States, log starts and log moves by expectation maximisation over all uris.

    Each uri gives its expected moves (forward and backward passes over its frames); Spark adds them
    up, one row for each pair of states reaches the driver.
    """
    states = sorted(r["label"] for r in frame_llr.select("label").distinct().collect())
    k = len(states)
    start, move = np.full(k, 1 / k), np.full((k, k), 0.1 / max(1, k - 1)) if k > 1 else np.ones((1, 1))
    np.fill_diagonal(move, 0.9 if k > 1 else 1.0)
    def expected(start: np.ndarray, move: np.ndarray):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            x = _wide(pdf, states).to_numpy()
            e = np.exp(x - x.max(axis=1, keepdims=True))
            n = len(e)
            fwd, bwd = np.empty((n, k)), np.ones((n, k))
            fwd[0] = start * e[0] / (start * e[0]).sum()
            for t in range(1, n):
                step = (fwd[t - 1] @ move) * e[t]
                fwd[t] = step / step.sum()
            for t in range(n - 2, -1, -1):
                step = move @ (e[t + 1] * bwd[t + 1])
                bwd[t] = step / step.sum()
            pairs = fwd[:-1, :, None] * move[None] * (e[1:] * bwd[1:])[:, None, :]
            moves = (pairs / np.maximum(pairs.sum(axis=(1, 2), keepdims=True), 1e-300)).sum(axis=0)
            first = fwd[0] * bwd[0] / (fwd[0] * bwd[0]).sum()
            rows = [(-1, j, float(first[j])) for j in range(k)] + [(i, j, float(moves[i, j])) for i in range(k) for j in range(k)]
            return pd.DataFrame(rows, columns=["i", "j", "x"])

        return run

    for _ in range(rounds):
        sums = frame_llr.groupBy("uri").applyInPandas(expected(start, move), "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
        start, move = np.zeros(k), np.zeros((k, k))
        for r in sums:
            if r["i"] < 0:
                start[r["j"]] = r["x"]
            else:
                move[r["i"], r["j"]] = r["x"]
        start = (start + 1e-9) / (start + 1e-9).sum()
        move = (move + 1e-9) / (move + 1e-9).sum(axis=1, keepdims=True)
    return states, np.log(start), np.log(move)


def majority(path: np.ndarray, reach: int) -> np.ndarray:
    """Median of a two-state path over ``2 * reach + 1`` frames, mirrored at both ends."""
    if not reach or not len(path):
        return path
    padded = np.pad(path, reach, mode="symmetric")
    sums = np.concatenate([[0], padded.cumsum()])
    return (sums[2 * reach + 1 :] - sums[: -2 * reach - 1] > reach).astype(path.dtype)


def decode(frame_llr: DataFrame, stay: float = 0.99, smooth: int = 0, model: tuple[list[str], np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """Viterbi path over the labels of each uri, as runs of frames of one state.

    ``model`` is what ``fit_transitions`` found; else states are kept with probability ``stay``.
    ``smooth`` removes short runs by a running median over that many frames on both sides, for two
    states; no frame is left out. A uri's frames are one sequence and are decoded together.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        states = model[0] if model else sorted(pdf["label"].unique())
        wide = _wide(pdf, states)
        k = len(states)
        if model:
            start, move = model[1], model[2]
        else:
            start, move = np.full(k, -np.log(k)), np.full((k, k), np.log((1 - stay) / max(1, k - 1)) if k > 1 else 0.0)
            np.fill_diagonal(move, np.log(stay))
        path = viterbi(wide.to_numpy(), move, start)
        if smooth and k > 2:
            raise ValueError("paths of more than two states have no median")
        path = majority(path, smooth)
        cut = np.flatnonzero(np.diff(path)) + 1
        first, stop = np.concatenate([[0], cut]), np.concatenate([cut, [len(path)]])
        at = wide.index.to_numpy()
        return pd.DataFrame({"uri": pdf["uri"].iloc[0], "first": at[first], "stop": at[stop - 1] + 1, "label": np.array(states, dtype=object)[path[first]]})

    return frame_llr.groupBy("uri").applyInPandas(run, "uri string, first long, stop long, label string")


def activity(features: DataFrame, trained_on: DataFrame, window: SlidingWindow, components: int = 4, shortest: float = 0.0) -> DataFrame:
    """(uri, start, end, label) of activity against the rest: a mixture for each label of
    ``trained_on`` frames, trained transitions, a decoded and smoothed path."""
    scored = frame_scores(features, collect_mixtures(train_mixtures(trained_on, components)))
    reach = int(round(shortest / window.step))
    runs = decode(scored, smooth=reach, model=fit_transitions(scored))
    seg = window.to_segment(F.col("first"), F.col("stop") - F.col("first"))
    return runs.select("uri", seg.start.alias("start"), seg.end.alias("end"), "label")


def turns_within(features: DataFrame, focus: DataFrame, window: SlidingWindow, width: int = 50, threshold: float = 0.0) -> DataFrame:
    """(uri, start, end): the focus, cut at the change points of the features."""
    cuts = change_points(features, width, threshold=threshold)
    seg = window.to_segment(F.col("first"), F.col("stop") - F.col("first"))
    return tl.crop(cuts.select("uri", seg.start.alias("start"), seg.end.alias("end")), focus)


def identify(features: DataFrame, tracks: DataFrame, window: SlidingWindow, trained_on: DataFrame, components: int = 4, priors: DataFrame | None = None, open_set: bool = True) -> DataFrame:
    """Posteriors of every track's labels: mixtures, frame scores, track means, Bayes."""
    scored = frame_scores(features, collect_mixtures(train_mixtures(trained_on, components)))
    return posteriors(track_scores(scored, tracks, window), priors, open_set)
