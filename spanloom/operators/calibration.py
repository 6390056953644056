"""Scores to probabilities: histograms in Spark, small fits on their bins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanloom.functions.stats import ScoreRatio, normal_quantile
from spanloom.operators import annotation as an
from spanloom.operators import matrix as mx
from spanloom.session import checkpoint_dir


def histogram(samples: DataFrame, bins: int = 50, low: float | None = None, high: float | None = None) -> DataFrame:
    """(bin, target, other): counts of (score, target 0/1) in equal bins."""
    if low is None or high is None:
        low, high = samples.agg(F.min("score"), F.max("score")).first()
    width = (high - low) / bins or 1.0
    at = F.least(F.lit(bins - 1), F.floor((F.col("score") - low) / width)).cast("int")
    return samples.groupBy(at.alias("bin")).agg(F.count_if(F.col("target") == 1).alias("target"), F.count_if(F.col("target") == 0).alias("other"))


def fit(samples: DataFrame, bins: int = 50, kind: str = "isotonic") -> ScoreRatio:
    """A ratio model from the histogram; only its bins reach the driver."""
    low, high = samples.agg(F.min("score"), F.max("score")).first()
    rows = sorted(histogram(samples, bins, low, high).collect())
    width = (high - low) / bins or 1.0
    return ScoreRatio.from_histogram(np.array([low + (r["bin"] + 0.5) * width for r in rows]), np.array([r["target"] for r in rows], float), np.array([r["other"] for r in rows], float), kind)


def piecewise(x: Column, knots: np.ndarray, values: np.ndarray) -> Column:
    """Linear interpolation as one expression, clamped at both ends."""
    out = F.lit(float(values[0]))
    for (a, b), (u, v) in zip(zip(knots[:-1], knots[1:], strict=True), zip(values[:-1], values[1:], strict=True), strict=True):
        inside = F.least(F.greatest(x, F.lit(float(a))), F.lit(float(b)))
        out = out + (inside - F.lit(float(a))) * F.lit(float((v - u) / (b - a)))
    return out


def apply(scores: DataFrame, model: ScoreRatio) -> DataFrame:
    """Add llr and posterior to a score column."""
    llr = piecewise(F.col("score"), model.x, model.llr)
    odds = (1 - model.prior) / model.prior
    return scores.withColumn("llr", llr).withColumn("posterior", 1 / (1 + F.lit(odds) * F.exp(-F.col("llr"))))


def linear_llr(samples: DataFrame, bins: int = 20) -> DataFrame:
    """One row: slope and intercept of log density ratio on score, over quantile bins.

    Bins hold equal numbers of samples; regression runs in Spark.
    """
    cuts = samples.stat.approxQuantile("score", [i / bins for i in range(1, bins)], 0.0)
    at = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("score")))
    per = samples.groupBy(at.alias("bin")).agg(F.avg("score").alias("x"), F.count_if(F.col("target") == 1).alias("t"), F.count_if(F.col("target") == 0).alias("o"))
    whole = W.partitionBy(F.lit(0))
    y = F.log(F.col("t") / F.sum("t").over(whole)) - F.log(F.col("o") / F.sum("o").over(whole))
    return per.withColumn("y", y).where("t > 0 AND o > 0").agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"))


def pair_samples(similarity: DataFrame, labels: DataFrame) -> DataFrame:
    """(score, target) of a track matrix (uri, row, col, value): target 1 for tracks of one label."""
    side = lambda name: labels.select("uri", F.col("track").alias(name), F.col("label").alias(name + "_label"))
    rows = similarity.where("row <> col AND value IS NOT NULL").join(side("row"), ["uri", "row"]).join(side("col"), ["uri", "col"])
    return rows.select("uri", F.col("value").alias("score"), (F.col("row_label") == F.col("col_label")).cast("int").alias("target"))


def groundtruth(labels: DataFrame, bound: Column | None = None) -> DataFrame:
    """Track pairs (row < col) of a uri with 1 for equal labels, else 0; ``bound`` limits which
    pairs are formed (columns of a and b)."""
    a, b = labels.alias("a"), labels.alias("b")
    on = (F.col("a.uri") == F.col("b.uri")) & (F.col("a.track") < F.col("b.track"))
    return a.join(b, on if bound is None else on & bound).select("a.uri", F.col("a.track").alias("row"), F.col("b.track").alias("col"), (F.col("a.label") == F.col("b.label")).cast("double").alias("value"))


def authentication_samples(scores: DataFrame, reference: DataFrame) -> DataFrame:
    """(label, score, target): scores of tracks whose label is known, exact (segment, track)."""
    key = ["uri", "start", "end", "track"]
    return scores.join(reference.select(*key, F.col("label").alias("truth")), key).where(~F.isnan("score")).select("uri", "label", "score", (F.col("label") == F.col("truth")).cast("int").alias("target"))


def duration_priors(reference: DataFrame) -> DataFrame:
    """Share of all labelled time of each label."""
    rows = an.label_durations(reference).groupBy("label").agg(F.sum("duration").alias("d"))
    return rows.select("label", (F.col("d") / F.sum("d").over(W.partitionBy(F.lit(0)))).alias("prior"))


def normalized_posteriors(scores: DataFrame, priors: DataFrame, slope: float, intercept: float, unknown: float = 0.1) -> DataFrame:
    """Open-set posteriors of all labels of a track from one linear score map."""
    llr = slope * F.col("score") + intercept
    rows = scores.join(priors, "label").withColumn("_w", F.col("prior") * (1 - unknown) * F.exp(llr))
    total = F.sum("_w").over(W.partitionBy("uri", "start", "end", "track")) + unknown
    return rows.withColumn("posterior", F.col("_w") / total).drop("_w", "prior")


def logistic(x: Column, low: float, high: float, growth: float, middle: float) -> Column:
    return low + (high - low) / (1 + F.exp(-growth * (x - middle)))


def generalized_logistic(x: Column, growth: float, q: float, middle: float, nu: float) -> Column:
    """1 / (1 + q exp(-growth (x - middle))) ** (1 / nu)."""
    return F.pow(1 + q * F.exp(-growth * (x - middle)), F.lit(-1.0 / nu))


def logistic_points(samples: DataFrame, bins: int = 50, prior: float | None = None) -> DataFrame:
    """(x, y): middles of bins and the posterior that the densities of (score, target 0/1) give there.

    Bin borders are quantiles of a normal between the two classes: its middle is where both classes'
    normals are equally likely, its width that of the wider class. Bins with too few samples of a class
    are left out. Only means, deviations and counts are taken to the driver."""
    finite = samples.where(F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf")) & F.col("target").isin(0, 1))
    stats = {r["target"]: r for r in finite.groupBy("target").agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s"), F.count(F.lit(1)).alias("n")).collect()}
    if len(stats) < 2:
        raise ValueError("samples of both classes are needed")
    (mp, sp, np_), (mn, sn, nn) = ((stats[t]["m"], stats[t]["s"], stats[t]["n"]) for t in (1, 0))
    odds = nn / np_ if prior is None else prior
    apart = lambda t: (-0.5 * ((t - mp) / sp) ** 2 - np.log(sp)) - (-0.5 * ((t - mn) / sn) ** 2 - np.log(sn))
    low, high = min(mp, mn), max(mp, mn)
    sign = apart(low)
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if apart(mid) * sign > 0 else (low, mid)
    cuts = low + max(sp, sn) * normal_quantile(np.arange(1, bins) / bins)
    at = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c <= F.col("score")))
    per = finite.groupBy(at.alias("bin")).agg(F.count_if(F.col("target") == 1).alias("t"), F.count_if(F.col("target") == 0).alias("o"))
    middles = [float((a + b) / 2) for a, b in zip(cuts, cuts[1:], strict=False)]
    rows = per.where((F.col("bin") > 0) & (F.col("bin") < bins - 1) & (F.col("t") > np_ / (10 * bins)) & (F.col("o") > nn / (10 * bins)))
    x = F.element_at(F.array(*[F.lit(m) for m in middles]), F.col("bin"))
    return rows.select(x.alias("x"), (1 / (1 + F.lit(float(odds)) * (F.col("o") / nn) / (F.col("t") / np_))).alias("y"))


def logistic_sums(points: DataFrame, growth: float, q: float, middle: float, nu: float) -> DataFrame:
    """One row of sums over (x, y) at a point: squared residuals, gradient g0..g3 and normal matrix
    h00..h33 of the generalized logistic in the order growth, log q, middle, log nu."""
    u = F.col("x") - middle
    e = q * F.exp(-growth * u)
    f = generalized_logistic(F.col("x"), growth, q, middle, nu)
    slope = f / nu * e / (1 + e)  # minus df / d log e
    rows = points.select((F.col("y") - f).alias("r"), (slope * u).alias("j0"), (-slope).alias("j1"), (-slope * growth).alias("j2"), (f / nu * F.log(1 + e)).alias("j3"))
    sums = [F.sum(F.col("r") * F.col("r")).alias("rss")] + [F.sum(F.col("r") * F.col(f"j{i}")).alias(f"g{i}") for i in range(4)]
    return rows.agg(*sums, *[F.sum(F.col(f"j{i}") * F.col(f"j{k}")).alias(f"h{i}{k}") for i in range(4) for k in range(i, 4)])


def fit_generalized_logistic(points: DataFrame, start: tuple[float, float, float, float], rounds: int = 60, tolerance: float = 1e-12) -> tuple[float, float, float, float]:
    """Damped Gauss-Newton from ``start`` (growth, q, middle, nu); q and nu stay positive. Each step
    is one pass of Spark over the points, which are checkpointed once; fifteen sums reach the driver."""
    checkpoint_dir(points.sparkSession)
    points = points.select("x", "y").checkpoint()
    at = np.array([start[0], np.log(start[1]), start[2], np.log(start[3])], float)
    sums = lambda v: logistic_sums(points, float(v[0]), float(np.exp(v[1])), float(v[2]), float(np.exp(v[3]))).first().asDict()
    now, damping = sums(at), 1e-3
    if now["rss"] is None:
        raise ValueError("no points to fit")
    for _ in range(rounds):
        g = np.array([now[f"g{i}"] for i in range(4)])
        h = np.array([[now[f"h{min(i, k)}{max(i, k)}"] for k in range(4)] for i in range(4)])
        step = np.linalg.lstsq(h + damping * np.diag(np.maximum(np.diag(h), 1e-12)), g, rcond=None)[0]
        new = at + np.clip(step, -5, 5) * np.where([True, False, True, False], np.maximum(1.0, np.abs(at)), 1.0) if np.abs(step).max() > 5 else at + step
        then = sums(new)
        if then["rss"] is not None and np.isfinite(then["rss"]) and then["rss"] <= now["rss"]:
            done = now["rss"] - then["rss"] <= tolerance * max(now["rss"], 1e-300)
            at, now, damping = new, then, max(damping / 5, 1e-12)
            if done:
                break
        else:
            damping *= 4
            if damping > 1e12:
                break
    return float(at[0]), float(np.exp(at[1])), float(at[2]), float(np.exp(at[3]))


def apply_generalized_logistic(scores: DataFrame, model: tuple[float, float, float, float]) -> DataFrame:
    """Add a posterior, kept a millionth off 0 and 1."""
    y = generalized_logistic(F.col("score"), *model)
    return scores.withColumn("posterior", F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), y)))


def binarize(x: Column, threshold: float, strict: bool = True) -> Column:
    return ((x > threshold) if strict else (x >= threshold)).cast("double")


def cluster_links(reference: DataFrame, hypothesis: DataFrame) -> DataFrame:
    """(uri, row, col, value) for hypothesis labels: 1 if only one reference label links both, -1
    if their main labels differ, 0 if one of them meets several or none."""
    k = mx.cooccurrence(hypothesis, reference).where("value > 0")
    pure = k.groupBy("uri", "row").agg(F.count(F.lit(1)).alias("n"), F.min("col").alias("main"))
    a, b = pure.alias("a"), pure.alias("b")
    pairs = a.join(b, (F.col("a.uri") == F.col("b.uri")) & (F.col("a.row") < F.col("b.row")))
    value = F.when((F.col("a.n") > 1) | (F.col("b.n") > 1), 0).when(F.col("a.main") == F.col("b.main"), 1).otherwise(-1)
    return pairs.select("a.uri", "a.row", F.col("b.row").alias("col"), value.alias("value"))
