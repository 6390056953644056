"""End-to-end programs: evaluate, report, convert, tag, stats, oracle, cluster, calibrate, mine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanloom.functions.segment import Seg
from spanloom.functions.stats import ScoreRatio
from spanloom.operators import annotation as an
from spanloom.operators import calibration as ca
from spanloom.operators import clustering as cl
from spanloom.operators import graph as gr
from spanloom.operators import mapping as mp
from spanloom.operators import metrics as me
from spanloom.operators import scores as sc
from spanloom.operators import tagging as tg
from spanloom.operators import timeline as tl

METRICS = {"detection": me.detection, "identification": me.identification, "diarization": me.diarization, "purity": me.purity, "coverage": me.coverage, "homogeneity": me.homogeneity, "completeness": me.completeness}


#: Metrics that join pieces with rows, and so can cut long uris by time.
BINNED = ("detection", "identification")


def without_overlap(reference: DataFrame, focus: DataFrame | None = None) -> DataFrame:
    """Evaluation map without the pieces where several reference tracks run.

    Tracks are counted by a sweep over bounds, so nothing is joined with what runs in a piece. A track is
    a row; of those without a name one a piece does not count.
    """
    unnamed = F.col("track").isNull().cast("int")
    bounds = F.array(*[F.struct(F.col(c).alias("t"), (F.lit(d) * (1 - unnamed)).alias("n"), (F.lit(d) * unnamed).alias("z")) for c, d in (("start", 1), ("end", -1))])
    at = reference.where(Seg.of().filled()).select("uri", F.explode(bounds).alias("e")).groupBy("uri", F.col("e.t").alias("t")).agg(F.sum("e.n").alias("n"), F.sum("e.z").alias("z"))
    order = W.partitionBy("uri").orderBy("t")
    now = lambda c: F.sum(c).over(order.rowsBetween(W.unboundedPreceding, 0)).alias(c)
    swept = at.select("uri", F.col("t").alias("start"), F.lead("t").over(order).alias("end"), now("n"), now("z"))
    busy = swept.where((F.col("n") + F.greatest(F.lit(0), F.col("z") - 1) > 1) & Seg.of().filled()).select("uri", "start", "end")
    frame = focus if focus is not None else tl.extent(reference)
    return tl.gaps(busy, frame).unionByName(frame.select("uri", "start", "end").join(busy.select("uri").distinct(), "uri", "left_anti"))


def evaluate(reference: DataFrame, hypotheses: dict[str, DataFrame], metrics: list[str], uem: DataFrame | None = None, skip_overlap: bool = False) -> DataFrame:
    """(hypothesis, uri, metric, rate), with uri '/all' for the rates of summed components."""
    area = without_overlap(reference, uem) if skip_overlap else uem
    ref = reference if area is None else an.crop(reference, area)
    out, width = None, tl.bin_width(ref)
    for name, hyp in hypotheses.items():
        own = hyp if area is None else an.crop(hyp, area)
        for m in metrics:
            rows = METRICS[m](ref, own, **({"bins": width} if m in BINNED else {})).select(F.lit(name).alias("hypothesis"), "uri", F.lit(m).alias("metric"), "rate")
            out = rows if out is None else out.unionByName(rows)
    return out


def report(evaluation: DataFrame) -> DataFrame:
    """Combined rate and mean, median, geometric and harmonic mean of each hypothesis and metric."""
    one = F.col("uri") != "/all"
    rate = F.when(one, F.col("rate"))
    good = F.when(one & (F.col("rate") > 0), F.col("rate"))
    return evaluation.groupBy("hypothesis", "metric").agg(
        F.max(F.when(~one, F.col("rate"))).alias("combined"), F.avg(rate).alias("mean"), F.median(rate).alias("median"),
        F.exp(F.avg(F.log(good))).alias("geometric"), (F.count(good) / F.sum(1 / good)).alias("harmonic"),
    )


def best(evaluation: DataFrame, metric: str, n: int) -> DataFrame:
    return report(evaluation).where(F.col("metric") == metric).orderBy("combined", "hypothesis").limit(n)


def significance(evaluation: DataFrame, metric: str, a: str, b: str) -> float:
    """Wilcoxon p-value of two hypotheses' rates over uris."""
    rows = evaluation.where((F.col("metric") == metric) & (F.col("uri") != "/all"))
    wide = rows.groupBy("uri").pivot("hypothesis", [a, b]).agg(F.first("rate")).toDF("uri", "a", "b").dropna()
    return me.wilcoxon(wide)


def write_csv(evaluation: DataFrame, path: str, metrics: list[str]) -> None:
    evaluation.groupBy("hypothesis", "uri").pivot("metric", metrics).agg(F.first("rate")).orderBy("hypothesis", "uri").coalesce(1).write.option("header", True).mode("errorifexists").csv(path)


def convert(df: DataFrame, focus: DataFrame | None = None, mode: str = "intersection", smooth: bool = False, anonymize: bool = False, retrack: bool = False, threshold: float | None = None) -> DataFrame:
    """Scores or annotations through crop, decision, smoothing, anonymizing and retracking."""
    if "score" in df.columns:
        df = sc.to_annotation(df if focus is None else sc.crop(df, focus, mode), threshold if threshold is not None else float("-inf"))
    elif focus is not None:
        df = an.crop(df, focus, mode)
    if smooth:
        df = an.smooth(df)
    if anonymize:
        df = an.anonymize_labels(df)
    return an.retrack(df) if retrack else df


def tag(original: DataFrame, names: DataFrame, one_to_one: bool = True, conservative: bool = False) -> DataFrame:
    """Name anonymous clusters by another annotation."""
    out = tg.by_mapping(names, an.anonymize_labels(original), mp.hungarian_mapper if one_to_one else mp.argmax_mapper)
    return tg.conservative(names, out) if conservative else out


def stats(files: dict[str, DataFrame]) -> DataFrame:
    """Labels of each uri in each file, and their minimum, maximum and means."""
    out = None
    for name, df in files.items():
        n = df.groupBy("uri").agg(F.count_distinct("label").alias("n"))
        row = n.agg(F.min("n").alias("min"), F.max("n").alias("max"), F.exp(F.avg(F.log("n"))).alias("geometric"), F.avg("n").alias("mean")).select(F.lit(name).alias("file"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def oracle(df: DataFrame, known: DataFrame) -> DataFrame:
    """Keep labels that are known from elsewhere; the others become unknown."""
    names = known.select("label").distinct().withColumn("_k", F.lit(True))
    rows = df.join(names, "label", "left")
    unknown = F.col("_k").isNull()
    return rows.withColumn("is_unknown", unknown).withColumn("label", F.when(unknown, F.concat(F.lit("Inconnu_"), "label")).otherwise(F.col("label"))).drop("_k")


def without_small_tracks(df: DataFrame, shortest: float) -> DataFrame:
    return df.where(F.col("end") - F.col("start") >= shortest)


def cluster(similarity: DataFrame, annotation: DataFrame, linkage: str = "average", threshold: float = 0.0) -> DataFrame:
    """Relabel an annotation by clustering its labels."""
    found = cl.agglomerative(similarity, linkage, threshold)
    return an.translate(annotation, found.select("uri", F.col("item").alias("left"), F.col("cluster").alias("right")), per_uri=True)


def calibration_samples(scores: DataFrame, reference: DataFrame, targets: list[str], uem: DataFrame | None = None) -> DataFrame:
    """(label, score, target) of scored tracks: reference labels are moved onto the score tracks
    inside the region both sides cover."""
    area = tl.crop(tl.islands(reference), tl.islands(scores))
    if uem is not None:
        area = tl.crop(area, uem)
    own = sc.crop(scores.where(F.col("label").isin(targets)), area, "intersection")
    tracks = own.select("uri", "start", "end", "track").distinct().withColumn("label", F.lit("?"))
    truth = tg.argmax_annotation(an.crop(reference, area), tracks).where("label <> '?'")
    return ca.authentication_samples(own, truth)


def calibrate(samples: DataFrame, scores: DataFrame, kind: str = "isotonic") -> tuple[ScoreRatio, DataFrame]:
    model = ca.fit(samples, kind=kind)
    return model, ca.apply(scores, model)


def train_similarity(similarity: DataFrame, reference: DataFrame, hypothesis: DataFrame, kind: str = "isotonic", bins: int = 50) -> ScoreRatio:
    """Calibration of similarities of clusters: pairs that one reference label links against pairs
    whose main labels differ; pairs that say neither take no part."""
    links = ca.cluster_links(reference, hypothesis).where("value <> 0")
    rows = similarity.where("row <> col AND value IS NOT NULL").select("uri", F.least("row", "col").alias("row"), F.greatest("row", "col").alias("col"), F.col("value").alias("score"))
    samples = rows.join(links, ["uri", "row", "col"]).select("score", (F.col("value") == 1).cast("int").alias("target"))
    return ca.fit(samples, bins, kind)


def train_track_similarity(similarity: DataFrame, labels: DataFrame, kind: str = "isotonic", bins: int = 50) -> ScoreRatio:
    """Calibration of similarities of tracks: equal labels against different ones."""
    return ca.fit(ca.pair_samples(similarity, labels), bins, kind)


def diarize(similarity: DataFrame, annotation: DataFrame, model: ScoreRatio | None = None) -> DataFrame:
    """Relabel by the best partition of (calibrated) similarities: weights are posteriors less a half."""
    rows = similarity.where("row < col AND value IS NOT NULL")
    if model is not None:
        rows = ca.apply(rows.withColumnRenamed("value", "score"), model).select("uri", "row", "col", (F.col("posterior") - 0.5).alias("value"))
    found = cl.correlation(rows)
    return an.translate(annotation, found.select("uri", F.col("item").alias("left"), F.col("cluster").alias("right")), per_uri=True)


def parse_threshold(text: str) -> float | str:
    """A number, ``-oo``, ``+oo`` or ``P`` for posteriors."""
    known = {"-oo": float("-inf"), "+oo": float("inf"), "oo": float("inf"), "P": "posterior"}
    return known[text] if text in known else float(text)


def mine(tracks: DataFrame, scores: DataFrame | None = None, names: DataFrame | None = None, similarity: DataFrame | None = None, nbest: int | None = None, alpha: float = 0.5) -> DataFrame:
    """Identities of tracks from all evidence: certain names, scores, similarities, exclusions."""
    parts = []
    if scores is not None:
        edges = gr.from_scores(scores)
        parts.append(gr.prune_identities(edges, nbest) if nbest else edges)
    if similarity is not None:
        parts.append(gr.from_similarity(similarity))
    if names is not None:
        parts.append(gr.from_annotation(names))
    graph = gr.merge(*parts)
    graph = gr.merge(graph, gr.identity_constraints(graph), gr.track_constraints(tracks))
    found = gr.mine(graph, alpha)
    rows = tracks.withColumn("item", gr.track_id("speaker")).join(found, ["uri", "item"], "left")
    return rows.withColumns({"label": F.coalesce("identity", F.concat(F.lit("Inconnu_"), F.coalesce("cluster", "item"))), "is_unknown": F.col("identity").isNull()}).select("uri", "start", "end", "track", "label", "is_unknown")
