"""Identity graphs: vertices are tracks and identities, edges (uri, src, dst, probability), src < dst."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanloom.functions.segment import Seg
from spanloom.functions.stats import ScoreRatio
from spanloom.operators import calibration as ca
from spanloom.operators import clustering as cl
from spanloom.operators import metrics as me
from spanloom.operators import timeline as tl
from spanloom.session import checkpoint_dir

EDGE = ("uri", "src", "dst", "probability")


def track_id(modality: str):
    return F.concat_ws("|", F.lit("track"), F.lit(modality), "start", "end", "track")


def identity_id(col: str = "label"):
    return F.concat_ws("|", F.lit("identity"), F.col(col))


def edge(df: DataFrame) -> DataFrame:
    """Canonical orientation; the highest probability of repeated edges stays."""
    rows = df.select("uri", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "probability").where("src <> dst")
    return rows.groupBy("uri", "src", "dst").agg(F.max("probability").alias("probability"))


def from_segmentation(df: DataFrame, modality: str = "speaker") -> DataFrame:
    """Track vertices."""
    return df.select("uri", track_id(modality).alias("id"), F.lit("track").alias("kind"), "start", "end", "track").distinct()


def from_annotation(df: DataFrame, modality: str = "speaker") -> DataFrame:
    """Certain edges from tracks to the identities of their labels."""
    known = df.where(~F.col("is_unknown")) if "is_unknown" in df.columns else df
    return edge(known.select("uri", track_id(modality).alias("src"), identity_id().alias("dst"), F.lit(1.0).alias("probability")))


def from_scores(df: DataFrame, modality: str = "speaker") -> DataFrame:
    return edge(df.select("uri", track_id(modality).alias("src"), identity_id().alias("dst"), F.col("score").alias("probability")))


def from_similarity(matrix: DataFrame) -> DataFrame:
    return edge(matrix.select("uri", F.col("row").alias("src"), F.col("col").alias("dst"), F.col("value").alias("probability")))


def track_constraints(df: DataFrame, modality: str = "speaker", bins: float | None = None) -> DataFrame:
    """Probability 0 between overlapping tracks of one modality."""
    rows = df.select("uri", "start", "end", "track").withColumn("id", track_id(modality))
    met = tl.overlap_join(rows, rows, extra=F.col("a_id") < F.col("b_id"), bins=bins)
    return met.select("uri", F.col("a_id").alias("src"), F.col("b_id").alias("dst"), F.lit(0.0).alias("probability"))


def identity_constraints(edges: DataFrame) -> DataFrame:
    """Probability 0 between all identities of a uri (its cast, not its tracks)."""
    ids = edges.select("uri", F.explode(F.array("src", "dst")).alias("id")).where(F.col("id").startswith("identity|")).distinct()
    a, b = ids.alias("a"), ids.alias("b")
    return a.join(b, (F.col("a.uri") == F.col("b.uri")) & (F.col("a.id") < F.col("b.id"))).select("a.uri", F.col("a.id").alias("src"), F.col("b.id").alias("dst"), F.lit(0.0).alias("probability"))


def merge(*graphs: DataFrame) -> DataFrame:
    """Later graphs overwrite earlier ones."""
    rows = graphs[0].withColumn("_n", F.lit(0))
    for i, g in enumerate(graphs[1:], 1):
        rows = rows.unionByName(g.withColumn("_n", F.lit(i)))
    return rows.groupBy("uri", "src", "dst").agg(F.max_by("probability", "_n").alias("probability"))


def mapped(edges: DataFrame, f) -> DataFrame:
    out = edges.withColumn("probability", f(F.col("probability")))
    return out.where(F.col("probability").isNotNull() & ~F.isnan("probability") & (F.abs("probability") < float("inf")))


def subgraphs(edges: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(uri, item, component) of edges above the threshold."""
    return cl.components(edges.where(F.col("probability") > threshold).select("uri", F.col("src").alias("row"), F.col("dst").alias("col")))


def _lifted(edges: DataFrame, sure: DataFrame) -> DataFrame:
    """Edges with the groups of their ends; an end without a certain edge is its own group."""
    for end in ("src", "dst"):
        side = sure.select("uri", F.col("item").alias(end), F.col("component").alias(end + "_c"))
        edges = edges.join(side, ["uri", end], "left").withColumn(end + "_c", F.coalesce(end + "_c", end))
    return edges


def _read_once(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges, written once, and (uri, item, component) of the certain ones."""
    checkpoint_dir(edges.sparkSession)
    edges = edges.select(*EDGE).checkpoint()
    return edges, cl.components(edges.where("probability = 1").select("uri", F.col("src").alias("row"), F.col("dst").alias("col")))


def contract(edges: DataFrame) -> DataFrame:
    """Graph of the groups that certain edges join; parallel edges are averaged."""
    rows = _lifted(*_read_once(edges)).where("src_c <> dst_c")
    return rows.groupBy("uri", F.least("src_c", "dst_c").alias("src"), F.greatest("src_c", "dst_c").alias("dst")).agg(F.avg("probability").alias("probability"))


def propagate(edges: DataFrame) -> DataFrame:
    """Which groups of certain edges exclude each other: probability 0 between the groups and 1 to
    a group's head; closure stays on groups instead of spelling out their pairs."""
    edges, comp = _read_once(edges)
    apart = _lifted(edges.where("probability = 0"), comp).select("uri", F.least("src_c", "dst_c").alias("src"), F.greatest("src_c", "dst_c").alias("dst"), F.lit(0.0).alias("probability")).distinct()
    inside = comp.where("item <> component").select("uri", F.least("item", "component").alias("src"), F.greatest("item", "component").alias("dst"), F.lit(1.0).alias("probability"))
    return apart.unionByName(inside)


def conflicts(edges: DataFrame) -> DataFrame:
    """Groups that certain edges join although an edge says 0."""
    edges, comp = _read_once(edges)
    return _lifted(edges.where("probability = 0"), comp).where("src_c = dst_c")


def prune_identities(edges: DataFrame, n: int) -> DataFrame:
    """Keep the n likeliest identities of each track, in one pass over the edges."""
    to = F.coalesce(F.col("src").startswith("identity|") & F.col("dst").startswith("track|"), F.lit(False))
    k = F.row_number().over(W.partitionBy("uri", "dst", "_to").orderBy(F.desc("probability"), "src"))
    return edges.withColumn("_to", to).withColumn("_k", k).where(~F.col("_to") | (F.col("_k") <= n)).drop("_to", "_k")


def log_costs(edges: DataFrame) -> DataFrame:
    return edges.where("probability > 0").withColumn("probability", -F.log("probability"))


def shortest_paths(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(uri, source, item, probability): likeliest path from each source (uri, item), by relaxation
    over -log probabilities until no path gets better; lineage is cut by checkpoints each round."""
    spark = edges.sparkSession
    checkpoint_dir(spark)
    cost = log_costs(edges)
    both = cost.select("uri", "src", "dst", F.col("probability").alias("c")).unionByName(cost.select("uri", F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("probability").alias("c"))).checkpoint()
    if not both.where("c < 0").isEmpty():
        raise ValueError("probabilities above 1 have no likeliest path")
    now = sources.select("uri", F.col("item").alias("source"), "item", F.lit(0.0).alias("c"), F.lit(True).alias("new")).distinct().checkpoint()
    while not now.where("new").isEmpty():
        step = now.where("new").select("uri", "source", F.col("item").alias("src"), F.col("c").alias("d")).join(both, ["uri", "src"])
        found = step.select("uri", "source", F.col("dst").alias("item"), (F.col("d") + F.col("c")).alias("c"), F.lit(None).cast("double").alias("was"))
        best = now.select("uri", "source", "item", "c", F.col("c").alias("was")).unionByName(found).groupBy("uri", "source", "item").agg(F.min("c").alias("c"), F.min("was").alias("was"))
        now = best.select("uri", "source", "item", "c", (F.col("was").isNull() | (F.col("c") < F.col("was"))).alias("new")).checkpoint()
    return now.select("uri", "source", "item", F.exp(-F.col("c")).alias("probability"))


def cooccurrence_fit(a: DataFrame, b: DataFrame, min_duration: float = 0.0, significant: float = 0.0) -> DataFrame:
    """(na, nb, probability): chance that a track of each side is the same label, by how many run."""
    counts = me.cell_labels(a, b).where(F.col("end") - F.col("start") > min_duration)
    per = counts.groupBy("uri", "start", "end").agg(F.sum("r").alias("na"), F.sum("h").alias("nb"), F.count_if((F.col("r") > 0) & (F.col("h") > 0)).alias("n"))
    d = F.col("end") - F.col("start")
    sums = per.where("na > 0 AND nb > 0").groupBy("na", "nb").agg(F.sum(d * F.least("na", "nb")).alias("most"), F.sum(d * F.col("n")).alias("same"), F.sum(d).alias("seconds"))
    p = F.least(F.lit(1 - 1e-6), F.col("same") / F.col("most"))
    return sums.select("na", "nb", "seconds", F.when(F.col("seconds") >= significant, p).alias("probability"))


def cooccurrence_edges(a: DataFrame, b: DataFrame, model: DataFrame) -> DataFrame:
    """Edges between overlapping tracks of two modalities from a fitted table."""
    both = Seg.of("a_").intersection(Seg.of("b_"))
    met = tl.overlap_join(a, b).select("uri", both.start.alias("start"), both.end.alias("end"), "a_track", "b_track", "a_start", "a_end", "b_start", "b_end")
    n = lambda df, c: tl.overlap_join(met.select("uri", "start", "end").distinct(), df).groupBy("uri", F.col("a_start").alias("start"), F.col("a_end").alias("end")).agg(F.count(F.lit(1)).alias(c))
    rows = met.join(n(a, "na"), ["uri", "start", "end"]).join(n(b, "nb"), ["uri", "start", "end"]).join(model, ["na", "nb"])
    name = lambda m, p: F.concat_ws("|", F.lit("track"), F.lit(m), f"{p}start", f"{p}end", f"{p}track")
    return edge(rows.where("probability IS NOT NULL").select("uri", name("a", "a_").alias("src"), name("b", "b_").alias("dst"), "probability"))


def _bin_runs(df: DataFrame, resolution: float, *cols: str) -> DataFrame:
    """Bins from ``start`` up to, not including, ``end`` that each segment reaches into."""
    first, stop = F.floor(F.col("start") / resolution).cast("double"), F.ceil(F.col("end") / resolution).cast("double")
    return df.select("uri", *cols, first.alias("start"), stop.alias("end")).where("uri IS NOT NULL").distinct()


def _widened(runs: DataFrame, low: int, high: int) -> DataFrame:
    """Runs as (from, to), widened to what lies between ``low`` and ``high`` bins ahead."""
    names = [c for c in runs.columns if c not in ("start", "end")]
    return runs.select(*names, F.col("start").alias("from"), F.col("end").alias("to"), (F.col("start") + low - 1).alias("start"), (F.col("end") + high + 1).alias("end"))


def _reach(low: int, high: int):
    """Smallest and largest lag, within the limits, between a bin of one run and a bin of the other."""
    x0, x1, y0, y1 = (F.col(c).cast("int") for c in ("a_from", "a_to", "b_start", "b_end"))
    return F.greatest(F.lit(low), y0 - x1 + 1), F.least(F.lit(high), y1 - x0 - 1)


def lag_fit(a: DataFrame, b: DataFrame, neighbourhood: float, resolution: float) -> DataFrame:
    """(lag, probability): of the times both sides speak ``lag`` bins apart, how often by one label.

    A label's bins are kept as runs, and labels that run at once as counted pieces, so what is joined
    follows the number of segments and not the bins they fill. Joins are merges: sizes that are
    estimated from a table's file say little here and must not broadcast a side."""
    k = int(neighbourhood / resolution)
    runs = [tl.islands(_bin_runs(df.where("label IS NOT NULL"), resolution, "label"), ("uri", "label")) for df in (a, b)]

    def pieces(df: DataFrame) -> DataFrame:
        both = F.array(F.struct(F.col("start").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end").alias("t"), F.lit(-1).alias("d")))
        at = df.select("uri", F.explode(both).alias("e")).groupBy("uri", F.col("e.t").alias("t")).agg(F.sum("e.d").alias("d")).where("d <> 0")
        order = W.partitionBy("uri").orderBy("t")
        swept = at.select("uri", F.col("t").alias("start"), F.lead("t").over(order).alias("end"), F.sum("d").over(order.rowsBetween(W.unboundedPreceding, 0)).alias("n"))
        return swept.where("n > 0")

    def met(x: DataFrame, y: DataFrame, keys: tuple[str, ...], weight, name: str) -> DataFrame:
        pairs = tl.overlap_join(_widened(x, -k, k), y.hint("merge"), keys, bins=16.0 * (2 * k + 1))
        first, last = _reach(-k, k)
        each = pairs.where(first <= last).withColumn("lag", F.explode(F.sequence(first, last)))
        shared = F.least(F.col("a_to"), F.col("b_end") - F.col("lag")) - F.greatest(F.col("a_from"), F.col("b_start") - F.col("lag"))
        return each.groupBy("lag").agg(F.sum(weight * shared.cast("long")).alias(name))

    same = met(*runs, ("uri", "label"), F.lit(1), "same")
    every = met(*map(pieces, runs), ("uri",), F.col("a_n") * F.col("b_n"), "every")
    return every.join(same, "lag", "left").select("lag", (F.coalesce("same", F.lit(0)) / F.col("every")).alias("probability"))


def _known_lags(model: DataFrame, k: int) -> dict[int, float]:
    """The lag table, at most 2 k + 1 rows; lags without a probability are left out."""
    return {int(r["lag"]): float(r["probability"]) for r in model.where(F.abs("lag") <= k).select("lag", "probability").collect() if r["probability"] is not None}


def lag_edges(a: DataFrame, b: DataFrame, model: DataFrame, neighbourhood: float, resolution: float, future: bool = False, bins: float | None = None) -> DataFrame:
    """(uri, a_track, b_track, probability): for tracks within reach of each other, the largest
    probability of any lag between a bin of one and a bin of the other; ``future`` looks ahead only.

    The lags between two runs of bins are a range, so no bin is spelled out. ``bins`` cuts large uris."""
    k = int(neighbourhood / resolution)
    low = 0 if future else -k
    known = _known_lags(model, k)
    table = F.array(*[F.lit(known.get(x)).cast("double") for x in range(low, k + 1)])
    pairs = tl.overlap_join(_widened(_bin_runs(a, resolution, "track"), low, k), _bin_runs(b, resolution, "track").hint("merge"), bins=bins)
    first, last = _reach(low, k)
    best = pairs.where(first <= last).select("uri", "a_track", "b_track", F.array_max(F.slice(table, first - low + 1, last - first + 1)).alias("probability"))
    return best.where("probability IS NOT NULL").groupBy("uri", "a_track", "b_track").agg(F.max("probability").alias("probability"))


def lag_average(a: DataFrame, b: DataFrame, model: DataFrame, neighbourhood: float, resolution: float, future: bool = False, bins: float | None = None) -> DataFrame:
    """(uri, a_track, b_track, probability): for tracks within reach of each other, the mean probability
    of the lags between their bins, each pair of bins once.

    How often a lag occurs between two runs of bins is a trapezoid, the difference of four ramps, so a
    mean needs four look-ups in running sums of the lag table (2 k + 1 rows) and no bin is spelled out.
    A track is one run of bins; ``bins`` cuts large uris for the join of near tracks."""
    k = int(neighbourhood / resolution)
    low = 0 if future else -k
    known = _known_lags(model, k)

    def ramps(values: dict[int, float]):
        """Sum over lags L > c of (L - c) times the value, as a function of a whole-number column c."""
        lags = range(low, k + 1)
        sums = [float(sum((x - c) * values.get(x, 0.0) for x in lags if x > c)) for c in range(low - 1, k + 1)]
        table, total = F.array(*map(F.lit, sums)), F.lit(float(sum(values.get(x, 0.0) for x in lags)))
        inside = lambda c: F.element_at(table, F.greatest(F.lit(1), F.least(F.lit(len(sums)), c - (low - 1) + 1)).cast("int"))
        return lambda c: inside(c) + F.greatest(F.lit(0), (low - 1) - c) * total

    met = tl.overlap_join(_widened(_bin_runs(a, resolution, "track"), low, k), _bin_runs(b, resolution, "track").hint("merge"), bins=bins)
    x0, x1, y0, y1 = (F.col(c).cast("long") for c in ("a_from", "a_to", "b_start", "b_end"))
    trapezoid = lambda f: f(y0 - x1) - f(y0 - x0) - f(y1 - x1) + f(y1 - x0)
    sums = met.groupBy("uri", "a_track", "b_track").agg(F.sum(trapezoid(ramps(known))).alias("p"), F.sum(trapezoid(ramps(dict.fromkeys(known, 1.0)))).alias("n"))
    return sums.where("n > 0").select("uri", "a_track", "b_track", (F.col("p") / F.col("n")).alias("probability"))


#: How the durations of two tracks weigh a pair.
DURATION_WEIGHTS = {"gmean": lambda a, b: F.sqrt(a * b), "mean": lambda a, b: (a + b) / 2, "min": F.least, "max": F.greatest}


def objective(edges: DataFrame, kind: str = "probability", alpha: float = 0.5, durations: DataFrame | None = None, weight: str = "gmean") -> tuple[DataFrame, dict]:
    """Pair weights whose sum inside clusters an objective maximises (constants left out), and what
    ``clustering.correlation`` needs beside them. Probabilities 0 and 1 stay constraints.

    ``large`` and ``small``: as many or as few pairs as the constraints allow, among all items of a uri
    that have edges; ``probability``: alpha p inside plus (1 - alpha)(1 - p) between clusters; ``log``: (1 - alpha)
    log p inside plus alpha log(1 - p) between; ``weighted``: as ``probability``, times a mean of the
    durations (uri, item, duration) of both items, of one if only one has any, else 1; ``modularity``."""
    p = F.col("probability")
    hard = F.lit(0) if kind == "modularity" else F.when(p == 1, 1).when(p == 0, -1).otherwise(0)
    rows = edges.select("uri", F.col("src").alias("row"), F.col("dst").alias("col"), "probability", hard.alias("hard"))
    value, more = alpha * p - (1 - alpha) * (1 - p), {}
    if kind in ("large", "small"):
        value = F.lit(1.0 if kind == "large" else -1.0)
        more["missing"] = 1.0 if kind == "large" else -1.0
    elif kind == "log":
        value = (1 - alpha) * F.log(p) - alpha * F.log(1 - p)
    elif kind == "weighted":
        for c in ("row", "col"):
            rows = rows.join(durations.select("uri", F.col("item").alias(c), F.col("duration").alias(c + "_d")), ["uri", c], "left")
        x, y = F.coalesce("row_d", "col_d", F.lit(1.0)), F.coalesce("col_d", "row_d", F.lit(1.0))
        value = value * DURATION_WEIGHTS[weight](x, y)
    elif kind == "modularity":
        ends = rows.select("uri", F.explode(F.array("row", "col")).alias("item"), "probability").groupBy("uri", "item").agg(F.sum("probability").alias("k"))
        whole = rows.groupBy("uri").agg((2 * F.sum("probability")).alias("t"))
        rows = rows.join(whole, "uri")
        value = 2 * p / F.col("t")
        more["pull"] = ends.join(whole, "uri").select("uri", "item", (F.col("k") * F.sqrt(F.lit(2.0)) / F.col("t")).alias("k"))
    elif kind != "probability":
        raise ValueError(f"no objective {kind}")
    free = F.when(F.col("hard") == 0, value).otherwise(0.0)
    return rows.select("uri", "row", "col", free.alias("value"), "hard"), more


def intra_edges(similarity: DataFrame, tracks: DataFrame, model: ScoreRatio, modality: str = "speaker") -> DataFrame:
    """Calibrated edges between tracks that the annotation has; ``similarity`` holds track names."""
    known = tracks.select("uri", "track", track_id(modality).alias("id"))
    side = lambda c: known.select("uri", F.col("track").alias(c), F.col("id").alias(c + "_id"))
    rows = ca.apply(similarity.where("row <> col AND value IS NOT NULL").withColumn("score", F.col("value")), model)
    rows = rows.join(side("row"), ["uri", "row"]).join(side("col"), ["uri", "col"])
    return edge(rows.select("uri", F.col("row_id").alias("src"), F.col("col_id").alias("dst"), F.col("posterior").alias("probability")))


def identification_edges(scores: DataFrame, tracks: DataFrame, model: ScoreRatio, n: int | None = None, modality: str = "speaker") -> DataFrame:
    """Calibrated edges from tracks that the annotation has to identities, all or the n likeliest."""
    rows = scores.join(tracks.select("uri", "start", "end", "track").distinct(), ["uri", "start", "end", "track"], "left_semi")
    edges = from_scores(ca.apply(rows, model).withColumn("score", F.col("posterior")).drop("llr", "posterior"), modality)
    return prune_identities(edges, n) if n else edges


def crop(edges: DataFrame, vertices: DataFrame, focus: DataFrame) -> DataFrame:
    """Edges whose tracks intersect the focus; identities left without edges go with them."""
    keep = tl.crop(vertices.select("uri", "start", "end", "id"), focus, "loose").select("uri", "id").distinct()
    gone = vertices.select("uri", "id").distinct().join(keep, ["uri", "id"], "left_anti")
    for end in ("src", "dst"):
        edges = edges.join(gone.select("uri", F.col("id").alias(end)), ["uri", end], "left_anti")
    return edges.select(*EDGE)


def mine(edges: DataFrame, alpha: float = 0.5, nodes: int = 5_000) -> DataFrame:
    """(uri, item, cluster, identity, gap, broken): best partition of every component by weights p -
    alpha. Probabilities 1 and 0 are constraints: what they join or part stays so, and pairs that are
    joined by some and parted by others are counted in ``broken``. Clusters with several identities
    stay anonymous; ``gap`` is 0 where the partition is proven best."""
    p = F.col("probability")
    hard = F.when(p == 1, 1).when(p == 0, -1).otherwise(0)
    weights = edges.select("uri", F.col("src").alias("row"), F.col("dst").alias("col"), F.when(hard == 0, p - alpha).otherwise(0.0).alias("value"), hard.alias("hard"))
    found = cl.correlation(weights, nodes)
    # named by a window: a join of the partition with its own names would solve everything twice
    own, name = W.partitionBy("uri", "cluster"), F.when(F.col("item").startswith("identity|"), F.col("item"))
    named = found.withColumns({"lo": F.min(name).over(own), "hi": F.max(name).over(own)})
    return named.select("uri", "item", "cluster", F.when(F.col("lo") == F.col("hi"), F.substring_index("lo", "|", -1)).alias("identity"), "gap", "broken")


def mine_chunks(edges: DataFrame, vertices: DataFrame, size: int, overlap: int, alpha: float = 0.5) -> DataFrame:
    """Solve overlapping runs of ``size`` tracks in time order and vote: most votes, then nearest to
    a chunk's middle, then name."""
    step = max(1, size - overlap)
    n = F.row_number().over(W.partitionBy("uri").orderBy("start", "end", "id")) - 1
    placed = vertices.where("kind = 'track'").select("uri", "id", n.alias("n"))
    first = F.greatest(F.lit(0), F.ceil((F.col("n") - size + 1) / step)).cast("int")
    spread = placed.select("uri", "id", "n", F.explode(F.sequence(first, F.floor(F.col("n") / step).cast("int"))).alias("chunk"))
    to = lambda c: spread.select("uri", F.col("id").alias(c), F.col("chunk").alias(c + "_k"))
    inner = edges.join(to("src"), ["uri", "src"], "left").join(to("dst"), ["uri", "dst"], "left")
    inner = inner.withColumn("chunk", F.coalesce("src_k", "dst_k")).where("chunk IS NOT NULL AND (src_k IS NULL OR dst_k IS NULL OR src_k = dst_k)")
    keyed = inner.select(F.concat_ws("\u0001", "uri", "chunk").alias("uri"), "src", "dst", "probability")
    votes = mine(keyed, alpha).where("identity IS NOT NULL AND item LIKE 'track|%'").select(F.substring_index("uri", "\u0001", 1).alias("uri"), F.substring_index("uri", "\u0001", -1).cast("int").alias("chunk"), F.col("item").alias("id"), "identity")
    rows = votes.join(spread, ["uri", "id", "chunk"]).groupBy("uri", "id", "identity").agg(F.count(F.lit(1)).alias("votes"), F.min(F.abs(F.col("n") - F.col("chunk") * step - size / 2)).alias("off"))
    best = F.row_number().over(W.partitionBy("uri", "id").orderBy(F.desc("votes"), "off", "identity"))
    return rows.withColumn("_b", best).where("_b = 1").select("uri", "id", "identity")
