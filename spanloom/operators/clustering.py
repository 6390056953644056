"""Clustering of long similarity matrices (uri, row, col, value), one uri or component at a time.

What reaches Python for a group is a matrix of labels or tracks of one uri; large groups are cut
into connected components first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanloom.functions import clustering as cl
from spanloom.functions import partition
from spanloom.functions.segment import EPS
from spanloom.operators import matrix as mx
from spanloom.operators import timeline as tl
from spanloom.session import checkpoint_dir

FOUND = "uri string, item string, cluster string"
#: A uri of at most as many pairs is taken as one group; a larger one is cut into its components first.
SMALL = 4_000


def by_key(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Sorted rows -> one table a key; one key is in memory at a time."""
    held: list[pa.RecordBatch] = []
    first = lambda b: [b.column(k)[0].as_py() for k in keys]
    for b in batches:
        if not b.num_rows:
            continue
        cut = np.zeros(b.num_rows - 1, bool)
        for k in keys:
            code = b.column(k).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            cut |= code[1:] != code[:-1]
        bounds = [0, *(np.flatnonzero(cut) + 1).tolist(), b.num_rows]
        for i, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)):
            part = b.slice(lo, hi - lo)
            if held and (i > 0 or first(held[-1]) != first(part)):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def streamed(rows: DataFrame, keys: tuple[str, ...], solve: Callable[[pa.Table], dict[str, list]], names: tuple[str, ...], schema: str) -> DataFrame:
    """``solve`` for each key's rows, dealt by key and streamed in order: few groups are worth a pandas frame."""
    kinds = {"string": pa.string(), "double": pa.float64(), "long": pa.int64()}
    fields = [(n, kinds[k]) for n, k in (f.split() for f in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {n: [] for n, _ in fields}
        for group in by_key(batches, keys):
            for n, values in solve(group).items():
                out[n].extend(values)
            if len(out["uri"]) >= 10_000:
                yield pa.record_batch([pa.array(out[n], k) for n, k in fields], names=[n for n, _ in fields])
                out = {n: [] for n, _ in fields}
        yield pa.record_batch([pa.array(out[n], k) for n, k in fields], names=[n for n, _ in fields])

    columns = list(dict.fromkeys([*keys, "uri", *names]))
    return rows.select(*columns).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _split_by_size(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows of small uris, and of large ones if there are any."""
    large = rows.groupBy("uri").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SMALL).select(F.col("uri").alias("_large")).checkpoint()
    if large.isEmpty():
        return rows, None
    on = F.col("uri").eqNullSafe(F.col("_large"))
    return rows.join(large, on, "left_anti"), rows.join(large, on, "left_semi")


def _roots(n: int, pairs: Iterator[tuple[int, int]]) -> list[int]:
    """Smallest number that pairs reach, for each number."""
    root = list(range(n))
    for i, j in pairs:
        while root[i] != i:
            root[i] = i = root[root[i]]
        while root[j] != j:
            root[j] = j = root[root[j]]
        root[max(i, j)] = min(i, j)
    for i in range(n):
        root[i] = root[root[i]]
    return root


def _square(pdf: pd.DataFrame, missing: float) -> tuple[list[str], np.ndarray]:
    items = sorted(set(pdf["row"]) | set(pdf["col"]))
    at = {x: i for i, x in enumerate(items)}
    w = np.full((len(items), len(items)), np.nan)
    i, j = pdf["row"].map(at).to_numpy(), pdf["col"].map(at).to_numpy()
    w[i, j] = pdf["value"].to_numpy()
    w = np.where(np.isnan(w), w.T, w)
    return items, np.where(np.isnan(w), missing, w)


def _grouped(similarity: DataFrame, solve, missing: float, keys: tuple[str, ...] = ("uri",)) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        items, w = _square(pdf, missing)
        label = solve(w)
        return pd.DataFrame({"uri": pdf["uri"].iloc[0], "item": items, "cluster": [items[int(np.flatnonzero(label == c)[0])] for c in label]})

    cols = list(dict.fromkeys([*keys, "uri", "row", "col", "value"]))
    return similarity.select(*cols).groupBy(*keys).applyInPandas(run, FOUND)


def agglomerative(similarity: DataFrame, linkage: str = "average", threshold: float = 0.0, clusters: int = 1, missing: float = -np.inf) -> DataFrame:
    return _grouped(similarity, lambda w: cl.replay(len(w), cl.agglomerate(w, linkage, threshold, clusters)), missing)


def history(similarity: DataFrame, linkage: str = "average", threshold: float = -np.inf, missing: float = -np.inf) -> DataFrame:
    """(uri, iteration, merged, similarity): what was merged when."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        items, w = _square(pdf, missing)
        steps = cl.agglomerate(w, linkage, threshold)
        return pd.DataFrame({"uri": pdf["uri"].iloc[0], "iteration": range(len(steps)), "merged": [[items[i] for i in m] for m, _ in steps], "similarity": [s for _, s in steps]})

    return similarity.groupBy("uri").applyInPandas(run, "uri string, iteration long, merged array<string>, similarity double")


def constrained(similarity: DataFrame, forbidden: DataFrame, linkage: str = "average", threshold: float = 0.0) -> DataFrame:
    """As agglomerative, but pairs in ``forbidden`` (uri, row, col) never share a cluster."""
    marked = similarity.join(forbidden.select("uri", "row", "col", F.lit(True).alias("_no")), ["uri", "row", "col"], "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        items, w = _square(pdf, -np.inf)
        no = _square(pdf.assign(value=pdf["_no"].fillna(False).astype(float)), 0.0)[1] > 0
        label = cl.replay(len(w), cl.agglomerate(w, linkage, threshold, allowed=lambda a, b: not no[np.ix_(a, b)].any()))
        return pd.DataFrame({"uri": pdf["uri"].iloc[0], "item": items, "cluster": [items[c] for c in label]})

    return marked.groupBy("uri").applyInPandas(run, FOUND)


def apart(a: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """(uri, row, col): labels that run at the same time for more than ``tolerance`` seconds, which no
    cluster may hold together. Both orders are listed."""
    return mx.cooccurrence(a, a).where((F.col("row") != F.col("col")) & (F.col("value") > tolerance)).select("uri", "row", "col")


def not_contiguous(a: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """(uri, row, col): pairs of labels that never come within ``tolerance`` seconds of each other."""
    wide = a.select("uri", "label", (F.col("start") - tolerance / 2 - EPS).alias("start"), (F.col("end") + tolerance / 2 + EPS).alias("end"))
    near = tl.overlap_join(wide, wide).select("uri", F.col("a_label").alias("row"), F.col("b_label").alias("col")).distinct()
    names = a.select("uri", F.col("label").alias("row")).distinct()
    every = names.join(names.withColumnRenamed("row", "col"), "uri").where("row <> col")
    return every.join(near, ["uri", "row", "col"], "left_anti")


def bic(features: DataFrame, penalty: float = 3.5, diagonal: bool = True) -> DataFrame:
    """Cluster the labels of (uri, label, vec) rows by their Gaussians."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(pdf["label"].unique())
        sets = [np.stack(pdf.loc[pdf["label"] == x, "vec"].to_numpy()).astype(float) for x in names]
        label = cl.bic_clustering(sets, penalty, diagonal)
        return pd.DataFrame({"uri": pdf["uri"].iloc[0], "item": names, "cluster": [names[c] for c in label]})

    return features.select("uri", "label", "vec").groupBy("uri").applyInPandas(run, FOUND)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(uri, item, component) of (uri, row, col): the smallest item that links reach.

    Links of a small uri are streamed together. In larger ones labels move along edges and jump to
    their label's label, so rounds grow with the logarithm of the longest path; lineage is cut by
    checkpoints each round.
    """
    checkpoint_dir(edges.sparkSession)
    small, large = _split_by_size(edges.select("uri", "row", "col").checkpoint())

    def solve(t: pa.Table) -> dict[str, list]:
        row, col = t.column("row").to_pylist(), t.column("col").to_pylist()
        items = sorted({*row, *col})
        at = {x: i for i, x in enumerate(items)}
        root = _roots(len(items), ((at[a], at[b]) for a, b in zip(row, col, strict=True)))
        return {"uri": [t.column("uri")[0].as_py()] * len(items), "item": items, "component": [items[r] for r in root]}

    found = streamed(small, ("uri",), solve, ("row", "col"), "uri string, item string, component string")
    return found if large is None else found.unionByName(_spread_components(large, rounds))


def _spread_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    both = edges.select("uri", F.col("row").alias("a"), F.col("col").alias("b"))
    both = both.unionByName(both.select("uri", F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    now = both.groupBy("uri", "a").agg(F.least(F.min("b"), F.first("a")).alias("c")).checkpoint()
    for _ in range(rounds):
        near = both.join(now.select("uri", F.col("a").alias("b"), "c"), ["uri", "b"]).groupBy("uri", "a").agg(F.min("c").alias("n"))
        low = now.join(near, ["uri", "a"]).select("uri", "a", "c", F.least("c", "n").alias("m"))
        jump = now.select("uri", F.col("a").alias("m"), F.col("c").alias("j"))
        new = low.join(jump, ["uri", "m"], "left").select("uri", "a", F.least("m", F.coalesce("j", "m")).alias("c"), (F.least("m", F.coalesce("j", "m")) != F.col("c")).alias("moved")).checkpoint()
        changed = not new.where("moved").isEmpty()
        now = new.drop("moved")
        if not changed:
            return now.select("uri", F.col("a").alias("item"), F.col("c").alias("component"))
    raise RuntimeError("components did not settle")


def correlation(weights: DataFrame, nodes: int = 5_000, missing: float = 0.0, pull: DataFrame | None = None) -> DataFrame:
    """(uri, item, cluster, gap, broken): best partition of each component of positive weights and must
    links; negative pairs inside a component keep items apart. ``gap`` is how much more a
    partition of the component could be worth at most (0: proven best), after ``nodes`` branches.

    ``weights`` is (uri, row, col, value), with ``hard`` where there are constraints: 1 for pairs that
    must share a cluster, -1 for pairs that must not. ``broken`` counts the pairs of the component that
    must links hold together although they must not share a cluster; all others keep their constraints.
    Pairs without a row weigh ``missing``, and if that is above 0 a uri is one component; ``pull`` (uri,
    item, k) takes the product of both items' k from the weight of every pair.
    """
    if "hard" not in weights.columns:
        weights = weights.withColumn("hard", F.lit(0))
    checkpoint_dir(weights.sparkSession)
    rows = weights.select("uri", "row", "col", F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"), F.coalesce(F.col("hard").cast("int"), F.lit(0)).alias("hard"))
    rows = rows.withColumns({"row_k": F.lit(0.0), "col_k": F.lit(0.0)}) if pull is None else rows
    for name in ("row", "col") if pull is not None else ():
        rows = rows.join(pull.select("uri", F.col("item").alias(name), F.col("k").cast("double").alias(name + "_k")), ["uri", name], "left")
    rows = rows.fillna(0.0, ["row_k", "col_k"])
    small, large = (rows, None) if missing > 0 else _split_by_size(rows.checkpoint())

    def solve(t: pa.Table) -> dict[str, list]:
        row, col = t.column("row").to_pylist(), t.column("col").to_pylist()
        items = sorted({*row, *col})
        at = {x: i for i, x in enumerate(items)}
        i, j = np.array([at[x] for x in row]), np.array([at[x] for x in col])
        value, hard, row_k, col_k = (t.column(c).to_numpy() for c in ("value", "hard", "row_k", "col_k"))
        n, k = len(items), np.zeros(len(items))
        k[i], k[j] = row_k, col_k
        linked = (hard > 0) | ((value > 0) & (hard == 0))
        root = np.zeros(n, int) if missing > 0 else np.array(_roots(n, zip(i[linked].tolist(), j[linked].tolist(), strict=True)))
        out: dict[str, list] = {"uri": [t.column("uri")[0].as_py()] * n, "item": items, "cluster": list(items), "gap": [0.0] * n, "broken": [0] * n}
        place, heads = np.zeros(n, int), np.flatnonzero(np.bincount(root, minlength=n) > 1)
        for head in heads.tolist():
            own = np.flatnonzero(root == head)
            place[own] = np.arange(len(own))
            inner = (root[i] == head) & (root[j] == head)
            a, b, v, h = place[i[inner]], place[j[inner]], value[inner], hard[inner]
            w, must, cannot = np.full((len(own), len(own)), np.nan), *(np.zeros((len(own), len(own)), bool) for _ in range(2))
            w[a[h == 0], b[h == 0]] = v[h == 0]
            w = np.where(np.isnan(w), w.T, w)
            w = np.where(np.isnan(w), missing, w) - np.outer(k[own], k[own])
            must[a[h == 1], b[h == 1]] = True
            cannot[a[h == -1], b[h == -1]] = True
            found = partition.solve(w, must, cannot, nodes=nodes)
            for x, c in zip(own.tolist(), found.label.tolist(), strict=True):
                out["cluster"][x], out["gap"][x], out["broken"][x] = items[own[c]], found.gap, len(found.broken)
        return out

    names, schema = ("row", "col", "value", "hard", "row_k", "col_k"), f"{FOUND}, gap double, broken long"
    found = streamed(small, ("uri",), solve, names, schema)
    if large is None:
        return found
    comp = components(large.where("hard > 0 OR (value > 0 AND hard = 0)"))
    side = lambda name: comp.select(F.col("uri").alias("_u"), F.col("item").alias(name + "_i"), F.col("component").alias(name + "_c"))
    for name in ("row", "col"):
        large = large.join(side(name), F.col("uri").eqNullSafe(F.col("_u")) & (F.col(name) == F.col(name + "_i")), "left").drop("_u", name + "_i").withColumn(name + "_c", F.coalesce(name + "_c", name))
    # pairs of two components only name their items
    inner = F.col("row_c") == F.col("col_c")
    own = large.where(inner).select("uri", F.col("row_c").alias("component"), *names)
    solved = streamed(own, ("uri", "component"), solve, names, schema)
    alone = large.where(~inner).select("uri", F.explode(F.array(F.struct(F.col("row").alias("item"), F.col("row_c").alias("c")), F.struct(F.col("col").alias("item"), F.col("col_c").alias("c")))).alias("x")).where("x.item = x.c").select("uri", F.col("x.item").alias("item"))
    alone = alone.distinct().withColumns({"cluster": F.col("item"), "gap": F.lit(0.0), "broken": F.lit(0).cast("long")})
    return found.unionByName(solved).unionByName(alone.join(solved.select(F.col("uri").alias("_u"), F.col("item").alias("_i")), F.col("uri").eqNullSafe(F.col("_u")) & (F.col("item") == F.col("_i")), "left_anti"))


def worth(weights: DataFrame, clusters: DataFrame) -> DataFrame:
    """(uri, worth): sum of the weights (uri, row, col, value) inside clusters, 0 where none is."""
    side = lambda c: clusters.select("uri", F.col("item").alias(c), F.col("cluster").alias(c + "_c"))
    rows = weights.join(side("row"), ["uri", "row"]).join(side("col"), ["uri", "col"])
    return rows.groupBy("uri").agg(F.sum(F.when(F.col("row_c") == F.col("col_c"), F.col("value")).otherwise(0.0)).alias("worth"))


def centers(probability: DataFrame, alpha: float = 0.5, nodes: int = 2_000) -> DataFrame:
    """(uri, item, center, gap) that minimises the number of centers plus the distances (1 - value) of
    the other items to theirs, where no distance may pass ``alpha``. ``probability`` is (uri, row, col,
    value), either order of a pair once. Each component of short enough distances is solved by itself;
    ``gap`` is how much cheaper it could be at most (0: proven best)."""
    checkpoint_dir(probability.sparkSession)
    rows = probability.select("uri", "row", "col", F.col("value").cast("double").alias("value"))
    small, large = _split_by_size(rows.checkpoint())

    def solve(t: pa.Table) -> dict[str, list]:
        row, col = t.column("row").to_pylist(), t.column("col").to_pylist()
        items = sorted({*row, *col})
        at = {x: i for i, x in enumerate(items)}
        i, j = np.array([at[x] for x in row]), np.array([at[x] for x in col])
        value, n = t.column("value").to_numpy(), len(items)
        near = (1 - value <= alpha) & (i != j)
        i, j, value = i[near], j[near], value[near]
        root = np.array(_roots(n, zip(i.tolist(), j.tolist(), strict=True)))
        out: dict[str, list] = {"uri": [t.column("uri")[0].as_py()] * n, "item": items, "center": list(items), "gap": [0.0] * n}
        place = np.zeros(n, int)
        for head in np.flatnonzero(np.bincount(root, minlength=n) > 1).tolist():
            own = np.flatnonzero(root == head)
            place[own] = np.arange(len(own))
            inner = root[i] == head
            p = np.full((len(own), len(own)), np.nan)
            p[place[i[inner]], place[j[inner]]] = value[inner]
            p = np.where(np.isnan(p), p.T, p)
            found = partition.centers(1.0 - np.where(np.isnan(p), -np.inf, p), nodes=nodes)
            for x, c in zip(own.tolist(), found.center.tolist(), strict=True):
                out["center"][x], out["gap"][x] = items[own[c]], found.gap
        return out

    schema = "uri string, item string, center string, gap double"
    found = streamed(small, ("uri",), solve, ("row", "col", "value"), schema)
    if large is None:
        return found
    near = large.where((1 - F.col("value") <= alpha) & (F.col("row") != F.col("col")))
    comp = components(near).select(F.col("uri").alias("_u"), F.col("item").alias("_i"), "component")
    own = near.join(comp, F.col("uri").eqNullSafe(F.col("_u")) & (F.col("row") == F.col("_i"))).drop("_u", "_i")
    solved = streamed(own, ("uri", "component"), solve, ("row", "col", "value"), schema)
    items = large.select("uri", F.explode(F.array("row", "col")).alias("item")).distinct()
    solved_too = solved.select(F.col("uri").alias("_u"), F.col("item").alias("_i"), "center", "gap")
    rest = items.join(solved_too, F.col("uri").eqNullSafe(F.col("_u")) & (F.col("item") == F.col("_i")), "left")
    return found.unionByName(rest.select("uri", "item", F.coalesce("center", "item").alias("center"), F.coalesce("gap", F.lit(0.0)).alias("gap")))


def louvain(edges: DataFrame, level: int = -1) -> DataFrame:
    return _grouped(edges, lambda w: cl.louvain(w)[level], 0.0)


def modularity(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """(uri, modularity) from sums over edges (each undirected edge once, row < col)."""
    c = clusters.select("uri", "item", "cluster")
    rows = edges.join(c.select("uri", F.col("item").alias("row"), F.col("cluster").alias("rc")), ["uri", "row"]).join(c.select("uri", F.col("item").alias("col"), F.col("cluster").alias("cc")), ["uri", "col"])
    both = rows.select("uri", F.explode(F.array("rc", "cc")).alias("cluster"), "value")
    degree = both.groupBy("uri", "cluster").agg(F.sum("value").alias("k")).withColumn("m2", F.sum("k").over(W.partitionBy("uri")))
    random = degree.groupBy("uri").agg(F.sum(F.pow(F.col("k") / F.col("m2"), 2)).alias("r"))
    inside = rows.groupBy("uri").agg((F.sum(F.when(F.col("rc") == F.col("cc"), F.col("value")).otherwise(0.0)) / F.sum("value")).alias("i"))
    return inside.join(random, "uri").select("uri", (F.col("i") - F.col("r")).alias("modularity"))
