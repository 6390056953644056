"""Label mappings between two annotations: (uri, left, right), either side null if unmatched."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanloom.functions.assignment import assign
from spanloom.operators import annotation as an
from spanloom.operators import matrix as mx
from spanloom.operators.clustering import streamed

PAIRS = "uri string, left string, right string"


def repeated(mapping: DataFrame, side: str = "left") -> DataFrame:
    """Labels that a mapping uses more than once on a side: its violations."""
    known = mapping.where(F.col(side).isNotNull())
    return known.groupBy("uri", side).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def complete(found: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Add labels of both sides that have no partner."""
    left = a.select("uri", F.col("label").alias("left")).distinct().join(found, ["uri", "left"], "left_anti").select("uri", "left", F.lit(None).cast("string").alias("right"))
    right = b.select("uri", F.col("label").alias("right")).distinct().join(found, ["uri", "right"], "left_anti").select("uri", F.lit(None).cast("string").alias("left"), "right")
    return found.select("uri", "left", "right").unionByName(left).unionByName(right)


def argmax_mapper(a: DataFrame, b: DataFrame) -> DataFrame:
    """Each left label goes to the right one it shares most time with."""
    return mx.argmax(mx.cooccurrence(a, b), 1).where("value > 0").select("uri", F.col("row").alias("left"), F.col("col").alias("right"))


def conservative_mapper(a: DataFrame, b: DataFrame) -> DataFrame:
    """Only left labels that meet exactly one right label."""
    met = mx.cooccurrence(a, b).where("value > 0")
    one = met.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("uri", "row"))).where("_n = 1")
    return one.select("uri", F.col("row").alias("left"), F.col("col").alias("right"))


def _solve(t: pa.Table) -> dict[str, list]:
    row, col = t.column("row").to_pylist(), t.column("col").to_pylist()
    rows, cols = sorted(set(row)), sorted(set(col))
    w = np.zeros((len(rows), len(cols)))
    at, to = ({x: n for n, x in enumerate(side)} for side in (rows, cols))
    w[[at[x] for x in row], [to[x] for x in col]] = np.nan_to_num(t.column("value").to_numpy())
    pairs = [(rows[i], cols[j]) for i, j in assign(w) if w[i, j] > 0]
    return {"uri": [t.column("uri")[0].as_py()] * len(pairs), "left": [a for a, _ in pairs], "right": [b for _, b in pairs]}


def assignment_of(weights: DataFrame, keys: tuple[str, ...] = ("uri",)) -> DataFrame:
    """Best one-to-one pairs of each uri's weight matrix; pairs without weight are dropped.

    The groups are label matrices of one uri: labels by labels, not rows of the annotation. They are
    streamed in order of their key.
    """
    rows = weights.withColumn("value", F.col("value").cast("double"))
    return streamed(rows, keys, _solve, ("row", "col", "value"), PAIRS)


def hungarian_mapper(a: DataFrame, b: DataFrame) -> DataFrame:
    return assignment_of(mx.cooccurrence(a, b).where("value > 0"))


def louvain_mapper(a: DataFrame, b: DataFrame, normalize: bool = False, overlap: bool = False) -> DataFrame:
    """(uri, left, right) with arrays of labels: communities of the graph of shared time.

    ``normalize`` divides by the left label's total; ``overlap`` adds the time that labels of one
    side share with each other. Labels that meet nothing are communities of their own.
    """
    from spanloom.operators import clustering as cl

    k = mx.cooccurrence(a, b)
    if normalize:
        k = k.withColumn("value", F.col("value") / F.greatest(F.lit(1e-6), F.sum("value").over(W.partitionBy("uri", "row"))))
    name = lambda side, c: F.concat(F.lit(side + "|"), F.col(c))
    edges = k.select("uri", name("l", "row").alias("row"), name("r", "col").alias("col"), "value")
    if overlap:
        for side, df in (("l", a), ("r", b)):
            own = mx.cooccurrence(df, df).where("row < col")
            edges = edges.unionByName(own.select("uri", name(side, "row").alias("row"), name(side, "col").alias("col"), "value"))
    found = cl.louvain(edges).select("uri", "cluster", F.substring("item", 1, 1).alias("side"), F.substring_index("item", "|", -1).alias("label"))
    pick = lambda s: F.sort_array(F.collect_list(F.when(F.col("side") == s, F.col("label"))))
    return found.groupBy("uri", "cluster").agg(pick("l").alias("left"), pick("r").alias("right")).drop("cluster")


def within_blocks(a: DataFrame, b: DataFrame, init: DataFrame, mapper=hungarian_mapper) -> DataFrame:
    """Map inside the blocks of an initial mapping (uri, block, side, label)."""
    pick = lambda df, side: df.join(init.where(F.col("side") == side).select("uri", "block", "label"), ["uri", "label"]).withColumn("uri", F.concat_ws("\u0001", "uri", "block"))
    found = mapper(pick(a, "left"), pick(b, "right"))
    return found.withColumn("uri", F.substring_index("uri", "\u0001", 1))


def to_dict(mapping: DataFrame, reverse: bool = False) -> DataFrame:
    """One map a uri, labels without partner to null."""
    k, v = ("right", "left") if reverse else ("left", "right")
    rows = mapping.where(F.col(k).isNotNull()).groupBy("uri")
    return rows.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(k, v)))).alias("mapping"))


def partition(mapping: DataFrame) -> DataFrame:
    """Cluster number of each (side, label): labels of one pair share it."""
    n = F.dense_rank().over(W.partitionBy("uri").orderBy(F.coalesce("left", F.lit("")), F.coalesce("right", F.lit(""))))
    rows = mapping.withColumn("cluster", n)
    both = [rows.where(F.col(s).isNotNull()).select("uri", F.lit(s).alias("side"), F.col(s).alias("label"), "cluster") for s in ("left", "right")]
    return both[0].unionByName(both[1]).distinct()


def expected(a: DataFrame, b: DataFrame) -> DataFrame:
    """The same-name mapping of two label sets: a full outer join."""
    left = an.labels(a).select("uri", F.col("label").alias("left"))
    right = an.labels(b).select("uri", F.col("label").alias("right"))
    on = (left["uri"] == right["uri"]) & (left["left"] == right["right"])
    return left.join(right, on, "full_outer").select(F.coalesce(left["uri"], right["uri"]).alias("uri"), "left", "right")


def accuracy(mapping: DataFrame, reference: DataFrame) -> DataFrame:
    """correct, confusion, false_alarm, total of a one-to-one mapping, counted both ways."""

    def one_way(k: str, v: str) -> DataFrame:
        h = mapping.where(F.col(k).isNotNull()).select("uri", F.col(k).alias("k"), F.col(v).alias("h"))
        r = reference.where(F.col(k).isNotNull()).select("uri", F.col(k).alias("k"), F.col(v).alias("r"))
        both = r.join(h, ["uri", "k"], "left")
        same = F.col("h").eqNullSafe(F.col("r"))
        return both.groupBy("uri").agg(
            F.count_if(same).alias("correct"),
            F.count_if(~same & F.col("r").isNotNull()).alias("confusion"),
            F.count_if(F.col("r").isNull() & F.col("h").isNotNull()).alias("false_alarm"),
            F.count(F.lit(1)).alias("total"),
        )

    both = one_way("left", "right").unionByName(one_way("right", "left"))
    sums = both.groupBy("uri").agg(*[F.sum(c).alias(c) for c in ("correct", "confusion", "false_alarm", "total")])
    return sums.withColumn("accuracy", F.when(F.col("total") > 0, F.col("correct") / F.col("total")).otherwise(1.0))


def translated(df: DataFrame, found: DataFrame) -> DataFrame:
    return an.translate(df, found.where("left IS NOT NULL AND right IS NOT NULL"), per_uri=True)


def cluster_agreement(pairs: DataFrame) -> DataFrame:
    """homogeneity, completeness, v_measure and adjusted Rand index of (uri, expected, found).

    The contingency table is counted in Spark; what is grouped for NumPy is one cell a row.
    """
    table = pairs.groupBy("uri", "expected", "found").agg(F.count(F.lit(1)).alias("n"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        t = pdf.pivot(index="expected", columns="found", values="n").fillna(0.0).to_numpy()
        n, a, b = t.sum(), t.sum(axis=1), t.sum(axis=0)
        ent = lambda x: float(-sum(v / n * np.log(v / n) for v in x if v > 0))
        joint = ent(t.ravel())
        h_a, h_b = ent(a), ent(b)
        hom = 1.0 if h_a == 0 else 1 - (joint - h_b) / h_a
        com = 1.0 if h_b == 0 else 1 - (joint - h_a) / h_b
        two = lambda x: float((x * (x - 1) / 2).sum())
        exp = two(a) * two(b) / max(1.0, n * (n - 1) / 2)
        top = (two(a) + two(b)) / 2
        ari = 1.0 if top == exp else (two(t.ravel()) - exp) / (top - exp)
        mi = h_a + h_b - joint
        emi = _expected_mi(a, b, n)
        mean = (h_a + h_b) / 2
        ami = 1.0 if abs(mean - emi) < 1e-15 else (mi - emi) / (mean - emi)
        v = 0.0 if hom + com == 0 else 2 * hom * com / (hom + com)
        return pd.DataFrame([[pdf["uri"].iloc[0], hom, com, v, ari, ami]], columns=["uri", "homogeneity", "completeness", "v_measure", "ari", "ami"])

    return table.groupBy("uri").applyInPandas(solve, "uri string, homogeneity double, completeness double, v_measure double, ari double, ami double")


def _expected_mi(a: np.ndarray, b: np.ndarray, n: float) -> float:
    """Expected mutual information of two random partitions with these class sizes."""
    size = int(n)
    log_fact = np.concatenate([[0.0], np.log(np.arange(1, size + 1)).cumsum()])
    total = 0.0
    for x in a.astype(int):
        for y in b.astype(int):
            k = np.arange(max(1, x + y - size), min(x, y) + 1)
            log_p = log_fact[x] + log_fact[y] + log_fact[size - x] + log_fact[size - y] - log_fact[size] - log_fact[k] - log_fact[x - k] - log_fact[y - k] - log_fact[size - x - y + k]
            total += float((k / n * np.log(n * k / (x * y)) * np.exp(log_p)).sum())
    return total
