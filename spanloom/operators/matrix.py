"""Label matrices in long form: (uri, row, col, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanloom.operators import timeline as tl


def values(m: DataFrame) -> DataFrame:
    return m.where(F.col("value").isNotNull() & ~F.isnan("value"))


def shape(m: DataFrame) -> DataFrame:
    return m.groupBy("uri").agg(F.count_distinct("row").alias("rows"), F.count_distinct("col").alias("cols"))


def argmax(m: DataFrame, axis: int | None = None, smallest: bool = False) -> DataFrame:
    """Best row of every column (axis 0), best column of every row (1), or best cell; ties go to
    the first labels."""
    part = {0: ("uri", "col"), 1: ("uri", "row"), None: ("uri",)}[axis]
    by = F.asc("value") if smallest else F.desc("value")
    n = F.row_number().over(W.partitionBy(*part).orderBy(by, "row", "col"))
    return values(m).withColumn("_n", n).where("_n = 1").drop("_n")


def argmin(m: DataFrame, axis: int | None = None) -> DataFrame:
    return argmax(m, axis, smallest=True)


def negative(m: DataFrame) -> DataFrame:
    return m.withColumn("value", -F.col("value"))


def transpose(m: DataFrame) -> DataFrame:
    return m.select("uri", F.col("col").alias("row"), F.col("row").alias("col"), "value")


def subset(m: DataFrame, rows: list[str] | None = None, cols: list[str] | None = None) -> DataFrame:
    if rows is not None:
        m = m.where(F.col("row").isin(rows))
    return m if cols is None else m.where(F.col("col").isin(cols))


def without(m: DataFrame, row: str | None = None, col: str | None = None) -> DataFrame:
    if row is not None:
        m = m.where(F.col("row") != row)
    return m if col is None else m.where(F.col("col") != col)


def above(m: DataFrame, value: float) -> DataFrame:
    return m.select("uri", "row", "col", (F.col("value") > value).alias("value"))


def to_wide(m: DataFrame, cols: list[str]) -> DataFrame:
    return m.groupBy("uri", "row").pivot("col", cols).agg(F.first("value"))


def cooccurrence(rows: DataFrame, cols: DataFrame, bins: float | None = None) -> DataFrame:
    """Seconds that each pair of labels shares; label pairs of a uri that never meet have 0."""
    r, c = tl.islands(rows, ("uri", "label")), tl.islands(cols, ("uri", "label"))
    common = F.least("a_end", "b_end") - F.greatest("a_start", "b_start")
    met = tl.overlap_join(r, c, bins=bins).groupBy("uri", F.col("a_label").alias("row"), F.col("b_label").alias("col")).agg(F.sum(common).alias("value"))
    names_r, names_c = r.select("uri", F.col("label").alias("row")).distinct(), c.select("uri", F.col("label").alias("col")).distinct()
    grid = names_r.join(names_c, "uri")
    return grid.join(met, ["uri", "row", "col"], "left").select("uri", "row", "col", F.coalesce("value", F.lit(0.0)).alias("value"))


def tfidf(words: DataFrame, documents: DataFrame, idf: bool = True, log: bool = False) -> DataFrame:
    """Term frequency (share of a document's time) times inverse document frequency."""
    k = cooccurrence(words, documents)
    tf = F.col("value") / F.greatest(F.lit(1e-6), F.sum("value").over(W.partitionBy("uri", "col")))
    if not idf:
        return k.select("uri", "row", "col", tf.alias("value"))
    docs = F.size(F.collect_set("col").over(W.partitionBy("uri")))
    hits = F.sum(F.when(F.col("value") > 0, 1).otherwise(0)).over(W.partitionBy("uri", "row"))
    inverse = docs / F.greatest(F.lit(1), hits)
    return k.select("uri", "row", "col", (tf * (F.log(inverse) if log else inverse)).alias("value"))
