"""Shared pieces: shared-folder tables, ASCII word rules, two-level row numbering."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: One or more ASCII white-space characters; words are what stands between.
WS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Unset, a temporary folder serves
    where driver and executors are one process; on a cluster that would lose rows, so it is an error."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")


def materialize(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: it cuts lineage, survives lost
    executors, and gives the optimizer real sizes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spanloom/{name}-{uuid.uuid4().hex}"
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


class Scratch:
    """Tables of one run: called like ``materialize``; ``drop`` deletes all but those it is given."""

    def __init__(self) -> None:
        self.made: list[DataFrame] = []

    def __call__(self, df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
        self.made.append(materialize(df, name, codec))
        return self.made[-1]

    def drop(self, *keep: DataFrame) -> None:
        kept = {k._stored_at for k in keep}
        for df in self.made:
            if df._stored_at not in kept:
                delete(df.sparkSession, df._stored_at)
        self.made = [df for df in self.made if df._stored_at in kept]


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    at, fs = _hadoop(spark, path)
    fs.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _hadoop(spark, path)
    return fs.exists(at)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """ASCII-white-space separated words of a text; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WS), "")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a bound variable."""
    return F.transform(F.array(value), body)[0]


def unsigned_crc32(text: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def gapless(df: DataFrame, group: list[str], bucket: Column, order: list[str], out: str) -> DataFrame:
    """Number the rows of each group from 0 without gaps, in the order (bucket, order).

    ``bucket`` must be monotone in the wanted order and small for each task; only one row for
    each (group, bucket) is ever brought together, to add up the counts before it.
    """
    tagged = df.withColumn("_b", bucket)
    counts = tagged.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(*group, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    rank = F.row_number().over(W.partitionBy(*group, "_b").orderBy(*order))
    ranked = tagged.withColumn("_rank", rank)
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*group, "_b"]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return (
        ranked.alias("l")
        .join(starts.alias("r"), cond)
        .select(*[F.col(f"l.{c}") for c in df.columns], (F.col("r._start") + F.col("l._rank") - 1).cast("long").alias(out))
    )


def ranked(df: DataFrame, group: list[str], order: list[str], out: str, store) -> DataFrame:
    """Number the rows of each group from 1 in ``order``, the ranges of large groups apart.

    Rows are dealt by ranges of (group, order) and stored; a row's number is its place in its range
    plus the rows of its group in earlier ranges, so no task holds more of a group than one range.
    ``store`` is ``materialize`` or a ``Scratch``.
    """
    dealt = store(df.repartitionByRange(*group, *order).withColumn("_p", F.spark_partition_id()), f"ranks-{out}")
    before = W.partitionBy(*group).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    counts = dealt.groupBy(*group, "_p").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select(*group, "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")).alias("r")
    placed = dealt.withColumn("_k", F.row_number().over(W.partitionBy(*group, "_p").orderBy(*order))).alias("l")
    same = F.lit(True)
    for c in [*group, "_p"]:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    return placed.join(starts, same).select(*[F.col(f"l.{c}") for c in df.columns], (F.col("r._start") + F.col("l._k")).cast("long").alias(out))
