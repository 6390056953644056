"""Interval views of the star-schema tables: whole-number offsets, so sums are exact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanloom.functions.segment import Seg

DAY = 86_400.0
#: The event types of the tables, in order.
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ann_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as labelled segments; the event id is the track."""
    start = F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts)").cast("double")
    rows = read(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("uri"), start.alias("start"), (start + F.round(F.col("value") * 100) * 6).alias("end"),
        F.col("event_id").cast("string").alias("track"), F.col("event_type").alias("label"),
    )
    return rows.where(Seg.of().filled()).select("uri", "start", "end", "track", "label")


def ann_hyp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference disturbed: rows dropped, bounds shifted, labels replaced."""
    i = F.col("track").cast("long")
    shift = (i % 7) * 600.0
    rows = ann_ref(spark, sf_dir).where(i % 11 != 0)
    return rows.select("uri", (F.col("start") + shift).alias("start"), (F.col("end") + shift).alias("end"), "track", F.when(i % 5 == 0, "view").otherwise(F.col("label")).alias("label"))


def ann_unk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_ref(spark, sf_dir).withColumn("is_unknown", F.col("label") == "error")


def uem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two focus windows for each user."""
    windows = F.array(*[F.struct(F.lit(a * DAY).alias("start"), F.lit(b * DAY).alias("end")) for a, b in ((5, 12), (15, 25))])
    users = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("uri")).distinct()
    return users.select("uri", F.explode(windows).alias("w")).select("uri", "w.start", "w.end")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns laid end to end, a second a character."""
    order = W.partitionBy("conv_id").orderBy("turn")
    rows = read(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", F.length("text").cast("double").alias("n"), F.sum(F.length("text")).over(order).cast("double").alias("end")
    )
    return rows.select(F.col("conv_id").cast("string").alias("uri"), (F.col("end") - F.col("n")).alias("start"), "end", F.col("turn").cast("string").alias("track"), F.col("role").alias("label"))


def turns_hyp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns merged into longer ones: every third joins the one before."""
    t = turns(spark, sf_dir)
    opens = F.when(F.col("track").cast("long") % 3 != 2, 1).otherwise(0)
    group = F.sum(opens).over(W.partitionBy("uri").orderBy("start", "end", "track").rowsBetween(W.unboundedPreceding, 0))
    return t.withColumn("g", group).groupBy("uri", "g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("g")


def orders_iv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as segments of days, from the order to its last shipment."""
    ship = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last"))
    day = lambda c: F.datediff(F.col(c).cast("date"), F.lit("1992-01-01").cast("date")).cast("double")
    rows = read(spark, sf_dir, "orders").join(ship, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_custkey").cast("string").alias("uri"), day("o_orderdate").alias("start"), day("last").alias("end"),
        F.col("o_orderkey").cast("string").alias("track"), F.col("o_orderpriority").alias("label"),
    )
    return rows.where(Seg.of().filled())


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.lit("emb").alias("uri"), F.col("vec_id").alias("frame"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").cast("string").alias("label"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's five scores, one for every event type: whole numbers from its id."""
    types = F.array(*[F.struct(F.lit(t).alias("label"), F.lit(j).alias("j")) for j, t in enumerate(EVENT_TYPES, 1)])
    rows = ann_ref(spark, sf_dir).drop("label").withColumn("t", F.explode(types))
    i, j = F.col("track").cast("long"), F.col("t.j")
    score = ((i * 7919 + j * 104_729 + i * j * 31) % 1000) / 1000.0
    return rows.select("uri", "start", "end", "track", "t.label", score.alias("score"))


def calib(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: length as score, quality as target."""
    d, y = read(spark, sf_dir, "documents").select("doc_id", "n_chars"), read(spark, sf_dir, "labels").select("doc_id", "quality")
    return d.join(y, "doc_id").select(F.col("n_chars").cast("double").alias("score"), F.col("quality").cast("int").alias("target"))
