"""Fitted models as one-row JSON tables with their date and a description."""

from __future__ import annotations

from datetime import UTC, datetime

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from spanloom.functions.stats import Mixture, ScoreRatio

RATIO = "created string, description string, x array<double>, llr array<double>, prior double"
MIXTURES = "created string, description string, label string, weight array<double>, mean array<double>, var array<double>"


def _now() -> str:
    return datetime.now(UTC).isoformat(timespec="seconds")


def save_ratio(spark: SparkSession, model: ScoreRatio, path: str, description: str = "") -> None:
    row = (_now(), description, [float(v) for v in model.x], [float(v) for v in model.llr], float(model.prior))
    spark.createDataFrame([row], RATIO).coalesce(1).write.mode("errorifexists").json(path)


def load_ratio(spark: SparkSession, path: str) -> ScoreRatio:
    r = spark.read.schema(RATIO).json(path).first()
    return ScoreRatio(np.array(r["x"]), np.array(r["llr"]), r["prior"])


def save_mixtures(spark: SparkSession, models: dict[str, Mixture], path: str, description: str = "") -> None:
    rows = [(_now(), description, k, g.weight.tolist(), g.mean.ravel().tolist(), g.var.ravel().tolist()) for k, g in models.items()]
    spark.createDataFrame(rows, MIXTURES).coalesce(1).write.mode("errorifexists").json(path)


def load_mixtures(spark: SparkSession, path: str) -> dict[str, Mixture]:
    shape = lambda v, w: np.array(v).reshape(len(w), -1)
    return {r["label"]: Mixture(np.array(r["weight"]), shape(r["mean"], r["weight"]), shape(r["var"], r["weight"])) for r in spark.read.schema(MIXTURES).json(path).collect()}


def save_graph(edges: DataFrame, path: str) -> None:
    edges.write.mode("errorifexists").parquet(path)


def load_graph(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
