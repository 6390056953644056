"""Session helpers."""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[tuple[str, str]] = set()


def checkpoint_dir(spark: SparkSession) -> None:
    """Set the checkpoint folder, if none is: ``spark.checkpoint.dir``, which executors share, or a
    temporary one where driver and executors are one process."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = context.getConf().get("spark.checkpoint.dir", None)
    if shared is None and not re.fullmatch(r"local(\[[^]]*\])?", context.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(shared or tempfile.mkdtemp())


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once an application, so that their Python finds it."""
    root = os.path.dirname(os.path.abspath(__file__))
    files = sorted(os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.endswith(".py"))
    digest = hashlib.sha1()
    for f in files:
        with open(f, "rb") as src:
            digest.update(f.encode() + b"\0" + src.read())
    tag = digest.hexdigest()[:16]
    key = (spark.sparkContext.applicationId, tag)
    if key in _shipped:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="spanloom-"), f"spanloom-{tag}.zip")
    with zipfile.ZipFile(path, "w") as out:
        for f in files:
            out.write(f, os.path.join("spanloom", os.path.relpath(f, root)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(key)
