"""Sessions with the settings that the jobs expect."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def builder(name: str = "verdict_lake") -> SparkSession.Builder:
    """A builder with the settings; master, memory and shuffle partitions are the cluster's own."""
    return SparkSession.builder.appName(name).config(map=SETTINGS)


def workers_find_package(spark: SparkSession) -> None:
    """Let Python workers import this package where it runs from a checkout instead of an installation."""
    root = str(Path(__file__).resolve().parents[1])
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        environment["PYTHONPATH"] = ":".join([*paths, root])


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it a query's shuffle files are removed when it is done, not when the driver next collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def scratch_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share. Where that is unset a session of one machine gets
    a temporary folder; on a cluster that would lose rows, so it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"
