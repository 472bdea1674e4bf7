"""Session settings the operators rely on."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

# Settings that change results or the resilience of a plan. Sizing settings
# (memory, executors, shuffle partitions) belong to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(master: str | None = None, app: str = "proseloom", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The reliable checkpoint folder of the cluster.

    ``spark.checkpoint.dir`` names the shared folder. It is set here only when
    the session has none, which is the case in local tests.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="proseloom-checkpoint-")
    context.setCheckpointDir(configured)
    return configured


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of all executors, once per application."""
    context = spark.sparkContext
    if getattr(context, "_proseloom_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="proseloom-"), "proseloom.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as target:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    target.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)
    context._proseloom_shipped = True


def with_package(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The query, with the package sent to the workers before it runs."""

    @wraps(query)
    def run(spark: SparkSession, *rest) -> DataFrame:
        ship_package(spark)
        return query(spark, *rest)

    return run
