"""Session settings the jobs rely on."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(master)
        .appName("caselens")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


@functools.cache
def _package_archive() -> str:
    folder = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="caselens-package-"), "caselens.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for base, _, names in sorted(os.walk(folder)):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(base, name)
                archive.write(full, os.path.relpath(full, os.path.dirname(folder)))
    return path


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers, once for each application: their Arrow functions import it,
    and they need not have been started from its folder."""
    context = spark.sparkContext
    if not getattr(context, "_caselens_shipped", False):
        context.addPyFile(_package_archive())
        context._caselens_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder the cluster names; fall back to a scratch one in tests."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="caselens-checkpoint-")
    context.setCheckpointDir(shared)
    return shared


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go with it, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def pinned(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back.

    Used where several branches of a plan read the same intermediate rows: it is computed
    once, a lost executor re-reads files instead of recomputing, and the columnar file
    keeps column pruning and size statistics for the branches.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/caselens-{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
