"""Session defaults."""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "staylens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; the cluster's own settings hold for the rest."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Checkpoints go when nothing refers to them any more.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    return builder.config(map=defaults | conf).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session: they needn't have it installed."""
    sc, root = spark.sparkContext, Path(__file__).parent
    if getattr(sc, "_staylens_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(), "staylens.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, str(Path(root.name) / file.relative_to(root)))
    sc.addPyFile(path)
    sc._staylens_shipped = True


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query that first sees to it that the executors have this package."""

    @functools.wraps(query)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship(spark)
        return query(spark, folder)

    return run


def folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors share: the one in spark.checkpoint.dir.

    Where none is set one is made if there is one machine only, and goes with the program; on a
    cluster that would be another folder on every machine, so it is an error.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        held = sc.getConf().get("spark.checkpoint.dir")
        if not held:
            if not sc.master.split("[")[0] == "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            held = tempfile.mkdtemp(prefix="staylens-")
            atexit.register(shutil.rmtree, held, ignore_errors=True)
        sc.setCheckpointDir(held)
    return sc._jsc.sc().getCheckpointDir().get()


def delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with more columns, each worked out once a row however often later steps use it.

    The optimizer puts a column's expression in wherever its name stands, filters included; it
    doesn't do so across a row generator, here of one row.
    """
    for name, column in columns.items():
        df = df.select(*[c for c in df.columns if c != name], F.explode(F.array(column)).alias(name))
    return df


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where it comes in fewer pieces than there are, as small tables of one row group do; else df."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def cut(df: DataFrame) -> DataFrame:
    """df from its rows in the session's shared checkpoint folder on: later steps neither plan nor run what led to it again."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)
