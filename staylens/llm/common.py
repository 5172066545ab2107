"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.session import cut, delete, folder  # noqa: F401

#: Whether shuffle files go at the end of the query that wrote them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def col(name: str) -> Column:
    """A column by its literal name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def pick(df: DataFrame, **names: str) -> DataFrame:
    """Only the named columns, under the operator's own names, so that other columns can't clash."""
    missing = [n for n in names.values() if n not in df.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)} in {df.columns}")
    return df.select(*[col(source).alias(target) for target, source in names.items()])


def usable(c: Column) -> Column:
    """A number as double, null where it is NaN."""
    c = c.cast("double")
    return F.when(~F.isnan(c), c)


class Kept:
    """Tables of the rounds of one job, written to the shared checkpoint folder.

    What the writing of a table shuffled goes with the end of it, and drop() deletes tables that
    are no longer needed, so that disk use doesn't grow with the rounds. What is left stays for the
    caller until the program ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.at, self.n = spark, f"{folder(spark)}/staylens-{uuid.uuid4().hex}", 0
        atexit.register(self._close)

    def keep(self, df: DataFrame) -> DataFrame:
        path, before = f"{self.at}/{self.n}", self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        self.n += 1
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *numbers: int) -> None:
        """Delete the tables of these rounds."""
        for number in numbers:
            delete(self.spark, f"{self.at}/{number}")

    def _close(self) -> None:
        with contextlib.suppress(Exception):  # the session may have ended
            delete(self.spark, self.at)


def partitions(spark: SparkSession) -> int:
    """Partitions of a shuffle in this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def latest(df: DataFrame, keys: list[str], time: str) -> DataFrame:
    """One row per key: the one with the greatest time; of equal times the greatest of the other columns.

    It is one aggregation with partial results before the shuffle, so a key with very many rows
    costs no more than its distinct share per input partition. A null time counts as the earliest;
    null keys form a key of their own.
    """
    rest = [time, *[c for c in df.columns if c not in keys and c != time]]
    best = F.max(F.struct(*[col(c) for c in rest])).alias("_best")
    return df.groupBy(*[col(k) for k in keys]).agg(best).select(*[col(k) for k in keys], *[F.col("_best").getField(c).alias(c) for c in rest])


def sample(df: DataFrame, by: list[str], n: int, total: int) -> DataFrame:
    """The n rows of `total` whose columns `by` hash lowest, all if there are fewer; `hash` is added.

    Rows whose hash can't be among the lowest n are left out first, with a margin of four standard
    deviations, so that what reaches the driver is about n rows however many partitions there are.
    """
    share = min(1.0, (n + 4 * n**0.5 + 16) / max(1, total))
    bound = min(2**63 - 1, int(-(2**63) + share * 2**64))
    rows = df.withColumn("hash", F.xxhash64(*[col(c) for c in by]))
    return rows.filter(F.col("hash") <= bound).orderBy("hash", *by).limit(n)
