"""Sinks: tables, run and judgement files, logs with retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A record a line, as many files as partitions."""
    df.write.mode(mode).json(path)


def write_run(lines: DataFrame, path: str) -> None:
    """Run lines in order of query number and rank: sorted over all files, whose names keep the order."""
    lines.orderBy("number", "rank").select("line").write.mode("overwrite").text(path)


def write_qrels(qrels: DataFrame, path: str) -> None:
    """Judgements as query, 0, document and grade, by tabs, in order."""
    line = F.concat_ws("\t", "query", F.lit("0"), "doc", F.col("grade").cast("string"))
    qrels.withColumn("number", F.substring("query", 2, 20).cast("long")).orderBy("number", "doc").select(line.alias("line")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def markdown(df: DataFrame, digits: int = 4) -> str:
    """A small report table as Markdown."""
    number = lambda v: f"{v:.{digits}f}" if isinstance(v, float) else "all" if v is None else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(number(v) for v in row) + " |" for row in df.collect()])


def log_run(df: DataFrame, path: str) -> None:
    """Add a run's trace to a log, under its time."""
    df.withColumn("logged_at", F.current_timestamp()).write.mode("append").parquet(path)


def latest_run(log: DataFrame) -> DataFrame:
    """The rows of the log's last run."""
    last = F.broadcast(log.agg(F.max("logged_at").alias("logged_at")))  # one row
    return log.join(last, "logged_at", "left_semi")


def retained(log: DataFrame, keep: int) -> DataFrame:
    """The rows of the log's last `keep` runs."""
    runs = log.select("logged_at").distinct().orderBy(F.col("logged_at").desc()).limit(keep)
    return log.join(F.broadcast(runs), "logged_at", "left_semi")  # `keep` rows at most


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
