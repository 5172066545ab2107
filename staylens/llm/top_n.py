"""Top N items within every group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm.common import pick, usable
from staylens.llm.positions import positions


def top_n(df: DataFrame, group: str, score: str, tie: str, n: int, tie_number: str | None = None) -> DataFrame:
    """The n rows of each group with the highest score, as (group, tie, score, position).

    Of equal scores the lower tie value comes first; `tie_number` is an SQL expression over the
    column `tie` to compare by before the value itself. Method: global range-partitioned sort on
    group, score and identifier; counts per partition are prefix-summed into exact positions.

    Rows with a null or NaN score are left out. Exactly repeated rows count once each only if the
    caller has removed them: they are items of their own here. A null group is a group, a null
    identifier comes first among equals, a group of fewer than n rows gives them all, n below 1 or
    an empty table gives none.
    """
    rows = pick(df, group=group, tie=tie, score=score).withColumn("score", usable(F.col("score"))).filter("score is not null")
    rows = rows.withColumn("number", F.expr(tie_number) if tie_number else F.lit(0))
    order = [F.col("score").desc(), F.col("number").asc_nulls_first(), F.col("tie").asc_nulls_first()]
    done = positions(rows, ["group"], order, keep=max(n, 0))
    return done.select(F.col("group").alias(group), F.col("tie").alias(tie), F.col("score").alias(score), "position")
