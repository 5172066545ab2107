"""One ranking from several differently-scaled scores: reciprocal rank fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm.common import partitions, pick, usable
from staylens.llm.positions import positions


def fuse(df: DataFrame, group: str, item: str, scores: list[str], k: int = 60) -> DataFrame:
    """Rank the items of each group per score, add 1 / (k + rank) up and rank by the sum.

    Result: (group, item, rank_0 .. rank_m, fused, position), rank_i belonging to scores[i].
    Equal scores share the best of their ranks; equal sums are put in the order of the item. A
    null or NaN score gives no rank and adds nothing, an item without any score comes last with a
    sum of 0. Of repeated rows of an item the greatest value of each score counts. Null groups
    and items are values like others. Scales and extreme values have no effect, only order has.
    """
    names = {f"s{i}": s for i, s in enumerate(scores)}
    rows = pick(df, g=group, item=item, **names)
    rows = rows.groupBy("g", "item").agg(*[F.max(usable(F.col(n))).alias(n) for n in names])
    pairs = F.array(*[F.struct(F.lit(i).alias("which"), F.col(n).alias("value")) for i, n in enumerate(names)])
    long = rows.select("g", "item", F.explode_outer(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("p")).select("g", "item", "p.which", "p.value")
    ranked = positions(long, ["g", "which"], [F.col("value").desc(), F.col("item").asc_nulls_first()], run=["value"])
    ranks = ranked.groupBy("g", "item").agg(*[F.max(F.when(F.col("which") == i, F.col("rank"))).alias(f"rank_{i}") for i in range(len(scores))])
    total = sum((F.coalesce(F.lit(1.0) / (k + F.col(f"rank_{i}")), F.lit(0.0)) for i in range(len(scores))), F.lit(0.0))
    done = positions(ranks.withColumn("fused", total), ["g"], [F.col("fused").desc(), F.col("item").asc_nulls_first()])
    return done.select(F.col("g").alias(group), F.col("item").alias(item), *[f"rank_{i}" for i in range(len(scores))], "fused", "position")


def _knock_out(codes: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Indexes of at most one row of each run of equal codes: the only one that can be ahead of all others of its run.

    Rows meet in pairs; who isn't ahead goes out, and both do if neither is.
    """
    left = np.arange(len(codes))
    while True:
        c = codes[left]
        first = np.r_[True, c[1:] != c[:-1]] if len(c) else np.zeros(0, bool)
        start = np.maximum.accumulate(np.where(first, np.arange(len(c)), 0))
        even = (np.arange(len(c)) - start) % 2 == 0
        pair = np.flatnonzero(even[:-1] & ~first[1:]) if len(c) else np.zeros(0, int)
        if not len(pair):
            return left
        a, b = ranks[left[pair]], ranks[left[pair + 1]]
        lead = (a < b).sum(1) - (a > b).sum(1)
        out = np.r_[pair[lead <= 0], pair[lead >= 0] + 1]
        left = np.delete(left, out)


def majority_leaders(fused: DataFrame, group: str, item: str, scores: int) -> DataFrame:
    """The item of each group that is ahead of every other one: (group, item), at most one a group.

    Of two items one is ahead if it has the better rank in more scores than the worse, counting
    only scores that both have. Input is what fuse() gives, and its fused order says who meets
    whom: the best of a group is the first candidate, neighbours in that order meet, and who isn't
    ahead goes out. Whoever leads wins every meeting, so at most one candidate is left in each
    partition that a group lies in, in sorted order and reading each once; these meet again by
    group. The last one is then compared with all items of the group: linear, never all pairs. A
    group of one item has that item as its leader.
    """
    cols = [f"rank_{i}" for i in range(scores)]
    rows = pick(fused, g=group, item=item, position="position", **{c: c for c in cols})

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # who is left of the group that the batch before ended in
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            keys = batch.column("g").dictionary_encode()
            codes = keys.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            ranks = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in cols])
            order = np.lexsort((batch.column("position").to_numpy(), codes))
            left = order[_knock_out(codes[order], ranks[order])]
            going_on = codes[left] == codes[-1]
            yield batch.take(pa.array(left[~going_on]))
            held = batch.take(pa.array(left[going_on]))
        if held is not None:
            yield held

    some = rows.mapInArrow(meet, rows.schema)
    # What is left is one row for each group and partition.
    some = some.repartition(partitions(fused.sparkSession), "g").sortWithinPartitions("g", "position").mapInArrow(meet, rows.schema)
    best = some.select(F.col("g").alias("bg"), F.col("item").alias("best"), *[F.col(c).alias(f"b_{c}") for c in cols])
    lead = sum((F.coalesce(F.signum(F.col(c) - F.col(f"b_{c}")), F.lit(0.0)) for c in cols), F.lit(0.0))
    ahead = F.max(F.when(~F.col("item").eqNullSafe(F.col("best")) & (lead <= 0), 1).otherwise(0))
    done = rows.join(best, F.col("g").eqNullSafe(F.col("bg"))).groupBy("g", "best").agg(ahead.alias("beaten")).filter("beaten = 0")
    return done.select(F.col("g").alias(group), F.col("best").alias(item))
