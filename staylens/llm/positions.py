"""Exact positions within groups from one global range-partitioned sort.

The rows are range-partitioned and sorted by group and order, so a large group spreads over as many
partitions as its size asks for. Each partition numbers its own part of every group while reading
it once. Only a partition's first group can have begun earlier, so two summary rows a partition
are enough to turn the local numbers into exact ones; the driver sums these over the partitions.
What it holds grows with the number of partitions, not with the rows or the groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staylens.llm.common import col, cut, partitions


def _differs(now: pa.Array, before: pa.Array) -> np.ndarray:
    other = pc.fill_null(pc.not_equal(now, before), False)
    return pc.or_(other, pc.xor(pc.is_null(now), pc.is_null(before))).to_numpy(zero_copy_only=False)


def _starts(batch: pa.RecordBatch, names: list[str], last: pa.RecordBatch | None) -> np.ndarray:
    """True where a row's values of the named columns aren't those of the row before."""
    out = np.zeros(batch.num_rows, dtype=bool)
    for name in names:
        column = batch.column(name)
        if batch.num_rows > 1:
            out[1:] |= _differs(column[1:], column[:-1])
        out[0] |= last is None or bool(_differs(column[:1], last.column(name))[0])
    return out


def positions(df: DataFrame, group: list[str], order: list[Column], run: list[str] = (), keep: int | None = None) -> DataFrame:
    """Number the rows of each group in the given order, from 1, as `position`.

    `rank` is the position of the first row with the same values in the columns `run`, which must
    be the leading columns of the order (without `run`, rank equals position). With `keep`, only
    positions up to it remain; what a partition can already tell to lie beyond is dropped before
    anything is written. Rows with null keys form a group of their own; an empty table gives an
    empty result. The order must be total for the numbering to be repeatable. Columns of the
    input may not begin with two underscores or be called position or rank.
    """
    group, run = list(group), [*group, *run]
    keys = [*[col(g).asc_nulls_first() for g in group], *order]
    ranged = df.repartitionByRange(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys)
    extra = [T.StructField("__kind", T.ByteType()), T.StructField("__pid", T.IntegerType()), T.StructField("__at", T.LongType()), T.StructField("__from", T.LongType()), T.StructField("__head", T.BooleanType()), T.StructField("__head_run", T.BooleanType())]
    schema = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in df.schema], *extra])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        last, first = None, None
        seen = at = start = 0  # groups begun; rows of the last group so far; where its last run began
        runs = head_rows = 0

        def out(batch: pa.RecordBatch, kind: int, at, start, head, head_run) -> pa.RecordBatch:
            n = batch.num_rows
            more = [pa.array(np.full(n, kind, np.int8)), pa.array(np.full(n, pid, np.int32)), pa.array(at, pa.int64()), pa.array(start, pa.int64()), pa.array(head, pa.bool_()), pa.array(head_run, pa.bool_())]
            return pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *[f.name for f in extra]])

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            begins, begins_run = _starts(batch, group, last), _starts(batch, run, last)
            i = np.arange(n)
            which = np.maximum.accumulate(np.where(begins, i, -1))
            local = np.where(which >= 0, i - which + 1, i + 1 + at)
            from_ = np.maximum.accumulate(np.where(begins_run, i, -1))
            began = np.where(from_ >= 0, local[np.maximum(from_, 0)], start)
            number_of_group, number_of_run = seen + np.cumsum(begins), runs + np.cumsum(begins_run)
            head, head_run = number_of_group <= 1, number_of_run <= 1
            head_rows += int(head.sum())
            first = batch.slice(0, 1) if first is None else first
            last, seen, runs, at, start = batch.slice(n - 1, 1), int(number_of_group[-1]), int(number_of_run[-1]), int(local[-1]), int(began[-1])
            result = out(batch, 0, local, began, head, head_run)
            yield result if keep is None else result.filter(pa.array(local <= keep))
        if last is not None:
            yield out(first, 1, [head_rows], [1], [True], [True])
            yield out(last, 2, [at], [start], [seen <= 1], [runs <= 1])

    numbered = cut(ranged.mapInArrow(number, schema))
    key = F.struct(*[col(g) for g in group]).alias("g")
    value = F.struct(*[col(r) for r in run]).alias("r")
    ends = numbered.filter("__kind > 0").select("__kind", "__pid", "__at", "__from", "__head", "__head_run", key, value).orderBy("__pid", "__kind").collect()
    offsets, before = [], None
    for first, last in zip(ends[::2], ends[1::2], strict=True):
        # before: key, rows so far and last run of the group that the partition before ended in
        goes_on = before is not None and before["g"] == first["g"]
        shift = before["rows"] if goes_on else 0
        same_run = goes_on and before["r"] == first["r"]
        began = before["from"] if same_run else None
        offsets.append((first["__pid"], shift, began))
        whole, whole_run = last["__head"], last["__head_run"]
        before = {"g": last["g"], "r": last["r"], "rows": last["__at"] + (shift if whole else 0), "from": began if whole_run and same_run else last["__from"] + (shift if whole else 0)}
    shifts = F.broadcast(df.sparkSession.createDataFrame(offsets, "__pid int, __shift long, __began long"))
    at = F.col("__at") + F.when(F.col("__head"), F.col("__shift")).otherwise(0)
    rank = F.when(F.col("__head_run") & F.col("__began").isNotNull(), F.col("__began")).otherwise(F.col("__from") + F.when(F.col("__head"), F.col("__shift")).otherwise(0))
    done = numbered.filter("__kind = 0").join(shifts, "__pid").select(*[col(c) for c in df.columns], at.alias("position"), rank.alias("rank"))
    return done if keep is None else done.filter(F.col("position") <= keep)
