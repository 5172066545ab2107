"""Filling fixed-capacity containers with items: bounded-space online packing."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm.common import cut, pick

#: Partitions whose open containers are merged by one task.
MERGED = 64


class _Windows:
    """Open containers by free space: `most` at a time, a new item goes where it leaves least."""

    def __init__(self, capacity: int, most: int | None, first: int):
        self.capacity, self.most, self.next = capacity, most, first
        self.open: list[tuple[int, int]] = []  # free space, container

    def place(self, size: int) -> int:
        at = bisect_left(self.open, (size, -1))
        if at < len(self.open):
            free, container = self.open.pop(at)
        else:
            if self.most is not None and len(self.open) >= self.most:
                self.open.pop(0)  # the fullest goes out for good
            free, container = self.capacity, self.next
            self.next += 1
        if free > size:
            insort(self.open, (free - size, container))
        return container


def pack(df: DataFrame, id_col: str, size_col: str, capacity: int, windows: int = 64, merged: int = MERGED) -> DataFrame:
    """Put items into containers: (id, piece, start, size, container).

    An item larger than the capacity, and no other, is split: into pieces of a full container each
    and a rest; `piece` counts from 0, `start` is where it begins in the item. Items of size 0
    need no room: one row with a null container. So do null and negative sizes, as size 0. Repeated
    rows and null ids are items of their own. An empty table gives none.

    Each partition packs its rows as they come, with a fixed number of open containers, best fit
    first, closing the fullest when none fits. What stays open at the ends, at most `windows` a
    partition, is packed as items of their own, the largest first, `merged` partitions' a task; what
    is emptiest of it then, at most `windows` again, goes on to the next stage until one task has
    had all that is left. A task has merged * windows rows at most, whatever the number of items.
    Containers are numbered by partition; numbers needn't be consecutive.
    """
    rows = pick(df, id=id_col, size=size_col).withColumn("size", F.greatest(F.coalesce(F.col("size").cast("long"), F.lit(0)), F.lit(0)))
    kind = rows.schema["id"].dataType.simpleString()
    names = ["id", "piece", "start", "size", "container", "left"]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        packer, used = _Windows(capacity, windows, base), {}
        for batch in batches:
            take, out = [], []
            for i, size in enumerate(batch.column("size").to_pylist()):
                for piece in range(max(1, -(-size // capacity))):
                    part = min(capacity, size - piece * capacity)
                    take.append(i)
                    out.append((piece, piece * capacity, part, packer.place(part) if part else None))
            columns = [pa.array(x, pa.int64()) for x in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(take, pa.int64())), *columns, pa.nulls(len(take), pa.int64())], names=names)
        # What is still open, as rows with `left`: the space taken.
        still = [(c, capacity - free) for free, c in packer.open]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(still), batch_type[0]), *[pa.nulls(len(still), pa.int64())] * 3, pa.array([c for c, _ in still], pa.int64()), pa.array([x for _, x in still], pa.int64())], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    batch_type = [to_arrow_type(rows.schema["id"].dataType)]
    placed = cut(rows.mapInArrow(fill, f"id {kind}, piece long, start long, size long, container long, left long"))

    def merge(table: pa.Table) -> pa.Table:
        items = sorted(zip(table.column("container").to_pylist(), table.column("left").to_pylist(), strict=True), key=lambda t: (-t[1], t[0]))
        packer, hosts, host = _Windows(capacity, None, 0), [], []
        for c, size in items:
            at = packer.place(size)
            if at == len(hosts):
                hosts.append(c)
            host.append(hosts[at])
        going_on = {hosts[at]: capacity - free for free, at in packer.open[-windows:]}
        return pa.table({"key": table.column("key"), "was": pa.array([c for c, _ in items], pa.int64()), "host": pa.array(host, pa.int64()), "left": pa.array([going_on.pop(h, None) for h in host], pa.int64())})

    parts = placed.rdd.getNumPartitions()
    rest = placed.filter("left is not null").select(F.shiftright("container", 33).alias("key"), "container", "left")
    done = placed.filter("left is null").select("id", "piece", "start", "size", "container")
    while True:
        parts = -(-parts // merged)
        moved = cut(rest.withColumn("key", F.floor(F.col("key") / merged)).groupBy("key").applyInArrow(merge, "key long, was long, host long, left long"))
        done = done.join(moved.select("was", "host"), F.col("container") == F.col("was"), "left").select("id", "piece", "start", "size", F.coalesce("host", "container").alias("container"))
        if parts <= 1:
            break
        rest = moved.filter("left is not null").select("key", F.col("host").alias("container"), "left")
    return done.select(F.col("id").alias(id_col), F.col("piece").cast("int").alias("piece"), "start", "size", "container")
