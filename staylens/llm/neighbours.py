"""Most similar vectors for every vector: a neighbour graph by NN-descent, and greedy search in it.

A row of the graph holds a vertex's id, its direction in 8-bit numbers, and its nearest so far.
First rounds put the vertices into blocks by trees of nearest centres, another tree each round, and
join each block with itself. Then come passes of descent: at every vertex meet those that list it
and those it lists, all pairs of which one is new there are compared, and what improves a list
returns to its vertex. Passes go on until few entries of the lists are new. What moves in a pass is
proportional to the vertices; nothing is gathered but a bounded sample that the trees are grown on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm.common import Kept, partitions, pick
from staylens.llm.common import sample as lowest

#: Vectors that a tree is grown on, at most; vectors of a block that are compared with each other at once; of a task's block.
SAMPLE, LEAF, BLOCK = 100_000, 8192, 40_000
#: Neighbours given out; entries of the lists that the descent works on, which must be more for it not to get stuck.
NEIGHBOURS, LISTED = 10, 16
#: Trees; parts of the places to meet that take turns, so that what is under way at once is a part's.
ROUNDS, TURNS = 4, 4
#: Rounds of k-means that the centres of a tree are refined by; binary digits of the centres under a node, at most.
REFINED, FAN = 2, 6
#: The descent ends when the turns of a pass over all places have made less than this share of the entries new.
SETTLED = 0.1
#: Vertices that meet at one place in one task. More are dealt into groups of half of it, every two of which meet in a task of their own.
CROWD = 20_000
#: Similarity from which two directions count as the same one.
SAME = 1 - 1e-6


def _rows(column: pa.Array, kind, width: int) -> np.ndarray:
    """A binary column of equal lengths as a matrix, without a copy."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offset, n = column.offset, len(column)
    starts = np.frombuffer(column.buffers()[1], np.int32, n + 1, offset * 4)
    return np.frombuffer(column.buffers()[2], np.uint8, int(starts[-1] - starts[0]), int(starts[0])).view(kind).reshape(n, width)


def _binary(matrix: np.ndarray) -> pa.Array:
    matrix = np.ascontiguousarray(matrix)
    n, width = len(matrix), matrix.dtype.itemsize * (matrix.shape[1] if matrix.ndim > 1 else 1)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * width), pa.py_buffer(matrix.tobytes())])


def _unit(v: np.ndarray) -> np.ndarray:
    x = v.astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def off_by(size: int) -> float:
    """How many radians, at most, a direction in 8-bit numbers is off.

    Each number is off by half a step, so the vector by sqrt(size) / 2, while its length is at
    least 127 steps: its largest value is 127.
    """
    return float(np.arcsin(min(1.0, size**0.5 / 2 / 127)))


def _best(ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k most similar of each row, each id once; empty places have id -1 and similarity -2."""
    order = np.argsort(ids, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    again = np.zeros(ids.shape, bool)
    again[:, 1:] = ids[:, 1:] == ids[:, :-1]
    sims = np.where(again | (ids < 0), np.float32(-2), sims)
    top = np.argsort(-sims, axis=1, kind="stable")[:, :k]
    ids, sims = np.take_along_axis(ids, top, 1), np.take_along_axis(sims, top, 1)
    return np.where(sims > -2, ids, -1), sims.astype(np.float32)


def _centres(x: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """n directions that x lies around: random ones of it, refined by spherical k-means.

    Few rounds of it, so that trees still differ and what one parts another keeps together. Of
    fewer than n the first is repeated, which leaves its copies without members.
    """
    c = x[rng.choice(len(x), min(n, len(x)), replace=False)]
    for _ in range(REFINED):
        near = np.argmax(x @ c.T, axis=1)
        sums = np.stack([x[near == j].sum(axis=0) for j in range(len(c))])
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 1e-6, sums / np.maximum(norm, 1e-6), c)
    return np.vstack([c, np.repeat(c[:1], n - len(c), axis=0)])


def _grow(x: np.ndarray, leaves: int, rng: np.random.Generator) -> list[np.ndarray]:
    """A tree of nearest centres down to `leaves`, a power of two: for each level the centres under each of its nodes."""
    depth = leaves.bit_length() - 1
    levels = -(-depth // FAN)
    tree, members = [], [np.arange(len(x))]
    for level in range(levels):
        n = 2 ** (depth * (level + 1) // levels - depth * level // levels)
        tree.append(np.stack([_centres(x[own], n, rng) if len(own) else np.zeros((n, x.shape[1]), np.float32) for own in members]).astype(np.float32))
        near = [np.argmax(x[own] @ c.T, axis=1) for own, c in zip(members, tree[-1], strict=True)]
        members = [own[to == j] for own, to in zip(members, near, strict=True) for j in range(n)]
    return tree


def _leaf(x: np.ndarray, *tree: np.ndarray) -> np.ndarray:
    node = np.zeros(len(x), np.int64)
    for centres in tree:
        order, near = np.argsort(node, kind="stable"), np.zeros(len(x), np.int64)
        for own in np.split(order, np.flatnonzero(np.diff(node[order])) + 1):
            if len(own):
                near[own] = np.argmax(x[own] @ centres[node[own[0]]].T, axis=1)
        node = node * centres.shape[1] + near
    return node


def _compare(x: np.ndarray, ids: np.ndarray, nb: np.ndarray, ns: np.ndarray, rng: np.random.Generator) -> None:
    """Compare all of a block that share a leaf of its own tree, and keep the better in nb and ns."""
    todo, k = [np.arange(len(x))], nb.shape[1]
    while todo:
        own = todo.pop()
        if len(own) > 1.5 * LEAF:
            a, b = _centres(x[rng.choice(own, 1024, replace=False)], 2, rng)
            right = x[own] @ (a - b) < 0
            if not 0.1 < right.mean() < 0.9:  # copies of one another: any halves will do
                right = rng.random(len(own)) < 0.5
            todo += [own[~right], own[right]]
            continue
        y, m = x[own], len(own)
        for i in range(0, m if m > 1 else 0, 256):
            part = own[i : i + 256]
            s = x[part] @ y.T
            s[np.arange(len(part)), np.arange(i, i + len(part))] = -2
            bound = ns[part, -1]
            if (groups := 8 * k) < m:  # the k-th best is no less than the k-th of the bests of groups
                most = s[:, : m // groups * groups].reshape(len(part), -1, groups).max(1)
                bound = np.maximum(bound, np.partition(most, -k, axis=1)[:, -k] - np.float32(1e-6))
                alike = np.flatnonzero(np.partition(most, -k, axis=1)[:, -k] > SAME)
                if len(alike):  # among more copies than a list can hold, each takes others, so that none is listed by all
                    s[alike] = np.where(s[alike] > SAME, 1 + rng.random((len(alike), m), np.float32), s[alike])
                    bound[alike] = np.maximum(ns[part[alike], -1], np.partition(s[alike], -k, axis=1)[:, -k] - np.float32(1e-6))
            row, other = np.divmod(np.flatnonzero(s > bound[:, None]), m)
            u, w, best = _first(row, other, s[row, other], k)
            if not len(u):
                continue
            each = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
            better, at = part[u[each]], (np.repeat(np.arange(len(each)), np.diff(np.r_[each, len(u)])), np.arange(len(u)) - np.repeat(each, np.diff(np.r_[each, len(u)])))
            new_ids, new_s = np.full((len(each), k), -1, np.int64), np.full((len(each), k), -2, np.float32)
            new_ids[at], new_s[at] = ids[own[w]], np.minimum(best, 1)
            nb[better], ns[better] = _best(np.hstack([nb[better], new_ids]), np.hstack([ns[better], new_s]), k)


def _kind(narrow: bool):
    """How an id is held in a list: in four bytes where all ids are below 2**32 - 1. No id is all ones."""
    return np.uint32 if narrow else np.int64


def _ids(column: pa.Array, kind, k: int) -> np.ndarray:
    """Lists of ids as whole numbers, -1 where a place is empty."""
    ids = _rows(column, kind, k)
    return ids if kind is np.int64 else np.where(ids == np.uint32(2**32 - 1), np.int64(-1), ids.astype(np.int64))


def _sims(column: pa.Array, k: int) -> np.ndarray:
    """Similarities of a list, held in two bytes each; -2 where a place is empty."""
    held = _rows(column, np.int16, k)
    return np.where(held == -32768, np.float32(-2), held.astype(np.float32) / np.float32(32767))


def _held(sims: np.ndarray) -> np.ndarray:
    return np.where(sims <= -2, -32768, np.rint(np.clip(sims, -1, 1) * 32767)).astype(np.int16)


#: A vertex: its direction, its list with similarities, and of each entry whether it has yet to visit (1) or to be invited (2).
_STATE = "id long, v binary, nb binary, ns binary, new binary"


def neighbour_graph(df: DataFrame, id_col: str, vector_col: str, size: int, k: int = LISTED, rounds: int = ROUNDS, settled: float = SETTLED, seed: int = 1) -> DataFrame:
    """The k nearest by cosine of each vector, approximately: (id, v, nb, ns, new), see neighbour_pairs.

    Ids are whole numbers of 0 or more. Vectors that are null, of another size, all zero or with a
    null, NaN or infinite value have no row and are no one's neighbour, nor have rows without an
    id. Of rows with one id one counts. Equal vectors are neighbours of similarity 1 of each
    other; which k of more than k equals are kept is open. Fewer than k + 1 vectors give shorter
    lists, an empty table an empty result. The length of the vectors has no effect. Similarities
    are those of the 8-bit directions; each direction is off by off_by(size) at most.

    The descent ends when the turns of a pass made less than the share `settled` of the entries
    new; as lists only ever get better, it does end.
    """
    spark = df.sparkSession
    kept = Kept(spark)

    def compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
            most = np.abs(x).max(axis=1)  # NaN where a value is null or NaN
            fine = np.flatnonzero(np.isfinite(most) & (most > 0))
            v = np.rint(x[fine] / most[fine, None] * 127).astype(np.int8)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(fine)), _binary(v)], names=["id", "v"])

    rows = pick(df, id=id_col, vector=vector_col).filter(F.col("id").isNotNull() & (F.size("vector") == size))
    rows = rows.select(F.col("id").cast("long").alias("id"), "vector").mapInArrow(compact, "id long, v binary")
    # Repeated rows of an id go before the lists begin.
    vertices = kept.keep(rows.groupBy("id").agg(F.max("v").alias("v")))
    total, most = vertices.agg(F.count("*"), F.max("id")).first()
    kind = _kind(total == 0 or most < 2**32 - 1)
    empty = [F.lit(bytes(x)) for x in (np.full(k, -1, np.int64).astype(kind), _held(np.full(k, -2.0)), np.full(k, 3, np.uint8))]
    state = vertices.select("id", "v", *[c.alias(n) for c, n in zip(empty, ("nb", "ns", "new"), strict=True)])
    if total < 2:
        return state
    leaves = 2 ** (max(1, min(total // LEAF, SAMPLE // 32)) - 1).bit_length()
    held = lowest(vertices, ["id"], min(SAMPLE, 256 * leaves), total).select("v").toArrow()
    sample = _unit(_rows(held.column("v"), np.int8, size))

    for r in range(rounds):
        tree = _grow(sample, leaves, np.random.default_rng([seed, r]))
        # A leaf that holds more than a task's block is dealt out to several.
        share = np.bincount(_leaf(sample, *tree), minlength=leaves) / len(sample)
        deal = np.maximum(1, np.ceil(share * total / BLOCK)).astype(np.int64)
        shared = spark.sparkContext.broadcast((tree, deal))

        def key(batches: Iterator[pa.RecordBatch], shared=shared, r=r) -> Iterator[pa.RecordBatch]:
            tree, deal = shared.value
            for batch in batches:
                leaf = _leaf(_unit(_rows(batch.column("v"), np.int8, size)), *tree)
                dealt = (_mixed(batch.column("id").to_numpy(), r) >> np.uint64(33)).astype(np.int64) % deal[leaf]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf * 4096 + dealt, pa.int64())], names=[*batch.schema.names, "key"])

        block_seed = [seed, r]

        def join_block(table: pa.Table) -> pa.Table:
            ids, x = table.column("id").to_numpy(), _unit(_rows(table.column("v"), np.int8, size))
            nb, ns = _ids(table.column("nb"), kind, k).copy(), _sims(table.column("ns"), k)
            _compare(x, ids, nb, ns, np.random.default_rng(block_seed))
            return pa.table([table.column("id"), table.column("v"), _binary(nb.astype(kind)), _binary(_held(ns)), table.column("new")], names=["id", "v", "nb", "ns", "new"])

        state = kept.keep(state.mapInArrow(key, _STATE + ", key long").groupBy("key").applyInArrow(join_block, _STATE))
        kept.drop(kept.n - 2)

    shares = [1.0] * TURNS
    while sum(shares[-TURNS:]) >= settled:
        before = kept.n - 1
        state = _descend(kept, state, size, k, kind, seed, len(shares) % TURNS)
        kept.drop(*range(before, kept.n - 1))
        shares.append(state.agg(F.sum("came")).first()[0] / (k * total))
    return state.drop("came")


def _mixed(ids: np.ndarray, seed: int) -> np.ndarray:
    """Ids as numbers in which all bits of the seed count."""
    x = (ids.astype(np.uint64) + np.uint64(seed + 1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def _whole_runs(batches: Iterator[pa.RecordBatch], name: str, crowd: int | None = None) -> Iterator[pa.RecordBatch | tuple[int, int]]:
    """The rows of batches sorted by a column, rows of one value always together.

    Of a value with more than `crowd` rows only (value, rows) comes; no more than that are held.
    """
    held: list[pa.RecordBatch] = []
    over: tuple[int, int] | None = None

    def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(name).to_numpy()
        if over:
            more = int(np.searchsorted(values, over[0], "right"))
            over = (over[0], over[1] + more)
            if more == len(values):
                continue
            yield over
            over, batch, values = None, batch.slice(more), values[more:]
        last = int(np.searchsorted(values, values[-1]))
        if last or not held or held[-1].column(name)[-1].as_py() != values[0]:
            done = [*held, *([batch.slice(0, last)] if last else [])]
            if done:
                yield joined(done)
            held = []
        held.append(batch.slice(last))
        if crowd and (n := sum(b.num_rows for b in held)) > crowd:
            over, held = (int(values[-1]), n), []
    if over:
        yield over
    if held:
        yield joined(held)


def _pairs(x: np.ndarray, worst: np.ndarray, fresh: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, other row, similarity) of all pairs within runs of which one is new and that are nearer than the row's worst."""
    n = len(x)
    width = np.where(sizes <= 64, -(-sizes // 8) * 8, -(-sizes // 64) * 64)
    for w in np.unique(width[(width <= 512) & (sizes > 1)]):
        own = np.flatnonzero((width == w) & (sizes > 1))
        step = max(1, 400_000 // int(w * w))
        for i in range(0, len(own), step):
            some = own[i : i + step]
            rows = starts[some, None] + np.arange(w)
            there = np.arange(w) < sizes[some, None]
            rows = np.where(there, rows, n - 1)
            y = x[rows]
            s = y @ y.transpose(0, 2, 1)
            f = fresh[rows] & there
            fine = s > np.where(there, worst[rows], 9)[:, :, None]
            fine &= (f[:, :, None] | f[:, None, :]) & there[:, None, :]
            fine[:, np.arange(w), np.arange(w)] = False
            g, a, b = np.nonzero(fine)
            yield rows[g, a], rows[g, b], s[g, a, b]
    for r in np.flatnonzero(width > 512):
        own = np.arange(starts[r], starts[r] + sizes[r])
        for i in range(0, len(own), 512):
            part = own[i : i + 512]
            s = x[part] @ x[own].T
            s[np.arange(len(part)), np.arange(i, i + len(part))] = -2
            a, b = np.nonzero((s > worst[part, None]) & (fresh[part, None] | fresh[own]) & (s > -2))
            yield part[a], own[b], s[a, b]


def _descend(kept: Kept, state: DataFrame, size: int, k: int, kind, seed: int, turn: int, turns: int = TURNS, crowd: int = CROWD) -> DataFrame:
    """One turn: at every vertex of this turn's part meet those that list it and those it lists, and better ones return to their lists."""
    spark, entry = state.sparkSession, np.dtype([("w", kind), ("s", np.int16)])
    # What a vertex takes along: its direction and the worst similarity it has.
    member = F.concat("v", F.substring("ns", 2 * k - 1, 2))

    def of_turn(ids: np.ndarray) -> np.ndarray:
        return (ids >= 0) & (_mixed(ids, seed) % np.uint64(turns) == turn)

    def places(ids: np.ndarray, groups: dict[int, int] | None) -> np.ndarray:
        return of_turn(ids) if groups is None else np.isin(ids, np.fromiter(groups, np.int64, len(groups)))

    def cells(who: np.ndarray, place: np.ndarray, groups: dict[int, int] | None) -> tuple[np.ndarray, np.ndarray]:
        """(index, cell): a place is one cell; a crowded one has a cell for every two of its groups."""
        if groups is None:
            return np.arange(len(who)), place
        count = np.array([groups[int(p)] for p in place], np.int64)
        own = (_mixed(who, seed) % count.astype(np.uint64)).astype(np.int64)
        at = np.repeat(np.arange(len(who)), count)
        other = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        low, high = np.minimum(own[at], other), np.maximum(own[at], other)
        return at, (_mixed(place[at], seed) ^ _mixed(low * count[at] + high, 77)).view(np.int64)

    def visit(groups: dict[int, int] | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, nb, worst, new = batch.column("id").to_numpy(), _ids(batch.column("nb"), kind, k), _sims(batch.column("ns"), k)[:, -1:], _rows(batch.column("new"), np.uint8, k)
                # Who has k equals looks for no one; others meet it through the list of the one they list.
                who, which = np.nonzero(places(nb, groups) & (worst < SAME))
                at, cell = cells(ids[who], nb[who, which], groups)
                who, which = who[at], which[at]
                yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column("id").take(pa.array(who)), batch.column("member").take(pa.array(who)), pa.array(new[who, which] & 1 > 0)], names=["cell", "id", "member", "new"])

        return run

    def invite(groups: dict[int, int] | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = np.flatnonzero(places(batch.column("id").to_numpy(), groups))
                some = batch.take(pa.array(own))
                ids, nb, new = some.column("id").to_numpy(), _ids(some.column("nb"), kind, k), _rows(some.column("new"), np.uint8, k)
                who, which = np.nonzero(nb >= 0)
                at, cell = cells(nb[who, which], ids[who], groups)
                who, which = who[at], which[at]
                yield pa.RecordBatch.from_arrays([pa.array(nb[who, which]), pa.array(cell), pa.array(new[who, which] & 2 > 0)], names=["x", "cell", "new"])

        return run

    def meet(crowd: int | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for some in _whole_runs(batches, "cell", crowd):
                if isinstance(some, tuple):
                    yield pa.RecordBatch.from_arrays([pa.array([some[0]]), pa.nulls(1, pa.binary()), pa.array([some[1]])], names=["id", "found", "crowd"])
                    continue
                cell, ids, new = (some.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "id", "new"))
                # Who lists a place and is listed there came twice.
                order = np.lexsort((ids, cell))
                cell, ids, new = cell[order], ids[order], new[order]
                again = np.r_[False, (cell[1:] == cell[:-1]) & (ids[1:] == ids[:-1])]
                new[:-1] |= new[1:] & again[1:]
                order, cell, ids, new = order[~again], cell[~again], ids[~again], new[~again]
                what = _rows(some.column("member"), np.uint8, size + 2)[order]
                x, worst = _unit(what[:, :size].view(np.int8)), np.ascontiguousarray(what[:, size:]).view(np.int16)[:, 0]
                worst = np.where(worst == -32768, np.float32(-2), (worst + np.float32(0.5)) / np.float32(32767))
                starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
                out = [(ids[a], ids[b], s) for a, b, s in _pairs(x, worst, new, starts, np.diff(np.r_[starts, len(cell)]))]
                if out:
                    u, w, s = (np.concatenate(c) for c in zip(*out, strict=True))
                    u, w, s = _first(u, w, s, k)
                    if len(u):
                        each = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
                        yield pa.RecordBatch.from_arrays([pa.array(u[each]), _packed(w, s, each, entry), pa.nulls(len(each), pa.int64())], names=["id", "found", "crowd"])

        return run

    def found(groups: dict[int, int] | None = None) -> DataFrame:
        own = state.select("id", "nb", "ns", "new", member.alias("member")).mapInArrow(visit(groups), "cell long, id long, member binary, new boolean")
        guests = state.select("id", "nb", "new").mapInArrow(invite(groups), "x long, cell long, new boolean")
        guests = guests.join(state.select("id", member.alias("member")).hint("shuffle_hash"), F.col("x") == F.col("id")).select("cell", "id", "member", "new")
        met = own.unionByName(guests).repartition(partitions(spark), "cell").sortWithinPartitions("cell")
        return kept.keep(met.mapInArrow(meet(crowd if groups is None else None), "id long, found binary, crowd long"))

    parts = [found()]
    # Places too crowded for a task: there can be 2 * k / CROWD of them for each vertex; as a rule there are none.
    crowded = {r["id"]: -(-r["crowd"] // (crowd // 2)) for r in parts[0].filter("crowd is not null").select("id", "crowd").collect()}
    if crowded:
        parts.append(found(crowded))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _whole_runs(batches, "id"):
            vertex = some.column("v").is_valid().to_numpy(zero_copy_only=False)
            rows, more = some.filter(pa.array(vertex)), some.filter(pa.array(~vertex))
            ids, nb, ns, new = rows.column("id").to_numpy(), _ids(rows.column("nb"), kind, k), _sims(rows.column("ns"), k), _rows(rows.column("new"), np.uint8, k).copy()
            new[of_turn(nb)] &= 2
            new[of_turn(ids)] &= 1
            came = np.zeros(len(ids), np.int32)
            if more.num_rows:
                lengths = pc.binary_length(more.column("found")).to_numpy() // entry.itemsize
                flat = np.frombuffer(b"".join(more.column("found").to_pylist()), entry)
                u, w, s = _first(np.repeat(more.column("id").to_numpy(), lengths), flat["w"].astype(np.int64), flat["s"].astype(np.float32) / np.float32(32767), 2 * k)
                each = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
                row, place = np.searchsorted(ids, u), np.arange(len(u)) - np.repeat(each, np.diff(np.r_[each, len(u)]))
                new_ids, new_s = np.full((len(ids), 2 * k), -1, np.int64), np.full((len(ids), 2 * k), -2, np.float32)
                new_ids[row, place], new_s[row, place] = w, s
                both, sims, fresh = np.hstack([nb, new_ids]), np.hstack([ns, new_s]), np.hstack([new, np.full(new_ids.shape, 7, np.uint8)])
                # Those that a list already has go out; the sort is stable, so that its own come first.
                order = np.argsort(both, axis=1, kind="stable")
                sorted_ids = np.take_along_axis(both, order, 1)
                again = np.zeros(both.shape, bool)
                np.put_along_axis(again, order[:, 1:], sorted_ids[:, 1:] == sorted_ids[:, :-1], 1)
                sims = np.where(again | (both < 0), np.float32(-2), sims)
                top = np.argsort(-sims, axis=1, kind="stable")[:, :k]
                nb, ns, new = (np.take_along_axis(m, top, 1) for m in (both, sims, fresh))
                nb = np.where(ns > -2, nb, -1)
                came = np.count_nonzero((new & 4 > 0) & (nb >= 0), axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("v"), _binary(nb.astype(kind)), _binary(_held(ns)), _binary(new & 3), pa.array(came)], names=["id", "v", "nb", "ns", "new", "came"])

    rows = state.select("id", "v", "nb", "ns", "new", F.lit(None).cast("binary").alias("found"))
    for part in parts:
        none = [F.lit(None).cast("binary").alias(c) for c in ("v", "nb", "ns", "new")]
        rows = rows.unionByName(part.filter("found is not null").select("id", *none, "found"))
    return kept.keep(rows.repartition(partitions(spark), "id").sortWithinPartitions("id").mapInArrow(merge, _STATE + ", came int"))


def _first(u: np.ndarray, w: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k most similar w of each u, each w once, in order of u and similarity."""
    order = np.lexsort((w, u))
    u, w, s = u[order], w[order], s[order]
    once = np.r_[True, (u[1:] != u[:-1]) | (w[1:] != w[:-1])][: len(u)]
    u, w, s = u[once], w[once], s[once]
    order = np.lexsort((-s, u))
    u, w, s = u[order], w[order], s[order]
    starts = np.flatnonzero(np.r_[True, u[1:] != u[:-1]][: len(u)])
    keep = np.arange(len(u)) - np.repeat(starts, np.diff(np.r_[starts, len(u)])) < k
    return u[keep], w[keep], s[keep]


def _packed(w: np.ndarray, s: np.ndarray, starts: np.ndarray, entry: np.dtype) -> pa.Array:
    """Entries as binary values, one for each run that begins at a start."""
    flat = np.empty(len(w), entry)
    flat["w"], flat["s"] = w, _held(s)
    offsets = (np.r_[starts, len(w)] * entry.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(flat.tobytes())])


def neighbour_pairs(graph: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """The k nearest of each vertex of a graph in rows: (id, neighbour, similarity)."""

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            width = len(batch.column("ns")[0].as_py()) // 2
            nb = _ids(batch.column("nb"), _kind(len(batch.column("nb")[0].as_py()) == 4 * width), width)[:, :k]
            ns, has = _sims(batch.column("ns"), width)[:, :k], nb >= 0
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("id").to_numpy(), nb.shape[1])[has.ravel()]), pa.array(nb[has]), pa.array(ns[has])], names=["id", "neighbour", "similarity"])

    return graph.mapInArrow(unfold, "id long, neighbour long, similarity float")


def search_graph(graph: DataFrame, queries: DataFrame, size: int, k: int = 10, width: int = 32, entries: int = 2048) -> DataFrame:
    """The k vertices nearest to each query by greedy search: (query, neighbour, similarity).

    `graph` is what neighbour_graph gives and `queries` has (id, v) in its form; a query that is a
    vertex doesn't find itself. A search begins at the nearest of `entries` vertices, a bounded
    sample, and where the query is a vertex at its own list too; it goes on from the `width` best seen to their neighbours until none of these is left
    to go on from; as it goes on from each vertex once at most, it ends. Ways lead along the lists
    and back, but back from a vertex that many list only to the `width` most similar of them and to
    those that have it as their nearest: whoever is listed nowhere is reached from its nearest.
    """
    spark, kk = graph.sparkSession, graph.select(F.length("ns") / 2).first()
    if kk is None:
        return spark.createDataFrame([], "query long, neighbour long, similarity float")
    kept = Kept(spark)
    held = lowest(graph.select("id", "v"), ["id"], entries, graph.count()).select("id", "v").toArrow()
    shared = spark.sparkContext.broadcast((held.column("id").to_numpy(), _unit(_rows(held.column("v"), np.int8, size))))

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = shared.value
        for batch in batches:
            own = batch.column("id").to_numpy()
            s = np.where(own[:, None] == ids, -2, _unit(_rows(batch.column("v"), np.int8, size)) @ x.T)
            few = min(8, s.shape[1])
            top = np.argpartition(-s, few - 1, axis=1)[:, :few]
            q = np.repeat(np.arange(len(own)), few)
            yield pa.RecordBatch.from_arrays([pa.array(own[q]), batch.column("v").take(pa.array(q)), pa.array(ids[top].ravel()), pa.array(np.take_along_axis(s, top, 1).ravel().astype(np.float32))], names=["query", "qv", "node", "s"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.einsum("ij,ij->i", _unit(_rows(batch.column("qv"), np.int8, size)), _unit(_rows(batch.column("v"), np.int8, size)))
            yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("qv"), batch.column("node"), pa.array(s.astype(np.float32)), pa.array(np.zeros(len(s), bool))], names=["query", "qv", "node", "s", "done"])

    pairs = neighbour_pairs(graph, int(kk[0]))
    # The first entry of a list is the nearest. Back links are cut before and after the shuffle, in arrays of bounded length.
    nearest = pairs.groupBy("id").agg(F.max(F.struct("similarity", "neighbour")).alias("n")).select(F.col("n.neighbour").alias("id"), F.col("id").alias("neighbour"))
    back = pairs.select(F.col("neighbour").alias("id"), "similarity", F.col("id").alias("other")).repartition(partitions(spark), "id").sortWithinPartitions("id", F.col("similarity").desc(), "other")

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rank = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("id").to_numpy()
            starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            ranks = np.arange(len(ids)) - np.repeat(starts, np.diff(np.r_[starts, len(ids)]))
            if ids[0] == last:
                ranks[: starts[1] if len(starts) > 1 else len(ids)] += rank
            last, rank = ids[-1], int(ranks[-1]) + 1
            yield batch.filter(pa.array(ranks < width))

    back = back.mapInArrow(few, "id long, similarity float, other long").select("id", F.col("other").alias("neighbour"))
    listed = pairs.select(F.col("id").alias("query"), F.col("neighbour").alias("node"), F.col("similarity").alias("s"))
    listed = listed.join(queries.select(F.col("id").alias("query"), F.col("v").alias("qv")), "query").select("query", "qv", "node", "s")
    links = kept.keep(pairs.select("id", "neighbour").unionByName(nearest).unionByName(back).distinct())
    begun = queries.select("id", "v").mapInArrow(enter, "query long, qv binary, node long, s float").filter("query <> node").unionByName(listed)
    seen = kept.keep(begun.groupBy("query", "node").agg(F.first("qv").alias("qv"), F.max("s").alias("s")).select("query", "qv", "node", "s", F.lit(False).alias("done")))
    while not seen.filter("not done").isEmpty():
        step = seen.filter("not done").join(links, F.col("node") == F.col("id")).select("query", "qv", F.col("neighbour").alias("node")).distinct()
        fresh = step.filter("query <> node").join(seen.select("query", "node"), ["query", "node"], "left_anti")
        fresh = fresh.join(graph.select(F.col("id").alias("node"), "v"), "node").select("query", "qv", "node", "v").mapInArrow(score, "query long, qv binary, node long, s float, done boolean")
        every = seen.withColumn("done", F.lit(True)).unionByName(fresh)
        # A query's best are bounded by `width` and the links of as many vertices.
        best = every.groupBy("query").agg(F.first("qv").alias("qv"), F.slice(F.sort_array(F.collect_list(F.struct("s", "node", "done")), asc=False), 1, width).alias("b"))
        seen = kept.keep(best.select("query", "qv", F.explode("b").alias("b")).select("query", "qv", "b.node", "b.s", "b.done"))
        kept.drop(kept.n - 2)
    best = seen.groupBy("query").agg(F.slice(F.sort_array(F.collect_list(F.struct("s", "node")), asc=False), 1, k).alias("b"))
    return best.select("query", F.explode("b").alias("b")).select("query", F.col("b.node").alias("neighbour"), F.col("b.s").alias("similarity"))
