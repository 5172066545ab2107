"""The neighbour graph and the search in it against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows
from pyspark.sql import functions as F

from staylens.llm.common import Kept
from staylens.llm.neighbours import _STATE, TURNS, _descend, _grow, _held, _kind, _leaf, _whole_runs, neighbour_graph, neighbour_pairs, search_graph


def _table(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(int(i), None if v is None else [None if x is None else float(x) for x in v]) for i, v in zip(ids, vectors, strict=True)], "vid long, e array<float>").withColumn("id", F.lit("clash")).withColumn("v", F.lit(0))


def test_recall_of_graph_and_search(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 16)) * 0.5
    x *= rng.lognormal(size=(6000, 1))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    graph = neighbour_graph(_table(spark, x), "vid", "e", 16).cache()
    lists = {}
    for r in neighbour_pairs(graph).collect():
        lists.setdefault(r["id"], {})[r["neighbour"]] = r["similarity"]
    some = np.arange(0, 6000, 50)
    s = unit[some] @ unit.T
    s[np.arange(len(some)), some] = -2
    best = np.argsort(-s, axis=1)[:, :10]
    assert len(lists) == 6000 and all(len(v) == 10 for v in lists.values())
    assert np.mean([len(set(lists[i]) & set(b)) / 10 for i, b in zip(some, best, strict=True)]) >= 0.9
    assert all(abs(sim - unit[i] @ unit[j]) < 0.01 for i in some for j, sim in lists[i].items())
    found = {}
    for r in search_graph(graph, graph.filter("id % 50 = 0"), 16).collect():
        found.setdefault(r["query"], set()).add(r["neighbour"])
    assert np.mean([len(found[i] & set(b)) / 10 for i, b in zip(some, best, strict=True)]) >= 0.9


@pytest.mark.parametrize(("leaves", "least"), [(32, 0.5), (256, 0.35)])
def test_trees_keep_neighbours_together(leaves, least):
    # Splits between pairs of points kept 0.26 and 0.11 of them.
    rng = np.random.default_rng(4)
    x = rng.normal(size=(100, 32))[rng.integers(0, 100, 20_000)] + rng.normal(size=(20_000, 32))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    some = np.arange(0, 20_000, 50)
    near = np.argsort(-(x[some] @ x.T), axis=1, kind="stable")[:, 1:11]
    leaf = _leaf(x, *_grow(x[rng.choice(20_000, 8192, replace=False)], leaves, rng))
    assert 0 <= leaf.min() and leaf.max() < leaves and np.bincount(leaf).max() < 8 * 20_000 / leaves
    assert np.mean(leaf[some][:, None] == leaf[near]) >= least


@pytest.mark.parametrize("x", [np.zeros((0, 4)), np.eye(4)[:1], np.tile(np.eye(4)[0], (50, 1))])
def test_trees_on_few_or_equal_vectors(x):
    leaf = _leaf(x.astype(np.float32), *_grow(x.astype(np.float32), 128, np.random.default_rng(0)))
    assert len(leaf) == len(x) and len(set(leaf.tolist())) <= 1


def test_unusable_repeated_and_equal_vectors(spark):
    same = [1.0, 2.0, 3.0, 4.0]
    vectors = [same, same, [2.0, 4.0, 6.0, 8.0], [-1.0, 0, 0, 0], None, [0.0] * 4, [1.0] * 3, [float("nan"), 1, 1, 1], [float("inf"), 1, 1, 1], [None, 1, 1, 1], same]
    df = _table(spark, vectors, [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 0])
    got = rows(neighbour_pairs(neighbour_graph(df, "vid", "e", 4)))
    assert {(a, b) for a, b, _ in got} == {(a, b) for a in range(4) for b in range(4) if a != b}
    assert all(s == pytest.approx(1, abs=1e-3) for a, b, s in got if a < 3 and b < 3)


def test_many_copies_are_neighbours_of_copies(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([np.tile(rng.normal(size=8), (3000, 1)), rng.normal(size=(1500, 8))])
    lists = {}
    for r in neighbour_pairs(neighbour_graph(_table(spark, x), "vid", "e", 8)).collect():
        lists.setdefault(r["id"], []).append(r["similarity"])
    assert all(min(lists[i]) > 0.999 and len(lists[i]) == 10 for i in range(3000))


def _state(spark, vertices, kind=np.uint32):
    """A graph in the middle of its descent from {id: (vector, list, similarities)}."""
    data = [(i, bytearray(np.array(v, np.int8).tobytes()), bytearray(np.array(nb, np.int64).astype(kind).tobytes()), bytearray(_held(np.array(ns, np.float32)).tobytes()), bytearray(np.full(len(nb), 3, np.uint8).tobytes())) for i, (v, nb, ns) in vertices.items()]
    return spark.createDataFrame(data, _STATE)


def _pass(spark, state, size, k, kind=np.uint32, **more):
    kept = Kept(spark)
    for turn in range(TURNS):
        state = _descend(kept, state, size, k, kind, 1, turn, **more)
    return state


@pytest.mark.parametrize("narrow", [True, False])
def test_no_better_neighbour_is_hidden_by_a_listed_one(spark, narrow):
    # The ids of the listed one and of the better one are alike under multiplicative hashing, in all rounds.
    q, p, u = 5, 3, 7
    w = q + min(range(10, 100_000), key=lambda d: d * 0x9E3779B97F4A7C15 % 2**64)
    vertices = {u: ([100, 0, 0, 0], [p, q], [0.9, 0.1]), w: ([99, 5, 0, 0], [p, -1], [0.9, -2]), p: ([90, 40, 0, 0], [-1, -1], [-2, -2]), q: ([10, 99, 0, 0], [-1, -1], [-2, -2])}
    state = _pass(spark, _state(spark, vertices, _kind(narrow)), 4, 2, _kind(narrow))
    assert {n for i, n, _ in rows(neighbour_pairs(state, 2)) if i == u} == {p, w}


def test_a_neighbour_of_a_neighbour_is_met_without_listing_it(spark):
    # 1 lists 2, 2 lists 3, and 3 lists neither.
    vertices = {1: ([100, 0, 0, 0], [2, 4], [0.9, 0.0]), 2: ([90, 40, 0, 0], [3, 1], [0.95, 0.9]), 3: ([95, 30, 0, 0], [4, -1], [0.3, -2]), 4: ([0, 100, 0, 0], [3, -1], [0.3, -2])}
    state = _pass(spark, _state(spark, vertices), 4, 2)
    assert {n for i, n, _ in rows(neighbour_pairs(state, 2)) if i == 1} == {2, 3} and (3, 1) in {(i, n) for i, n, _ in rows(neighbour_pairs(state, 2))}


def test_all_pairs_of_a_crowded_place_meet(spark):
    # Forty vertices list one hub only; in groups of four all of them still find their best two.
    rng = np.random.default_rng(3)
    x = rng.integers(-100, 100, (41, 8))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T - 3 * np.eye(41)
    state = _state(spark, {i: (x[i], [0, -1] if i else [-1, -1], [float(near[i, 0]) if i else -2, -2]) for i in range(41)})
    got = {}
    for i, n, _ in rows(neighbour_pairs(_pass(spark, state, 8, 2, crowd=8), 2)):
        got.setdefault(i, set()).add(n)
    assert all(got[i] == set(np.argsort(-near[i])[:2].tolist()) for i in range(1, 41))


@pytest.mark.parametrize("limit", [3, 100])
def test_runs_stay_whole_over_batches(limit):
    values = np.repeat(np.arange(6), [1, 5, 2, 9, 1, 4])
    batches = [pa.RecordBatch.from_arrays([pa.array(values[i : i + 3])], names=["c"]) for i in range(0, len(values), 3)]
    got, over = [], {}
    for some in _whole_runs(iter(batches), "c", limit):
        if isinstance(some, tuple):
            over[some[0]] = some[1]
        else:
            got.append(set(some.column("c").to_pylist()))
    assert sorted(v for g in got for v in g) == sorted({0, 1, 2, 3, 4, 5} - set(over))
    assert over == ({1: 5, 3: 9, 5: 4} if limit == 3 else {})


@pytest.mark.parametrize("n", [0, 1, 2])
def test_tiny_tables(spark, n):
    df = _table(spark, np.eye(4)[:2]).limit(n)
    graph = neighbour_graph(df, "vid", "e", 4)
    assert len(rows(neighbour_pairs(graph))) == (2 if n == 2 else 0)
    assert len(rows(search_graph(graph, graph, 4))) == (2 if n == 2 else 0)
