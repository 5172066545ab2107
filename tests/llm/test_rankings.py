"""Positions, top-n, rank fusion and term weights against plain Python."""

import math
import random
from collections import Counter, defaultdict

import pytest
from conftest import rows
from pyspark.sql import functions as F

from staylens.llm.common import latest
from staylens.llm.distinctive import term_weights
from staylens.llm.positions import positions
from staylens.llm.rank_fusion import fuse, majority_leaders
from staylens.llm.top_n import top_n


def test_latest_takes_the_last_row_of_a_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), (None, None, "n"), ("b", None, None)], "k string, t int, v string")
    assert rows(latest(df, ["k"], "t")) == sorted([("a", 2, "z"), ("b", None, None), (None, None, "n")], key=repr)


@pytest.mark.parametrize("parts", [1, 4, 9])
def test_positions_over_partitions_with_a_hot_group(spark, parts):
    rng = random.Random(parts)
    data = [(rng.choice([None, "hot", "hot", "hot", "b", "c"]), rng.randint(0, 5), i) for i in range(700)]
    df = spark.createDataFrame(data, "g string, v int, i int")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    got = positions(df, ["g"], [F.col("v").desc(), F.col("i")], run=["v"])
    kept = positions(df, ["g"], [F.col("v").desc(), F.col("i")], keep=3)
    want = []
    by = defaultdict(list)
    for g, v, i in data:
        by[g].append((-v, i))
    for g, own in by.items():
        own.sort()
        first = {}
        for n, (v, i) in enumerate(own, 1):
            want.append((g, -v, i, n, first.setdefault(v, n)))
    assert rows(got) == sorted(want, key=repr)
    assert rows(kept.select("g", "v", "i", "position")) == sorted([w[:4] for w in want if w[3] <= 3], key=repr)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_top_n_ties_nulls_repeats_and_clashing_columns(spark):
    nan = float("nan")
    data = [("h", "Q10", 1.0, 0), ("h", "Q2", 1.0, 0), ("h", "Q3", 2.0, 0), ("h", "Q4", nan, 0), ("h", "Q5", None, 0), (None, "Q6", 1.0, 0), ("h", None, 5.0, 0), ("k", "Q1", 0.5, 0), ("k", "Q1", 0.5, 0)]
    df = spark.createDataFrame(data, "hotel string, query string, score double, position int").withColumn("group", F.lit(1))
    got = top_n(df, "hotel", "score", "query", 3, "cast(substring(tie, 2) as bigint)")
    assert rows(got) == sorted([("h", None, 5.0, 1), ("h", "Q3", 2.0, 2), ("h", "Q2", 1.0, 3), (None, "Q6", 1.0, 1), ("k", "Q1", 0.5, 1), ("k", "Q1", 0.5, 2)], key=repr)
    assert rows(top_n(df.limit(0), "hotel", "score", "query", 3)) == []
    assert rows(top_n(df, "hotel", "score", "query", 0)) == []
    with pytest.raises(ValueError):
        top_n(df, "absent", "score", "query", 3)


def _brute(data, k=60):
    """Fusion and leaders of (group, item, scores...) in plain Python."""
    by = defaultdict(dict)
    for g, i, *s in data:
        old = by[g].get(i, [None] * len(s))
        s = [None if x is not None and math.isnan(x) else x for x in s]
        by[g][i] = [max((x for x in (a, b) if x is not None), default=None) for a, b in zip(old, s, strict=True)]
    fused, leaders = {}, set()
    for g, items in by.items():
        for i, s in items.items():
            ranks = [None if x is None else 1 + sum(o[n] is not None and o[n] > x for o in items.values()) for n, x in enumerate(s)]
            fused[g, i] = sum(1 / (k + r) for r in ranks if r)
            ahead = lambda o, s=s: sum((a > b) - (a < b) for a, b in zip(s, o, strict=True) if a is not None and b is not None) > 0
            if all(ahead(o) for j, o in items.items() if j != i):
                leaders.add((g, i))
    return fused, leaders


@pytest.mark.parametrize("seed", range(3))
def test_fusion_and_leaders_against_brute_force(spark, seed):
    rng = random.Random(seed)
    value = lambda scale: rng.choice([None, float("nan"), 0.0, scale, round(rng.random() * scale, 1), round(rng.random() * scale, 1)])
    data = [(rng.choice([None, "a", "b", "c"]) if n > 60 else f"q{n % 20}", f"i{rng.randint(0, 9)}", value(1.0), value(1e6), value(5.0)) for n in range(160)]
    df = spark.createDataFrame(data, "q string, i string, s0 double, s1 double, s2 double").withColumn("rank_0", F.lit("clash"))
    got = fuse(df, "q", "i", ["s0", "s1", "s2"])
    fused, leaders = _brute(data)
    assert {(r["q"], r["i"]): round(r["fused"], 9) for r in got.collect()} == {k: round(v, 9) for k, v in fused.items()}
    order = defaultdict(list)
    for r in got.collect():
        order[r["q"]].append((r["position"], -r["fused"], r["i"]))
    assert all([p for p, _, _ in sorted(o)] == list(range(1, len(o) + 1)) and sorted(o) == sorted(o, key=lambda x: x[1:]) for o in order.values())
    assert set(rows(majority_leaders(got, "q", "i", 3))) == leaders


def test_fusion_of_nothing_and_of_items_without_scores(spark):
    df = spark.createDataFrame([("q", "i", None), ("q", "j", 1.0), ("r", "k", None)], "q string, i string, s double")
    got = fuse(df, "q", "i", ["s"])
    assert rows(got.select("q", "i", "rank_0", "position")) == sorted([("q", "i", None, 2), ("q", "j", 1, 1), ("r", "k", None, 1)], key=repr)
    assert rows(majority_leaders(got, "q", "i", 1)) == [("r", "k")]
    empty = fuse(df.limit(0), "q", "i", ["s"])
    assert rows(empty) == [] and rows(majority_leaders(empty, "q", "i", 1)) == []


def test_term_weights_against_brute_force(spark):
    rng = random.Random(1)
    words = [f"w{n}" for n in range(30)] + ["", "!x", "x"]
    data = [(i, None if i % 13 == 0 else [rng.choice([*words, None, "the", "the", "the"]) for _ in range(rng.randint(0, 40))], ["t"] * (i % 2)) for i in range(60)]
    data.append((None, ["lone"], None))
    df = spark.createDataFrame(data, "id int, tokens array<string>, tags array<string>").withColumn("term", F.lit(1)).withColumn("df", F.lit(2))
    got = {(r["id"], r["field"], r["term"]): (r["tf"], r["df"], r["cf"], round(r["weight"], 9)) for r in term_weights(df, "id", ["tokens", "tags"]).collect()}
    want = {}
    for field in (1, 2):
        docs = {d[0]: Counter(t for t in d[field] or [] if t is not None) for d in data}
        docs = {k: v for k, v in docs.items() if v}
        mean = sum(sum(v.values()) for v in docs.values()) / len(docs)
        df_, cf = Counter(t for v in docs.values() for t in v), sum(docs.values(), Counter())
        for k, v in docs.items():
            for t, tf in v.items():
                m, tfn = cf[t] / len(docs), tf * math.log2(1 + mean / sum(v.values()))
                want[k, ["tokens", "tags"][field - 1], t] = (tf, df_[t], cf[t], round((math.log2(1 + m) + tfn * math.log2((1 + m) / m)) / (tfn + 1), 9))
    assert got == want
    for few in (1, 2, 4):  # the least weight of a term of few records loses none of them, but most of the others
        heavy = {(r["id"], r["field"], r["term"]) for r in term_weights(df, "id", ["tokens", "tags"], few=few).collect()}
        assert heavy <= set(got) and {k for k, v in got.items() if v[1] <= few} <= heavy and sum(got[k][1] > 20 for k in heavy) < sum(v[1] > 20 for v in got.values())
    assert max(got, key=lambda k: got[k][3] if k[1] == "tokens" and k[2] else -1)[2] != "the"
    assert rows(term_weights(df.limit(0), "id", ["tokens"])) == []
