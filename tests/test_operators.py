"""Table operators against hand-made tables."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from staylens.functions.lexicon import rules
from staylens.operators import bm25, evaluation, search, store, summary, tagging, vectors


def test_store(spark):
    seen = spark.createDataFrame([("h", v, i) for i, v in enumerate(["B", "A", "A", "B", None, " "])], "h string, v string, i int").withColumn("t", F.timestamp_seconds("i"))
    assert rows(store.mode(seen, "h", "v", "t").select("h", "v")) == [("h", "B")]
    assert rows(store.canonicalise(seen, "h", ["v"], "t").select("v").distinct()) == [("B",)]
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, None)], "k string, t int, v string")
    assert rows(store.latest(df, ["k"], "t")) == [("a", 3, "z"), ("b", 1, None)] and rows(store.first(df, ["k"], "t")) == [("a", 1, "x"), ("b", 1, None)]
    new = spark.createDataFrame([("b", 5, "n"), ("b", 4, "o"), ("c", 1, "c"), ("", 1, "x"), (None, 1, "x")], "k string, t int, v string")
    once = store.upsert(store.latest(df, ["k"], "t"), new, ["k"], "t")
    assert rows(once) == [("a", 3, "z"), ("b", 5, "n"), ("c", 1, "c")] == rows(store.upsert(once, new, ["k"], "t"))


def test_split_store_and_join(spark):
    raw = spark.createDataFrame([("r1", "h1", "H", "L", "4", ["villa"], "a", 1), ("r1", "h1", "H2", "L", "4", None, "b", 2), (None, "h2", "G", "L", "3", None, "c", 3), ("r2", "h9", None, None, None, None, "d", 4)], "review_id string, source_hotel_id string, hotel_name string, location string, rating string, place_types array<string>, review_text string, seq int")
    places, reviews = store.split_store(raw, F.col("seq"))
    assert rows(places.select("_id", "hotel_name", "types")) == [("h1", "H2", ["hotel"]), ("h2", "G", ["hotel"]), ("h9", None, ["hotel"])]
    assert rows(reviews.select("_id", "review_text")) == [("r1", "b"), ("r2", "d")]
    assert rows(store.with_places(reviews, places.filter("_id <> 'h9'")).select("_id", "hotel_name")) == [("r1", "H2")]


HITS = [(1, 0, 2, "p1", "a", False), (1, 1, 4, "p2", "b", True), (1, 3, 5, "p3", "c", False), (1, 6, 7, "p4", "d", False), (1, 7, 8, "p5", "e", False)]


def test_overlaps_merge_and_touching_ones_stay(spark):
    df = spark.createDataFrame(HITS, "id int, start int, end int, phrase string, tag string, negative boolean")
    got = rows(tagging.merge_overlaps(df, "id").select("start", "end", "tag", "negative", "phrase"))
    assert got == [(0, 5, "a|b|c", True, "p1 + p2 + p3"), (6, 7, "d", False, "p4"), (7, 8, "e", False, "p5")]


def test_tagging(spark):
    df = spark.createDataFrame([(1, "phòng rất sạch sẽ nhưng hơi ồn ào quá".split()), (2, "ga bẩn".split()), (3, []), (4, None)], "id int, tokens array<string>")
    lexicon = rules({"clean": {"positive": ["sạch", "sạch sẽ"], "negative": ["bẩn"]}, "quiet": {"positive": ["yên tĩnh"], "negative": ["ồn ào"]}})
    assert rows(tagging.category_tags(df, "id", "tokens", lexicon)) == [(1, ["clean", "!quiet"]), (2, ["!clean"])]
    found = tagging.contexts(df, "id", "tokens", lexicon, subjects={"clean": ["phòng"]}, exclusions={"quiet": ["không có"]})
    assert rows(found.select("id", "tag", "phrase", "context", "sentiment")) == [(1, "clean|clean", "sạch + sạch sẽ", "phòng rất sạch sẽ nhưng hơi ồn", "neutral"), (1, "quiet", "ồn ào", "nhưng hơi ồn ào quá", "negative")]
    tags = {r["id"]: r for r in tagging.assign_tags(found, "id").collect()}
    assert "!quiet" in tags[1]["tags"] and tags[1]["polarity"]["quiet"] == "negative"


def test_bm25_of_four_documents(spark):
    docs = spark.createDataFrame([("d1", list("aba")), ("d2", list("ac")), ("d3", list("abcd")), ("d4", ["e"]), ("d5", []), ("d6", None)], "id string, tokens array<string>")
    index = bm25.build(docs, "id", "tokens")
    idf = {r["term"]: round(r["idf"], 6) for r in index.terms.collect()}
    assert idf == {"a": 0.042365, "b": 0.0, "c": 0.0, "d": 0.847298, "e": 0.847298}
    asked = spark.createDataFrame([("q", ["a", "c"])], "query_id string, tokens array<string>")
    got = bm25.score(asked, index)
    assert {r["doc"]: round(r["bm25"], 6) for r in got.collect()} == {"d1": 0.056866, "d2": 0.046555, "d3": 0.033358}
    assert {r["doc"]: round(r["bm25"], 6) for r in bm25.max_normalise(got, "query", "bm25").collect()} == {"d1": 1.0, "d2": 0.818681, "d3": 0.586614}


def _corpus(spark):
    """Documents with repeated ids, equal texts and terms of negative weight, and queries with repeated and unknown terms."""
    docs = [(f"d{i % 90:02d}", [f"t{(i * j) % 13}" for j in range(1, 2 + i % 7)] + ["all"] * (i % 5 > 0)) for i in range(100)]
    asked = [(f"q{i}", [f"t{i % 13}", f"t{i * i % 13}", "all", "none"]) for i in range(30)] + [(None, ["t1"]), ("empty", [])]
    return spark.createDataFrame(docs, "id string, tokens array<string>"), spark.createDataFrame(asked, "query_id string, tokens array<string>")


@pytest.mark.parametrize("block, many", [(1000, 1000), (16, 7)])
def test_candidates_hold_the_best_of_all_scores(spark, monkeypatch, block, many):
    monkeypatch.setattr(bm25, "BLOCK", block), monkeypatch.setattr(bm25, "PASS", many), monkeypatch.setattr(bm25, "STRIPE", 4)
    docs, asked = _corpus(spark)
    index = bm25.build(docs, "id", "tokens")
    best = lambda df: rows(bm25.top(df.withColumn("bm25", F.round("bm25", 6)), "query", "bm25", "doc", 3))
    few, every = bm25.candidates(asked, index, 3), bm25.score(asked, index)
    assert best(few) == best(every) and {r[0] for r in best(few)} >= {None, "q1"}
    assert few.count() < every.filter("bm25 > 0").count() / 2  # scores of all pairs don't leave the tasks


@pytest.mark.parametrize("block, many", [(1000, 1000), (16, 7)])
def test_groups_are_those_of_all_scores(spark, monkeypatch, block, many):
    monkeypatch.setattr(bm25, "BLOCK", block), monkeypatch.setattr(bm25, "PASS", many), monkeypatch.setattr(bm25, "STRIPE", 4)
    docs, asked = _corpus(spark)
    index = bm25.build(docs, "id", "tokens")
    about = docs.select(F.col("id").alias("doc"), F.expr("nullif('h' || substr(id, 3), 'h3')").alias("h"))
    asked = asked.filter("query_id is not null")
    scored = bm25.max_normalise(bm25.score(asked, index), "query", "bm25").withColumn("bm25", F.round("bm25", 9)).withColumn("hybrid", F.col("bm25")).withColumn("vector", F.lit(0.0))
    values = ["query", "h", F.round("score", 6), F.round("bm25", 6), "first_doc", "reviews"]
    got = rows(bm25.grouped(asked, index, about, "h").select(*values))
    assert got == rows(search.group_hits(scored, about, "h").select(*values)) and max(r[5] for r in got) > 5


def test_index_is_written_and_read(spark, tmp_path):
    docs = spark.createDataFrame([("d1", ["a"]), ("d2", ["b"]), ("d3", ["c"])], "id string, tokens array<string>")
    bm25.build(docs, "id", "tokens").write(str(tmp_path / "index"))
    assert bm25.Index.read(spark, str(tmp_path / "index")).terms.count() == 3


def test_fusion_and_roll_up(spark):
    a = spark.createDataFrame([("q", "d1", 4.0), ("q", "d2", 2.0)], "query string, doc string, bm25 double")
    b = spark.createDataFrame([("q", "d1", 0.5), ("q", "d3", 0.25)], "query string, doc string, vector double")
    assert {r["doc"]: round(r["hybrid"], 6) for r in search.fuse(a, b).collect()} == {"d1": 1.0, "d2": 0.2, "d3": 0.3}
    scored = spark.createDataFrame([("q", f"r{i}", s, s, s) for i, s in enumerate([1.0, 0.9, 0.8, 0.7, 0.6, 0.5])], "query string, doc string, hybrid double, vector double, bm25 double")
    docs = spark.createDataFrame([(f"r{i}", "h", f"t{i}", ["x", "!y"]) for i in range(6)], "doc string, hotel string, review_text string, category_tags array<string>")
    r = search.roll_up(scored, docs, "hotel").first()
    assert round(r["score"], 9) == 4.0 and r["reviews"] == 6 and r["texts"][:3] == ["t0", "t1", "t2"] and r["first_doc"] == "r0"


def test_mask_or_all(spark):
    df = spark.createDataFrame([("q", 1, True), ("q", 2, False), ("r", 3, False), ("r", 4, None)], "q string, i int, ok boolean")
    assert rows(search.mask_or_all(df, "q", F.coalesce("ok", F.lit(False))).select("i")) == [(1,), (3,), (4,)]


def test_metrics(spark):
    run = spark.createDataFrame([("s", "q", f"h{i}", i) for i in range(1, 5)] + [("s", "none", "h1", 1)], "system string, query string, doc string, rank int")
    grades = spark.createDataFrame([("q", "h2", 2), ("q", "h4", 1), ("q", "h9", 1)], "query string, doc string, grade int")
    queries = spark.createDataFrame([("q",), ("none",), ("absent",)], "query string")
    ten = {r["query"]: r for r in evaluation.metrics(run, grades, queries).collect()}
    five = {r["query"]: r for r in evaluation.metrics(run, grades, queries, k=5).collect()}
    q = ten["q"]
    assert five["q"]["precision"] == 0.4 and [round(q[c], 6) for c in ("recall", "ap", "ap_k", "ndcg", "mrr")] == [0.666667, 0.333333, 0.1, 0.540586, 0.5]
    assert all(ten[n][c] == 0 for n in ("none", "absent") for c in ("precision", "recall", "ap", "ndcg", "mrr"))
    report = evaluation.report(evaluation.metrics(run, grades, queries), queries.withColumn("bucket", F.lit("b")), ["mrr"])
    assert {(r["bucket"], round(r["mrr"], 6)) for r in report.collect()} == {("b", 0.166667), (None, 0.166667)}
    assert rows(evaluation.winners(report, "mrr", {"s": 0})) == sorted([("b", "s"), (None, "s")], key=repr)


def test_latency_pools_and_lines(spark):
    times = spark.createDataFrame([("g", 10.0 * i) for i in range(1, 21)] + [("g", None)], "g string, ms double")
    r = evaluation.latency(times, ["g"], "ms").first()
    assert (r["n"], r["mean"], r["p95"], r["most"]) == (20, 105.0, 190.0, 200.0)
    a = spark.createDataFrame([("Q1", "x", 1, 0.5)], "query string, doc string, rank int, score double")
    b = spark.createDataFrame([("Q1", "y", 1, 0.25)], "query string, doc string, rank int, score double")
    assert rows(evaluation.pool([("a", a), ("b", b)])) == [("Q1", "x", 1, None), ("Q1", "y", None, 1)]
    assert rows(evaluation.run_lines(a)) == [(1, 1, "Q1\t1\tx\t0.500000")]
    labels = spark.createDataFrame([("Q1", "z", 2)], "query string, doc string, grade int")
    assert rows(evaluation.qrels(labels, a)) == [("Q1", "x", 0), ("Q1", "z", 2)]


@pytest.mark.parametrize("block", [2, 1000])
def test_exact_top(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, None), (5, [1.0]), (6, [float("nan"), 1.0]), (7, [0.9, 0.1])], "id long, v array<float>")
    got = rows(vectors.exact_top(df, df.filter("id < 4"), "id", "v", 2).select("query", "doc", "rank"))
    assert got == [(1, 2, 1), (1, 7, 2), (2, 1, 1), (2, 7, 2), (3, 2, 1), (3, 7, 2)]


@pytest.mark.parametrize("batch", ["4", "10000"])
def test_exact_top_takes_an_id_once(spark, batch):
    # Nine copies of the nearest, one of them farther; each id's best row counts.
    rest = [(i, [1.0, 0.1 * i]) for i in range(2, 8)]
    df = spark.createDataFrame([(1, [1.0, 0.0])] * 8 + [(1, [0.5, 0.0])] + rest + rest[::-1] + [(1, [1.0, 0.0])] + [(0, [1.0, 0.0])], "id long, v array<float>").coalesce(1)
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = rows(vectors.exact_top(df, df.filter("id = 0"), "id", "v", 3, cosine=True).select("rank", "doc"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert got == [(1, 1), (2, 2), (3, 3)]


def test_search_masks_the_whole_collection_before_the_pool(spark):
    import numpy as np

    from staylens import api

    # 150 documents elsewhere are nearer than each of the 30 at the place asked for; none there shares the words of Q2.
    texts = {i: ("away", "phòng đẹp") if i < 150 else ("here", f"phòng đẹp w{i} x{i} y{i}") for i in range(180)} | {180: ("away", "ban công")}
    docs = spark.createDataFrame([(i, h, t, [], t.split()) for i, (h, t) in texts.items()], "doc long, source_hotel_id string, review_text string, category_tags array<string>, tokens array<string>")
    places = spark.createDataFrame([("here", "A", "Bãi Vọng", "4", ["hotel"]), ("away", "B", "Huế", "4", ["hotel"])], "_id string, hotel_name string, location string, rating string, types array<string>")
    coded = vectors.encode(docs.select("doc", F.array_join("tokens", " ").alias("t")), "t")
    engine = api.Engine(docs, places, bm25.build(docs, "doc", "tokens"), coded, {"bãi_vọng": "bãi_vọng", "hòn_bích": "hòn_bích"}, {"bãi_vọng": ["bãi vọng"], "hòn_bích": ["hòn bích"]}, [])
    hits = {(r["query"], r["source_hotel_id"]): r for r in engine.search(["phòng đẹp bãi vọng", "ban công bãi vọng", "ban công hòn bích"], vector_weight=1, bm25_weight=0).collect()}
    code = lambda t: vectors.hashed([t])[0].astype(float)
    for query, asked, own in (("Q1", "phòng đẹp bãi_vọng", "here"), ("Q2", "ban công bãi_vọng", "here"), ("Q3", "ban công hòn_bích", None)):
        scores = {i: code(t) @ code(asked) for i, (h, t) in texts.items() if own in (h, None)}
        for hotel in ("here", "away"):
            mine = sorted((s / max(scores.values()) for i, s in scores.items() if s > 1e-9 and texts[i][0] == hotel), reverse=True)
            assert ((query, hotel) in hits) == bool(mine)
            if mine:
                hit = hits[query, hotel]
                assert hit["reviews"] == len(mine) and hit["score"] == pytest.approx(sum(mine[:5]))
    assert hits["Q1", "here"]["reviews"] == 30
    lexical = engine.search(["ban công bãi vọng"], vector_weight=0, bm25_weight=1)
    assert lexical.count() == 0  # documents at the place exist, though none shares a word
    assert np.all([r["location_matched"] for q, r in hits.items() if q[0] == "Q1"])


def test_encoder_is_pluggable(spark):
    import numpy as np

    df = spark.createDataFrame([("a b",), (None,)], "t string")
    assert [len(r["embedding"]) for r in vectors.encode(df, "t").collect()] == [64, 64]
    assert rows(vectors.encode(df, "t", "e", lambda texts: np.ones((len(texts), 2)))) == sorted([("a b", [1.0, 1.0]), (None, [1.0, 1.0])], key=repr)


def test_summary(spark):
    df = spark.createDataFrame([("h", 1, "phòng đẹp phòng. Ồn. phòng đẹp phòng."), ("h", 2, None), ("k", 3, "")], "h string, id int, t string")
    assert rows(summary.summarise(df, "h", "id", "t", 2)) == [("h", 1, "phòng đẹp phòng.", 10), ("h", 2, "Ồn.", 0)]


def test_label_by_points(spark):
    places, types, wishes = {"huế": ["huế"]}, {"resort": ["resort"]}, {"quiet": ["yên tĩnh"], "pet": ["thú cưng"]}
    label = evaluation.label_by_points(F.col("q"), F.col("n"), F.col("l"), F.col("r"), places, types, wishes, denied={"quiet": ["ồn"]}, missing={"pet": ["chó", "thú cưng"]})
    cases = [
        ("ở huế", "A", "Huế", [], 1),
        ("ở huế", "A", "x", ["gần huế"], 1),
        ("ở huế", "A", "x", [], 0),
        ("resort", "Resort B", None, None, 1),
        ("yên tĩnh", "A", "x", ["yên tĩnh"], 0),
        ("resort yên tĩnh", "Resort", "x", ["rất ồn"], 0),
        ("thú cưng yên tĩnh", "A", "x", ["yên tĩnh, có thú cưng"], 1),
        ("a b c d e f g h i hoa sen", "Hoa Sen", "x", [], 1),
        (None, None, None, None, 0),
    ]
    df = spark.createDataFrame(cases, "q string, n string, l string, r array<string>, want int")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", label).collect())


def test_pooled_ranking_and_changes(spark):
    pools = spark.createDataFrame([("Q1", "x", None), ("Q1", "y", 2), ("Q1", "z", 1)], "query string, doc string, a_rank int")
    assert rows(evaluation.pooled_ranking(pools, "a")) == [("a", "Q1", "x", 3), ("a", "Q1", "y", 2), ("a", "Q1", "z", 1)]
    now, before = (spark.createDataFrame([("s", m, t)], "system string, mrr double, ms double") for m, t in ((0.5, 130.0), (0.53, 100.0)))
    assert rows(evaluation.changes(now, before, "system", {"mrr": -0.02, "ms": 40.0}).select("value", "within")) == [("mrr", False), ("ms", True)]
