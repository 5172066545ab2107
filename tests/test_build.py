"""Settings, and the way from raw records to hits."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from staylens import build
from staylens.__main__ import parser
from staylens.functions import lexicon
from staylens.operators import bm25, evaluation, search, tagging

CATEGORIES = lexicon.rules({"quiet": {"positive": ["yên tĩnh"], "negative": ["ồn ào"]}})
DESCRIPTORS = lexicon.rules({"clean": {"positive": ["sạch sẽ"], "negative": ["bẩn"]}})
LOCATIONS = {"trà_rêu": ["tra reu"]}


def test_settings_are_overridden_by_the_environment():
    assert build.settings({"index": "a", "rules": " "}, {"STAYLENS_INDEX": "b", "STAYLENS_RULES": ""}) == {"index": "b"}
    with pytest.raises(ValueError, match="STAYLENS_INDEX"):
        build.settings({}, {}, need=("index",))
    assert parser().parse_args(["search", "a", "b", "--top-k", "3"]).queries == ["a", "b"]


def test_from_raw_records_to_hits(spark, tmp_path):
    raw = [
        ("r1", "h1", "Nhà Mây", "Trà Rêu", "Phòng rất sạch sẽ và yên tĩnh, nhân viên tốt", ["hotel"]),
        ("r1", "h1", "Nhà Mây", "Trà Rêu", "Phòng rất sạch sẽ và yên tĩnh, nhân viên rất tốt", ["hotel"]),
        ("r2", "h2", "Biển Xanh", "Hòn Bích", "Phòng bẩn và ồn ào quá đi thôi", None),
        ("r3", "h2", "Biển Xanh", "Hòn Bích", "spam", None),
        (None, "h3", "Không Tên", "Hòn Bích", "Phòng đẹp và rộng rãi", None),
    ]
    records = spark.createDataFrame([(a, a, h, n, at, "4", t, k) for a, h, n, at, t, k in raw], "review_id string, source_review_id string, source_hotel_id string, hotel_name string, location string, rating string, review_text string, place_types array<string>").coalesce(1)
    processed = build.process(records, CATEGORIES, DESCRIPTORS)
    assert rows(processed.select("review_id", "category_tags", "descriptor_tags")) == [("r1", ["quiet"], ["clean"]), ("r2", ["!quiet"], ["!clean"])]
    path = str(tmp_path / "index")
    build.index(processed, path)
    engine = build.engine(spark, path, lexicon.aliases(LOCATIONS), lexicon.keywords(LOCATIONS), ["sạch"])
    hits = engine.search(["phòng sạch sẽ ở trà rêu", "phòng"])
    assert [(r["query"], r["source_hotel_id"]) for r in hits.filter("rank = 1").orderBy("query").collect()][0] == ("Q1", "h1")
    assert {r[0] for r in engine.systems(["phòng sạch sẽ"]).select("system").distinct().collect()} <= {"bm25", "vector", "hybrid"}


def test_index_versions(spark, tmp_path):
    path = str(tmp_path / "bm25")
    with pytest.raises(FileNotFoundError):
        bm25.Index.read(spark, path)
    for docs in ([("a", ["x"]), ("b", ["y"])], [("a", ["x"]), ("b", ["y"]), ("c", ["z"])]):
        bm25.build(spark.createDataFrame(docs, "id string, tokens array<string>"), "id", "tokens").write(path)
        assert bm25.Index.read(spark, path).terms.count() == len(docs)
    assert bm25.Index.read(spark, path) is bm25.Index.read(spark, path)


def test_sentiment_by_a_model_and_strong_words(spark):
    df = spark.createDataFrame([(1, "phòng sạch sẽ nhưng có gián".split()), (2, "phòng sạch sẽ".split())], "id int, t array<string>")
    model = lambda texts: ["positive" for _ in texts]
    got = rows(tagging.contexts(df, "id", "t", DESCRIPTORS, sentiment=model).select("id", "sentiment"))
    assert got == [(1, "positive"), (2, "positive")]
    got = rows(tagging.contexts(df, "id", "t", DESCRIPTORS, sentiment=model, strong_negative=["gián"]).select("id", "sentiment"))
    assert got == [(1, "negative"), (2, "positive")]
    with pytest.raises(ValueError):
        tagging.hits_in(F.col("t"), [(f"w{i}", "t", False) for i in range(tagging.MOST_PHRASES + 1)])


def test_synonyms_take_part_in_conflicts():
    words = search.conflict_words({"yên tĩnh": ["tĩnh_mịch"], "unknown": ["x"]})
    assert "tĩnh mịch" in words and "x" not in words and "cách âm" in words


@pytest.mark.parametrize("n", [1, 19, 20, 21, 500])
def test_percentiles_of_a_hot_group(spark, n):
    values = [float((i * 7919) % n // 2) for i in range(n)]
    df = spark.createDataFrame([("hot", v) for v in values] + [("b", 1.0), ("b", None), (None, 3.0), (None, 2.0)], "g string, v double")
    got = {r["g"]: r for r in evaluation.latency(df, ["g"], "v").collect()}
    assert got["hot"]["p95"] == sorted(values)[int(0.95 * (n - 1))] and got["hot"]["n"] == n and got["hot"]["most"] == max(values)
    assert got["hot"]["mean"] == pytest.approx(sum(values) / n) and got[None]["p95"] == 2.0 and got["b"]["n"] == 1
    assert evaluation.latency(df, [], "v").first()["n"] == n + 3
    assert evaluation.latency(df.limit(0), [], "v").first() is None


def test_shortlist_loses_no_hit(spark):
    grouped = spark.createDataFrame([("q", f"h{i:03d}", 1000.0 - 3 * i, 0.0, 0.0, "d", ["d"], 1) for i in range(300)], "query string, source_hotel_id string, score double, vector double, bm25 double, first_doc string, best array<string>, reviews long")
    places = spark.createDataFrame([(f"h{i:03d}", "trà rêu" if i % 7 == 0 else "xa") for i in range(300)], "_id string, location string")
    for place, fit in ((None, range(300)), ("trà_rêu", range(0, 300, 7))):
        asked = spark.createDataFrame([("q", place)], "query string, detected_location string")
        kept = {r["source_hotel_id"] for r in search.shortlist(grouped, places, asked, {"trà_rêu": ["trà rêu"]}, search.Settings(top_k=5)).collect()}
        score = {f"h{i:03d}": (1000.0 - 3 * i) for i in fit}
        bound = sorted(score.values())[-5] * search.LEAST_FACTOR
        assert kept == {h for h, s in score.items() if s * 1.2 >= bound - 1e-6}
