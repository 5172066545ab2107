"""Files, streams and the service's calls."""

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from staylens import api
from staylens.operators import bm25, vectors
from staylens.sources import readers, writers
from staylens.streaming import ingest


def test_records(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"review_id": "1", "review_text": "x"}, {"review_id": "2"}]))
    (tmp_path / "e.json").write_text("[]")
    (tmp_path / "l.jsonl").write_text('{"review_id": "3"}\n\n{"review_id": "4"}\n')
    read = lambda a, b: sorted(r["review_id"] for r in readers.read_records(spark, str(tmp_path / a), str(tmp_path / b)).collect())
    assert read("a.json", "l.jsonl") == ["1", "2"] and read("e.json", "l.jsonl") == ["3", "4"] and read("no", "l.jsonl") == ["3", "4"] and read("no", "no") == []


def test_first_source_wins(spark):
    a = spark.createDataFrame([("1", None, "a"), (None, None, "k")], "review_id string, id string, v string")
    b = spark.createDataFrame([("1", None, "b"), (None, "7", "c"), (None, "7", "d")], "review_id string, id string, v string")
    assert sorted(r["v"] for r in readers.read_all([a, b], ["review_id", "id"]).collect()) == ["a", "c", "k"]


def test_csv_with_mark_and_quotes(spark, tmp_path):
    (tmp_path / "p.csv").write_text('\ufeffquery_id,rank,text\nQ1,3.0,"a ""b"",\nc"\nQ2,,d\n', encoding="utf-8")
    df = readers.read_csv(spark, str(tmp_path / "p.csv"), {"rank": 99})
    assert rows(df) == [("Q1", 3, 'a "b",\nc'), ("Q2", 99, "d")]
    writers.write_csv(df, str(tmp_path / "out"))
    assert rows(readers.read_csv(spark, str(tmp_path / "out"), {"rank": 99})) == rows(df)


def test_query_sets(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps([{"query": "a"}, {"query": " "}, {"query": "b", "query_id": "X"}, {"query": "c"}]))
    (tmp_path / "d.json").write_text(json.dumps({"one": ["a", "b"], "two": ["c"]}))
    assert rows(readers.read_queries(spark, str(tmp_path / "l.json")).select("query_id", "query")) == [("Q1", "a"), ("Q4", "c"), ("X", "b")]
    assert rows(readers.read_queries(spark, str(tmp_path / "d.json")).select("query_id", "query", "bucket_id")) == [("Q1", "a", "one"), ("Q2", "b", "one"), ("Q3", "c", "two")]


def test_small_readers(spark):
    df = spark.createDataFrame([("h", i, f"t{i}" * 200) for i in range(5)], "h string, i int, t string")
    assert [(r["place"], len(r["text"])) for r in readers.samples_by_key(df, "h", "t", ["i"]).orderBy("place").collect()] == [(1, 200), (2, 200), (3, 200)]
    assert rows(readers.seeded_sample(df, "i", 2)) == rows(readers.seeded_sample(df.repartition(3), "i", 2))
    assert rows(readers.page(df.select("i"), ["i"], 3)) == [(3,), (4,)]
    assert rows(readers.cities(spark, [{"name": "Huế", "geo_id": "1", "max_hotels": "x"}, {"name": "Off", "geo_id": "2", "enabled": False}, {"name": "No"}])) == [("Huế", "HU", "1", None, 1, 1)]
    assert rows(readers.mapped(df.limit(1), {"id": ["none", "i"], "src": ["none"]}, {"src": "s"})) == [("0", "s")]
    assert readers.indexable(spark.createDataFrame([(None, None), (["a"], None)], "tokens array<string>, clean_text string")).count() == 1


def test_writers(spark, tmp_path):
    lines = spark.createDataFrame([(10, 1, "Q10"), (2, 2, "b"), (2, 1, "a")], "number int, rank int, line string")
    writers.write_run(lines, str(tmp_path / "run"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "run")).collect()] == ["a", "b", "Q10"]
    writers.write_qrels(spark.createDataFrame([("Q2", "y", 1), ("Q1", "x", 0)], "query string, doc string, grade int"), str(tmp_path / "qrels"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "qrels")).collect()] == ["Q1\t0\tx\t0", "Q2\t0\ty\t1"]
    for n in range(3):
        writers.log_run(spark.createDataFrame([(n,)], "n int"), str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    assert [r["n"] for r in writers.latest_run(log).collect()] == [2] and sorted(r["n"] for r in writers.retained(log, 2).collect()) == [1, 2]
    assert writers.markdown(spark.createDataFrame([(None, 0.5)], "bucket string, p double")).endswith("| all | 0.5000 |")


def test_stream_of_reviews_is_kept_up(spark, tmp_path):
    schema = "review_id string, review_text string, crawled_at timestamp"

    def arrive(name, data):
        spark.createDataFrame(data, "review_id string, review_text string, s long").select("review_id", "review_text", F.timestamp_seconds("s").alias("crawled_at")).coalesce(1).write.parquet(str(tmp_path / "in" / name))

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        ingest.keep_up(stream, str(tmp_path / "table"), str(tmp_path / "cp")).awaitTermination()
        return ingest.read_table(spark, str(tmp_path / "table"))

    arrive("1", [("a", "Phòng rất sạch sẽ", 1_000_000), ("a", "Phòng rất sạch sẽ", 1_000_000), ("spam", "hotline", 1_000_000), ("en", "a good clean place", 1_000_000)])
    assert rows(run().select("review_id", "clean_text")) == [("a", "phòng rất sạch sẽ")]
    arrive("2", [("b", "Hồ bơi rất đẹp", 1_000_100)])
    assert rows(run().select("review_id")) == [("a",), ("b",)]


def test_service(spark):
    docs = spark.createDataFrame([(1, "h1", "view biển rất đẹp", ["beach"], "view biển rất đẹp".split()), (2, "h2", "phòng cũ", [], "phòng cũ".split()), (3, "h1", "ăn sáng ngon", [], "ăn sáng ngon".split()), (4, "h3", "xa chợ", [], ["xa", "chợ"])], "doc long, source_hotel_id string, review_text string, category_tags array<string>, tokens array<string>")
    places = spark.createDataFrame([("h1", "A", "Bãi Vọng", "4.5", ["resort"]), ("h2", "B", "Huế", "3", ["hotel"]), ("h3", "C", "Huế", "3", ["hotel"])], "_id string, hotel_name string, location string, rating string, types array<string>")
    coded = vectors.encode(docs.select("doc", F.array_join("tokens", " ").alias("t")), "t")
    engine = api.Engine(docs, places, bm25.build(docs, "doc", "tokens"), coded, {"bãi_vọng": "bãi_vọng"}, {"bãi_vọng": ["bãi vọng"]}, ["view", "biển"])
    hits = engine.search(["resort view biển bãi vọng", "phòng"]).collect()
    by = {(r["query"], r["rank"]): r for r in hits}
    first = by["Q1", 1]
    assert first["source_hotel_id"] == "h1" and first["location_matched"] and first["descriptor_matched"] and first["type_factor"] == 1.2 and first["place_factor"] == 1.8
    assert by["Q2", 1]["source_hotel_id"] == "h2"
    for bad in (["x"], dict(top_k=0)), (["x"], dict(vector_weight=0, bm25_weight=0)), ([" "], {}):
        with pytest.raises(ValueError):
            engine.search(bad[0], **bad[1])
    assert engine.hotel("h2")["hotel_name"] == "B" and engine.hotel("x") is None
    assert len(engine.suggestions(["a"]).first()["suggestions"]) == 4
    assert engine.latency(spark.createDataFrame([(1.0,), (3.0,)], "ms double"))["n"] == 2
