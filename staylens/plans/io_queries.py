"""Queries that write tables out and read them again, and that read pages and captured answers, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from staylens.functions import parse, text
from staylens.operators import bm25, capture, quality, vectors
from staylens.plans import search_queries as search_plans
from staylens.plans.sql import array, stripped
from staylens.plans.text_queries import _SHORT_VI, _score, table
from staylens.plans.text_queries import ORACLE as TEXT_ORACLE
from staylens.sources import readers, writers
from staylens.streaming import ingest

_REVIEW = "_id string, source_hotel_id string, review_text string, review_rating string, review_date string, source string"
HOST = "https://stay.invalid"


def lines_written(spark, folder):
    """Reviews as records a line, read again where the file of one array is missing."""
    path = ingest.work_folder(spark)
    writers.write_lines(table(spark, folder, "reviews").select(*[c.split()[0] for c in _REVIEW.split(", ")]), f"{path}/lines")
    return readers.read_records(spark, f"{path}/array", f"{path}/lines", _REVIEW)


def array_written(spark, folder):
    """The list of places, which doesn't grow, as one array."""
    path, rows = ingest.work_folder(spark), table(spark, folder, "canon_locations")
    rows.agg(F.to_json(F.collect_list(F.struct("loc_id", "canonical", "aliases", "region"))).alias("value")).write.text(f"{path}/array")
    return readers.read_records(spark, f"{path}/array", None, "loc_id long, canonical string, aliases array<string>, region string")


def csv_written(spark, folder):
    path = ingest.work_folder(spark)
    writers.write_csv(table(spark, folder, "queries"), f"{path}/csv")
    return readers.read_csv(spark, f"{path}/csv", {"bucket_order": 0})


def sources_first_wins(spark, folder):
    """Rated reviews as one source and the others as a second: the first row of each id."""
    rows = table(spark, folder, "reviews").select("_id", "review_rating", "source")
    return readers.read_all([rows.filter("review_rating is not null"), rows.filter("review_rating is null")], ["_id"])


def page_of_documents(spark, folder):
    return readers.page(table(spark, folder, "documents").select("doc_id", "n_chars"), ["doc_id"], 100, 50)


def hotel_samples(spark, folder):
    rows = table(spark, folder, "documents").filter("source_hotel_id is not null")
    return readers.samples_by_key(rows, "source_hotel_id", "text", ["doc_id"]).select("source_hotel_id", F.col("place").cast("int").alias("place"), "text")


def query_set(spark, folder):
    """The queries as the one file of a query set, read again."""
    path, rows = ingest.work_folder(spark), table(spark, folder, "queries")
    items = F.array_sort(F.collect_list(F.struct(search_plans._number().alias("n"), F.struct("query_id", "query", "bucket_id", "bucket_name", "bucket_order").alias("q"))))
    rows.agg(F.to_json(F.transform(items, lambda i: i["q"])).alias("value")).write.text(f"{path}/queries")
    return readers.read_queries(spark, f"{path}/queries")


_CITIES = [
    {"name": " Tân Mỹ ", "geo_id": "101", "max_hotels": "5", "max_reviews": None, "region": "south", "enabled": True, "code": None},
    {"name": "Hòn Bích", "code": "HB", "geo_id": "102", "max_hotels": "0", "max_reviews": "x"},
    {"name": "", "geo_id": "103"},
    {"name": "Trà Rêu", "geo_id": None},
    {"name": "Bãi Vọng", "geo_id": "105", "enabled": False},
]


def crawl_cities(spark, folder):
    return readers.cities(spark, _CITIES)


def bm25_stored(spark, folder):
    """The lexical search from an index that was written and read again."""
    path = ingest.work_folder(spark)
    search_plans._index(spark, folder).write(path)
    scores = bm25.candidates(search_plans._asked(spark, folder), bm25.Index.read(spark, path), 10).withColumn("bm25", F.round("bm25", 6))
    return bm25.top(scores, "query", "bm25", "doc", 10)


def vectors_stored(spark, folder):
    """The vector search from an index that was written and read again."""
    path = f"{ingest.work_folder(spark)}/vectors"
    vectors.write_index(table(spark, folder, "vector_index").select("vec_id", "embeddings"), path, "vec_id", "embeddings")
    rows = vectors.read_index(spark, path).filter(F.size("embedding") == 64)
    best = vectors.exact_top(rows, rows.filter(F.col("doc") % search_plans.EVERY == 0).dropDuplicates(["doc"]), "doc", "embedding", 10)
    return best.select("query", "doc", F.round("score", 4).alias("score"))


def run_logged(spark, folder):
    """Of a log with two runs, the second: the rated places."""
    path, rows = f"{ingest.work_folder(spark)}/log", table(spark, folder, "places").select("_id", "rating", "updated_at")
    for run in (rows, rows.filter("rating is not null")):
        writers.log_run(run, path)
    log = spark.read.parquet(path)
    return writers.latest_run(writers.retained(log, 2)).drop("logged_at")


def run_written(spark, folder):
    path = f"{ingest.work_folder(spark)}/run"
    writers.write_run(search_plans.run_file(spark, folder), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


def qrels_written(spark, folder):
    path = f"{ingest.work_folder(spark)}/qrels"
    writers.write_qrels(search_plans.qrels_union(spark, folder), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


def reviews_kept_up(spark, folder):
    """Reviews read as a stream into a table that is kept up by id."""
    path = ingest.work_folder(spark)
    rows = ingest.stream_of(spark, f"{folder}/reviews.parquet").select("_id", "review_text", F.col("crawled_at").cast("timestamp").alias("crawled_at"))
    ingest.keep_up(rows, f"{path}/table", f"{path}/checkpoint", "_id", "crawled_at").awaitTermination()
    return ingest.read_table(spark, f"{path}/table").select("_id", "clean_text", F.size("tokens").alias("n_tokens"))


_PAYLOAD = """named_struct('data', named_struct('hasNext', false, 'reviews', array(named_struct(
  'reviewId', if(length(_id) % 7 = 0, concat('expedia-', _id), _id), 'reviewOriginalText', review_text, 'translationStatus', if(length(review_text) % 5 = 0, 'TRANSLATED', 'Original'),
  'reviewScore', review_rating, 'reviewTimestamp', '1700000000000', 'reviewReply', named_struct('replyText', if(length(review_text) % 3 = 0, review_text, 'Cảm ơn quý khách')))))) """


def captured_reviews(spark, folder):
    """Reviews written as captured answers: translations, replies taken for reviews and ids from elsewhere go, the first row of an id counts."""
    rows = table(spark, folder, "reviews").filter("review_text is not null").select("source_hotel_id", "crawled_at", F.to_json(F.expr(_PAYLOAD)).alias("payload"))
    found = capture.reviews(rows, "payload", "source_hotel_id", "crawled_at", "stay")
    return found.select("review_id", "source_review_id", "review_text", "review_rating", "review_date")


def unwanted_tags(spark, folder):
    return table(spark, folder, "documents").select("doc_id", quality.without_unwanted(F.col("descriptor_tags"), text.words_array(["sạch", "view_biển"])).alias("wanted"))


# Pages and urls of each kind, with what they say.
_PAGES = {
    "linked": ('<html><script type="application/ld+json">{"@type":"Villa","address":{"streetAddress":"12 Đường Biển","addressLocality":"Tân Mỹ","addressCountry":"VN"}}</script><h1>Hotel A</h1></html>', "12 Đường Biển, Tân Mỹ, VN", "villa"),
    "graph": ('<html><script type="application/ld+json">{"@graph":[{"@type":"BoutiqueHotel","address":{"streetAddress":"7 Lê Lợi","addressLocality":"Tân Mỹ"}},{"@type":"Hotel"}]}</script></html>', "7 Lê Lợi, Tân Mỹ", "boutique_hotel"),
    "element": ('<div class="hotel-address x"><b>Số 5</b>, Phường 2, Tân Mỹ</div><span>Tân Mỹ, sạch sẽ, quay lại</span><title>Resort Sóng</title>', "Số 5 , Phường 2, Tân Mỹ", "resort"),
    "span": ("<html><span>Nhân viên ở Tân Mỹ, thân thiện</span><span>88 Trần Phú, Tân Mỹ</span><h1>Nhà khách Gió</h1></html>", "88 Trần Phú, Tân Mỹ", "guesthouse"),
    "none": ("<html><p>Chỉ có chữ</p></html>", "Tân Mỹ", "hotel"),
}
_ANCHORS = """<a class="c" href="/vi-vn/hotel/detail?spec=1.2.HOTEL.123456.Nha-A.1">x</a><a href='https://stay.invalid/vi-vn/hotel/b-7654321'><h3>B</h3></a>
<a href="/vi-vn/hotel/b?hotelId=7654321">b</a><a href="/vi-vn/flight/1">f</a><a href="https://other.invalid/hotel/9">o</a><a href="/vi-vn/hotel/list">l</a><a href="/vi-vn/hotel/list">l</a>"""
_URLS = {
    "/vi-vn/hotel/detail?spec=01-01-2024.02-01-2024.1.1.HOTEL.3000020.Nha-Moi.1": ("3000020", "https://stay.invalid/vi-vn/hotel/detail?spec=01-01-2024.02-01-2024.1.1.HOTEL.3000020.Nha-Moi.1", True),
    "https://stay.invalid/vi-vn/hotel/nha-moi-9000001?x=1": ("9000001", "https://stay.invalid/vi-vn/hotel/nha-moi-9000001?x=1", True),
    "https://stay.invalid/x?hotelId=55555#t": ("55555", "https://stay.invalid/x?hotelId=55555#t", False),
    "https://stay.invalid/x?hotel_id=1234": ("", "https://stay.invalid/x?hotel_id=1234", False),
    "hotel/nha-1234567": ("1234567", "https://stay.invalid/hotel/nha-1234567", True),
    "": ("", "", False),
}
_NESTED = ['{"a":[{"name":"Nhà A","card":{"hotelSeoUrl":"/hotel/a-1"}},{"hotelName":"B","hotelSeoUrl":"/hotel/b-2"}],"hotelSeoUrl":" /hotel/c "}', '[{"title":"T","x":[[{"hotelSeoUrl":"/hotel/a-1"},{"hotelSeoUrl":"/hotel/a-1","name":"later"}]]}]', "no json", "{}"]


def _pages(spark):
    return spark.createDataFrame([(name, page[0]) for name, page in _PAGES.items()], "page string, html string")


def page_facts(spark, folder):
    """Where a page says a hotel is, and of what kind it is."""
    heading = F.array_join(F.regexp_extract_all("html", F.lit(r"(?is)<(?:title|h1|h2)\b[^>]*>([^<]*)<"), 1), " ")
    kinds = parse.page_types(parse.linked_type(F.col("html")), heading, F.lit(""))
    return _pages(spark).select("page", parse.page_location(F.col("html"), F.lit("Tân Mỹ")).alias("location"), F.array_join(kinds, ",").alias("kinds"))


def page_anchors(spark, folder):
    rows = spark.createDataFrame([(_ANCHORS,)], "html string")
    return rows.select(F.posexplode(parse.anchor_targets(F.col("html"), HOST)).alias("place", "t")).select("place", "t.url", "t.hotel_id")


def url_rules(spark, folder):
    url = F.col("url")
    return spark.createDataFrame([(u,) for u in _URLS], "url string").select("url", parse.hotel_id(url).alias("hotel_id"), parse.detail_url(url, HOST).alias("page"), parse.is_candidate(parse.detail_url(url, HOST), "stay.invalid").alias("candidate"))


def search_urls(spark, folder):
    cities = spark.createDataFrame([("101", "Tân Mỹ")], "geo string, name string")
    return cities.select(parse.search_url(HOST, F.col("geo"), F.col("name"), F.lit("2024-02-28").cast("date")).alias("url"))


def nested_targets(spark, folder):
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(_NESTED)], "n int, payload string")
    return rows.select("n", F.explode(parse.json_targets("payload")).alias("t")).select("n", "t.url", "t.name")


QUERIES = {
    f.__name__: f
    for f in (
        lines_written, array_written, csv_written, sources_first_wins, page_of_documents, hotel_samples, query_set, crawl_cities, bm25_stored, vectors_stored, run_logged, run_written, qrels_written, reviews_kept_up, captured_reviews, unwanted_tags,
        page_facts, page_anchors, url_rules, search_urls, nested_targets,
    )
}


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_KEPT = TEXT_ORACLE["pipeline_filter"].replace("coalesce(text, '')", "coalesce(review_text, '')").replace("doc_id", "_id").replace("FROM documents", "FROM (SELECT DISTINCT _id, review_text FROM reviews)")
ORACLE = {
    "lines_written": f"SELECT {', '.join(c.split()[0] for c in _REVIEW.split(', '))} FROM reviews",
    "array_written": "SELECT loc_id, canonical, aliases, region FROM canon_locations",
    "csv_written": "SELECT query_id, query, bucket_id, bucket_name, bucket_order FROM queries",
    "sources_first_wins": "SELECT _id, review_rating, source FROM reviews QUALIFY row_number() OVER (PARTITION BY _id ORDER BY review_rating IS NULL, review_rating, source NULLS FIRST) = 1",
    "page_of_documents": "SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 50 OFFSET 100",
    "hotel_samples": "SELECT source_hotel_id, cast(row_number() OVER (PARTITION BY source_hotel_id ORDER BY doc_id) AS int) AS place, substr(text, 1, 200) AS text FROM documents WHERE source_hotel_id IS NOT NULL QUALIFY place <= 3",
    "query_set": "SELECT query_id, trim(query) AS query, bucket_id, bucket_name, bucket_order FROM queries WHERE trim(coalesce(query, '')) <> ''",
    "crawl_cities": "SELECT * FROM (VALUES ('Tân Mỹ', 'TÂ', '101', 'south', 5, 1), ('Hòn Bích', 'HB', '102', NULL, 1, 1)) t(name, code, geo_id, region, max_hotels, max_reviews)",
    "bm25_stored": search_plans.ORACLE["bm25_topk"],
    "vectors_stored": search_plans.ORACLE["vector_topk"],
    "run_logged": "SELECT _id, rating, updated_at FROM places WHERE rating IS NOT NULL",
    "run_written": f"SELECT line FROM ({search_plans.ORACLE['run_file']})",
    "qrels_written": f"SELECT concat_ws(chr(9), query, '0', doc, grade) AS line FROM ({search_plans.ORACLE['qrels_union']})",
    "reviews_kept_up": _KEPT,
    "captured_reviews": f"""WITH r AS (SELECT _id, source_hotel_id, {stripped('review_text')} AS said, arg_min({{'s': {_score('review_rating')}}}, crawled_at) AS first FROM reviews
  WHERE review_text IS NOT NULL AND length(review_text) % 5 <> 0 AND length(review_text) % 3 <> 0 AND length(_id) % 7 <> 0 AND length({stripped('review_text')}) > 10 AND {_SHORT_VI.format('review_text')} GROUP BY 1, 2, 3)
SELECT 'stay_' || source_hotel_id || '_' || _id AS review_id, _id AS source_review_id, said AS review_text, first.s AS review_rating, '2023-11-14T22:13:20+00:00' AS review_date FROM r""",
    "unwanted_tags": f"SELECT doc_id, NOT coalesce(len(list_intersect(list_transform(descriptor_tags, lambda t: lower(trim(t))), {array(['!cleanliness', '!view_beach'])})) > 0, false) AS wanted FROM documents",
    "page_facts": "SELECT * FROM (VALUES " + ", ".join(f"({_text(name)}, {_text(at)}, {_text(kinds)})" for name, (_, at, kinds) in _PAGES.items()) + ") t(page, location, kinds)",
    "page_anchors": "SELECT * FROM (VALUES (0, 'https://stay.invalid/vi-vn/hotel/b-7654321', '7654321'), (1, 'https://stay.invalid/vi-vn/hotel/detail?spec=1.2.HOTEL.123456.Nha-A.1', '123456'), (2, 'https://stay.invalid/vi-vn/hotel/list', '')) t(place, url, hotel_id)",
    "url_rules": "SELECT * FROM (VALUES " + ", ".join(f"({_text(u)}, {_text(i)}, {_text(p)}, {c})" for u, (i, p, c) in _URLS.items()) + ") t(url, hotel_id, page, candidate)",
    "search_urls": "SELECT 'https://stay.invalid/hotel/search?spec=29-02-2024.01-03-2024.1.1.HOTEL_GEO.101.T%C3%A2n%20M%E1%BB%B9.1' AS url",
    "nested_targets": "SELECT * FROM (VALUES (0, '/hotel/a-1', 'Nhà A'), (0, '/hotel/b-2', 'B'), (0, '/hotel/c', ''), (1, '/hotel/a-1', 'T')) t(n, url, name)",
}
