"""The queries of this subpackage, by name, and their SQL where SQL can say it."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.llm.canonical import canonical_text
from staylens.llm.common import cut, latest
from staylens.llm.distinctive import term_weights
from staylens.llm.gazetteer import map_values
from staylens.llm.language import fit_model, label_meaning, languages
from staylens.llm.neighbours import neighbour_graph, neighbour_pairs, off_by, search_graph
from staylens.llm.packing import pack
from staylens.llm.rank_fusion import fuse, majority_leaders
from staylens.llm.repetition import repetition
from staylens.llm.tokenizer import encode_corpus
from staylens.llm.top_n import top_n

SCORES = ["hybrid_score", "vector_score", "bm25_score", "review_rating"]
WINDOW = 2048


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _hits(spark: SparkSession, folder: str) -> DataFrame:
    """The latest row of each query and hotel with its scores and its hotel's mean rating."""
    hits = latest(_table(spark, folder, "results").select("query_id", "source_hotel_id", "logged_at", *SCORES[:3]), ["query_id", "source_hotel_id"], "logged_at")
    written = F.regexp_replace(F.trim("review_rating"), ",", ".")
    value = F.when(written.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), written.try_cast("decimal(12,5)"))
    value = F.when(value > 5, value / 2).otherwise(value).cast("decimal(12,5)")
    # Exact sums, so that equal means are equal whatever the order of the rows.
    ratings = _table(spark, folder, "documents").select("source_hotel_id", value.alias("v")).filter("v is not null")
    ratings = ratings.groupBy("source_hotel_id").agg((F.sum("v").cast("double") / F.count("*")).alias("review_rating"))
    return hits.join(ratings, "source_hotel_id", "left")


def p1_ranking(spark: SparkSession, folder: str) -> DataFrame:
    return fuse(_hits(spark, folder), "query_id", "source_hotel_id", SCORES)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return majority_leaders(p1_ranking(spark, folder), "query_id", "source_hotel_id", len(SCORES))


def _languages(spark: SparkSession, folder: str) -> DataFrame:
    """Languages of every review row, with what its label means as `label`."""
    reviews, codes = _table(spark, folder, "reviews").withColumnRenamed("lang", "written"), _table(spark, folder, "lang_codes")
    model = fit_model(reviews, "_id", "review_text", "written", codes)
    return languages(label_meaning(reviews, "written", codes, "label"), "_id", "review_text", model, carry=["label"]).withColumnRenamed("_id", "review_id")


def p2_languages(spark: SparkSession, folder: str) -> DataFrame:
    """One row a review: rows of an _id share text and label."""
    return _languages(spark, folder).dropDuplicates(["review_id"])


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = _languages(spark, folder).select("review_id", "label", F.explode(F.array_distinct("stretches.lang")).alias("lang"))
    return rows.filter(F.col("lang").isNotNull() & ~F.col("lang").eqNullSafe(F.col("label"))).select("review_id", "lang").distinct()


def _places(spark: SparkSession, folder: str) -> DataFrame:
    return latest(_table(spark, folder, "places").select("_id", "location", "updated_at"), ["_id"], "updated_at")


def p3_canonical(spark: SparkSession, folder: str) -> DataFrame:
    """Every review text and latest location in its one form. Rows of an _id share their text."""
    reviews = canonical_text(_table(spark, folder, "reviews"), "_id", "review_text").dropDuplicates(["_id"])
    places = canonical_text(_places(spark, folder), "_id", "location").withColumnRenamed("location", "review_text")
    return reviews.withColumn("tbl", F.lit("reviews")).unionByName(places.withColumn("tbl", F.lit("places"))).select("tbl", F.col("_id").alias("row_id"), F.col("review_text").alias("text"), "kinds")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    reviews = canonical_text(_table(spark, folder, "reviews"), "_id", "review_text", changed_only=True).select(F.lit("reviews").alias("tbl"), "_id").distinct()
    places = canonical_text(_places(spark, folder), "_id", "location", changed_only=True).select(F.lit("places").alias("tbl"), "_id")
    return reviews.unionByName(places).select("tbl", F.col("_id").alias("row_id"))


def p7_mapping(spark: SparkSession, folder: str) -> DataFrame:
    mapped = map_values(_places(spark, folder), "_id", "location", _table(spark, folder, "canon_locations"), "loc_id", "canonical", "aliases")
    return mapped.withColumnRenamed("_id", "place_id")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_mapping(spark, folder).filter("not blank and not exact").select("place_id", "loc_id")


#: Cosine from which a pair counts.
ALIKE = 0.965
DIMENSIONS = 64


def _graph(spark: SparkSession, folder: str) -> DataFrame:
    return neighbour_graph(_table(spark, folder, "vector_index"), "vec_id", "embeddings", DIMENSIONS)


def p4_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbour_pairs(_graph(spark, folder)).withColumnRenamed("id", "vec_id")


def p4_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 50, found in the graph."""
    graph = _graph(spark, folder)
    return search_graph(graph, graph.filter("id % 50 = 0"), DIMENSIONS)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of the graph that can be alike by their 8-bit directions, then all of them by the vectors themselves."""
    least = math.cos(math.acos(ALIKE) + 2 * off_by(DIMENSIONS))
    lists = neighbour_pairs(_graph(spark, folder)).filter(F.col("similarity") >= least)
    pairs = cut(lists.select(F.least("id", "neighbour").alias("vec_id_a"), F.greatest("id", "neighbour").alias("vec_id_b")).distinct())
    asked = pairs.select(F.explode(F.array("vec_id_a", "vec_id_b")).alias("vec_id")).distinct()
    vectors = _table(spark, folder, "vector_index").select("vec_id", "embeddings").filter(F.size("embeddings") == DIMENSIONS).join(asked, "vec_id", "left_semi").groupBy("vec_id").agg(F.max("embeddings").alias("v"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    near = pairs.join(vectors.select(F.col("vec_id").alias("vec_id_a"), F.col("v").alias("a")), "vec_id_a").join(vectors.select(F.col("vec_id").alias("vec_id_b"), F.col("v").alias("b")), "vec_id_b")
    return near.filter(dot("a", "b") >= ALIKE * F.sqrt(dot("a", "a") * dot("b", "b"))).select("vec_id_a", "vec_id_b")


def _runs(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "runrow").select("query_id", "hotel_id", "score", "scored_at").filter("score is not null and not isnan(score)")
    return latest(rows, ["query_id", "hotel_id"], "scored_at")


def p5_top(spark: SparkSession, folder: str) -> DataFrame:
    return top_n(_runs(spark, folder), "hotel_id", "score", "query_id", 3, "cast(substring(tie, 2) as bigint)")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_top(spark, folder).select("hotel_id", "query_id")


def p6_weights(spark: SparkSession, folder: str) -> DataFrame:
    return term_weights(_table(spark, folder, "documents"), "doc_id", ["tokens", "descriptor_tags"]).withColumn("weight", F.round("weight", 6))


#: Documents that a distinctive term is in.
FEW = (2, 4)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The terms whose weight is at least what a term of so few documents can have, then by the counts themselves."""
    heavy = term_weights(_table(spark, folder, "documents"), "doc_id", ["tokens", "descriptor_tags"], few=FEW[1])
    exact = F.col("df").between(*FEW) & ((F.col("field") == "descriptor_tags") | (F.col("tf") >= 2))
    return heavy.filter(exact).select("doc_id", "field", "term")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_corpus(_table(spark, folder, "documents"), "doc_id", "text")


def p9_containers(spark: SparkSession, folder: str) -> DataFrame:
    return pack(p8_ids(spark, folder).select("doc_id", F.size("ids").alias("size")), "doc_id", "size", WINDOW)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return p9_containers(spark, folder).filter("piece = 1").select("doc_id")


def p10_repetition(spark: SparkSession, folder: str) -> DataFrame:
    return repetition(_table(spark, folder, "documents"), "doc_id", "text")


def p10_shares(spark: SparkSession, folder: str) -> DataFrame:
    return p10_repetition(spark, folder).select("doc_id", "n_words", F.round("repeated_share", 6).alias("repeated_share"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return p10_repetition(spark, folder).filter("repetitive >= 0.5").select("doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_ranking, p2_found, p2_languages, p3_found, p3_canonical, p4_found, p4_neighbours, p4_search, p5_found, p5_top, p6_found, p6_weights, p7_found, p7_mapping, p8_ids, p9_found, p9_containers, p10_found, p10_repetition, p10_shares)
}

_HITS = """
WITH hits AS (
  SELECT query_id, source_hotel_id, arg_max({'h': hybrid_score, 'v': vector_score, 'b': bm25_score}, logged_at) AS s
  FROM results GROUP BY ALL),
parsed AS (SELECT source_hotel_id, try_cast(replace(trim(review_rating), ',', '.') AS decimal(12,5)) AS x FROM documents),
ratings AS (
  SELECT source_hotel_id, cast(sum(CASE WHEN x > 5 THEN x / 2.0 ELSE x END::decimal(12,5)) AS double) / count(*) AS r
  FROM parsed WHERE x IS NOT NULL GROUP BY 1),
scored AS (
  SELECT query_id AS q, source_hotel_id AS i, s.h AS s0, s.v AS s1, s.b AS s2, r AS s3
  FROM hits LEFT JOIN ratings USING (source_hotel_id))
"""
_RUNS = """
WITH runs AS (
  SELECT query_id, hotel_id, arg_max(score, scored_at) AS score FROM runrow
  WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY ALL),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY hotel_id ORDER BY score DESC, cast(query_id[2:] AS bigint)) AS position FROM runs)
"""
_TERMS = """
WITH tf AS (
  SELECT doc_id, field, term, count(*) AS tf FROM (
    SELECT doc_id, 'tokens' AS field, unnest(tokens) AS term FROM documents
    UNION ALL SELECT doc_id, 'descriptor_tags', unnest(descriptor_tags) FROM documents)
  WHERE term IS NOT NULL GROUP BY ALL),
stats AS (SELECT field, term, count(*) AS df, cast(sum(tf) AS bigint) AS cf FROM tf GROUP BY ALL)
"""
ORACLE: dict[str, str] = {
    "p1_found": _HITS
    + """
SELECT a.q AS query_id, a.i AS source_hotel_id FROM scored a LEFT JOIN scored b ON a.q = b.q AND a.i <> b.i
GROUP BY ALL HAVING coalesce(bool_and(
  coalesce(sign(a.s0 - b.s0), 0) + coalesce(sign(a.s1 - b.s1), 0) + coalesce(sign(a.s2 - b.s2), 0) + coalesce(sign(a.s3 - b.s3), 0) > 0)
  FILTER (b.i IS NOT NULL), true)""",
    "p1_ranking": _HITS
    + """,
ranks AS (
  SELECT q, i,
    CASE WHEN s0 IS NOT NULL THEN rank() OVER (PARTITION BY q ORDER BY s0 DESC NULLS LAST) END AS rank_0,
    CASE WHEN s1 IS NOT NULL THEN rank() OVER (PARTITION BY q ORDER BY s1 DESC NULLS LAST) END AS rank_1,
    CASE WHEN s2 IS NOT NULL THEN rank() OVER (PARTITION BY q ORDER BY s2 DESC NULLS LAST) END AS rank_2,
    CASE WHEN s3 IS NOT NULL THEN rank() OVER (PARTITION BY q ORDER BY s3 DESC NULLS LAST) END AS rank_3
  FROM scored),
fused AS (
  SELECT *, 0.0::double + coalesce(1.0::double / (60 + rank_0), 0) + coalesce(1.0::double / (60 + rank_1), 0)
    + coalesce(1.0::double / (60 + rank_2), 0) + coalesce(1.0::double / (60 + rank_3), 0) AS fused
  FROM ranks)
SELECT q AS query_id, i AS source_hotel_id, rank_0, rank_1, rank_2, rank_3, fused,
  row_number() OVER (PARTITION BY q ORDER BY fused DESC, i) AS position FROM fused""",
    "p4_found": """
WITH v AS (
  SELECT vec_id, any_value(embeddings)::double[64] AS e FROM vector_index
  WHERE len(embeddings) = 64 AND len(list_filter(embeddings, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embeddings, lambda x: x <> 0)) > 0 GROUP BY 1)
SELECT a.vec_id AS vec_id_a, b.vec_id AS vec_id_b FROM v a JOIN v b ON a.vec_id < b.vec_id
WHERE array_cosine_similarity(a.e, b.e) >= 0.965""",
    "p5_found": _RUNS + "SELECT hotel_id, query_id FROM placed WHERE position <= 3",
    "p5_top": _RUNS + "SELECT hotel_id, query_id, score, position FROM placed WHERE position <= 3",
    "p6_weights": _TERMS
    + """,
lengths AS (SELECT doc_id, field, sum(tf) AS length FROM tf GROUP BY 1, 2),
totals AS (SELECT field, count(*) AS records, avg(length) AS mean FROM lengths GROUP BY 1),
parts AS (
  SELECT doc_id, field, term, tf, df, cf, cf / records AS m, tf * log2(1 + mean / length) AS tfn
  FROM tf JOIN stats USING (field, term) JOIN lengths USING (doc_id, field) JOIN totals USING (field))
SELECT doc_id, field, term, tf, df, cf, round((log2(1 + m) + tfn * log2((1 + m) / m)) / (tfn + 1), 6) AS weight FROM parts""",
    "p10_shares": """
WITH words AS (
  SELECT doc_id, regexp_extract_all(regexp_replace(lower(nfc_normalize(coalesce(text, ''))), '([\\p{Han}\\p{Hiragana}\\p{Katakana}])', ' \\1 ', 'g'), '[\\p{L}\\p{M}\\p{N}]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words),
runs AS (SELECT doc_id, i, CASE WHEN i + 3 <= len(w) THEN array_to_string(w[i:i + 3], ' ') END AS run FROM starts),
again AS (SELECT doc_id, i, run IS NOT NULL AND i > min(i) OVER (PARTITION BY doc_id, run) AS again FROM runs),
lying AS (SELECT doc_id, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS lies FROM again),
shares AS (SELECT doc_id, count(*) FILTER (lies) / count(*) AS share FROM lying GROUP BY 1)
SELECT doc_id, cast(len(w) AS int) AS n_words, round(coalesce(share, 0.0), 6) AS repeated_share FROM words LEFT JOIN shares USING (doc_id)""",
    "p6_found": _TERMS + "SELECT doc_id, field, term FROM tf JOIN stats USING (field, term) WHERE df BETWEEN 2 AND 4 AND (field = 'descriptor_tags' OR tf >= 2)",
}
