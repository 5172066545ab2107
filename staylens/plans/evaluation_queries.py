"""Queries over several systems, their pools, labels and adjustments, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.functions import fixed, text
from staylens.functions.lexicon import rules
from staylens.operators import bm25, evaluation, search, tagging, vectors
from staylens.plans import search_queries as S
from staylens.plans import text_queries as T
from staylens.plans import vocabulary
from staylens.plans.sql import any_of, array, normalized, squeezed, tokens_of

DIMENSIONS = 64
SYSTEMS = {"bm25": (0.0, 1.0), "vector": (1.0, 0.0), "hybrid": (0.6, 0.4)}


def _sides(spark, folder, pool: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lexical, dense, docs): the `pool` best scores of the reviews that have a vector, divided by each query's best.

    A query's vector is the row of `embeddings` with its number; queries without one have no dense hits.
    """
    held = T.table(spark, folder, "vector_index").filter(F.size("embeddings") == DIMENSIONS).groupBy("_id").agg(F.max("embeddings").alias("embedding"))
    held = held.filter(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)))
    said = T.table(spark, folder, "reviews").groupBy("_id").agg(F.max("source_hotel_id").alias("source_hotel_id"), F.max("review_text").alias("review_text"))
    docs = held.join(said, "_id").select(F.col("_id").alias("doc"), "source_hotel_id", "review_text", F.array().cast("array<string>").alias("category_tags"), "embedding", text.tokens(F.col("review_text")).alias("tokens"))
    asked = T.table(spark, folder, "queries").filter(S._number() % S.EVERY == 0)
    lexical = bm25.candidates(asked.select("query_id", text.tokens(F.col("query")).alias("tokens")), bm25.build(docs, "doc", "tokens"), pool)
    asking = asked.select(F.col("query_id").alias("query"), S._number().alias("vec_id")).join(T.table(spark, folder, "embeddings"), "vec_id").select("query", "embedding", F.lit(None).cast("long").alias("need"))
    dense = vectors.positive(docs.select("doc", "embedding", F.array().cast("array<bigint>").alias("fits")), asking, "doc", "embedding").withColumnRenamed("score", "vector")
    sides = []
    for rows, score in ((lexical, "bm25"), (dense, "vector")):
        best = bm25.max_normalise(rows.filter(F.col(score) > 0), "query", score).withColumn(score, F.round(score, 9))
        sides.append(bm25.top(best, "query", score, "doc", pool))
    return sides[0], sides[1], docs.select("doc", "source_hotel_id", "review_text", "category_tags")


def three_systems(spark, folder):
    """The ten best hotels of lexical, dense and mixed search for each query."""
    lexical, dense, docs = _sides(spark, folder, S.POOL)
    best = search.systems(lexical, dense, docs, "source_hotel_id", SYSTEMS, 10)
    return best.select("system", "query", "source_hotel_id", F.round("score", 6).alias("score"), "rank")


def pool_three(spark, folder):
    """The hotels to be judged for each query, by the ten best reviews of each side and the ten best hotels of both."""
    lexical, dense, docs = _sides(spark, folder, 10)
    return evaluation.pool_three(lexical, dense, docs, "source_hotel_id")


def _pooled(spark, folder):
    pools = S.pool_union(spark, folder)
    return evaluation.pooled_ranking(pools, "run").unionByName(evaluation.pooled_ranking(pools, "hybrid"))


def pooled_ranking(spark, folder):
    return _pooled(spark, folder)


def ndcg_pooled(spark, folder):
    return evaluation.ndcg_of_list(_pooled(spark, folder), S._grades(spark, folder)).withColumn("ndcg", F.round("ndcg", 6))


def label_counts(spark, folder):
    labels = S.relevance_points(spark, folder).join(T.table(spark, folder, "queries").select("query_id", "bucket_id"), "query_id")
    return evaluation.label_counts(labels, "relevant", ["bucket_id"]).withColumn("percent", F.round("percent", 4))


def no_results(spark, folder):
    queries = T.table(spark, folder, "queries").select(F.col("query_id").alias("query"))
    return evaluation.no_result_rate(S._run(spark, folder).unionByName(S._hybrid_run(spark, folder)), queries).withColumn("no_result", F.round("no_result", 6))


_TOLERANCES = {"ndcg": -0.02, "mrr": -0.02, "recall": -0.03}


def metric_changes(spark, folder):
    """Whether the stored ranking's means by bucket are as good as the hybrid one's."""
    means = S.metrics_by_bucket(spark, folder).filter("bucket is not null")
    out = evaluation.changes(means.filter("system = 'run'"), means.filter("system = 'hybrid'"), "bucket", _TOLERANCES)
    return out.select("bucket", "value", F.round("before", 6).alias("before"), F.round("now", 6).alias("now"), "within")


def adjusted_hits(spark, folder):
    """Stored hits with what place and kind of lodging make of their scores, step by step, and their ranks."""
    asked = S._understood(spark, folder).withColumn("raw", F.col("query")).withColumn("query", F.col("query_id"))
    hits = S._latest_results(spark, folder).filter("hybrid_score is not null and not isnan(hybrid_score)")
    none = F.array().cast("array<string>")
    rolled = hits.select(F.col("query_id").alias("query"), "source_hotel_id", F.col("hybrid_score").alias("score"), F.col("vector_score").alias("vector"), F.col("bm25_score").alias("bm25"), F.lit(None).cast("string").alias("first_doc"), none.alias("texts"), none.alias("tags"), F.col("review_count").alias("reviews"))
    best = search.adjust(rolled, T._places(spark, folder), asked, S.KEYWORDS, search.Settings())
    return best.select("query", "source_hotel_id", "rank", "location_matched", "place_factor", "complaint_factor", "type_factor", F.round("hybrid_score", 6).alias("hybrid_score"))


def prepared_text(spark, folder):
    """What records are tagged by."""
    rows = T.table(spark, folder, "documents")
    return rows.select("doc_id", tagging.prepared(F.col("text"), F.col("hotel_name"), F.col("source")).alias("prepared"))


def tagged_records(spark, folder):
    """Documents with category and descriptor tags by their prepared texts."""
    rows = tagging.tag_records(T.texts(spark, folder, "documents"), "doc_id", "text", "hotel_name", "source", rules(vocabulary.CATEGORIES), rules(vocabulary.DESCRIPTORS), subjects=vocabulary.SUBJECTS, exclusions=vocabulary.EXCLUSIONS)
    return rows.select("doc_id", "category_tags", "descriptor_tags")


def strong_contexts(spark, folder):
    """Contexts of descriptors of which a strong word makes some negative whatever else they say."""
    return tagging.contexts(T._tokens(spark, folder), "doc_id", "t", rules(vocabulary.DESCRIPTORS), strong_negative=fixed.STRONG_NEGATIVE).select("doc_id", "start", "end", "context", "sentiment")


def query_tokens(spark, folder):
    from staylens.operators.understanding import process_query

    return T.table(spark, folder, "queries").select("query_id", process_query(F.col("query")).alias("tokens"))


QUERIES = {f.__name__: f for f in (three_systems, pool_three, pooled_ranking, ndcg_pooled, label_counts, no_results, metric_changes, adjusted_hits, prepared_text, tagged_records, strong_contexts, query_tokens)}

_SIDES = f"""{S._bm25(f"SELECT _id AS doc, {tokens_of("coalesce(review_text, '')")} AS tokens FROM held_docs", S._SOME)},
dense AS (
  SELECT 'Q' || q.vec_id AS query, d._id AS doc, list_dot_product(q.embedding::double[], d.e) AS s FROM embeddings q, held_docs d
  WHERE q.vec_id % {S.EVERY} = 0 AND 'Q' || q.vec_id IN (SELECT query_id FROM queries)),
lex AS (SELECT query, doc, round(bm25 / max(bm25) OVER (PARTITION BY query), 9) AS x FROM scores WHERE bm25 > 0),
den AS (SELECT query, doc, round(s / max(s) OVER (PARTITION BY query), 9) AS x FROM dense WHERE s > 0),
lexical AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY x DESC, doc) AS rank FROM lex WHERE x > 0 QUALIFY rank <= {S.POOL}),
densest AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY x DESC, doc) AS rank FROM den WHERE x > 0 QUALIFY rank <= {S.POOL})"""
_HELD = f"""usable AS (SELECT _id, max(embeddings) AS e FROM vector_index WHERE len(embeddings) = {DIMENSIONS} GROUP BY 1),
held_docs AS (
  SELECT u._id, u.e::double[] AS e, hotel, review_text FROM usable u JOIN (SELECT _id, max(source_hotel_id) AS hotel, max(review_text) AS review_text FROM reviews GROUP BY 1) r USING (_id)
  WHERE len(list_filter(u.e, lambda x: x IS NULL OR isnan(x))) = 0)"""
_WITH = f"WITH {_HELD}, {_SIDES}"
_POOL = S.ORACLE["pool_union"]
_PLACED = """pool AS ({pool}),
pooled AS (
  SELECT 'run' AS system, query, doc, row_number() OVER (PARTITION BY query ORDER BY coalesce(run_rank, 999), doc) AS rank FROM pool
  UNION ALL SELECT 'hybrid', query, doc, row_number() OVER (PARTITION BY query ORDER BY coalesce(hybrid_rank, 999), doc) FROM pool)""".format(pool=_POOL)
_PREPARED = normalized("concat_ws(' ', nullif({}, ''), nullif(hotel_name, ''), nullif(source, ''))".format(squeezed(f"regexp_replace(regexp_replace(coalesce(text, ''), 'https?://[^{fixed.SPACE}]+|www\\.[^{fixed.SPACE}]+', ' ', 'g'), chr(8203), ' ', 'g')")))
_PLACE_OF = " ".join(f"WHEN u.detected_location = '{name}' THEN {any_of('lower(coalesce(pl.location, $$))'.replace('$$', chr(39) * 2), words)}" for name, words in S.KEYWORDS.items())
_OF_PREPARED = lambda sql: sql.replace(tokens_of(normalized("coalesce(text, '')")), tokens_of("prepared")).replace("FROM documents", "FROM ready")
_READY = f"ready AS (SELECT * FROM (SELECT doc_id, {_PREPARED} AS prepared FROM documents) WHERE prepared <> '')"
ORACLE = {
    "three_systems": f"""{_WITH},
both_ AS (SELECT query, doc, coalesce(a.x, 0) AS b, coalesce(d.x, 0) AS v FROM lexical a FULL JOIN densest d USING (query, doc)),
hits AS (SELECT system, query, doc, hotel, vw * v + bw * b AS h FROM both_, (VALUES ('bm25', 0.0::double, 1.0::double), ('vector', 1.0, 0.0), ('hybrid', 0.6, 0.4)) s(system, vw, bw), held_docs WHERE doc = _id AND hotel IS NOT NULL AND vw * v + bw * b > 0),
n AS (SELECT *, row_number() OVER (PARTITION BY system, query, hotel ORDER BY h DESC, doc) AS n FROM hits),
rolled AS (SELECT system, query, hotel, sum(h) AS score FROM n WHERE n <= 5 GROUP BY ALL)
SELECT system, query, hotel AS source_hotel_id, round(score, 6) AS score, cast(row_number() OVER (PARTITION BY system, query ORDER BY score DESC, hotel) AS int) AS rank FROM rolled QUALIFY rank <= 10""",
    "pool_three": f"""{_WITH},
b AS (SELECT query, hotel, sum(x) AS b, max(rank) AS bm25_rank FROM lexical JOIN held_docs ON doc = _id WHERE rank <= 10 AND hotel IS NOT NULL GROUP BY 1, 2),
v AS (SELECT query, hotel, sum(x) AS v, max(rank) AS vector_rank FROM densest JOIN held_docs ON doc = _id WHERE rank <= 10 AND hotel IS NOT NULL GROUP BY 1, 2),
j AS (SELECT query, hotel, bm25_rank, vector_rank, 0.6 * coalesce(b, 0) + 0.4 * coalesce(v, 0) AS h FROM b FULL JOIN v USING (query, hotel)),
n AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(h, 9) DESC, hotel) AS n FROM j)
SELECT query, hotel AS source_hotel_id, cast(bm25_rank AS int) AS bm25_rank, cast(vector_rank AS int) AS vector_rank, cast(CASE WHEN n <= 10 THEN n END AS int) AS hybrid_rank FROM n""",
    "pooled_ranking": f"WITH {_PLACED} SELECT system, query, doc, cast(rank AS int) AS rank FROM pooled",
    "ndcg_pooled": f"""WITH {_PLACED}, {S._RESULTS}, {S._GRADES},
g AS (SELECT p.*, coalesce(grade, 0) AS grade FROM pooled p LEFT JOIN grades USING (query, doc)),
i AS (SELECT *, row_number() OVER (PARTITION BY system, query ORDER BY grade DESC, doc) AS best FROM g),
s AS (SELECT system, query, sum(grade / log2(rank + 1)) FILTER (rank <= 10) AS dcg, sum(grade / log2(best + 1)) FILTER (best <= 10) AS idcg FROM i GROUP BY 1, 2)
SELECT system, query, round(coalesce(dcg / nullif(idcg, 0), 0), 6) AS ndcg FROM s""",
    "label_counts": f"SELECT bucket_id, count(*) AS pairs, cast(sum(relevant) AS bigint) AS relevant, round(100 * avg(relevant), 4) AS percent FROM ({S.ORACLE['relevance_points']}) JOIN queries USING (query_id) GROUP BY 1",
    "no_results": f"""WITH {S._RESULTS}, {S._RUN}, {S._HYBRID}, both_ AS (SELECT system, query FROM run UNION SELECT system, query FROM hyb), n AS (SELECT count(DISTINCT query_id) AS queries FROM queries)
SELECT system, any_value(queries) AS queries, round(1 - count(*) / any_value(queries), 6) AS no_result FROM both_, n WHERE query IN (SELECT query_id FROM queries) GROUP BY 1""",
    "metric_changes": f"""WITH m AS ({S.ORACLE['metrics_by_bucket']}),
c AS (SELECT bucket, unnest(['ndcg', 'mrr', 'recall']) AS value, unnest([b.ndcg, b.mrr, b.recall]) AS before, unnest([a.ndcg, a.mrr, a.recall]) AS now, unnest([-0.02, -0.02, -0.03]::double[]) AS most
  FROM (SELECT * FROM m WHERE system = 'run' AND bucket IS NOT NULL) a JOIN (SELECT * FROM m WHERE system = 'hybrid') b USING (bucket))
SELECT bucket, value, round(before, 6) AS before, round(now, 6) AS now, now - before >= most AS within FROM c""",
    "adjusted_hits": f"""WITH {S._RESULTS}, {T._PLACES}, u AS ({S.ORACLE['query_understanding']}),
j AS (
  SELECT res.query_id AS query, res.source_hotel_id, hybrid_score AS score, coalesce(CASE {_PLACE_OF} END, false) AS location_matched, CASE {S._LODGING.replace('lower(query)', 'lower(queries.query)')} END AS asked,
    list_filter(list_transform(coalesce(types, []), lambda t: lower(trim(t))), lambda t: t <> '') AS own, [{S._SPOKEN.replace('{}', "''").replace('hotel_name', 'pl.hotel_name')}] AS spoken
  FROM res JOIN queries USING (query_id) JOIN u USING (query_id) JOIN pl ON pl._id = res.source_hotel_id WHERE hybrid_score IS NOT NULL AND NOT isnan(hybrid_score)),
f AS (SELECT *, CASE WHEN location_matched THEN 1.8 ELSE 1.0 END::double AS place_factor, CASE WHEN asked IS NULL THEN 1.0 WHEN list_contains(CASE WHEN len(own) > 0 THEN own ELSE spoken END, asked) THEN 1.2 ELSE 0.85 END::double AS type_factor FROM j),
k AS (SELECT *, score * place_factor * 1.0::double * type_factor AS hybrid_score FROM f QUALIFY location_matched OR NOT bool_or(location_matched) OVER (PARTITION BY query))
SELECT query, source_hotel_id, cast(row_number() OVER (PARTITION BY query ORDER BY hybrid_score DESC, source_hotel_id) AS int) AS rank, location_matched, place_factor, 1.0::double AS complaint_factor, type_factor, round(hybrid_score, 6) AS hybrid_score FROM k QUALIFY rank <= 20""",
    "prepared_text": f"SELECT doc_id, {_PREPARED} AS prepared FROM documents",
    "tagged_records": f"""WITH {_READY}, c AS ({_OF_PREPARED(T.ORACLE['category_tagging'])}), d AS ({_OF_PREPARED(T.ORACLE['tag_assign'])})
SELECT doc_id, coalesce(c.tags, []) AS category_tags, coalesce(d.tags, []) AS descriptor_tags FROM ready LEFT JOIN c USING (doc_id) LEFT JOIN d USING (doc_id)""",
    "strong_contexts": f"""WITH {T._CONTEXTS.replace(f"WHERE {T._SUBJECT} AND {T._EXCLUDED}", "")}
SELECT doc_id, start, "end", context, CASE WHEN {any_of('lower(context)', fixed.STRONG_NEGATIVE)} THEN 'negative' ELSE sentiment END AS sentiment FROM contexts""",
    "query_tokens": f"SELECT query_id, list_filter({tokens_of(normalized("coalesce(query, '')"))}, lambda x: NOT list_contains({array(fixed.STOPWORDS)}, x)) AS tokens FROM queries",
}
