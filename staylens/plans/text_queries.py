"""Queries over texts, tags, pages and keyed tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.functions import fixed, parse, text
from staylens.functions.lexicon import rules
from staylens.operators import quality, store, summary, tagging
from staylens.plans import vocabulary
from staylens.session import spread
from staylens.plans.sql import any_of, array, normalized, squeezed, stripped, tokens_of


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table whose texts are worked on: over all cores, however few row groups it is in."""
    return spread(table(spark, folder, name))


def text_clean(spark, folder):
    return texts(spark, folder, "reviews").select("_id", text.clean(F.col("review_text")).alias("clean"))


def text_normalize(spark, folder):
    return texts(spark, folder, "reviews").select("_id", text.normalize(F.col("review_text")).alias("normal"))


def text_tokens(spark, folder):
    return texts(spark, folder, "documents").select("doc_id", text.tokens(F.col("text")).alias("tokens"), text.words(F.col("text")).alias("words"))


def stopword_filter(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text.without(F.col("tokens"), fixed.STOPWORDS).alias("tokens"))


def token_forms(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.array_sort(text.forms(F.col("descriptor_tags"))).alias("forms"))


def token_ngrams(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text.ngrams(F.col("tokens"), 3, " ").alias("trigrams"))


def sentence_split(spark, folder):
    return texts(spark, folder, "documents").select("doc_id", text.sentences(F.col("text")).alias("sentences"))


def negative_tag_filter(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text.positive_tags(F.col("descriptor_tags")).alias("tags"))


def suggestions(spark, folder):
    return table(spark, folder, "queries").select("query_id", F.posexplode(text.suggestions(F.col("query"))).alias("place", "suggestion"))


def spam_filter(spark, folder):
    return texts(spark, folder, "reviews").filter(~quality.is_spam(F.col("review_text"))).select("_id", "crawled_at")


def language_filter(spark, folder):
    return texts(spark, folder, "documents").select("doc_id", quality.is_vietnamese(F.col("text")).alias("vietnamese"), quality.is_vietnamese_short(F.col("text")).alias("vietnamese_short"))


def pipeline_filter(spark, folder):
    return quality.keep_reviews(texts(spark, folder, "documents").drop("tokens"), "text").select("doc_id", "clean_text", F.size("tokens").alias("n_tokens"))


def tag_conflict_check(spark, folder):
    return table(spark, folder, "documents").select("doc_id", quality.tag_conflicts(F.col("descriptor_tags")).alias("conflicts")).filter(F.size("conflicts") > 0)


def score_to_5(spark, folder):
    return table(spark, folder, "documents").select("doc_id", parse.score_to_5(F.col("review_rating")).alias("score"))


def iso_timestamp(spark, folder):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, folder, "events").select("event_id", parse.iso_timestamp(ms).alias("from_ms"), parse.iso_timestamp(F.floor(ms / 1000)).alias("from_s"))


def review_id(spark, folder):
    own = F.when(F.pmod(F.length("_id"), F.lit(2)) == 0, F.col("source_review_id"))
    return table(spark, folder, "reviews").select("_id", parse.review_id("stay", F.col("source_hotel_id"), own, F.col("review_text"), F.col("review_rating"), F.col("review_date")).alias("made"))


_URL = "concat('https://stay.invalid/vi-vn/hotel/detail?', CASE length(_id) % 3 WHEN 0 THEN concat('spec=1.1.HOTEL.', _id, '.Nha-Moi.1') WHEN 1 THEN concat('a=b&hotel_id=', _id) ELSE concat('x-', _id, '?y') END)"


def hotel_id_from_url(spark, folder):
    return table(spark, folder, "places").withColumn("url", F.expr(_URL)).select("url", parse.hotel_id(F.col("url")).alias("hotel_id")).distinct()


_PAGE = """concat('<html><head><title>', coalesce(hotel_name, ''), '</title></head><body><a href="/vi-vn/hotel/detail?spec=1.1.HOTEL.', _id, '.Nha-Moi.1">x</a><a href="/vi-vn/hotel/detail?spec=1.1.HOTEL.', _id, '.Nha-Moi.1">y</a><a href="/b?spec=2.2.HOTEL.9', _id, '.Cu-La.2&c=d">z</a></body></html>')"""


def page_targets(spark, folder):
    pages = table(spark, folder, "places").select("_id", F.expr(_PAGE).alias("html")).distinct()
    return pages.select("_id", F.explode(parse.page_targets(F.col("html"))).alias("t")).select("_id", "t.spec", "t.hotel_id", "t.name").distinct()


def place_type_cascade(spark, folder):
    none = F.lit(None).cast("string")
    return table(spark, folder, "places").select("_id", "hotel_name", F.array_join(parse.page_types(none, F.col("hotel_name"), F.col("hotel_name")), ",").alias("kinds")).distinct()


def address_candidates(spark, folder):
    return table(spark, folder, "places").select("_id", "location", "updated_at", parse.is_address(F.col("location"), F.lit("")).alias("address")).distinct()


def name_keys(spark, folder):
    return table(spark, folder, "places").select("_id", "hotel_name", parse.name_key(F.col("hotel_name")).alias("key")).distinct()


def payload_rows(spark, folder):
    """Reviews written as captured answers and read again: originals of more than ten characters in Vietnamese."""
    rows = table(spark, folder, "reviews").filter("review_text is not null").select("_id", "review_text", "review_rating").distinct()
    status = F.when(F.pmod(F.length("review_text"), F.lit(5)) == 0, "TRANSLATED").otherwise("ORIGINAL")
    one = F.struct(F.col("_id").alias("reviewId"), F.col("review_text").alias("reviewOriginalText"), status.alias("translationStatus"), F.col("review_rating").alias("reviewScore"))
    payload = F.to_json(F.struct(F.struct(F.array(one).alias("reviews"), F.lit(False).alias("hasNext")).alias("data")))
    read = rows.select(F.explode(parse.payload_reviews(payload)).alias("r")).select("r.*")
    kept = read.filter((F.col("translationStatus") == "ORIGINAL") & (F.length("reviewOriginalText") > 10) & quality.is_vietnamese_short(F.col("reviewOriginalText")))
    return kept.select(F.col("reviewId").alias("review_id"), F.col("reviewOriginalText").alias("review_text"), parse.score_to_5(F.col("reviewScore")).alias("score"))


def dedup_first(spark, folder):
    return store.first(table(spark, folder, "reviews").select("_id", "crawled_at", "review_rating"), ["_id"], "crawled_at")


def dedup_last(spark, folder):
    return store.latest(table(spark, folder, "reviews").select("_id", "crawled_at", "review_rating"), ["_id"], "crawled_at")


def mode_canonical(spark, folder):
    return store.mode(table(spark, folder, "places"), "_id", "hotel_name", "updated_at")


def upsert_last_wins(spark, folder):
    rows = table(spark, folder, "places").select("_id", "hotel_name", "rating", "updated_at")
    old = store.latest(rows.filter("updated_at < timestamp '2024-01-01'"), ["_id"], "updated_at")
    return store.upsert(old, rows.filter("updated_at >= timestamp '2024-01-01'"), ["_id"], "updated_at")


def _places(spark, folder):
    return store.latest(table(spark, folder, "places"), ["_id"], "updated_at")


def review_place_join(spark, folder):
    reviews = table(spark, folder, "reviews").select("_id", "source_hotel_id", "crawled_at")
    return store.with_places(reviews, _places(spark, folder).select("_id", "hotel_name", "rating")).distinct()


def semi_anti_join(spark, folder):
    hotels = table(spark, folder, "places").select(F.col("_id").alias("source_hotel_id")).distinct()
    docs = table(spark, folder, "documents").select("doc_id", "source_hotel_id")
    return docs.join(hotels, "source_hotel_id", "left_semi").withColumn("known", F.lit(True)).unionByName(docs.join(hotels, "source_hotel_id", "left_anti").withColumn("known", F.lit(False)))


def lookup_join(spark, folder):
    customers, nations = table(spark, folder, "customer").select("c_custkey", "c_nationkey"), table(spark, folder, "nation")
    return store.lookup(customers, nations, "c_nationkey", "n_nationkey", "nation_").select("c_custkey", "nation_n_name")


def vector_text(spark, folder):
    rows = store.with_places(table(spark, folder, "reviews").drop("crawled_at"), _places(spark, folder)).filter(F.trim(F.coalesce("clean_text", F.lit(""))) != "")
    return rows.select("_id", text.document_text(F.col("types"), F.col("location"), F.col("category_tags"), F.col("descriptor_tags"), F.col("clean_text")).alias("text")).distinct()


def _tokens(spark, folder):
    return texts(spark, folder, "documents").select("doc_id", text.tokens(text.normalize(F.col("text"))).alias("t"))


def phrase_hits(spark, folder):
    return tagging.phrase_hits(_tokens(spark, folder), "doc_id", "t", rules(vocabulary.DESCRIPTORS))


def category_tagging(spark, folder):
    return tagging.category_tags(_tokens(spark, folder), "doc_id", "t", rules(vocabulary.CATEGORIES))


def interval_merge(spark, folder):
    return tagging.merge_overlaps(tagging.phrase_hits(_tokens(spark, folder), "doc_id", "t", rules(vocabulary.DESCRIPTORS)), "doc_id")


def _contexts(spark, folder):
    return tagging.contexts(_tokens(spark, folder), "doc_id", "t", rules(vocabulary.DESCRIPTORS), subjects=vocabulary.SUBJECTS, exclusions=vocabulary.EXCLUSIONS)


def descriptor_contexts(spark, folder):
    return _contexts(spark, folder)


def tag_assign(spark, folder):
    return tagging.assign_tags(_contexts(spark, folder), "doc_id").select("doc_id", "tags", F.array_sort(F.map_keys("phrases")).alias("matched"))


def review_summary(spark, folder):
    return summary.summarise(texts(spark, folder, "documents"), "source_hotel_id", "doc_id", "text")


QUERIES = {
    f.__name__: f
    for f in (
        text_clean, text_normalize, text_tokens, stopword_filter, token_forms, token_ngrams, sentence_split, negative_tag_filter, suggestions, spam_filter, language_filter, pipeline_filter, tag_conflict_check, score_to_5, iso_timestamp, review_id, hotel_id_from_url, page_targets, place_type_cascade, address_candidates, name_keys, payload_rows,
        dedup_first, dedup_last, mode_canonical, upsert_last_wins, review_place_join, semi_anti_join, lookup_join, vector_text, phrase_hits, category_tagging, interval_merge, descriptor_contexts, tag_assign, review_summary,
    )
}

_VI = f"regexp_matches(lower(%s), '[{fixed.VIETNAMESE_LETTERS}]')"
_SHORT_VI = f"({_VI} OR (length(%s) < 50 AND {any_of('lower(%s)', fixed.PLAIN_VIETNAMESE_WORDS)}))".replace("%s", "{0}")
_LONG_VI = f"({_VI} OR {any_of('lower(%s)', fixed.VIETNAMESE_WORDS)})".replace("%s", "{0}")


def _spam(x: str) -> str:
    run = f"len(list_filter(range(1, length({x}) - 6), lambda i: len(list_distinct(string_split(substr({x}, i, 8), ''))) = 1 AND substr({x}, i, 1) <> chr(10))) > 0"
    return f"(length({x}) < 8 OR {run} OR {any_of(f'lower({x})', fixed.SPAM_PHRASES)})"


def _score(x: str) -> str:
    value = f"try_cast(replace(trim({x}), ',', '.') AS double)"
    return f"CASE WHEN {value} IS NULL THEN '' WHEN {value} > 5 THEN format('{{:.1f}}', {value} / 2) ELSE format('{{:.1f}}', {value}) END"


def _positive(tags: str) -> str:
    bad = " AND ".join([f"NOT starts_with(t, '{p}')" for p in fixed.NEGATIVE_PREFIXES])
    return f"list_filter(list_transform(coalesce({tags}, []), lambda t: replace(lower(trim(t)), ' ', '_')), lambda t: t <> '' AND {bad} AND NOT list_contains({array(fixed.NEGATIVE_TAGS)}, t))"


def _as_written(tags: str) -> str:
    bad = " AND ".join([f"NOT starts_with(lower(trim(t)), '{p}')" for p in fixed.NEGATIVE_PREFIXES])
    return f"list_filter(coalesce({tags}, []), lambda t: trim(t) <> '' AND {bad} AND NOT list_contains({array(fixed.NEGATIVE_TAGS)}, lower(trim(t))))"


_KINDS = " ".join(f"WHEN {any_of('lower(hotel_name)', words)} THEN '{kind}'" for kind, words in fixed.PAGE_LODGING.items())
_NAMED = ", ".join(f"CASE WHEN {any_of('lower(hotel_name)', words)} THEN '{kind}' END" for kind, words in fixed.NAME_LODGING.items())
_PLACES = "places_now AS (SELECT _id, max({'u': updated_at, 'types': types, 'location': location, 'rating': rating, 'hotel_name': hotel_name}) AS m FROM places GROUP BY 1), pl AS (SELECT _id, m.types AS types, m.location AS location, m.rating AS rating, m.hotel_name AS hotel_name FROM places_now)"


def _lexicon(tags: dict) -> str:
    last = {p: (t, n) for p, t, n in rules(tags)}
    return "lexicon(phrase, tag, negative, size) AS (VALUES " + ", ".join(f"('{p}', '{t}', {n}, {len(p.split())})" for p, (t, n) in last.items()) + ")"


def _hits(tags: dict) -> str:
    return f"""toks AS (SELECT doc_id, {tokens_of(normalized("coalesce(text, '')"))} AS t FROM documents),
places_ AS (SELECT doc_id, t, unnest(range(len(t))) AS start FROM toks),
{_lexicon(tags)},
hits AS (
  SELECT doc_id, cast(start AS int) AS start, cast(start + g.size AS int) AS "end", g.phrase, tag, negative
  FROM (SELECT doc_id, start, size, array_to_string(t[start + 1:start + size], ' ') AS phrase
    FROM places_, (SELECT DISTINCT size FROM lexicon) WHERE start + size <= len(t)) g JOIN lexicon USING (phrase))"""


_MERGE = """marked AS (
  SELECT *, CASE WHEN start < max("end") OVER (PARTITION BY doc_id ORDER BY start, "end", tag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS b FROM {src}),
islands AS (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY start, "end", tag ROWS UNBOUNDED PRECEDING) AS island FROM marked),
merged AS (
  SELECT doc_id, min(start) AS start, max("end") AS "end", bool_or(negative) AS negative,
    string_agg(tag, '|' ORDER BY start, "end", tag) AS tag, string_agg(phrase, ' + ' ORDER BY start, "end", tag) AS phrase
  FROM islands GROUP BY doc_id, island)"""
_SUBJECT = " AND ".join(f"(tag <> '{tag}' OR len(list_filter(t[greatest(start - 15, 0) + 1:start + 15], lambda x: len(list_filter({array(words)}, lambda s: contains(x, s) OR contains(s, x))) > 0)) > 0)" for tag, words in vocabulary.SUBJECTS.items())
_EXCLUDED = " AND ".join(f"(tag <> '{tag}' OR NOT {any_of("array_to_string(t, ' ')", words)})" for tag, words in vocabulary.EXCLUSIONS.items())
_CONTEXTS = f"""{_hits(vocabulary.DESCRIPTORS)},
valid AS (SELECT h.* FROM hits h JOIN toks USING (doc_id) WHERE {_SUBJECT} AND {_EXCLUDED}),
{_MERGE.format(src="valid")},
around AS (
  SELECT m.*, array_to_string(t[greatest((start + "end") // 2 - 3, 0) + 1:(start + "end") // 2 + 4], ' ') AS context
  FROM merged m JOIN toks USING (doc_id)),
counted AS (
  SELECT *, len(list_intersect(string_split(context, ' '), {array(fixed.POSITIVE_WORDS)})) AS up,
    len(list_intersect(string_split(context, ' '), {array(fixed.NEGATIVE_WORDS)})) AS down FROM around),
contexts AS (
  SELECT doc_id, start, "end", negative, tag, phrase, context,
    CASE WHEN up > down THEN 'positive' WHEN down > up THEN 'negative' ELSE 'neutral' END AS sentiment FROM counted)"""

ORACLE = {
    "text_clean": f"SELECT _id, {squeezed(f"regexp_replace(regexp_replace(coalesce(review_text, ''), 'https?://[^{fixed.SPACE}]+|www\\.[^{fixed.SPACE}]+', ' ', 'g'), chr(8203), ' ', 'g')")} AS clean FROM reviews",
    "text_normalize": f"SELECT _id, {normalized("coalesce(review_text, '')")} AS normal FROM reviews",
    "text_tokens": f"SELECT doc_id, {tokens_of("coalesce(text, '')")} AS tokens, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}_]+'), lambda t: t <> '') AS words FROM documents",
    "stopword_filter": f"SELECT doc_id, list_filter(tokens, lambda t: NOT list_contains({array(fixed.STOPWORDS)}, lower(t))) AS tokens FROM documents",
    "token_forms": "SELECT doc_id, list_sort(list_distinct(list_filter(flatten(list_transform(list_filter(list_transform(descriptor_tags, lambda t: lower(trim(t))), lambda t: t <> ''), lambda t: list_concat([t], string_split(t, '_')))), lambda t: t <> ''))) AS forms FROM documents",
    "token_ngrams": "SELECT doc_id, CASE WHEN tokens IS NOT NULL AND len(tokens) >= 3 THEN list_transform(range(1, len(tokens) - 1), lambda i: array_to_string(tokens[i:i + 2], ' ')) ELSE [] END AS trigrams FROM documents",
    "sentence_split": f"SELECT doc_id, list_filter(string_split(regexp_replace({squeezed("coalesce(text, '')")}, '([.!?]) ', '\\1' || chr(10), 'g'), chr(10)), lambda s: s <> '') AS sentences FROM documents",
    "negative_tag_filter": f"SELECT doc_id, {_positive('descriptor_tags')} AS tags FROM documents",
    "suggestions": "WITH q AS (SELECT query_id, query, list_filter(string_split_regex(lower(trim(query)), ' +'), lambda t: t <> '') AS w FROM queries), u AS (SELECT query_id, query, array_to_string(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: list_position(w, x[1]) = x[2]), lambda x: x[1]), ' ') AS o FROM q) SELECT query_id, cast(unnest(range(4)) AS int) AS place, unnest([query, 'khách sạn ' || o, 'resort ' || o, 'homestay ' || o]) AS suggestion FROM u",
    "spam_filter": f"WITH r AS (SELECT _id, crawled_at, {stripped("coalesce(review_text, '')")} AS v FROM reviews) SELECT _id, crawled_at FROM r WHERE NOT {_spam('v')}",
    "language_filter": f"WITH d AS (SELECT doc_id, coalesce(text, '') AS v FROM documents) SELECT doc_id, {_LONG_VI.format('v')} AS vietnamese, {_SHORT_VI.format('v')} AS vietnamese_short FROM d",
    "pipeline_filter": f"""WITH d AS (SELECT doc_id, {squeezed(f"regexp_replace(regexp_replace(coalesce(text, ''), 'https?://[^{fixed.SPACE}]+|www\\.[^{fixed.SPACE}]+', ' ', 'g'), chr(8203), ' ', 'g')")} AS c FROM documents),
k AS (SELECT doc_id, {normalized('c')} AS clean_text FROM d WHERE c <> '' AND NOT {_spam('c')} AND {_LONG_VI.format('c')}),
t AS (SELECT doc_id, clean_text, cast(len(list_filter({tokens_of('clean_text')}, lambda t: NOT list_contains({array(fixed.STOPWORDS)}, t))) AS int) AS n_tokens FROM k)
SELECT * FROM t WHERE n_tokens > 0""",
    "tag_conflict_check": "WITH c AS (SELECT doc_id, list_sort(list_distinct(list_filter(descriptor_tags, lambda t: NOT starts_with(t, '!') AND list_contains(descriptor_tags, '!' || t)))) AS conflicts FROM documents) SELECT * FROM c WHERE len(conflicts) > 0",
    "score_to_5": f"SELECT doc_id, {_score('review_rating')} AS score FROM documents",
    "iso_timestamp": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS from_ms, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS from_s FROM events",
    "review_id": f"SELECT _id, 'stay_' || source_hotel_id || '_' || CASE WHEN length(_id) % 2 = 0 AND coalesce(source_review_id, '') <> '' THEN source_review_id ELSE substr(sha1(concat_ws('|', source_hotel_id, lower({stripped("coalesce(review_text, '')")}), coalesce(review_rating, ''), coalesce(review_date, ''))), 1, 16) END AS made FROM reviews",
    "hotel_id_from_url": f"SELECT DISTINCT {_URL} AS url, CASE WHEN length(_id) >= 5 THEN _id ELSE '' END AS hotel_id FROM places",
    "page_targets": "SELECT DISTINCT _id, unnest(['1.1.HOTEL.' || _id || '.Nha-Moi.1', '2.2.HOTEL.9' || _id || '.Cu-La.2']) AS spec, unnest([_id, '9' || _id]) AS hotel_id, unnest(['Nha Moi', 'Cu La']) AS name FROM places",
    "place_type_cascade": f"WITH k AS (SELECT DISTINCT _id, hotel_name, coalesce(CASE {_KINDS} END, 'hotel') AS base, array_to_string(list_filter([{_NAMED}], lambda x: x IS NOT NULL), ',') AS named FROM places) SELECT _id, hotel_name, CASE WHEN base = 'hotel' AND named <> '' THEN 'hotel,' || named ELSE base END AS kinds FROM k",
    "address_candidates": f"WITH a AS (SELECT DISTINCT _id, location, updated_at, {squeezed("coalesce(location, '')")} AS v FROM places) SELECT _id, location, updated_at, length(v) BETWEEN 10 AND 160 AND NOT {any_of('lower(v)', fixed.REVIEW_LIKE)} AND (contains(v, ',') OR regexp_matches(v, '\\p{{Nd}}') OR {any_of('lower(v)', fixed.ADDRESS_WORDS)}) AS address FROM a",
    "name_keys": f"SELECT DISTINCT _id, hotel_name, {squeezed("regexp_replace(replace(lower(coalesce(hotel_name, '')), '&', ' and '), '[^0-9a-zA-ZÀ-ỹđĐ'' ]+', ' ', 'g')")} AS key FROM places",
    "payload_rows": f"WITH r AS (SELECT DISTINCT _id, review_text, review_rating FROM reviews WHERE review_text IS NOT NULL) SELECT _id AS review_id, review_text, {_score('review_rating')} AS score FROM r WHERE length(review_text) % 5 <> 0 AND length(review_text) > 10 AND {_SHORT_VI.format('review_text')}",
    "dedup_first": "SELECT _id, crawled_at, review_rating FROM reviews QUALIFY row_number() OVER (PARTITION BY _id ORDER BY crawled_at, review_rating NULLS FIRST) = 1",
    "dedup_last": "SELECT _id, crawled_at, review_rating FROM reviews QUALIFY row_number() OVER (PARTITION BY _id ORDER BY crawled_at DESC, review_rating DESC NULLS LAST) = 1",
    "mode_canonical": "WITH c AS (SELECT _id, hotel_name, count(*) AS rows, min(updated_at) AS first FROM places WHERE trim(coalesce(hotel_name, '')) <> '' GROUP BY 1, 2) SELECT _id, hotel_name, rows FROM c QUALIFY row_number() OVER (PARTITION BY _id ORDER BY rows DESC, first, hotel_name DESC) = 1",
    "upsert_last_wins": "SELECT _id, hotel_name, rating, updated_at FROM (SELECT DISTINCT * EXCLUDE (types) FROM places) QUALIFY row_number() OVER (PARTITION BY _id ORDER BY updated_at DESC, hotel_name DESC NULLS LAST, rating DESC NULLS LAST) = 1",
    "review_place_join": f"WITH {_PLACES} SELECT DISTINCT r._id, source_hotel_id, crawled_at, hotel_name, rating FROM reviews r JOIN pl ON trim(r.source_hotel_id) = trim(pl._id)",
    "semi_anti_join": "SELECT doc_id, source_hotel_id, coalesce(source_hotel_id IN (SELECT _id FROM places), false) AS known FROM documents",
    "lookup_join": "SELECT c_custkey, n_name AS nation_n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey",
    "vector_text": f"""WITH {_PLACES},
r AS (SELECT DISTINCT r._id, types, location, {_as_written('category_tags')} AS ct, {_as_written('descriptor_tags')} AS dt, clean_text FROM reviews r JOIN pl ON trim(r.source_hotel_id) = trim(pl._id) WHERE trim(coalesce(clean_text, '')) <> '')
SELECT DISTINCT _id, concat_ws('. ', CASE WHEN len(types) > 0 THEN 'Types: ' || array_to_string(types, ', ') END, CASE WHEN {stripped("coalesce(location, '')")} <> '' THEN 'Location: ' || {stripped('location')} END,
  CASE WHEN len(ct) > 0 THEN 'Category tags: ' || array_to_string(ct, ', ') END, CASE WHEN len(dt) > 0 THEN 'Descriptor tags: ' || array_to_string(dt, ', ') END, 'Review: ' || {stripped('clean_text')}) AS text FROM r""",
    "phrase_hits": f"WITH {_hits(vocabulary.DESCRIPTORS)} SELECT * FROM hits",
    "category_tagging": f"""WITH RECURSIVE {_hits(vocabulary.CATEGORIES)},
longest AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id, start ORDER BY "end" DESC) = 1),
walk AS (
  SELECT doc_id, arg_min({{'s': start, 'e': "end", 't': tag, 'n': negative}}, start) AS h FROM longest GROUP BY doc_id
  UNION ALL
  SELECT w.doc_id, (SELECT arg_min({{'s': l.start, 'e': l."end", 't': l.tag, 'n': l.negative}}, l.start) FROM longest l WHERE l.doc_id = w.doc_id AND l.start >= w.h.e) AS h FROM walk w WHERE w.h IS NOT NULL),
named AS (SELECT doc_id, CASE WHEN bool_or(h.n) THEN '!' ELSE '' END || h.t AS name, min(h.s) AS first FROM walk WHERE h IS NOT NULL GROUP BY doc_id, h.t)
SELECT doc_id, list(name ORDER BY first) AS tags FROM named GROUP BY 1""",
    "interval_merge": f"WITH {_hits(vocabulary.DESCRIPTORS)}, {_MERGE.format(src='hits')} SELECT * FROM merged",
    "descriptor_contexts": f"WITH {_CONTEXTS} SELECT * FROM contexts",
    "tag_assign": f"""WITH {_CONTEXTS},
by_tag AS (
  SELECT doc_id, string_split(tag, '|')[1] AS t, min(start) AS first, count(*) FILTER (sentiment <> 'neutral') AS n,
    bool_or(CASE WHEN sentiment = 'neutral' THEN negative ELSE sentiment = 'negative' END) AS bad FROM contexts GROUP BY ALL)
SELECT doc_id, list(CASE WHEN bad THEN '!' ELSE '' END || t ORDER BY first, t) AS tags,
  list_sort(coalesce(list(CASE WHEN bad THEN '!' ELSE '' END || t) FILTER (n > 0), [])) AS matched FROM by_tag GROUP BY 1""",
    "review_summary": f"""WITH s AS (SELECT source_hotel_id AS g, doc_id, list_filter(string_split(regexp_replace({squeezed("coalesce(text, '')")}, '([.!?]) ', '\\1' || chr(10), 'g'), chr(10)), lambda s: s <> '') AS ss FROM documents),
p AS (SELECT g, doc_id, unnest(ss) AS sentence, unnest(range(len(ss))) AS n FROM s),
once AS (SELECT g, sentence, count(*) AS copies, min({{'d': doc_id, 'n': n}}) AS first FROM p GROUP BY 1, 2),
w AS (SELECT g, sentence, copies, first, unnest(list_filter(regexp_extract_all(lower(sentence), '[a-zA-ZÀ-ỹđ_]+'), lambda x: length(x) >= 3)) AS word FROM once),
o AS (SELECT g, word, sum(copies) AS often FROM w GROUP BY 1, 2),
sc AS (SELECT once.g, once.sentence, once.first, cast(coalesce(sum(often), 0) AS bigint) AS score FROM once LEFT JOIN w ON once.sentence = w.sentence AND once.g = w.g LEFT JOIN o ON w.word = o.word AND w.g = o.g GROUP BY 1, 2, 3)
SELECT g AS source_hotel_id, cast(row_number() OVER (PARTITION BY g ORDER BY score DESC, first) AS int) AS place, sentence, score FROM sc WHERE g IS NOT NULL QUALIFY place <= 3""",
}
