"""From raw records to the tables that searches read, in one call."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.api import Engine
from staylens.functions import text
from staylens.operators import bm25, quality, store, tagging, vectors
from staylens.session import cut
from staylens.sources import readers, writers

#: Settings and the environment variables that override them.
ENVIRONMENT = {"index": "STAYLENS_INDEX", "records": "STAYLENS_RECORDS", "rules": "STAYLENS_RULES", "context_window": "STAYLENS_CONTEXT_WINDOW"}


def settings(file: Mapping[str, str] | None = None, environment: Mapping[str, str] = os.environ, need: tuple[str, ...] = ()) -> dict[str, str]:
    """Settings of a file, overridden by the environment. Blank values count as none; a needed one that is missing is an error."""
    out = {k: str(v) for k, v in (file or {}).items() if v is not None and str(v).strip()}
    out |= {k: environment[name] for k, name in ENVIRONMENT.items() if environment.get(name, "").strip()}
    missing = [k for k in need if k not in out]
    if missing:
        raise ValueError("no value for " + ", ".join(f"{k} (or {ENVIRONMENT.get(k, k)})" for k in missing))
    return out


def process(records: DataFrame, categories: tagging.Lexicon, descriptors: tagging.Lexicon, **options) -> DataFrame:
    """Raw records that are worth indexing, with clean_text, tokens and tags; of one review id the last row counts.

    Options are those of tagging.contexts, a model of sentiment among them.
    """
    last = store.latest(records.filter("review_id is not null").withColumn("_seq", F.monotonically_increasing_id()), ["review_id"], "_seq").drop("_seq")
    kept = cut(quality.keep_reviews(last))
    tags = tagging.tag_records(kept, "review_id", "review_text", "hotel_name", "location", categories, descriptors, **options)
    return kept.join(tags.select("review_id", "category_tags", "descriptor_tags"), "review_id", "left")


def index(processed: DataFrame, path: str, encoder: Callable[[list], np.ndarray] = vectors.hashed) -> None:
    """Write places, reviews, the lexical index and the vectors of processed records under a path."""
    places, reviews = store.split_store(processed, F.lit(0))
    writers.write_table(places, f"{path}/places")
    writers.write_table(reviews, f"{path}/reviews")
    spark = processed.sparkSession
    places, reviews = spark.read.parquet(f"{path}/places"), spark.read.parquet(f"{path}/reviews")
    docs = store.with_places(readers.indexable(reviews), places)
    weighted = docs.select("_id", bm25.weighted_tokens(F.col("hotel_name"), F.col("types"), F.col("location"), F.coalesce("tokens", text.tokens(F.col("clean_text"))), F.col("category_tags"), F.col("descriptor_tags")).alias("tokens"))
    bm25.build(weighted, "_id", "tokens").write(f"{path}/bm25")
    said = docs.filter(F.trim(F.coalesce("clean_text", F.lit(""))) != "").select("_id", text.document_text(F.col("types"), F.col("location"), F.col("category_tags"), F.col("descriptor_tags"), F.col("clean_text")).alias("text"))
    vectors.write_index(vectors.encode(said, "text", encoder=encoder).drop("text"), f"{path}/vectors", "_id", "embedding")


def engine(spark: SparkSession, path: str, aliases: dict[str, str], keywords: dict[str, list[str]], descriptors: list[str], synonyms: dict[str, list[str]] | None = None) -> Engine:
    """Searches over what index() wrote."""
    reviews = spark.read.parquet(f"{path}/reviews").select(F.col("_id").alias("doc"), "source_hotel_id", "review_text", "category_tags")
    return Engine(reviews, spark.read.parquet(f"{path}/places"), bm25.Index.read(spark, f"{path}/bm25"), vectors.read_index(spark, f"{path}/vectors"), aliases, keywords, descriptors, synonyms)
