"""Keyed tables: which row of a key counts, joins of reviews with places, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row per key, the last by the order columns, then by all others.

    One aggregation with partial results, so that a key with very many rows is reduced where it is read.
    """
    rest = [*order, *[c for c in df.columns if c not in keys and c not in order]]
    return df.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_r")).select(*[F.col(k) if k in keys else F.col(f"_r.{k}").alias(k) for k in df.columns])


def first(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row per key, the first by the order columns, then by all others."""
    rest = [*order, *[c for c in df.columns if c not in keys and c not in order]]
    return df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*[F.col(k) if k in keys else F.col(f"_r.{k}").alias(k) for k in df.columns])


def mode(df: DataFrame, key: str, value: str, seen: str) -> DataFrame:
    """(key, value, rows): the most frequent filled value of each key, of equally frequent ones the first seen."""
    filled = F.coalesce(F.trim(F.col(value)), F.lit("")) != ""
    counted = df.filter(filled).groupBy(key, value).agg(F.count("*").alias("rows"), F.min(seen).alias("first"))
    best = F.max_by(F.struct(value, "rows"), F.struct(F.col("rows"), -F.unix_micros(F.col("first").cast("timestamp")), F.col(value)))
    return counted.groupBy(key).agg(best.alias("b")).select(key, f"b.{value}", "b.rows")


def canonicalise(df: DataFrame, key: str, values: list[str], seen: str) -> DataFrame:
    """df with each value replaced by its key's mode, where it has one. The modes are one row a key."""
    out = df
    for value in values:
        out = out.drop(value).join(mode(df, key, value, seen).drop("rows"), key, "left")
    return out.select(*df.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """old with the rows of new put in by key; of several new rows of a key the last counts. Null keys in new are skipped."""
    fresh = new
    for key in keys:
        fresh = fresh.filter(F.coalesce(F.trim(F.col(key).cast("string")), F.lit("")) != "")
    fresh = latest(fresh, keys, *order)
    return old.join(fresh, keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


def with_places(reviews: DataFrame, places: DataFrame, hotel: str = "source_hotel_id") -> DataFrame:
    """Reviews with their place's columns; reviews of unknown places go. Places are one row an id.

    No side is forced to be broadcast: the optimizer does so where the places are small enough.
    """
    side = places.select(F.trim("_id").alias("_pid"), *[F.col(c) for c in places.columns if c != "_id" and c not in reviews.columns])
    return reviews.join(side, F.trim(F.col(hotel)) == F.col("_pid")).drop("_pid")


def lookup(df: DataFrame, other: DataFrame, key: str, other_key: str, prefix: str) -> DataFrame:
    """df with the other table's columns under a prefix, where its key is found."""
    side = other.select(*[F.col(c).alias(prefix + c) for c in other.columns])
    return df.join(side, F.col(key) == F.col(prefix + other_key), "left")


def split_store(records: DataFrame, seq: Column) -> tuple[DataFrame, DataFrame]:
    """Raw records as places and reviews: places by hotel, reviews by review id, the last row of each."""
    rows = records.withColumn("_seq", seq)
    places = rows.filter(F.coalesce("source_hotel_id", F.lit("")) != "").select(F.col("source_hotel_id").alias("_id"), F.coalesce("place_types", F.array(F.lit("hotel"))).alias("types"), "location", "rating", "hotel_name", "_seq")
    dropped = {"review_id", "hotel_name", "location", "rating", "place_types", "place_type_source"}
    reviews = rows.filter(F.coalesce("review_id", F.lit("")) != "").select(F.col("review_id").alias("_id"), *[c for c in rows.columns if c not in dropped])
    return latest(places, ["_id"], "_seq").drop("_seq"), latest(reviews, ["_id"], "_seq").drop("_seq")
