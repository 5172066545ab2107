"""Captured answers of a review service as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.functions import parse
from staylens.functions.text import strip
from staylens.operators import quality, store


def reviews(df: DataFrame, payload_col: str, hotel_col: str, order_col: str, source: str) -> DataFrame:
    """(review_id, source_review_id, hotel, review_text, review_rating, review_date): the reviews that captured answers give.

    What counts is said by parse.original_reviews; texts must be Vietnamese besides. Of several
    rows of one review id the first counts: by `order_col`, then by its place in the answer.
    """
    found = df.select(F.col(hotel_col).alias("hotel"), F.col(order_col).alias("_order"), F.posexplode(parse.original_reviews(F.col(payload_col))).alias("_at", "r"))
    said, own, rating = strip("r.reviewOriginalText"), strip(F.coalesce("r.reviewId", F.lit(""))), parse.score_to_5(F.col("r.reviewScore"))
    found = found.filter(quality.is_vietnamese_short(F.col("r.reviewOriginalText")))
    rows = found.select(parse.review_id(source, F.col("hotel"), own, said, rating, F.col("r.reviewTimestamp")).alias("review_id"), "_order", "_at", own.alias("source_review_id"), "hotel", said.alias("review_text"), rating.alias("review_rating"), parse.iso_timestamp(F.col("r.reviewTimestamp")).alias("review_date"))
    return store.first(rows, ["review_id"], "_order", "_at").drop("_order", "_at")
