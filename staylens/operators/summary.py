"""Extractive summaries: the sentences whose words are frequent in their group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staylens.functions import text
from staylens.session import cut


def summarise(df: DataFrame, group: str, id_col: str, text_col: str, n: int = 3) -> DataFrame:
    """(group, place, sentence, score): the n distinct sentences of each group with the highest score.

    A sentence's score is the sum of how often each of its words (three letters or more) occurs in
    the group's sentences, 0 without such words. Equal scores go by first occurrence: id, then place in the text.
    Equal sentences of a group are one from the start, counted, so that copies cost nothing more.
    """
    parts = df.select(F.col(group).alias("g"), F.col(id_col).alias("id"), F.posexplode(text.sentences(F.col(text_col))).alias("at", "sentence"))
    once = cut(parts.groupBy("g", "sentence").agg(F.count("*").alias("copies"), F.min(F.struct("id", "at")).alias("first")))
    found = F.filter(F.regexp_extract_all(F.lower("sentence"), F.lit("([a-zA-ZÀ-ỹđ_]+)"), 1), lambda w: F.length(w) >= 3)
    # A sentence goes by where it is first; its text is put back to the best only.
    words = once.select("g", "copies", "first", F.explode_outer(found).alias("word"))
    # The distinct words of a group and how often they occur; most of the sum is done before the shuffle.
    often = words.filter("word is not null").groupBy("g", "word").agg(F.sum("copies").alias("often"))
    scored = words.join(often, ["g", "word"], "left").groupBy("g", "first").agg(F.coalesce(F.sum("often"), F.lit(0)).alias("score"))
    order = Window.partitionBy("g").orderBy(F.col("score").desc(), "first")
    best = scored.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)
    best = best.join(once.select("g", "first", "sentence"), ["g", "first"])
    return best.select(F.col("g").alias(group), "place", "sentence", "score")
