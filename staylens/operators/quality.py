"""Predicates that decide which reviews are kept, and data-quality checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.functions import fixed, text
from staylens.session import once


def is_spam(review: Column, low: Column | None = None) -> Column:
    """Empty, shorter than eight characters, one character eight times in a row, or an advertisement.

    `low` is the text in lower case where it is known, of a text without white space at its ends.
    """
    value = text.strip(F.coalesce(review, F.lit(""))) if low is None else review
    return (F.length(value) < 8) | value.rlike(r"(?d)(.)\1{7,}") | text.contains_any(F.lower(value) if low is None else low, fixed.SPAM_PHRASES)


def is_vietnamese(review: Column, low: Column | None = None) -> Column:
    """With a letter that Vietnamese has, or a common word. Letters that French shares count too."""
    low = F.lower(F.coalesce(review, F.lit(""))) if low is None else low
    return low.rlike(f"[{fixed.VIETNAMESE_LETTERS}]") | text.contains_any(low, fixed.VIETNAMESE_WORDS)


def is_vietnamese_short(review: Column) -> Column:
    """The stricter variant: a letter of Vietnamese, or a short text with a common word without accents."""
    value = F.coalesce(review, F.lit(""))
    return F.lower(value).rlike(f"[{fixed.VIETNAMESE_LETTERS}]") | ((F.length(value) < 50) & text.contains_any(F.lower(value), fixed.PLAIN_VIETNAMESE_WORDS))


def keep_reviews(df: DataFrame, text_col: str = "review_text", stopwords: list[str] = fixed.STOPWORDS) -> DataFrame:
    """The rows worth indexing, with clean_text and tokens: clean, no spam, Vietnamese, with tokens left."""
    rows = once(df, clean_text=text.clean(F.col(text_col)))
    rows = once(rows, low_text=F.lower("clean_text"))
    rows = rows.filter((F.col("clean_text") != "") & ~is_spam(F.col("clean_text"), F.col("low_text")) & is_vietnamese(F.col("clean_text"), F.col("low_text"))).drop("low_text")
    rows = once(once(rows, clean_text=text.normalize(F.col("clean_text"))), tokens=text.without(text.tokens(F.col("clean_text")), stopwords))
    return rows.filter(F.size("tokens") > 0)


def tag_conflicts(tags: Column) -> Column:
    """Tags of an array that are there with and without the mark of negation."""
    return F.array_sort(F.array_distinct(F.filter(tags, lambda t: ~t.startswith("!") & F.array_contains(tags, F.concat(F.lit("!"), t)))))


def without_unwanted(tags: Column, wishes: Column) -> Column:
    """Whether no tag denies what the query's wishes ask for."""
    denied = F.array_compact(F.array(*[F.when(F.arrays_overlap(wishes, text.words_array(words)), f"!{tag}") for tag, words in fixed.UNWANTED.items()]))
    return ~F.coalesce(F.arrays_overlap(F.transform(tags, lambda t: F.lower(F.trim(t))), denied), F.lit(False))
