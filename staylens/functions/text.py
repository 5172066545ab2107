"""Column functions over text and token arrays; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from staylens.functions import fixed

_WS = f"[{fixed.SPACE}]"


def words_array(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def contains_any(text: Column, phrases: Iterable[str]) -> Column:
    """Whether any phrase is a part of the text. One pattern, so that the text is worked out and read once."""
    quoted = ["\\Q" + phrase.replace("\\E", "\\E\\\\E\\Q") + "\\E" for phrase in phrases]
    return text.rlike("|".join(quoted)) if quoted else F.lit(False)


def strip(text: Column | str) -> Column:
    """Without white space at both ends, of any kind."""
    return F.regexp_replace(text, f"^{_WS}+|{_WS}+$", "")


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{_WS}+", " "))


def clean(text: Column) -> Column:
    """Without links and zero-width spaces, squeezed; null as empty."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), f"https?://[^{fixed.SPACE}]+|www\\.[^{fixed.SPACE}]+", " ")
    return squeeze(F.regexp_replace(text, "\u200b", " "))


def normalize(text: Column) -> Column:
    """Lower case, without punctuation, letters repeated three times or more once, squeezed."""
    text = strip(F.lower(F.coalesce(text, F.lit(""))))
    text = F.regexp_replace(text, rf"[^\p{{L}}\p{{N}}_{fixed.SPACE}]+", " ")
    return squeeze(F.regexp_replace(text, r"([a-zà-ỹđ])\1{2,}", "$1"))


def tokens(text: Column) -> Column:
    """Runs of letters of the Latin script, digits and underscores, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-zA-ZÀ-ỹ0-9_]+)"), 1)


def words(text: Column) -> Column:
    """Parts between anything that isn't a letter, digit or underscore, in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda t: t != "")


def without(array: Column, stopwords: Iterable[str]) -> Column:
    """An array without stop words, letter case aside; order and repeats stay."""
    held = words_array({w.lower() for w in stopwords})
    return F.filter(array, lambda t: ~F.array_contains(held, F.lower(t)))


def forms(array: Column) -> Column:
    """Each token in lower case and its parts between underscores, each once."""
    low = F.filter(F.transform(array, lambda t: F.lower(F.trim(t))), lambda t: t != "")
    parts = F.flatten(F.transform(low, lambda t: F.concat(F.array(t), F.split(t, "_"))))
    return F.array_distinct(F.filter(parts, lambda t: t != ""))


def ngrams(array: Column, n: int, joiner: str = "_") -> Column:
    """All runs of n tokens, joined, in order."""
    places = F.sequence(F.lit(1), F.size(array) - n + 1)
    some = F.transform(places, lambda i: F.array_join(F.slice(array, i, n), joiner))
    return F.when(F.size(array) >= n, some).otherwise(F.array().cast("array<string>"))


def sentences(text: Column) -> Column:
    """Parts after a full stop, question or exclamation mark and white space."""
    return F.filter(F.split(squeeze(F.coalesce(text, F.lit(""))), r"(?<=[.!?]) "), lambda s: s != "")


def is_negative_tag(tag: Column) -> Column:
    """Blank, with a negating prefix, or one of the strong words."""
    value = F.lower(F.trim(F.coalesce(tag, F.lit(""))))
    out = (value == "") | value.isin(fixed.NEGATIVE_TAGS)
    for prefix in fixed.NEGATIVE_PREFIXES:
        out = out | value.startswith(prefix)
    return out


def positive_tags(tags: Column) -> Column:
    """Tags as tokens, without the negative ones."""
    some = F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.replace(F.lower(F.trim(t)), F.lit(" "), F.lit("_")))
    return F.filter(some, lambda t: ~is_negative_tag(t))


def kept_tags(tags: Column) -> Column:
    """Tags as they are written, without the negative ones."""
    return F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda t: ~is_negative_tag(t))


def document_text(types: Column, location: Column, category_tags: Column, descriptor_tags: Column, review: Column) -> Column:
    """The text that a document is embedded by: its filled parts, named, joined by full stops."""

    def listed(name: str, tags: Column) -> Column:
        return F.when(F.size(tags) > 0, F.concat(F.lit(name), F.array_join(tags, ", ")))

    def said(name: str, value: Column) -> Column:
        value = strip(F.coalesce(value, F.lit("")))
        return F.when(value != "", F.concat(F.lit(name), value))

    return F.concat_ws(". ", listed("Types: ", types), said("Location: ", location), listed("Category tags: ", kept_tags(category_tags)), listed("Descriptor tags: ", kept_tags(descriptor_tags)), said("Review: ", review))


def suggestions(query: Column) -> Column:
    """The query and up to four variants of it."""
    once = F.array_join(F.array_distinct(F.filter(F.split(F.lower(F.trim(query)), " +"), lambda t: t != "")), " ")
    return F.array(query, *[F.concat(F.lit(kind + " "), once) for kind in ("khách sạn", "resort", "homestay")])


def lexicon_sentiment(context: Column, positive: Iterable[str] = fixed.POSITIVE_WORDS, negative: Iterable[str] = fixed.NEGATIVE_WORDS) -> Column:
    """positive, negative or neutral by which list more distinct words of the context are in."""
    seen = F.array_distinct(F.split(F.coalesce(context, F.lit("")), " +"))
    up, down = F.size(F.array_intersect(seen, words_array(positive))), F.size(F.array_intersect(seen, words_array(negative)))
    return F.when(up > down, "positive").when(down > up, "negative").otherwise("neutral")
