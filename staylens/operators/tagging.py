"""Tags of a text by phrases: categories, and descriptors with their context and sentiment."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staylens.functions import text
from staylens.session import cut, once

Lexicon = list[tuple[str, str, bool]]

#: The lexicon is part of the plan; it is checked against this number of phrases.
MOST_PHRASES = 5000
_HIT = "struct<start:int,end:int,phrase:string,tag:string,negative:boolean>"


def hits_in(tokens: Column, lexicon: Lexicon) -> Column:
    """Every place where a phrase's words follow one another, as an array of (start, end, phrase, tag, negative) in order.

    Of equal phrases the last counts. Only tokens that a phrase begins with are looked at, and
    there only the phrases that begin so; all of it happens within a row.
    """
    last = {phrase: (tag, negative) for phrase, tag, negative in lexicon}
    if len(last) > MOST_PHRASES:
        raise ValueError(f"the lexicon has more than {MOST_PHRASES} phrases")
    if not last:
        return F.array().cast(f"array<{_HIT}>")
    by_first: dict[str, list[tuple[str, int, str, bool]]] = {}
    for phrase, (tag, negative) in last.items():
        by_first.setdefault(phrase.split()[0], []).append((phrase, len(phrase.split()), tag, negative))
    rules = F.create_map(*[x for first, own in by_first.items() for x in (F.lit(first), F.array(*[F.struct(F.lit(p).alias("phrase"), F.lit(n).alias("size"), F.lit(t).alias("tag"), F.lit(neg).alias("negative")) for p, n, t, neg in own]))])
    starts = F.filter(F.transform(tokens, lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda x: x["t"].isin(list(by_first)))

    def found(s: Column) -> Column:
        fits = F.filter(F.element_at(rules, s["t"]), lambda r: (s["i"] + r["size"] <= F.size(tokens)) & (F.array_join(F.slice(tokens, s["i"] + 1, r["size"]), " ") == r["phrase"]))
        return F.transform(fits, lambda r: F.struct(s["i"].alias("start"), (s["i"] + r["size"]).alias("end"), r["phrase"].alias("phrase"), r["tag"].alias("tag"), r["negative"].alias("negative")))

    return F.coalesce(F.flatten(F.transform(starts, found)), F.array()).cast(f"array<{_HIT}>")


def phrase_hits(df: DataFrame, id_col: str, tokens_col: str, lexicon: Lexicon) -> DataFrame:
    """(id, start, end, phrase, tag, negative): every place where a phrase's words follow one another. Nothing is shuffled."""
    return df.select(F.col(id_col), F.explode(hits_in(F.col(tokens_col), lexicon)).alias("h")).select(id_col, "h.*")


def category_tags(df: DataFrame, id_col: str, tokens_col: str, lexicon: Lexicon) -> DataFrame:
    """(id, tags): each category once, negated if any of its hits is, in the order of the first hits.

    Of hits that overlap the leftmost counts, of those that begin together the longest. Nothing is shuffled.
    """
    rows = once(df.select(id_col, tokens_col), hits=F.array_sort(F.transform(hits_in(F.col(tokens_col), lexicon), lambda h: F.struct(h["start"].alias("start"), (-h["end"]).alias("back"), h["tag"].alias("tag"), h["negative"].alias("negative")))))
    # In order, the longest of a start first: one is taken if it begins where the last taken one has ended.
    one = "struct<start:int,back:int,tag:string,negative:boolean>"
    kind = f"struct<end:int,taken:array<{one}>>"
    taken = F.aggregate(
        "hits",
        F.struct(F.lit(0).alias("end"), F.array().cast(f"array<{one}>").alias("taken")).cast(kind),
        lambda s, h: F.when(h["start"] >= s["end"], F.struct((-h["back"]).alias("end"), F.concat(s["taken"], F.array(h)).alias("taken")).cast(kind)).otherwise(s),
    )["taken"]
    rows = once(rows.filter(F.size("hits") > 0).select(id_col, "hits"), taken=taken)
    name = lambda tag: F.concat(F.when(F.exists("taken", lambda h: (h["tag"] == tag) & h["negative"]), "!").otherwise(""), tag)
    return rows.select(id_col, F.transform(F.array_distinct(F.col("taken.tag")), name).alias("tags"))


def merged(hits: Column) -> Column:
    """Hits in order of start, end and tag, those that overlap as one: (start, end, tag, negative, phrase); touching ones stay apart."""
    one = "struct<start:int,end:int,tag:string,negative:boolean,phrase:string>"
    in_order = F.array_sort(F.transform(hits, lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), h["tag"].alias("tag"), h["negative"].alias("negative"), h["phrase"].alias("phrase")))).cast(f"array<{one}>")

    def add(done: Column, h: Column) -> Column:
        last = F.element_at(done, -1)
        both = F.struct(last["start"].alias("start"), F.greatest(last["end"], h["end"]).alias("end"), F.concat(last["tag"], F.lit("|"), h["tag"]).alias("tag"), (last["negative"] | h["negative"]).alias("negative"), F.concat(last["phrase"], F.lit(" + "), h["phrase"]).alias("phrase"))
        return F.when((F.size(done) > 0) & (h["start"] < F.try_element_at(done, F.lit(-1))["end"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(both))).otherwise(F.concat(done, F.array(h))).cast(f"array<{one}>")

    return F.aggregate(in_order, F.array().cast(f"array<{one}>"), add)


def merge_overlaps(hits: DataFrame, id_col: str) -> DataFrame:
    """(id, start, end, tag, negative, phrase): hits that overlap as one, tags joined by |; touching ones stay apart.

    A text's hits come together; they are bounded by its length.
    """
    held = hits.groupBy(id_col).agg(F.collect_list(F.struct("start", "end", "tag", "negative", "phrase")).alias("h"))
    return held.select(id_col, F.explode(merged(F.col("h"))).alias("m")).select(id_col, "m.start", "m.end", "m.tag", "m.negative", "m.phrase")


def valid_subject(tokens: Column, start: Column, tag: Column, subjects: dict[str, list[str]], window: int = 15) -> Column:
    """For tags that need one of their subjects near: whether a token near the hit is part of one, or it of a token."""
    near = F.slice(tokens, F.greatest(start - window, F.lit(0)) + 1, F.least(start, F.lit(window)) + window)
    out = F.lit(True)

    def has(words: list[str]) -> Column:
        return F.exists(near, lambda t: F.exists(text.words_array(words), lambda s: F.contains(t, s) | F.contains(s, t)))

    for name, words in subjects.items():
        out = F.when(tag == name, has(words)).otherwise(out)
    return out


def with_sentiment(df: DataFrame, context_col: str, sentiment: Callable[[list[str | None]], list[str]] | None = None, strong_negative: list[str] | None = None) -> DataFrame:
    """df with `sentiment` of each context: positive, negative or neutral.

    A model takes a list of texts and gives their sentiments; it gets batches and is loaded once a
    worker. Without one the lexicon decides. With `strong_negative`, a context that holds one of
    these parts is negative whatever else says.
    """
    if sentiment is None:
        out = df.withColumn("sentiment", text.lexicon_sentiment(F.col(context_col)))
    else:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sentiment(batch.column(context_col).to_pylist()), pa.string())], names=[*batch.schema.names, "sentiment"])

        out = df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("sentiment", T.StringType())]))
    if strong_negative:
        out = out.withColumn("sentiment", F.when(text.contains_any(F.lower(context_col), strong_negative), "negative").otherwise(F.col("sentiment")))
    return out


def contexts(df: DataFrame, id_col: str, tokens_col: str, lexicon: Lexicon, window: int = 3, subjects: dict | None = None, exclusions: dict | None = None, sentiment: Callable[[list[str | None]], list[str]] | None = None, strong_negative: list[str] | None = None) -> DataFrame:
    """(id, start, end, tag, negative, phrase, context, sentiment): merged hits with the words around them.

    The context reaches `window` tokens to both sides of the hit's middle; its sentiment is the
    lexicon's or a model's, see with_sentiment. All of it happens within a row; nothing is shuffled.
    """
    rows = once(df.select(id_col, F.col(tokens_col).alias("_tokens")), _hits=hits_in(F.col("_tokens"), lexicon)).filter(F.size("_hits") > 0)
    valid = F.col("_hits")
    if exclusions:
        rows = once(rows, _doubtful=F.array_compact(F.array(*[F.when(text.contains_any(F.array_join("_tokens", " "), words), tag) for tag, words in exclusions.items()])))
        valid = F.filter(valid, lambda h: ~F.array_contains(F.col("_doubtful"), h["tag"]))
    if subjects:
        valid = F.filter(valid, lambda h: valid_subject(F.col("_tokens"), h["start"], h["tag"], subjects))
    rows = rows.select(id_col, "_tokens", F.explode(merged(valid)).alias("m")).select(id_col, "_tokens", "m.start", "m.end", "m.tag", "m.negative", "m.phrase")
    middle = F.floor((F.col("start") + F.col("end")) / 2).cast("int")
    begin = F.greatest(middle - window, F.lit(0))
    around = F.array_join(F.slice("_tokens", begin + 1, middle + window + 1 - begin), " ")
    return with_sentiment(once(rows, context=around).drop("_tokens"), "context", sentiment, strong_negative)


def assign_tags(found: DataFrame, id_col: str) -> DataFrame:
    """(id, tags, polarity, phrases): the first tag of each context, negated if any context of it is negative.

    A neutral context has its rule's polarity; only others give matched phrases.
    """
    tag = F.element_at(F.split("tag", "\\|"), 1)
    negative = F.when(F.col("sentiment") == "neutral", F.col("negative")).otherwise(F.col("sentiment") == "negative")
    name = F.when(F.col("bad"), F.concat(F.lit("!"), F.col("t"))).otherwise(F.col("t"))
    phrase = F.when(F.col("sentiment") != "neutral", F.struct("start", "phrase"))
    by_tag = found.select(id_col, "start", tag.alias("t"), negative.alias("n"), "sentiment", "phrase").groupBy(id_col, "t").agg(F.bool_or("n").alias("bad"), F.min("start").alias("first"), F.array_sort(F.collect_list(phrase)).alias("p"))
    rows = by_tag.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("first", name.alias("name"), F.col("t"), F.when(F.col("bad"), "negative").otherwise("positive").alias("polarity"), F.col("p.phrase").alias("phrases")))).alias("x"))
    polarity = F.map_from_entries(F.transform("x", lambda e: F.struct(e["t"], e["polarity"])))
    phrases = F.map_from_entries(F.transform(F.filter("x", lambda e: F.size(e["phrases"]) > 0), lambda e: F.struct(e["name"], e["phrases"])))
    return rows.select(id_col, F.col("x.name").alias("tags"), polarity.alias("polarity"), phrases.alias("phrases"))


def prepared(review: Column, name: Column, location: Column) -> Column:
    """The text that a record is tagged by: the clean review, name and location, normalised."""
    parts = [F.nullif(F.coalesce(c, F.lit("")), F.lit("")) for c in (text.clean(review), name, location)]
    return text.normalize(F.concat_ws(" ", *parts))


def tag_records(df: DataFrame, id_col: str, review_col: str, name_col: str, location_col: str, categories: Lexicon, descriptors: Lexicon, **options) -> DataFrame:
    """(id, prepared, category_tags, descriptor_tags, polarity, phrases): records by their prepared texts; those without one go.

    Ids must be unique. Options are those of contexts().
    """
    rows = once(df.select(id_col, review_col, name_col, location_col), prepared=prepared(F.col(review_col), F.col(name_col), F.col(location_col))).filter("prepared <> ''").select(id_col, "prepared")
    rows = cut(once(rows, _t=text.tokens(F.col("prepared"))))
    of_category = category_tags(rows, id_col, "_t", categories).withColumnRenamed("tags", "category_tags")
    of_descriptor = assign_tags(contexts(rows, id_col, "_t", descriptors, **options), id_col).withColumnRenamed("tags", "descriptor_tags")
    none = F.array().cast("array<string>")
    out = rows.drop("_t").join(of_category, id_col, "left").join(of_descriptor, id_col, "left")
    return out.withColumn("category_tags", F.coalesce("category_tags", none)).withColumn("descriptor_tags", F.coalesce("descriptor_tags", none))
