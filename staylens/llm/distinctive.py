"""How distinctive a term is per record: divergence from randomness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staylens.llm.common import Kept, col, cut, pick

#: Terms that make up more than this share of all occurrences are looked up in a broadcast table, of which there can be no more than 1 / share.
HOT_SHARE = 1e-3


def term_weights(df: DataFrame, id_col: str, fields: list[str], c: float = 1.0, few: int | None = None) -> DataFrame:
    """Weight each term of each array field of a record against the whole collection.

    Result: (id, field, term, tf, df, cf, weight): occurrences in the record, records with the
    term, occurrences in the collection. Weight: information content under a geometric model of
    the collection, log2(1 + m) + tfn * log2((1 + m) / m) with m = cf / records of the field, times
    the Laplace after-effect gain 1 / (tfn + 1), tfn = tf * log2(1 + c * mean length / length).

    With `few`, only terms remain whose weight is at least what any term of at most so many records
    can have when it occurs as often in that record: with most = the occurrences of the most
    frequent such term, the least weight for m up to most / records. For a given tfn the weight
    falls until m = tfn and then rises, so that least is at the smaller of the two. No term of so
    few records is lost; nearly all common ones go.

    Terms are compared exactly as they are. Null and empty arrays and null terms give no rows and
    don't count; an empty string is a term. Rows with the same id are parts of one record; null
    ids are one record. Every record and term counts, none are sampled or capped.

    Occurrences are summed per record and term once and written to the shared folder; statistics
    and weights are read from there. Rows without an id are spread and summed up before they meet.
    Terms that are a large share of all occurrences (at most 1 / HOT_SHARE of them) get their
    statistics by broadcast, so that no task receives all rows of a common term; the others by a
    join on the term.
    """
    names = {f"f{i}": f for i, f in enumerate(fields)}
    arrays = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.filter(col(n).cast("array<string>"), lambda t: t.isNotNull()).alias("terms")) for n, f in names.items()]))
    # Whole arrays move once, by record; rows without an id go anywhere.
    salt = F.when(F.col("id").isNull(), F.pmod(F.xxhash64(*names), F.lit(1 << 16))).otherwise(0)
    parts = pick(df, id=id_col, **names).withColumn("salt", salt).repartition("id", "salt").select("id", "salt", arrays.alias("a")).select("id", "salt", "a.field", "a.terms")
    counted = parts.select("id", "salt", "field", F.explode("terms").alias("term")).groupBy("id", "salt", "field", "term").agg(F.count("*").alias("tf"))
    one = counted.filter("id is not null").select("id", "salt", "field", "term", "tf").withColumn("length", F.sum("tf").over(Window.partitionBy("id", "salt", "field"))).drop("salt")
    none = counted.filter("id is null").groupBy("id", "field", "term").agg(F.sum("tf").alias("tf"))
    none = none.join(none.groupBy("field").agg(F.sum("tf").alias("length")), "field").select(*one.columns)
    tf = Kept(df.sparkSession).keep(one.unionByName(none))
    stats = tf.groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    records = tf.groupBy("field").agg(F.countDistinct("id").alias("ids"), F.max(F.col("id").isNull().cast("int")).alias("none"), F.sum("tf").alias("total"))
    totals = records.select("field", (F.col("ids") + F.col("none")).alias("records"), "total")
    if few is not None:
        totals = totals.join(stats.filter(F.col("df") <= few).groupBy("field").agg(F.max("cf").alias("most")), "field", "left")
    totals = F.broadcast(cut(totals))  # one row a field
    hot = F.broadcast(stats.join(totals, "field").filter(F.col("cf") > F.col("total") * HOT_SHARE).select("field", "term", "df", "cf"))
    known = tf.join(hot, ["field", "term"], "left")
    common = known.filter("df is not null")
    rare = known.filter("df is null").drop("df", "cf").join(stats, ["field", "term"])
    rows = common.unionByName(rare).join(totals, "field")
    tfn = F.col("tf") * F.log2(1 + c * F.col("total") / F.col("records") / F.col("length"))

    def weight(m: Column) -> Column:
        return (F.log2(1 + m) + tfn * F.log2((1 + m) / m)) / (tfn + 1)

    rows = rows.withColumn("weight", weight(F.col("cf") / F.col("records")))
    if few is not None:
        rows = rows.filter(F.col("weight") >= weight(F.least(F.col("most") / F.col("records"), tfn)) - 1e-9)
    return rows.select(F.col("id").alias(id_col), "field", "term", "tf", "df", "cf", "weight")
