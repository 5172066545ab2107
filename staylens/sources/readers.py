"""Sources: files of reviews, query sets, judgements and settings, with declared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Raw reviews as they are captured.
RAW_REVIEW = "review_id string, source_review_id string, source_hotel_id string, hotel_name string, location string, place_types array<string>, place_type_source string, rating string, review_rating string, review_text string, review_date string, source string"


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_records(spark: SparkSession, array_path: str, lines_path: str | None = None, schema: str = RAW_REVIEW) -> DataFrame:
    """Records of a file that holds one array, or of one with a record a line if the first is missing or empty; none if both are."""
    if exists(spark, array_path):
        df = spark.read.schema(schema).option("multiLine", True).json(array_path)
        if not df.isEmpty():
            return df
    if lines_path and exists(spark, lines_path):
        return spark.read.schema(schema).json(lines_path)
    return spark.createDataFrame([], schema)


def read_all(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """Several sources as one, the first row of each key: of the earlier source, then by content.

    The key is the first of the columns that is filled; rows without any stay.
    """
    rows = None
    for n, source in enumerate(sources):
        part = source.withColumn("_source", F.lit(n))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    key = F.coalesce(*[F.nullif(F.trim(F.col(k).cast("string")), F.lit("")) for k in keys])
    rows = rows.withColumn("_key", key)
    columns = [c for c in rows.columns if c not in ("_source", "_key")]
    best = rows.filter("_key is not null").groupBy("_key").agg(F.min(F.struct("_source", *columns)).alias("_r"))
    return best.select(*[F.col("_r").getField(c).alias(c) for c in columns]).unionByName(rows.filter("_key is null").select(*columns))


def read_csv(spark: SparkSession, path: str, numbers: dict[str, int] | None = None) -> DataFrame:
    """A CSV file with a header, a mark of byte order or not; columns named in `numbers` as whole numbers or that default."""
    df = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    df = df.toDF(*[c.lstrip("\ufeff").strip('"') for c in df.columns])
    for name, default in (numbers or {}).items():
        df = df.withColumn(name, F.coalesce(F.col(name).try_cast("double").cast("int"), F.lit(default)))
    return df


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """A query set, a list of objects or lists of texts by bucket: (query_id, query, bucket_id, bucket_name, bucket_order).

    A query without an id gets Q and its place in the file; blank queries go but count as places.
    A query set is one small file, read whole.
    """
    raw = spark.read.text(path, wholetext=True)
    item = "struct<query_id:string,query:string,bucket_id:string,bucket_name:string,bucket_order:int>"
    listed = raw.filter(F.trim("value").startswith("[")).select(F.posexplode(F.from_json("value", f"array<{item}>")).alias("at", "q")).select((F.col("at") + 1).alias("place"), "q.*")
    buckets = raw.filter(F.trim("value").startswith("{")).select(F.from_json("value", "map<string,array<string>>").alias("m")).select(F.posexplode("m").alias("b", "bucket", "texts"))
    buckets = buckets.select("b", "bucket", F.posexplode("texts").alias("at", "query"))
    before = Window.orderBy("b", "at")  # one small file
    named = buckets.select(F.row_number().over(before).alias("place"), F.lit(None).cast("string").alias("query_id"), "query", F.col("bucket").alias("bucket_id"), F.col("bucket").alias("bucket_name"), (F.col("b") + 1).alias("bucket_order"))
    rows = listed.unionByName(named).filter(F.trim(F.coalesce("query", F.lit(""))) != "")
    return rows.select(F.coalesce("query_id", F.concat(F.lit("Q"), F.col("place").cast("string"))).alias("query_id"), F.trim("query").alias("query"), "bucket_id", "bucket_name", "bucket_order")


def indexable(reviews: DataFrame) -> DataFrame:
    """Reviews that can be indexed: with tokens or a clean text."""
    return reviews.filter(F.col("tokens").isNotNull() | F.col("clean_text").isNotNull())


def samples_by_key(df: DataFrame, key: str, text_col: str, order: list[str], n: int = 3, length: int = 200) -> DataFrame:
    """(key, place, text): the beginnings of the first n texts of each key."""
    place = Window.partitionBy(key).orderBy(*order)
    rows = df.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= n)
    return rows.select(key, "place", F.substring(text_col, 1, length).alias("text"))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, the same for a seed: those whose seeded hash of the key is lowest."""
    return df.withColumn("_h", F.xxhash64(F.lit(seed), F.col(key))).orderBy("_h", key).limit(n).drop("_h")


def page(df: DataFrame, order: list[Column | str], start: int, n: int | None = None) -> DataFrame:
    """Rows from place `start` on, n at most, in the order given."""
    out = df.orderBy(*order).offset(start)
    return out if n is None else out.limit(n)


def cities(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """Crawl targets: enabled ones with a name and a geo id; the code is the first two letters by default, limits are 1 at least."""
    schema = "name string, code string, geo_id string, enabled boolean, region string, max_hotels string, max_reviews string"
    names = [f.name for f in T._parse_datatype_string(schema).fields]
    df = spark.createDataFrame([tuple(None if e.get(k) is None else (bool(e[k]) if k == "enabled" else str(e[k])) for k in names) for e in entries], schema)
    limit = lambda c: F.greatest(F.lit(1), F.coalesce(F.col(c).try_cast("int"), F.lit(1)))
    filled = (F.trim(F.coalesce("name", F.lit(""))) != "") & (F.trim(F.coalesce("geo_id", F.lit(""))) != "") & F.coalesce("enabled", F.lit(True))
    code = F.coalesce(F.nullif(F.trim("code"), F.lit("")), F.upper(F.substring(F.trim("name"), 1, 2)))
    return df.filter(filled).select(F.trim("name").alias("name"), code.alias("code"), "geo_id", "region", limit("max_hotels").alias("max_hotels"), limit("max_reviews").alias("max_reviews"))


def mapped(df: DataFrame, mapping: dict[str, list[str]], defaults: dict[str, str] | None = None) -> DataFrame:
    """Columns by a declared mapping: the first filled of the named ones, else the default."""
    out = []
    for name, sources in mapping.items():
        found = [F.nullif(F.trim(F.col(s).cast("string")), F.lit("")) for s in sources if s in df.columns]
        out.append(F.coalesce(*found, F.lit((defaults or {}).get(name))).alias(name))
    return df.select(*out)
