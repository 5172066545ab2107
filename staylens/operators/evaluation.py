"""Quality of rankings and latencies: metrics, pools, judgements, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staylens.session import cut


def metrics(run: DataFrame, grades: DataFrame, queries: DataFrame, k: int = 10, strong: int = 2) -> DataFrame:
    """(system, query, precision, recall, ap, ap_k, ndcg, mrr, strong_precision, strong_recall) for every query and system.

    run has system, query, doc, rank; grades has query, doc, grade. Precision is over k however few
    results there are; recall, average precision and nDCG are 0 without relevant documents, and
    such queries still count. nDCG's ideal is over all graded documents; ap is divided by the
    number of relevant documents, ap_k by k.
    """
    graded = grades.filter("grade > 0")
    best = graded.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.col("grade").desc(), "doc"))).filter(F.col("n") <= k)
    ideal = best.groupBy("query").agg(F.sum(F.col("grade") / F.log2(F.col("n") + 1)).alias("idcg"))
    relevant = graded.groupBy("query").agg(F.count("*").alias("relevant"), F.sum((F.col("grade") >= strong).cast("int")).alias("strong"))
    hits = run.filter(F.col("rank") <= k).join(graded, ["query", "doc"], "left").withColumn("hit", (F.coalesce("grade", F.lit(0)) > 0).cast("int"))
    so_far = F.sum("hit").over(Window.partitionBy("system", "query").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    found = hits.withColumn("so_far", so_far).groupBy("system", "query").agg(
        F.sum("hit").alias("hits"),
        F.sum(F.when(F.col("hit") == 1, F.col("so_far") / F.col("rank")).otherwise(0.0)).alias("gain"),
        F.sum(F.coalesce("grade", F.lit(0)) / F.log2(F.col("rank") + 1)).alias("dcg"),
        F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"),
        F.sum((F.coalesce("grade", F.lit(0)) >= strong).cast("int")).alias("strong_hits"),
    )
    # Systems are a handful, so this is the queries once for each.
    every = run.select("system").distinct().join(queries.select("query").distinct())
    rows = every.join(found, ["system", "query"], "left").join(relevant, "query", "left").join(ideal, "query", "left")
    over = lambda a, b: F.when(F.coalesce(b, F.lit(0)) > 0, F.coalesce(a, F.lit(0)) / b).otherwise(0.0)
    hits_, gain = F.coalesce("hits", F.lit(0)), F.coalesce("gain", F.lit(0.0))
    return rows.select(
        "system",
        "query",
        (hits_ / k).alias("precision"),
        over(F.col("hits"), F.col("relevant")).alias("recall"),
        over(F.col("gain"), F.col("relevant")).alias("ap"),
        (gain / k).alias("ap_k"),
        over(F.col("dcg"), F.col("idcg")).alias("ndcg"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"),
        (F.coalesce("strong_hits", F.lit(0)) / k).alias("strong_precision"),
        over(F.col("strong_hits"), F.col("strong")).alias("strong_recall"),
    )


def report(by_query: DataFrame, buckets: DataFrame, values: list[str]) -> DataFrame:
    """Means by bucket and system and over all buckets, whose bucket is null, in one pass."""
    rows = by_query.join(buckets, "query")
    return rows.groupingSets([["bucket", "system"], ["system"]], "bucket", "system").agg(F.count("*").alias("queries"), *[F.avg(v).alias(v) for v in values])


def winners(means: DataFrame, value: str, order: dict[str, int]) -> DataFrame:
    """(bucket, winner): the system with the greatest mean, of equal ones the first in the order given."""
    place = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    return means.groupBy("bucket").agg(F.max_by("system", F.struct(F.col(value), -F.try_element_at(place, F.col("system")))).alias("winner"))


def pool(runs: list[tuple[str, DataFrame]], k: int = 10) -> DataFrame:
    """(query, doc, <system>_rank ...): all documents that some system has among its first k, with their ranks, null where unknown."""
    parts = [run.filter(F.col("rank") <= k).select("query", "doc", F.lit(name).alias("system"), "rank") for name, run in runs]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy("query", "doc").agg(*[F.max(F.when(F.col("system") == name, F.col("rank"))).alias(f"{name}_rank") for name, _ in runs])


def qrels(labelled: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(query, doc, grade): all labelled and all retrieved documents, those without a label graded 0."""
    return labelled.select("query", "doc", "grade").join(retrieved.select("query", "doc").distinct(), ["query", "doc"], "full_outer").select("query", "doc", F.coalesce("grade", F.lit(0)).alias("grade"))


def run_lines(run: DataFrame) -> DataFrame:
    """Lines of a run file: query, rank, document and score with six decimals, by tabs; sorted by query number and rank."""
    line = F.concat_ws("\t", "query", F.col("rank").cast("string"), "doc", F.format_string("%.6f", F.col("score")))
    return run.select(F.substring("query", 2, 20).cast("long").alias("number"), "rank", line.alias("line"))


def latency(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, n, mean, p95, most): p95 is the value at place int(0.95 * (n - 1)) in order, from 0.

    Exact, and no group is gathered: counts of equal values are range-sorted over the cluster, the
    parts' sums tell which part of a group has the place, and only that part is counted through.
    Groups may be named by no column at all; then all rows are one. Null values don't count.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("c"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(counted.repartitionByRange(parts, *group, value).withColumn("part", F.spark_partition_id()))
    # One row for each group and part that it lies in.
    held = ranged.groupBy(*group, "part").agg(F.sum("c").alias("c"), F.sum(F.col(value) * F.col("c")).alias("total"), F.max(value).alias("most"))
    whole = Window.partitionBy(*group)
    held = held.select(*group, "part", F.sum("c").over(whole).alias("n"), F.sum("total").over(whole).alias("total"), F.max("most").over(whole).alias("most"), (F.sum("c").over(whole.orderBy("part")) - F.col("c")).alias("before"), F.col("c").alias("own"))
    place = F.floor(0.95 * (F.col("n") - 1))
    hit = held.filter((F.col("before") <= place) & (place < F.col("before") + F.col("own")))
    hit = hit.select(F.col("part").alias("_part"), *[F.col(name).alias(f"_{name}") for name in group], "n", "total", "most", "before")
    same = F.col("part") == F.col("_part")
    for name in group:
        same = same & F.col(name).eqNullSafe(F.col(f"_{name}"))
    rows = ranged.join(hit, same).select(*group, "n", "total", "most", "before", value, "c")
    upto = F.col("before") + F.sum("c").over(Window.partitionBy(*group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("upto", upto).filter(F.col("upto") > place)
    return rows.groupBy(*group, "n", "total", "most").agg(F.min(value).alias("p95")).select(*group, "n", (F.col("total") / F.col("n")).alias("mean"), "p95", "most")


def label_by_rules(query: Column, name: Column, location: Column, reviews: Column, rank: Column, types: dict[str, list[str]], places: dict[str, list[str]], wishes: dict[str, list[str]]) -> Column:
    """Heuristic relevance: kinds, places and wishes that the query names and the hit shows, and its rank; 1 from two points on."""
    from staylens.functions.text import contains_any

    q, n, r = (F.lower(F.coalesce(c, F.lit(""))) for c in (query, name, reviews))
    points = F.lit(0)
    for groups, in_name, in_text in ((types, 3, 1), (places, 3, 1)):
        for key, words in groups.items():
            points = points + F.when(q.contains(key) & contains_any(n, words), in_name).when(q.contains(key) & contains_any(r, words), in_text).otherwise(0)
    for key, words in wishes.items():
        points = points + F.when(q.contains(key) & contains_any(r, words), 2).when(q.contains(key) & contains_any(n, words), 1).otherwise(0)
    points = points + F.when(rank <= 3, 2).when(rank <= 5, 1).otherwise(0)
    points = points + F.when(F.size(F.array_distinct(F.filter(F.split(q, " +"), lambda t: t != ""))) <= 3, 1).otherwise(0)
    return F.when(points >= 2, 1).otherwise(0)


def label_by_points(query: Column, name: Column, location: Column, reviews: Column, places: dict[str, list[str]], types: dict[str, list[str]], wishes: dict[str, list[str]], denied: dict[str, list[str]] | None = None, missing: dict[str, list[str]] | None = None) -> Column:
    """Heuristic relevance by points, 1 from one point on. `reviews` is an array of texts.

    The first place whose words the query has gives 2 if name or location has one, else 1 if a
    review does; each kind that the query and the name have gives 1, each wish 1 for the name or
    half for a review. A wish in `denied` loses 1 if a review has one of its words, one in
    `missing` half if neither name nor reviews have one. A query of more than ten words that
    shares two with the name gets 1 more.
    """
    from staylens.functions.text import contains_any

    q, n, at = (F.lower(F.coalesce(c, F.lit(""))) for c in (query, name, location))
    low = F.transform(F.coalesce(reviews, F.array().cast("array<string>")), lambda r: F.lower(F.coalesce(r, F.lit(""))))
    said = lambda words: F.exists(low, lambda r: contains_any(r, words))
    place = F.coalesce(*[F.when(contains_any(q, words), F.when(contains_any(at, words) | contains_any(n, words), 2.0).when(said(words), 1.0).otherwise(0.0)) for words in places.values()], F.lit(0.0))
    points = place
    for words in types.values():
        points = points + F.when(contains_any(q, words) & contains_any(n, words), 1.0).otherwise(0.0)
    for wish, words in wishes.items():
        asked = contains_any(q, words)
        points = points + F.when(asked & contains_any(n, words), 1.0).when(asked & said(words), 0.5).otherwise(0.0)
        if wish in (denied or {}):
            points = points - F.when(asked & said(denied[wish]), 1.0).otherwise(0.0)
        if wish in (missing or {}):
            points = points - F.when(asked & ~said(missing[wish]) & ~contains_any(n, missing[wish]), 0.5).otherwise(0.0)
    terms = F.filter(F.split(q, r"\s+"), lambda t: t != "")
    shared = F.size(F.array_intersect(terms, F.filter(F.split(n, r"[^\p{L}\p{N}_]+"), lambda t: t != "")))
    points = points + F.when((F.size(terms) > 10) & (shared >= 2), 1.0).otherwise(0.0)
    return F.when(points >= 1, 1).otherwise(0)


def pooled_ranking(pools: DataFrame, system: str) -> DataFrame:
    """(system, query, doc, rank) of a pool's documents by their rank in the system, those without one last, as if at 999."""
    order = Window.partitionBy("query").orderBy(F.coalesce(f"{system}_rank", F.lit(999)), "doc")
    return pools.select(F.lit(system).alias("system"), "query", "doc", F.row_number().over(order).alias("rank"))


def changes(now: DataFrame, before: DataFrame, key: str, tolerances: dict[str, float]) -> DataFrame:
    """(key, value, before, now, within): whether each value is within its tolerance of what it was.

    A negative tolerance is the most a value may fall, a positive one the most it may rise.
    """
    parts = None
    for value, most in tolerances.items():
        a, b = now.select(key, F.col(value).alias("now")), before.select(key, F.col(value).alias("before"))
        within = (F.col("now") - F.col("before") >= most) if most < 0 else (F.col("now") - F.col("before") <= most)
        part = a.join(b, key).select(key, F.lit(value).alias("value"), "before", "now", within.alias("within"))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def pool_three(lexical: DataFrame, dense: DataFrame, docs: DataFrame, hotel: str, bm25_weight: float = 0.6, vector_weight: float = 0.4, k: int = 10) -> DataFrame:
    """(query, hotel, bm25_rank, vector_rank, hybrid_rank): the hotels to be judged, from three systems.

    lexical and dense are the k best reviews of each query, with rank and a score divided by the
    query's best. A hotel's rank in one of them is that of its last review. The third system adds
    a hotel's reviews up in both, weighs the sums and takes the k best hotels.
    """

    def by_hotel(rows: DataFrame, score: str) -> DataFrame:
        own = rows.join(docs.select("doc", hotel), "doc").filter(F.col(hotel).isNotNull())
        return own.groupBy("query", hotel).agg(F.sum(score).alias(score), F.max("rank").alias(f"{score}_rank"))

    rows = by_hotel(lexical, "bm25").join(by_hotel(dense, "vector"), ["query", hotel], "full_outer")
    rows = rows.withColumn("hybrid", bm25_weight * F.coalesce("bm25", F.lit(0.0)) + vector_weight * F.coalesce("vector", F.lit(0.0)))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.round("hybrid", 9).desc(), hotel))
    return rows.withColumn("n", rank).select("query", hotel, "bm25_rank", "vector_rank", F.when(F.col("n") <= k, F.col("n")).alias("hybrid_rank"))


def ndcg_of_list(ranking: DataFrame, grades: DataFrame, k: int = 10) -> DataFrame:
    """(system, query, ndcg): nDCG whose ideal is the best order of the ranked list itself."""
    rows = ranking.join(grades.select("query", "doc", "grade"), ["query", "doc"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    ideal = F.row_number().over(Window.partitionBy("system", "query").orderBy(F.col("grade").desc(), "doc"))
    gain = lambda at: F.sum(F.when(F.col(at) <= k, F.col("grade") / F.log2(F.col(at) + 1)).otherwise(0.0))
    sums = rows.withColumn("ideal", ideal).groupBy("system", "query").agg(gain("rank").alias("dcg"), gain("ideal").alias("idcg"))
    return sums.select("system", "query", F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"))


def label_counts(labels: DataFrame, label: str, group: list[str] | None = None) -> DataFrame:
    """(group, pairs, relevant, percent): how many of the judged pairs are relevant."""
    return labels.groupBy(*(group or [])).agg(F.count("*").alias("pairs"), F.sum(F.col(label).cast("long")).alias("relevant"), (100 * F.avg(F.col(label).cast("double"))).alias("percent"))


def no_result_rate(run: DataFrame, queries: DataFrame) -> DataFrame:
    """(system, queries, no_result): the share of the queries for which a system of the run finds nothing."""
    asked = queries.select("query").distinct()
    found = run.join(asked, "query", "left_semi").groupBy("system").agg(F.countDistinct("query").alias("found"))
    n = asked.agg(F.count("*").alias("queries"))  # one row
    return found.join(F.broadcast(n)).select("system", "queries", (1 - F.col("found") / F.col("queries")).alias("no_result"))
