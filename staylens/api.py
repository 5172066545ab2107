"""What a service offers, as calls: search, hotel, suggestions, metrics of latency."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.functions import text
from staylens.operators import bm25, evaluation, search, understanding, vectors


#: Weights of dense and lexical scores, and what a place that fits makes of a score, of the systems that are compared.
SYSTEMS = {"bm25": (0.0, 1.0, 1.0), "vector": (1.0, 0.0, 1.0), "hybrid": (0.6, 0.4, 1.8)}


class Engine:
    """Searches over one set of index tables. Each call plans all of its queries as one job."""

    def __init__(self, docs: DataFrame, places: DataFrame, index: bm25.Index, embeddings: DataFrame | None, aliases: dict[str, str], keywords: dict[str, list[str]], descriptors: list[str], synonyms: dict[str, list[str]] | None = None):
        self.docs, self.places, self.index, self.embeddings = docs, places, index, embeddings
        self.aliases, self.keywords, self.descriptors, self.synonyms = aliases, keywords, descriptors, synonyms
        self.spark: SparkSession = docs.sparkSession

    def search(self, queries: list[str], top_k: int = 10, vector_weight: float = 0.6, bm25_weight: float = 0.4, location_boost: float = 1.8) -> DataFrame:
        """Ranked hotels for each query; queries are numbered Q1, Q2 and so on."""
        if not all(q and q.strip() for q in queries):
            raise ValueError("a query is blank")
        if not (1 <= top_k <= 50 and 0 <= vector_weight <= 1 and 0 <= bm25_weight <= 1 and 1 <= location_boost <= 5) or vector_weight + bm25_weight == 0:
            raise ValueError("a setting is out of its range")
        settings = replace(search.Settings(), top_k=top_k, vector_weight=vector_weight, bm25_weight=bm25_weight, location_boost=location_boost)
        rows = self.spark.createDataFrame([(f"Q{n}", q) for n, q in enumerate(queries, 1)], "query string, raw string")
        asked = understanding.understand(rows, "raw", self.aliases, self.descriptors, self.synonyms)
        dense = None
        if self.embeddings is not None and vector_weight > 0:
            asking = vectors.encode(asked.select("query", F.array_join("expanded_tokens", " ").alias("t")), "t")
            dense = self.embeddings.select(F.col("doc").cast(self.docs.schema["doc"].dataType).alias("doc"), "embedding"), asking
        return search.search(asked, self.index, dense, self.docs, self.places, self.keywords, settings)

    def systems(self, queries: list[str], top_k: int = 10) -> DataFrame:
        """Lexical, dense and mixed search of the same queries, with `system` before the columns of a search."""
        parts = [self.search(queries, top_k, v, b, place).withColumn("system", F.lit(name)) for name, (v, b, place) in SYSTEMS.items()]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out.select("system", *[c for c in out.columns if c != "system"])

    def hotel(self, hotel_id: str) -> dict | None:
        """A hotel's row, or None."""
        row = self.places.filter(F.col("_id") == hotel_id).first()
        return row.asDict() if row else None

    def suggestions(self, queries: list[str]) -> DataFrame:
        rows = self.spark.createDataFrame([(q,) for q in queries], "query string")
        return rows.select("query", text.suggestions(F.col("query")).alias("suggestions"))

    def latency(self, log: DataFrame, value: str = "ms") -> dict:
        """Count, mean and 95th percentile of logged times."""
        row = evaluation.latency(log, [], value).first()
        return row.asDict() if row else {"n": 0}
