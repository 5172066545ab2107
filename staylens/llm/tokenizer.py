"""Encoding of texts with a public byte-level tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from staylens.llm.common import cut, partitions, pick

TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the public split pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _file(folder: str, name: str) -> str:
    """A file of the vocabulary: as it was sent to this executor, else in its folder."""
    sent = SparkFiles.get(name) if SparkFiles._is_running_on_worker else ""
    return sent if os.path.exists(sent) else os.path.join(folder, name)


def _send(spark: SparkSession, folder: str, name: str) -> None:
    """Send the files of a vocabulary to the executors, once a session: they needn't have the folder."""
    sc = spark.sparkContext
    sent = sc.__dict__.setdefault("_staylens_vocabularies", set())
    if (folder, name) not in sent:
        for file in (f"{name}.tiktoken", f"{name}.json"):
            sc.addFile(os.path.join(folder, file))
        sent.add((folder, name))


@lru_cache(maxsize=4)
def _encoder(folder: str, name: str):
    import tiktoken

    with open(_file(folder, f"{name}.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def _splitter(folder: str, name: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(_file(folder, f"{name}.json")).pre_tokenizer


def decode(ids: list[int], folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> str:
    """The text of ids: their bytes in a row."""
    return b"".join(_encoder(folder, name).decode_single_token_bytes(i) for i in ids).decode("utf-8")


def _encode(texts: pa.Array, folder: str, name: str) -> pa.Array:
    encode = _encoder(folder, name).encode_ordinary
    ids = [encode(t) if t else [] for t in texts.to_pylist()]
    offsets = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    flat = np.fromiter((i for x in ids for i in x), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


#: The longest end of a cut-off text in which the pattern may see a boundary that isn't one: a contraction cut short.
BLIND = 4


def _ends(text: str, folder: str, name: str) -> list[int]:
    """Ends of pre-tokens that hold whatever may follow the text.

    None after white space: two pre-tokens of one run of it would be one where a piece ends.
    """
    return [end for _, (_, end) in _splitter(folder, name).pre_tokenize_str(text) if end <= len(text) - BLIND and not text[end - 1].isspace()]


def encode_corpus(df: DataFrame, id_col: str, text_col: str, folder: str = TOKENIZERS, name: str = "byte_bpe_50k", chunk: int = 8192, overlap: int = 256) -> DataFrame:
    """The ids of each text without special tokens, as (id, ids array<int>): one row per input row.

    Null and empty texts have the empty list. Strings that look like special tokens are ordinary
    text. Repeated rows and null ids give a row each. Nothing is normalised, so that the ids decode
    to the very text.

    Texts up to `chunk` characters are encoded where they are read, without a shuffle. Longer ones
    are cut into chunks that reach `overlap` characters into the next; the chunks spread over the
    cluster and are split into pre-tokens in parallel. Splitting depends only on what follows, so
    from the first boundary that two neighbours share both agree: there the pieces are stitched.
    Each piece, which then begins and ends at true boundaries, is encoded by itself and a text's
    pieces are put in a row. A text in which some neighbours share no boundary (one unbroken run
    longer than the overlap) is encoded whole.
    """
    _send(df.sparkSession, folder, name)
    rows = pick(df, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()
    long = F.length("text") > chunk

    def short_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), _encode(batch.column("text"), folder, name)], names=["id", "ids"])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            for i, text in enumerate(batch.column("text").to_pylist()):
                starts = range(0, max(1, len(text) - overlap), chunk)
                columns = [pa.array([part + row] * len(starts)), pc.take(batch.column("id"), pa.array([i] * len(starts))), pa.array(range(len(starts)), pa.int32()), pa.array([text[s : s + chunk + overlap] for s in starts])]
                row += 1
                yield pa.RecordBatch.from_arrays(columns, names=["row", "id", "no", "piece"])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_ends(piece, folder, name) for piece in batch.column("piece").to_pylist()]
            head = [[e for e in x if e <= overlap] for x in found]
            tail = [[e - chunk for e in x if e >= chunk] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("no"), pa.array(head, pa.list_(pa.int32())), pa.array(tail, pa.list_(pa.int32()))], names=["row", "no", "head", "tail"])

    def piece_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = [p[a:b] for p, a, b in zip(batch.column("piece").to_pylist(), batch.column("begin").to_pylist(), batch.column("end").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), batch.column("no"), _encode(pa.array(pieces, pa.string()), folder, name)], names=["row", "id", "no", "ids"])

    short = rows.filter(~F.coalesce(long, F.lit(False))).mapInArrow(short_ids, f"id {kind}, ids array<int>")
    n = partitions(df.sparkSession)
    # Frozen, as the row numbers must stay the same for all that follows.
    cut_up = cut(rows.filter(long).mapInArrow(chunks, f"row long, id {kind}, no int, piece string").repartition(n, "row", "no"))
    in_text = Window.partitionBy("row").orderBy("no")
    bounds = cut_up.select("row", "no", "piece").mapInArrow(ends, "row long, no int, head array<int>, tail array<int>")
    seam = F.array_min(F.array_intersect("head", F.lag("tail").over(in_text)))
    seams = bounds.select("row", "no", F.when(F.col("no") == 0, 0).otherwise(seam).alias("begin"))
    last = F.col("no") == F.max("no").over(Window.partitionBy("row"))
    seams = seams.select("row", "no", "begin", F.when(last, F.lit(2**31 - 1)).otherwise(F.lead("begin").over(in_text) + chunk).alias("end"), F.max(F.col("begin").isNull()).over(Window.partitionBy("row")).alias("torn"))
    pieces = cut_up.join(seams, ["row", "no"])
    parts = pieces.filter("not torn").select("row", "id", "no", "piece", "begin", "end").mapInArrow(piece_ids, f"row long, id {kind}, no int, ids array<int>")
    in_order = F.array_sort(F.collect_list(F.struct("no", "piece")))
    whole_text = F.array_join(F.transform("pieces", lambda x, i: F.when(i < F.size("pieces") - 1, F.substring(x["piece"], 1, chunk)).otherwise(x["piece"])), "")
    torn = pieces.filter("torn").groupBy("row").agg(F.first("id").alias("id"), in_order.alias("pieces")).select("id", whole_text.alias("text")).mapInArrow(short_ids, f"id {kind}, ids array<int>")
    joined = parts.groupBy("row").agg(F.first("id").alias("id"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("no", "ids"))), lambda x: x["ids"])).alias("ids")).select("id", "ids")
    done = short.unionByName(joined).unionByName(torn)
    return done.select(F.col("id").alias(id_col), F.col("ids"))
