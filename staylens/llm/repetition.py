"""Repetition inside a single document, and a quality judged by weak supervision."""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staylens.llm.common import cut, pick

#: A Chinese or Japanese character, or a run of other letters, marks and digits.
_WORD = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]|(?:(?![\p{Han}\p{Hiragana}\p{Katakana}])[\p{L}\p{M}\p{N}])+")
_SENTENCE = regex.compile(r"[.!?…。！？\n]+")
_PARAGRAPH = regex.compile(r"\s*\n\s*")
RUN = 4


def words(text: str) -> list[str]:
    """Words without regard to case, punctuation, white space or how accents are stored."""
    return _WORD.findall(unicodedata.normalize("NFC", text).casefold())


def repeated_share(tokens: list, run: int = RUN) -> float:
    """Share of the words that lie in a run of `run` words which has already begun earlier."""
    n = len(tokens)
    if n <= run:
        return 0.0
    numbers: dict = {}
    codes = [numbers.setdefault(t, len(numbers)) for t in tokens]
    seen: set[tuple] = set()
    lies = bytearray(n)
    for i, gram in enumerate(zip(*[codes[j:] for j in range(run)])):
        if gram in seen:
            lies[i : i + run] = b"\x01" * run
        else:
            seen.add(gram)
    return lies.count(1) / n


def _again(parts: list[str]) -> float:
    """Share of the characters that lie in a part which occurred before."""
    seen, again, total = set(), 0, 0
    for part in parts:
        total += len(part)
        again += len(part) * (part in seen)
        seen.add(part)
    return again / total if total else 0.0


FEATURES = ["n_words", "repeated_share", "sentence_share", "paragraph_share", "distinct_share", "packed_share"]
#: The rules: feature, votes repetitive from here on, votes fine up to here (the other way round where the first is less; None: never, as few whole sentences or paragraphs repeat even in a text that goes in circles), least words. Fixed values of this operator.
RULES = [
    ("repeated_share", 0.6, 0.4, 1),
    ("sentence_share", 0.4, None, 12),
    ("paragraph_share", 0.4, None, 40),
    ("distinct_share", 0.35, 0.7, 20),
    ("packed_share", 0.25, 0.45, 40),
]


def _parts(tokens: list[str], begins: np.ndarray, text: str, mark: regex.Pattern) -> list[str]:
    """The words between the places where a mark ends, as one string each."""
    ends = [m.end() for m in mark.finditer(text)]
    at = [0, *np.unique(np.searchsorted(begins, ends)).tolist(), len(tokens)]
    return [" ".join(tokens[a:b]) for a, b in zip(at, at[1:])]


def measure(text: str | None) -> tuple:
    """The features of a text, whose words are cut once for all of them."""
    text = unicodedata.normalize("NFC", text).casefold() if text else ""
    found = list(_WORD.finditer(text))
    if not found:
        return (0, 0.0, 0.0, 0.0, None, None)
    tokens, begins = [m[0] for m in found], np.array([m.start() for m in found])
    joined = " ".join(tokens).encode()
    return (len(tokens), repeated_share(tokens), _again(_parts(tokens, begins, text, _SENTENCE)), _again(_parts(tokens, begins, text, _PARAGRAPH)), len(set(tokens)) / len(tokens), len(zlib.compress(joined, 1)) / len(joined))


def _votes() -> list:
    votes = []
    for name, bad, good, least in RULES:
        c = F.col(name)
        is_bad, is_good = (c >= bad, F.lit(False) if good is None else c <= good) if good is None or bad > good else (c <= bad, c >= good)
        votes.append(F.when(F.col("n_words") < least, 0).when(is_bad, 1).when(is_good, -1).otherwise(0))
    return votes


def _agree(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, float]:
    """Posterior of "repetitive" for each pattern of votes, and its prior, by expectation-maximisation.

    Each rule has one accuracy when it votes; rules err independently given the truth. Accuracies
    begin at 0.8 and stay above one half, which settles which class is which. One vote a rule and
    class is added before counting.
    """
    votes, accuracy, prior = patterns.astype(float), np.full(patterns.shape[1], 0.8), 0.2
    for _ in range(rounds):
        weight = np.log(accuracy / (1 - accuracy))
        posterior = 1 / (1 + np.exp(-np.clip(votes @ weight + np.log(prior / (1 - prior)), -50, 50)))
        right = (counts[:, None] * (posterior[:, None] * (votes > 0) + (1 - posterior[:, None]) * (votes < 0))).sum(0)
        cast = (counts[:, None] * (votes != 0)).sum(0)
        accuracy = np.clip((right + 1.6) / (cast + 2), 0.51, 0.99)
        prior = float(np.clip((counts * posterior).sum() / counts.sum(), 0.01, 0.9))
    return posterior, prior


def repetition(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Measures of repetition and the judgement of each text: (id, measures, votes, repetitive).

    `repeated_share` is the share of the words in runs of four or more that began earlier in the
    text; further measures are the shares of repeated sentences and paragraphs, of distinct words
    and the packed size. Rules vote 1 (repetitive), -1 (fine) or 0 (abstain) on them; from the
    counts of all patterns of votes expectation-maximisation estimates how accurate each rule is,
    and `repetitive` is the posterior probability. What is gathered for it is one count for each
    pattern, at most 3 to the power of the rules.

    One row per input row; repeated rows and null ids have rows of their own. Null, empty and
    wordless texts have no words, shares of 0 and no votes against them but the prior. Texts are
    measured whole. An empty table gives an empty result.
    """
    rows = pick(df, id=id_col, text=text_col)
    kinds = ["int", "double", "double", "double", "double", "double"]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(t) for t in batch.column("text").to_pylist()]
            columns = list(zip(*found, strict=True)) if found else [[]] * len(FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(c, pa.int32() if k == "int" else pa.float64()) for c, k in zip(columns, kinds, strict=True)]], names=["id", *FEATURES])

    schema = T.StructType([rows.schema["id"], *[T.StructField(n, T.IntegerType() if k == "int" else T.DoubleType()) for n, k in zip(FEATURES, kinds, strict=True)]])
    # Kept, as the votes are counted before they are judged and the texts should be read once.
    voted = cut(rows.mapInArrow(features, schema).withColumn("votes", F.array(*_votes())))
    counts = voted.groupBy("votes").count().collect()
    if not counts:
        return voted.withColumn("repetitive", F.lit(0.0)).withColumnRenamed("id", id_col)
    patterns = np.array([r["votes"] for r in counts])
    posterior, _ = _agree(patterns, np.array([r["count"] for r in counts], float))
    judged = df.sparkSession.createDataFrame([(r["votes"], float(p)) for r, p in zip(counts, posterior, strict=True)], "votes array<int>, repetitive double")
    return voted.join(F.broadcast(judged), "votes").select(F.col("id").alias(id_col), *FEATURES, "votes", "repetitive")
