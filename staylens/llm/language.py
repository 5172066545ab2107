"""Language of each text and of each stretch of a mixed one."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staylens.llm.canonical import canonical
from staylens.llm.common import pick
from staylens.llm.common import sample as lowest
from staylens.llm.gazetteer import repaired

#: Labelled rows that the model is fitted on, those whose id hashes lowest.
SAMPLE = 6000
BUCKETS, SIZE = 1 << 16, 16
#: Least words of a stretch; of Chinese or Japanese, least characters.
LEAST_WORDS, LEAST_CHARACTERS = 4, 6
#: Words of an example to fit on, at most; forms of labels, at most; chance of being right below which a judgement is rejected.
EXAMPLE, MOST_FORMS, RIGHT = 60, 10_000, 0.5
#: Words remembered by a task, with their sums.
MOST_WORDS = 500_000

_LINK = re.compile(r"(?:https?://|www\.)\S+|\S+@\S+\.\w+")
_EMOJI = "←-⇿⌀-➿⬀-⯿️‍\U0001f000-\U0001faff"
_BREAK = re.compile(f"[.!?…。！？;；\n\r|•/()（）\\[\\]\"“”„«»「」{_EMOJI}]+|--+")
_IDEOGRAPHS = "々-〇぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003134f"
_OTHER = re.compile("[Ͱ-᷿⺀-퟿豈-￯\U00020000-\U0003134f]")
_LATIN_WORD = re.compile("[^\\W\\d_]+(?:['’][^\\W\\d_]+)?")
_WORD = re.compile(f"[{_IDEOGRAPHS}]|[^\\W\\d_{_IDEOGRAPHS}]+(?:['’][^\\W\\d_{_IDEOGRAPHS}]+)?")
_BRACKETS = re.compile(r"[(\uff08]([^()\uff08\uff09]*)[)\uff09]")
_SCRIPTS = [(0x0370, 0x03FF, "g"), (0x0400, 0x052F, "c"), (0x1100, 0x11FF, "h"), (0x3040, 0x30FF, "j"), (0x3400, 0x4DBF, "j"), (0x4E00, 0x9FFF, "j"), (0xAC00, 0xD7A3, "h"), (0xF900, 0xFAFF, "j"), (0x20000, 0x3134F, "j")]


def _script(word: str) -> str:
    code = ord(word[0])
    if code < 0x0370:
        return "l"
    return next((s for a, b, s in _SCRIPTS if a <= code <= b), "l")


def _is_name(text: str) -> bool:
    """Whether words without a full stop are a name: most of them begin with a capital letter."""
    words = _WORD.findall(text)
    return not re.search("[.!?…。！？]", text) and 2 * sum(w[0].isupper() for w in words) > len(words)


def stretches(text: str) -> list[tuple[str, list[str]]]:
    """The sentences of a text in its one form, each as (script, lower-case words).

    A sentence in several scripts gives a stretch for each. Links, emoji and names that stand in
    brackets by themselves are left out.
    """
    text = _LINK.sub(" ", canonical(repaired(text))[0])
    if "(" in text or "\uff08" in text:
        text = _BRACKETS.sub(lambda m: " . " if _is_name(m[1]) else m[0], text)
    text = text.lower()
    if not _OTHER.search(text):
        return [("l", words) for piece in _BREAK.split(text) if (words := _LATIN_WORD.findall(piece))]
    found = []
    for piece in _BREAK.split(text):
        by_script: dict[str, list[str]] = {}
        for word in _WORD.findall(piece):
            by_script.setdefault(_script(word), []).append(word)
        found += by_script.items()
    return found


def _full(script: str, words: list[str]) -> bool:
    """Whether a stretch is long enough to say something."""
    return len(words) >= (LEAST_CHARACTERS if script == "j" else LEAST_WORDS)


def _features(word: str, script: str) -> list[int]:
    """Buckets of a word: itself, its parts of two to four letters, its script."""
    if script == "j":
        parts = [word, "kana" if word < "㐀" else "han"]
    else:
        marked = f"<{word}>"
        parts = ["script " + script, marked, *[marked[i : i + n] for n in (2, 3, 4) for i in range(len(marked) - n + 1)]]
    return [zlib.crc32(p.encode()) % BUCKETS for p in parts]


@dataclass
class LanguageModel:
    """Mean of hashed subword embeddings, a linear softmax, a temperature and a bound of rejection."""

    codes: list[str]
    table: np.ndarray  # buckets x languages: embeddings times the output layer
    bias: np.ndarray
    temperature: float = 1.0
    bound: float = 0.0  # of a stretch
    text_bound: float = 0.0  # of a whole text
    _index: dict[tuple[str, str], int] = field(default_factory=dict, repr=False)
    _sums: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_index": {}, "_sums": None}

    def _word(self, script: str, word: str) -> int:
        key = (script, word)
        at = self._index.get(key)
        if at is None:
            at = self._index[key] = len(self._index)
            if self._sums is None or at >= len(self._sums):
                grown = np.zeros((max(4096, 2 * at), len(self.codes) + 1), np.float32)
                if self._sums is not None:
                    grown[: len(self._sums)] = self._sums
                self._sums = grown
            buckets = _features(word, script)
            self._sums[at, :-1] = self.table[buckets].sum(0)
            self._sums[at, -1] = len(buckets)
        return at

    def scores(self, found: list[tuple[str, list[str]]]) -> np.ndarray:
        """Logits of stretches; as the model is linear, words are summed once and remembered."""
        if not found:
            return np.zeros((0, len(self.codes)), np.float32)
        if len(self._index) > MOST_WORDS:
            self._index.clear()
        at = np.fromiter((self._word(s, w) for s, words in found for w in words), np.int64)
        starts = np.r_[0, np.cumsum([len(words) for _, words in found])[:-1]]
        sums = np.add.reduceat(self._sums[at], starts, axis=0)
        return sums[:, :-1] / sums[:, -1:] + self.bias

    def whole(self, p: np.ndarray, found: list[tuple[str, list[str]]]) -> np.ndarray:
        """Probabilities of a text from those of its stretches, by their words."""
        sizes = np.array([len(words) for _, words in found])
        return (p * sizes[:, None]).sum(0) / sizes.sum()

    def judge(self, found: list[tuple[str, list[str]]]) -> np.ndarray:
        """Probabilities of the languages for each stretch."""
        return _softmax(self.scores(found) / self.temperature)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _descend(data: list[tuple[list[int], int]], languages: int, epochs: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Stochastic gradient descent; gives embeddings times output layer, and bias."""
    rng = np.random.default_rng(seed)
    embedding = rng.normal(0, 0.1, (BUCKETS, SIZE)).astype(np.float32)
    output, bias = rng.normal(0, 0.1, (SIZE, languages)).astype(np.float32), np.zeros(languages, np.float32)
    steps = [rng.permutation(len(data)) for _ in range(epochs)]
    batch, done, total = 64, 0, max(1, epochs * len(data))
    for order in steps:
        for i in range(0, len(order), batch):
            part = [data[j] for j in order[i : i + batch]]
            rate = 4.0 * (1 - done / total) + 0.05
            done += len(part)
            sizes = np.array([len(x) for x, _ in part])
            buckets = np.concatenate([x for x, _ in part])
            starts = np.r_[0, np.cumsum(sizes)[:-1]]
            hidden = np.add.reduceat(embedding[buckets], starts, axis=0) / sizes[:, None]
            wrong = _softmax(hidden @ output + bias)
            wrong[np.arange(len(part)), [y for _, y in part]] -= 1
            back = (wrong @ output.T) / sizes[:, None]
            output -= rate / len(part) * hidden.T @ wrong
            bias -= rate / len(part) * wrong.sum(0)
            # Each stretch moves its own embeddings by its own step.
            np.subtract.at(embedding, buckets, np.repeat(0.25 * rate * back, sizes, axis=0).astype(np.float32))
    return embedding @ output, bias


def _reject(sure: np.ndarray, right: np.ndarray) -> tuple[float, float]:
    """(bound, share of wrong labels) from judgements on held-out rows, whose labels can be wrong themselves.

    How many of the labels are wrong shows in the surer half. The chance of being right for a
    confidence comes from isotonic regression, as a share of what the labels allow; the bound is
    the least confidence with a chance of RIGHT, and never less than that.
    """
    order = np.argsort(sure, kind="stable")
    allowed = max(float(right[order][len(order) // 2 :].mean()), 1e-9)
    blocks: list[list[float]] = []  # right ones, rows, least confidence
    for confidence, good in zip(sure[order], right[order], strict=True):
        blocks.append([float(good), 1, float(confidence)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1][0] += last[0]
            blocks[-1][1] += last[1]
    bound = next((least for good, rows, least in blocks if good / rows >= RIGHT * allowed), 1.0)
    return max(RIGHT, bound), 1 - allowed


def _temperature(logits: np.ndarray, truth: np.ndarray, wrong: float) -> float:
    """The temperature of least log loss, given the share of labels that are wrong; by golden section."""

    def loss(log_t: float) -> float:
        p = _softmax(logits / np.exp(log_t))[np.arange(len(truth)), truth]
        return float(-np.log((1 - wrong) * p + wrong / logits.shape[1] + 1e-9).mean())

    low, high, cut = np.log(0.1), np.log(10), (5**0.5 - 1) / 2
    for _ in range(30):
        a, b = high - cut * (high - low), low + cut * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(texts: list[str], labels: list[str], codes: list[str], epochs: int = 4, seed: int = 7) -> LanguageModel:
    """A model from texts with labels of which some are wrong and some texts mixed.

    A tenth of the texts, as they are, is held out. A first model is fitted on the others;
    stretches whose label it finds unlikely don't count for the second. The held-out texts give
    the temperature and the bounds below which the judgement of a stretch or of a text is
    rejected. Stretches count whole; a long one is several examples.
    """
    rng = np.random.default_rng(seed)
    held_out, data, tests = rng.random(len(texts)) < 0.1, [], []
    for text, label, held in zip(texts, labels, held_out, strict=True):
        found = stretches(text)
        if held and found:
            tests.append((found, codes.index(label)))
        for script, words in found if not held else ():
            for part in np.array_split(words, -(-len(words) // EXAMPLE)) if len(words) >= 3 else ():
                data.append(([b for w in part for b in _features(str(w), script)], codes.index(label), (script, words)))
    if not data:
        return LanguageModel(codes, np.zeros((BUCKETS, len(codes)), np.float32), np.zeros(len(codes), np.float32), bound=1.1, text_bound=1.1)
    first = LanguageModel(codes, *_descend([d[:2] for d in data], len(codes), 2, seed))
    own = first.judge([d[2] for d in data])[np.arange(len(data)), [d[1] for d in data]]
    clean = [d[:2] for d, p in zip(data, own, strict=True) if p >= 0.3] or [d[:2] for d in data]
    model = LanguageModel(codes, *_descend(clean, len(codes), epochs, seed + 1))
    tests = tests or [([d[2]], d[1]) for d in data]
    clauses = [(s, y) for found, y in tests for s in found if _full(*s)] or [(s, y) for found, y in tests for s in found]
    logits, truth = model.scores([s for s, _ in clauses]), np.array([y for _, y in clauses])
    # What is surest and how many labels are wrong hardly depends on the temperature, which depends on the latter.
    _, wrong = _reject(_softmax(logits).max(1), logits.argmax(1) == truth)
    model.temperature = _temperature(logits, truth, wrong)
    p = _softmax(logits / model.temperature)
    model.bound, _ = _reject(p.max(1), p.argmax(1) == truth)
    whole = np.stack([model.whole(model.judge(found), found) for found, _ in tests])
    model.text_bound, _ = _reject(whole.max(1), whole.argmax(1) == np.array([y for _, y in tests]))
    return model


def fit_model(df: DataFrame, id_col: str, text_col: str, label_col: str, label_codes: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    """A model fitted on the labelled rows whose ids hash lowest, `sample` of them at most.

    label_codes has (code, forms); labels are compared without regard to letter case and outer
    blanks. Only this bounded sample reaches the driver.
    """
    forms = _forms(label_codes)
    rows = pick(df, id=id_col, text=text_col, label=label_col).filter("text is not null")
    rows = rows.join(F.broadcast(forms), F.lower(F.trim("label")) == F.col("form"))
    held = lowest(rows.select("id", "text", "code"), ["id", "text"], sample, rows.count()).collect()
    codes = sorted({r["code"] for r in label_codes.select("code").filter("code is not null").limit(MOST_FORMS).collect()})
    unique = {(r["hash"], r["text"]): r["code"] for r in held}
    return fit([t for _, t in unique], list(unique.values()), codes)


def _forms(label_codes: DataFrame) -> DataFrame:
    """(form, code), one row a form; small enough to be broadcast, which is checked."""
    forms = label_codes.select("code", F.explode("forms").alias("form")).groupBy(F.lower("form").alias("form")).agg(F.min("code").alias("code"))
    held = forms.limit(MOST_FORMS + 1).collect()
    if len(held) > MOST_FORMS:
        raise ValueError(f"there are more than {MOST_FORMS} forms of labels")
    return label_codes.sparkSession.createDataFrame([(r["form"], r["code"]) for r in held], T.StructType([T.StructField("form", T.StringType()), T.StructField("code", T.StringType())]))


def languages(df: DataFrame, id_col: str, text_col: str, model: LanguageModel, carry: list[str] = ()) -> DataFrame:
    """The language of each text and of its stretches: (id, lang, confidence, stretches, then the columns `carry`).

    `stretches` is an array of (lang, confidence, words), one for each run of sentences of one
    language, in order within a script. A sentence of fewer than LEAST_WORDS words (of Chinese or
    Japanese, LEAST_CHARACTERS characters) says nothing and gives none; a judgement below the
    model's bound has a null language. The text's own language is the one with the most
    confidence by words over all its sentences, short ones included; null if the model rejects it.

    One row per input row, repeated rows and null ids too. Null, empty and wordless texts have a
    null language, confidence 0 and no stretches. Texts are taken whole.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    carried = {f"c{i}": c for i, c in enumerate(carry)}
    rows = pick(df, id=id_col, text=text_col, **carried)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            parts = [stretches(t) if t else [] for t in batch.column("text").to_pylist()]
            flat = [s for p in parts for s in p]
            p = m.judge(flat)
            best = p.argmax(1) if len(p) else np.zeros(0, int)
            sure = p.max(1) if len(p) else np.zeros(0)
            lang, confidence, runs, at = [], [], [], 0
            for part in parts:
                n = len(part)
                if not n:
                    lang.append(None)
                    confidence.append(0.0)
                    runs.append([])
                    continue
                whole = m.whole(p[at : at + n], part)
                k = int(whole.argmax())
                lang.append(m.codes[k] if whole[k] >= m.text_bound else None)
                confidence.append(float(whole[k]))
                out: list[list] = []
                for (script, words), b, c in zip(part, best[at : at + n], sure[at : at + n], strict=True):
                    if not _full(script, words):
                        continue
                    code, c, size = m.codes[b] if c >= m.bound else None, float(c), len(words)
                    if out and out[-1][0] == code:
                        out[-1][1] = (out[-1][1] * out[-1][2] + c * size) / (out[-1][2] + size)
                        out[-1][2] += size
                    else:
                        out.append([code, c, size])
                runs.append([{"lang": a, "confidence": b, "words": c} for a, b, c in out])
                at += n
            run = pa.struct([("lang", pa.string()), ("confidence", pa.float64()), ("words", pa.int32())])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(lang, pa.string()), pa.array(confidence, pa.float64()), pa.array(runs, pa.list_(run)), *[batch.column(c) for c in carried]], names=["id", "lang", "confidence", "stretches", *carried])

    run = T.StructType([T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("words", T.IntegerType())])
    schema = T.StructType([rows.schema["id"], T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("stretches", T.ArrayType(run)), *[rows.schema[c] for c in carried]])
    return rows.mapInArrow(judge, schema).select(F.col("id").alias(id_col), "lang", "confidence", "stretches", *[F.col(c).alias(n) for c, n in carried.items()])


def label_meaning(df: DataFrame, label_col: str, label_codes: DataFrame, into: str) -> DataFrame:
    """df with the code that a label means, null for null, blank and unknown labels. The list of codes is small by nature."""
    forms = F.broadcast(_forms(label_codes).select(F.col("form").alias("__form"), F.col("code").alias(into)))
    return df.join(forms, F.lower(F.trim(F.col(label_col))) == F.col("__form"), "left").drop("__form")
