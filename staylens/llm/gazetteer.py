"""Free-entered values mapped to a list of canonical names."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staylens.llm.canonical import LOOKALIKES, canonical
from staylens.llm.common import pick

#: The list is held by every task; it is checked against this number of entries.
MOST_ENTRIES = 200_000
NONE = -1
#: Token sets: least score, least distance to the second-best entry, what a word counts that is one slip off.
LIKE, MARGIN, SLIP = 0.75, 0.1, 0.75

# How addresses are written.
_STREET = ["đường", "duong", "phố", "pho", "hẻm", "hem", "ngõ", "ngo", "kiệt", "kiet", "đl", "đại lộ", "dai lo", "street", "st.", "road"]
_BEFORE = ["thành phố", "thanh pho", "thị xã", "thi xa", "thị trấn", "thi tran", "tp", "tx", "tt", "tỉnh", "tinh", "huyện", "huyen", "quận", "quan", "khu vực", "khu vuc", "du lịch", "du lich", "city of"]
_AFTER = ["province", "city", "town", "việt nam", "viet nam", "vietnam", "vn", "mới", "tỉnh lẻ", "tinh le"]

_SPLIT = re.compile(r"\s*[,;/|()\n]\s*|\s+[-–—]\s+")
_IS_STREET = re.compile(r"^(?:số\s+|so\s+)?\d+[\w/.-]*\s+|^(?:" + "|".join(map(re.escape, _STREET)) + r")(?:\s|(?<=\.))")
_IS_BEFORE = re.compile(r"^(?:" + "|".join(map(re.escape, _BEFORE)) + r")(?:\s*\.\s*|\s+)(?=\S)")
_IS_AFTER = re.compile(r"\s+(?:" + "|".join(map(re.escape, _AFTER)) + r")$")
_SHORT = re.compile(r"^(\w)(?:\s*\.\s*|\s+)(\w.*)$")
_LETTERS = re.compile(r"[^\W_]+")
#: Keys of the common input method for the marks and tones of Vietnamese letters.
_MARK_KEYS = {"\u0302": None, "\u0306": "w", "\u031b": "w", "\u0301": "s", "\u0300": "f", "\u0309": "r", "\u0303": "x", "\u0323": "j"}


def fold(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c)).replace("\u0111", "d")


def typed(text: str) -> str:
    """The keys struck for a text by an input method that was off: marks after their letter, tones after the word."""
    out = []
    for word in text.lower().split():
        keys, tone = "", ""
        for letter in unicodedata.normalize("NFC", word):
            base, *marks = unicodedata.normalize("NFD", letter)
            keys += "dd" if base == "đ" else base
            for mark in marks:
                key = _MARK_KEYS.get(mark, "")
                if mark == "\u0302":
                    keys += base
                elif key == "w":
                    keys += key
                else:
                    tone += key
        out.append(keys + tone)
    return "".join(out)


def _bytes(text: str) -> bytes:
    out = bytearray()
    for c in text:
        try:
            out += c.encode("cp1252")
        except UnicodeEncodeError:
            out += c.encode("latin-1")
    return bytes(out)


def repaired(text: str) -> str:
    """A text whose UTF-8 bytes were read as Western European ones, read again; others as they are."""
    text = unicodedata.normalize("NFC", text).strip()
    if not re.search("[ÃÄÅÆá][\x80-\xffŒ-™]", re.sub("[\u200b-\u200f\u2060\ufeff]", "", text)):
        return text
    seen = re.sub("[\u200b-\u200f\u2060\ufeff]", "", text)
    spaced = re.sub("[\u2000-\u200a\u202f\u3000]", " ", seen)
    # A soft hyphen or a fixed space may be a byte of a letter or not.
    for out in (text, seen, spaced, spaced.replace("\xad", ""), spaced.replace("\xa0", " "), spaced.replace("\xad", "").replace("\xa0", " ")):
        try:
            return _bytes(out).decode("utf-8")
        except UnicodeError:
            continue
    return text


def _plain(value: str) -> str:
    text, _ = canonical(repaired(value))
    text = "".join(LOOKALIKES.get(c, c) for c in text)
    return re.sub(r"[\s_]+", " ", unicodedata.normalize("NFC", text).lower()).strip()


def one_edit(a: str, b: str) -> bool:
    """Whether one letter added, left out, put for another or two neighbours swapped makes a of b."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y or x == y[1:] or x[1:] == y[1:] or (len(x) > 1 and len(y) > 1 and x[0] == y[1] and x[1] == y[0] and x[2:] == y[2:])


def _shorter(text: str) -> set[str]:
    return {text, *(text[:i] + text[i + 1 :] for i in range(len(text)))}


class Gazetteer:
    """Index of the canonical names and aliases: an automaton for mentions, and forms for the rest."""

    def __init__(self, entries: list[tuple[int, str, list[str]]]):
        self.exact = {}
        self.with_accents, self.without = ahocorasick.Automaton(), ahocorasick.Automaton()
        self.joined, self.keys, self.shorter, self.by_last = (defaultdict(set) for _ in range(4))
        self.words: set[tuple[bool, str]] = set()  # whether a name's first word, the word
        # For the token sets: the forms that have a word without accents, and those words by what a slip leaves of them.
        self.forms: list[tuple[int, list[str]]] = []
        self.having, self.slipped = defaultdict(list), defaultdict(set)
        plain: dict[str, set] = defaultdict(set)
        full: dict[str, set] = defaultdict(set)
        for entry, name, aliases in entries:
            if name:
                self.exact.setdefault(name, entry)
            for form in [name, *(aliases or [])]:
                text = " ".join(_LETTERS.findall(_plain(form or "")))
                if not text:
                    continue
                self.forms.append((entry, text.split()))
                for word in {fold(w) for w in text.split()}:
                    self.having[word].append(len(self.forms) - 1)
                full[text].add((entry, text))
                plain[fold(text)].add((entry, text))
                self.words.update((i == 0, w) for x in (text, fold(text)) for i, w in enumerate(x.split()))
                for x in {text, fold(text)}:
                    whole = x.replace(" ", "")
                    self.joined[whole].add((entry, text))
                    for s in _shorter(whole):
                        self.shorter[s].add((entry, x))
                    first, _, rest = x.partition(" ")
                    if rest:
                        self.by_last[first[0], rest].add((entry, text))
                self.keys[typed(text)].add((entry, text))
        for word in self.having:
            for s in _shorter(word):
                self.slipped[s].add(word)
        for automaton, forms in ((self.with_accents, full), (self.without, plain)):
            for text, owners in forms.items():
                automaton.add_word(f" {text} ", (len(text) + 2, owners))
            automaton.make_automaton()
        self.cached = lru_cache(maxsize=100_000)(self._find)

    @staticmethod
    def _mentions(automaton: ahocorasick.Automaton, text: str) -> list[tuple[int, int, set]]:
        """Longest non-overlapping mentions, as (start, end, owners)."""
        if not len(automaton):
            return []
        hits = sorted(((end - size + 1, end, owners) for end, (size, owners) in automaton.iter(f" {text} ")), key=lambda h: (h[0] - h[1], h[0]))
        taken: list[tuple[int, int, set]] = []
        for start, end, owners in hits:
            if all(end <= a or start >= b for a, b, _ in taken):  # neighbours share the space between
                taken.append((start, end, owners))
        return sorted(taken, key=lambda h: h[0])

    @staticmethod
    def _agree(written: str, name: str) -> bool:
        """Whether the accents that are written are the name's: they may be left out, not differ."""
        a, b = unicodedata.normalize("NFC", written), unicodedata.normalize("NFC", name)
        if len(a) != len(b):
            return False
        for x, y in zip(a, b, strict=True):
            p, q = (unicodedata.normalize("NFD", "d\u0335" if c == "\u0111" else c) for c in (x, y))
            if p[:1] != q[:1] or not set(p[1:]) <= set(q[1:]):
                return False
        return True

    @staticmethod
    def _one(owners) -> int | None:
        """The entry, if they all are the same one."""
        found = {entry for entry, _ in owners}
        return next(iter(found)) if len(found) == 1 else None

    def find(self, value: str | None) -> int:
        """The entry that a value denotes, or NONE."""
        return NONE if value is None else self.cached(value)

    def _find(self, value: str) -> int:
        if value in self.exact:
            return self.exact[value]
        parts = [p for p in _SPLIT.split(_plain(value)) if p]
        places = []
        for part in parts:
            if _IS_STREET.match(part):
                continue
            was = None
            while was != part:
                was, part = part, _IS_AFTER.sub("", _IS_BEFORE.sub("", part).strip())
            places.append(part)
        texts = [" ".join(_LETTERS.findall(p)) for p in places]
        # The town comes last in an address.
        for text in reversed(texts):
            for _, _, owners in reversed(self._mentions(self.with_accents, text)):
                if (entry := self._one(owners)) is not None:
                    return entry
        for text in reversed(texts):
            for start, end, owners in reversed(self._mentions(self.without, fold(text))):
                written = f" {text} "[start + 1 : end]
                if (entry := self._one([o for o in owners if self._agree(written, o[1])])) is not None:
                    return entry
        for part, text in zip(reversed(places), reversed(texts), strict=True):
            for look in (self._whole, self._initial, self._similar, self._token_set):
                if (entry := look(part, text)) is not None:
                    return entry
        return NONE

    def _whole(self, part: str, text: str) -> int | None:
        """Words run together, or keys of an input method."""
        whole = text.replace(" ", "")
        owners = self.joined.get(whole) or [o for o in self.joined.get(fold(whole), ()) if self._agree(whole, o[1].replace(" ", ""))] or self.keys.get(whole, ())
        return self._one(owners)

    def _initial(self, part: str, text: str) -> int | None:
        """The first word cut to its letter."""
        if not (m := _SHORT.match(part)):
            return None
        rest = " ".join(_LETTERS.findall(m[2]))
        owners = self.by_last.get((m[1], rest)) or self.by_last.get((fold(m[1]), rest), ())
        return self._one(owners)

    def _similar(self, part: str, text: str) -> int | None:
        """The letters of a name, but for one slip.

        A word that is one of other names in the same place, first or later, isn't a slip: it makes
        another name, not in the list.
        """
        words, whole = text.split(), text.replace(" ", "")
        if len(whole) < 4:
            return None
        near = set()
        for s in _shorter(whole):
            for entry, name in self.shorter.get(s, ()):
                if one_edit(whole, name.replace(" ", "")):
                    theirs = name.split()
                    other = [(i == 0, w) for i, w in enumerate(words) if w not in theirs]
                    if len(words) != len(theirs) or not other or any(w not in self.words for w in other):
                        near.add((entry, name))
        return self._one(near)

    def _token_set(self, part: str, text: str) -> int | None:
        """The entry whose words are most like the value's as a set, in any order, some missing, others more.

        The score is the words in common, twice, as a share of the words of both. Accents may be
        missing; a word with one slip counts SLIP, unless it is a word of other names. The best
        entry must have LIKE and be MARGIN ahead of the second best. A single word says too little.
        """
        words = text.split()
        if len(words) < 2:
            return None
        known = {w: [fold(w)] if fold(w) in self.having else [t for s in _shorter(fold(w)) for t in self.slipped.get(s, ()) if len(w) > 2 and one_edit(fold(w), t)] for w in words}
        often = {w: sum(len(self.having[t]) for t in set(ts)) for w, ts in known.items()}
        # Who reaches LIKE shares so many words that one of the rarest of these is among them.
        least = math.ceil(LIKE * len(words) / (2 - LIKE) - 1e-9)
        probes = sorted(words, key=lambda w: often[w])[: len(words) - least + 1]
        forms = {f for w in probes for t in known[w] for f in self.having[t]}
        # With the accents as they are written first, then with missing ones.
        for agree in (str.__eq__, self._agree):
            best: dict[int, float] = {}
            for entry, theirs in (self.forms[f] for f in forms):
                left, common = list(theirs), 0.0
                for w in words:
                    if (same := next((t for t in left if agree(w, t)), None)) is not None:
                        left.remove(same)
                        common += 1
                for w in words:
                    if fold(w) not in self.having and (near := next((t for t in left if fold(t) in known[w]), None)) is not None:
                        left.remove(near)
                        common += SLIP
                best[entry] = max(best.get(entry, 0.0), 2 * common / (len(words) + len(theirs)))
            (first, score), *others = sorted(best.items(), key=lambda e: -e[1]) or [(NONE, 0.0)]
            if score >= LIKE:
                return first if all(score - other >= MARGIN - 1e-9 for _, other in others[:1]) else None
        return None


def map_values(df: DataFrame, id_col: str, value_col: str, entries: DataFrame, entry_id: str, name_col: str, aliases_col: str) -> DataFrame:
    """Each value's entry in the list: (id, value, entry id, exact, blank); -1 where it denotes none.

    Values are compared in their one form (see canonical_text), misread bytes read again. Mentions
    of names and aliases are found by one automaton, the longest first and without overlap; accents
    may be missing but not differ. Streets don't count, the town does. What is left is tried with
    its words run together, cut to an initial, typed without the input method or with one letter
    wrong, and then by token-set similarity: the words of both as sets, from LIKE on and MARGIN
    ahead of the second-best entry. A value that suits several entries alike denotes none.

    One row per input row, repeated rows and null ids too. Null and blank values get -1 and
    `blank`; `exact` says that the value is a canonical name to the letter. An empty list maps
    everything to -1. The list must have at most MOST_ENTRIES entries, which is checked; entries
    with null names count by their aliases, and of two entries of one name the lower id is exact.
    """
    held = pick(entries, e=entry_id, n=name_col, a=aliases_col).filter("e is not null").orderBy("e").limit(MOST_ENTRIES + 1).collect()
    if len(held) > MOST_ENTRIES:
        raise ValueError(f"the list has more than {MOST_ENTRIES} entries")
    shared = df.sparkSession.sparkContext.broadcast([(r["e"], r["n"], r["a"]) for r in held])
    rows = pick(df, id=id_col, value=value_col)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Gazetteer(shared.value)
        for batch in batches:
            values = batch.column("value").to_pylist()
            more = [pa.array([index.find(v) for v in values], pa.int64()), pa.array([v in index.exact for v in values], pa.bool_()), pa.array([v is None or not canonical(v)[0].strip() for v in values], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=["id", "value", "entry", "exact", "blank"])

    schema = T.StructType([rows.schema["id"], T.StructField("value", T.StringType()), T.StructField("entry", T.LongType()), T.StructField("exact", T.BooleanType()), T.StructField("blank", T.BooleanType())])
    return rows.mapInArrow(find, schema).select(F.col("id").alias(id_col), F.col("value").alias(value_col), F.col("entry").alias(entry_id), "exact", "blank")
