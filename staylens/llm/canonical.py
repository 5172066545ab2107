"""Visually identical text with different characters, brought to one form."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staylens.llm.common import pick

#: Letters that look like a plain Latin one, and that one.
LOOKALIKES = {
    # Cyrillic
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l", "ѵ": "v", "г": "r", "п": "n",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ԍ": "G", "Ӏ": "I",
    # Greek
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "υ": "u", "τ": "t", "γ": "y", "χ": "x", "η": "n", "ε": "e", "ω": "w", "ϲ": "c", "ϳ": "j", "σ": "o", "μ": "u",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    # Armenian
    "օ": "o", "ս": "u", "ո": "n", "հ": "h", "ց": "g", "զ": "q", "Օ": "O", "Ս": "U",
    # Coptic
    "Ⲃ": "B", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "Ⲣ": "P", "Ⲥ": "C", "Ⲧ": "T", "Ⲭ": "X", "ⲟ": "o", "ⲣ": "p", "ⲥ": "c",
    # Cherokee
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    # Lisu
    "ꓮ": "A", "ꓐ": "B", "ꓚ": "C", "ꓓ": "D", "ꓰ": "E", "ꓝ": "F", "ꓖ": "G", "ꓧ": "H", "ꓲ": "I", "ꓙ": "J", "ꓗ": "K", "ꓡ": "L", "ꓟ": "M", "ꓠ": "N", "ꓳ": "O", "ꓑ": "P", "ꓣ": "R", "ꓢ": "S", "ꓔ": "T", "ꓴ": "U", "ꓦ": "V", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓜ": "Z",
    # Latin letters of the same look as another
    "ð": "đ", "Ð": "Đ", "Ɖ": "Đ", "ɖ": "đ", "ı": "i", "ɩ": "i", "ɑ": "a", "ɡ": "g", "ɪ": "i", "ʏ": "y", "ⅼ": "l", "ⅰ": "i", "ⅴ": "v", "ⅹ": "x", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m",
}
_INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\U000e0000-\U000e0fff\x00-\x08\x0e-\x1b\x7f-\x84\x86-\x9f"
_SPACES = "\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"
_JOINED = "\ufb00-\ufb06\u0132\u0133\u0149\u01c4-\u01cc\u01f1-\u01f3"
_WIDE = "\uff10-\uff19\uff21-\uff3a\uff41-\uff5a"
_STYLED = "\U0001d400-\U0001d7ff"

_ODD = re.compile(f"[{_INVISIBLE}{_SPACES}{_JOINED}{_WIDE}{_STYLED}]")
_LOOK = re.compile(f"[{''.join(LOOKALIKES)}]")
_LATIN = re.compile(r"[A-Za-zªºÀ-ÖØ-öø-ʸḀ-ỿⱠ-Ɀ]")
_WORD = re.compile("(?:[^\\W\\d_]|[\u0300-\u036f])+")
#: Scripts with no letter that could pass for a Latin one.
_FAR = re.compile("[\u0590-\u1dff\u2e80-\ud7ff\uf900-\ufaff\uff66-\uffdc]")
#: What belongs to an emoji: joiners and selectors in their places, tags after a flag.
_EMOJI = regex.compile(r"(?:\p{Emoji}\ufe0f?\u20e3|\p{Extended_Pictographic}[\ufe0e\ufe0f]?\p{EMod}?[\U000e0020-\U000e007f]*(?:\u200d\p{Extended_Pictographic}[\ufe0e\ufe0f]?\p{EMod}?)*|[#*0-9]\ufe0f)")
_NAMES = ["accent", "width", "invisible", "space", "joined", "lookalike"]


@lru_cache(maxsize=1)
def _unstable() -> re.Pattern:
    """A segment around characters whose quick check for composed form isn't Yes.

    No: the character is never in composed form. Maybe: it can combine with what stands before;
    these are the marks and the second halves of canonical pairs. A segment begins at the starter
    before and ends before the next stable starter.
    """
    no, maybe = set(), {chr(c) for c in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]}
    for code in [*range(0x80, 0xD800), *range(0xE000, 0x20000), *range(0x2F800, 0x2FA20)]:
        c = chr(code)
        if unicodedata.combining(c):
            maybe.add(c)
        parts = unicodedata.decomposition(c)
        if parts and parts[0] != "<":
            if unicodedata.normalize("NFC", c) != c:
                no.add(c)
            elif " " in parts:
                maybe.add(chr(int(parts.split()[1], 16)))
    codes = sorted(map(ord, no | maybe))
    firsts = [c for c, before in zip(codes, [-1, *codes]) if c != before + 1]
    lasts = [c for c, after in zip(codes, [*codes[1:], -1]) if c + 1 != after]
    both = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(firsts, lasts, strict=True))
    return re.compile(f"[^{both}]?[{both}]+", re.DOTALL)


def _compose(text: str) -> str:
    """Composed form, made for the unstable segments only and spliced into the rest."""
    if unicodedata.is_normalized("NFC", text):  # the quick check of the whole text
        return text
    return _unstable().sub(lambda m: unicodedata.normalize("NFC", m.group()), text)


def _plain_odd(text: str, kinds: set[str]) -> str:
    keep = [m.span() for m in _EMOJI.finditer(text)] if regex.search("[\u200d\ufe0e\ufe0f\U000e0020-\U000e007f]", text) else []

    def plain(m: re.Match) -> str:
        c = m.group()
        if any(a <= m.start() < b for a, b in keep):
            return c
        code = ord(c)
        if 0xFF10 <= code <= 0xFF5A:
            kinds.add("width")
            return chr(code - 0xFEE0)
        if unicodedata.category(c) == "Zs":
            kinds.add("space")
            return " "
        if code >= 0x1D400 and code <= 0x1D7FF:
            kinds.add("lookalike")
            return unicodedata.normalize("NFKC", c)
        if unicodedata.category(c)[0] == "L" and c not in "\u115f\u1160\u3164\uffa0":
            kinds.add("joined")
            return unicodedata.normalize("NFKC", c)
        kinds.add("invisible")
        return ""

    return _ODD.sub(plain, text)


def _plain_words(text: str, kinds: set[str]) -> str:
    @lru_cache(maxsize=1)
    def unlike() -> bool:
        """Whether some word is surely in another alphabet."""
        words = [w for w in _WORD.findall(text) if not _FAR.search(w)]
        return any(not _LATIN.search(w) and any(c not in LOOKALIKES and not unicodedata.combining(c) for c in w) for w in words)

    def plain(m: re.Match) -> str:
        word = m.group()
        # A word of look-alikes alone is one only where no word is surely in that alphabet.
        if not _LOOK.search(word) or (not _LATIN.search(word) and (_FAR.search(word) or unlike())):
            return word
        kinds.add("lookalike")
        return "".join(LOOKALIKES.get(c, c) for c in word)

    return _WORD.sub(plain, text)


def canonical(text: str) -> tuple[str, list[str]]:
    """The one form of a text, and the kinds of change that led to it.

    Accents and syllable parts join their letters; full-width letters and digits, joined letter
    forms and look-alike letters in Latin words become plain; other spaces become U+0020 and
    invisible characters go. Emoji, line breaks, punctuation, symbols and text in its own script
    stay as they are. A text in this form comes back the same.
    """
    if text.isascii() and text.isprintable():
        return text, []
    kinds: set[str] = set()
    out = _plain_odd(text, kinds) if _ODD.search(text) else text
    if _LOOK.search(out) and _LATIN.search(out):
        out = _plain_words(out, kinds)
    done = _compose(out)
    if done != out:
        kinds.add("accent")
    return done, [k for k in _NAMES if k in kinds]


def canonical_text(df: DataFrame, id_col: str, text_col: str, changed_only: bool = False) -> DataFrame:
    """Each text in its one form: (id, text, kinds), kinds naming the changes, empty where none was needed.

    One row per input row, repeated rows and null ids too; null stays null, empty stays empty and
    blank texts are treated like others. Texts are taken whole; each is read once, and only its
    unstable segments are normalised. `changed_only` keeps the rows that had to be changed.
    """
    rows = pick(df, id=id_col, text=text_col)

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [(None, []) if t is None else canonical(t) for t in batch.column("text").to_pylist()]
            out = pa.RecordBatch.from_arrays([batch.column("id"), pa.array([t for t, _ in done], pa.string()), pa.array([k for _, k in done], pa.list_(pa.string()))], names=["id", "text", "kinds"])
            yield out.filter(pa.array([bool(k) for _, k in done], pa.bool_())) if changed_only else out

    schema = T.StructType([rows.schema["id"], T.StructField("text", T.StringType()), T.StructField("kinds", T.ArrayType(T.StringType()))])
    return rows.mapInArrow(plain, schema).select(F.col("id").alias(id_col), F.col("text").alias(text_col), "kinds")
