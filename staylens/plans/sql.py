"""Pieces of the SQL that the queries are compared with."""

from __future__ import annotations

from collections.abc import Iterable

from staylens.functions import fixed

WS = f"[{fixed.SPACE}]"


def array(values: Iterable[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def any_of(value: str, phrases: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({value}, '{p}')" for p in phrases) + ")"


def stripped(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def squeezed(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def normalized(x: str) -> str:
    """Letters in runs of three or more once: one goes if it equals the one before and that, or the next, equals too."""
    chars = f"string_split(regexp_replace({stripped(f'lower({x})')}, '[^\\p{{L}}\\p{{N}}_{fixed.SPACE}]+', ' ', 'g'), '')"
    kept = f"list_transform(list_filter(list_zip(chars_, list_concat([''], chars_[:-2]), list_concat(['', ''], chars_[:-3]), list_concat(chars_[2:], [''])), lambda z: NOT (regexp_matches(z[1], '^[a-zà-ỹđ]$') AND z[1] = z[2] AND (z[2] = z[3] OR z[1] = z[4]))), lambda z: z[1])"
    return squeezed(f"(SELECT array_to_string({kept}, '') FROM (SELECT {chars} AS chars_))")


def tokens_of(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-zA-ZÀ-ỹ0-9_]+')"
