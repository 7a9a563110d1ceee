r"""Scalar functions on names, companies and markup, as column expressions.

Java's ``\s`` and ``\w`` are ASCII only; ``(?U)`` makes them Unicode, which the
name rules need. Missing text is the empty string here, never null: callers fill
nulls right after a read.
"""

from __future__ import annotations

import html
import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Company suffixes that don't tell companies apart.
COMPANY_SUFFIXES = ["inc", "llc", "ltd", "limited", "corp", "corporation", "co", "gmbh", "srl", "s.r.l", "plc"]

#: How a page may mark the agency behind a name, by option value.
VENDOR_TAGS = {
    "suffix": r"\s*\(([A-Z0-9][A-Z0-9\s&.,\-]{1,50}|[A-Za-z][A-Za-z0-9\s&.,\-]{1,50}\b(?:LLC|Inc\.?|Corp\.?|Ltd\.?|Co\.?))\)\s*$",
    "any-parenthetical": r"\s*\(\s*(?!www\.|https?://)([^()]{1,60}?)\s*\)\s*$",
    "any-bracket": r"\s*[\(\[]\s*(?!www\.|https?://)([^()\[\]]{1,60}?)\s*[\)\]]\s*$",
    "square": r"\s*\[\s*([^\[\]]{1,60}?)\s*\]\s*$",
}


def clean_name(c: Column) -> Column:
    """Line-break tags and runs of any white space become one space; ends are trimmed."""
    one = F.regexp_replace(c, r"(?i)<br\s*/?>", " ")
    return F.trim(F.regexp_replace(one, r"(?U)[\s\x{A0}]+", " "))


def fold(text: str | None) -> str:
    """The spelling key of a name: no marks, no punctuation, lower case, single spaces."""
    plain = "".join(ch for ch in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(ch))
    return " ".join(re.sub(r"[^\w ]", "", plain).lower().split())


def _code_points(chars: list[str]) -> str:
    """A character class of the given characters, as ranges."""
    points, out = sorted(map(ord, chars)), []
    for c in points:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "[" + "".join(rf"\x{{{x:X}}}-\x{{{y:X}}}" for x, y in out) + "]"


@lru_cache(1)
def _foldings() -> tuple[str, str, str, list[tuple[str, str]], str, dict[str, str]]:
    """Compatibility decomposition without combining marks, as tables for ``translate``.

    (characters that become one other, and marks, which go; what they become; the class
    of characters that become several; for the first, second and third place of those that
become two or three, (characters, theirs); the class of those that become three; the
few that become more).
    """
    one, gone, many = {}, [], {}
    for c in map(chr, (*range(0xD800), *range(0xE000, 0x110000))):
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(plain) > 1:
            many[c] = plain
        elif plain != c:
            (gone.append(c) if plain == "" else one.update({c: plain}))
    short = {c: p for c, p in many.items() if len(p) < 4}
    places = [("".join(c for c, p in short.items() if len(p) > i), "".join(p[i] for p in short.values() if len(p) > i)) for i in range(3)]
    longer = {c: p for c, p in many.items() if len(p) > 3}
    return "".join(one) + "".join(gone), "".join(one.values()), _code_points(list(many)), places, _code_points([c for c, p in short.items() if len(p) == 3]), longer


def normalise_name(name: Column | str) -> Column:
    """:func:`fold` as an expression: no Python runs. Texts with characters that decompose into several take a slower way, character by character."""
    c = F.col(name) if isinstance(name, str) else name
    before, after, several, (first, second, third), three, longer = _foldings()
    table = F.create_map(*(F.lit(x) for pair in longer.items() for x in pair))
    parts = lambda x: F.concat(F.translate(x, *first), F.translate(x, *second), F.when(x.rlike(three), F.translate(x, *third)).otherwise(""))
    each = lambda x: F.when(x.rlike(several), F.coalesce(F.try_element_at(table, x), parts(x))).otherwise(x)
    whole = F.coalesce(c, F.lit(""))
    plain = F.when(whole.rlike(several), F.array_join(F.transform(F.split(whole, ""), each), "")).otherwise(whole)
    plain = F.when(whole.rlike(r"[^\x00-\x7F]"), F.translate(plain, before, after)).otherwise(whole)
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(plain, r"[^\p{L}\p{N}_ ]", "")), " +", " "))


def slug(key: Column) -> Column:
    """The id text of a spelling key."""
    dashed = F.regexp_replace(key, "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(dashed, "^-+|-+$", ""), F.lit("")), F.lit("unknown"))


def is_compound(c: Column) -> Column:
    """Does one credit name several people?"""
    low = F.lower(c)
    return low.contains(" and ") | c.contains("&") | low.startswith("composed by")


def normalise_studio(c: Column) -> Column:
    """The key of a company: lower case, no corporate suffixes however many, no outer stops."""
    low = F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " ")))
    names = "|".join(re.escape(s) for s in COMPANY_SUFFIXES)
    return F.btrim(F.regexp_replace(low, rf"(?:[,\s]+(?:{names})\.?[ .,]*)+$", ""), F.lit(" .,"))


def split_vendor_tag(c: Column, mode: str | bool | None) -> tuple[Column, Column]:
    """(text without its trailing agency, the agency or ''); ``mode`` is a key of VENDOR_TAGS, True for suffix, or falsy."""
    if not mode:
        return c, F.lit("")
    pattern = VENDOR_TAGS["suffix" if mode is True else mode]
    return F.regexp_replace(c, pattern, ""), clean_name(F.regexp_extract(c, pattern, 1))


def heading_from_ref(ref: Column) -> Column:
    """What a source reference itself says about the heading: '' for line and row numbers."""
    head = F.substring_index(F.trim(ref), "#", 1)
    return F.when(F.trim(ref).contains(":") | head.rlike(r"^L\d+$"), "").otherwise(F.replace(head, F.lit("/"), F.lit(" ")))


def strip_links(c: Column) -> Column:
    """Wiki links to what is shown."""
    return F.regexp_replace(c, r"\[\[(?:[^\]|]+\|)?([^\]|]+)\]\]", "$1")


def link_targets(c: Column) -> Column:
    """Wiki links to the page they lead to, whatever is shown."""
    return F.regexp_replace(c, r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]", "$1")


@F.pandas_udf(StringType())
def _entities(c: pd.Series) -> pd.Series:
    return c.map(lambda t: None if t is None else html.unescape(t))


def strip_markup(text: Column | str) -> Column:
    """Tags out, entities resolved, white space collapsed; only texts with an ampersand go to Python, for the entities."""
    c = F.col(text) if isinstance(text, str) else text
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^>]+>", " ")
    whole = F.coalesce(_entities(F.when(F.contains(bare, F.lit("&")), bare)), bare)
    # what Python's str.split takes for white space
    return F.trim(F.regexp_replace(whole, r"[\x09-\x0D\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+", " "))


def percent(part: Column, whole: Column) -> Column:
    """Whole per cent, halves to even, 0 of nothing."""
    return F.when(whole == 0, 0).otherwise(F.bround(100.0 * part / whole, 0)).cast("int")
