"""Text normalisation and tokenisation as Column functions.

Python runs only where Spark has no built-in function (compatibility composition, accent folding, scripts), as
Arrow UDFs that see null for every string that is plain ASCII.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that say nothing about a name or an address, and words that mark kinds of places.
COMMON_NAME_TOKENS = ("the", "and", "company", "co", "corporation", "corp", "inc", "incorporated", "llc", "ltd", "limited", "pvt", "private", "llp", "plc", "group", "india")
COMMON_ADDRESS_TOKENS = (
    "road", "street", "st", "rd", "avenue", "ave", "lane", "ln", "drive", "dr", "highway", "hwy", "boulevard", "blvd", "building", "floor", "block", "near",
    "beside", "opposite", "district", "city", "town", "village", "state", "india", "usa", "us",
)
STREET_MARKERS = ("road", "street", "st", "rd", "avenue", "ave", "lane", "ln", "drive", "dr", "highway", "hwy", "boulevard", "blvd", "parkway", "pkwy", "way", "place", "pl")
LANDMARK_MARKERS = ("building", "mall", "market", "plaza", "tower", "complex", "temple", "hospital", "school", "college", "university", "airport", "station", "church", "hotel")
CITY_MARKERS = {
    "recoveries": ("city", "town", "village", "municipality", "county", "district"),
    "impact": ("city", "town", "village", "county", "district", "township", "cdp"),
}
SCRIPTS = (
    "LATIN", "DEVANAGARI", "BENGALI", "GURMUKHI", "GUJARATI", "ORIYA", "TAMIL", "TELUGU", "KANNADA", "MALAYALAM", "SINHALA", "THAI", "ARABIC", "HEBREW", "CYRILLIC", "GREEK",
)

_NOT_ASCII = r"[^\x00-\x7F]"
#: Composition changes nothing in ASCII and the letters of Latin-1. Two ranges only: more make the test slow.
_MAY_COMPOSE = r"[^\x00-\x7FÀ-ÿ]"


def _beyond_ascii(x: Column) -> Column:
    return F.when(x.rlike(_NOT_ASCII), x)


@F.pandas_udf(T.StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


@F.pandas_udf(T.StringType())
def _fold(values: pd.Series) -> pd.Series:
    def fold(v: str | None) -> str | None:
        return None if v is None else "".join(c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c))

    return values.map(fold)


@cache
def _script(c: str) -> str | None:
    if unicodedata.category(c)[0] not in "LM":
        return None
    name = unicodedata.name(c, "")
    return next((s for s in SCRIPTS if s in name), None)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _scripts(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else sorted({s for s in map(_script, v) if s}))


def text_of(x: Column) -> Column:
    """The string, empty where it is null."""
    return F.coalesce(x.cast("string"), F.lit(""))


def normalize_text(x: Column) -> Column:
    """Lower-cased, then composed (NFKC), ``&`` as the word and, all but letters, numbers and marks as single spaces.

    Composition comes after lower-casing, so capitals that it makes stay.
    """
    low = F.lower(F.trim(text_of(x)))
    composed = F.coalesce(_nfkc(F.when(low.rlike(_MAY_COMPOSE), low)), low)
    return F.trim(F.regexp_replace(F.replace(composed, F.lit("&"), F.lit(" and ")), r"[^\p{L}\p{N}\p{M}]+", " "))


normalize_name = normalize_address = normalize_text


def stripped(x: Column) -> Column:
    """Without white space of any kind at both ends; ``trim`` takes spaces only."""
    return F.regexp_replace(x, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def country_key(x: Column) -> Column:
    return F.lower(stripped(text_of(x)))


def _words(normal: Column) -> Column:
    return F.filter(F.split(normal, " "), lambda t: t != "")


def _not_in(words: tuple[str, ...]):
    stop = F.array(*[F.lit(w) for w in words])
    return lambda t: ~F.array_contains(stop, t)


def is_number(token: Column) -> Column:
    return token.rlike(r"^\p{Nd}+$")


def name_tokens(normal: Column, least: int = 4) -> Column:
    """Informative tokens of a normalised name in order, repeats included."""
    keep = _not_in(COMMON_NAME_TOKENS)
    return F.filter(_words(normal), lambda t: (F.length(t) >= least) & keep(t))


def address_tokens(normal: Column, least: int = 4) -> Column:
    """Informative tokens of a normalised address in order, repeats included; numbers of any length count."""
    keep = _not_in(COMMON_ADDRESS_TOKENS)
    return F.filter(_words(normal), lambda t: keep(t) & (is_number(t) | (F.length(t) >= least)))


def unique_tokens(normal: Column, common: tuple[str, ...], least: int) -> Column:
    """The set of tokens of at least ``least`` characters that aren't common."""
    keep = _not_in(common) if common else lambda t: F.lit(True)
    return F.array_distinct(F.filter(_words(normal), lambda t: (F.length(t) >= least) & keep(t)))


def name_tokens_len3(normal: Column) -> Column:
    return unique_tokens(normal, COMMON_NAME_TOKENS, 3)


def three_letter_tokens(normal: Column) -> Column:
    return F.filter(name_tokens_len3(normal), lambda t: F.length(t) == 3)


def numeric_tokens(tokens: Column) -> Column:
    return F.filter(tokens, is_number)


def light_normal(x: Column) -> Column:
    """Lower-cased with single spaces; punctuation stays. Used by the rule experiments."""
    return F.trim(F.regexp_replace(F.lower(text_of(x)), r"(?U)\s+", " "))


def accent_fold(x: Column) -> Column:
    """Normalised without accents."""
    normal = normalize_text(x)
    return F.coalesce(_fold(_beyond_ascii(normal)), normal)


def address_parts(address: Column) -> Column:
    """struct(city, state): the last two non-empty comma-separated parts; both empty where there are fewer."""
    parts = F.filter(F.transform(F.split(text_of(address), ","), light_normal), lambda p: p != "")
    whole = F.size(parts) >= 2
    return F.struct(*[F.when(whole, F.element_at(parts, k)).otherwise("").alias(n) for k, n in ((-2, "city"), (-1, "state"))])


def address_words(address: Column, with_tokens: bool) -> Column:
    """White-space words of an address; with its informative tokens where the recoveries report asks for them."""
    words = F.array_distinct(F.filter(F.split(light_normal(address), " "), lambda t: t != ""))
    return F.array_union(address_tokens(normalize_text(address)), words) if with_tokens else words


def count_matches(x: Column) -> Column:
    """Comma-separated entries of a truth cell, blank ones included; 0 for an empty cell."""
    return F.when(stripped(text_of(x)) == "", 0).otherwise(F.size(F.split(text_of(x), ",")))


def scripts(x: Column) -> Column:
    """The sorted set of scripts of the letters and marks."""
    text = text_of(x)
    latin = F.when(text.rlike("[A-Za-z]"), F.array(F.lit("LATIN"))).otherwise(F.array().cast("array<string>"))
    return F.coalesce(_scripts(_beyond_ascii(text)), latin)


def cross_script(left: Column, right: Column) -> Column:
    """Both have scripts and share none."""
    return (F.size(left) > 0) & (F.size(right) > 0) & ~F.arrays_overlap(left, right)
