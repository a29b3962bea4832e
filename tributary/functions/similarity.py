"""Similarities of strings and token sets, and the measures built from them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CACHED_PAIRS = 250_000


@lru_cache(CACHED_PAIRS)
def _ratio(left: str, right: str) -> float:
    return SequenceMatcher(None, left, right).ratio()


@F.pandas_udf(T.DoubleType())
def _character_similarity(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for left, right in batches:
        yield pd.Series([None if a is None or b is None else _ratio(a, b) for a, b in zip(left, right, strict=True)], dtype="float64")


def similarity_bound(left: Column, right: Column) -> Column:
    """What the character similarity can't exceed: twice the characters that both have, repeats counted, over all of both."""
    times = lambda x, c: F.length(x) - F.length(F.replace(x, c, F.lit("")))
    both = F.aggregate(F.array_distinct(F.split(left, "")), F.lit(0), lambda n, c: n + F.least(times(left, c), times(right, c)))
    whole = F.length(left) + F.length(right)
    return F.when(whole == 0, 1.0).otherwise(2.0 * both / whole)


def character_similarity(left: Column, right: Column, least: float | None = None) -> Column:
    """Matching-block ratio of two strings; the order of the arguments matters.

    Equal strings, and pairs with an empty side, are answered without Python. With ``least`` so are pairs whose lengths or
    characters bound it below that; their value is the bound.
    """
    easy = F.when(left == right, 1.0).when((left == "") | (right == ""), 0.0)
    hard = (left != right) & (left != "") & (right != "")
    if least is not None:
        lengths = 2.0 * F.least(F.length(left), F.length(right)) / (F.length(left) + F.length(right))
        bound = F.when(lengths < least, lengths).otherwise(similarity_bound(left, right))
        easy = easy.when(bound < least, bound)
        hard &= bound >= least
    return F.coalesce(easy, _character_similarity(F.when(hard, left), F.when(hard, right)))


def edit_distance(left: Column, right: Column) -> Column:
    return F.levenshtein(left, right)


def edit_similarity(left: Column, right: Column) -> Column:
    """1 - distance / longer length; 1 for two empty strings."""
    longer = F.greatest(F.length(left), F.length(right))
    return F.when(longer == 0, 1.0).otherwise(1 - edit_distance(left, right) / longer)


def shared(left: Column, right: Column) -> Column:
    return F.size(F.array_intersect(left, right))


def jaccard(left: Column, right: Column) -> Column:
    """Shared / all tokens; 1 for two empty sets."""
    union = F.size(F.array_union(left, right))
    return F.when(union == 0, 1.0).otherwise(shared(left, right) / union)


def overlap_coefficient(left: Column, right: Column) -> Column:
    """Shared tokens / size of the smaller set; 0 if a set is empty."""
    smaller = F.least(F.size(F.array_distinct(left)), F.size(F.array_distinct(right)))
    return F.when(smaller == 0, 0.0).otherwise(shared(left, right) / smaller)


def contains_either(left: Column, right: Column) -> Column:
    """Neither is empty, and one holds the other."""
    return (left != "") & (right != "") & (F.contains(left, right) | F.contains(right, left))


def name_signals(left: Column, right: Column, left_tokens: Column, right_tokens: Column) -> Column:
    """struct of what the reports ask of two lightly normalised names and their sets of informative tokens."""
    return F.struct(
        (left == right).alias("exact"),
        character_similarity(left, right).alias("similarity"),
        edit_similarity(left, right).alias("edit_similarity"),
        contains_either(left, right).alias("contains"),
        shared(left_tokens, right_tokens).alias("shared_tokens"),
        overlap_coefficient(left_tokens, right_tokens).alias("token_overlap"),
    )


def likely_typo_or_accent(left: Column, right: Column, similarity: Column, left_folded: Column, right_folded: Column) -> Column:
    """Different, but equal without accents, or a few edits apart and similar enough."""
    longer = F.greatest(F.length(left), F.length(right))
    near = (edit_distance(left, right) <= F.greatest(F.lit(2), F.rint(0.12 * longer).cast("int"))) & (similarity >= 0.85)
    return (left != "") & (right != "") & (left != right) & ((left_folded == right_folded) | near)


def f_half(precision: Column, recall: Column) -> Column:
    return F.when((precision == 0) & (recall == 0), 0.0).otherwise(1.25 * precision * recall / (0.25 * precision + recall))


def safe_ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where there is nothing to divide by."""
    return F.when(whole == 0, 0.0).otherwise(part / whole)


@lru_cache(10_000)
def _beside(either: str, token: str) -> re.Pattern[str]:
    word = rf"\b{re.escape(token)}\b"
    return re.compile(rf"\b(?:{either})\b[^,;]*{word}|{word}[^,;]*\b(?:{either})\b")


def marked(markers: tuple[str, ...]):
    """A column function: does a token stand with a marker in one part of a text, in either order?

    Only texts that hold the token and a marker at all go to Python.
    """
    either = "|".join(map(re.escape, markers))

    @F.pandas_udf(T.BooleanType())
    def near_marker(tokens: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([bool(a and b and _beside(either, a).search(b)) for a, b in zip(tokens, texts, strict=True)], dtype="boolean")

    def column(token: Column, text: Column) -> Column:
        can = F.coalesce((token != "") & F.contains(text, token) & text.rlike(either), F.lit(False))
        return can & F.coalesce(near_marker(F.when(can, token), F.when(can, text)), F.lit(False))

    return column
