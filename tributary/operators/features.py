"""The twenty pair features, in an order that models rely on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions import similarity as s
from tributary.storage import settled

FEATURES = (
    "exact_name", "name_character_similarity", "name_edit_similarity", "name_token_overlap_count", "name_token_jaccard", "name_length_difference", "name_contains",
    "exact_address", "address_character_similarity", "address_token_overlap_count", "address_token_jaccard", "numeric_token_overlap_count", "numeric_token_jaccard",
    "address_component_count", "address_contains", "same_country", "name_address_similarity_product", "strong_name_weak_address", "weak_name_strong_address",
    "strong_name_same_country",
)
_FIELDS = ("name", "address", "country_key", "name_set", "address_set", "number_set")


def joined(pairs: DataFrame, s1: DataFrame, targets: DataFrame, fields: tuple[str, ...] = _FIELDS) -> DataFrame:
    """Pairs with the prepared fields of both records, as s1_... and target_...

    Many pairs to one record: an id that no record has, or that several have, is an error when the rows are read,
    so no pair is lost or doubled silently.
    """
    for records, key, side in ((s1, "s1_id", "s1"), (targets, "candidate_id", "target")):
        one = records.groupBy(F.col("entity_id").alias(key)).agg(F.count("*").alias("_n"), F.first(F.struct(*fields)).alias("_r"))
        wrong = F.concat(F.lit("no single record has the id "), F.coalesce(key, F.lit("null")))
        found = F.when(F.col("_n") == 1, F.col("_r")).otherwise(F.raise_error(wrong))
        pairs = pairs.join(one, key, "left").withColumn("_r", found)
        pairs = pairs.select(*[c for c in pairs.columns if c not in ("_n", "_r")], *[F.col("_r")[f].alias(f"{side}_{f}") for f in fields])
    return pairs


def _similar(rows: DataFrame, field: str) -> DataFrame:
    """Rows with the character similarity of a field: each different pair of strings is compared once."""
    left, right = f"s1_{field}", f"target_{field}"
    strings = rows.filter(F.col(left) != F.col(right)).select(left, right).distinct()
    measured = strings.withColumn("similarity", s.character_similarity(F.col(left), F.col(right)))
    equal = F.when(F.col(left) == F.col(right), 1.0)
    return rows.join(measured, [left, right], "left").withColumn(f"{field}_similarity", F.coalesce(equal, "similarity")).drop("similarity")


def _flag(condition: Column) -> Column:
    return condition.cast("double")


def set_features(rows: DataFrame) -> dict[str, Column]:
    """The features that compare without characters' order: built-in functions only."""
    a, b = (lambda f: F.col(f"s1_{f}")), (lambda f: F.col(f"target_{f}"))
    overlap = lambda f: s.shared(a(f), b(f)).cast("double")
    return {
        "exact_name": _flag(a("name") == b("name")),
        "name_edit_similarity": s.edit_similarity(a("name"), b("name")),
        "name_token_overlap_count": overlap("name_set"),
        "name_token_jaccard": s.jaccard(a("name_set"), b("name_set")),
        "name_length_difference": F.abs(F.length(a("name")) - F.length(b("name"))).cast("double"),
        "name_contains": _flag(s.contains_either(a("name"), b("name"))),
        "exact_address": _flag(a("address") == b("address")),
        "address_token_overlap_count": overlap("address_set"),
        "address_token_jaccard": s.jaccard(a("address_set"), b("address_set")),
        "numeric_token_overlap_count": overlap("number_set"),
        "numeric_token_jaccard": s.jaccard(a("number_set"), b("number_set")),
        "address_component_count": overlap("address_set"),
        "address_contains": _flag(s.contains_either(a("address"), b("address"))),
        "same_country": _flag(a("country_key") == b("country_key")),
    }


def pair_features(pairs: DataFrame, s1: DataFrame, targets: DataFrame) -> DataFrame:
    """The columns of ``pairs`` and the twenty features as doubles; cast to float only where they are stored."""
    rows = settled(joined(pairs, s1, targets))  # read for the pairs of strings, and to bring their similarities back
    for field in ("name", "address"):
        rows = _similar(rows, field)
    return rows.select(*pairs.columns, *_features(rows))


def row_features(rows: DataFrame, keep: list[str]) -> DataFrame:
    """The same of pairs that have the fields of both records, where they are made: similarities are remembered by each worker, and nothing is shuffled."""
    both = [(F.col(f"s1_{f}"), F.col(f"target_{f}")) for f in ("name", "address")]
    rows = rows.withColumns({f"{f}_similarity": s.character_similarity(a, b) for f, (a, b) in zip(("name", "address"), both, strict=True)})
    return rows.select(*keep, *_features(rows))


def _features(rows: DataFrame) -> list[Column]:
    name, address = F.col("name_similarity"), F.col("address_similarity")
    columns = set_features(rows)
    columns |= {
        "name_character_similarity": name,
        "address_character_similarity": address,
        "name_address_similarity_product": name * address,
        "strong_name_weak_address": _flag((name >= 0.85) & (address < 0.60)),
        "weak_name_strong_address": _flag((name < 0.60) & (address >= 0.80)),
        "strong_name_same_country": _flag((name >= 0.85) & (columns["same_country"] == 1)),
    }
    return [columns[f].alias(f) for f in FEATURES]


def stored(features: DataFrame) -> DataFrame:
    """Features as they are written: single precision."""
    return features.withColumns({f: F.col(f).cast("float") for f in FEATURES})
