"""Ordered classifications of pairs and tokens: the first condition that holds names the class.

Rows are pairs with the prepared fields of both records as ``s1_...`` and ``target_...`` columns
(``features.joined``). Labels are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions import similarity as s
from tributary.functions import text as t

RAW = ("business_name", "business_address", "country_key", "name", "address", "name_set", "address_set", "number_set")
FUZZY_NAME, FUZZY_ADDRESS = 0.82, 0.80


def s1(field: str) -> Column:
    return F.col(f"s1_{field}")


def target(field: str) -> Column:
    return F.col(f"target_{field}")


def cascade(rules: list[tuple[str, Column]], otherwise: str) -> Column:
    out = F.lit(otherwise)
    for name, condition in reversed(rules):
        out = F.when(condition, name).otherwise(out)
    return out


def missed_pair_signals(rows: DataFrame) -> DataFrame:
    """The signals of missed pairs, and their class ``pattern``."""
    short = lambda x: t.three_letter_tokens(x("name"))
    rows = rows.withColumns(
        {
            "name_similarity": s.character_similarity(s1("name"), target("name")),
            "address_similarity": s.character_similarity(s1("address"), target("address")),
            "shared_name_tokens": s.shared(s1("name_set"), target("name_set")),
            "shared_three_letter": s.shared(short(s1), short(target)),
            "exact_normalized_name": s1("name") == target("name"),
            "name_token_overlap": s.overlap_coefficient(s1("name_set"), target("name_set")),
            "shared_address_count": s.shared(s1("address_set"), target("address_set")),
            "shared_numeric_count": s.shared(s1("number_set"), target("number_set")),
        }
    )
    typo = lambda f: s.likely_typo_or_accent(s1(f), target(f), F.col(f"{f}_similarity"), t.accent_fold(s1(f)), t.accent_fold(target(f)))
    other_script = lambda f: t.cross_script(t.scripts(s1(f)), t.scripts(target(f)))
    rows = rows.withColumns(
        {
            "current_address_rule": F.col("shared_address_count") >= 2,
            "fuzzy_name_potential": (F.col("shared_name_tokens") == 0) & (F.col("name_similarity") >= FUZZY_NAME),
            "fuzzy_address_potential": (F.col("shared_address_count") < 2) & (F.col("address_similarity") >= FUZZY_ADDRESS),
            "cross_script": other_script("business_name") | other_script("business_address"),
            "typo_or_accent": typo("name") | typo("address"),
        }
    )
    rules = [
        ("CROSS_SCRIPT", F.col("cross_script")),
        ("TYPO_OR_ACCENT", F.col("typo_or_accent")),
        ("FUZZY_NAME_POTENTIAL", F.col("fuzzy_name_potential")),
        ("FUZZY_ADDRESS_POTENTIAL", F.col("fuzzy_address_potential")),
        ("NAME_MATCH", F.col("exact_normalized_name") | (F.col("shared_name_tokens") > 0) | (F.col("shared_three_letter") > 0)),
        ("ADDRESS_MATCH", F.col("shared_address_count") > 0),
    ]
    return rows.withColumn("pattern", cascade(rules, "NO_STRONG_SIGNAL"))


def _both_addresses() -> Column:
    return F.lower(F.concat_ws(" ", s1("business_address"), target("business_address")))


def _has(words: Column, markers: tuple[str, ...]) -> Column:
    return F.arrays_overlap(words, F.array(*[F.lit(m) for m in markers]))


def token_class(token: Column) -> Column:
    """What kind of word a shared token is, by its form and by both addresses."""
    words = t.address_words(_both_addresses(), with_tokens=True)
    return cascade(
        [
            ("numeric/address component", t.is_number(token)),
            ("generic/noisy token", token.isin(*t.COMMON_ADDRESS_TOKENS) | (F.length(token) <= 3)),
            ("street/road", s.marked(t.STREET_MARKERS)(token, _both_addresses())),
            ("landmark/building", _has(words, t.LANDMARK_MARKERS)),
            ("city/town", _has(words, t.CITY_MARKERS["recoveries"])),
        ],
        "distinctive business/location term",
    )


def collision_pattern(token: Column) -> Column:
    """Why unrelated businesses share a token."""
    words = t.address_words(_both_addresses(), with_tokens=False)
    return cascade(
        [
            ("common numeric address component", t.is_number(token)),
            ("generic address word", token.isin(*t.COMMON_ADDRESS_TOKENS)),
            ("same street but unrelated business", s.marked(t.STREET_MARKERS)(token, _both_addresses())),
            ("same building/landmark but different business", _has(words, t.LANDMARK_MARKERS)),
            ("same city/town but unrelated business", _has(words, t.CITY_MARKERS["impact"])),
        ],
        "other shared-location collision",
    )


def with_name_signals(rows: DataFrame) -> DataFrame:
    """Rows with the struct ``signals`` of their names and ``different_scripts`` of names and addresses together."""
    both = lambda side: F.concat_ws(" ", side("business_name"), side("business_address"))
    scripts = t.cross_script(t.scripts(both(s1)), t.scripts(both(target)))
    signals = s.name_signals(t.light_normal(s1("business_name")), t.light_normal(target("business_name")), s1("name_set"), target("name_set"))
    return rows.withColumn("signals", signals).withColumn("different_scripts", scripts)


def name_pattern() -> Column:
    """How the names of a true pair relate; asks for ``with_name_signals``."""
    x = F.col("signals")
    similar, shares, holds = x["similarity"], x["shared_tokens"] > 0, x["contains"]
    name = F.lower(target("business_name"))
    domain = name.rlike(r"\.(?:com|net|org)\z") | F.contains(name, F.lit(".com"))
    return cascade(
        [
            ("cross-script + 1 address token", F.col("different_scripts")),
            ("exact/near-exact name + 1 address token", x["exact"]),
            ("domain/DBA name + 1 address token", domain & ((similar >= 0.65) | holds | shares)),
            ("shared name token + 1 address token", shares & (similar >= 0.70)),
            ("strong name similarity + 1 address token", similar >= 0.82),
            ("moderate name signal + 1 address token", (similar >= 0.60) | holds),
            ("shared name token + 1 address token", shares),
        ],
        "weak/no name signal",
    )


def combined_signal() -> Column:
    x = F.col("signals")
    rules = [("shared name token + address token", x["shared_tokens"] > 0), ("name containment + address token", x["contains"]), ("name similarity + address token", x["similarity"] >= 0.60)]
    return cascade(rules, "address token only")


def with_place(rows: DataFrame) -> DataFrame:
    """Rows with ``same_city`` and ``same_state``, from the last two parts of the addresses."""
    a, b = t.address_parts(s1("business_address")), t.address_parts(target("business_address"))
    same = lambda f: (a[f] != "") & (a[f] == b[f])
    return rows.withColumn("same_city", same("city")).withColumn("same_state", same("state"))


def collision_reason() -> Column:
    """Why a false pair came in; asks for ``token``, ``with_place`` and ``address_similarity``."""
    return cascade(
        [
            ("numeric address collision", t.is_number(F.col("token"))),
            ("same direct city component", F.col("same_city")),
            ("same direct state/region component", F.col("same_state")),
            ("high address similarity", F.col("address_similarity") >= 0.80),
        ],
        "single textual address-token collision",
    )
