"""Exact dedup against SQL, and against a plain grouping of texts where identifiers collide."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest

from tributary.llm.exact_dedup import exact_dedup, keep_one


def low(t: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def plain(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[low(t)].append(d)
    out = []
    for d, t in rows:
        keep = max((x for x in groups[low(t)] if x is not None), default=None)
        out.append((d, keep, len(groups[low(t)]), d is None or d == keep, hashlib.sha256(low(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=repr)



@pytest.mark.parametrize("bits", [64, 3])
def test_cases_with_and_without_colliding_identifiers(spark, bits):
    body = "The quick brown fox jumps over it. " * 60
    rows = [(1, None), (2, ""), (3, "Ab"), (4, "aB"), (4, "aB"), (5, "ÄB"), (6, "äb"), (None, "AB"), (None, "q"), (7, body), (8, body.upper()), (9, body + "!"), (10, "x" * 5000), (11, "x" * 5001), (12, "ΑΣ"), (13, "ας"), (14, "x" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 recipe", "'k' keep_id", "2 id", "3 norm")
    assert got(exact_dedup(docs, bits)) == plain(rows)


def test_only_ascii_capitals_are_lowered(spark):
    """Capitals of any Unicode version, some of whose lower cases are ASCII or of another length."""
    pairs = [("\ua7c0", "\ua7c1"), ("\U00010570", "\U00010597"), ("\u2c2f", "\u2c5f"), ("\u212a", "k"), ("\u0130", "i\u0307"), ("\u1e9e", "\u00df"), ("\u00c9A", "\u00e9a"), ("\u03a3", "\u03c2"), ("\u24b6", "\u24d0")]
    rows = [(2 * i + k, f"Q {t} {i}") for i, p in enumerate(pairs) for k, t in enumerate(p)] + [(100, "q \ua7c0 0")]
    assert got(exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"))) == plain(rows)


def test_the_kept_rows(spark):
    rows = [(1, "a"), (2, "A"), (3, "b"), (None, "a"), (2, "A")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 kept", "2 recipe")
    left = keep_one(docs)
    assert left.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == [(2, "A"), (2, "A"), (3, "b"), (None, "a")]
    assert exact_dedup(docs.limit(0)).count() == 0


def test_a_repeated_id_loses_only_its_copies(spark):
    rows = [(1, "unique"), (1, "copy"), (2, "Copy"), (3, None), (3, "x"), (4, "")]
    left = keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == [(1, "unique"), (2, "Copy"), (3, "x"), (4, "")]
