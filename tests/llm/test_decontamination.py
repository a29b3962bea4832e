"""Decontamination against a comparison of all words at all places, without seeds."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
import regex

from tributary.llm.decontamination import REGION, SPAN, contaminated, masks_of, passages, remove_contaminated

SF = "/root/testdata/sf0.01"


def words(t):
    return regex.findall(r"[\p{L}\p{M}\p{N}]+", (t or "").lower())


def plain(docs, items):
    """What holds a passage by the definition: items laid beside documents at every place, no seeds."""
    return {(d, i) for d, i, *_ in aligned(docs, items)}


def aligned(docs, items):
    """(doc, item, similarity, equal words, overlap) of the best place."""
    out = []
    coded: dict[str, int] = {}
    code = lambda t: np.array([coded.setdefault(w, len(coded)) for w in words(t)], np.int64)
    docs, items = [(d, code(t)) for d, t in docs], [(i, code(t)) for i, t in items]
    for item, b in items:
        if not len(b):
            continue
        for doc, h in {(d, tuple(h)): (d, h) for d, h in docs}.values():
            best = None
            i = np.flatnonzero(np.isin(h, b))
            j, k = np.nonzero(b[:, None] == h[i][None])
            equal = np.bincount(i[k] - j + len(b))  # words by shift; where they are too few in all, no region has enough
            shifts = np.arange(len(equal)) - len(b)
            beside = np.minimum(len(b), len(h) - shifts) - np.maximum(0, -shifts)
            for shift in shifts[(5 * equal >= 4 * np.minimum(beside, REGION)) & (beside >= min(len(b), SPAN))].tolist():
                lo, hi = max(0, -shift), min(len(b), len(h) - shift)
                if hi - lo < min(len(b), SPAN):
                    continue
                same = np.r_[0, np.cumsum(b[lo:hi] == h[lo + shift : hi + shift])]
                n = min(REGION, hi - lo)
                agree = (same[n:] - same[:-n]).max()
                if 5 * agree >= 4 * n:
                    best = max(best or (0,), (agree / n, int(same[-1]), -shift, hi - lo))
            if best:
                out.append((doc, item, best[0], best[1], best[3]))
    return out


@pytest.mark.parametrize("n", range(1, REGION + 1))
def test_no_placement_of_substitutions_escapes_all_masks(n):
    """Every way to substitute as many of ``n`` words as the similarity allows leaves a place for one of the masks."""
    allowed = n - math.ceil(0.8 * n - 1e-9)
    for spots in itertools.combinations(range(n), allowed):
        left = set(range(n)) - set(spots)
        assert any({o + k for k, c in enumerate(m) if c == "1"} <= left for m in masks_of(n) for o in range(n - len(m) + 1)), spots


def test_all_documents(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()}
    assert got == want and len(want) > 3
    left = {r.doc_id for r in remove_contaminated(docs, bench).collect()}
    assert left == {r.doc_id for r in docs.select("doc_id").collect()} - {d for d, _ in want}


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_substitutions_short_items_and_both_joins(spark, limit):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate([40, 60, 30, 12, 11, 5, 1, 24])] + [(90, None), (91, ""), (92, "W1 w2, W3 w4")]
    items += [(93, items[0][1].upper())]
    docs = []
    for d in range(40):
        text = rng.choices(vocabulary, k=rng.randint(0, 80))
        if d % 2:
            part = items[d % 8][1].split()
            part = [w if rng.random() > 0.12 else rng.choice(vocabulary) for w in part]
            text[5:5] = part[: rng.randint(len(part) // 2, len(part))]
        docs.append((d, " ".join(text)))
    docs += [(100, None), (101, ""), (None, items[1][1]), (102, "w1 w2 w3; w4"), (103, items[2][1]), (103, items[2][1]), (104, items[2][1] * 400)]
    a = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 item", "2 h", "3 size", "4 i", "5 item_id")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 doc_id", "2 b")
    got = {(r.doc_id, r.item_id) for r in passages(a, b, broadcast_words=limit).collect()}
    assert got == plain(docs, items)
    assert passages(a.limit(0), b).count() == 0 and passages(a, b.limit(0)).count() == 0
    left = remove_contaminated(a, b)
    assert left.columns == a.columns and {r.doc_id for r in left.collect()} == {d for d, _ in docs} - {d for d, _ in got}


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_every_placement_of_substitutions_is_found(spark, limit):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    sizes = [36, 60, 1, 2, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24]
    items = [(n, " ".join(rng.choices(vocabulary, k=n))) for n in sizes]
    docs = []
    for n, text in items:
        for _ in range(12):
            part = text.split()
            begin = rng.randint(0, max(0, n - 24))  # of the 24 words that must be found; those outside are others
            part = [w if begin <= k < begin + 24 else "outside" for k, w in enumerate(part)]
            for k in rng.sample(range(begin, begin + min(n, 24)), min(n, 24) // 5):
                part[k] = "other"
            docs.append((len(docs), " ".join([*rng.choices(vocabulary, k=15), *part, *rng.choices(vocabulary, k=15)])))
    for spots in [(8, 9, 10, 11), (2, 5, 8, 11), (3, 7, 11, 15), (3, 7, 11, 14)]:
        part = ["other" if k in spots else w for k, w in enumerate(items[-5][1].split())]
        docs.append((len(docs), " ".join(["x", *part, "y"])))
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in passages(a, b, broadcast_words=limit).collect()}
    want = aligned(docs, items)
    assert len(want) >= len(docs) and got == {x[:2] for x in want}
    best = {(r.doc_id, r.item_id, r.similarity, r.equal_words, r.overlap_words) for r in contaminated(a, b).collect()}
    assert best == set(want)


def test_random_substitutions_are_all_found(spark):
    """Recall by length of the item and number of substituted words, at the stated similarity: 1."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(5000)]
    items = [(n, " ".join(rng.choices(vocabulary, k=n))) for n in (5, 8, 11, 12, 15, 16, 20, 24, 40)]
    docs = []
    for n, text in items:
        for changed in range(min(n, REGION) // 5 + 1):
            for _ in range(30):
                part = text.split()
                for k in rng.sample(range(min(n, REGION)), changed):
                    part[k] = "other"
                docs.append((len(docs), n, " ".join([*rng.choices(vocabulary, k=20), *part, *rng.choices(vocabulary, k=20)])))
    a, b = spark.createDataFrame(docs, "doc_id long, of long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contaminated(a, b).collect()}
    assert {(d, n) for d, n, _ in docs} <= got


def test_one_word_repeated_very_often(spark):
    """Equal words side by side make one comparison for each diagonal, not one for each pair of places."""
    docs = [(1, "na " * 50_000), (2, "na nu " * 2_000), (3, "nu " + "na " * 30 + "nu")]
    items = [(1, "na " * 400), (2, "nu na " * 100), (3, "na " * 24), (4, "hey " + "na " * 11)]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.equal_words, r.overlap_words) for r in contaminated(a, b).collect()}
    assert got[1, 1] == (1.0, 400, 400) and got[2, 2] == (1.0, 200, 200) and got[3, 3] == (1.0, 24, 24)
    assert got[1, 4] == (11 / 12, 11, 12)
    assert set(got) == {(1, 1), (1, 3), (1, 4), (2, 2), (3, 1), (3, 3), (3, 4)}
