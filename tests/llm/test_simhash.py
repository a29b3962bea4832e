"""SimHash against a plain computation of fingerprints, links and components."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from tributary.llm import components
from tributary.llm.components import connected_components
from tributary.llm.simhash import GrayIndex, fingerprint, keep_one, links, near_duplicates

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text: str) -> int:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(fps: dict[int, int], bits: int = 4) -> dict[int, int]:
    root = {d: d for d in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def test_fingerprints_follow_the_definition():
    for text in ["", " \t ", "a", "A b", "a b c d", "a b c d e", "Éa É x\x85y z\xa0w B c", "w " * 500, "tie a\x1cb c d e f g"]:
        assert fingerprint(text.encode()) == plain_fingerprint(text), text


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    fps = {d: plain_fingerprint(t) for d, t in texts.items()}
    want = plain_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in near_duplicates(docs).collect()}
    assert got == {d: (f"{fps[d]:016x}", want[d]) for d in texts}


@pytest.mark.parametrize("limit", [20_000, 60, 9])
def test_links_at_every_tier_of_dealing(spark, limit):
    rng = random.Random(limit)
    centres = [rng.getrandbits(64) for _ in range(4)]
    codes = {rng.getrandbits(64) for _ in range(100)}
    for c in centres:
        for _ in range(60):
            x = c
            for b in rng.sample(range(64), rng.randint(0, 7)):
                x ^= 1 << b
            codes.add(x)
    fps = dict(enumerate(sorted(codes)))
    signed = [(f - (1 << 64) if f >> 63 else f, i) for i, f in fps.items()]
    classes = spark.createDataFrame(signed, "fp long, rep long")
    found = {r.node: r.component for r in connected_components(links(classes, limit=limit)).collect()}
    assert {i: found.get(i, i) for i in fps} == plain_components(fps)


def test_index_prunes_nothing_that_links():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
    codes = np.unique(np.concatenate([base ^ (np.uint64(1) << np.uint64(k)) for k in range(60)]))
    groups = np.sort(rng.integers(0, 3, len(codes)))
    label = GrayIndex(codes, groups).forest(4)
    for g in range(3):
        at = np.flatnonzero(groups == g)
        want = plain_components({int(i): int(codes[i]) for i in at})
        assert {int(i): int(label[i]) for i in at} == want


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}


@pytest.mark.parametrize("share", [1 << 16, 16])
def test_few_links_are_one_task_and_many_are_dealt(spark, monkeypatch, share):
    monkeypatch.setattr(components, "LINKS_A_TASK", share)
    monkeypatch.setattr(components, "_signature", lambda links, f=components._signature: (rounds.append(1), f(links))[1])
    rounds: list[int] = []
    path = [(i, i + 1) for i in range(60)] + [(-5, 100 + i) for i in range(30)] + [(7, 7), (None, 3)]
    found = connected_components(spark.createDataFrame(path, "a long, b long").repartition(8))
    got = {r.node: r.component for r in found.collect()}
    assert got == {i: 0 for i in range(61)} | {i: -5 for i in (-5, *range(100, 130))}
    assert len(rounds) == 1 if share > 90 else len(rounds) >= 2  # one task that has all links needs no round of joins


def test_a_repeated_id_loses_only_its_near_copies(spark):
    rows = [(5, "one two three four five six"), (2, "x y z w v"), (5, "x y z w v"), (7, None), (7, "one two three four five six")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.text or "") for r in keep_one(docs).collect())
    assert got == [(2, "x y z w v"), (5, "one two three four five six"), (7, "")]
    assert {r.component_id for r in near_duplicates(docs).filter("doc_id = 5").collect()} == {2, 5}


def test_nulls_empty_texts_and_repeats(spark):
    long = "word " * 30_000
    rows = [(5, None), (6, ""), (7, "  "), (8, long), (8, long), (9, long), (None, long), (10, "one two three four five")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' fp", "1 g", "2 rep", "3 component_id")
    got = sorted((r.doc_id or -1, r.component_id) for r in near_duplicates(docs).collect())
    assert got == [(-1, None), (5, 5), (6, 5), (7, 5), (8, 8), (8, 8), (9, 8), (10, 10)]
    left = keep_one(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or -1) for r in left.collect()) == [-1, 5, 8, 8, 10]
    assert near_duplicates(docs.limit(0)).count() == 0
