"""Removal of repeated passages against a plain dictionary of windows."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tributary.llm.substring_dedup import code, decode, remove_repeats

SF = "/root/testdata/sf0.001"


def plain(rows, width=20):
    first = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    where = lambda d, s: (d is None, d or 0, s)
    for d, w in split:
        for s in range(len(w) - width + 1):
            k = tuple(w[s : s + width])
            first[k] = min(first.get(k, (True, 1 << 62, 0)), where(d, s))
    out = []
    for d, w in split:
        gone = set()
        for s in range(len(w) - width + 1):
            if first[tuple(w[s : s + width])] < where(d, s):
                gone.update(range(s, s + width))
        out.append((d, b" ".join(x for i, x in enumerate(w) if i not in gone).decode(), len(w), len(gone)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.text, r.n_words, r.n_removed) for r in df.collect()), key=repr)


def test_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = plain([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(r[3] for r in want) > 100
    assert got(remove_repeats(docs)) == want
    # many buckets and slices, and cells so few that the sketch calls nearly everything repeated
    assert got(remove_repeats(docs, bucket_bytes=50_000, slice_windows=10_000, cell_bits=9)) == want


@pytest.mark.parametrize("seed", range(3))
def test_random_texts_of_few_words(spark, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choices("abc", k=rng.randint(0, 60)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(remove_repeats(docs, width=5, bucket_bytes=300, slice_windows=40, cell_bits=10)) == plain(rows, 5)


def test_nulls_repeats_and_long_texts(spark):
    p = " ".join(f"w{i}" for i in range(25))
    rows = [(9223372036854775807, p), (9223372036854775807, "z " + p), (9, p), (3, "x " + p), (3, "x " + p), (3, p), (None, p), (None, "é " + p), (4, None), (5, ""), (6, "a\x0bb\x1cc\xa0d"), (7, "same " * 3000), (8, "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 p", "2 run", "3 row", "4 start")
    for size in (1 << 20, 100):
        assert got(remove_repeats(docs, bucket_bytes=size)) == plain(rows)
    assert remove_repeats(docs.limit(0)).count() == 0


def test_codes():
    rng = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 5), (500, 600), (3000, 1 << 24), (40, 1 << 24), (100_000, 1 << 24)):
        x = np.unique(rng.integers(0, top, n))
        assert (decode(code(x)) == x).all()
