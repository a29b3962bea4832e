"""Packing against the tokenizer library on whole texts, and against the laws of packing."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tributary.llm.packing import best_fit, pack, pack_documents, token_ids
from tributary.llm.tokens import load

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"])) | st.text("aB'sSé ̈\x1c\x85\xa0İΣσ1२<|>.\n​"), max_size=4))
def test_words_one_by_one_are_the_whole_text(library, texts):
    got = [np.frombuffer(x, "<u4").tolist() for x in load().encode(texts)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_special_tokens_in_a_text(library):
    for t in ["a <|endoftext|> b", "x<|startoftext|>y", "<|endoftext", "it's  O'Neil's 12,5%"]:
        assert np.frombuffer(load().encode([t])[0], "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_small_cache_gives_the_same(library, monkeypatch):
    monkeypatch.setattr("tributary.llm.tokens.CACHE_WORDS", 5)
    texts = [" ".join(random.Random(i).choices("alpha Beta gam-ma delta, 77 x'll été".split(), k=9)) for i in range(40)]
    assert [np.frombuffer(x, "<u4").tolist() for x in load().encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def check(rows, texts, library, capacity=2048):
    ids = defaultdict(list)
    for r in rows:
        ids[r.doc_id].append(r)
    for doc, text in texts.items():
        want = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        mine = sorted(ids[doc], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(-(-len(want) // capacity)))
        for r in mine:
            part = np.array(want[r.start : r.start + r.length], "<u4")
            assert r.start == r.piece * capacity and r.length == len(part)
            assert r.ids_crc32 == zlib.crc32(part.tobytes())
        assert sum(r.length for r in mine) == len(want)
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for xs in places.values():
        at = 0
        for offset, length in sorted(xs):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places), sum(r.length for r in rows)


def test_all_documents(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = pack_documents(docs).collect()
    bins, total = check(rows, {r.doc_id: r.text for r in docs.collect()}, library)
    assert bins <= -(-total // 2048) + 1
    ids = {r.doc_id: r.ids for r in token_ids(docs.limit(5)).collect()}
    assert all(sum(r.length for r in rows if r.doc_id == d) == len(x) for d, x in ids.items())


def test_rounds_lose_nothing(spark):
    rng = random.Random(1)
    rows = [(i, 0, 0, rng.choice([1, 3, 700, 900, 1100, 2000, 2048]), i) for i in range(3000)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    out = pack(pieces, items=300).collect()
    assert sorted((r.doc_id, r.length) for r in out) == sorted((r[0], r[3]) for r in rows)
    places = defaultdict(list)
    for r in out:
        places[r.sequence_id].append((r.offset, r.length))
    for xs in places.values():
        assert [o for o, _ in sorted(xs)] == [sum(n for _, n in sorted(xs)[:k]) for k in range(len(xs))]
        assert sum(n for _, n in xs) <= 2048
    alone = len(set(best_fit(sorted((r[3] for r in rows), reverse=True), 2048)[0].tolist()))
    assert len(places) <= 1.02 * alone + 2


def test_best_fit_takes_the_tightest_bin():
    into, place = best_fit([6, 5, 4, 3, 2], 10)
    assert into.tolist() == [0, 1, 0, 1, 1] and place.tolist() == [0, 0, 6, 5, 8]


def test_nulls_empties_repeats_and_long_texts(spark, library):
    rows = [(1, None), (2, ""), (3, "Word, " * 5000), (None, "x y"), (4, "a"), (4, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 piece", "2 size", "3 members")
    out = pack_documents(docs).collect()
    assert sorted((r.doc_id, r.length) for r in out if r.doc_id in (1, 2, 4)) == [(1, 1), (2, 1), (4, 2), (4, 2)]
    assert sum(r.length for r in out if r.doc_id == 3) == 10_001
    assert [r.length for r in out if r.doc_id is None] == [3]
    assert pack_documents(docs.limit(0)).count() == 0


def test_files_of_other_rules_are_encoded_whole():
    """Any tokenizer's ids are those of its library, whatever its splitting rules."""
    from tributary.llm import tokens

    texts = ["Don't stop, it's 12 o'clock", "  naïve  café\nnew line", "x" * 50 + " 日本 text", ""]
    for name, by_words in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        mine, library = tokens.load(name), Tokenizer.from_file(tokens.tokenizer_path(name))
        assert mine.by_words == by_words
        for text, ids in zip(texts, mine.encode(texts), strict=True):
            assert np.frombuffer(ids, np.uint32).tolist() == library.encode(text, add_special_tokens=False).ids
