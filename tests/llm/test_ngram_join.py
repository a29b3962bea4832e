"""The n-gram join against plain sets, its signatures against all similar pairs, and odd input."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tributary.llm import ngram_join as j
from tributary.llm.components import connected_components

SCHEMA = "doc_id long, text string"


def plain_set(text: str | None, width: int) -> set[tuple[str, ...]]:
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def plain(docs: list[tuple[int, str | None]], width: int, percent: int) -> dict[int, tuple[int, int]]:
    sets = {d: plain_set(t, width) for d, t in docs}
    comp = {d: d for d in sets}

    def top(d: int) -> int:
        while comp[d] != d:
            d = comp[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                comp[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), top(d)) for d in ids}


def variants(seed: int, n: int) -> list[tuple[int, str | None]]:
    """Texts that share much: bases of many sizes, edits of them, edits of edits, copies, and texts of one common passage."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(3000)}"
    texts = [" ".join(word() for _ in range(r.choice((1, 2, 3, 8, 12, 20, 33, 60, 200)))) for _ in range(12)]
    passage = [word() for _ in range(30)]
    while len(texts) < n:
        words = r.choice(texts).split()
        for _ in range(r.randrange(3)):
            words[r.randrange(len(words))] = word()
        if r.random() < 0.2:
            words = passage + [word() for _ in range(r.randrange(12))]
        texts.append(" ".join(words).title() if r.random() < 0.1 else " ".join(words))
    r.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("width", "percent", "cells"), [(3, 90, False), (5, 80, True)])
def test_classes_against_plain_sets(spark, monkeypatch, width, percent, cells):
    if cells:
        monkeypatch.setattr(j, "PAIR_GROUP", 2)
        monkeypatch.setattr(j, "CELL_CLASSES", 7)
    docs = variants(1, 260)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in j.similar_documents(spark.createDataFrame(docs, SCHEMA).repartition(5), width, percent).collect()}
    want = plain(docs, width, percent)
    assert got == want
    assert 20 < sum(c != d for d, (_, c) in want.items()) < 255


def test_open_signatures_are_searched_completely(spark, monkeypatch):
    """A pivot that links to nothing hides links of others: stars don't see them, the search of open groups does."""
    base = [f"b{i}" for i in range(60)]
    change = lambda at, by: " ".join([*base[:at], by, *base[at + 1 :]])
    docs = [(i, change(5 * (i % 10) + 3, f"x{i}")) for i in range(40)] + [(99, " ".join(base))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in j.similar_documents(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert got == plain(docs, 3, 90)
    _, links, classes = j.similarity_links(spark.createDataFrame(docs, SCHEMA), 3, 90)
    assert links.count() > 0
    everything = classes.known.selectExpr("1L sig", "key", "key component", "41L classes")
    want = sorted(c for _, c in plain(docs, 3, 90).values())
    for pair_group, cell in ((50, 1000), (1, 6)):
        monkeypatch.setattr(j, "PAIR_GROUP", pair_group)
        monkeypatch.setattr(j, "CELL_CLASSES", cell)
        found = {r.node: r.component for r in connected_components(j.all_links(everything, classes)).collect()}
        least = {}
        for r in classes.known.collect():
            c = found.get(r.key, r.key)
            least[c] = min(r.first, least.get(c, r.first))
        assert sorted(least[found.get(r.key, r.key)] for r in classes.known.collect()) == want


@pytest.mark.parametrize("percent", [80, 90])
def test_similar_sets_share_a_signature(percent):
    r = np.random.default_rng(percent)
    for n in [*range(4, 60), 100, 333, 1000, 4000]:
        for _ in range(6):
            base = r.integers(1, 1 << 63, n, dtype=np.uint64)
            least = -(-n * percent // 100)
            kept = int(r.integers(least, n + 1))
            room = kept * 100 // percent - n  # how many others may be there
            other = np.r_[base[:kept], r.integers(1, 1 << 63, int(r.integers(0, room + 1)), dtype=np.uint64)]
            sets = [np.unique(base), np.unique(other)]
            shared = j.common(*sets)
            assert j.similar(len(sets[0]), len(sets[1]), shared, percent)
            sig, row = j.signatures(np.array([len(s) for s in sets]), sets, percent)
            assert np.array_equal(*sets) or set(sig[row == 0]) & set(sig[row == 1]), (n, kept, len(other))


def test_bands_meet():
    for percent in (80, 90):
        starts, _ = j.size_bands(percent, 5000)
        for n in range(1, 5000):
            for m in (n, n * 100 // percent):
                assert np.searchsorted(starts, m, "right") - np.searchsorted(starts, n, "right") <= 1


def test_parity_sketches_never_say_too_much():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 400, n).astype(np.uint64)) for n in (1, 5, 60, 61, 200, 300)]
    sets += [s[:-1] for s in sets if len(s) > 40]
    for a in sets:
        for b in sets:
            x, y = (np.frombuffer(j.parity_sketch(s), np.uint64) for s in (a, b))
            words = min(len(x), len(y))
            assert np.bitwise_count(j.folded(x, words) ^ j.folded(y, words)).sum() <= len(np.setxor1d(a, b))
            assert j.may_link(len(a), len(b), x, y, 90) or not j.similar(len(a), len(b), j.common(a, b), 90)
    assert not j.may_link(300, 300, *(np.frombuffer(j.parity_sketch(r.integers(1, 1 << 62, 300).astype(np.uint64)), np.uint64) for _ in "ab"), 90)


def test_odd_input(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, None, "a"), (2, "", "b"), (3, " \t\n", "c"), (4, "One two", "d"), (5, "one TWO", "e"), (None, "one two", "f"), (6, long, "g"), (7, long + " more", "h"), (7, "other words here", "i"), (7, "other words here", "i"), (8, "one", "j")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted(j.similar_documents(docs).collect(), key=repr)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (None, 1, None), (6, 59_998, 6), (7, 59_999, 6), (7, 1, 7), (8, 1, 8)}
    assert len(got) == len(rows)
    kept = j.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.component_id for r in kept.collect()) == ["a", "b", "c", "d", "f", "g", "i", "i", "j"]
    assert j.similar_documents(docs.limit(0)).count() == 0


def test_shingles_of_equal_hash_count_twice(monkeypatch):
    import xxhash

    monkeypatch.setattr(xxhash, "xxh3_128_digest", lambda x, seed=0: b"\0" * 8 + len(x).to_bytes(8, "little"))
    n, hashes = j.shingle_set(b"a bb ccc dddd eeeee")
    assert (n, len(hashes)) == (3, 1)


def test_rows_left_out_link_nothing(spark):
    """A row that is out joins no others, also where its class is met first, and its equals keep their sketch."""
    base = [f"b{i}" for i in range(90)]
    change = lambda *at: " ".join("x" if i in at else w for i, w in enumerate(base))
    docs = [(1, change(0, 1)), (2, change()), (3, change()), (4, change(88, 89)), (5, change(0, 1, 88, 89)), (6, "other words " * 9), (7, None)]
    frame = spark.createDataFrame(docs, SCHEMA).coalesce(1)
    for gone in ((), (2,), (2, 3), (1, 5), (4, 2, 3)):
        without = frame.filter(frame.doc_id.isin(list(gone))).selectExpr("doc_id id", "xxhash64(coalesce(text, '')) h")
        got = {r.id for r in j.rejected(frame, 5, 95, without).collect()}
        left = [(d, t) for d, t in docs if d not in gone]
        assert got == {d for d, (_, c) in plain(left, 5, 95).items() if c != d}, gone
        assert {r.doc_id for r in j.left_out(frame, without).collect()} == {d for d, _ in left}


def test_few_empty_projections_are_signatures():
    """With two parts some projections are empty, and all of a band would share these: only sets of very many empty ones sign them."""
    r = np.random.default_rng(5)
    sets = [np.unique(r.integers(1, 1 << 63, 300, dtype=np.uint64)) for _ in range(200)]
    sig, row = j.signatures(np.array([len(s) for s in sets]), sets, 80)
    _, times = np.unique(sig, return_counts=True)
    assert times[times > 1].sum() < len(sig) / 1000 and len(set(row.tolist())) == 200
