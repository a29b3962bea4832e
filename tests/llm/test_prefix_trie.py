"""The prefix trie against a tree of plain lists, and odd input."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tributary.llm import prefix_trie as p

SCHEMA = "conv_id long, turn long, role string, text string"
Row = tuple[int | None, int | None, str | None, str | None]


def plain(rows: list[Row]) -> set[tuple]:
    turns: dict[int, list] = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    seqs = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        first = c - (c % 100 if c >= 0 else -(-c % 100))
        seqs[c] = [t[3:] for t in [*sorted(turns.get(first, []))[:h], *sorted(mine)[h:]]]
    members = defaultdict(list)
    for c, s in sorted(seqs.items()):
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    kids = defaultdict(list)
    for s in members:
        if s:
            kids[s[:-1]].append(s)
    leaves, saved = {}, {}
    for s in sorted(members, key=len, reverse=True):
        leaves[s] = sum(leaves[k] for k in kids[s]) or 1
        saved[s] = (len(members[s]) - 1) * (len(s[-1][1]) if s else 0) + sum(saved[k] for k in kids[s])
    end = lambda s: hashlib.sha256(",".join(str(c) for c in members[s] if len(seqs[c]) == len(s)).encode()).hexdigest()
    return {(min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(kids[s]), leaves[s], saved[s], end(s)) for s, m in members.items()}


def made(seed: int, convs: int, longest: int) -> list[Row]:
    """Conversations that leave each other at every depth, so that chains hang on chains."""
    r = random.Random(seed)
    rows, seen = [], [[]]
    for c in r.sample(range(900), convs):
        s = list(r.choice(seen))[: r.randrange(longest + 1)]
        s += [(r.choice(("user", "assistant", None)), r.choice(("ok", "yes", None, "né", "x" * 9))) for _ in range(r.randrange(longest - len(s) + 1))]
        seen.append(s)
        rows += [(c, k, role, text) for k, (role, text) in enumerate(s)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "convs", "longest"), [(1, 150, 12), (2, 60, 40), (3, 5, 2)])
def test_against_plain_tree(spark, monkeypatch, seed, convs, longest):
    monkeypatch.setattr(p, "OPENINGS", 6)
    rows = made(seed, convs, longest)
    got = p.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(3))
    want = plain(rows)
    assert {tuple(r) for r in got.collect()} == want
    assert got.count() == len(want)


def test_long_lists_of_ends(spark, monkeypatch):
    rows = [(c, 0, "user", "same") for c in range(12_000)]
    assert {tuple(r) for r in p.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()} == plain(rows)


def test_odd_input(spark):
    """Turnless after rebuilding, no first of the hundred, null turns, equal numbers, repeated rows, negative ids, long texts."""
    rows: list[Row] = [(c, None, None, None) for c in range(700, 720)]
    rows += [(101, 5, "user", "a"), (101, 5, "user", "b"), (101, 5, "user", "b"), (101, None, "user", "first"), (None, 0, "user", "gone"), (-1, 0, "user", "x" * 200_000), (-100, 1, None, "y"), (-101, 1, "", "y")]
    rows += [(300, k, "user", "z") for k in range(400)] + [(301, k, "user", "z") for k in range(399)]
    docs = spark.createDataFrame([(*r, 3) for r in rows], SCHEMA + ", depth int")
    got = p.prefix_trie(docs)
    assert {tuple(r) for r in got.collect()} == plain(rows)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert p.prefix_trie(docs.limit(0)).count() == 0


def test_totals_by_doubling(spark):
    """A chain of chains far deeper than the rounds that are needed."""
    chains = spark.createDataFrame([(k, k - 1 if k else None, 1, k) for k in range(200)], "conv long, parent long, leaves long, saved long")
    got = {r.conv: (r.leaves, r.saved) for r in p.totals(chains).collect()}
    assert got == {k: (200 - k, sum(range(k, 200))) for k in range(200)}
