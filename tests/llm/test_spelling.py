"""Spelling variants against plain Python, with keys that collide, and odd input."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tributary.llm import spelling

SCHEMA = "doc_id long, text string"


def plain(docs: list[tuple[int | None, str | None]]) -> set[tuple]:
    counts: Counter[str] = Counter()
    for d, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{d}:{run}".encode())
            if d is not None and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= 5 and len(w) >= 6}
    near: dict[str, set[str]] = defaultdict(set)
    places: dict[tuple[int, str], set[str]] = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            less = w[:i] + w[i + 1 :]
            places[i, less].add(w)
            if less in words:
                near[w].add(less)
                near[less].add(w)
    for group in places.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, others in near.items():
        if others and words[best := min(others, key=lambda x: (-words[x], x))] >= 5 * words[w]:
            form[w] = best

    def root(w: str) -> str:
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items()}


def corpus(seed: int) -> list[tuple[int, str]]:
    """Words and slips of them, counted so that forms follow upon forms and some are tied."""
    r = random.Random(seed)
    words: Counter[str] = Counter()
    for _ in range(25):
        w, n = "".join(r.choices("abcdeßéÀ", k=r.randrange(5, 12))), 700
        while n >= 4:
            words[w] += n
            for _ in range(3):
                i = r.randrange(len(w))
                words[w[:i] + r.choice(("", "q", "ab", "É")) + w[i + r.randrange(2) :]] += r.choice((5, 7, n // 6))
            n //= 6
            i = r.randrange(len(w))
            w = w[:i] + r.choice("xyz") + w[i + 1 :]
    runs = [w.title() if r.random() < 0.2 else w for w, n in words.items() for _ in range(n)]
    r.shuffle(runs)
    return [(d, " ".join(runs[k : k + 400])) for d, k in enumerate(range(0, len(runs), 400))]


@pytest.mark.parametrize("bits", [64, 9])
def test_against_plain_python(spark, bits):
    docs = corpus(7)
    want = plain(docs)
    got = spelling.spelling_variants(spark.createDataFrame(docs, SCHEMA).repartition(3), bits).collect()
    assert {tuple(r) for r in got} == want
    assert len(got) == len(want)
    chains = sum(1 for w, form, root, *_ in want if form and root != form)
    assert chains > 3


def test_odd_input(spark):
    long = "ab" * 30_000
    rows = [(1, None), (2, ""), (None, "nullid " * 5), (3, " ".join([long] * 5)), (4, " ".join([long + "a"] * 30)), (4, " ".join([long + "a"] * 30))]
    rows += [(5, "aaaaaa " * 40), (6, "aaaaaaa " * 5), (7, "short " * 50 + "ties12tiesaa tiesaa tiesaa tiesaa tiesaa tiesab tiesab tiesab tiesab tiesab tiesac")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, word int")
    got = spelling.spelling_variants(docs)
    assert {tuple(r) for r in got.collect()} == plain(rows)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert spelling.spelling_variants(docs.limit(0)).count() == 0


def test_deletion_keys():
    key, word, place, kind = spelling.deletion_keys(["banana", "anana", "bananas", "bonana", "bananá"])
    of = lambda w, p, k: {int(x) for x, a, b, c in zip(key, word, place, kind, strict=True) if (a, c) == (w, k) and p in (b, None)}
    assert of(0, 0, spelling.SHORTER) == of(1, None, spelling.ITSELF)
    assert of(2, 6, spelling.SHORTER) == of(0, None, spelling.ITSELF)
    assert of(0, 1, spelling.AT_PLACE) == of(3, 1, spelling.AT_PLACE)
    assert of(0, 5, spelling.AT_PLACE) == of(4, 5, spelling.AT_PLACE)
    assert not of(0, 0, spelling.AT_PLACE) & of(3, 0, spelling.AT_PLACE)
    assert len(spelling.deletion_keys([])[0]) == 0
    assert len(of(0, None, spelling.SHORTER)) == 6
    assert sum(1 for k in spelling.deletion_keys(["aaab"])[3] if k == spelling.SHORTER) == 2
