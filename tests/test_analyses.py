"""The analyses against plain Python, over generated records that reach every class and tell the rules apart."""

from __future__ import annotations

import difflib
import functools
import random
import re
import unicodedata
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.functions import text as t
from tributary.operators import blocking, classify, matcher, rules
from tributary.operators.features import FEATURES, joined
from tributary.plans import reports
from tributary.plans.fixtures import Linkage
from tributary.sources import tsv

#: Address words that so many targets have: one for each limit of the rules C, D, E and F, and one beyond.
CROWDS = {"quarry": 60, "meadow": 300, "hillside": 700, "harbour": 1500, "bazaar": 5200}


def made() -> tuple[list[tuple], list[tuple], set[tuple[str, str]]]:
    r = random.Random(11)
    names = ["acmetool", "acmetools", "acmetools.com", "Acme-Tools", "zephyr", "zéphyr", "Акме", "***", "abc xy", "abc qq", "northgate foodstore", "foodstore northgates", "blue river", "bluerivers", "the co", "river blue inc", "kiosk.net", "kioskly", "brightwaterx", "brightwaters.org", "हिन्दी नाम", "millstonery", "millstoned co", "quickprint shop", "quikprint shops"]
    word = ["oakley", "linden", "granite", "falcon", "juniper", "cobalt", "marble", "walnut"]
    mark = ["street", "road", "mall", "tower", "town", "county", "station", "", "", "municipality", "township"]
    place = [", rivertown, tx", ", rivertown, ca", ", hilltown, tx", ", new city, nv", "", ", Лес, tx"]

    def record(source: str, k: int) -> tuple:
        address = f"{r.choice(('', '7 ', '42 ', '9001 '))}{r.choice(word)} {r.choice(mark)}{r.choice((' ' + r.choice(word), '', ''))}{r.choice(place)}"
        return (f"{source}-{k}", r.choice(names), address, r.choice(("US", "us ", "IN")))

    s1 = [record("S1", k) for k in range(60)]
    targets = [record(r.choice(("S2", "S3")), k) for k in range(150)]
    targets += [(f"S2-{900 + k}", n, a, c) for k, (n, a, c) in enumerate((("wholly other", "5 nowhere", "US"), ("acmetools", "x", "FR"), ("brightwater", "9 elm", "US"), ("Акме Тулс", "Лес 7", "US"), ("spruce goods", "granite linden walnut rows", "US")))]
    s1 += [("S1-850", "fir trading", "granite linden walnut row", "US")]
    s1 += [(f"S1-{900 + k}", f"lonely{k} seller", f"{word_} alone{k}", "XX") for k, word_ in enumerate(CROWDS)]
    targets += [(f"S3-{word_}{i}", f"{word_}shop number{i}" if i % 50 else f"lonely{k}s sellers", f"{word_} place{i}", "XX") for k, (word_, n) in enumerate(CROWDS.items()) for i in range(n)]
    ids = [x[0] for x in targets[:155]]
    truth = {(r.choice(s1[:60])[0], r.choice(ids)) for _ in range(160)} | {(f"S1-{900 + k}", f"S3-{w}{i}") for k, w in enumerate(CROWDS) for i in (0, 3, 50)}
    return s1, targets, truth


def tokens(text: str, common: tuple[str, ...], least: int, numbers: bool = False) -> tuple[list[str], str]:
    low = unicodedata.normalize("NFKC", text.strip(" ").lower()).replace("&", " and ")
    words = "".join(c if unicodedata.category(c)[0] in "LNM" else " " for c in low).split(" ")
    return [w for w in words if w and w not in common and (len(w) >= least or (numbers and w.isdigit()))], " ".join(w for w in words if w)


def light(v: str) -> str:
    return re.sub(r"\s+", " ", v.lower()).strip(" ")


@functools.lru_cache(None)
def ratio(a: str, b: str) -> float:
    return 1.0 if a == b else difflib.SequenceMatcher(None, a, b).ratio()


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def folded(v: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", tokens(v, (), 1)[1]) if not unicodedata.combining(c))


def scripts(v: str) -> set[str]:
    return {next((s for s in t.SCRIPTS if s in unicodedata.name(c, "")), "") for c in v if unicodedata.category(c)[0] in "LM"} - {""}


def apart(a: str, b: str) -> bool:
    return bool(scripts(a) and scripts(b) and not scripts(a) & scripts(b))


def first(*rules_: tuple[bool, str]) -> str:
    return next(name for holds, name in rules_ if holds)


class Pair:
    """A pair of records with all that the analyses ask of it, each from its definition."""

    def __init__(self, a: tuple, b: tuple):
        self.a, self.b = a, b
        self.n, self.m = (tokens(x[1], t.COMMON_NAME_TOKENS, 4) for x in (a, b))
        self.p, self.q = (tokens(x[2], t.COMMON_ADDRESS_TOKENS, 4, True) for x in (a, b))
        self.names = set(self.n[0]) & set(self.m[0])
        self.places = set(self.p[0]) & set(self.q[0])
        self.numbers = {w for w in self.places if w.isdigit()}
        self.country = a[3].strip().lower() == b[3].strip().lower()

    @property
    def candidate(self) -> bool:
        repeated = sum(w in set(self.p[0]) for w in self.q[0])
        return self.country and (bool(self.n[1]) and self.n[1] == self.m[1] or bool(self.names) or (len(set(self.p[0])) > 1 and repeated > 1))

    def likely_typo(self, x: str, y: str, similarity: float) -> bool:
        u, v = tokens(x, (), 1)[1], tokens(y, (), 1)[1]
        near = distance(u, v) <= max(2, round(0.12 * max(len(u), len(v)))) and similarity >= 0.85
        return bool(u and v) and u != v and (folded(x) == folded(y) or near)

    def missed(self) -> dict:
        short = [{w for w in tokens(x[1], t.COMMON_NAME_TOKENS, 3)[0] if len(w) == 3} for x in (self.a, self.b)]
        name, address = ratio(self.n[1], self.m[1]), ratio(self.p[1], self.q[1])
        out = {
            "name_similarity": name,
            "address_similarity": address,
            "shared_name_tokens": len(self.names),
            "shared_three_letter": len(short[0] & short[1]),
            "exact_normalized_name": self.n[1] == self.m[1],
            "name_token_overlap": len(self.names) / min(len(set(self.n[0])), len(set(self.m[0]))) if self.n[0] and self.m[0] else 0.0,
            "shared_address_count": len(self.places),
            "shared_numeric_count": len(self.numbers),
            "current_address_rule": len(self.places) >= 2,
            "fuzzy_name_potential": not self.names and name >= 0.82,
            "fuzzy_address_potential": len(self.places) < 2 and address >= 0.80,
            "cross_script": apart(self.a[1], self.b[1]) or apart(self.a[2], self.b[2]),
            "typo_or_accent": self.likely_typo(self.a[1], self.b[1], name) or self.likely_typo(self.a[2], self.b[2], address),
        }
        some_name = out["exact_normalized_name"] or out["shared_name_tokens"] or out["shared_three_letter"]
        out["pattern"] = first(
            (out["cross_script"], "CROSS_SCRIPT"), (out["typo_or_accent"], "TYPO_OR_ACCENT"), (out["fuzzy_name_potential"], "FUZZY_NAME_POTENTIAL"),
            (out["fuzzy_address_potential"], "FUZZY_ADDRESS_POTENTIAL"), (bool(some_name), "NAME_MATCH"), (bool(self.places), "ADDRESS_MATCH"), (True, "NO_STRONG_SIGNAL"),
        )
        return out

    @property
    def both(self) -> str:
        return f"{self.a[2]} {self.b[2]}".lower()

    def marked(self, token: str) -> bool:
        either = "|".join(map(re.escape, t.STREET_MARKERS))
        word = rf"\b{re.escape(token)}\b"
        return bool(re.search(rf"\b(?:{either})\b[^,;]*{word}", self.both) or re.search(rf"{word}[^,;]*\b(?:{either})\b", self.both))

    def token_class(self, token: str) -> str:
        words = set(tokens(self.both, t.COMMON_ADDRESS_TOKENS, 4, True)[0]) | set(light(self.both).split())
        return first(
            (token.isdigit(), "numeric/address component"), (token in t.COMMON_ADDRESS_TOKENS or len(token) <= 3, "generic/noisy token"), (self.marked(token), "street/road"),
            (bool(words & set(t.LANDMARK_MARKERS)), "landmark/building"), (bool(words & set(t.CITY_MARKERS["recoveries"])), "city/town"), (True, "distinctive business/location term"),
        )

    def collision(self, token: str) -> str:
        words = set(light(self.both).split())
        return first(
            (token.isdigit(), "common numeric address component"), (token in t.COMMON_ADDRESS_TOKENS, "generic address word"), (self.marked(token), "same street but unrelated business"),
            (bool(words & set(t.LANDMARK_MARKERS)), "same building/landmark but different business"), (bool(words & set(t.CITY_MARKERS["impact"])), "same city/town but unrelated business"),
            (True, "other shared-location collision"),
        )

    def named(self) -> SimpleNamespace:
        x, y = light(self.a[1]), light(self.b[1])
        return SimpleNamespace(exact=x == y, similarity=ratio(x, y), contains=bool(x and y) and (x in y or y in x), shared=len(self.names))

    def name_pattern(self) -> str:
        x, name = self.named(), self.b[1].lower()
        domain = name.endswith((".com", ".net", ".org")) or ".com" in name
        other = apart(f"{self.a[1]} {self.a[2]}", f"{self.b[1]} {self.b[2]}")
        return first(
            (other, "cross-script + 1 address token"), (x.exact, "exact/near-exact name + 1 address token"),
            (domain and (x.similarity >= 0.65 or x.contains or x.shared > 0), "domain/DBA name + 1 address token"), (x.shared > 0 and x.similarity >= 0.70, "shared name token + 1 address token"),
            (x.similarity >= 0.82, "strong name similarity + 1 address token"), (x.similarity >= 0.60 or x.contains, "moderate name signal + 1 address token"),
            (x.shared > 0, "shared name token + 1 address token"), (True, "weak/no name signal"),
        )

    def combined(self) -> str:
        x = self.named()
        return first((x.shared > 0, "shared name token + address token"), (x.contains, "name containment + address token"), (x.similarity >= 0.60, "name similarity + address token"), (True, "address token only"))

    def parts(self) -> tuple[bool, bool]:
        x, y = ([p for p in map(light, v[2].split(",")) if p] for v in (self.a, self.b))
        good = len(x) > 1 and len(y) > 1
        return good and x[-2] == y[-2], good and x[-1] == y[-1]

    def reason(self, token: str) -> str:
        city, state = self.parts()
        return first(
            (token.isdigit(), "numeric address collision"), (city, "same direct city component"), (state, "same direct state/region component"),
            (ratio(light(self.a[2]), light(self.b[2])) >= 0.80, "high address similarity"), (True, "single textual address-token collision"),
        )


@pytest.fixture(scope="module")
def plain():
    s1, targets, truth = made()
    frequency = Counter(w for x in targets for w in set(tokens(x[2], t.COMMON_ADDRESS_TOKENS, 4, True)[0]))
    by_country = defaultdict(list)
    for y in targets:
        by_country[y[3].strip().lower()].append(y)
    near = {(x[0], y[0]): Pair(x, y) for x in s1 for y in by_country[x[3].strip().lower()]}
    current = {k for k, p in near.items() if p.candidate}
    single = {k: (w := next(iter(p.places)), frequency[w]) for k, p in near.items() if len(p.places) == 1}
    extra = {k: v for k, v in single.items() if k not in current}
    records = {x[0]: x for x in (*s1, *targets)}
    every = near | {k: Pair(records[k[0]], records[k[1]]) for k in truth if k not in near}
    return SimpleNamespace(s1=s1, targets=targets, truth=truth, pairs=every, current=current, extra=extra, added={k: v for k, v in extra.items() if v[1] <= 5000})


@pytest.fixture(scope="module")
def linkage(spark, plain):
    a, b = (blocking.prepare(spark.createDataFrame(x, tsv.RECORD)) for x in (plain.s1, plain.targets))
    return Linkage(a.cache(), b.cache(), spark.createDataFrame(sorted(plain.truth), "s1_id string, candidate_id string"))


def keyed(df) -> dict:
    rows = df.collect()
    out = {(r.s1_id, r.candidate_id): r for r in rows}
    assert len(out) == len(rows)
    return out


def test_candidates_and_additions(plain, linkage):
    assert set(keyed(linkage.candidates)) == plain.current
    got = {k: (r.token, r.frequency, r.is_true, r.source) for k, r in keyed(reports.rule_f(linkage)).items()}
    assert got == {k: (w, n, k in plain.truth, k[1][:2]) for k, (w, n) in plain.added.items()}
    assert len(plain.extra) - len(got) == CROWDS["bazaar"]  # what the limit of 5,000 leaves out


def test_every_class_is_reached(spark, plain, linkage):
    """All classifications of all pairs of the small part, each by its definition."""
    some = {k: (p, min(p.places, default="granite")) for k, p in plain.pairs.items() if not k[0].startswith("S1-9")}
    rows = [(*k, w) for k, (_, w) in some.items()] + [("S1-900", "S3-quarry1", "quarry")]
    x = rules.addressed(rules.measured(spark.createDataFrame(rows, "s1_id string, candidate_id string, token string").withColumn("frequency", F.lit(1)), linkage.s1, linkage.targets)).withColumn("reason", classify.collision_reason())
    reasons = {(r.s1_id, r.candidate_id): r.reason for r in x.select("s1_id", "candidate_id", "reason").collect()}
    y = classify.with_name_signals(joined(spark.createDataFrame(rows, "s1_id string, candidate_id string, token string"), linkage.s1, linkage.targets, classify.RAW))
    word = F.col("token")
    found = keyed(y.select("s1_id", "candidate_id", classify.token_class(word).alias("c2"), classify.token_class(F.lit("road")).alias("c2g"), classify.collision_pattern(word).alias("c3"), classify.collision_pattern(F.lit("road")).alias("c3g"), classify.name_pattern().alias("c4"), classify.combined_signal().alias("c6")))
    missed = keyed(classify.missed_pair_signals(y).select("s1_id", "candidate_id", "pattern"))
    reached = defaultdict(set)
    for k, (p, w) in some.items():
        want = {"c1": p.missed()["pattern"], "c2": p.token_class(w), "c2g": p.token_class("road"), "c3": p.collision(w), "c3g": p.collision("road"), "c4": p.name_pattern(), "c5": p.reason(w), "c6": p.combined()}
        r = found[k]
        assert {"c1": missed[k].pattern, "c2": r.c2, "c2g": r.c2g, "c3": r.c3, "c3g": r.c3g, "c4": r.c4, "c5": reasons[k], "c6": r.c6} == want, (k, p.a, p.b, w)
        for c, v in want.items():
            reached[c[:2]].add(v)
    assert {c: len(v) for c, v in reached.items()} == {"c1": 7, "c2": 6, "c3": 6, "c4": 7, "c5": 5, "c6": 4}


def test_missed_patterns(plain, linkage):
    got = {k: r.asDict() for k, r in keyed(reports.missed_patterns(linkage)).items()}
    want = {k: plain.pairs[k].missed() for k in plain.truth - plain.current}
    assert {k: {n: pytest.approx(v) if isinstance(v, float) else v for n, v in x.items()} for k, x in want.items()} == {k: {n: x[n] for n in want[k]} for k, x in got.items()}
    counts = reports.missed_pattern_counts(reports.missed_patterns(linkage)).first().asDict()
    assert counts == {n: sum(bool(x[n]) for x in want.values()) for n in counts}
    assert len({x["pattern"] for x in want.values()}) >= 5


def test_rules_are_told_apart(plain, linkage):
    got = {r.rule: r for r in rules.rule_sizes(linkage.s1, linkage.targets, linkage.truth, linkage.frequency).collect()}
    base = Counter(i for i, _ in plain.current)
    for rule, limit in {"A": 0, "C": 100, "D": 500, "E": 1000, "F": 5000, "B": 10**9}.items():
        added = {k for k, (_, n) in plain.extra.items() if n <= limit}
        extra = Counter(i for i, _ in added)
        sizes = [base[x[0]] + extra[x[0]] for x in plain.s1]
        hit = len(plain.truth & (plain.current | added))
        r = got[rule]
        assert (r.recovered, r.missed, r.affected, r.candidates, r.min_size, r.max_size) == (hit, len(plain.truth) - hit, len(extra), sum(sizes), min(sizes), max(sizes))
        assert (r.median_size, r.p90_size, r.p95_size) == tuple(pytest.approx(np.percentile(sizes, q)) for q in (50, 90, 95))
    order = [got[k].candidates for k in "ACDEFB"]
    assert order == sorted(set(order)) and [got[k].recovered for k in "ACDEFB"] == sorted({got[k].recovered for k in "ACDEFB"})


def test_recoveries_and_collisions(plain, linkage):
    true = {k: v for k, v in plain.added.items() if k in plain.truth}
    recovered = keyed(reports.rule_f_recoveries(linkage))
    assert {k: (r.token, r.frequency, r.token_class) for k, r in recovered.items()} == {k: (w, n, plain.pairs[k].token_class(w)) for k, (w, n) in true.items()}
    counts = Counter(w for w, _ in true.values())
    top = reports.top_tokens(reports.rule_f_recoveries(linkage), 5).collect()
    assert [(r.token, r.n) for r in top] == sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:5]
    false = {k: v for k, v in plain.added.items() if k not in plain.truth}
    got = keyed(reports.collisions(linkage))
    assert {k: (r.token, r.frequency, r.source, r.pattern) for k, r in got.items()} == {k: (w, n, k[1][:2], plain.pairs[k].collision(w)) for k, (w, n) in false.items()}
    order = sorted(false, key=lambda k: (plain.pairs[k].collision(false[k][0]), false[k][1], k))
    assert [(r.s1_id, r.candidate_id) for r in reports.collision_examples(reports.collisions(linkage)).collect()] == order[:30]


def test_true_pairs(plain, linkage):
    true = {k: v for k, v in plain.added.items() if k in plain.truth}
    patterns = reports.true_pair_patterns(linkage)
    got = keyed(patterns)
    assert {k: (r.token, r.pattern, r.combined, r.shared_numeric_tokens) for k, r in got.items()} == {k: (w, p.name_pattern(), p.combined(), len(p.numbers)) for k, (w, _) in true.items() for p in [plain.pairs[k]]}
    signals = {r.signal: (r.n, r.share) for r in reports.true_pair_signals(patterns).collect()}
    rows = [(plain.pairs[k], plain.pairs[k].named(), w) for k, (w, _) in true.items()]
    want = {
        "exact normalized name": [x.exact for _, x, _ in rows],
        "shared useful name token": [x.shared > 0 for _, x, _ in rows],
        "name containment": [x.contains for _, x, _ in rows],
        "character similarity >= 0.82": [x.similarity >= 0.82 for _, x, _ in rows],
        "character similarity >= 0.60": [x.similarity >= 0.60 for _, x, _ in rows],
        "shared numeric address token": [bool(p.numbers) for p, _, _ in rows],
        "Rule F token is textual": [not w.isdigit() for _, _, w in rows],
        "same country": [True for _ in rows],
        "different detected scripts": [apart(f"{p.a[1]} {p.a[2]}", f"{p.b[1]} {p.b[2]}") for p, _, _ in rows],
        "address token only": [x.similarity < 0.60 and not x.shared and not x.contains for _, x, _ in rows],
    }
    assert signals == {k: (sum(v), pytest.approx(sum(v) / len(rows))) for k, v in want.items()}


def test_selective_rules(plain, linkage):
    got = {r.condition: r for r in reports.selective(linkage).collect()}
    all_true = sum(k in plain.truth for k in plain.added)
    met = {n: {} for n in rules.selective_rules()}
    for k, (w, n) in plain.added.items():
        x = plain.pairs[k].named()
        holds = (x.similarity >= 0.60, x.similarity >= 0.70, x.similarity >= 0.80, x.contains, x.similarity >= 0.60 or x.contains, not w.isdigit() and x.similarity >= 0.60)
        for name, yes in zip(met, holds, strict=True):
            if yes:
                met[name][k] = n
    assert set(got) == {n for n, x in met.items() if x} and len(got) == 6
    for name, keys in met.items():
        r, true = got[name], sum(k in plain.truth for k in keys)
        sizes = list(Counter(i for i, _ in keys).values())
        assert (r.added, r.true, r.false, r.affected, r.max) == (len(keys), true, len(keys) - true, len(sizes), max(sizes))
        assert (r.precision, r.recall, r.median, r.p90) == tuple(map(pytest.approx, (true / len(keys), true / all_true, np.percentile(sizes, 50), np.percentile(sizes, 90))))
        for source in ("S2", "S3"):
            mine = [k for k in keys if k[1].startswith(source)]
            assert (r[f"added_{source.lower()}"], r[f"true_{source.lower()}"]) == (len(mine), sum(k in plain.truth for k in mine))
    assert 0 < got["RULE 3: similarity >= 0.80"].added < got["RULE 2: similarity >= 0.70"].added < got["RULE 1: similarity >= 0.60"].added
    assert 0 < got["RULE 3: similarity >= 0.80"].true


def test_rule_3(plain, linkage):
    want = {k: v for k, v in plain.added.items() if plain.pairs[k].named().similarity >= 0.80}
    rows = reports.rule3(linkage).cache()
    got = keyed(rows)
    assert {k: (r.token, r.reason, r.is_true) for k, r in got.items()} == {k: (w, plain.pairs[k].reason(w), k in plain.truth) for k, (w, _) in want.items()}
    facts = {}
    for k, (w, n) in want.items():
        p = plain.pairs[k]
        x, address, (city, state) = p.named(), ratio(light(p.a[2]), light(p.b[2])), p.parts()
        facts[k] = SimpleNamespace(true=k in plain.truth, name=x.similarity, address=address, textual=not w.isdigit(), exact=x.exact, contains=x.contains, shared=x.shared, numbers=len(p.numbers), places=len(p.places), city=city, state=state, frequency=n,
                                   overlap=x.shared / min(len(set(p.n[0])), len(set(p.m[0]))) if p.n[0] and p.m[0] else 0.0, length=abs(len(light(p.a[1])) - len(light(p.b[1]))))
    conditions = [
        lambda f: f.name >= 0.85, lambda f: f.name >= 0.90, lambda f: f.shared > 0, lambda f: f.contains, lambda f: f.textual, lambda f: not f.textual, lambda f: f.numbers >= 2,
        lambda f: f.address >= 0.60, lambda f: f.address >= 0.70, lambda f: f.address >= 0.80, lambda f: f.name >= 0.80,
        lambda f: f.name >= 0.80 and f.textual, lambda f: f.name >= 0.85 and f.textual, lambda f: f.name >= 0.90 and f.textual,
    ]
    report = {r.condition: r for r in rules.condition_report(rows).collect()}
    true, false = (sum(f.true == v for f in facts.values()) for v in (True, False))
    assert true and false and len(report) == 14
    for name, holds in zip(rules.rule3_conditions(), conditions, strict=True):
        a, b = sum(f.true for f in facts.values() if holds(f)), sum(not f.true for f in facts.values() if holds(f))
        r = report[name]
        assert (r.retained, r.true, r.false, r.false_reduced) == (a + b, a, b, false - b), name
        assert (r.precision, r.true_recall) == (pytest.approx(a / (a + b) if a + b else 0), pytest.approx(a / true)), name
    flags = {"exact normalized name": "exact", "name containment": "contains", "shared useful name token": "shared", "textual Rule-3 token": "textual", "same city": "city", "same state/region": "state"}
    counted = {r.condition: (r.true, r.false) for r in rules.boolean_features(rows).collect()}
    for name, field in flags.items():
        assert counted[name] == tuple(sum(bool(getattr(f, field)) for f in facts.values() if f.true == v) for v in (True, False)), name
    assert counted["same country"] == (true, false)
    fields = {"name_similarity": "name", "name_token_overlap": "overlap", "name_length_difference": "length", "shared_numeric_tokens": "numbers", "shared_address_tokens": "places", "frequency": "frequency", "address_similarity": "address"}
    numbers = {(r.feature, r.is_true): r for r in rules.numeric_features(rows).collect()}
    assert len(numbers) == 14
    for feature, field in fields.items():
        for v in (True, False):
            values = [getattr(f, field) for f in facts.values() if f.true == v]
            r = numbers[feature, v]
            assert (r.n, r.min, r.median, r.p90, r.max) == (len(values), *(pytest.approx(x) for x in (min(values), np.percentile(values, 50), np.percentile(values, 90), max(values))))


def test_scores_and_matches(spark, plain, linkage):
    """Scores are the model's formula over the features; matches are those at the threshold of the best macro F0.5."""
    features = reports.candidate_features(linkage)
    model = reports.trained(linkage, features)
    scored = keyed(matcher.score(features, model))
    assert set(scored) == plain.current
    rows = keyed(features)
    weights = np.array(model.stages[-1].coefficients.toArray())
    keys = sorted(rows)
    x = np.array([[rows[k][f] for f in FEATURES] for k in keys])
    deviation = np.where(x.std(0) == 0, 1, x.std(0))
    expected = 1 / (1 + np.exp(-((x - x.mean(0)) / deviation @ weights + model.stages[-1].intercept)))
    assert np.allclose(expected, [scored[k].score for k in keys], atol=1e-6) and expected.std() > 0.01
    scores = spark.createDataFrame([(*k, r.score) for k, r in scored.items()], "s1_id string, candidate_id string, score double")
    best, chosen = (-1.0, 0.0), None
    for threshold in (0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9):
        kept = {k for k, r in scored.items() if r.score >= threshold}
        total = 0.0
        for s in plain.s1:
            p, a = {k for k in kept if k[0] == s[0]}, {k for k in plain.truth if k[0] == s[0]}
            precision = len(p & a) / len(p) if p else float(not a)
            recall = len(p & a) / len(a) if a else float(not p)
            total += 1.25 * precision * recall / (0.25 * precision + recall) if precision + recall else 0.0
        if total / len(plain.s1) > best[0] + 1e-12:
            best, chosen = (total / len(plain.s1), threshold), kept
    got = {r.s1_entity_id: r.matched_entity_ids for r in reports.matched(linkage, scores).collect()}
    assert got == {s[0]: ",".join(sorted(c for i, c in chosen if i == s[0])) for s in plain.s1}



def test_bounds_decide_as_the_similarity_does(spark):
    """With a bound, the same pairs are at or above every threshold from it on, and few go to Python."""
    from tributary.functions import similarity as s

    r = random.Random(3)
    texts = ["", "a", "aab", "acme tools", "acme tool", "𝒳yz", "ééa"] + ["".join(r.choices("abcdefgh  ", k=r.randrange(1, 25))) for _ in range(60)]
    df = spark.createDataFrame([(x, y) for x in texts for y in texts], "a string, b string")
    a, b = F.col("a"), F.col("b")
    for least in (0.60, 0.80):
        rows = df.select("a", "b", s.character_similarity(a, b, least).alias("got"), s.similarity_bound(a, b).alias("bound")).collect()
        for x in rows:
            want = ratio(x.a, x.b)
            assert want <= x.bound + 1e-12
            assert x.got == pytest.approx(want) if want >= least else want <= x.got < least or x.got == pytest.approx(want)
        assert sum(x.bound >= least for x in rows) < 0.6 * len(rows)
