"""Queries whose SQL names no limit have none; equal names in many copies."""

from __future__ import annotations

import pytest
from compare import same_rows

from tributary.operators import blocking, matcher

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["sampled_entities", "training_sample"])
def test_no_limit_of_the_sample_shows(spark, monkeypatch, name):
    sample, pairs = matcher.sample_entities, matcher.training_pairs
    monkeypatch.setattr(matcher, "sample_entities", lambda c, n: sample(c, n and 5))
    monkeypatch.setattr(matcher, "training_pairs", lambda p, t, n=5: pairs(p, t, n))
    assert same_rows(spark, name, SF) > 5


def test_equal_names_come_once_and_are_never_shuffled_as_pairs(spark, monkeypatch):
    monkeypatch.setattr(blocking, "SHARE", 7)
    schema = "entity_id string, country_key string, name string"
    a = [(f"S1-{k}", "c", f"n{k % 3}") for k in range(60)] + [("S1-0", "c", "n0"), ("S1-x", "c", "")]
    b = [(f"S2-{k}", "c", f"n{k % 4}") for k in range(80)] + [("S2-x", "c", ""), ("S2-y", "d", "n1")]

    def check(a, b):
        found = blocking.exact_name_pairs(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema))
        got = [tuple(r) for r in found.collect()]
        assert sorted(got) == sorted({(x, y) for x, c, n in a for y, d, m in b if c == d and n == m != ""})
        return found

    plan = check(a, b)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("RepartitionByExpression") and "Aggregate" not in plan[: plan.index("Generate explode")]
    check([*a, ("S1-0", "c", "n1")], [*b, ("S2-0", "c", "n1")])
