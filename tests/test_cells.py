"""Pairs of kinds that are made cell by cell: the same rows as by the packed index, no pair shuffled, none stored."""

from __future__ import annotations

import pytest
from compare import same_rows
from pyspark.sql import functions as F

from tributary.operators import blocking
from tributary.operators.blocking import PAIR
from tributary.plans import fixtures
from tributary.plans.fixtures import part_linkage

SF = "/root/testdata/sf0.001"
NAMES = ["missed_pairs", "blocker_recall", "rare_token_what_if", "best_threshold", "predictions", "verification", "candidate_export", "fast_validation_candidates"]
NAMES += ["set_pair_features", "edit_and_number_features", "single_token_block_any", "training_sample", "rule_f_by_source", "rule_f_candidate_cost"]


@pytest.mark.parametrize("name", NAMES)
def test_no_list_of_candidates_is_kept(spark, monkeypatch, name):
    def none(*_, **__):
        raise AssertionError("pairs by the packed index are shuffled and stored")

    monkeypatch.setattr(blocking, "candidate_pairs", none)
    monkeypatch.setattr(blocking, "CELL", (7, 11))
    same_rows(spark, name, SF)


def test_candidates_read_off_both_records(spark):
    """A token that a target repeats counts twice; a name without informative tokens only as a whole; other countries don't meet."""
    schema = "entity_id string, business_name string, business_address string, country string"
    a = [("S1-1", "zz", "main", "US"), ("S1-2", "zz", "main 10", "US"), ("S1-3", "acme tools", "", "US"), ("S1-4", "", "", "US"), ("S1-5", "acme", "5 7", "IN")]
    b = [("S2-1", "yy", "main main square", "US"), ("S2-2", "zz", "", "us"), ("S2-3", "tools", "10 main", "US"), ("S2-4", "", "", "US"), ("S2-5", "bolts", "7 5", "IN")]
    left, right = (blocking.with_repeats(blocking.prepare(spark.createDataFrame(x, schema))) for x in (a, b))
    want = sorted(tuple(r) for r in blocking.candidate_pairs(left, right).collect())
    for cell in ((1, 1), (2, 3), (100, 100)):
        found = blocking.beside(left, right, cell=cell).filter(blocking.is_candidate()).select(*PAIR)
        assert sorted(tuple(r) for r in found.collect()) == want and ("S1-2", "S2-1") in want and ("S1-1", "S2-1") not in want


def test_nothing_is_shuffled_behind_the_pairs(spark):
    x = part_linkage(spark, SF)
    assert x.cells
    plan = x.candidates._jdf.queryExecution().optimizedPlan().toString()
    assert all(n not in plan[: plan.index("Join")] for n in ("Repartition", "Aggregate", "Sort")) and plan.count("Join Inner") >= 1


def test_sparse_records_go_by_the_index(spark, monkeypatch):
    monkeypatch.setattr(blocking, "DENSE", 0)
    x = part_linkage(spark, SF)
    assert not x.cells
    y = part_linkage(spark, SF)
    monkeypatch.setattr(blocking, "DENSE", 10**9)
    assert y.cells and {tuple(r) for r in x.candidates.collect()} == {tuple(r) for r in y.candidates.collect()}


def test_keys_without_a_country_are_not_true(spark):
    rows = [("S1-1", "a", "b", None, 1), ("S2-1", "a", "b", None, 1), ("S1-2", "a", "b", "US", 1), ("S2-2", "a", "b", "US", 1)]
    records = spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string, k int")
    x = fixtures._linkage(records.drop("k").join(records.select("entity_id", F.col("k").alias("_size")), "entity_id"), F.col("_size"), kinds=True)
    assert [tuple(r) for r in x.true_kinds().select(*PAIR).collect()] == [("S1-2", "S2-2")]
