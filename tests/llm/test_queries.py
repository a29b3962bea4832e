"""The queries against their SQL, and the columns that they return."""

from __future__ import annotations

import pytest
from compare import same_rows

from tributary.llm.oracles import ORACLES
from tributary.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ORACLES)
def test_same_as_sql(spark, name):
    assert same_rows(spark, name, SF) > 0


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
