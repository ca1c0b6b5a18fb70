from __future__ import annotations

import pytest
from oracle import differences

from deckframe.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    assert differences(spark, QUERIES[name], SQL[name]) == []


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
