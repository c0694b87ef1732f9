"""What the subpackage registers."""

import __spark_entry__ as contract
from lagcast.llm.queries import ORACLES, QUERIES


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) == {n for n in QUERIES if n[2:].split("_")[0] in ("3", "4", "11", "12")}
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries())
    assert set(ORACLES) <= set(contract.oracle_sql())
