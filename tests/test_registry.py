"""Registered queries against their SQL on the small tables."""

import glob
import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as contract  # noqa: E402
from lagcast.oracles import ORACLES  # noqa: E402
from lagcast.registry import QUERIES  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
CHECKED = ["prev_stop_delay", "history_round_trip", "empirical_delta_quantiles", "forecast_source", "xml_condense_day", "synthetic_board"]


def plain(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)

    def value(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 5) + 0.0
        return v

    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    made = contract.queries()[name](spark, FOLDER)
    cursor = db.execute(contract.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(made.columns)
    assert plain(made.collect(), made.columns) == plain(cursor.fetchall(), columns)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
def test_entry_gives_rows(spark):
    cards = contract.entry(spark)
    assert cards.count() > 0
