"""Every grid query against DuckDB, on the smallest tables."""

import os

import pytest

from gridloom.plans import analogues, oracles, pieces, wholes
from tests.compare import same

QUERIES, ORACLES = analogues.QUERIES | pieces.QUERIES | wholes.QUERIES, oracles.ORACLES | pieces.ORACLES | wholes.ORACLES
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    same(spark, QUERIES[name], ORACLES[name], SF)


def test_every_query_has_sql_or_a_reason():
    assert set(QUERIES) - set(ORACLES) == {"od_agents", "provenance"}


def test_entry(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert rows and [r["rank"] for r in sorted(rows, key=lambda r: -r["score"])] == sorted(r["rank"] for r in rows)
