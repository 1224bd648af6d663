"""Registered queries of this folder against their SQL, as the driver compares them."""

from __future__ import annotations

import pytest

from charscape.llm.queries import ORACLES, QUERIES
from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    assert differences(QUERIES[name](spark, SF), connect(SF), ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs_over_its_table(spark, name):
    table = "pages" if name == "op6_html" else "documents"
    rows = spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert QUERIES[name](spark, SF).count() == rows
