"""Every query of the catalogue against its SQL, on whole tables."""

from __future__ import annotations

import pytest
from compare import DATA, same

import __spark_entry__ as entry
from tidewatch.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_sql(spark, name):
    sf = str(DATA / "sf0.01")
    same(catalogue.QUERIES[name](spark, sf), catalogue.ORACLES[name], sf)


def test_entry(spark):
    assert entry.entry(spark).count() == 11


def test_every_query_is_registered():
    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stream_replay(spark):
    rows = catalogue.QUERIES["stream_replay_equivalence"](spark, str(DATA / "sf0.001")).collect()
    assert rows and all(r["rows"] == r["keys"] == r["expected"] for r in rows)


def test_wide_price_math(spark):
    assert catalogue.QUERIES["wide_price_math"](spark, str(DATA / "sf0.001")).count() > 0
