"""Endpoints: parameters are checked and clamped."""

from __future__ import annotations

import pytest
from compare import DATA

from tidewatch.plans import api

SF = str(DATA / "sf0.001")


@pytest.mark.parametrize("path, params", [("/api/launches", {"days": "x"}), ("/api/alerts", {"limit": "1.5"}), ("/api/precision", {"horizon": "7"}), ("/api/none", {})])
def test_refused(spark, path, params):
    with pytest.raises(api.BadRequest):
        api.answer(spark, SF, path, params)


def test_clamped(spark):
    assert api.answer(spark, SF, "/api/alerts", {"limit": "-3"}).count() == 1
    assert api.answer(spark, SF, "/api/alerts", {"limit": "999"}).count() <= 200
    assert api.answer(spark, SF, "/api/launches", {"days": "0"}).count() == 1


def test_horizon(spark):
    one = api.answer(spark, SF, "/api/quartiles", {"horizon": "1-URGENT"}).collect()
    assert {r["horizon"] for r in one} == {"1-URGENT"} and len(one) == 4
