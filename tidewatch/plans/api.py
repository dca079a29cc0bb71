"""The read-only dashboard's endpoints as parameterised queries.

A server's handler calls answer(); what it returns is small. Malformed numbers
and unknown horizons or paths are refused, numbers out of range are clamped.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from . import analytics as a

HORIZONS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


class BadRequest(ValueError):
    pass


def number(params: dict[str, str], name: str, default: int, low: int, high: int | None = None) -> int:
    text = params.get(name, str(default))
    if not re.fullmatch(r"-?\d{1,9}", text):
        raise BadRequest(f"{name} must be a whole number")
    n = max(low, int(text))
    return n if high is None else min(high, n)


def horizon(params: dict[str, str]) -> str | None:
    h = params.get("horizon")
    if h is not None and h not in HORIZONS:
        raise BadRequest("unknown horizon")
    return h


ENDPOINTS = {
    "/api/funnel": lambda s, sf, p: a.funnel_summary(s, sf),
    "/api/launches": lambda s, sf, p: a.launch_cadence(s, sf, number(p, "days", 30, 1)),
    "/api/precision": lambda s, sf, p: a.score_precision_curve(s, sf, horizon(p)),
    "/api/quartiles": lambda s, sf, p: a.feature_quartiles(s, sf, horizon(p)),
    "/api/survival": lambda s, sf, p: a.survival_by_horizon(s, sf),
    "/api/alerts": lambda s, sf, p: a.recent_alert_outcomes(s, sf, number(p, "limit", 50, 1, 200)),
    "/api/judgment": lambda s, sf, p: a.judgment_quality_version(s, sf),
}


def answer(spark: SparkSession, sf_dir: str, path: str, params: dict[str, str] | None = None) -> DataFrame:
    if path not in ENDPOINTS:
        raise BadRequest(f"no such path: {path}")
    return ENDPOINTS[path](spark, sf_dir, params or {})
