"""Registered queries of the image jobs and the SQL each must agree with."""

from __future__ import annotations

from lumenspark.plans import jobs, names, pixels, stored


def queries() -> dict:
    return names.QUERIES | pixels.QUERIES | jobs.QUERIES | stored.QUERIES


def oracle_sql() -> dict[str, str]:
    return names.SQL | pixels.SQL | jobs.SQL | stored.SQL
