"""All queries and SQL of this subpackage."""

from __future__ import annotations

from lumenspark.llm import op1, op2, op3, op4, op5, op6, op7, op8, op9, op10, op11, op12, op13

_MODULES = (op1, op2, op3, op4, op5, op6, op7, op8, op9, op10, op11, op12, op13)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.SQL.items()}
